"""The corpus pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from compare import differences, duck

from tidewatch.llm import decontaminate, pii, queries, similarity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF).cache()
        assert df.columns == docs.columns
        kept[name] = {r.doc_id for r in df.collect()}
    assert kept["language"] >= kept["near_duplicates"] >= kept["decontamination"] == kept["personal_data"]
    groups = similarity.grouped(docs.where(docs.doc_id.isin(list(kept["language"]))), 5, 80).collect()
    assert kept["near_duplicates"] == {r.doc_id for r in groups if r.doc_id == r.component_id}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contamination(df, bench).where("contaminated").count() == 0
    assert pii.report(df).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["personal_data"]


def test_sql(spark):
    c = duck(SF)
    for name, sql in queries.oracle_sql().items():
        assert differences(spark, c, queries.queries()[name], sql, SF) == ""


def test_names():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
