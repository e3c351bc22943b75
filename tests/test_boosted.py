"""Boosted trees: what a line can't rank, missing numbers, single labels."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boosted


@pytest.fixture(scope="module")
def rows(spark):
    """Label 1 where x and y lie on different sides, and a seventh of the labels missing."""
    df = spark.range(1200).select("id", (F.rand(1) - 0.5).alias("x"), (F.rand(2) - 0.5).alias("y"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    return df.withColumn("label", F.when(F.col("id") % 7 != 0, (F.col("x") * F.col("y") < 0).cast("int"))).cache()


def test_ranks_what_a_line_cannot(rows):
    c = boosted.Boosting(rounds=15, depth=3)
    got = {(r.model, r.split): r for r in boosted.compared(rows, ["x", "y"], "split", "train", c=c).collect()}
    assert set(got) == {(m, s) for m in ("boosted", "linear") for s in ("test", "train")}
    assert got["boosted", "test"].auc > 0.95 and got["linear", "test"].auc < 0.65
    labelled = rows.where("split = 'test' and label is not null")
    assert got["boosted", "test"].positives + got["boosted", "test"].negatives == labelled.count()


def test_scores_of_missing_numbers(rows):
    model = boosted.fit(rows, ["x", "y"], c=boosted.Boosting(rounds=5))
    odd = rows.limit(3).withColumn("x", F.when(F.col("id") >= 0, F.lit(float("nan")))).withColumn("y", F.lit(None).cast("double")).withColumn("probability", F.lit("kept"))
    got = boosted.scored(odd, ["x", "y"], model).collect()
    assert len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1 and got[0].probability == "kept"
    assert abs(sum(boosted.importances(["x", "y"], model).values()) - 1) < 1e-5
    plan = boosted.scored(rows, ["x", "y"], model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_no_model_of_one_label(rows):
    assert boosted.fit(rows.where("label = 1"), ["x"]) is None
    assert boosted.compared(rows.where("label = 1"), ["x"], "split", "train").count() == 0
