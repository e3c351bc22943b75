"""A corpus pipeline over documents: each stage works on all that its predecessor kept.

The stages are not expressible in SQL as a whole (models, component search, tokenizing), so ORACLE_SQL is None; their
tests compare them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, languages, packing, pii, similarity
from tidewatch.llm.common import read, shared_dir, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without words (null and empty texts, too) or without a probable language.

    Whole texts count, however long. Rows that agree in doc_id and text share their fate; null lang or source is no
    evidence; of equally probable languages the first in alphabetical order wins. Where no row has a lang, all with words stay.
    """
    return languages.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Of repeated rows of one id, and of rows without an id with the same text, one stays. Texts without words are in no group.
    """
    return similarity.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark windows.

    Null and empty texts have no words and stay; repeated rows share their fate; items without an id count.
    """
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows.

    A null text stays null; of spans that overlap one mask stays; equal rows get equal results.
    """
    return pii.with_sizes(pii.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null and empty texts are the end id alone; repeated rows are packed each for itself, and a null id stays null.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again by the next."""
    out, base = read(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = written(stage(spark, out, sf_dir), f"{base}/{i}-{name}")
    return out
