"""Sinks: ledgers, refreshes, samples, alert channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refresh(df: DataFrame, path: str, *scope: str) -> None:
    """Replaces a table, or, with scope columns, only the partitions that df has rows of."""
    writer = df.write.mode("overwrite")
    if scope:
        writer = writer.partitionBy(*scope).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append_new(df: DataFrame, path: str, *key: str) -> None:
    """Appends the rows whose key the table at path lacks: running it again adds nothing."""
    spark = df.sparkSession
    rows = df.dropDuplicates(list(key))
    try:
        have = spark.read.parquet(path).select(*key)
    except Exception as e:  # noqa: BLE001  no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        rows = rows.join(have, list(key), "left_anti")
    rows.write.mode("append").parquet(path)


def upsert(df: DataFrame, path: str, target: str, *key: str) -> None:
    """Writes to target the table at path with df's rows in place of those of the same key."""
    old = df.sparkSession.read.parquet(path)
    old.join(df.select(*key), list(key), "left_anti").unionByName(df).write.mode("overwrite").parquet(target)


def sample(df: DataFrame, path: str, n: int, *order: F.Column) -> None:
    """The n first rows by order as one CSV file with a header; n is the size of the report."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def deliver(channels: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands each channel its rows of a batch, which is computed once.

    Rows of a channel that isn't known (or null) are an error before anything is sent.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            lost = df.where(~F.coalesce(F.col("channel").isin(list(channels)), F.lit(False))).select("channel").first()
            if lost is not None:
                raise ValueError(f"no channel {lost[0]!r} for a row of batch {number}")
            for name, send in channels.items():
                send(df.where(F.col("channel") == name), number)
        finally:
            df.unpersist()

    return batch


def feed_items(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The first n items of each RSS file below path; n is the size of the report."""
    raw = spark.read.format("xml").option("rowTag", "channel").schema("title string, item array<struct<title:string,link:string,pubDate:string>>").load(path)
    return raw.select(F.col("title").alias("feed"), F.posexplode(F.slice(F.coalesce("item", F.array()), 1, n)).alias("place", "i")).select("feed", "place", "i.*")
