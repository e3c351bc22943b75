"""Storage: manifests, reconciliation with files, tiering, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Storage
from ..functions import scalars as S


def manifest(envelopes: DataFrame) -> DataFrame:
    """One row for each hour and source: rows, bytes, first and last times and the last key.

    envelopes: source, ts, ordering_key, n_bytes.
    """
    return envelopes.groupBy(F.date_trunc("hour", "ts").alias("hour"), "source").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("ordering_key", F.struct("ts", "ordering_key")).alias("last_key"))


def hours(spark, start: str, end: str) -> DataFrame:  # noqa: ANN001
    """The hours of [start, end)."""
    bounds = spark.range(1).select(F.date_trunc("hour", F.lit(start).cast("timestamp")).alias("a"), F.lit(end).cast("timestamp").alias("b"))
    return bounds.select(F.explode(F.sequence("a", F.col("b") - F.expr("interval 1 microsecond"), F.expr("interval 1 hour"))).alias("hour"))


def reconciled(expected: DataFrame, files: DataFrame, manifests: DataFrame) -> DataFrame:
    """State of each expected partition (hour, source): missing, mismatched or ready, by its rows and the manifest's."""
    keys = ["hour", "source"]
    out = expected.join(files.select(*keys, F.col("rows").alias("file_rows")), keys, "left").join(manifests.select(*keys, F.col("rows").alias("manifest_rows")), keys, "left")
    state = F.when(F.col("manifest_rows").isNull() & F.col("file_rows").isNull(), "empty").when(F.col("file_rows").isNull(), "missing").when(~F.col("file_rows").eqNullSafe(F.col("manifest_rows")), "mismatched").otherwise("ready")
    return out.withColumn("state", state)


def window_health(states: DataFrame) -> DataFrame:
    """Worst state of each source: degraded if partitions are missing or differ, empty if all are, partial if some are."""
    out = states.groupBy("source").agg(F.count("*").alias("hours"), F.count_if(F.col("state") == "ready").alias("ready"), F.count_if(F.col("state") == "empty").alias("empty"), F.count_if(F.col("state").isin("missing", "mismatched")).alias("bad"))
    return out.withColumn("health", F.when(F.col("bad") > 0, "degraded").when(F.col("ready") == 0, "empty").when(F.col("empty") > 0, "partial").otherwise("ready"))


def tiered(partitions: DataFrame, c: Storage = Storage()) -> DataFrame:
    """Tier and recommended action of each partition. partitions: age_days, n_bytes, exists."""
    tier = S.storage_tier(F.col("age_days"), c)
    small = F.col("n_bytes") < c.compact_below
    action = (
        F.when(~F.col("exists") & (tier == "archive_only"), "none").when(~F.col("exists"), "restore").when(tier == "archive_only", "archive").when(tier == "cold", "move_cold")
        .when((tier == "warm") & small, "compact").when(tier == "warm", "compress").otherwise("keep")
    )
    return partitions.withColumn("tier", tier).withColumn("action", action)


def roll_up(partitions: DataFrame, *keys: str) -> DataFrame:
    """Partitions, bytes and counts by tier."""
    names = ("hot", "warm", "cold", "archive_only")
    return partitions.groupBy(*keys).agg(F.count("*").alias("partitions"), F.sum("n_bytes").alias("bytes"), *(F.count_if(F.col("tier") == t).alias(t) for t in names))


def enforcement(partitions: DataFrame, actions: tuple[str, ...], n: int = 100) -> DataFrame:
    """The n largest partitions with one of the actions; n is the batch of one pass."""
    return partitions.where(F.col("action").isin(*actions)).orderBy(F.desc("n_bytes"), "path").limit(n)


def staleness(rows: DataFrame, now: F.Column, c: Storage = Storage()) -> DataFrame:
    """Rows and the latest time of each source, and whether that is stale."""
    out = rows.groupBy("source").agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))
    hours_ago = (F.unix_micros(now) - F.unix_micros("last_ts")) / 3600e6
    return out.withColumn("status", F.when(F.col("last_ts").isNull(), "empty").when(hours_ago > c.stale_hours, "stale").otherwise("fresh"))


def first_location(artifacts: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """The first root, in order, at which each artifact exists, and its class of availability."""
    each = artifacts.select("artifact", F.posexplode(F.array(*map(F.lit, roots))).alias("priority", "root"))
    found = each.join(files.select("artifact", "root"), ["artifact", "root"]).groupBy("artifact").agg(F.min(F.struct("priority", "root")).alias("m"))
    out = artifacts.join(found, "artifact", "left")
    return out.select("artifact", F.col("m.root").alias("root"), F.when(F.col("m").isNull(), "missing").when(F.col("m.priority") == 0, "local").otherwise("external").alias("availability"))
