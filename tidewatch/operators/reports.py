"""Reports and decisions over small results: baselines, gates, findings, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def heuristics() -> dict[str, Column]:
    """Baseline scores of a candidate's features; missing features count as 0."""
    x = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(0.0))
    momentum = F.least(F.lit(1.0), x("velocity") / 0.05)
    micro = 0.35 * x("fresh_share") + 0.25 * x("imbalance") + 0.20 * x("concentration") + 0.10 * momentum + 0.10 * F.least(F.lit(1.0), x("volume_acceleration") / 2)
    return {"momentum": momentum, "imbalance_only": x("imbalance"), "microstructure": micro, "fresh_wallet": F.when(x("fresh_count") >= 3, 1.0).otherwise(0.0)}


def compared(reports: DataFrame, model: str, baselines: list[str]) -> DataFrame:
    """Margin of a model over each baseline on the best split there is (test, validation, train).

    reports: split, name, value.
    """
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "validation", 1).otherwise(2)
    best = reports.groupBy("name").agg(F.min(F.struct(rank.alias("r"), "split", "value")).alias("b")).select("name", "b.split", "b.value")
    own = best.where(F.col("name") == model).select(F.col("split").alias("model_split"), F.col("value").alias("model_value"))
    out = best.where(F.col("name").isin(baselines)).crossJoin(F.broadcast(own))  # one row
    margin = F.round(F.col("model_value") - F.col("value"), 6)
    status = F.when(F.col("split") != F.col("model_split"), "not_comparable").when(margin > 0, "above").when(margin == 0, "equal").otherwise("below")
    return out.select(F.col("name").alias("baseline"), "split", margin.alias("margin"), status.alias("status"))


def gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """Whether all metrics of each name reach their least values, and how many don't. metrics: name, metric, value."""
    need = F.lit(None).cast("double")
    for k, v in least.items():
        need = F.when(F.col("metric") == k, F.lit(float(v))).otherwise(need)
    low = need.isNotNull() & ~F.coalesce(F.col("value") >= need, F.lit(False))
    return metrics.groupBy("name").agg(F.count_if(low).alias("short"), (F.count_if(low) == 0).alias("passed"))


def findings(ratios: DataFrame, ladder: dict[str, tuple[float, float]]) -> DataFrame:
    """Findings of each row of ratios: a level for each ratio that passes its watch or act threshold."""
    items = [F.when(F.col(c) >= act, F.concat(F.lit(f"{c}:act"))).when(F.col(c) >= watch, F.lit(f"{c}:watch")) for c, (watch, act) in ladder.items()]
    return ratios.withColumn("findings", F.array_join(F.array_compact(F.array(*items)), ","))


def listing(rows: DataFrame, n: int, order: list[Column], **filters: str | None) -> DataFrame:
    """The n first rows by order, of those that match the filters that are given."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order).limit(n)


def ablation(families: list[str], artifacts: DataFrame) -> DataFrame:
    """One row for each family in order: its first artifact, a placeholder where there is none, and whether hashes agree.

    artifacts: family, seq, artifact, dataset_hash.
    """
    spark = artifacts.sparkSession
    dim = spark.createDataFrame(list(enumerate(families)), "place long, family string")
    first = artifacts.groupBy("family").agg(F.min_by("artifact", "seq").alias("artifact"), F.min_by("dataset_hash", "seq").alias("dataset_hash"))
    kinds = first.where(F.col("family").isin(families)).agg(F.countDistinct("dataset_hash").alias("kinds"))
    out = dim.join(first, "family", "left").crossJoin(F.broadcast(kinds))  # one row
    return out.select("place", "family", F.coalesce("artifact", F.lit("missing")).alias("artifact"), F.when(F.col("artifact").isNull(), "placeholder").when(F.col("kinds") > 1, "hash_mismatch").otherwise("ok").alias("status"))


def resolutions(frames: DataFrame, by_condition: DataFrame, by_token: DataFrame) -> DataFrame:
    """Outcome of each resolved frame by its final price, and its market by condition, else by token.

    frames: id, condition_id, asset_id, final_price. by_condition: condition_id, market_id. by_token: asset_id, market_id.
    """
    outcome = F.when(F.col("final_price") >= 0.99, "YES").when(F.col("final_price") <= 0.01, "NO").otherwise("N/A")
    a, b = by_condition.withColumnRenamed("market_id", "m1"), by_token.withColumnRenamed("market_id", "m2")
    return frames.join(a, "condition_id", "left").join(b, "asset_id", "left").select("id", F.coalesce("m1", "m2").alias("market_id"), outcome.alias("outcome"))


def observed(rows: DataFrame) -> DataFrame:
    """The strongest stage that each row reached. rows: public, reviewed, visible, created, scored (booleans)."""
    out = F.lit("candidate")
    for c in ("scored", "created", "visible", "reviewed", "public"):
        out = F.when(F.coalesce(F.col(c), F.lit(False)), c).otherwise(out)
    return rows.withColumn("bucket", out)


def parents(alerts: DataFrame) -> DataFrame:
    """Each suppressed alert with the one that its state names (``suppressed_by:<id>``)."""
    named = alerts.withColumn("parent_id", F.regexp_extract("state", r"suppressed_by:([0-9]+)", 1).try_cast("long"))
    other = alerts.select(F.col("id").alias("parent_id"), F.col("rank").alias("parent_rank"))
    return named.where("parent_id is not null").join(other, "parent_id", "left").select("id", "parent_id", "parent_rank")


def split_frames(rows: DataFrame, order: Column, fractions: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Adds train, validation or test by position in order, cut at the fractions; places come from counts of each key."""
    counts = rows.groupBy(order.alias("__o")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("__share", before / F.sum("__c").over(Window.partitionBy(F.lit(0))))
    name = F.when(F.col("__share") < fractions[0], "train").when(F.col("__share") < fractions[1], "validation").otherwise("test")
    return rows.withColumn("__o", order).join(placed.select("__o", name.alias("partition")), "__o").drop("__o")


def normalized_identity(price: Column, size: Column, ts: Column) -> Column:
    """Numbers and time in a common text form; what isn't a number is empty."""
    number = lambda c: F.when(c.try_cast("double").isNotNull(), F.format_string("%.8f", c.try_cast("double"))).otherwise("")
    return F.concat_ws("|", number(price), number(size), F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("")))


def lifecycle_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(S.safe_ratio(F.count_if(F.col("delivered")), F.count("*")), 6).alias("delivered_share"))
