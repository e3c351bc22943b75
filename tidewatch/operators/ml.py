"""Rankers: fit, scores, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written
from .folds import BLOCK_ROWS, blocks, key


def fit_linear(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """One row for each feature: mean, sample deviation (1 where there is none) and weight; and the intercept.

    A weight is the difference of the labels' means in deviations, all scaled to absolute sum 1. The intercept is the logit
    of the base rate. Without both labels there is no model: no rows.
    """
    labelled = rows.where(F.col(label).isNotNull())
    one, zero = (F.col(label) == 1), (F.col(label) != 1)
    aggs = [x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}"), F.avg(F.when(one, F.col(f))).alias(f"p_{f}"), F.avg(F.when(zero, F.col(f))).alias(f"n_{f}"))]
    got = labelled.agg(F.avg(F.when(one, 1.0).otherwise(0.0)).alias("rate"), *aggs)
    parts = []
    for f in features:
        std = F.when(F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) <= 1e-9, 1.0).otherwise(F.col(f"s_{f}"))
        parts.append(F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), std.alias("std"), ((F.col(f"p_{f}") - F.col(f"n_{f}")) / std).alias("raw")))
    out = got.where((F.col("rate") > 0) & (F.col("rate") < 1)).select("rate", F.array(*parts).alias("w")).withColumn("norm", F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x["raw"])))
    each = out.select("rate", "norm", F.explode("w").alias("w")).select("rate", "norm", "w.*")
    return each.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(0.0), 6).alias("weight"), F.round(F.log(F.col("rate") / (1 - F.col("rate"))), 6).alias("intercept"))


def linear_score(model: list[dict], intercept: float, normalized: bool = True) -> Column:
    """The score of a fitted model as a column; raw features without normalization are the serving form."""
    out = F.lit(intercept if normalized else 0.0)
    for m in model:
        x = F.coalesce(F.col(m["feature"]).cast("double"), F.lit(0.0))
        out = out + F.lit(m["weight"]) * ((x - m["mean"]) / m["std"] if normalized else x)
    return S.sigmoid(out)


def auc(rows: DataFrame, *keys: str, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the curve by average ranks (ties count half).

    Scores are counted first; ranks come from running sums over distinct scores.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    below = F.coalesce(F.sum("n").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__w", F.col("p") * (below + F.col("n") / 2)).groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.round(F.when(F.sum("p") * F.sum("n") > 0, F.sum("__w") / (F.sum("p") * F.sum("n"))), 6).alias("auc"))


def precision_at(rows: DataFrame, ks: tuple[int, ...], *keys: str, score: str = "score", label: str = "label", tie: str = "doc_id") -> DataFrame:
    """Precision among the k best scores of each key."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc(score), tie)
    ranked = rows.where(F.col(label).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(ks))
    return ranked.groupBy(*keys).agg(*(F.round(F.avg(F.when(F.col("__r") <= k, F.col(label).cast("double"))), 6).alias(f"p_at_{k}") for k in ks))


def precision_thresholds(rows: DataFrame, targets: dict[str, float], *keys: str, score: str = "score", label: str = "label", tie: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each target, by its name, the first score, from the top, at which the running precision reaches it among the rows
    down to it; and n, the labelled rows, their positive_rate and mean_score.

    Where none does, the (1 - target) quantile of the scores. Running sums are taken within blocks of the order, on top of
    the sums of the blocks before, so that a key of any size is shared by many tasks; one pass serves all targets.
    """
    labelled = rows.where(F.col(label).isNotNull()).select(key(*keys).alias("__key"), F.col(score).alias("__s"), F.col(label).alias("__l"), F.col(tie).alias("__t"))
    placed = blocks(written(labelled), "__key", F.desc("__s"), "__t", block_rows=block_rows)
    totals = placed.groupBy("__key", "__block").agg(F.count("*").alias("n"), F.sum("__l").alias("l"), F.count("__s").alias("s"))
    whole = Window.partitionBy("__key")
    before = whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}0")
    offsets = totals.select("__key", "__block", offset("n"), offset("l"), F.sum("s").over(whole).alias("__m"))
    w = Window.partitionBy("__key", "__block").orderBy("__place")
    run = F.sum("__l").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.join(offsets, ["__key", "__block"]).withColumn("__r", F.col("__n0") + F.row_number().over(w)).withColumn("__p", (F.col("__l0") + run) / F.col("__r"))

    def threshold(target: float) -> Column:
        first = F.min_by("__s", F.when(F.col("__p") >= target, F.col("__r")))
        # The quantile lies between two ranks, counted from the smallest score; scores that are null rank last.
        at = (F.col("__m") - 1) * F.lit(1 - target)
        value = lambda place: F.max(F.when(F.col("__r") == F.col("__m") - place, F.col("__s")))
        share = F.max(at - F.floor(at))
        return F.round(F.coalesce(first, value(F.floor(at)) * (1 - share) + value(F.ceil(at)) * share), 6)

    out = ranked.groupBy(*(["__key"] if keys else [])).agg(
        *(threshold(t).alias(name) for name, t in targets.items()), F.count("*").alias("n"), F.round(F.avg("__l"), 6).alias("positive_rate"), F.round(F.avg("__s"), 6).alias("mean_score"))
    return out.select(*(F.col("__key")[k].alias(k) for k in keys), *targets, "n", "positive_rate", "mean_score")


def precision_threshold(rows: DataFrame, target: float, *keys: str, score: str = "score", label: str = "label", tie: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``precision_thresholds`` for one target: threshold and n."""
    return precision_thresholds(rows, {"threshold": target}, *keys, score=score, label=label, tie=tie, block_rows=block_rows).select(*keys, "threshold", "n")


#: The precision that each severity's threshold must reach.
PRECISIONS = {"watch_threshold": 0.55, "actionable_threshold": 0.65, "critical_threshold": 0.80}


def calibration_profiles(rows: DataFrame, targets: dict[str, float] | None = None, tie: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Thresholds, positive rate and mean score overall, by liquidity and by category: scope, key and ``precision_thresholds``.

    rows: score, label, dataset_partition, liquidity_bucket, category and tie. The labelled rows of the validation part
    count, or all labelled rows where that part has none; scopes without labelled rows have no profile. Null buckets and
    categories are a key of their own.
    """
    labelled = rows.where("label is not null")
    is_validation = F.coalesce(F.col("dataset_partition") == "validation", F.lit(False))
    seen = labelled.agg(F.coalesce(F.bool_or(is_validation), F.lit(False)).alias("__any"))
    used = labelled.crossJoin(F.broadcast(seen)).where(is_validation | ~F.col("__any"))  # one row
    pairs = (("global", F.lit("global")), ("liquidity_bucket", F.col("liquidity_bucket")), ("category", F.col("category")))
    scopes = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), k.cast("string").alias("key")) for s, k in pairs))).alias("p")
    each = used.select(scopes, "score", "label", F.col(tie).alias("doc_id")).select("p.*", "score", "label", "doc_id")
    return precision_thresholds(each, targets or PRECISIONS, "scope", "key", block_rows=block_rows)


def diagnostics(rows: DataFrame, features: list[str]) -> DataFrame:
    """Non-null and non-zero counts, distinct values and variance of each feature, in one pass."""
    aggs = [x for f in features for x in (F.count(f).alias(f"a_{f}"), F.count_if(F.col(f) != 0).alias(f"b_{f}"), F.countDistinct(f).alias(f"c_{f}"), F.var_samp(f).alias(f"d_{f}"))]
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"a_{f}").alias("non_null"), F.col(f"b_{f}").alias("non_zero"), F.col(f"c_{f}").alias("distinct"), F.round(f"d_{f}", 4).alias("variance")) for f in features))
    status = F.when(F.col("non_null") == 0, "empty").when(F.col("distinct") <= 1, "constant").otherwise("ok")
    return rows.agg(*aggs).select(F.explode(items).alias("x")).select("x.*").withColumn("status", status)


def content_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """Number of rows and two numbers that are the same for the same rows (repeats count) in any order.

    Sums of two independent 64-bit hashes, as decimals of 38 digits: far from overflow for any number of rows.
    """
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), wide(F.xxhash64(*columns)).alias("hash"), wide(F.xxhash64(F.lit(1), *columns)).alias("check"))
