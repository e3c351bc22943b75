"""Summaries of held-out splits: candidates, alerts, lead times and paper trades, by family, category and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions import scalars as S
from . import evaluation as E

UNITS = ("candidates", "alerts", "lead_times", "trades")


def split_status(unit: Column, total: Column, eligible: Column, resolved: Column, families: Column, categories: Column, coverage: Column, c: Evaluation = Evaluation()) -> Column:
    """What a split's numbers are good for; the first that holds. Lead times are judged as alerts."""
    least = F.when(unit == "candidates", c.candidate_rows).when(unit == "trades", c.trade_rows).otherwise(c.alert_rows)
    few = (eligible < least) | (resolved < c.resolved_rows) | (families < c.families) | (categories < c.categories)
    return F.when((total == 0) | (coverage < c.coverage), "coverage_insufficient").when(few, "descriptive_only").otherwise("scored")


def keyed(rows: DataFrame, c: Evaluation = Evaluation()) -> DataFrame:
    """rows (see ``summaries``) with the keys of the three regimes: fold, category, block; and block at the alert's time."""
    out = E.family_folds(rows, "event_family_id", c)
    return out.withColumns({
        "fold": F.coalesce("fold", F.lit("fold_unknown")),
        "category": F.coalesce(S.blank_to_null(F.col("category")), F.lit("unknown")),
        "block": F.coalesce(S.time_block(F.col("trigger_ts"), c), F.lit("time_block:unknown")),
        "alert_block": F.coalesce(S.time_block(F.coalesce("alert_ts", "trigger_ts"), c), F.lit("time_block:unknown")),
    })


def _regimes(block: str) -> Column:
    pairs = (("event_family_holdout", "fold"), ("category_holdout", "category"), ("time_split_holdout", block))
    return F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), F.col(k).alias("key")) for r, k in pairs))).alias("p")


def summaries(rows: DataFrame, trades: DataFrame, c: Evaluation = Evaluation()) -> DataFrame:
    """Rows, eligible and resolved rows, families, categories, coverage and status of each unit's splits.

    rows: id, event_family_id, category, trigger_ts, alert_id, alert_ts, outcome, resolved_ts, coverage_status. trades: id (of
    the row), status. Trades without a row are left out. All units and regimes are counted in one pass: each row goes to
    every split that it belongs to, and tasks combine their own counts first.
    """
    base = keyed(rows, c)
    columns = ("event_family_id", "category", "outcome", "resolved_ts", "coverage_status")
    own = base.select(F.explode(F.array(F.lit("candidates"), *(F.when(F.col("alert_id").isNotNull(), u) for u in ("alerts", "lead_times")))).alias("unit"), "fold", "block", "alert_block", *columns).where("unit is not null")
    own = own.withColumn("at", F.when(F.col("unit") == "candidates", F.col("block")).otherwise(F.col("alert_block")))
    own = own.select("unit", _regimes("at"), *columns, F.lit(1).alias("eligible"))
    met = trades.select("id", F.col("status").alias("__s")).join(base, "id")
    met = met.select(F.lit("trades").alias("unit"), _regimes("block"), *columns, F.coalesce(F.col("__s").isin("filled", "resolved"), F.lit(False)).cast("int").alias("eligible"))
    each = own.unionByName(met).select("unit", "p.*", *columns, "eligible")
    some = F.col("event_family_id").isNull().cast("int")
    out = each.groupBy("unit", "regime", "key").agg(
        F.count("*").alias("total_rows"), F.sum("eligible").alias("eligible_rows"), F.count_if(F.col("outcome").isNotNull() & F.col("resolved_ts").isNotNull()).alias("resolved_rows"),
        (F.countDistinct("event_family_id") + F.max(some)).alias("distinct_families"), F.countDistinct("category").alias("distinct_categories"),
        (F.count_if(~F.col("coverage_status").eqNullSafe("coverage_insufficient")) / F.count("*")).alias("__c"))
    status = split_status(*(F.col(n) for n in ("unit", "total_rows", "eligible_rows", "resolved_rows", "distinct_families", "distinct_categories", "__c")), c)
    return out.withColumn("coverage_ratio", F.round("__c", 6)).withColumn("status", status).drop("__c")


def candidate_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, label coverage, precision, false positives, reach and median severity. label: 1, 0 or null."""
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    n, labelled, hits = F.count("*"), F.count("label"), F.count_if(F.col("label") == 1)
    severity = F.coalesce(F.col("severity").cast("double"), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        n.alias("n_candidates"), F.countDistinct("market_id").alias("distinct_markets"), F.countDistinct("event_family_id").alias("distinct_families"), share(labelled, n).alias("label_coverage"),
        share(hits, labelled).alias("precision"), share(labelled - hits, labelled).alias("false_positive_rate"), share(F.count("outcome"), n).alias("reach_rate"), F.round(F.median(severity), 6).alias("median_severity"))


def lead_time_metrics(rows: DataFrame, *keys: str, c: Evaluation = Evaluation()) -> DataFrame:
    """Of alerts that came true before the resolution: how long before. Keys without one have no row."""
    lead = F.unix_micros("resolved_ts") / 1e6 - F.unix_micros("alert_ts") / 1e6
    timed = rows.where("label = 1 and alert_id is not null").withColumn("lead", lead).where("lead > 0")
    return E.lead_times(timed, "lead", *keys, c=c)


def metrics(rows: DataFrame, trades: DataFrame, c: Evaluation = Evaluation()) -> DataFrame:
    """Metrics of the four families by regime and key, in long form (``evaluation.holdout_metrics``).

    rows as for ``summaries``, with market_id, severity, label, useful, delivered; trades with pnl.
    """
    base = keyed(rows, c)
    met = trades.select("id", "pnl").join(base.drop("pnl"), "id")
    alerts = base.where("alert_id is not null")
    by = {"event_family_holdout": "fold", "category_holdout": "category"}
    first = E.holdout_metrics({"candidates": (base, candidate_metrics), "trades": (met, E.trade_metrics)}, by | {"time_split_holdout": "block"})
    return first.unionByName(E.holdout_metrics({"alerts": (alerts, E.alert_metrics), "lead_times": (alerts, lead_time_metrics)}, by | {"time_split_holdout": "alert_block"}))
