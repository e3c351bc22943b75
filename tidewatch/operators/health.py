"""Health of the archive and of what runs on it: roll-ups of an audit, a dashboard, status ladders, schema contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written


@dataclass(frozen=True)
class Actions:
    """What an audit recommends that counts as compaction, and as a move to cold storage."""

    compact: tuple[str, ...] = ("compact_candidate", "compact_and_cold_archive")
    cold: tuple[str, ...] = ("cold_archive_candidate", "compact_and_cold_archive")


_COUNTS = ("partitions", "bytes", "missing", "compact", "cold")


def _counted(decisions: DataFrame, *keys: str, c: Actions = Actions()) -> DataFrame:
    action = F.col("action")
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("partitions"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_if(~F.coalesce("exists", F.lit(False))).alias("missing"),
        F.count_if(action.isin(*c.compact)).alias("compact"), F.count_if(action.isin(*c.cold)).alias("cold"))


def integrity_summary(decisions: DataFrame, c: Actions = Actions()) -> DataFrame:
    """Counts of an audit by source, with their place by missing files, then bytes, then name; and a last row of totals.

    decisions: source, n_bytes, exists, action. The row of totals has no source, the number of sources in ``place`` and the
    status: missing_partitions_detected, empty_window or ready. A source that is null counts as one, named unknown. The
    decisions are read once; what follows works on one row for each source.
    """
    by = written(_counted(decisions.withColumn("source", F.coalesce("source", F.lit("unknown"))), "source", c=c))
    order = F.array_sort(F.collect_list(F.struct((-F.col("missing")).alias("a"), (-F.col("bytes")).alias("b"), "source")))
    places = by.agg(order.alias("o")).select(F.posexplode("o").alias("p", "s")).select((F.col("p") + 1).alias("place"), F.col("s.source").alias("source"))
    rows = by.join(places, "source").select("source", "place", *_COUNTS, F.lit(None).cast("string").alias("status"))
    sums = by.agg(F.count("*").cast("int").alias("place"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _COUNTS))
    status = F.when(F.col("missing") > 0, "missing_partitions_detected").when(F.col("partitions") == 0, "empty_window").otherwise("ready")
    return rows.unionByName(sums.withColumns({"source": F.lit(None).cast("string"), "status": status}).select(rows.columns))


def dashboard(decisions: DataFrame, top: int = 10) -> DataFrame:
    """Sections of a dashboard: the top sources by bytes, partitions by action and tier, the largest partitions.

    decisions: path, source, n_bytes, exists, action, tier. Columns: section, key, n, bytes, missing; top is the length of the
    two lists. A partition's n is 1. Sources, actions and tiers come from one pass, the largest partitions are a top-k.
    """
    pair = lambda section, k: F.struct(F.lit(section).alias("section"), F.coalesce(F.col(k), F.lit("unknown")).alias("key"))
    each = decisions.select(F.explode(F.array(pair("source", "source"), pair("action", "action"), pair("tier", "tier"))).alias("p"), "n_bytes", "exists")
    missing = ~F.coalesce("exists", F.lit(False))
    by = written(each.groupBy("p.section", "p.key").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("long").alias("bytes"), F.count_if(missing).alias("missing")))
    sources = by.where("section = 'source'").orderBy(F.desc("bytes"), "key").limit(top)
    size = F.coalesce(F.col("n_bytes"), F.lit(0)).cast("long")
    parts = decisions.select(F.lit("partition").alias("section"), F.col("path").alias("key"), F.lit(1).cast("long").alias("n"), size.alias("bytes"), missing.cast("long").alias("missing"))
    return sources.unionByName(by.where("section <> 'source'")).unionByName(parts.orderBy(F.desc("bytes"), "key").limit(top))


def runtime(alerts: DataFrame, scores: DataFrame, models: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: alerts and shadow scores of the last hours, and the active model of the latest activation, if any.

    alerts, scores: ts. models: model, status, activated_ts. What has no time isn't recent.
    """
    since = F.unix_micros(now) - hours * 3_600_000_000
    recent = lambda df, name: df.agg(F.count_if(F.unix_micros("ts") >= since).alias(name))
    active = models.where("status = 'active'").agg(F.max_by("model", F.struct(F.col("activated_ts").isNotNull(), "activated_ts", "model")).alias("active_model"))
    return recent(alerts, "recent_alerts").crossJoin(recent(scores, "recent_scores")).crossJoin(active)  # one row each


def ladders(audits: DataFrame, running: DataFrame, now: Column, stale_hours: float = 48.0) -> DataFrame:
    """One row: the last audit, its age, the archive's health and whether redundancy can be designed, with what is in the way.

    audits: audit_id, ts, missing. running: the row of ``runtime``. Health is no_storage_audit_yet, missing_archive_files,
    stale_storage_audit or ok; blockers are an array. Without audits there is still a row. An audit without a time counts as
    the earliest; if there is no other, its age is null.
    """
    last = audits.agg(F.max_by(F.struct("audit_id", "ts", "missing"), F.struct(F.col("ts").isNotNull(), "ts", "audit_id")).alias("a")).select("a.*")
    age = (F.unix_micros(now) - F.unix_micros("ts")) / 3_600_000_000
    known, gone, stale = F.col("audit_id").isNotNull(), F.coalesce("missing", F.lit(0)) > 0, F.coalesce(age > stale_hours, F.lit(False))
    health = F.when(~known, "no_storage_audit_yet").when(gone, "missing_archive_files").when(stale, "stale_storage_audit").otherwise("ok")
    blockers = F.array_compact(F.array(
        F.when(~known, "no_storage_audit_yet"), F.when(known & F.col("ts").isNull(), "storage_audit_has_invalid_timestamp"), F.when(known & stale, "storage_audit_is_stale"),
        F.when(known & gone, "missing_archive_files_detected"), F.when(F.col("recent_scores") <= 0, "no_recent_shadow_scores"), F.when(F.col("active_model").isNull(), "no_active_shadow_model")))
    out = last.crossJoin(running)  # one row each
    out = out.select("audit_id", F.round(age, 3).alias("age_hours"), F.coalesce("missing", F.lit(0)).alias("missing"), "recent_alerts", "recent_scores", "active_model", health.alias("health"), blockers.alias("blockers"))
    return out.withColumn("redundancy", F.when(F.size("blockers") == 0, "ready_for_redundancy_design").otherwise("not_ready_for_redundancy_design"))


def contract_gaps(spark: SparkSession, tables: dict[str, DataFrame | None], contract: dict[str, StructType]) -> DataFrame:
    """What tables lack of a contract: table, column, problem (missing_table, missing_column, other_type), wanted, found.

    Only schemas are looked at. Nullability isn't part of the contract; tables that it doesn't name are left alone.
    """
    rows: list[tuple[str, str | None, str, str | None, str | None]] = []
    for name, wanted in contract.items():
        df = tables.get(name)
        if df is None:
            rows.append((name, None, "missing_table", None, None))
            continue
        have = {f.name: f.dataType.simpleString() for f in df.schema}
        for f in wanted:
            kind = f.dataType.simpleString()
            if f.name not in have:
                rows.append((name, f.name, "missing_column", kind, None))
            elif have[f.name] != kind:
                rows.append((name, f.name, "other_type", kind, have[f.name]))
    return spark.createDataFrame(rows, "table string, column string, problem string, wanted string, found string")
