"""Queries of the data-quality and storage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import storage as Z
from ..sources import driver as D
from .catalog import query

_RATIO = "round(CASE WHEN {1} <> 0 THEN {0} / {1} ELSE 0 END, 6)"


@query("a35_side_coverage", f"WITH {D.TRADES}, i AS (SELECT market_id, max(CASE WHEN outcome_side = 'YES' THEN 1 ELSE 0 END) AS y, max(CASE WHEN outcome_side = 'NO' THEN 1 ELSE 0 END) AS n FROM trades GROUP BY 1) SELECT count(*) AS markets, count(*) FILTER (y = 1 AND n = 1) AS both, {_RATIO.format('count(*) FILTER (y = 1 AND n = 1)', 'count(*)')} AS ratio FROM i")
def _(spark, sf_dir):
    return Q.side_coverage(D.trades(spark, sf_dir))


@query("a36_side_coverage_by_source", f"WITH {D.TRADES}, i AS (SELECT source, market_id, max(CASE WHEN outcome_side = 'YES' THEN 1 ELSE 0 END) AS y, max(CASE WHEN outcome_side = 'NO' THEN 1 ELSE 0 END) AS n FROM trades GROUP BY 1, 2) SELECT source, count(*) AS markets, count(*) FILTER (y = 1 AND n = 1) AS both, {_RATIO.format('count(*) FILTER (y = 1 AND n = 1)', 'count(*)')} AS ratio FROM i GROUP BY 1")
def _(spark, sf_dir):
    return Q.side_coverage(D.trades(spark, sf_dir), "source")


@query("a37_two_sided", f"WITH {D.TRADES} SELECT condition_id, count(DISTINCT outcome_side) AS sides FROM trades WHERE trim(condition_id) <> '' GROUP BY 1 HAVING count(DISTINCT outcome_side) >= 2")
def _(spark, sf_dir):
    return Q.two_sided(D.trades(spark, sf_dir))


@query("a38_token_coverage", f"WITH {D.MARKETS} SELECT closed, count(*) AS total, count(*) FILTER (trim(condition_id) <> '') AS matched, {_RATIO.format('''count(*) FILTER (trim(condition_id) <> '')''', 'count(*)')} AS ratio FROM markets GROUP BY 1")
def _(spark, sf_dir):
    return Q.ratio_by(D.markets(spark, sf_dir), S.is_present(F.col("condition_id")), "closed")


_IDENTITY = f"""{D.TRADES}, ident AS (SELECT trade_id, source, priority, market_id, notional, coalesce(lower(nullif(trim(tx_hash), '')), concat_ws('|', condition_id, asset_id, outcome_side, printf('%.6f', price), printf('%.6f', size), strftime(ts, '%Y-%m-%d %H:%M:%S'))) AS identity, coalesce(trim(tx_hash) <> '', false) AS by_hash FROM trades)"""


@query("a39_duplicate_identity", f"WITH {_IDENTITY} SELECT by_hash, count(*) AS n, count(DISTINCT identity) AS identities FROM ident GROUP BY 1")
def _(spark, sf_dir):
    return Q.duplicate_identity(D.trades(spark, sf_dir)).groupBy("by_hash").agg(F.count("*").alias("n"), F.countDistinct("identity").alias("identities"))


_DUPES = "count(*) FILTER (n > 1) AS dup_groups, CAST(sum(n - 1) AS BIGINT) AS surplus, round(CASE WHEN sum(n) <> 0 THEN sum(n - 1) / sum(n) ELSE 0 END, 6) AS rate"


@query("a40_duplicate_rates", f"WITH {_IDENTITY}, g AS (SELECT identity, count(*) AS n FROM ident GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, {_DUPES} FROM g")
def _(spark, sf_dir):
    return Q.duplicate_rates(Q.duplicate_identity(D.trades(spark, sf_dir)))


@query("a42_duplicates_by_source", f"WITH {_IDENTITY}, g AS (SELECT source, identity, count(*) AS n FROM ident GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS total, {_DUPES} FROM g GROUP BY 1")
def _(spark, sf_dir):
    return Q.duplicate_rates(Q.duplicate_identity(D.trades(spark, sf_dir)), "source")


@query("a41_priority_conflicts", f"WITH {_IDENTITY}, g AS (SELECT identity, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT priority) AS priorities FROM ident GROUP BY 1 HAVING count(*) > 1) SELECT * FROM g WHERE sources > 1 OR priorities > sources")
def _(spark, sf_dir):
    return Q.priority_conflicts(Q.duplicate_identity(D.trades(spark, sf_dir)))


@query("a43_duplicate_samples", f"""WITH {_IDENTITY}, g AS (SELECT identity, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT notional) AS amounts FROM ident GROUP BY 1 HAVING count(*) > 1)
 SELECT *, concat_ws(',', 'duplicate_group', CASE WHEN sources > 1 THEN 'several_sources' END, CASE WHEN amounts > 1 THEN 'amounts_differ' END) AS reasons FROM g ORDER BY n DESC, identity LIMIT 50""")
def _(spark, sf_dir):
    return Q.duplicate_samples(Q.duplicate_identity(D.trades(spark, sf_dir)))


@query("a44_priority_coherence", f"WITH {D.TRADES}, r(source, rank) AS (VALUES ('ws', 1), ('clob', 2)) SELECT source, count(*) AS total, count(*) FILTER (priority IS DISTINCT FROM rank) AS mismatched, bool_and(rank IS NOT NULL) AS ranked FROM trades LEFT JOIN r USING (source) GROUP BY 1")
def _(spark, sf_dir):
    return Q.priority_coherence(D.trades(spark, sf_dir), {"ws": 1, "clob": 2})


_FLAGS = "count(*) AS total, count(*) FILTER (coalesce(trim(wallet), '') = '') AS missing, count(*) FILTER (trim(wallet) <> '' AND NOT regexp_matches(wallet, '^0x[0-9a-fA-F]{40}$')) AS malformed, count(*) FILTER (wallet <> lower(wallet)) AS upper_case, count(*) FILTER (lower(wallet) = lower(tx_hash)) AS equals_hash, count(*) FILTER (wallet = asset_id) AS equals_asset"


@query("a45_wallet_integrity", f"WITH {D.TRADES} SELECT source, {_FLAGS} FROM trades GROUP BY ROLLUP (source)")
def _(spark, sf_dir):
    return Q.wallet_integrity(D.trades(spark, sf_dir), "source")


@query("a46_null_rates", f"WITH {D.TRADES} SELECT source, count(*) AS total, round(avg(CASE WHEN trim(wallet) <> '' THEN 0.0 ELSE 1.0 END), 6) AS wallet, round(avg(CASE WHEN trim(condition_id) <> '' THEN 0.0 ELSE 1.0 END), 6) AS condition_id, round(avg(CASE WHEN trim(side) <> '' THEN 0.0 ELSE 1.0 END), 6) AS side FROM trades GROUP BY ROLLUP (source)")
def _(spark, sf_dir):
    return Q.null_rates(D.trades(spark, sf_dir), ["wallet", "condition_id", "side"], "source")


@query("a47_hash_population", f"WITH {D.TRADES} SELECT source, count(*) AS total, count(*) FILTER (trim(tx_hash) <> '') AS matched, {_RATIO.format('''count(*) FILTER (trim(tx_hash) <> '')''', 'count(*)')} AS ratio FROM trades GROUP BY 1")
def _(spark, sf_dir):
    return Q.ratio_by(D.trades(spark, sf_dir), S.is_present(F.col("tx_hash")), "source")


@query("a48_condition_population", f"WITH {D.TRADES}, {D.MARKETS} SELECT count(*) AS total, count(*) FILTER (trim(t.condition_id) <> '') AS present, count(*) FILTER (t.condition_id <> m.condition_id) AS mismatched, count(*) FILTER (m.condition_id IS NULL) AS market_without FROM trades t LEFT JOIN markets m USING (market_id)")
def _(spark, sf_dir):
    return Q.condition_population(D.trades(spark, sf_dir), D.markets(spark, sf_dir))


_CONDITIONS = "by_c AS (SELECT condition_id, bool_or(outcome_side = 'YES') AS yes, bool_or(outcome_side = 'NO') AS no, count(DISTINCT market_id) AS markets, count(*) AS n FROM trades WHERE trim(condition_id) <> '' GROUP BY 1)"


@query("a49_condition_integrity", f"WITH {D.TRADES}, {_CONDITIONS} SELECT *, concat_ws(',', CASE WHEN NOT yes THEN 'no_yes_trades' END, CASE WHEN NOT no THEN 'no_no_trades' END, CASE WHEN markets > 1 THEN 'several_markets' END) AS reasons FROM by_c")
def _(spark, sf_dir):
    return Q.condition_integrity(D.trades(spark, sf_dir))


@query("a50_condition_failures", f"WITH {D.TRADES}, {_CONDITIONS} SELECT condition_id, n FROM by_c WHERE NOT yes OR NOT no OR markets > 1 ORDER BY n DESC, condition_id LIMIT 50")
def _(spark, sf_dir):
    return Q.condition_integrity(D.trades(spark, sf_dir)).where("reasons <> ''").select("condition_id", "n").orderBy(F.desc("n"), "condition_id").limit(50)


@query("a51_universe_leakage", f"WITH {D.TRADES}, {D.MARKETS} SELECT count(DISTINCT market_id) AS markets, count(*) AS trades FROM trades WHERE market_id NOT IN (SELECT market_id FROM markets WHERE NOT closed)")
def _(spark, sf_dir):
    return Q.leakage(D.trades(spark, sf_dir), D.markets(spark, sf_dir).where("not closed"))


@query("a52_required_blanks", f"WITH {D.TRADES} SELECT 'wallet' AS \"column\", count(*) FILTER (coalesce(trim(wallet), '') = '') AS blank FROM trades UNION ALL SELECT 'side', count(*) FILTER (coalesce(trim(side), '') = '') FROM trades")
def _(spark, sf_dir):
    return Q.blanks(D.trades(spark, sf_dir), ["wallet", "side"])


@query("a53_roll_up", "WITH f AS (SELECT json_extract_string(props, '$.k') AS c, ts, CASE WHEN value > 95 THEN 0 WHEN value > 80 THEN 1 ELSE 2 END AS r FROM events), l AS (SELECT c, arg_max(r, ts) AS r FROM f GROUP BY 1) SELECT CASE min(r) WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status, count(*) FILTER (r = 0) AS fail, count(*) FILTER (r = 1) AS warn, count(*) FILTER (r = 2) AS pass FROM l")
def _(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    findings = e.select(F.get_json_object("props", "$.k").alias("check"), F.col("ts").alias("at"), F.when(F.col("value") > 95, "fail").when(F.col("value") > 80, "warn").otherwise("pass").alias("status"))
    return Q.rolled_up(findings)


@query("j19_sides_to_markets", f"WITH {D.TRADES}, {D.MARKETS}, s AS (SELECT market_id, count(*) FILTER (outcome_side = 'YES') AS yes, count(*) FILTER (outcome_side = 'NO') AS no FROM trades GROUP BY 1) SELECT market_id, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no FROM markets LEFT JOIN s USING (market_id)")
def _(spark, sf_dir):
    s = D.trades(spark, sf_dir).groupBy("market_id").agg(F.count_if(F.col("outcome_side") == "YES").alias("yes"), F.count_if(F.col("outcome_side") == "NO").alias("no"))
    return D.markets(spark, sf_dir).join(s, "market_id", "left").select("market_id", F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))


@query("j20_consistency", f"WITH {D.TRADES}, {D.MARKETS} SELECT source, count(*) AS n, count(*) FILTER (t.condition_id = m.condition_id) AS same, count(*) FILTER (asset_id = market_id || '-' || outcome_side) AS token_ok FROM trades t JOIN markets m USING (market_id) GROUP BY 1")
def _(spark, sf_dir):
    m = D.markets(spark, sf_dir).select("market_id", F.col("condition_id").alias("mc"))
    return D.trades(spark, sf_dir).join(m, "market_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("condition_id") == F.col("mc")).alias("same"), F.count_if(F.col("asset_id") == F.concat("market_id", F.lit("-"), "outcome_side")).alias("token_ok"))


@query("a65_ratio_by_group", f"WITH {D.TRADES} SELECT outcome_side, count(*) AS total, count(*) FILTER (side = 'SELL') AS matched, {_RATIO.format('''count(*) FILTER (side = 'SELL')''', 'count(*)')} AS ratio FROM trades GROUP BY 1")
def _(spark, sf_dir):
    return Q.ratio_by(D.trades(spark, sf_dir), F.coalesce(F.col("side") == "SELL", F.lit(False)), "outcome_side")


@query("a64_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in D.TABLES))
def _(spark, sf_dir):
    out = None
    for t in D.TABLES:
        own = D.table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = own if out is None else out.unionByName(own)
    return out


# Storage: event types are sources, an event an envelope.
def _envelopes(spark, sf_dir):  # noqa: ANN001, ANN202
    e = D.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.lpad(F.col("event_id").cast("string"), 10, "0").alias("ordering_key"), F.length("props").cast("long").alias("n_bytes"))


_MANIFEST = "man AS (SELECT date_trunc('hour', ts) AS hour, event_type AS source, count(*) AS rows, CAST(sum(length(props)) AS BIGINT) AS bytes, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(lpad(CAST(event_id AS VARCHAR), 10, '0'), (ts, event_id)) AS last_key FROM events GROUP BY 1, 2)"


@query("sk2_manifest", f"WITH {_MANIFEST} SELECT * FROM man")
def _(spark, sf_dir):
    return Z.manifest(_envelopes(spark, sf_dir))


@query("sc2_hours", "SELECT CAST(h AS TIMESTAMP) AS hour FROM range(TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '2024-01-02 07:00:00', INTERVAL 1 HOUR) t(h)")
def _(spark, sf_dir):
    return Z.hours(spark, "2024-01-01 05:30:00", "2024-01-02 07:00:00")


_RECONCILED = f"""{_MANIFEST}, fil AS (SELECT date_trunc('hour', ts) AS hour, event_type AS source, count(*) AS rows FROM events WHERE value < 99 GROUP BY 1, 2),
 ex AS (SELECT h AS hour, s AS source FROM range(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-08 00:00:00', INTERVAL 1 HOUR) t(h), (SELECT DISTINCT event_type AS s FROM events) u),
 rec AS (SELECT hour, source, fil.rows AS file_rows, man.rows AS manifest_rows, CASE WHEN man.rows IS NULL AND fil.rows IS NULL THEN 'empty' WHEN fil.rows IS NULL THEN 'missing' WHEN fil.rows IS DISTINCT FROM man.rows THEN 'mismatched' ELSE 'ready' END AS state FROM ex LEFT JOIN fil USING (hour, source) LEFT JOIN man USING (hour, source))"""


def _reconciled(spark, sf_dir):  # noqa: ANN001, ANN202
    e = D.table(spark, sf_dir, "events").where("value < 99")
    files = e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), F.col("event_type").alias("source")).agg(F.count("*").alias("rows"))
    kinds = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()
    expected = kinds.select("source", F.explode(F.expr("sequence(timestamp '2024-01-01 00:00:00', timestamp '2024-01-07 23:00:00', interval 1 hour)")).alias("hour"))
    return Z.reconciled(expected, files, Z.manifest(_envelopes(spark, sf_dir)))


@query("j21_reconciliation", f"WITH {_RECONCILED} SELECT * FROM rec")
def _(spark, sf_dir):
    return _reconciled(spark, sf_dir)


@query("a62_window_health", f"WITH {_RECONCILED} SELECT source, count(*) AS hours, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state IN ('missing', 'mismatched')) AS bad, CASE WHEN count(*) FILTER (state IN ('missing', 'mismatched')) > 0 THEN 'degraded' WHEN count(*) FILTER (state = 'ready') = 0 THEN 'empty' WHEN count(*) FILTER (state = 'empty') > 0 THEN 'partial' ELSE 'ready' END AS health FROM rec GROUP BY 1")
def _(spark, sf_dir):
    return Z.window_health(_reconciled(spark, sf_dir))


_TIERED = """par AS (SELECT 'p' || p_partkey AS path, p_brand AS source, p_size * 12.0 AS age_days, CAST(p_retailprice * 100000 AS BIGINT) AS n_bytes, p_partkey % 7 <> 0 AS ex FROM part),
 tie AS (SELECT *, CASE WHEN age_days <= 30 THEN 'hot' WHEN age_days <= 120 THEN 'warm' WHEN age_days <= 365 THEN 'cold' ELSE 'archive_only' END AS tier FROM par),
 act AS (SELECT *, CASE WHEN NOT ex AND tier = 'archive_only' THEN 'none' WHEN NOT ex THEN 'restore' WHEN tier = 'archive_only' THEN 'archive' WHEN tier = 'cold' THEN 'move_cold' WHEN tier = 'warm' AND n_bytes < 52428800 THEN 'compact' WHEN tier = 'warm' THEN 'compress' ELSE 'keep' END AS action FROM tie)"""


def _tiered(spark, sf_dir):  # noqa: ANN001, ANN202
    p = D.table(spark, sf_dir, "part")
    rows = p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_brand").alias("source"), (F.col("p_size") * 12.0).alias("age_days"), F.round(F.col("p_retailprice") * 100000).cast("long").alias("n_bytes"), (F.col("p_partkey") % 7 != 0).alias("exists"))
    return Z.tiered(rows)


@query("p45_tier_actions", f"WITH {_TIERED} SELECT path, tier, action FROM act")
def _(spark, sf_dir):
    return _tiered(spark, sf_dir).select("path", "tier", "action")


@query("a31_storage_roll_up", f"WITH {_TIERED} SELECT source, count(*) AS partitions, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(*) FILTER (tier = 'hot') AS hot, count(*) FILTER (tier = 'warm') AS warm, count(*) FILTER (tier = 'cold') AS cold, count(*) FILTER (tier = 'archive_only') AS archive_only FROM act GROUP BY 1")
def _(spark, sf_dir):
    return Z.roll_up(_tiered(spark, sf_dir), "source")


@query("t7_enforcement", f"WITH {_TIERED} SELECT path, n_bytes, action FROM act WHERE action IN ('archive', 'compact') ORDER BY n_bytes DESC, path LIMIT 100")
def _(spark, sf_dir):
    return Z.enforcement(_tiered(spark, sf_dir), ("archive", "compact")).select("path", "n_bytes", "action")


@query("a34_staleness", "SELECT event_type AS source, count(*) AS rows, max(ts) AS last_ts, CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(max(ts))) / 3600e6 > 24 THEN 'stale' ELSE 'fresh' END AS status FROM events GROUP BY 1")
def _(spark, sf_dir):
    return Z.staleness(_envelopes(spark, sf_dir), F.lit("2024-01-31 12:00:00").cast("timestamp"))


@query("j25_first_location", "WITH a AS (SELECT 'p' || p_partkey AS artifact, p_partkey FROM part), f AS (SELECT artifact, 'local' AS root, 0 AS pr FROM a WHERE p_partkey % 3 = 0 UNION ALL SELECT artifact, 'mirror', 1 FROM a WHERE p_partkey % 2 = 0), m AS (SELECT artifact, arg_min(root, pr) AS root, min(pr) AS pr FROM f GROUP BY 1) SELECT artifact, root, CASE WHEN pr IS NULL THEN 'missing' WHEN pr = 0 THEN 'local' ELSE 'external' END AS availability FROM a LEFT JOIN m USING (artifact)")
def _(spark, sf_dir):
    a = D.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("artifact"), "p_partkey")
    f = a.where("p_partkey % 3 = 0").select("artifact", F.lit("local").alias("root")).unionByName(a.where("p_partkey % 2 = 0").select("artifact", F.lit("mirror").alias("root")))
    return Z.first_location(a.select("artifact"), f, ["local", "mirror"])


@query("w13_hour_histogram", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))


@query("a21_runtime_status", "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS last_ts FROM events")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.col("ts").cast("timestamp")).alias("last_ts"))


@query("a23_budget_usage", "SELECT 'p' || (event_id % 3) AS provider, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16') AS today, count(*) AS month, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS spent FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1")
def _(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01'")
    return e.groupBy(F.concat(F.lit("p"), F.col("event_id") % 3).alias("provider")).agg(F.count_if(F.expr("ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16'")).alias("today"), F.count("*").alias("month"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("spent"))


@query("w18_first_occurrence", "SELECT user_id, arg_min(event_type, event_id) AS first_type, min(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("event_id"))


@query("a63_merged_updates", f"WITH {D.TRADES} SELECT market_id, ts, arg_max(price, trade_id) FILTER (outcome_side = 'YES') AS yes_price, arg_max(price, trade_id) FILTER (outcome_side = 'NO') AS no_price FROM trades GROUP BY 1, 2")
def _(spark, sf_dir):
    side = lambda s: F.max_by("price", F.when(F.col("outcome_side") == s, F.col("trade_id")))
    return D.trades(spark, sf_dir).groupBy("market_id", "ts").agg(side("YES").alias("yes_price"), side("NO").alias("no_price"))


@query("sk10_score_upsert", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


