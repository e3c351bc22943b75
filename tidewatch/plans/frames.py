"""Queries of training frames, held-out splits, nested JSON, merged tables and points of the log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Evaluation
from ..operators import frames, holdouts, nested
from ..session import folder
from ..sources import driver as D
from ..sources import log, store
from .catalog import query

#: The events table spans thirty days, so blocks of time have five.
C = Evaluation(block_days=5, families=4)


def _events(spark, sf_dir):  # noqa: ANN001, ANN202
    return D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_BLOCK = lambda t: f"'time_block:' || strftime(DATE '1970-01-01' + CAST(floor(epoch({t}) / 432000) * 5 AS INTEGER), '%Y-%m-%d') || ':' || strftime(DATE '1970-01-01' + CAST(floor(epoch({t}) / 432000) * 5 + 5 AS INTEGER), '%Y-%m-%d')"
_KINDS = ", ".join(D.kind_sql(n, k) for n, k in (("rows", "purchase"), ("quotes", "click"), ("evidence", "view"), ("resolutions", "error")))


@query("m1_training_frame", f"""WITH {_KINDS}, {D.MARKETS}, r AS (SELECT rows.*, event_id AS family, CASE WHEN id % 3 < 2 THEN CAST(id % 3 AS INTEGER) END AS label FROM rows LEFT JOIN markets USING (market_id)),
f AS (SELECT family, row_number() OVER (ORDER BY family) AS n FROM (SELECT DISTINCT family FROM r WHERE family IS NOT NULL)),
b AS (SELECT *, coalesce({_BLOCK('ts')}, 'time_block:unknown') AS block FROM r), k AS (SELECT block, row_number() OVER (ORDER BY block DESC) AS n FROM (SELECT DISTINCT block FROM b)),
q AS (SELECT b.id, arg_max(q.value, (q.ts, q.id)) AS last_quote FROM b JOIN quotes q ON q.market_id = b.market_id AND q.ts <= b.ts GROUP BY 1),
e AS (SELECT b.id, arg_max(e.value, (e.ts, e.id)) AS last_evidence FROM b JOIN evidence e ON e.market_id = b.market_id AND e.ts <= b.ts AND e.ts >= b.ts - INTERVAL 1 DAY GROUP BY 1),
s AS (SELECT b.id, arg_max(s.id, (s.ts, s.id)) AS last_resolution FROM b JOIN resolutions s ON s.market_id = b.market_id AND s.ts <= b.ts GROUP BY 1),
l AS (SELECT b.id, arg_min(q.value, (q.ts, q.id)) / 1000.0 AS spread FROM b JOIN quotes q ON q.market_id = b.market_id AND q.ts >= b.ts AND q.ts <= b.ts + INTERVAL 12 HOUR GROUP BY 1)
SELECT b.id, last_quote, last_evidence, last_resolution, coalesce('fold_' || ((f.n - 1) % 5 + 1) || '_of_5', 'fold_unknown') AS event_family_holdout, block AS time_holdout, CASE k.n WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS dataset_partition,
 CAST(label AS DOUBLE) AS label_success, CASE WHEN spread IS NULL OR spread < 0 THEN 'unknown' WHEN spread <= 0.02 THEN 'tight' WHEN spread <= 0.05 THEN 'mid' ELSE 'wide' END AS liquidity_bucket
FROM b LEFT JOIN f USING (family) JOIN k USING (block) LEFT JOIN q USING (id) LEFT JOIN e USING (id) LEFT JOIN s USING (id) LEFT JOIN l USING (id)""")
def _(spark, sf_dir):
    m = D.markets(spark, sf_dir).select("market_id", F.col("event_id").alias("event_family_id"), "category")
    rows = D.kind(spark, sf_dir, "purchase").join(m, "market_id", "left")
    rows = rows.select("id", "market_id", "event_family_id", "category", "ts", F.lit(0.0).alias("velocity"), F.lit(0.0).alias("acceleration"), F.when(F.col("id") % 3 < 2, (F.col("id") % 3).cast("int")).alias("label"))
    streams = {n: D.kind(spark, sf_dir, k) for n, k in (("quotes", "click"), ("evidence", "view"), ("resolutions", "error"))}
    spreads = streams["quotes"].select("market_id", "ts", "id", (F.col("value") / 1000.0).alias("spread"))
    out = frames.training_frame(rows, streams, spreads, C, dict.fromkeys(streams, "id"), {"evidence": 86_400}, 12 * 3600)
    return out.select("id", F.col("quotes.value").alias("last_quote"), F.col("evidence.value").alias("last_evidence"), F.col("resolutions.id").alias("last_resolution"),
                      "event_family_holdout", "time_holdout", "dataset_partition", "label_success", "liquidity_bucket")


_ROWS = """e AS (SELECT event_id AS id, CASE WHEN user_id % 11 <> 0 THEN 'f' || (user_id % 11) END AS family, event_type AS category, ts AS trigger_ts, value > 50 AS alerted, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label,
 event_id % 5 <> 0 AS resolved, value * 3 % 10 < 8 AS covered, json_extract_string(props, '$.k') AS market_id, value FROM events),
f AS (SELECT family, row_number() OVER (ORDER BY family) AS n FROM (SELECT DISTINCT family FROM e WHERE family IS NOT NULL)),
k AS (SELECT e.*, coalesce('fold_' || ((n - 1) % 5 + 1) || '_of_5', 'fold_unknown') AS fold, """ + _BLOCK("trigger_ts") + """ AS block, """ + _BLOCK("trigger_ts + INTERVAL 1 HOUR") + """ AS ablock FROM e LEFT JOIN f USING (family)),
u AS (SELECT 'candidates' AS unit, block AS place, 1 AS eligible, * FROM k UNION ALL SELECT 'alerts', ablock, 1, * FROM k WHERE alerted UNION ALL SELECT 'lead_times', ablock, 1, * FROM k WHERE alerted
 UNION ALL SELECT 'trades', block, CAST(id % 4 <> 0 AS INTEGER), * FROM k WHERE id % 2 = 0),
x AS (SELECT 'event_family_holdout' AS regime, fold AS key, * FROM u UNION ALL SELECT 'category_holdout', category, * FROM u UNION ALL SELECT 'time_split_holdout', place, * FROM u)"""


def _rows(spark, sf_dir):  # noqa: ANN001, ANN202
    e, third = _events(spark, sf_dir), F.col("event_id") % 3
    alerted = F.col("value") > 50
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("f"), F.col("user_id") % 11)).alias("event_family_id"), F.col("event_type").alias("category"), F.col("ts").alias("trigger_ts"),
        F.when(alerted, F.col("event_id")).alias("alert_id"), F.when(alerted, F.col("ts") + F.expr("interval 1 hour")).alias("alert_ts"), F.when(F.col("event_id") % 5 != 0, "YES").alias("outcome"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_interval(secs=F.col("value") * 100)).alias("resolved_ts"), F.when(F.col("value") * 3 % 10 < 8, "ok").otherwise("coverage_insufficient").alias("coverage_status"),
        F.get_json_object("props", "$.k").alias("market_id"), F.col("value").alias("severity"), F.when(third == 0, 1).when(third == 1, 0).alias("label"), F.lit(None).cast("boolean").alias("useful"), F.lit(True).alias("delivered"))


def _trades(spark, sf_dir):  # noqa: ANN001, ANN202
    e = _events(spark, sf_dir).where("event_id % 2 = 0")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, "filled").otherwise("skipped").alias("status"), F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") - 20, 2)).alias("pnl"))


@query("a15_split_summaries", f"""WITH {_ROWS}, s AS (SELECT unit, regime, key, count(*) AS total_rows, CAST(sum(eligible) AS BIGINT) AS eligible_rows, count(*) FILTER (resolved) AS resolved_rows, count(DISTINCT coalesce(family, '')) AS distinct_families,
 count(DISTINCT category) AS distinct_categories, count(*) FILTER (covered) / count(*) AS c FROM x GROUP BY 1, 2, 3)
SELECT unit, regime, key, total_rows, eligible_rows, resolved_rows, distinct_families, distinct_categories, round(c, 6) AS coverage_ratio, CASE WHEN c < 0.8 THEN 'coverage_insufficient'
 WHEN eligible_rows < CASE unit WHEN 'candidates' THEN 30 WHEN 'trades' THEN 10 ELSE 20 END OR resolved_rows < 15 OR distinct_families < 4 OR distinct_categories < 3 THEN 'descriptive_only' ELSE 'scored' END AS status FROM s""")
def _(spark, sf_dir):
    return holdouts.summaries(_rows(spark, sf_dir), _trades(spark, sf_dir), C)


_SHARE = "coalesce(round({} / nullif({}, 0), 6), 0)"


@query("a17_candidate_families", f"""WITH {_ROWS}, m AS (SELECT regime, key, count(*) AS n_candidates, count(DISTINCT market_id) AS distinct_markets, count(DISTINCT family) AS distinct_families, round(count(label) / count(*), 6) AS label_coverage,
 {_SHARE.format('sum(label)', 'count(label)')} AS precision, {_SHARE.format('(count(label) - sum(label))', 'count(label)')} AS false_positive_rate, round(count(*) FILTER (resolved) / count(*), 6) AS reach_rate, round(median(value), 6) AS median_severity
 FROM x WHERE unit = 'candidates' GROUP BY 1, 2) SELECT regime, key, metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT regime, key, CAST(n_candidates AS DOUBLE) AS n_candidates, CAST(distinct_markets AS DOUBLE) AS distinct_markets,
 CAST(distinct_families AS DOUBLE) AS distinct_families, label_coverage, precision, false_positive_rate, reach_rate, median_severity FROM m) ON COLUMNS(* EXCLUDE (regime, key)) INTO NAME metric VALUE value)""")
def _(spark, sf_dir):
    return holdouts.metrics(_rows(spark, sf_dir), _trades(spark, sf_dir), C).where("family = 'candidates'").drop("family")


@query("a17_lead_time_families", f"""WITH {_ROWS}, t AS (SELECT regime, key, (value * 100 - 3600) AS lead FROM x WHERE unit = 'lead_times' AND label = 1 AND resolved AND value * 100 > 3600),
r AS (SELECT *, row_number() OVER (PARTITION BY regime, key ORDER BY lead) AS n, count(*) OVER (PARTITION BY regime, key) AS k FROM t)
SELECT regime, key, count(*) AS n, round(median(lead), 3) AS median, round(max(lead) FILTER (n = greatest(0, CAST(floor(k * 0.25) AS INTEGER) - 1) + 1), 3) AS p25 FROM r GROUP BY 1, 2""")
def _(spark, sf_dir):
    long = holdouts.metrics(_rows(spark, sf_dir), _trades(spark, sf_dir), C).where("family = 'lead_times'")
    wide = long.groupBy("regime", "key").pivot("metric", ["n", "median", "p25"]).agg(F.max("value"))
    return wide.select("regime", "key", F.col("n").cast("long").alias("n"), F.round("median", 3).alias("median"), F.round("p25", 3).alias("p25"))


#: JSON of each event: keys out of order, a list, wallets and a public identifier.
def _documents(spark, sf_dir):  # noqa: ANN001, ANN202
    hexa = F.concat(F.lit("0x"), F.lpad(F.hex("event_id"), 10, "0"))
    inner = F.to_json(F.struct(F.concat(F.lit("by "), hexa).alias("note"), hexa.alias("condition_id"), F.array(hexa, F.lit("x")).alias("list")))
    head = F.concat(F.lit('{ "z": null, "inner": '), inner, F.lit(', "captured_at": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", "amount": '), F.col("event_id").cast("string"), F.lit("}"))
    return _events(spark, sf_dir).select("event_id", head.alias("doc"))


_JSON = """d AS (SELECT event_id, '0x' || lpad(printf('%X', event_id), 10, '0') AS h, ts FROM events)"""
_TEXT = lambda note, item, at: f"""'{{"amount":' || event_id || ',"captured_at":"' || {at} || '","inner":{{"condition_id":"' || h || '","list":["' || {item} || '","x"],"note":"by ' || {note} || '"}},"z":null}}'"""
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"


@query("p30_nested_redaction", f"WITH {_JSON} SELECT event_id, {_TEXT(repr('[wallet_redacted]'), repr('[wallet_redacted]'), _AT)} AS doc FROM d")
def _(spark, sf_dir):
    return nested.redacted(_documents(spark, sf_dir), "doc")


@query("p49_nested_shift", f"WITH {_JSON} SELECT event_id, {_TEXT('h', 'h', chr(39).join(('strftime(date_trunc(', 'second', ', ts) + INTERVAL 90 MINUTE, ', '%Y-%m-%dT%H:%M:%S+00:00', ')')))} AS doc FROM d")
def _(spark, sf_dir):
    return nested.shifted(_documents(spark, sf_dir), "doc", F.lit(5400))


@query("p58_canonical_digest", f"WITH {_JSON} SELECT event_id, sha256({_TEXT('h', 'h', _AT)}) AS digest FROM d")
def _(spark, sf_dir):
    return nested.canonical(_documents(spark, sf_dir), "doc", "digest").select("event_id", "digest")


@query("sk9_keyed_merge", "SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, max(o_orderdate) AS last_day FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """Orders by customer, merged in two batches by date, the second of which comes twice."""
    o = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    path, at = folder(spark), F.lit("1995-06-17").cast("date")
    how = {"n": store.added, "first_order": store.first, "last_day": store.largest}
    for batch, part in ((0, o.where(F.col("day") < at)), (1, o.where(F.col("day") >= at)), (1, o.where(F.col("day") >= at))):
        rows = part.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("day", "o_orderkey")).alias("first_order"), F.max("day").alias("last_day"))
        store.merge(rows, path, ("o_custkey",), batch, how, buckets=8)
    return store.rows(spark, path, StructType(list(rows.schema))).withColumn("last_day", F.col("last_day").cast("timestamp"))


@query("st1_log_points", """SELECT 'trade' AS kind, json_extract_string(props, '$.k') AS market_id, CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) + INTERVAL 1 HOUR ELSE date_trunc('second', ts) END AS ts, 'u' || user_id AS wallet, 'BUY' AS side, 'NO' AS outcome_side,
 CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(value AS DOUBLE) END AS notional, CAST(NULL AS DOUBLE) AS price FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT 'quote', json_extract_string(props, '$.k'), date_trunc('second', ts), NULL, NULL, NULL, NULL, CAST(value AS DOUBLE) FROM events WHERE event_id % 2 = 1""")
def _(spark, sf_dir):
    e, stamp = _events(spark, sf_dir), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    market, late = F.get_json_object("props", "$.k"), F.col("event_id") % 4 == 0
    trade = F.struct(market.alias("market_id"), F.concat(F.lit("U"), "user_id").alias("proxy_wallet"), F.lit("buy").alias("side"), F.lit("no").alias("outcome_side"),
                     F.when(F.col("event_id") % 3 != 0, F.col("value").cast("string")).alias("usdc_notional"), F.when(late, "").otherwise(stamp("ts")).alias("trade_time"), stamp(F.col("ts") + F.expr("interval 1 hour")).alias("captured_at"))
    quote = F.struct(market.alias("market_id"), stamp("ts").alias("captured_at"), F.col("value").alias("mid_price"))
    even = F.col("event_id") % 2 == 0
    payload = F.when(even, F.to_json(F.struct(F.array(trade).alias("trades")))).otherwise(F.to_json(F.struct(F.array(quote).alias("market_snapshots"))))
    envelopes = e.select(F.col("event_id").cast("string").alias("envelope_id"), F.when(even, "recent_trades_page").otherwise("books_batch").alias("entity_type"), stamp("ts").alias("captured_at"), F.lit("k").alias("ordering_key"), payload.alias("payload"))
    return log.points(envelopes).drop("order_key", "pos")
