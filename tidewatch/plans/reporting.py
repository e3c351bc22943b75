"""Queries of reports, gates, listings and the smaller helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reports as R
from ..sources import driver as D
from .catalog import query


def _events(spark, sf_dir):  # noqa: ANN001, ANN202
    return D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("p39_heuristics", """WITH x AS (SELECT event_id, value / 200 AS v, (event_id % 10) / 10.0 AS fs, (event_id % 7) / 7.0 AS im FROM events)
 SELECT event_id, round(least(1.0, v / 0.05), 6) AS momentum, round(0.35 * fs + 0.25 * im + 0.1 * least(1.0, v / 0.05), 6) AS micro, CASE WHEN event_id % 5 >= 3 THEN 1.0 ELSE 0.0 END AS fresh_wallet FROM x""")
def _(spark, sf_dir):
    x = _events(spark, sf_dir).select("event_id", (F.col("value") / 200).alias("velocity"), ((F.col("event_id") % 10) / 10.0).alias("fresh_share"), ((F.col("event_id") % 7) / 7.0).alias("imbalance"), F.lit(None).cast("double").alias("concentration"), F.lit(0.0).alias("volume_acceleration"), (F.col("event_id") % 5).alias("fresh_count"))
    h = R.heuristics()
    return x.select("event_id", F.round(h["momentum"], 6).alias("momentum"), F.round(h["microstructure"], 6).alias("micro"), h["fresh_wallet"].alias("fresh_wallet"))


_REPORTS = "r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, event_type AS name, max(value) AS value FROM events GROUP BY 1, 2)"


def _reports(spark, sf_dir):  # noqa: ANN001, ANN202
    split = F.when(F.col("event_id") % 3 == 0, "test").when(F.col("event_id") % 3 == 1, "validation").otherwise("train")
    return _events(spark, sf_dir).groupBy(split.alias("split"), F.col("event_type").alias("name")).agg(F.max("value").alias("value"))


@query("m6_baseline_comparison", f"""WITH {_REPORTS}, m AS (SELECT value AS mv FROM r WHERE split = 'test' AND name = 'purchase') SELECT name AS baseline, split, round(mv - value, 6) + 0.0 AS margin, CASE WHEN round(mv - value, 6) > 0 THEN 'above' WHEN round(mv - value, 6) = 0 THEN 'equal' ELSE 'below' END AS status FROM r, m WHERE split = 'test' AND name IN ('view', 'click', 'error')""")
def _(spark, sf_dir):
    return R.compared(_reports(spark, sf_dir), "purchase", ["view", "click", "error"])


@query("m8_gate", f"WITH {_REPORTS} SELECT name, count(*) FILTER (CASE split WHEN 'test' THEN value < 300 WHEN 'train' THEN value < 100 ELSE false END) AS short, count(*) FILTER (CASE split WHEN 'test' THEN value < 300 WHEN 'train' THEN value < 100 ELSE false END) = 0 AS passed FROM r GROUP BY 1")
def _(spark, sf_dir):
    return R.gate(_reports(spark, sf_dir).withColumnRenamed("split", "metric"), {"test": 300, "train": 100})


@query("p64_findings", "WITH c AS (SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS errors, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS large FROM events GROUP BY 1) SELECT user_id, concat_ws(',', CASE WHEN errors >= 0.3 THEN 'errors:act' WHEN errors >= 0.2 THEN 'errors:watch' END, CASE WHEN large >= 0.5 THEN 'large:act' WHEN large >= 0.1 THEN 'large:watch' END) AS findings FROM c")
def _(spark, sf_dir):
    c = _events(spark, sf_dir).groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("errors"), F.avg((F.col("value") > 50).cast("double")).alias("large"))
    return R.findings(c, {"errors": (0.2, 0.3), "large": (0.1, 0.5)}).select("user_id", "findings")


@query("t12_filtered_listing", "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 25")
def _(spark, sf_dir):
    return R.listing(_events(spark, sf_dir), 25, [F.desc("ts"), F.col("event_id")], event_type="purchase", props=None).select("event_id", "event_type", "value")


@query("t13_active_model", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey LIMIT 1")
def _(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return R.listing(o, 1, [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "o_orderstatus")


@query("u4_ablation", """WITH f(place, family) AS (VALUES (0, 'view'), (1, 'none'), (2, 'error')), a AS (SELECT event_type AS family, arg_min(event_id, event_id) AS artifact, arg_min(user_id % 2, event_id) AS h FROM events GROUP BY 1), k AS (SELECT count(DISTINCT h) AS kinds FROM a WHERE family IN ('view', 'none', 'error'))
 SELECT CAST(place AS BIGINT) AS place, family, coalesce(CAST(artifact AS VARCHAR), 'missing') AS artifact, CASE WHEN artifact IS NULL THEN 'placeholder' WHEN kinds > 1 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM f LEFT JOIN a USING (family), k""")
def _(spark, sf_dir):
    a = _events(spark, sf_dir).select(F.col("event_type").alias("family"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("artifact"), (F.col("user_id") % 2).alias("dataset_hash"))
    return R.ablation(["view", "none", "error"], a)


@query("sk12_resolution", f"""WITH {D.MARKETS}, x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN 'c' || p_partkey END AS condition_id, p_partkey || '-YES' AS asset_id, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS fp FROM part)
 SELECT id, coalesce(m.market_id, CAST(id AS VARCHAR)) AS market_id, CASE WHEN fp >= 0.99 THEN 'YES' WHEN fp <= 0.01 THEN 'NO' ELSE 'N/A' END AS outcome FROM x LEFT JOIN markets m ON m.condition_id = x.condition_id""")
def _(spark, sf_dir):
    p, k, m = D.table(spark, sf_dir, "part"), F.col("p_partkey"), D.markets(spark, sf_dir)
    x = p.select(k.alias("id"), F.when(k % 4 != 0, F.concat(F.lit("c"), k)).alias("condition_id"), F.concat(k, F.lit("-YES")).alias("asset_id"), F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.0).otherwise(0.5).alias("final_price"))
    return R.resolutions(x, m.where("condition_id is not null").select("condition_id", "market_id"), m.select(F.concat("market_id", F.lit("-YES")).alias("asset_id"), "market_id"))


@query("p52_observability", "SELECT event_id, CASE WHEN value > 90 THEN 'public' WHEN event_type = 'signup' THEN 'reviewed' WHEN event_type = 'view' THEN 'created' ELSE 'candidate' END AS bucket FROM events")
def _(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select("event_id", (F.col("value") > 90).alias("public"), (F.col("event_type") == "signup").alias("reviewed"), F.lit(None).cast("boolean").alias("visible"), (F.col("event_type") == "view").alias("created"), F.lit(False).alias("scored"))
    return R.observed(rows).select("event_id", "bucket")


@query("j24_suppressing_parent", "WITH a AS (SELECT event_id AS id, user_id AS rank, CASE WHEN event_id % 3 = 0 THEN event_id - 3 END AS parent_id FROM events) SELECT a.id, a.parent_id, p.rank AS parent_rank FROM a LEFT JOIN a p ON p.id = a.parent_id WHERE a.parent_id >= 0")
def _(spark, sf_dir):
    a = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("rank"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("suppressed_by:"), F.col("event_id") - 3)).otherwise("sent").alias("state"))
    return R.parents(a)


@query("p48_normalized_identity", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.8f', l_quantity) || '|' || '' || '|' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS identity FROM lineitem")
def _(spark, sf_dir):
    i = R.normalized_identity(F.col("l_quantity").cast("string"), F.lit("junk"), F.col("l_shipdate").cast("timestamp"))
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", i.alias("identity"))


@query("m1_training_split", "WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS c FROM events GROUP BY 1), s AS (SELECT d, coalesce(sum(c) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER () AS share FROM c) SELECT event_id, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'validation' ELSE 'test' END AS partition FROM events JOIN s ON CAST(ts AS DATE) = d")
def _(spark, sf_dir):
    return R.split_frames(_events(spark, sf_dir), F.to_date("ts")).select("event_id", "partition")


@query("w6_latest_by_time", "SELECT user_id, arg_max(event_id, (date_trunc('hour', ts), event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct(F.date_trunc("hour", "ts"), "event_id")).alias("event_id"))


@query("w5_window_velocity", f"WITH {D.STREAM} SELECT market_id, date_trunc('day', ts) AS day, CASE WHEN max(ts) > min(ts) THEN (arg_max(price, (ts, seq)) - arg_min(price, (ts, seq))) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6) ELSE 0 END AS velocity FROM stream GROUP BY 1, 2")
def _(spark, sf_dir):
    at = F.struct("ts", "seq")
    minutes = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60e6
    return D.stream(spark, sf_dir).groupBy("market_id", F.date_trunc("day", "ts").alias("day")).agg(S.safe_ratio(F.max_by("price", at) - F.min_by("price", at), minutes).alias("velocity"))


@query("a10_candidate_metrics", f"WITH {D.SCORED} SELECT count(*) AS n, round(count(label) / count(*), 6) AS coverage, round(avg(label), 6) AS precision, round(1 - avg(label), 6) AS false_positive_rate, round(median(score), 6) AS median_score FROM scored")
def _(spark, sf_dir):
    return D.scored(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.count("label") / F.count("*"), 6).alias("coverage"), F.round(F.avg("label"), 6).alias("precision"), F.round(1 - F.avg("label"), 6).alias("false_positive_rate"), F.round(F.median("score"), 6).alias("median_score"))


@query("a18_coverage", "SELECT count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled FROM documents")
def _(spark, sf_dir):
    known = D.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    return D.table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").agg(F.count("*").alias("n"), F.count("known").alias("labelled"))


@query("a22_status_row", "SELECT (SELECT count(*) FROM events WHERE event_type = 'signup') AS alerts, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS candidates, (SELECT max(ts) FROM events) AS last_ts")
def _(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.count_if(F.col("event_type") == "signup").alias("alerts"), F.count_if(F.col("event_type") == "purchase").alias("candidates"), F.max("ts").alias("last_ts"))


@query("a26_group_counts", "SELECT event_type, value > 50 AS large, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type", (F.col("value") > 50).alias("large")).agg(F.count("*").alias("n"))


@query("a28_risk_ratios", "SELECT event_type, round(sum(CASE WHEN value > 50 THEN value END) / sum(value), 4) AS weighted, round(count(*) FILTER (value > 50) / count(*), 6) AS share FROM events GROUP BY 1")
def _(spark, sf_dir):
    large = F.col("value") > 50
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(F.when(large, F.col("value"))) / F.sum("value"), 4).alias("weighted"), F.round(F.count_if(large) / F.count("*"), 6).alias("share"))


@query("j8_metadata_lookup", f"WITH {D.STREAM}, {D.MARKETS} SELECT seq, event_id, category FROM stream LEFT JOIN markets USING (market_id)")
def _(spark, sf_dir):
    return D.stream(spark, sf_dir).join(D.markets(spark, sf_dir).select("market_id", "event_id", "category"), "market_id", "left").select("seq", "event_id", "category")


@query("j10_not_seen", f"WITH {D.TRADES}, {D.MARKETS} SELECT market_id FROM markets WHERE market_id NOT IN (SELECT market_id FROM trades WHERE size > 45)")
def _(spark, sf_dir):
    return D.markets(spark, sf_dir).join(D.trades(spark, sf_dir).where("size > 45"), "market_id", "left_anti").select("market_id")


@query("j23_model_merge", f"WITH {D.SCORED} SELECT doc_id, score AS a, 1 - score AS b, score > 1 - score AS a_above FROM scored")
def _(spark, sf_dir):
    s = D.scored(spark, sf_dir)
    return s.select("doc_id", F.col("score").alias("a")).join(s.select("doc_id", (1 - F.col("score")).alias("b")), "doc_id").withColumn("a_above", F.col("a") > F.col("b"))


@query("j27_latest_three_keys", "SELECT user_id, event_type, arg_max(event_id, (value, ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("value", "ts", "event_id")).alias("event_id"))


@query("sc3_windowed_scan", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, sf_dir):
    e = _events(spark, sf_dir).where("ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
    return e.select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).alias("seq"))


@query("sc12_price_payloads", "SELECT p_partkey, 't' || p_partkey AS token, p_retailprice AS price FROM part")
def _(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    token = F.concat(F.lit("t"), "p_partkey")
    as_map = F.to_json(F.create_map(token, F.col("p_retailprice").cast("string")))
    as_list = F.to_json(F.array(F.struct(token.alias("token"), F.col("p_retailprice").cast("string").alias("price"))))
    raw = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, as_map).otherwise(as_list).alias("payload"))
    listed = F.from_json("payload", "array<struct<token:string,price:string>>")
    mapped = F.transform(F.map_entries(F.from_json("payload", "map<string,string>")), lambda e: F.struct(e["key"].alias("token"), e["value"].alias("price")))
    each = raw.select("p_partkey", F.explode(F.when(F.col("payload").startswith("["), listed).otherwise(mapped)).alias("e"))
    return each.select("p_partkey", "e.token", F.col("e.price").try_cast("double").alias("price"))


@query("p27_suppression_key", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'event:' || p_brand ELSE 'market:' || p_partkey END AS key FROM part")
def _(spark, sf_dir):
    none = F.lit(None).cast("string")
    event = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")
    return D.table(spark, sf_dir, "part").select("p_partkey", S.suppression_key(none, event, none, F.col("p_partkey").cast("string"), none).alias("key"))


@query("p29_movement", "SELECT event_id, abs(value - 50) + abs(value / 10) AS movement FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.movement(F.col("value") - 50, F.col("value") / 10).alias("movement"))


@query("p56_alert_payload", """SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS payload FROM events""")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("payload"))


@query("p59_analyst_actions", "SELECT event_id, CASE event_type WHEN 'view' THEN 'acknowledged' WHEN 'click' THEN 'dismissed' WHEN 'error' THEN 'escalated' END AS status FROM events WHERE event_type IN ('view', 'click', 'error')")
def _(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for p in (("view", "acknowledged"), ("click", "dismissed"), ("error", "escalated")) for x in p))
    return _events(spark, sf_dir).select("event_id", F.try_element_at(names, F.col("event_type")).alias("status")).where("status is not null")


@query("sk9_composite_upsert", f"WITH {D.TRADES} SELECT wallet, market_id, max(ts) AS ts, arg_max(notional, (ts, trade_id)) AS notional FROM trades WHERE wallet IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    t = D.trades(spark, sf_dir).where("wallet is not null")
    return t.groupBy("wallet", "market_id").agg(F.max("ts").alias("ts"), F.max_by("notional", F.struct("ts", "trade_id")).alias("notional"))


@query("t6_qa_sample", f"WITH {D.TRADES} SELECT market_id, count(*) AS n, count(DISTINCT wallet) AS wallets FROM trades GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def _(spark, sf_dir):
    by = D.trades(spark, sf_dir).groupBy("market_id").agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"))
    return by.orderBy(F.desc("n"), F.desc("wallets"), "market_id").limit(20)


