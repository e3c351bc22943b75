"""Queries of the smaller normal forms, decisions and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detector as X
from ..operators import evaluation as E
from ..operators import ml as M
from ..sources import driver as D
from .catalog import query
from .detection import DAYS


def _events(spark, sf_dir):  # noqa: ANN001, ANN202
    return D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _parts(spark, sf_dir):  # noqa: ANN001, ANN202
    return D.table(spark, sf_dir, "part")


_MS = "CAST(epoch_ms(ts) AS VARCHAR)"


@query("p3_trade_timestamps", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('milliseconds', ts) END AS parsed FROM events")
def _(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.floor(F.unix_millis("ts") / 1000).cast("string")).when(F.col("event_id") % 3 == 1, F.unix_millis("ts").cast("string")).otherwise("bad")
    return _events(spark, sf_dir).select("event_id", S.trade_timestamp(text).alias("parsed"))


@query("p4_push_timestamps", "SELECT event_id, date_trunc('milliseconds', ts) AS parsed FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.push_timestamp(F.unix_millis("ts").cast("string")).alias("parsed"))


@query("p5_job_timestamps", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def _(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _events(spark, sf_dir).select("event_id", S.job_timestamp(text).alias("parsed"))


@query("p9_json_strings", "SELECT p_partkey, p_brand || ',' || p_type AS tags FROM part")
def _(spark, sf_dir):
    text = F.to_json(F.array(F.col("p_brand"), F.lit(""), F.col("p_type")))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(S.json_strings(text), ",").alias("tags"))


@query("p10_json_doubles", "SELECT p_partkey, p_retailprice AS a, CAST('NaN' AS DOUBLE) AS b FROM part")
def _(spark, sf_dir):
    xs = S.json_doubles(F.to_json(F.array(F.col("p_retailprice").cast("string"), F.lit("x"))))
    return _parts(spark, sf_dir).select("p_partkey", F.get(xs, F.lit(0)).alias("a"), F.get(xs, F.lit(1)).alias("b"))


@query("p11_outcome_tokens", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey ELSE 'b' || p_partkey END AS yes_token FROM part")
def _(spark, sf_dir):
    outcomes = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(F.lit("No"), F.lit("Yes")))
    tokens = F.array(F.concat(F.lit("a"), "p_partkey"), F.concat(F.lit("b"), "p_partkey"))
    return _parts(spark, sf_dir).select("p_partkey", S.yes_probability(outcomes, tokens).alias("yes_token"))


@query("p14_side_probability", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value / 200 ELSE 1 - value / 200 END AS p FROM events")
def _(spark, sf_dir):
    yes = F.col("value") / 200
    return _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, yes).otherwise(1 - yes).alias("p"))


@query("p17_trade_normal_form", f"WITH {D.TRADES} SELECT trade_id, lower(wallet) AS wallet, lower(tx_hash) AS tx_hash, upper(side) AS side, coalesce(CASE WHEN priority <> 2 THEN notional END, price * size) AS notional FROM trades")
def _(spark, sf_dir):
    amount = F.coalesce(F.when(F.col("priority") != 2, F.col("notional")), F.col("price") * F.col("size"))
    return D.trades(spark, sf_dir).select("trade_id", F.lower("wallet").alias("wallet"), F.lower("tx_hash").alias("tx_hash"), F.upper("side").alias("side"), amount.alias("notional"))


@query("p22_include_reasons", "SELECT p_partkey, array_to_string(list_sort(list_intersect([lower(p_type), lower(p_brand)], ['economy', 'standard', 'brand#3', 'brand#7'])), ',') AS reasons FROM part")
def _(spark, sf_dir):
    tags = F.array(F.lower("p_type"), F.lower("p_brand"))
    wanted = F.array(*map(F.lit, ("economy", "standard", "brand#3", "brand#7")))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(F.array_intersect(tags, wanted)), ",").alias("reasons"))


@query("p24_domain_filter", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'ring') THEN 'ring' END AS excluded FROM part")
def _(spark, sf_dir):
    first = F.get(F.filter(F.array(F.lit("red"), F.lit("ring")), lambda k: F.contains(F.lower("p_name"), k)), F.lit(0))
    return _parts(spark, sf_dir).select("p_partkey", first.alias("excluded"))


@query("p33_conservative_quotes", "SELECT event_id, greatest(value / 200, CASE WHEN event_id % 2 = 0 THEN value / 190 END) AS entry, least(value / 200, CASE WHEN event_id % 2 = 0 THEN value / 190 END) AS exit FROM events")
def _(spark, sf_dir):
    a, b = F.col("value") / 200, F.when(F.col("event_id") % 2 == 0, F.col("value") / 190)
    return _events(spark, sf_dir).select("event_id", F.greatest(a, b).alias("entry"), F.least(a, b).alias("exit"))


@query("p38_model_inputs", "SELECT event_id, CASE WHEN value > 1 THEN least(1.0, value / 100) ELSE value END AS severity, abs(value - 50) AS velocity, 0.0 AS missing FROM events")
def _(spark, sf_dir):
    severity = F.when(F.col("value") > 1, F.least(F.lit(1.0), F.col("value") / 100)).otherwise(F.col("value"))
    return _events(spark, sf_dir).select("event_id", severity.alias("severity"), F.abs(F.col("value") - 50).alias("velocity"), F.coalesce(F.lit(None).cast("double"), F.lit(0.0)).alias("missing"))


@query("p41_shadow_score", f"WITH {D.SCORED} SELECT doc_id, round(1 / (1 + exp(-(0.8 * score))), 6) AS p, CASE WHEN 1 / (1 + exp(-(0.8 * score))) >= 0.6 THEN 'high' ELSE 'low' END AS name FROM scored")
def _(spark, sf_dir):
    p = S.clamped(M.linear_score([{"feature": "score", "weight": 0.8, "mean": 0.0, "std": 1.0}], 0.0, False))
    return D.scored(spark, sf_dir).select("doc_id", F.round(p, 6).alias("p"), F.when(p >= 0.6, "high").otherwise("low").alias("name"))


@query("p49_shifted_times", "SELECT event_id, ts + (TIMESTAMP '2025-01-01' - (SELECT max(ts) FROM events)) AS ts FROM events")
def _(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = e.agg(F.max("ts").alias("last"))
    shift = F.unix_micros(F.lit("2025-01-01").cast("timestamp")) - F.unix_micros("last")
    return e.crossJoin(F.broadcast(last)).select("event_id", F.timestamp_micros(F.unix_micros("ts") + shift).alias("ts"))  # one row


@query("p50_push_events", "SELECT event_id, CASE event_type WHEN 'view' THEN 'book' WHEN 'click' THEN 'price_change' WHEN 'purchase' THEN 'trade' ELSE 'ignored' END AS kind, CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS size FROM events")
def _(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "view", "book").when(t == "click", "price_change").when(t == "purchase", "trade").otherwise("ignored")
    return _events(spark, sf_dir).select("event_id", kind.alias("kind"), F.when(t == "purchase", F.from_json("props", "k double")["k"]).alias("size"))


@query("p54_url_slugs", "SELECT p_partkey, 'https://host/' || replace(p_name, ' ', '+') AS url FROM part")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.concat(F.lit("https://host/"), F.url_encode("p_name")).alias("url"))


@query("p58_config_hash", """SELECT p_partkey, sha256('{"a":"' || p_brand || '","b":' || p_size || '}') AS hash FROM part""")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", F.sha2(F.to_json(F.struct(F.col("p_brand").alias("a"), F.col("p_size").alias("b"))), 256).alias("hash"))


@query("p60_resend", "SELECT event_id, coalesce(value > lag(value) OVER w, false) OR event_type IS DISTINCT FROM lag(event_type) OVER w AS resend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    resend = F.coalesce(F.col("value") > F.lag("value").over(w), F.lit(False)) | ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))
    return _events(spark, sf_dir).select("event_id", resend.alias("resend"))


@query("p65_family_alias", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'basic' WHEN p_type = 'PROMO' THEN 'promo' ELSE lower(p_type) END AS family FROM part")
def _(spark, sf_dir):
    t = F.col("p_type")
    return _parts(spark, sf_dir).select("p_partkey", F.when(t.isin("ECONOMY", "STANDARD"), "basic").when(t == "PROMO", "promo").otherwise(F.lower(t)).alias("family"))


@query("a11_alert_metrics", """WITH a AS (SELECT CASE WHEN value > 80 THEN 'ACTIONABLE' WHEN value > 50 THEN 'WATCH' ELSE 'INFO' END AS severity, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label,
 CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS useful, value > 40 AS delivered FROM events WHERE event_type = 'signup')
 SELECT severity, count(*) AS n_alerts, count(label) AS labelled, count(useful) AS with_feedback, count(*) FILTER (delivered) AS delivered, round(coalesce(sum(label) / nullif(count(label), 0), 0), 6) AS label_precision,
 round(coalesce(count(*) FILTER (useful) / nullif(count(useful), 0), 0), 6) AS usefulness_precision, round(count(label) / count(*), 6) AS label_coverage FROM a GROUP BY 1""")
def _(spark, sf_dir):
    name = F.when(F.col("value") > 80, "ACTIONABLE").when(F.col("value") > 50, "WATCH").otherwise("INFO")
    label, useful = (F.when(F.col("user_id") % 4 == 0, 1).when(F.col("user_id") % 4 == 1, 0), F.when(F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 0))
    rows = _events(spark, sf_dir).where("event_type = 'signup'").select(name.alias("severity"), label.alias("label"), useful.alias("useful"), (F.col("value") > 40).alias("delivered"))
    return E.alert_metrics(rows, "severity")


@query("a24_provider_summary", "SELECT 'p' || (event_id % 4) AS provider, event_type, count(*) AS n, max(value) AS largest FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.concat(F.lit("p"), F.col("event_id") % 4).alias("provider"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest"))


@query("a25_mode_summary", "SELECT event_id % 2 = 0 AS live, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy((F.col("event_id") % 2 == 0).alias("live"), "event_type").agg(F.count("*").alias("n"))


@query("a55_review_readiness", "WITH l AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT count(*) AS n, count(DISTINCT v) AS scores, count(*) >= 10 AS enough, count(*) FILTER (v > 50) AS high FROM l")
def _(spark, sf_dir):
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    return last.agg(F.count("*").alias("n"), F.countDistinct("v").alias("scores"), (F.count("*") >= 10).alias("enough"), F.count_if(F.col("v") > 50).alias("high"))


@query("a61_prune_candidates", "SELECT p_brand, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS bytes FROM part WHERE p_size * 12 > 365 GROUP BY 1")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).where(S.storage_tier(F.col("p_size") * 12) == "archive_only").groupBy("p_brand").agg(F.count("*").alias("files"), F.sum("p_size").alias("bytes"))


@query("w4_window_sums", f"WITH {D.STREAM} SELECT seq, round(sum(notional) OVER (PARTITION BY market_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS current, count(*) OVER (PARTITION BY market_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM stream")
def _(spark, sf_dir):
    w = Window.partitionBy("market_id").orderBy(F.unix_micros("ts")).rangeBetween(-86400 * 1000000, Window.currentRow)
    return D.stream(spark, sf_dir).select("seq", F.round(F.sum("notional").over(w), 4).alias("current"), F.count("*").over(w).alias("n"))


@query("t8_compaction_plan", "SELECT 'p' || p_partkey AS path, p_size AS files FROM part WHERE p_size >= 10 AND p_retailprice < 1500")
def _(spark, sf_dir):
    return _parts(spark, sf_dir).where("p_size >= 10 and p_retailprice < 1500").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_size").alias("files"))


@query("t9_restore_plan", "SELECT event_id, CASE WHEN value > 50 THEN 'restore' ELSE 'none' END AS action FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-10' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-11'")
def _(spark, sf_dir):
    path = F.date_format("ts", "'root/year='yyyy'/month='MM'/day='dd'/hour='HH'/f'")
    e = _events(spark, sf_dir).withColumn("hour", S.partition_hour(path)).where("hour >= timestamp '2024-01-10' and hour < timestamp '2024-01-11'")
    return e.select("event_id", F.when(F.col("value") > 50, "restore").otherwise("none").alias("action"))


@query("j16_frame_merge", f"WITH {D.SCORED} SELECT doc_id, score, quality FROM scored LEFT JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    return D.scored(spark, sf_dir).select("doc_id", "score").join(D.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("m7_calibration_scopes", f"""WITH {D.SCORED}, e AS (SELECT 'global' AS scope, 'all' AS key, doc_id, score, label FROM scored UNION ALL SELECT 'category', category, doc_id, score, label FROM scored),
 r AS (SELECT *, row_number() OVER w AS r, sum(label) OVER w / row_number() OVER w AS p FROM e WINDOW w AS (PARTITION BY scope, key ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
 SELECT scope, key, round(coalesce(arg_min(score, r) FILTER (p >= 0.8), quantile_cont(score, 0.2)), 6) AS threshold, count(*) AS n FROM r GROUP BY 1, 2""")
def _(spark, sf_dir):
    scopes = F.array(F.struct(F.lit("global").alias("scope"), F.lit("all").alias("key")), F.struct(F.lit("category").alias("scope"), F.col("category").alias("key")))
    rows = D.scored(spark, sf_dir).withColumn("s", F.explode(scopes)).select("*", "s.*")
    return M.precision_threshold(rows, 0.8, "scope", "key")


@query("m11_assessment", f"""WITH {D.SCORED}, t AS (SELECT category, split, count(*) AS k FROM scored GROUP BY 1, 2), s AS (SELECT category, max(k) / sum(k) AS split_share FROM t GROUP BY 1),
 g AS (SELECT category, count(*) AS n_rows, count(*) FILTER (label = 0) AS n_insufficient, count(*) FILTER (score > 0.8) AS fills, median(score) - 0.6 AS median_pnl, avg(label) AS usefulness FROM scored GROUP BY 1)
 SELECT category, CASE WHEN n_insufficient > 0 AND fills = 0 THEN 'coverage_limited' WHEN median_pnl > 0 AND usefulness >= 0.85 AND split_share < 0.75 THEN 'promising'
 WHEN median_pnl > 0 OR usefulness >= 0.85 THEN 'mixed' ELSE 'not_yet_defendable' END AS assessment FROM g JOIN s USING (category)""")
def _(spark, sf_dir):
    rows = D.scored(spark, sf_dir)
    by_split = rows.groupBy("category", "split").agg(F.count("*").alias("k")).groupBy("category").agg((F.max("k") / F.sum("k")).alias("category_share"))
    metrics = rows.groupBy("category").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("label") == 0).alias("n_insufficient"), F.count_if(F.col("score") > 0.8).alias("fills"),
        (F.median("score") - 0.6).alias("median_pnl"), F.avg("label").alias("usefulness"))
    metrics = metrics.join(by_split, "category").withColumn("family_share", F.col("category_share"))
    return metrics.select("category", E.assessment(useful=0.85).alias("assessment"))


@query("st14_replay")
def _(spark, sf_dir):
    """The batch form over a replayed window, with fresh state."""
    found = X.cooled(X.candidates(D.stream(spark, sf_dir).where("ts < timestamp '2024-01-10'"), DAYS), DAYS)
    return found.where("emitted").select("seq", "market_id", "severity")


@query("sk3_ordering_keys", "SELECT event_type AS source, max(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '::' || event_id) AS last_key FROM events GROUP BY 1")
def _(spark, sf_dir):
    key = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("::"), F.col("event_id"))
    return _events(spark, sf_dir).groupBy(F.col("event_type").alias("source")).agg(F.max(key).alias("last_key"))


@query("sk20_exclusive_flag", "SELECT user_id, user_id = (SELECT arg_max(user_id, (value, user_id)) FROM events) AS active FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = _events(spark, sf_dir)
    best = e.agg(F.max_by("user_id", F.struct("value", "user_id")).alias("best"))
    return e.select("user_id").distinct().crossJoin(F.broadcast(best)).select("user_id", (F.col("user_id") == F.col("best")).alias("active"))  # one row


@query("sk22_backfill_plan", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(ceil(o_totalprice / 86400) AS BIGINT) END AS days, CASE WHEN o_orderstatus = 'O' THEN 'planned' ELSE 'skipped' END AS status FROM orders")
def _(spark, sf_dir):
    is_open = F.col("o_orderstatus") == "O"
    return D.table(spark, sf_dir, "orders").select("o_orderkey", F.when(is_open, F.ceil(F.col("o_totalprice") / 86400)).alias("days"), F.when(is_open, "planned").otherwise("skipped").alias("status"))
