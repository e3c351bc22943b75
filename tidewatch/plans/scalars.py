"""Queries of scalar functions and text predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import driver as D
from .catalog import query


def _events(spark, sf_dir):  # noqa: ANN001, ANN202
    return D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("p1_is_present", "SELECT count(*) FILTER (trim(CASE WHEN event_id % 3 = 0 THEN ' ' WHEN event_id % 3 = 1 THEN event_type END) <> '') AS n FROM events")
def _(spark, sf_dir):
    x = F.when(F.col("event_id") % 3 == 0, " ").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return _events(spark, sf_dir).agg(F.count_if(S.is_present(x)).alias("n"))


_TEXT = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN CAST(epoch_ms(ts) AS VARCHAR) WHEN 2 THEN CAST(epoch_ms(ts) // 1000 AS VARCHAR) ELSE 'junk' END"
_PARSED = "CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('milliseconds', ts) WHEN 2 THEN date_trunc('second', ts) END"


@query("p2_detector_timestamps", f"SELECT event_id, {_PARSED} AS parsed FROM events")
def _(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.unix_millis("ts").cast("string")).when(F.col("event_id") % 4 == 2, F.floor(F.unix_millis("ts") / 1000).cast("string")).otherwise("junk")
    return _events(spark, sf_dir).select("event_id", S.detector_timestamp(text).alias("parsed"))


@query("p6_hour_floor", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.date_trunc("hour", "ts").alias("hour"))


@query("p7_safe_numbers", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'x' END AS DOUBLE) AS x FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("x").try_cast("double").alias("x"))


@query("p8_json_default", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@query("p12_yes_probability", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 100.0 WHEN p_partkey % 3 = 1 THEN 1 - p_size / 100.0 ELSE p_size / 100.0 END AS p FROM part")
def _(spark, sf_dir):
    p = F.col("p_size") / 100.0
    outcomes = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Yes"), F.lit("No"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("No"), F.lit("YES"))).otherwise(F.array(F.lit("up"), F.lit("down")))
    return D.table(spark, sf_dir, "part").select("p_partkey", S.yes_probability(outcomes, F.array(p, 1 - p)).alias("p"))


@query("p13_probability_band", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 5 <> 0 THEN value / 100 END BETWEEN 0.10 AND 0.95, true)")
def _(spark, sf_dir):
    return _events(spark, sf_dir).where(S.in_probability_band(F.when(F.col("event_id") % 5 != 0, F.col("value") / 100))).select("event_id")


@query("p15_volume_tier", "SELECT p_partkey, CAST(CASE WHEN p_size * 20 > 500 THEN 1 WHEN p_size * 20 > 50 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM part")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", S.volume_tier(F.col("p_size") * 20).alias("tier"))


@query("p16_category_key", "SELECT p_partkey, lower(trim(coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE ' ' END), ''), CASE WHEN p_partkey % 3 = 0 THEN p_brand END, 'unknown'))) AS category FROM part")
def _(spark, sf_dir):
    tags = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(" "), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    return D.table(spark, sf_dir, "part").select("p_partkey", S.category_key(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(" "), tags).alias("category"))


_WORDS = ("the", "que", "schen", "ing")


@query("p20_keywords", f"SELECT doc_id, array_to_string(list_filter({sorted(_WORDS)!r}, lambda k: contains(lower(text), k)), ',') AS hits FROM documents")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.keyword_hits(F.col("text"), _WORDS), ",").alias("hits"))


@query("p21_hard_exclude", "SELECT p_partkey FROM part WHERE NOT (p_brand IN ('Brand#3', 'Brand#7') OR contains(lower(p_name), 'red'))")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "part").where(~(F.col("p_brand").isin("Brand#3", "Brand#7") | F.contains(F.lower("p_name"), F.lit("red")))).select("p_partkey")


@query("p23_review_reasons", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 30 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'liquid' END, CASE WHEN contains(lower(p_name), 'blue') THEN 'keyword' END) AS reasons FROM part")
def _(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("p_size") > 30, "large"), F.when(F.col("p_retailprice") > 1000, "liquid"), F.when(F.contains(F.lower("p_name"), F.lit("blue")), "keyword")))
    return D.table(spark, sf_dir, "part").select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


@query("p25_severity", "SELECT event_id, CASE WHEN value / 100 + 0.15 >= 0.8 THEN 'ACTIONABLE' WHEN value / 100 + 0.15 >= 0.5 THEN 'WATCH' ELSE 'INFO' END AS severity FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.severity(F.col("value") / 100, F.lit(0.15)).alias("severity"))


@query("p26_severity_rank", "SELECT event_type, CAST(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 WHEN 'view' THEN 0 ELSE -1 END AS INTEGER) AS rank, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    name = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "ACTIONABLE").when(F.col("event_type") == "signup", "WATCH").when(F.col("event_type") == "view", "INFO")
    return _events(spark, sf_dir).groupBy("event_type", S.severity_rank(name).alias("rank")).agg(F.count("*").alias("n"))


@query("p28_evidence_state", "WITH c AS (SELECT user_id, count(*) FILTER (value > 90) AS results, bool_or(value > 50) AS ok FROM events GROUP BY 1) SELECT user_id, CASE WHEN results >= 5 THEN 'already_public' WHEN results > 0 OR ok THEN 'weakly_public' ELSE 'not_publicly_explained' END AS state, CASE WHEN results >= 5 THEN -0.25 WHEN results > 0 OR ok THEN -0.1 ELSE 0.15 END AS modifier FROM c")
def _(spark, sf_dir):
    c = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("value") > 90).alias("results"), F.bool_or(F.col("value") > 50).alias("ok"))
    state = S.evidence_state(F.col("results"), F.col("ok"))
    return c.select("user_id", state.alias("state"), S.evidence_modifier(state).alias("modifier"))


@query("p30_redaction", "SELECT p_partkey, regexp_replace('id 0xdeadbeef' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ' end', '0x[0-9a-fA-F]{8,}', '[redacted]', 'g') AS text FROM part")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", S.redacted(F.concat(F.lit("id 0xdeadbeef"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(" end"))).alias("text"))


@query("p31_eastern_time", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.date_format(F.from_utc_timestamp("ts", "America/New_York"), "yyyy-MM-dd HH:mm").alias("shown"))


@query("p32_direction", "SELECT event_id, CASE WHEN value - 50 > 0 THEN 'YES' ELSE 'NO' END AS direction FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.direction(F.col("value") - 50).alias("direction"))


@query("p34_clamp", "SELECT event_id, least(1.0, greatest(0.0, value / 60 - 0.2)) AS x FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.clamped(F.col("value") / 60 - 0.2).alias("x"))


@query("p35_stable_ids", "SELECT p_partkey, substr(sha1(p_name), 1, 16) AS short_id, sha256(p_name) AS long_id FROM part")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", S.short_id(F.col("p_name")).alias("short_id"), F.sha2("p_name", 256).alias("long_id"))


@query("p44_storage_tier", "SELECT p_partkey, CASE WHEN p_size * 12 <= 30 THEN 'hot' WHEN p_size * 12 <= 120 THEN 'warm' WHEN p_size * 12 <= 365 THEN 'cold' ELSE 'archive_only' END AS tier FROM part")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", S.storage_tier(F.col("p_size") * 12).alias("tier"))


@query("p46_partition_hour", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def _(spark, sf_dir):
    path = F.date_format("ts", "'root/year='yyyy'/month='MM'/day='dd'/hour='HH'/events'")
    return _events(spark, sf_dir).select("event_id", S.partition_hour(path).alias("hour"))


@query("p47_wallet_format", "SELECT o_custkey, regexp_matches('0x' || CASE WHEN o_custkey % 2 = 0 THEN repeat('a1', 20) ELSE repeat('g1', 20) END, '^0x[0-9a-fA-F]{40}$') AS ok FROM orders GROUP BY 1")
def _(spark, sf_dir):
    w = F.concat(F.lit("0x"), F.when(F.col("o_custkey") % 2 == 0, F.repeat(F.lit("a1"), 20)).otherwise(F.repeat(F.lit("g1"), 20)))
    return D.table(spark, sf_dir, "orders").select("o_custkey", S.wallet_valid(w).alias("ok")).distinct()


@query("p51_book_summary", "WITH b AS (SELECT o_orderkey, min(l_extendedprice / l_quantity) AS best_ask, max(l_extendedprice / l_quantity) AS best_bid, count(*) AS depth, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT *, (best_ask + best_bid) / 2 AS mid FROM b")
def _(spark, sf_dir):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = D.table(spark, sf_dir, "lineitem").join(D.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    book = rows.groupBy("o_orderkey").agg(F.min(price).alias("best_ask"), F.max(price).alias("best_bid"), F.count("*").alias("depth"), S.money(F.col("l_quantity")).alias("volume"))
    return book.withColumn("mid", (F.col("best_ask") + F.col("best_bid")) / 2)


@query("p57_safe_ratio", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / (o_custkey % 5) ELSE 0 END AS r FROM orders")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select("o_orderkey", S.safe_ratio(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("r"))


@query("p62_source_names", "SELECT DISTINCT translate(lower(trim(o_orderpriority || ' /X')), ' /', '__') AS name FROM orders")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(S.source_name(F.concat("o_orderpriority", F.lit(" /X"))).alias("name")).distinct()


@query("u3_set_intersection", "SELECT p_partkey, len(list_intersect(['a', CASE WHEN p_size > 25 THEN 'b' ELSE 'c' END], ['b', 'a'])) AS n FROM part")
def _(spark, sf_dir):
    mine = F.array(F.lit("a"), F.when(F.col("p_size") > 25, "b").otherwise("c"))
    return D.table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(mine, F.array(F.lit("b"), F.lit("a")))).cast("long").alias("n"))


@query("t4_priority_queue", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 50")
def _(spark, sf_dir):
    p = F.col("o_orderpriority")
    return D.table(spark, sf_dir, "orders").orderBy(F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).otherwise(2), "o_orderdate", "o_orderkey").select("o_orderkey").limit(50)


@query("t10_latest_row", "SELECT arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events")
def _(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("a27_buckets", "WITH b(bucket) AS (VALUES ('low'), ('mid'), ('high'), ('none')), e AS (SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS bucket FROM events) SELECT b.bucket, count(e.bucket) AS n FROM b LEFT JOIN e USING (bucket) GROUP BY 1")
def _(spark, sf_dir):
    dim = spark.createDataFrame([("low",), ("mid",), ("high",), ("none",)], "bucket string")
    e = _events(spark, sf_dir).select(F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return dim.join(e, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("a58_bounds", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a59_group_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("a30_query_latency", "SELECT event_type, round(avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END), 6) AS slow_rate, round(median(value), 6) AS median FROM events GROUP BY 1")
def _(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg((F.col("value") > 90).cast("double")), 6).alias("slow_rate"), F.round(F.median("value"), 6).alias("median"))
