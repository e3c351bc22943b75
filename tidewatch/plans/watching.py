"""Queries of the universe of markets, the review of live alerts, their payloads, calibration and the candidates' report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alerts, evaluation, health, ml, review, universe, wallets
from ..operators import detector as X
from ..sources import driver as D
from ..sources import log
from .catalog import query
from .detection import _RULES, DAYS
from .trading import _SUM, CANONICAL, canonical


def _events(spark, sf_dir):  # noqa: ANN001, ANN202
    return D.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


POLICY = universe.Policy(
    include=universe.Rules(event_slugs=("brand#3",), tags=("t3", "t5"), keywords=("bolt", "promo", "widget"), event_liquidity=20_000, market_liquidity=905),
    exclude=universe.Rules(market_slugs=("gear-7",), tags=("t9",), keywords=("cold",)),
    review_keywords=("economy", "gear"), review_liquidity=100_000, review_most=10)


def _markets(spark, sf_dir):  # noqa: ANN001, ANN202
    """Parts as markets with texts, tags, probability, liquidity, volume and tier."""
    key, size = F.col("p_partkey"), F.col("p_size")
    m = D.table(spark, sf_dir, "part").select(
        key.cast("string").alias("market_id"), F.col("p_brand").alias("event_id"), F.lower("p_brand").alias("event_slug"), F.when(key % 13 != 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), key)).alias("market_slug"),
        F.col("p_brand").alias("event_title"), F.lit("").alias("event_description"), F.col("p_name").alias("question"), F.when(key % 2 == 0, F.concat(F.lit("About "), "p_type")).alias("market_description"),
        F.when(key % 3 != 0, F.array("p_type")).alias("event_tags"), F.when(key % 5 != 0, F.array(F.concat(F.lit("t"), size % 10), F.concat(F.lit("t"), key % 7))).alias("event_tag_ids"),
        F.when(key % 11 != 0, size / 50).alias("yes_probability"), (F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int") * 5000.0).alias("event_liquidity"), F.col("p_retailprice").alias("market_liquidity"))
    v = D.trades(spark, sf_dir).groupBy("market_id").agg(S.money(F.col("notional")).alias("volume"))
    v = m.join(v, "market_id", "left")
    return universe.classified(v.withColumn("tier", F.when(F.col("volume") > 1_000_000, 1).when(F.col("volume") > 500_000, 2)), POLICY)


_UNIVERSE = f"""{D.TRADES}, v AS (SELECT market_id, {_SUM.format('notional')} AS volume FROM trades GROUP BY 1),
m AS (SELECT CAST(p_partkey AS VARCHAR) AS market_id, p_brand AS event_id, p_partkey AS k, lower(p_brand) AS event_slug, CASE WHEN p_partkey % 13 <> 0 THEN replace(p_name, ' ', '-') || '-' || p_partkey END AS market_slug,
 CASE WHEN p_partkey % 5 <> 0 THEN ['t' || (p_size % 10), 't' || (p_partkey % 7)] ELSE [] END AS tags, CASE WHEN p_partkey % 11 <> 0 THEN p_size / 50 END AS p, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) * 5000.0 AS el, p_retailprice AS ml,
 lower(concat_ws(' ', p_brand, p_brand, CASE WHEN p_partkey % 13 <> 0 THEN replace(p_name, ' ', '-') || '-' || p_partkey END, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'About ' || p_type END, CASE WHEN p_partkey % 3 <> 0 THEN p_type END)) AS text FROM part),
h AS (SELECT *, list_sort(list_filter(tags, lambda t: t IN ('t3', 't5'))) AS wanted, list_filter(['bolt', 'promo', 'widget'], lambda w: contains(text, w)) AS words, contains(text, 'economy') OR contains(text, 'gear') AS second FROM m LEFT JOIN v USING (market_id)),
c AS (SELECT *, CASE WHEN event_slug = 'brand#3' THEN 'named' WHEN p < 0.1 OR p > 0.95 THEN 'outside_band' WHEN coalesce(market_slug, '') = 'gear-7' OR list_contains(tags, 't9') OR contains(text, 'cold') THEN 'excluded'
  WHEN (len(wanted) > 0 OR len(words) > 0) AND el >= 20000 AND ml >= 905 THEN 'included' WHEN second OR el >= 100000 THEN 'review' ELSE 'none' END AS verdict,
 concat_ws('|', CASE WHEN len(wanted) > 0 THEN 'tag_ids=' || array_to_string(wanted, ',') END, CASE WHEN len(words) > 0 THEN 'keywords=' || array_to_string(words, ',') END, CASE WHEN event_slug = 'brand#3' THEN 'manual_event_slug' END) AS why,
 concat_ws('|', CASE WHEN second THEN 'secondary_keyword_match' END, CASE WHEN el >= 100000 THEN 'high_event_liquidity' END, CASE WHEN len(wanted) > 0 THEN 'include_tag_but_below_threshold' END) AS whynot,
 CASE WHEN volume > 1000000 THEN 1 WHEN volume > 500000 THEN 2 ELSE 3 END AS tier FROM h)"""


@query("t5_universe_verdicts", f"WITH {_UNIVERSE} SELECT market_id, verdict, CASE WHEN verdict IN ('named', 'included') THEN why WHEN verdict = 'review' THEN whynot ELSE '' END AS reasons FROM c")
def _(spark, sf_dir):
    return _markets(spark, sf_dir).select("market_id", "verdict", F.array_join("reasons", "|").alias("reasons"))


@query("t5_runtime_tiers", f"""WITH {_UNIVERSE}, r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY coalesce(volume, 0) DESC, market_id) AS n FROM c WHERE verdict IN ('named', 'included'))
SELECT market_id, volume, CASE WHEN tier = 1 AND n <= 6 THEN 'tier0' ELSE 'tier' || tier END AS role FROM r""")
def _(spark, sf_dir):
    return universe.tiers(_markets(spark, sf_dir), 12).select("market_id", "volume", "role")


@query("p23_review_list", f"""WITH {_UNIVERSE}, b AS (SELECT * FROM c WHERE verdict = 'review' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY el DESC, coalesce(volume, 0) DESC, market_id) = 1)
SELECT event_id, el AS event_liquidity, market_id, replace(whynot, '|', ',') AS reason, CAST(row_number() OVER (ORDER BY el DESC, event_id) AS INTEGER) AS place FROM b ORDER BY place LIMIT 10""")
def _(spark, sf_dir):
    return universe.review_list(_markets(spark, sf_dir), POLICY)


def _reviewed(spark, sf_dir):  # noqa: ANN001, ANN202
    """Signups as alerts on parts as candidates, clicks as scores, views as evidence; each event is an attempt for the one before."""
    e, hour = _events(spark, sf_dir), F.expr("interval 1 hour")
    id, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    named = F.when(k % 4 != 0, F.concat(F.lit("c"), k))
    none = F.lit(None).cast("timestamp")
    a = e.where("event_type = 'signup'").select(
        id.alias("alert_id"), F.concat(F.lit("c"), k).alias("candidate_id"), F.when(id % 2 == 0, F.concat(F.lit("Alert "), id)).otherwise("").alias("title"), F.when(F.col("value") > 80, "ACTIONABLE").when(F.col("value") > 20, "WATCH").alias("severity"),
        F.lit("created").alias("alert_status"), F.when(id % 3 == 0, F.col("ts") + hour).alias("updated_at"), F.when(id % 3 == 1, F.col("ts")).alias("created_at"), none.alias("first_delivery_at"), none.alias("last_delivery_at"))
    p, key = D.table(spark, sf_dir, "part"), F.col("p_partkey")
    c = p.where("p_partkey % 9 <> 0").select(
        F.concat(F.lit("c"), key).alias("candidate_id"), key.cast("string").alias("market_id"), F.when(key % 2 == 0, F.col("p_brand")).alias("event_title"), F.col("p_name").alias("question"), F.when(key % 3 == 0, F.lower("p_type")).otherwise("").alias("event_slug"),
        F.concat(F.lit("s"), key).alias("market_slug"), F.when(key % 5 != 0, F.timestamp_seconds(F.lit(1704067200) + F.col("p_size") * 86400)).alias("trigger_time"), F.array("p_type").alias("rules"), (F.col("p_size") / 10).alias("severity_score"),
        F.create_map(F.col("p_type"), F.lit(1.0), F.lit("b"), F.lit(2.0)).alias("features"))
    s = e.where("event_type = 'click'").select(named.alias("candidate_id"), id.alias("score_id"), F.when(id % 5 != 0, F.col("ts")).alias("scored_at"), F.col("ts").alias("created_at"), F.concat(F.lit("m"), id % 2).alias("model_version"),
                                               F.when(F.col("value") > 50, "high").otherwise("").alias("score_label"), F.when(id % 7 != 0, F.floor("value") / 1000).alias("score_value"))
    v = e.where("event_type = 'view'").select(named.alias("candidate_id"), id.alias("snapshot_id"), F.col("ts").alias("snapshot_time"), none.alias("created_at"), F.when(F.col("value") > 60, "weakly_public").alias("evidence_state"), (F.floor("value") / 100).alias("confidence_modifier"))
    t = e.select((id - 1).alias("alert_id"), F.when(F.col("value") > 40, "sent").when(F.col("value") > 10, "error").otherwise("pending").alias("delivery_status"), F.when(F.col("user_id") % 3 == 0, "chat").when(F.col("user_id") % 3 == 1, "mail").otherwise("").alias("delivery_channel"))
    return review.reviewed(a, c, s, v, t, F.lit("2024-01-10").cast("timestamp"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_REVIEW = f"""a AS (SELECT event_id AS alert_id, 'c' || {_K} AS candidate_id, CASE WHEN event_id % 2 = 0 THEN 'Alert ' || event_id END AS title, CASE WHEN value > 80 THEN 'ACTIONABLE' WHEN value > 20 THEN 'WATCH' END AS severity,
 CASE event_id % 3 WHEN 0 THEN ts + INTERVAL 1 HOUR WHEN 1 THEN ts END AS own FROM events WHERE event_type = 'signup'),
p AS (SELECT 'c' || p_partkey AS candidate_id, CAST(p_partkey AS VARCHAR) AS market_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE 's' || p_partkey END AS slug,
 CASE WHEN p_partkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(p_size AS INTEGER)) END AS trigger_time, p_size / 10 AS severity_score, p_type || ',b' AS feature_keys FROM part WHERE p_partkey % 9 <> 0),
s AS (SELECT 'c' || {_K} AS candidate_id, ts AS scored, 'm' || (event_id % 2) AS model_version, CASE WHEN value > 50 THEN 'high' ELSE '' END AS score_label, CASE WHEN event_id % 7 <> 0 THEN floor(value) / 1000 END AS score_value
 FROM events WHERE event_type = 'click' AND {_K} % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY ts DESC, event_id DESC) = 1),
v AS (SELECT 'c' || {_K} AS candidate_id, CASE WHEN value > 60 THEN 'weakly_public' END AS state, floor(value) / 100 AS modifier FROM events WHERE event_type = 'view' AND {_K} % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY ts DESC, event_id DESC) = 1),
t AS (SELECT event_id - 1 AS alert_id, count(*) AS attempts, count(*) FILTER (value > 40) AS sent, count(*) FILTER (value > 10 AND value <= 40) AS failed, CASE min(user_id % 3) WHEN 0 THEN 'chat' WHEN 1 THEN 'mail' ELSE '' END AS channels FROM events GROUP BY 1),
r AS (SELECT alert_id, candidate_id, coalesce(title, name) AS title, market_id, slug, severity, coalesce(own, trigger_time) AS alert_time, trigger_time, severity_score, state, modifier, coalesce(attempts, 0) AS attempts, coalesce(sent, 0) AS sent, coalesce(failed, 0) AS failed,
  coalesce(channels, '') AS channels, s.candidate_id IS NOT NULL AS scored, model_version, score_label, score_value, coalesce(feature_keys, '') AS feature_keys
 FROM a LEFT JOIN p USING (candidate_id) LEFT JOIN s USING (candidate_id) LEFT JOIN v USING (candidate_id) LEFT JOIN t USING (alert_id) WHERE coalesce(own, trigger_time, TIMESTAMP '2024-01-10') >= TIMESTAMP '2024-01-10')"""


@query("a55_alert_review", f"""WITH {_REVIEW} SELECT alert_id, candidate_id, title, market_id, slug, severity, trigger_time, alert_time, severity_score, state AS public_evidence_state, modifier AS confidence_modifier, attempts AS attempt_count, sent AS sent_count,
 failed AS error_count, channels, CASE WHEN scored THEN 'scored' ELSE 'missing' END AS ml_state, model_version, score_label, score_value, feature_keys FROM r""")
def _(spark, sf_dir):
    rows = _reviewed(spark, sf_dir)
    return rows.withColumns({"channels": F.array_join("channels", ","), "feature_keys": F.array_join("feature_keys", ",")}).drop("alert_status", "rules", "scored_at")


@query("a55_review_counts", f"""WITH {_REVIEW}, e AS (SELECT unnest([{{'kind': 'severity', 'value': coalesce(severity, 'unknown')}}, {{'kind': 'evidence_state', 'value': coalesce(state, 'unknown')}},
 {{'kind': 'ml_label', 'value': coalesce(nullif(score_label, ''), 'missing')}}, {{'kind': 'ml_model', 'value': coalesce(model_version, 'missing')}}]) AS x FROM r) SELECT x.kind AS kind, x.value AS value, count(*) AS n FROM e GROUP BY 1, 2""")
def _(spark, sf_dir):
    return review.counts(_reviewed(spark, sf_dir))


@query("a55_promotion_readiness", f"""WITH {_REVIEW}, g AS (SELECT count(*) AS n, count(*) FILTER (scored) AS k, count(*) FILTER (sent > 0) AS d, count(*) FILTER (sent > 0 AND scored) AS dk, count(score_value) AS scores, min(score_value) AS low, max(score_value) AS high,
 count(DISTINCT round(score_value, 6)) AS many, list_sort(list(DISTINCT round(score_value, 6)) FILTER (score_value IS NOT NULL))[1:25] AS shown FROM r),
w AS (SELECT *, concat_ws(',', CASE WHEN n = 0 THEN 'no_alerts' END, CASE WHEN coalesce(k / nullif(n, 0), 0) < 0.9 THEN 'coverage' END, CASE WHEN scores < 25 THEN 'few_scores' END, CASE WHEN many <= 2 THEN 'flat_scores' END, CASE WHEN dk < d THEN 'delivered_without_score' END) AS gates FROM g)
SELECT n AS alerts_reviewed, k AS alerts_scored, d AS delivered, dk AS delivered_scored, scores AS n_scores, low AS least_score, high AS largest_score, many AS distinct_scores, array_to_string(shown, ',') AS distinct_values, gates, round(coalesce(k / nullif(n, 0), 0), 4) AS coverage,
 CASE WHEN gates = '' THEN 'review_for_priority_only' ELSE 'not_ready' END AS promotion_readiness FROM w""")
def _(spark, sf_dir):
    out = review.readiness(_reviewed(spark, sf_dir))
    return out.withColumns({"distinct_values": F.array_join(F.col("distinct_values").cast("array<string>"), ","), "gates": F.array_join("gates", ",")})


@query("a55_review_examples", f"""WITH {_REVIEW}, l AS (SELECT 'top_scored' AS list, * FROM r UNION ALL SELECT 'delivered', * FROM r WHERE sent > 0 UNION ALL SELECT 'missing_score', * FROM r WHERE NOT scored)
SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY score_value DESC NULLS LAST, alert_time DESC NULLS LAST, alert_id) AS INTEGER) AS place, alert_id FROM l QUALIFY place <= 20""")
def _(spark, sf_dir):
    return review.examples(_reviewed(spark, sf_dir), 20)


BASE = "https://host/event"
_ISO = "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S')"
_Q = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


def _object(**fields: str) -> str:
    """SQL of a JSON object from the SQL of its fields' JSON texts."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in sorted(fields.items())) + " || '}'"


_LINKS = {"market_url": _Q("coalesce(event_url, slug_url)"), "event_url": _Q("event_url"), "market_slug_url": _Q("slug_url"), "market_slug": _Q("market_slug"), "event_slug": _Q("event_slug"), "condition_id": _Q("condition_id")}
_PAYLOAD = _object(
    **_LINKS, title=_Q("title"), severity=_Q("severity"), trigger_time_display=_Q("shown"), what_changed=_Q("'Candidate ' || id || ' triggered at ' || shown"), why_it_looks_informed=_Q("'Rules=' || rules || ' severity_score=' || score"),
    market_evidence=_object(**_LINKS, market_id=_Q("market_id"), event_id=_Q("event_id"), feature_snapshot="features"), active_outcome_side=_Q("side"), active_outcome_probability="p", public_evidence_state=_Q("state"), provider_summary="provider",
    ml_shadow_score=_object(state=_Q("ml"), model_version=_Q("model"), score_label=_Q("label"), score_value="coalesce(CAST(score_value AS VARCHAR), 'null')", scored_at=_Q("scored_at")), invalidates_it=_Q(repr(alerts.INVALIDATES)), detector_version=_Q("'d1'"), feature_schema_version=_Q("'f1'"))


@query("p56_rendered_payload", f"""WITH e AS (SELECT *, event_id AS id, json_extract_string(props, '$.k') AS k, ts + to_days(CASE WHEN user_id % 2 = 1 THEN 170 ELSE 0 END) AS moment FROM events WHERE event_type = 'purchase'),
w AS (SELECT *, moment - to_hours(CASE WHEN moment >= TIMESTAMP '2024-03-10 07:00:00' AND moment < TIMESTAMP '2024-11-03 06:00:00' THEN 4 ELSE 5 END) AS l FROM e),
x AS (SELECT id, 'm' || k AS market_id, 'e' || user_id AS event_id, '0xabcdef123456' AS condition_id, CASE WHEN id % 4 = 0 THEN '/a b~c*' || k || '/' WHEN id % 4 = 1 THEN '' END AS event_slug, CASE WHEN id % 4 = 0 THEN '{BASE}/a%20b~c%2A' || k END AS event_url, 's-' || k AS market_slug, '{BASE}/s-' || k AS slug_url,
 CASE WHEN id % 3 = 0 THEN 'By "[wallet_redacted]" ' || k WHEN id % 3 = 1 THEN 'Will it?' WHEN id % 4 = 0 THEN '/a b~c*' || k || '/' ELSE 'Market m' || k END AS title, CASE WHEN value > 80 THEN 'ACTIONABLE' ELSE 'WATCH' END AS severity,
 strftime(l, '%b ') || day(l) || ', ' || year(l) || ' ' || ((hour(l) + 11) % 12 + 1) || strftime(l, ':%M %p') || ' ET' AS shown, CASE WHEN id % 2 = 0 THEN '[''burst'', ''flow'']' ELSE '[]' END AS rules, CAST((floor(value) + 1) / 1000 AS VARCHAR) AS score,
 CASE id % 4 WHEN 0 THEN '{{"n":[1,{{"w":"[wallet_redacted]"}}],"probability_velocity":-0.5,"wallet":"[wallet_redacted]"}}' WHEN 1 THEN '"no json [wallet_redacted]"' WHEN 2 THEN '{{}}' ELSE '{{"active_outcome_side":"no"}}' END AS features,
 CASE WHEN id % 4 IN (0, 3) THEN 'NO' ELSE 'YES' END AS side, CASE WHEN id % 5 = 0 THEN 'null' WHEN id % 4 IN (0, 3) THEN '0.75' ELSE '0.25' END AS p, CASE WHEN id % 3 = 0 THEN 'weakly_public' ELSE 'pending_evidence' END AS state, CASE WHEN id % 2 = 0 THEN '{{"feed":{{"hits":2}}}}' ELSE '{{}}' END AS provider,
 CASE WHEN id % 3 = 1 THEN 'scored' ELSE 'pending' END AS ml, CASE WHEN id % 3 = 1 THEN 'm1' END AS model, CASE WHEN id % 3 = 1 THEN 'high' END AS label, CASE WHEN id % 3 = 1 THEN (floor(value) + 1) / 1000 END AS score_value, CASE WHEN id % 3 = 1 THEN {_ISO} END AS scored_at FROM w)
SELECT id AS candidate_id, {_PAYLOAD} AS payload FROM x""")
def _(spark, sf_dir):
    id, k, value = F.col("event_id"), F.get_json_object("props", "$.k"), (F.floor("value") + 1) / 1000
    of = lambda n: id % 4 == n
    has = lambda c: F.when(id % 3 == 1, c)
    features = F.when(of(0), '{"wallet": "0x1234567890ab", "n": [1, {"w": "0x99999999"}], "probability_velocity": -0.5}').when(of(1), "no json 0xdeadbeefdead").when(of(3), '{"active_outcome_side": "no"}')
    rows = _events(spark, sf_dir).where("event_type = 'purchase'").select(
        id.alias("candidate_id"), F.concat(F.lit("m"), k).alias("market_id"), F.concat(F.lit("e"), "user_id").alias("event_id"), F.lit("0xabcdef123456").alias("condition_id"), F.when(id % 3 == 0, F.concat(F.lit('By "0x00112233aa" '), k)).alias("event_title"),
        F.when(id % 3 == 1, "Will it?").otherwise("").alias("question"), F.when(of(0), F.concat(F.lit("/a b~c*"), k, F.lit("/"))).when(of(1), "").alias("event_slug"), F.concat(F.lit("s-"), k).alias("market_slug"),
        (F.col("ts") + F.make_dt_interval(F.when(F.col("user_id") % 2 == 1, 170).otherwise(0))).alias("trigger_time"), F.when(id % 2 == 0, F.array(F.lit("burst"), F.lit("flow"))).otherwise(F.array().cast("array<string>")).alias("rules"),
        F.when(F.col("value") > 80, "ACTIONABLE").otherwise("WATCH").alias("severity"), value.alias("severity_score"), features.alias("features"), F.when(id % 2 == 0, '{"feed": {"hits": 2}}').alias("provider_summary"),
        F.array(F.lit("Yes"), F.lit(" no ")).alias("outcomes"), F.when(id % 5 != 0, F.array(F.lit("0.25"), F.lit("0.75"))).alias("outcome_prices"), F.when(id % 3 == 0, "weakly_public").alias("evidence_state"),
        has(F.lit("m1")).alias("model_version"), has(F.lit("high")).alias("score_label"), has(value).alias("score_value"), has(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("scored_at"), F.lit("d1").alias("detector_version"), F.lit("f1").alias("feature_schema_version"))
    return alerts.rendered(rows, BASE)


@query("p31_eastern_display", """WITH t AS (SELECT event_id, ts + to_days(CAST(event_id * 7 % 365 AS INTEGER)) AS moment FROM events), l AS (SELECT event_id, moment - to_hours(CASE WHEN moment >= TIMESTAMP '2024-03-10 07:00:00' AND moment < TIMESTAMP '2024-11-03 06:00:00' THEN 4 ELSE 5 END) AS l FROM t)
SELECT event_id, strftime(l, '%b ') || day(l) || ', ' || year(l) || ' ' || ((hour(l) + 11) % 12 + 1) || strftime(l, ':%M %p') || ' ET' AS shown FROM l""")
def _(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", S.eastern(F.col("ts") + F.make_dt_interval((F.col("event_id") * 7 % 365).cast("int"))).alias("shown"))


_TARGETS = ", ".join(f"round(coalesce(arg_min(score, r) FILTER (p >= {t}), quantile_cont(score, {1 - t})), 6) AS {name}" for name, t in ml.PRECISIONS.items())


@query("m7_calibration_profiles", f"""WITH {D.SCORED}, u AS (SELECT *, CASE WHEN doc_id % 7 < 3 THEN 'tight' WHEN doc_id % 7 < 6 THEN 'mid' ELSE 'wide' END AS bucket FROM scored WHERE doc_id % 3 = 0 AND label IS NOT NULL),
 e AS (SELECT 'global' AS scope, 'global' AS key, doc_id, score, label FROM u UNION ALL SELECT 'liquidity_bucket', bucket, doc_id, score, label FROM u UNION ALL SELECT 'category', category, doc_id, score, label FROM u),
 r AS (SELECT *, row_number() OVER w AS r, sum(label) OVER w / row_number() OVER w AS p FROM e WINDOW w AS (PARTITION BY scope, key ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
 SELECT scope, key, {_TARGETS}, count(*) AS n, round(avg(label), 6) AS positive_rate, round(avg(score), 6) AS mean_score FROM r GROUP BY 1, 2""")
def _(spark, sf_dir):
    part = F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train")
    return ml.calibration_profiles(D.scored(spark, sf_dir).withColumns({"dataset_partition": part, "liquidity_bucket": S.liquidity(F.col("doc_id") % 7 / 100.0)}))


@query("a20_candidate_report", f"""WITH {_RULES}, hits AS (SELECT sev.seq, sev.market_id, severity, rules, stream.ts FROM sev JOIN stream USING (seq) WHERE len(rules) > 0), m AS (SELECT market_id AS key, count(*) AS n, max(severity) AS severity FROM hits GROUP BY 1)
SELECT 'hour' AS section, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00') AS key, count(*) AS n, max(severity) AS severity FROM hits GROUP BY 2 UNION ALL SELECT 'rule', rule, count(*), max(severity) FROM (SELECT unnest(rules) AS rule, severity FROM hits) GROUP BY 2
UNION ALL SELECT 'market', * FROM (SELECT * FROM m ORDER BY n DESC, severity DESC, key LIMIT 10) UNION ALL SELECT 'total', 'total_candidates', count(*), max(severity) FROM hits UNION ALL SELECT 'total', 'unique_markets', count(DISTINCT market_id), max(severity) FROM hits""")
def _(spark, sf_dir):
    return evaluation.candidate_report(X.candidates(D.stream(spark, sf_dir), DAYS))


_LOW = "lower(nullif(trim(wallet), ''))"


@query("a4_netted_positions", f"""WITH {CANONICAL}, t AS (SELECT {_LOW} AS wallet, market_id, outcome_side, nullif(trim(condition_id), '') AS condition_id, trade_id, ts, coalesce(side = 'SELL', false) AS sell, size,
  CASE WHEN priority = 2 THEN CAST(price * size AS DECIMAL(28,10)) ELSE CAST(notional AS DECIMAL(28,10)) END AS amount, price FROM canonical WHERE {_LOW} IS NOT NULL),
g AS (SELECT wallet, market_id, outcome_side, sum(CASE WHEN sell THEN 0 ELSE size END) AS buy_size, sum(CASE WHEN sell THEN size ELSE 0 END) AS sell_size, CAST(coalesce(sum(amount) FILTER (NOT sell), 0) AS DOUBLE) AS buy_amount, CAST(coalesce(sum(amount) FILTER (sell), 0) AS DOUBLE) AS sell_amount,
 count(*) AS n_trades, count(*) FILTER (NOT sell) AS n_buy, count(*) FILTER (sell) AS n_sell, min(price) FILTER (price > 0) AS low, max(price) FILTER (price > 0) AS high, min(ts) AS first_ts, max(ts) AS last_ts, list(trade_id ORDER BY ts, trade_id)[1:5] AS ids FROM t GROUP BY 1, 2, 3),
m AS (SELECT wallet, market_id, outcome_side, condition_id FROM (SELECT wallet, market_id, outcome_side, condition_id, count(*) AS n FROM t WHERE condition_id IS NOT NULL GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY wallet, market_id, outcome_side ORDER BY n DESC, condition_id) = 1)
SELECT g.* EXCLUDE (ids), m.condition_id, buy_size - sell_size AS net_size, round(buy_amount - sell_amount, 6) AS net_notional, buy_amount / nullif(buy_size, 0) AS avg_buy_price, sell_amount / nullif(sell_size, 0) AS avg_sell_price, array_to_string(ids, ',') AS first_trades
FROM g LEFT JOIN m USING (wallet, market_id, outcome_side) WHERE abs(buy_size - sell_size) > 1e-9""")
def _(spark, sf_dir):
    t = canonical(spark, sf_dir, "wallet", "market_id", "outcome_side", "condition_id", "side", "price", "size", "notional").withColumn("notional", F.when(F.col("priority") != 2, F.col("notional")))
    return wallets.netted(t).withColumn("net_notional", F.round("net_notional", 6))


_ID = "substr(sha1({}'v1|' || market_id || '|' || epoch_us(ts)), 1, 16)"


@query("sk6_recorded_candidates", f"""WITH {_RULES}, found AS (SELECT sev.market_id, date_trunc('hour', stream.ts) AS ts, sev.seq, severity FROM sev JOIN stream USING (seq) WHERE len(rules) > 0), once AS (SELECT market_id, ts, min(seq) AS seq, arg_min(severity, seq) AS severity FROM found GROUP BY 1, 2)
SELECT 'v1' AS detector_version, market_id, ts, seq, severity, {_ID.format('')} AS candidate_id, {_ID.format("'episode|' || ")} AS episode_id FROM once WHERE ts >= TIMESTAMP '2024-01-10' OR seq % 2 = 0""")
def _(spark, sf_dir):
    found = X.candidates(D.stream(spark, sf_dir), DAYS).select("market_id", F.date_trunc("hour", "ts").alias("ts"), "seq", "severity")
    stored = X.recorded(found, "v1").where("ts < timestamp '2024-01-10' and seq % 2 = 1")
    return X.recorded(found, "v1", stored)


def _envelopes(spark, sf_dir):  # noqa: ANN001, ANN202
    e, id = _events(spark, sf_dir), F.col("event_id").cast("string")
    return e.select(
        F.concat(F.lit("n"), id).alias("envelope_id"), F.lit("1").alias("schema_version"), F.col("event_type").alias("source_system"), F.lit("page").alias("entity_type"), F.when(F.col("user_id") % 2 == 0, "push").alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("captured_at"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("k"), F.col("user_id"))).alias("ordering_key"), F.col("props").alias("payload"), "ts", "event_id")


_SCAN = "FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"
_SEQ = "row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%dT%H'), CASE WHEN user_id % 3 <> 0 THEN 'k' || user_id ELSE '' END, 'n' || event_id)"


@query("sc3_ordered_scan", f"SELECT event_id, {_SEQ} AS seq {_SCAN}")
def _(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).where("source_system in ('click', 'view') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
    return log.ordered(rows).select("event_id", "seq")


@query("sc3_limited_scan", f"SELECT event_id, {_SEQ} AS seq {_SCAN} QUALIFY seq <= 150")
def _(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).where("source_system in ('click', 'view') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
    return log.ordered(rows, 150).select("event_id", "seq")


_UTC = "strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00'"


@query("st15_republished", f"""SELECT 'run' AS replay_run_id, {_UTC} AS captured_at, '2024-02-01T00:00:00+00:00' AS replayed_at, event_type AS source_system, 'replay_raw_event' AS entity_type, {_UTC} || '::n' || event_id AS ordering_key,
 strftime(ts, 'year=%Y/month=%m/day=%d/hour=%H/source=') || event_type AS raw_partition, 'n' || event_id AS original_envelope_id, CASE WHEN user_id % 2 = 0 THEN 'push' END AS original_event_type, '1' AS original_schema_version,
 '{{"envelope_id":"n' || event_id || '","schema_version":"1","source_system":"' || event_type || '","entity_type":"page","event_type":' || CASE WHEN user_id % 2 = 0 THEN '"push"' ELSE 'null' END || ',"captured_at":"' || strftime(ts, '%Y-%m-%dT%H')
 || '","ordering_key":' || CASE WHEN user_id % 3 <> 0 THEN '"k' || user_id || '"' ELSE 'null' END || ',"payload":' || CAST(to_json(props) AS VARCHAR) || '}}' AS payload {_SCAN}""")
def _(spark, sf_dir):
    rows = _envelopes(spark, sf_dir).where("source_system in ('click', 'view') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
    return log.republished(rows, "run", F.lit("2024-02-01").cast("timestamp"))


def _decisions(spark, sf_dir):  # noqa: ANN001, ANN202
    e, id = _events(spark, sf_dir), F.col("event_id")
    names = F.array(*map(F.lit, ("keep", "compact_candidate", "cold_archive_candidate", "compact_and_cold_archive")))
    return e.select(F.concat(F.lit("p"), id).alias("path"), F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("s"), F.col("user_id") % 10)).alias("source"), F.floor(F.col("value") * 100).cast("long").alias("n_bytes"), (id % 50 != 0).alias("exists"), F.get(names, (id % 4).cast("int")).alias("action"),
                    F.when(id % 7 != 0, S.storage_tier(F.col("value") * 2)).alias("tier"))


_AUDIT = """d AS (SELECT 'p' || event_id AS path, CASE WHEN user_id % 10 <> 0 THEN 's' || (user_id % 10) ELSE 'unknown' END AS source, CAST(floor(value * 100) AS BIGINT) AS n_bytes, event_id % 50 = 0 AS gone, ['keep', 'compact_candidate', 'cold_archive_candidate', 'compact_and_cold_archive'][event_id % 4 + 1] AS action,
 CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN value * 2 <= 30 THEN 'hot' WHEN value * 2 <= 120 THEN 'warm' WHEN value * 2 <= 365 THEN 'cold' ELSE 'archive_only' END AS tier FROM events)"""
_ROLL = "count(*) AS partitions, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(*) FILTER (gone) AS missing, count(*) FILTER (action LIKE 'compact%') AS compact, count(*) FILTER (action LIKE '%cold_archive%') AS cold"


@query("a32_integrity_summary", f"""WITH {_AUDIT}, s AS (SELECT source, {_ROLL} FROM d GROUP BY 1) SELECT source, CAST(row_number() OVER (ORDER BY missing DESC, bytes DESC, source) AS INTEGER) AS place, partitions, bytes, missing, compact, cold, NULL AS status FROM s
UNION ALL SELECT NULL, (SELECT count(*) FROM s), *, CASE WHEN missing > 0 THEN 'missing_partitions_detected' ELSE 'ready' END FROM (SELECT {_ROLL} FROM d)""")
def _(spark, sf_dir):
    return health.integrity_summary(_decisions(spark, sf_dir))


@query("a33_dashboard", f"""WITH {_AUDIT}, r AS (SELECT x.s AS section, x.k AS key, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes, count(*) FILTER (gone) AS missing FROM (SELECT unnest([{{'s': 'source', 'k': source}}, {{'s': 'action', 'k': action}}, {{'s': 'tier', 'k': tier}}]) AS x, n_bytes, gone FROM d) GROUP BY 1, 2)
SELECT * FROM (SELECT * FROM r WHERE section = 'source' ORDER BY bytes DESC, key LIMIT 5) UNION ALL SELECT * FROM r WHERE section <> 'source' UNION ALL SELECT * FROM (SELECT 'partition', path, 1, n_bytes, CAST(gone AS BIGINT) FROM d ORDER BY n_bytes DESC, path LIMIT 5)""")
def _(spark, sf_dir):
    return health.dashboard(_decisions(spark, sf_dir), 5)


@query("m12_status_ladders", """WITH now AS (SELECT max(ts) + INTERVAL 10 HOUR AS t FROM events), a AS (SELECT event_id, ts, CAST(floor(value) AS BIGINT) % 3 AS missing FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1),
m AS (SELECT 'm' || user_id AS model FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 ORDER BY ts DESC, 'm' || user_id DESC LIMIT 1), x AS (SELECT 'a' || event_id AS audit_id, (epoch_us(t) - epoch_us(ts)) / 3600000000 AS age, missing, (SELECT count(*) FROM events, now WHERE event_type = 'signup' AND ts >= t - INTERVAL 24 HOUR) AS recent_alerts,
 (SELECT count(*) FROM events, now WHERE event_type = 'click' AND ts >= t - INTERVAL 24 HOUR) AS recent_scores, (SELECT model FROM m) AS active_model FROM a, now),
y AS (SELECT *, concat_ws(',', CASE WHEN age > 48 THEN 'storage_audit_is_stale' END, CASE WHEN missing > 0 THEN 'missing_archive_files_detected' END, CASE WHEN recent_scores = 0 THEN 'no_recent_shadow_scores' END, CASE WHEN active_model IS NULL THEN 'no_active_shadow_model' END) AS blockers FROM x)
SELECT audit_id, round(age, 3) AS age_hours, missing, recent_alerts, recent_scores, active_model, CASE WHEN missing > 0 THEN 'missing_archive_files' WHEN age > 48 THEN 'stale_storage_audit' ELSE 'ok' END AS health, blockers, CASE WHEN blockers = '' THEN 'ready_for_redundancy_design' ELSE 'not_ready_for_redundancy_design' END AS redundancy FROM y""")
def _(spark, sf_dir):
    e = _events(spark, sf_dir)
    of = lambda kind: e.where(F.col("event_type") == kind)
    end = e.agg((F.max("ts") + F.expr("interval 10 hours")).alias("now"))
    audits = of("error").select(F.concat(F.lit("a"), "event_id").alias("audit_id"), "ts", (F.floor("value") % 3).alias("missing"))
    models = of("purchase").select(F.concat(F.lit("m"), "user_id").alias("model"), F.when(F.col("user_id") % 2 == 0, "active").otherwise("retired").alias("status"), F.col("ts").alias("activated_ts"))
    now = F.lit(end.first()[0])
    return health.ladders(audits, health.runtime(of("signup"), of("click"), models, now), now).withColumn("blockers", F.array_join("blockers", ","))
