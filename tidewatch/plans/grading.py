"""Queries of the replay evaluation and the rankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import ml as M
from ..sources import driver as D
from .catalog import query

_ALERTS, _QUOTES, _RESOLUTIONS = (D.kind_sql(n, k) for n, k in (("alerts", "signup"), ("quotes", "click"), ("resolutions", "error")))


def _paper(spark, sf_dir):  # noqa: ANN001, ANN202
    alerts = D.kind(spark, sf_dir, "signup").select("id", "market_id", "ts", S.direction(F.col("value") - 50).alias("direction"))
    resolved = D.kind(spark, sf_dir, "error").groupBy("market_id").agg(F.max("ts").alias("resolved_ts"), F.max_by("value", F.struct("ts", "id")).alias("v"))
    resolved = resolved.select("market_id", "resolved_ts", F.when(F.col("v") > 50, "YES").otherwise("NO").alias("resolution"))
    quotes = D.kind(spark, sf_dir, "click").select("market_id", "ts", (F.col("value") / (F.col("value") + 50)).alias("yes"))
    return E.paper_trades(alerts.join(resolved, "market_id", "left"), quotes)


_PAPER = f"""{_ALERTS}, {_QUOTES}, {_RESOLUTIONS}, r AS (SELECT market_id, max(ts) AS resolved_ts, CASE WHEN arg_max(value, (ts, id)) > 50 THEN 'YES' ELSE 'NO' END AS resolution FROM resolutions GROUP BY 1),
a AS (SELECT id, market_id, ts, CASE WHEN value - 50 > 0 THEN 'YES' ELSE 'NO' END AS direction, resolved_ts, resolution FROM alerts LEFT JOIN r USING (market_id)),
s AS (SELECT a.id, q.ts, CASE WHEN direction = 'YES' THEN q.value / (q.value + 50) ELSE 1 - q.value / (q.value + 50) END AS price FROM a JOIN quotes q ON q.market_id = a.market_id AND q.ts BETWEEN a.ts AND greatest(a.ts + INTERVAL 24 HOUR, coalesce(resolved_ts, a.ts)) WHERE resolved_ts IS NULL OR q.ts < resolved_ts),
e AS (SELECT id, min(ts) AS entry_ts, least(1.0, greatest(0.0, arg_min(price, (ts, price)) + 0.01)) AS entry FROM s GROUP BY 1),
x AS (SELECT id, min(ts) AS exit_ts, arg_min(greatest(0.0, price - 0.01), (ts, price)) AS exit, arg_min(why, (ts, price)) AS why FROM (SELECT s.id, s.ts, s.price, CASE WHEN price <= entry * (1 - 0.2) THEN 'risk_stop' WHEN s.ts >= entry_ts + INTERVAL 24 HOUR THEN 'time_stop' END AS why FROM s JOIN e USING (id) WHERE s.ts > entry_ts) WHERE why IS NOT NULL GROUP BY 1),
j AS (SELECT a.id, a.market_id, direction, entry_ts, entry, resolved_ts, resolution, x.exit_ts AS xt, x.exit AS xp, CASE WHEN entry IS NULL THEN 'no_entry' WHEN x.why IS NOT NULL THEN x.why WHEN resolved_ts IS NOT NULL THEN 'resolution_exit' ELSE 'expired_unexitable' END AS reason FROM a LEFT JOIN e USING (id) LEFT JOIN x USING (id)),
k AS (SELECT *, CASE WHEN reason IN ('risk_stop', 'time_stop') THEN xp WHEN reason = 'resolution_exit' THEN CASE WHEN direction = resolution THEN 1.0 ELSE 0.0 END END AS px, CASE WHEN xt IS NOT NULL THEN xt WHEN reason = 'resolution_exit' THEN resolved_ts END AS pt FROM j),
paper AS (SELECT id, market_id, direction, entry_ts, round(entry, 6) AS entry, pt AS exit_ts, round(px, 6) AS exit, reason, round(100.0 / entry * (px - entry) - 100.0 * 0.02 * 2, 6) AS pnl FROM k)"""


@query("m10_paper_trades", f"WITH {_PAPER} SELECT * FROM paper")
def _(spark, sf_dir):
    return _paper(spark, sf_dir)


@query("a13_trade_metrics", f"""WITH {_PAPER}, o AS (SELECT *, CASE WHEN pnl IS NOT NULL THEN row_number() OVER (PARTITION BY direction ORDER BY pnl NULLS LAST, id) END AS r, count(pnl) OVER (PARTITION BY direction) AS n FROM paper)
 SELECT direction, count(*) AS n, count(pnl) AS filled, round(avg(pnl), 6) AS mean_pnl, round(median(pnl), 6) AS median_pnl, round(count(*) FILTER (pnl > 0) / count(pnl), 6) AS hit_rate, round(avg(pnl) FILTER (r <= greatest(1, floor(n / 10))), 6) AS worst_tenth FROM o GROUP BY 1""")
def _(spark, sf_dir):
    return E.trade_metrics(_paper(spark, sf_dir), "direction")


@query("w17_position_limits")
def _(spark, sf_dir):
    family = F.concat(F.lit("f"), F.col("market_id").cast("int") % 7)
    return E.limited(_paper(spark, sf_dir).withColumn("family", family), "family").select("id", "reason", "taken")


@query("a12_lead_times", f"""WITH {_ALERTS}, {_RESOLUTIONS}, r AS (SELECT market_id, max(ts) AS t FROM resolutions GROUP BY 1), v AS (SELECT (epoch_us(t) - epoch_us(ts)) // 1000000 AS lead FROM alerts JOIN r USING (market_id) WHERE t > ts), o AS (SELECT lead, row_number() OVER (ORDER BY lead) - 1 AS i, count(*) OVER () AS n FROM v)
 SELECT count(*) AS n, CAST(median(lead) AS DOUBLE) AS median, max(lead) FILTER (i = greatest(0, floor(n * 0.25) - 1)) AS p25, max(lead) FILTER (i = greatest(0, floor(n * 0.75) - 1)) AS p75, round(avg(CASE WHEN lead < 3600 THEN 1.0 ELSE 0.0 END), 6) AS short_share FROM o""")
def _(spark, sf_dir):
    r = D.kind(spark, sf_dir, "error").groupBy("market_id").agg(F.max("ts").alias("t"))
    rows = D.kind(spark, sf_dir, "signup").join(r, "market_id").where("t > ts").select(F.floor((F.unix_micros("t") - F.unix_micros("ts")) / 1000000).alias("lead"))
    return E.lead_times(rows, "lead")


@query("w8_family_folds", "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS r FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, 'fold_' || ((r - 1) % 5 + 1) || '_of_5' AS fold FROM events JOIN k USING (event_type)")
def _(spark, sf_dir):
    return E.family_folds(D.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").select("event_id", "fold")


_BLOCK = "strftime(DATE '1970-01-01' + CAST(floor(epoch(ts) / 432000) * 5 AS INTEGER), '%Y-%m-%d')"
_TBLOCK = f"'time_block:' || {_BLOCK} || ':' || strftime(DATE '1970-01-01' + CAST(floor(epoch(ts) / 432000) * 5 + 5 AS INTEGER), '%Y-%m-%d')"


@query("p36_time_blocks", f"SELECT event_id, {_TBLOCK} AS block FROM events")
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select("event_id", S.time_block(F.col("ts").cast("timestamp"), Evaluation(block_days=5)).alias("block"))


@query("w9_time_split", f"WITH b AS (SELECT event_id, {_TBLOCK} AS block FROM events), r AS (SELECT block, row_number() OVER (ORDER BY block DESC) AS r FROM (SELECT DISTINCT block FROM b)) SELECT event_id, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS partition FROM b JOIN r USING (block)")
def _(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select("event_id", S.time_block(F.col("ts").cast("timestamp"), Evaluation(block_days=5)).alias("block"))
    return E.time_split(rows, "block").select("event_id", "partition")


@query("a17_split_summary", f"""WITH {D.SCORED}, e AS (SELECT 'split' AS regime, split AS key, label FROM scored UNION ALL SELECT 'category', category, label FROM scored) SELECT regime, key, count(*) AS n, count(label) AS labelled, round(avg(label), 6) AS precision, CASE WHEN count(label) = 0 THEN 'unlabelled' WHEN count(*) >= 30 THEN 'scored' ELSE 'descriptive_only' END AS status FROM e GROUP BY 1, 2""")
def _(spark, sf_dir):
    return E.split_summary(D.scored(spark, sf_dir), {"split": "split", "category": "category"})


@query("a14_dependency", f"WITH {D.SCORED}, c AS (SELECT category, count(*) AS n FROM scored GROUP BY 1) SELECT arg_max(category, (n, category)) AS largest, round(max(n) / sum(n), 6) AS share, count(*) AS \"values\" FROM c")
def _(spark, sf_dir):
    return E.dependency(D.scored(spark, sf_dir), "category")


@query("w11_auc", f"WITH {D.SCORED} SELECT split, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label <> 1) AS negatives, CASE WHEN count(*) FILTER (label = 1) * count(*) FILTER (label <> 1) > 0 THEN round(sum(CASE WHEN label = 1 THEN below END) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6) END AS auc FROM (SELECT a.split, a.label, (SELECT coalesce(sum(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0 END), 0) FROM scored b WHERE b.split = a.split AND b.label <> 1) AS below FROM scored a) GROUP BY 1")
def _(spark, sf_dir):
    return M.auc(D.scored(spark, sf_dir), "split")


@query("w12_precision_at_k", f"WITH {D.SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, doc_id) AS r FROM scored) SELECT split, round(avg(label) FILTER (r <= 10), 6) AS p_at_10, round(avg(label) FILTER (r <= 25), 6) AS p_at_25 FROM r WHERE r <= 25 GROUP BY 1")
def _(spark, sf_dir):
    return M.precision_at(D.scored(spark, sf_dir), (10, 25), "split")


@query("w10_precision_threshold", f"""WITH {D.SCORED}, r AS (SELECT *, row_number() OVER w AS r, sum(label) OVER w / row_number() OVER w AS p FROM scored WINDOW w AS (PARTITION BY split ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
 SELECT split, round(coalesce(arg_min(score, r) FILTER (p >= 0.8), quantile_cont(score, 0.2)), 6) AS threshold, count(*) AS n FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return M.precision_threshold(D.scored(spark, sf_dir), 0.8, "split")


@query("m2_linear_fit", f"""WITH {D.SCORED}, x AS (SELECT score AS f1, CAST(length(category) AS DOUBLE) AS f2, CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END AS y FROM scored),
 g AS (SELECT avg(y) AS rate, avg(f1) AS m1, avg(f2) AS m2, CASE WHEN stddev_samp(f1) <= 1e-9 THEN 1 ELSE stddev_samp(f1) END AS s1, CASE WHEN stddev_samp(f2) <= 1e-9 THEN 1 ELSE stddev_samp(f2) END AS s2, avg(f1) FILTER (y = 1) - avg(f1) FILTER (y = 0) AS d1, avg(f2) FILTER (y = 1) - avg(f2) FILTER (y = 0) AS d2 FROM x),
 w AS (SELECT *, d1 / s1 AS r1, d2 / s2 AS r2 FROM g)
 SELECT unnest(['f1', 'f2']) AS feature, round(unnest([m1, m2]), 6) AS mean, round(unnest([s1, s2]), 6) AS std, round(unnest([r1, r2]) / (abs(r1) + abs(r2)), 6) AS weight, round(ln(rate / (1 - rate)), 6) AS intercept FROM w""")
def _(spark, sf_dir):
    rows = D.scored(spark, sf_dir).select(F.col("score").alias("f1"), F.length("category").cast("double").alias("f2"), "label")
    return M.fit_linear(rows, ["f1", "f2"])


@query("a56_diagnostics", f"""WITH {D.SCORED} SELECT 'score' AS feature, count(score) AS non_null, count(*) FILTER (score <> 0) AS non_zero, count(DISTINCT score) AS "distinct", round(var_samp(score), 4) AS variance, 'ok' AS status FROM scored
 UNION ALL SELECT 'label', count(label), count(*) FILTER (label <> 0), count(DISTINCT label), round(var_samp(label), 4), CASE WHEN count(DISTINCT label) <= 1 THEN 'constant' ELSE 'ok' END FROM scored""")
def _(spark, sf_dir):
    return M.diagnostics(D.scored(spark, sf_dir), ["score", "label"])


@query("a57_content_hash")
def _(spark, sf_dir):
    return M.content_hash(D.table(spark, sf_dir, "events"), "event_id", "user_id", "value")


@query("m5_score_report", f"""WITH {D.SCORED}, u AS (SELECT split, doc_id, label, unnest(['score', 'length']) AS name, unnest([score, CAST(length(category) AS DOUBLE)]) AS s FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY split, name ORDER BY s DESC, doc_id) AS r FROM u) SELECT split, name, round(avg(label) FILTER (r <= 10), 6) AS p_at_10 FROM r WHERE r <= 10 GROUP BY 1, 2""")
def _(spark, sf_dir):
    rows = D.scored(spark, sf_dir).withColumn("length", F.length("category").cast("double")).unpivot(["split", "doc_id", "label"], ["score", "length"], "name", "s")
    return M.precision_at(rows, (10,), "split", "name", score="s")


@query("p40_linear_score", f"WITH {D.SCORED} SELECT doc_id, round(1 / (1 + exp(-least(50, greatest(-50, 0.5 + 0.7 * (score - 0.4) / 0.2)))), 6) AS p, round(1 / (1 + exp(-least(50, greatest(-50, 0.7 * score)))), 6) AS serving FROM scored")
def _(spark, sf_dir):
    model = [{"feature": "score", "weight": 0.7, "mean": 0.4, "std": 0.2}]
    return D.scored(spark, sf_dir).select("doc_id", F.round(M.linear_score(model, 0.5), 6).alias("p"), F.round(M.linear_score(model, 0.5, False), 6).alias("serving"))


@query("a29_threshold_bunching", f"WITH {D.SCORED} SELECT split, round(avg(CASE WHEN abs(score - 0.25) <= 0.02 OR abs(score - 0.5) <= 0.02 OR abs(score - 0.8) <= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS share FROM scored GROUP BY 1")
def _(spark, sf_dir):
    near = F.exists(F.array(*map(F.lit, (0.25, 0.5, 0.8))), lambda t: F.abs(F.col("score") - t) <= 0.02)
    return D.scored(spark, sf_dir).groupBy("split").agg(F.round(F.avg(near.cast("double")), 6).alias("share"))


@query("a19_strongest_categories", f"WITH {D.SCORED} SELECT category, round(avg(label), 6) AS precision FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, sf_dir):
    return D.scored(spark, sf_dir).groupBy("category").agg(F.round(F.avg("label"), 6).alias("precision")).orderBy(F.desc("precision"), "category").limit(3)


_HOLDOUT = """e AS (SELECT event_id AS id, event_type AS category, strftime(ts, '%Y-%m-%d') AS block, 'fold' || (user_id % 5) AS fold, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS label,
 CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS useful, value > 40 AS delivered, CASE WHEN event_id % 7 <> 0 THEN round(value - 20, 2) END AS pnl FROM events),
x AS (SELECT 'time' AS regime, block AS key, * FROM e UNION ALL SELECT 'category', category, * FROM e UNION ALL SELECT 'family', fold, * FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY regime, key ORDER BY pnl, id) AS rn, count(pnl) OVER (PARTITION BY regime, key) AS k FROM x),
a AS (SELECT regime, key, count(*) AS n_alerts, count(label) AS labelled, count(useful) AS with_feedback, count(*) FILTER (delivered) AS delivered, coalesce(round(sum(label) / nullif(count(label), 0), 6), 0) AS label_precision,
 coalesce(round(count(*) FILTER (useful) / nullif(count(useful), 0), 6), 0) AS usefulness_precision, round(count(label) / count(*), 6) AS label_coverage FROM x GROUP BY 1, 2),
t AS (SELECT regime, key, count(*) AS n, count(pnl) AS filled, round(avg(pnl), 6) AS mean_pnl, round(median(pnl), 6) AS median_pnl, round(count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 6) AS hit_rate,
 round(avg(pnl) FILTER (pnl IS NOT NULL AND rn <= greatest(1, floor(k / 10))), 6) AS worst_tenth FROM r GROUP BY 1, 2)"""


def _long(family: str, table: str, names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{family}' AS family, regime, key, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {table}" for n in names.split())


@query("a16_holdout_metrics", f"WITH {_HOLDOUT} {_long('alerts', 'a', 'n_alerts labelled with_feedback delivered label_precision usefulness_precision label_coverage')} UNION ALL {_long('trades', 't', 'n filled mean_pnl median_pnl hit_rate worst_tenth')}")
def _(spark, sf_dir):
    e, when = D.table(spark, sf_dir, "events"), F.col("user_id") % 4
    rows = e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM-dd").alias("block"), F.concat(F.lit("fold"), F.col("user_id") % 5).alias("fold"),
        F.when(when == 0, 1).when(when == 1, 0).alias("label"), F.when(F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 0).alias("useful"),
        (F.col("value") > 40).alias("delivered"), F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") - 20, 2)).alias("pnl"))
    families = {"alerts": (rows, E.alert_metrics), "trades": (rows, E.trade_metrics)}
    return E.holdout_metrics(families, {"time": "block", "category": "category", "family": "fold"})


@query("a19_extreme_categories", f"""WITH {D.SCORED}, m AS (SELECT category, round(avg(score), 6) AS mean FROM scored GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, category) AS s, row_number() OVER (ORDER BY mean, category) AS w FROM m)
 SELECT category, mean, CAST(s AS INTEGER) AS place, 'strongest' AS "end" FROM r WHERE s <= 3 UNION ALL SELECT category, mean, CAST(w AS INTEGER), 'weakest' FROM r WHERE w <= 3""")
def _(spark, sf_dir):
    return E.extreme_categories(D.scored(spark, sf_dir), "category", "score")


@query("m5_auc_report", f"""WITH {D.SCORED}, u AS (SELECT split, label, unnest(['score', 'length']) AS name, unnest([score, CAST(length(category) AS DOUBLE)]) AS s FROM scored),
 k AS (SELECT split, name, label, (rank() OVER w + count(*) OVER (PARTITION BY split, name, s) / 2 - 0.5) AS r FROM u WINDOW w AS (PARTITION BY split, name ORDER BY s)),
 g AS (SELECT split, name, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n, sum(r) FILTER (label = 1) AS x FROM k WHERE label IS NOT NULL GROUP BY 1, 2)
 SELECT split, name, p AS positives, n AS negatives, CASE WHEN p * n > 0 THEN round((x - p * (p + 1) / 2) / (p * n), 6) END AS auc FROM g""")
def _(spark, sf_dir):
    long = D.scored(spark, sf_dir).select("split", "label", "score", F.length("category").cast("double").alias("length")).unpivot(["split", "label"], ["score", "length"], "name", "s")
    return M.auc(long, "split", "name", score="s")


@query("w4_window_pair", """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS market_id, ts, value FROM events)
 SELECT a.event_id, round(coalesce(sum(b.value) FILTER (b.ts >= a.ts - INTERVAL 1 HOUR), 0), 6) AS trailing, round(coalesce(sum(b.value) FILTER (b.ts < a.ts - INTERVAL 1 HOUR), 0), 6) AS preceding
 FROM e a JOIN e b ON a.market_id = b.market_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 HOUR GROUP BY 1""")
def _(spark, sf_dir):
    return J.window_pair(D.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("market_id"), F.col("ts").cast("timestamp").alias("ts"), "value"), "market_id", "value", 3600).select("event_id", "trailing", "preceding")


@query("m4_boosted_report")
def _(spark, sf_dir):
    """Boosted trees against the linear ranker: quality of documents from plain statistics, fitted on two thirds of them."""
    from ..operators import boosted

    text = F.col("text")
    words = F.split(F.trim(text), r"\s+")
    rows = D.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(D.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select(
        "doc_id", "label", F.length(text).alias("n_chars"), F.size(words).alias("n_words"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
        (F.length(F.regexp_replace(text, "[^#*$%&|<>]", "")) / F.length(text)).alias("symbol_share"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "test").otherwise("train").alias("split"))
    return boosted.compared(rows, ["n_chars", "n_words", "distinct_share", "symbol_share"], "split", "train")
