"""Queries of the detector, joins over time, and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Alerts, Detector, Graph
from ..functions import scalars as S
from ..operators import alerts as A
from ..operators import detector as X
from ..operators import graph as G
from ..operators import joins as J
from ..sources import driver as D
from .catalog import query

#: The events table spans thirty days, so the windows here are days instead of minutes.
DAYS = Detector(window_s=86400, history_s=172800, cooldown_s=3 * 86400, fresh_wallets=1, fresh_share=0.25, imbalance=0.5, concentration=0.5, velocity=1e-5, acceleration=1e-5, volume_acceleration=1.0, min_notional=10.0)

_FEATURES = f"""{D.STREAM}, s AS (SELECT *, first_value(ts) OVER (PARTITION BY wallet ORDER BY seq) AS first_seen FROM stream),
pairs AS (SELECT i.seq, i.market_id, i.ts, p.seq AS pseq, p.ts AS pts, p.wallet, p.side, p.outcome_side, p.notional, p.price, p.first_seen, p.ts >= i.ts - INTERVAL 1 DAY AS cur
 FROM s i JOIN s p ON p.market_id = i.market_id AND p.seq <= i.seq AND p.ts >= i.ts - INTERVAL 2 DAY),
byw AS (SELECT seq, max(x) AS biggest FROM (SELECT seq, wallet, round(sum(notional), 9) AS x FROM pairs WHERE cur GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT seq, market_id, any_value(ts) AS ts, count(*) AS n_trades, round(sum(notional), 9) AS total, count(DISTINCT wallet) AS n_wallets, count(price) AS n_prices, min(pts) AS episode_start, max(pts) AS episode_end,
 count(DISTINCT wallet) FILTER (first_seen >= ts - INTERVAL 1 DAY) AS fresh_count, round(coalesce(sum(notional) FILTER (first_seen >= ts - INTERVAL 1 DAY), 0), 9) AS fresh,
 round(coalesce(sum(notional) FILTER (side = 'BUY'), 0), 9) AS buy, round(coalesce(sum(notional) FILTER (side = 'SELL'), 0), 9) AS sell,
 arg_max(price, (pts, pseq)) - arg_min(price, (pts, pseq)) AS dp, (epoch_us(max(pts)) - epoch_us(min(pts))) / 60e6 AS mins, arg_min(outcome_side, pseq) AS first_side,
 round(coalesce(sum(notional) FILTER (outcome_side = 'YES'), 0), 9) AS yes, round(coalesce(sum(notional) FILTER (outcome_side = 'NO'), 0), 9) AS no FROM pairs WHERE cur GROUP BY 1, 2),
q AS (SELECT seq, round(sum(notional), 9) AS prev, arg_max(price, (pts, pseq)) - arg_min(price, (pts, pseq)) AS dp, (epoch_us(max(pts)) - epoch_us(min(pts))) / 60e6 AS mins FROM pairs WHERE NOT cur GROUP BY 1),
raw AS (SELECT c.seq, market_id, ts, CAST(n_trades AS INTEGER) AS n_trades, CAST(n_wallets AS INTEGER) AS n_wallets, CAST(n_prices AS INTEGER) AS n_prices, episode_start, episode_end, total AS notional, coalesce(prev, 0) AS previous_notional,
 buy AS buy_notional, sell AS sell_notional, yes AS yes_notional, no AS no_notional, greatest(yes, no) AS active_notional, CAST(fresh_count AS INTEGER) AS fresh_count, fresh / total AS fresh_share, abs(buy - sell) / total AS imbalance,
 biggest / total AS concentration, CASE WHEN c.mins <> 0 THEN c.dp / c.mins ELSE 0 END AS velocity,
 CASE WHEN c.mins <> 0 THEN c.dp / c.mins ELSE 0 END - coalesce(CASE WHEN q.mins <> 0 THEN q.dp / q.mins ELSE 0 END, 0) AS acceleration,
 CASE WHEN prev > 0 THEN total / prev ELSE 2 END AS volume_acceleration, CASE WHEN yes > no THEN 'YES' WHEN no > yes THEN 'NO' ELSE first_side END AS active_side
 FROM c LEFT JOIN q USING (seq) LEFT JOIN byw USING (seq) WHERE total >= 10),
f AS (SELECT seq, market_id, ts, n_trades, n_wallets, n_prices, episode_start, episode_end, fresh_count, active_side, {", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in X.FEATURES if X.FEATURES[n] == "double")} FROM raw)"""


@query("a1_window_features", f"WITH {_FEATURES} SELECT * FROM f")
def _(spark, sf_dir):
    return X.features(D.stream(spark, sf_dir), DAYS)


_RULES = f"""{_FEATURES}, sev AS (SELECT *, (SELECT round(r.fresh_count / 1.0 + r.fresh_share / 0.25 + r.imbalance / 0.5 + r.concentration / 0.5 + abs(r.velocity) / 1e-4 + abs(r.acceleration) / 1e-4 + r.volume_acceleration / 1.0, 6) FROM raw r WHERE r.seq = f.seq) AS severity,
 list_filter([CASE WHEN fresh_count >= 1 AND fresh_share >= 0.25 AND abs(velocity) >= 1e-5 THEN 'fresh_wallet_burst' END, CASE WHEN concentration >= 0.5 AND imbalance >= 0.5 THEN 'concentrated_directional_flow' END,
 CASE WHEN abs(velocity) >= 1e-5 AND abs(acceleration) >= 1e-5 AND volume_acceleration >= 1.0 AND (fresh_count > 0 OR concentration >= 0.5) THEN 'fast_repricing_with_wallet_support' END], lambda x: x IS NOT NULL) AS rules FROM f)"""


@query("st9_rules", f"WITH {_RULES} SELECT seq, market_id, severity, array_to_string(rules, ',') AS rules FROM sev WHERE len(rules) > 0")
def _(spark, sf_dir):
    return X.candidates(D.stream(spark, sf_dir), DAYS).select("seq", "market_id", "severity", F.array_join("rules", ",").alias("rules"))


@query("a20_rule_counts", f"WITH {_RULES} SELECT rule, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM sev) GROUP BY 1")
def _(spark, sf_dir):
    from ..operators.evaluation import rule_counts

    return rule_counts(X.candidates(D.stream(spark, sf_dir), DAYS))


_PROBABILITIES = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS market_id, p_retailprice / 2000.0 AS yes_probability FROM part)"


@query("st10_probability_filter", f"WITH {_RULES}, {_PROBABILITIES} SELECT seq, market_id, severity FROM sev LEFT JOIN p USING (market_id) WHERE len(rules) > 0 AND coalesce(yes_probability BETWEEN 0.5 AND 0.55, true)")
def _(spark, sf_dir):
    from dataclasses import replace

    known = D.markets(spark, sf_dir).select("market_id", (F.col("liquidity") / 2000.0).alias("yes_probability"))
    return X.candidates(D.stream(spark, sf_dir), replace(DAYS, band_low=0.5, band_high=0.55), known).select("seq", "market_id", "severity")


@query("w14_cooldown")
def _(spark, sf_dir):
    return X.cooled(X.candidates(D.stream(spark, sf_dir), DAYS), DAYS).select("seq", "market_id", "severity", "emitted")


@query("sk6_melted_features", f"WITH {_FEATURES} SELECT seq, n AS feature_name, v AS feature_value FROM (SELECT seq, unnest(['fresh_share', 'imbalance']) AS n, unnest([fresh_share, imbalance]) AS v FROM f)")
def _(spark, sf_dir):
    return X.melted(X.features(D.stream(spark, sf_dir), DAYS), ("fresh_share", "imbalance"))


@query("u2_signature_difference", f"""WITH {_RULES}, a AS (SELECT DISTINCT market_id, ts, array_to_string(list_sort(rules), ',') AS rules FROM sev WHERE len(rules) > 0), b AS (SELECT DISTINCT market_id, ts, array_to_string(list_sort(rules), ',') AS rules FROM sev WHERE len(rules) > 0 AND seq % 3 <> 0)
 SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(spark, sf_dir):
    from ..operators.evaluation import signature_differences

    found = X.candidates(D.stream(spark, sf_dir), DAYS)
    return signature_differences(found, found.where("seq % 3 <> 0"))


# Joins over time: alerts are signups, evidence views, quotes clicks, resolutions errors.
_ALERTS, _EVIDENCE, _QUOTES, _RESOLUTIONS, _CANDIDATES = (D.kind_sql(n, k) for n, k in (("alerts", "signup"), ("evidence", "view"), ("quotes", "click"), ("resolutions", "error"), ("candidates", "purchase")))


@query("j3_as_of_backward", f"""WITH {_ALERTS}, {_EVIDENCE} SELECT a.id, arg_max(e.id, (e.ts, e.id)) AS evidence_id, arg_max(e.value, (e.ts, e.id)) AS evidence_value FROM alerts a LEFT JOIN evidence e ON a.market_id = e.market_id AND e.ts <= a.ts GROUP BY 1""")
def _(spark, sf_dir):
    out = J.as_of(D.kind(spark, sf_dir, "signup"), D.kind(spark, sf_dir, "view"), "market_id", "e", tie="id")
    return out.select("id", F.col("e.id").alias("evidence_id"), F.col("e.value").alias("evidence_value"))


@query("j6_as_of_forward", f"""WITH {_ALERTS}, {_QUOTES} SELECT a.id, arg_min(q.id, (q.ts, q.id)) AS quote_id FROM alerts a LEFT JOIN quotes q ON a.market_id = q.market_id AND q.ts >= a.ts AND q.ts <= a.ts + INTERVAL 12 HOUR GROUP BY 1""")
def _(spark, sf_dir):
    out = J.as_of(D.kind(spark, sf_dir, "signup"), D.kind(spark, sf_dir, "click"), "market_id", "q", forward=True, within_s=12 * 3600, tie="id")
    return out.select("id", F.col("q.id").alias("quote_id"))


@query("p37_liquidity", f"""WITH {_ALERTS}, {_QUOTES}, n AS (SELECT a.id, arg_min(q.value, (q.ts, q.id)) / 1000.0 AS spread FROM alerts a LEFT JOIN quotes q ON a.market_id = q.market_id AND q.ts >= a.ts AND q.ts <= a.ts + INTERVAL 12 HOUR GROUP BY 1)
 SELECT id, CASE WHEN spread IS NULL OR spread < 0 THEN 'unknown' WHEN spread <= 0.02 THEN 'tight' WHEN spread <= 0.05 THEN 'mid' ELSE 'wide' END AS bucket FROM n""")
def _(spark, sf_dir):
    out = J.as_of(D.kind(spark, sf_dir, "signup"), D.kind(spark, sf_dir, "click"), "market_id", "q", forward=True, within_s=12 * 3600, tie="id")
    return out.select("id", S.liquidity(F.col("q.value") / 1000.0).alias("bucket"))


@query("j5_range_join", f"""WITH {_ALERTS}, {_QUOTES} SELECT a.id, q.id AS quote_id FROM alerts a JOIN quotes q ON a.market_id = q.market_id AND q.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY""")
def _(spark, sf_dir):
    a = D.kind(spark, sf_dir, "signup").select("id", "market_id", F.col("ts").alias("t0"), (F.col("ts") + F.expr("interval 1 day")).alias("t1"))
    return J.in_range(a, D.kind(spark, sf_dir, "click").select(F.col("id").alias("quote_id"), "market_id", "ts"), "market_id", "t0", "t1", 86400).select("id", "quote_id")


@query("j17_interval_containment", f"""WITH {_ALERTS}, {_QUOTES} SELECT a.id, count(DISTINCT q.wallet) AS wallets, count(q.id) AS n FROM alerts a JOIN quotes q ON a.market_id = q.market_id AND q.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts GROUP BY 1""")
def _(spark, sf_dir):
    met = J.met_counts(D.kind(spark, sf_dir, "signup").select("id", "market_id", "ts"), D.kind(spark, sf_dir, "click").select("market_id", "ts", "wallet"), "market_id", "wallet", 86400)
    return met.select("id", F.col("distinct").alias("wallets"), "n")


@query("j4_latest_per_key", f"WITH {_RESOLUTIONS} SELECT market_id, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM resolutions GROUP BY 1")
def _(spark, sf_dir):
    return J.latest(D.kind(spark, sf_dir, "error"), ["market_id"], "ts", "id").select("market_id", "id", "ts")


@query("j1_star_left_join", f"""WITH {_CANDIDATES}, {_ALERTS}, {D.MARKETS} SELECT c.id, m.event_id, m.category, a.id AS alert_id FROM candidates c LEFT JOIN markets m ON m.market_id = c.market_id LEFT JOIN alerts a ON a.market_id = c.market_id AND a.wallet = c.wallet
 WHERE c.ts >= TIMESTAMP '2024-01-05' AND c.ts < TIMESTAMP '2024-01-20'""")
def _(spark, sf_dir):
    c = D.kind(spark, sf_dir, "purchase").where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'").select("id", "market_id", "wallet")
    a = D.kind(spark, sf_dir, "signup").select(F.col("id").alias("alert_id"), "market_id", "wallet")
    return c.join(D.markets(spark, sf_dir).select("market_id", "event_id", "category"), "market_id", "left").join(a, ["market_id", "wallet"], "left").select("id", "event_id", "category", "alert_id")


@query("j2_markets_events", f"WITH {D.MARKETS} SELECT market_id, event_id, n_name FROM markets JOIN nation ON CAST(replace(event_id, 'Brand#', '') AS INTEGER) = n_nationkey WHERE NOT closed AND condition_id IS NOT NULL")
def _(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation")
    m = D.markets(spark, sf_dir).where("not closed and condition_id is not null")
    return m.join(n, F.replace("event_id", F.lit("Brand#"), F.lit("")).cast("int") == F.col("n_nationkey")).select("market_id", "event_id", "n_name")


@query("j9_candidates_without_alerts", f"WITH {_CANDIDATES}, {_ALERTS} SELECT id, market_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.market_id = c.market_id AND a.wallet = c.wallet)")
def _(spark, sf_dir):
    return D.kind(spark, sf_dir, "purchase").join(D.kind(spark, sf_dir, "signup").select("market_id", "wallet"), ["market_id", "wallet"], "left_anti").select("id", "market_id")


@query("j11_semi_join", f"WITH {D.TRADES}, {D.MARKETS} SELECT trade_id, market_id FROM trades WHERE market_id IN (SELECT market_id FROM markets WHERE closed)")
def _(spark, sf_dir):
    return D.trades(spark, sf_dir).join(D.markets(spark, sf_dir).where("closed"), "market_id", "left_semi").select("trade_id", "market_id")


@query("j12_nested_semi", f"WITH {_CANDIDATES}, {_ALERTS}, {_EVIDENCE} SELECT id FROM candidates WHERE (market_id, wallet) IN (SELECT (market_id, wallet) FROM alerts WHERE market_id IN (SELECT market_id FROM evidence WHERE value > 50))")
def _(spark, sf_dir):
    a = D.kind(spark, sf_dir, "signup").join(D.kind(spark, sf_dir, "view").where("value > 50"), "market_id", "left_semi")
    return D.kind(spark, sf_dir, "purchase").join(a, ["market_id", "wallet"], "left_semi").select("id")


@query("j13_lookup_aggregates", f"WITH {_CANDIDATES}, {_ALERTS}, n AS (SELECT market_id, count(*) AS alerts, max(value) AS top FROM alerts GROUP BY 1) SELECT id, coalesce(alerts, 0) AS alerts, top FROM candidates LEFT JOIN n USING (market_id)")
def _(spark, sf_dir):
    n = D.kind(spark, sf_dir, "signup").groupBy("market_id").agg(F.count("*").alias("alerts"), F.max("value").alias("top"))
    return D.kind(spark, sf_dir, "purchase").join(n, "market_id", "left").select("id", F.coalesce("alerts", F.lit(0)).alias("alerts"), "top")


@query("j15_or_range", f"WITH {_CANDIDATES}, {_ALERTS} SELECT DISTINCT c.id FROM candidates c LEFT JOIN alerts a ON a.market_id = c.market_id AND a.wallet = c.wallet WHERE c.ts >= TIMESTAMP '2024-01-25' OR a.ts >= TIMESTAMP '2024-01-25'")
def _(spark, sf_dir):
    a = D.kind(spark, sf_dir, "signup").select("market_id", "wallet", F.col("ts").alias("alert_ts"))
    return D.kind(spark, sf_dir, "purchase").join(a, ["market_id", "wallet"], "left").where("ts >= timestamp '2024-01-25' or alert_ts >= timestamp '2024-01-25'").select("id").distinct()


@query("j26_cache_lookup", f"""WITH {_ALERTS}, {_EVIDENCE} SELECT a.id, arg_max(e.id, (e.ts, e.id)) AS cached FROM alerts a LEFT JOIN evidence e ON a.wallet = e.wallet AND e.ts <= a.ts AND e.ts >= a.ts - INTERVAL 1 DAY GROUP BY 1""")
def _(spark, sf_dir):
    out = J.as_of(D.kind(spark, sf_dir, "signup"), D.kind(spark, sf_dir, "view"), "wallet", "e", within_s=86400, tie="id")
    return out.select("id", F.col("e.id").alias("cached"))


_RANKED = f"""{_ALERTS}, {D.MARKETS}, k AS (SELECT a.id, a.ts, CASE WHEN event_id IS NOT NULL THEN 'event:' || event_id ELSE 'market:' || a.market_id END AS suppression_key,
 CASE WHEN value > 80 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS rank, value, a.market_id, event_id FROM alerts a LEFT JOIN markets m ON m.market_id = a.market_id)"""


def _ranked(spark, sf_dir):  # noqa: ANN001, ANN202
    a = D.kind(spark, sf_dir, "signup").join(D.markets(spark, sf_dir).select("market_id", "event_id"), "market_id", "left")
    key = S.suppression_key(F.lit(None).cast("string"), F.col("event_id"), F.lit(None).cast("string"), F.col("market_id"), F.lit(None).cast("string"))
    return a.select("id", "ts", key.alias("suppression_key"), F.when(F.col("value") > 80, 2).when(F.col("value") > 50, 1).otherwise(0).alias("rank"), "value", "market_id", "event_id")


@query("w15_suppression", f"""WITH {_RANKED} SELECT id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) <= CASE WHEN suppression_key LIKE 'event:%' THEN 86400000000 ELSE 43200000000 END AND rank <= lag(rank) OVER w, false) AS suppressed
 FROM k WINDOW w AS (PARTITION BY suppression_key ORDER BY ts, id)""")
def _(spark, sf_dir):
    return A.suppressed(_ranked(spark, sf_dir), Alerts(event_window_s=86400, market_window_s=43200)).select("id", "suppressed")


@query("t3_movement_top", f"""WITH {_RANKED}, r AS (SELECT id, suppression_key, row_number() OVER (PARTITION BY suppression_key ORDER BY value / 100 DESC, rank DESC, id) AS r, count(*) OVER (PARTITION BY suppression_key) AS n FROM k) SELECT id, suppression_key FROM r WHERE n <= 5 OR r <= 7""")
def _(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("movement", S.movement(F.col("value") / 100, F.lit(0.0))).withColumn("severity", F.col("rank"))
    return A.movers(rows, "suppression_key").select("id", "suppression_key")


@query("w16_delivery_budget")
def _(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select("id", "ts", F.lit("chat").alias("channel"), (F.col("rank") >= 1).alias("eligible"))
    return A.delivered(rows, 600).select("id", "delivered")


@query("w19_lifecycle")
def _(spark, sf_dir):
    rows = A.suppressed(_ranked(spark, sf_dir))
    sent = A.delivered(rows.select("id", "ts", F.lit("chat").alias("channel"), (~F.col("suppressed") & (F.col("rank") >= 1)).alias("eligible")), 600).select("id", "delivered")
    own = Window.partitionBy("market_id").orderBy("ts", "id")
    rows = rows.withColumn("reason", F.when(F.col("value") > 60, "jump").when(F.col("value") > 10, "drift"))
    rows = rows.withColumns({"existing_rank": F.lag("rank").over(own), "existing_reason": F.lag("reason").over(own)}).join(sent, "id")
    rows = rows.select("id", (F.col("value") > 1).alias("domain_ok"), S.in_probability_band(F.col("value") / 100).alias("probability_ok"), "existing_rank", "rank", "reason", "existing_reason", "suppressed", "delivered")
    return A.lifecycle(rows).select("id", "status")


@query("w20_call_gating", f"""WITH {_ALERTS}, c AS (SELECT *, CAST(substr(wallet, 2) AS BIGINT) % 3 = 0 AS cached, 'p' || (id % 2) AS provider FROM alerts), d AS (SELECT *, row_number() OVER (PARTITION BY provider, date_trunc('day', ts) ORDER BY ts, id) AS d FROM c WHERE NOT cached),
 m AS (SELECT id, row_number() OVER (PARTITION BY provider, date_trunc('month', ts) ORDER BY ts, id) AS m FROM d WHERE d <= 5) SELECT c.id, coalesce(m.m <= 60, false) AS called FROM c LEFT JOIN m USING (id)""")
def _(spark, sf_dir):
    rows = D.kind(spark, sf_dir, "signup").select("id", "ts", F.concat(F.lit("p"), F.col("id") % 2).alias("provider"), (F.substring("wallet", 2, 20).cast("long") % 3 == 0).alias("cached"))
    return A.gated(rows, 5, 60).select("id", "called")


_EDGES = f"""{_CANDIDATES}, {_QUOTES}, {D.MARKETS}, d AS (SELECT c.id, c.market_id, c.ts, m.event_id FROM candidates c LEFT JOIN markets m USING (market_id)), e AS (SELECT q.wallet, q.market_id, q.ts, q.value AS notional, m.event_id FROM quotes q LEFT JOIN markets m USING (market_id))"""


@query("g1_graph_features", f"""WITH {_EDGES}, w AS (SELECT DISTINCT d.id, d.market_id AS home, d.ts AS decided, d.event_id AS he, e.wallet FROM d JOIN e ON e.market_id = d.market_id AND e.ts BETWEEN d.ts - INTERVAL 2 DAY AND d.ts),
 h AS (SELECT w.*, e.market_id, e.event_id, CAST(e.ts AS DATE) AS day FROM w JOIN e ON e.wallet = w.wallet AND e.ts BETWEEN w.decided - INTERVAL 2 DAY AND w.decided),
 bw AS (SELECT id, wallet, count(DISTINCT market_id) AS m, count(DISTINCT event_id) AS ev, count(DISTINCT day) AS days, bool_or(coalesce(market_id <> home AND event_id = he, false)) AS same FROM h GROUP BY 1, 2),
 ws AS (SELECT id, count(*) AS deg, round(avg(CAST(m > 1 AS INTEGER)), 6) AS rep, round(avg(CAST(ev > 1 AS INTEGER)), 6) AS crs, round(avg(CAST(same AS INTEGER)), 6) AS same, round(avg(days), 6) AS pers, round(avg(CAST(days >= 2 AS INTEGER)), 6) AS pshare FROM bw GROUP BY 1),
 n AS (SELECT DISTINCT id, home, he, decided, market_id, event_id FROM h), ms AS (SELECT id, count(DISTINCT market_id) AS c, round(count(DISTINCT market_id) FILTER (event_id = he) / count(DISTINCT market_id), 6) AS ses FROM n GROUP BY 1),
 p AS (SELECT n.id, n.home, n.market_id, e.wallet, sum(greatest(0, e.notional)) AS notional FROM n JOIN e ON e.market_id = n.market_id AND e.ts BETWEEN n.decided - INTERVAL 2 DAY AND n.decided GROUP BY 1, 2, 3, 4),
 ar AS (SELECT id, count(DISTINCT wallet) AS cw, count(*) AS pairs, round(CAST(sum(CASE WHEN market_id = home THEN notional ELSE 0 END) AS DOUBLE) / CAST(sum(notional) AS DOUBLE), 6) AS ns FROM p GROUP BY 1)
 SELECT d.id, coalesce(deg, 0) AS market_wallet_degree, greatest(0, coalesce(c, 0) - 1) AS related_market_count, coalesce(cw, 0) AS cluster_wallet_count, coalesce(round(pairs / (cw * c), 6), 0) AS cluster_density_2hop, coalesce(ses, 0) AS same_event_market_share,
 coalesce(rep, 0) AS repeat_wallet_share, coalesce(crs, 0) AS cross_event_wallet_share, coalesce(same, 0) AS same_event_repeat_wallet_share, coalesce(pers, 0) AS wallet_persistence_mean_days, coalesce(pshare, 0) AS persistent_wallet_share, coalesce(ns, 0) AS cluster_notional_share
 FROM d LEFT JOIN ws USING (id) LEFT JOIN ms USING (id) LEFT JOIN ar USING (id)""")
def _(spark, sf_dir):
    m = D.markets(spark, sf_dir).select("market_id", "event_id")
    d = D.kind(spark, sf_dir, "purchase").join(m, "market_id", "left").select("id", "market_id", "event_id", "ts")
    e = D.kind(spark, sf_dir, "click").join(m, "market_id", "left").select("wallet", "market_id", "event_id", "ts", F.col("value").alias("notional"))
    return G.features(d, e, Graph(lookback_days=2))
