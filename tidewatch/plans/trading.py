"""Queries over trades, wallets and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trades as T
from ..operators import wallets as W
from ..sources import driver as D
from .catalog import query

_KEY = """coalesce(lower(nullif(trim(tx_hash), '')), coalesce(condition_id, '') || '|' || coalesce(asset_id, '') || '|' || coalesce(side, '') || '|' ||
 printf('%.12f', price) || '|' || printf('%.12f', size) || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S'))"""
KEYED = f"{D.TRADES}, keyed AS (SELECT *, {_KEY} AS dedupe_key FROM trades)"
CANONICAL = f"""{KEYED}, canonical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(dedupe_key, ''), trade_id) ORDER BY priority DESC, ts DESC, trade_id DESC) AS rn FROM keyed) WHERE rn = 1)"""
#: Amounts in the tables have two decimals, so that a rounded sum of doubles is an independent way to the exact sum.
_SUM = "round(sum({}), 2)"
LOW = "lower(nullif(trim(wallet), ''))"
ACTIVITY = f"""activity AS (SELECT {LOW} AS w, count(*) AS n_trades, count(*) FILTER (side = 'BUY') AS n_buy, count(*) FILTER (side = 'SELL') AS n_sell, {_SUM.format('notional')} AS notional,
 coalesce({_SUM.format("CASE WHEN ts >= now_ts - INTERVAL 1 DAY THEN notional END")}, 0) AS notional_1d, coalesce({_SUM.format("CASE WHEN ts >= now_ts - INTERVAL 7 DAY THEN notional END")}, 0) AS notional_7d,
 count(DISTINCT market_id) AS n_markets, count(DISTINCT condition_id) AS n_conditions, count(DISTINCT source) AS n_sources, min(ts) AS first_ts, max(ts) AS last_ts,
 min({{'a': ts, 'b': trade_id, 'c': market_id}})['c'] AS first_market
 FROM canonical, (SELECT max(ts) AS now_ts FROM canonical) WHERE {LOW} IS NOT NULL GROUP BY 1)"""
_SIGNED = "CASE WHEN side = 'SELL' THEN -{0} ELSE {0} END"
POSITIONS = f"""positions AS (SELECT {LOW} AS w, market_id, outcome_side, {_SUM.format(_SIGNED.format('size'))} AS net_size, {_SUM.format(_SIGNED.format('notional'))} AS net_notional,
 CAST(sum(CAST(price AS DECIMAL(24,14))) FILTER (side IS DISTINCT FROM 'SELL') AS DOUBLE) / count(*) FILTER (side IS DISTINCT FROM 'SELL') AS avg_buy, CAST(sum(CAST(price AS DECIMAL(24,14))) FILTER (side = 'SELL') AS DOUBLE) / count(*) FILTER (side = 'SELL') AS avg_sell,
 min(CASE WHEN price > 0 THEN price END) AS low, max(CASE WHEN price > 0 THEN price END) AS high, count(*) AS n_trades
 FROM canonical WHERE {LOW} IS NOT NULL GROUP BY 1, 2, 3 HAVING abs({_SUM.format(_SIGNED.format('size'))}) > 1e-9)"""
_MEMBERS = f"""members AS (SELECT condition_id, {LOW} AS wallet, count(*) AS n_trades, {_SUM.format('notional')} AS notional FROM canonical WHERE {LOW} IS NOT NULL AND trim(condition_id) <> '' GROUP BY 1, 2),
whole AS (SELECT condition_id, count(*) AS n_wallets, {_SUM.format('notional')} AS total FROM members GROUP BY 1 HAVING count(*) >= 3),
clusters AS (SELECT substr(sha1(condition_id), 1, 12) AS cluster_id, condition_id, wallet, n_trades, n_wallets, notional,
 round(least(1.0, 0.5 + least(0.4, CASE WHEN total <> 0 THEN notional / total ELSE 0 END * 0.4) + CASE WHEN n_trades > 1 THEN 0.1 ELSE 0.0 END), 6) AS confidence FROM members JOIN whole USING (condition_id))"""


def canonical(spark, sf_dir, *keep):  # noqa: ANN001, ANN201
    return T.canonical(T.keyed(D.trades(spark, sf_dir)), *keep)


@query("p18_dedupe_key", f"WITH {KEYED} SELECT trade_id, dedupe_key FROM keyed")
def _(spark, sf_dir):
    return T.keyed(D.trades(spark, sf_dir)).select("trade_id", "dedupe_key")


@query("w1_canonical_dedupe", f"WITH {CANONICAL} SELECT trade_id, dedupe_key, priority, source, notional FROM canonical")
def _(spark, sf_dir):
    return canonical(spark, sf_dir).select("trade_id", "dedupe_key", "priority", "source", "notional")


@query("a2_wallet_activity", f"WITH {CANONICAL}, {ACTIVITY} SELECT w AS wallet, * EXCLUDE (w) FROM activity")
def _(spark, sf_dir):
    return W.activity(canonical(spark, sf_dir))


@query("a2_wallet_favourites", f"""WITH {CANONICAL}, c AS (SELECT {LOW} AS wallet, market_id, count(*) AS n FROM canonical WHERE {LOW} IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY n DESC, market_id) AS r FROM c)
 SELECT wallet, max(market_id) FILTER (r = 1) AS favourite, string_agg(market_id, ',' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY 1""")
def _(spark, sf_dir):
    return W.favourites(canonical(spark, sf_dir))


@query("a4_net_positions", f"WITH {CANONICAL}, {POSITIONS} SELECT w AS wallet, * EXCLUDE (w) FROM positions")
def _(spark, sf_dir):
    return W.positions(canonical(spark, sf_dir))


@query("a5_position_summary", f"""WITH {CANONICAL}, {POSITIONS} SELECT w AS wallet, count(*) AS n_positions, count(*) FILTER (net_size > 0) AS n_long, {_SUM.format('abs(net_notional)')} AS gross, max(abs(net_notional)) AS largest FROM positions GROUP BY 1""")
def _(spark, sf_dir):
    return W.position_summary(W.positions(canonical(spark, sf_dir)))


@query("w7_top_positions", f"""WITH {CANONICAL}, {POSITIONS} SELECT wallet, market_id, outcome_side, net_notional, rank FROM (SELECT w AS wallet, market_id, outcome_side, net_notional, CAST(row_number() OVER (PARTITION BY w ORDER BY abs(net_notional) DESC, market_id, outcome_side) AS INTEGER) AS rank FROM positions) WHERE rank <= 3""")
def _(spark, sf_dir):
    return W.top_positions(W.positions(canonical(spark, sf_dir)))


@query("a7_condition_clusters", f"WITH {CANONICAL}, {_MEMBERS} SELECT * FROM clusters")
def _(spark, sf_dir):
    return W.clusters(canonical(spark, sf_dir))


@query("a6_cluster_lists", f"WITH {CANONICAL}, {_MEMBERS} SELECT wallet, count(*) AS n_clusters, max(confidence) AS confidence, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters FROM clusters GROUP BY 1")
def _(spark, sf_dir):
    return W.cluster_lists(W.clusters(canonical(spark, sf_dir)))


@query("j22_wallet_profiles", f"""WITH {CANONICAL}, {ACTIVITY}, {POSITIONS}, {_MEMBERS},
 ps AS (SELECT w, count(*) AS n_positions, {_SUM.format('abs(net_notional)')} AS gross FROM positions GROUP BY 1), cl AS (SELECT wallet AS w, count(*) AS n_clusters FROM clusters GROUP BY 1)
 SELECT w AS wallet, n_trades, notional, coalesce(n_positions, 0) AS n_positions, coalesce(gross, 0) AS gross, coalesce(n_clusters, 0) AS n_clusters FROM activity LEFT JOIN ps USING (w) LEFT JOIN cl USING (w)""")
def _(spark, sf_dir):
    t = canonical(spark, sf_dir)
    return W.profiles(W.activity(t), W.position_summary(W.positions(t)), W.cluster_lists(W.clusters(t)))


@query("a8_first_seen", f"WITH {D.TRADES} SELECT {LOW} AS wallet, min(ts) AS first_seen, count(*) AS n FROM trades WHERE {LOW} IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    t = D.trades(spark, sf_dir).withColumn("wallet", F.lower("wallet")).where("trim(wallet) <> ''")
    return t.groupBy("wallet").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))


@query("a9_fresh_wallets", f"""WITH {D.TRADES}, s AS (SELECT {LOW} AS wallet, min(ts) AS first_seen, count(*) AS k FROM trades WHERE {LOW} IS NOT NULL GROUP BY 1)
 SELECT trade_id, {LOW} AS wallet, coalesce(floor((epoch_us(ts) - epoch_us(first_seen)) / 86400000000.0) <= 30 AND k <= 3, false) AS fresh,
 CASE WHEN {LOW} IS NULL THEN 'low' WHEN k > 3 THEN 'full' ELSE 'limited' END AS confidence FROM trades LEFT JOIN s ON s.wallet = {LOW.replace('wallet', 'trades.wallet')}""".replace(f"SELECT trade_id, {LOW}", f"SELECT trade_id, {LOW.replace('wallet', 'trades.wallet')}").replace(f"CASE WHEN {LOW} IS NULL", f"CASE WHEN {LOW.replace('wallet', 'trades.wallet')} IS NULL"))
def _(spark, sf_dir):
    return W.freshness(D.trades(spark, sf_dir))


@query("t1_top_wallets", f"WITH {CANONICAL}, {ACTIVITY} SELECT w AS wallet, n_trades, notional FROM activity ORDER BY notional DESC, w LIMIT 10")
def _(spark, sf_dir):
    return W.top(W.activity(canonical(spark, sf_dir)).select("wallet", "n_trades", "notional"), "notional", 10, "wallet")


@query("t2_top_positions", f"WITH {CANONICAL}, {POSITIONS} SELECT w AS wallet, market_id, outcome_side, net_notional FROM positions ORDER BY abs(net_notional) DESC, w, market_id, outcome_side LIMIT 10")
def _(spark, sf_dir):
    return W.top(W.positions(canonical(spark, sf_dir)).select("wallet", "market_id", "outcome_side", "net_notional"), "net_notional", 10, "wallet", "market_id", "outcome_side")


@query("w2_sessions", f"""WITH {D.TRADES}, f AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 20 DAY THEN 1 ELSE 0 END AS fresh FROM trades WHERE trim(market_id) <> '' AND trim(condition_id) <> '' WINDOW w AS (PARTITION BY market_id, condition_id ORDER BY ts, trade_id)),
 n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY market_id, condition_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS episode FROM f)
 SELECT market_id, condition_id, episode, min(ts) AS started, max(ts) AS ended, count(*) AS n_trades, count(DISTINCT wallet) AS n_wallets, {_SUM.format('notional')} AS notional FROM n GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return T.sessions(D.trades(spark, sf_dir), "20 days")


@query("sk4_priority_upsert", """WITH a AS (SELECT l_orderkey AS trade_id, (CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 100000 + l_suppkey AS seq, CAST(l_suppkey % 3 + 1 AS INTEGER) AS priority, l_quantity AS size, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS notional FROM lineitem),
 t AS (SELECT *, max(priority) OVER (PARTITION BY trade_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a), k AS (SELECT * FROM t WHERE top IS NULL OR priority >= top)
 SELECT CAST(trade_id AS VARCHAR) AS trade_id, arg_max(priority, seq) AS priority, arg_max(size, seq) AS size, arg_max(notional, seq) FILTER (notional IS NOT NULL) AS notional FROM k GROUP BY trade_id""")
def _(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("trade_id"), ((F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("seq"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("priority"), F.col("l_quantity").alias("size"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("notional"))
    return T.upserted(rows, "seq", ("size",), ("notional",))


@query("sk5_first_seen", f"WITH {D.STREAM} SELECT wallet, arg_min(ts, seq) AS first_seen FROM stream GROUP BY 1")
def _(spark, sf_dir):
    return T.first_seen(D.stream(spark, sf_dir))


@query("sk11_close_missing", """SELECT CAST(p_partkey AS VARCHAR) AS market_id, p_size % 5 = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 25) AS closed FROM part""")
def _(spark, sf_dir):
    seen = D.trades(spark, sf_dir).where("size > 25")
    return T.closed_missing(D.markets(spark, sf_dir).select("market_id", "closed"), seen, "market_id")


@query("sk13_expired", f"WITH {D.TRADES}, {D.MARKETS} SELECT trade_id, market_id FROM trades WHERE NOT (ts < TIMESTAMP '1999-01-01' AND market_id IN (SELECT market_id FROM markets WHERE closed))")
def _(spark, sf_dir):
    return T.expired(D.trades(spark, sf_dir).select("trade_id", "market_id", "ts"), D.markets(spark, sf_dir).where("closed"), F.lit("1999-01-01").cast("timestamp")).select("trade_id", "market_id")


@query("sc19_token_sides", f"WITH {D.MARKETS} SELECT market_id, condition_id, market_id || '-' || s AS asset_id, s AS outcome_side FROM markets, (VALUES ('YES'), ('NO')) v(s)")
def _(spark, sf_dir):
    return T.tokens(D.markets(spark, sf_dir))


@query("j14_token_join", f"""WITH {D.TRADES}, {D.MARKETS}, k AS (SELECT market_id || '-' || s AS asset_id, s AS side_of FROM markets, (VALUES ('YES'), ('NO')) v(s))
 SELECT side_of, count(*) AS n FROM trades JOIN k USING (asset_id) GROUP BY 1""")
def _(spark, sf_dir):
    k = T.tokens(D.markets(spark, sf_dir)).select("asset_id", F.col("outcome_side").alias("side_of"))
    return D.trades(spark, sf_dir).join(k, "asset_id").groupBy("side_of").agg(F.count("*").alias("n"))


@query("w3_running_first_seen", f"WITH {D.STREAM} SELECT seq, wallet, first_value(ts) OVER (PARTITION BY wallet ORDER BY seq) AS first_seen FROM stream")
def _(spark, sf_dir):
    from pyspark.sql import Window

    return D.stream(spark, sf_dir).select("seq", "wallet", F.first_value("ts").over(Window.partitionBy("wallet").orderBy("seq")).alias("first_seen"))


@query("u1_union_sources", """SELECT 'raw' AS tag, event_type AS source, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'detector_input', event_type, count(*) FROM events WHERE value > 50 GROUP BY 2""")
def _(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    count = lambda df, tag: df.groupBy(F.lit(tag).alias("tag"), F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    return count(e, "raw").unionByName(count(e.where("value > 50"), "detector_input"))


@query("a3_null_wallet_rate", f"WITH {CANONICAL} SELECT count(*) AS total, count(*) FILTER ({LOW} IS NULL) AS without_wallet, max(ts) AS reference_time FROM canonical")
def _(spark, sf_dir):
    return canonical(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("wallet").isNull()).alias("without_wallet"), F.max("ts").alias("reference_time"))


@query("a54_linkage", f"WITH {D.TRADES} SELECT count(*) AS total, count(wallet) AS with_wallet, count(condition_id) AS with_condition, count(tx_hash) AS with_hash FROM trades")
def _(spark, sf_dir):
    return D.trades(spark, sf_dir).agg(F.count("*").alias("total"), F.count("wallet").alias("with_wallet"), F.count("condition_id").alias("with_condition"), F.count("tx_hash").alias("with_hash"))


@query("t15_top_volume_markets", f"WITH {D.TRADES}, {D.MARKETS}, v AS (SELECT market_id, {_SUM.format('notional')} AS volume FROM trades GROUP BY 1) SELECT market_id, event_id, volume FROM markets JOIN v USING (market_id) WHERE NOT closed ORDER BY volume DESC, market_id LIMIT 20")
def _(spark, sf_dir):
    from ..functions.scalars import money

    v = D.trades(spark, sf_dir).groupBy("market_id").agg(money(F.col("notional")).alias("volume"))
    return D.markets(spark, sf_dir).where("not closed").join(v, "market_id").select("market_id", "event_id", "volume").orderBy(F.desc("volume"), "market_id").limit(20)


@query("t5_tiered_universe", f"""WITH {D.TRADES}, {D.MARKETS}, v AS (SELECT market_id, event_id, coalesce({_SUM.format('notional')}, 0) AS volume FROM markets LEFT JOIN trades USING (market_id) GROUP BY 1, 2)
 SELECT market_id, volume, CAST(CASE WHEN volume > 1000000 THEN 1 WHEN volume > 500000 THEN 2 ELSE 3 END AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY event_id ORDER BY volume DESC, market_id) AS INTEGER) AS place FROM v""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions.scalars import money

    v = D.markets(spark, sf_dir).join(D.trades(spark, sf_dir).select("market_id", "notional"), "market_id", "left").groupBy("market_id", "event_id").agg(F.coalesce(money(F.col("notional")), F.lit(0.0)).alias("volume"))
    w = Window.partitionBy("event_id").orderBy(F.desc("volume"), "market_id")
    return v.select("market_id", "volume", F.when(F.col("volume") > 1000000, 1).when(F.col("volume") > 500000, 2).otherwise(3).alias("tier"), F.row_number().over(w).alias("place"))
