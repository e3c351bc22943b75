"""The surveillance tables as views of the star schema at hand, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All tables at hand.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: the part is the market, the customer the wallet."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key, line, market = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").cast("string")
    outcome = F.when(F.col("l_linestatus") == "F", "YES").otherwise("NO")
    wallet = F.when(F.col("o_custkey") % 17 == 0, F.lit(None)).when(F.col("o_custkey") % 19 == 0, F.concat(F.lit("W"), "o_custkey")).otherwise(F.concat(F.lit("w"), F.col("o_custkey")))
    return l.join(o, key == F.col("o_orderkey")).select(
        F.concat(key, F.lit("-"), line, F.lit("-"), F.col("l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("trade_id"),
        market.alias("market_id"),
        F.when(F.col("l_partkey") % 23 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), market)).alias("condition_id"),
        F.concat(market, F.lit("-"), outcome).alias("asset_id"),
        wallet.alias("wallet"),
        F.when(line % 3 != 0, F.concat(F.lit("H"), key, F.lit("-"), F.floor(line / 2).cast("int"))).alias("tx_hash"),
        outcome.alias("outcome_side"),
        F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "BUY").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 5000.0).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_extendedprice").alias("notional"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.element_at(F.array(F.lit("ws"), F.lit("clob_backfill"), F.lit("clob")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("source"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("priority"),
    )


TRADES = """trades AS (
 SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trade_id, CAST(l_partkey AS VARCHAR) AS market_id,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE 'c' || l_partkey END AS condition_id,
  l_partkey || '-' || CASE WHEN l_linestatus = 'F' THEN 'YES' ELSE 'NO' END AS asset_id,
  CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 19 = 0 THEN 'W' || o_custkey ELSE 'w' || o_custkey END AS wallet,
  CASE WHEN l_linenumber % 3 <> 0 THEN 'H' || l_orderkey || '-' || (l_linenumber // 2) END AS tx_hash,
  CASE WHEN l_linestatus = 'F' THEN 'YES' ELSE 'NO' END AS outcome_side,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' WHEN l_returnflag = 'A' THEN 'BUY' END AS side,
  l_extendedprice / l_quantity / 5000.0 AS price, l_quantity AS size, l_extendedprice AS notional, l_shipdate AS ts,
  CASE l_suppkey % 3 WHEN 0 THEN 'ws' WHEN 1 THEN 'clob_backfill' ELSE 'clob' END AS source, CAST(l_suppkey % 3 + 1 AS INTEGER) AS priority
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as markets, their brand as the event."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("market_id"), F.col("p_brand").alias("event_id"), F.col("p_name").alias("question"),
        F.col("p_type").alias("category"), (F.col("p_size") % 5 == 0).alias("closed"), F.col("p_retailprice").alias("liquidity"),
        F.when(F.col("p_partkey") % 23 != 0, F.concat(F.lit("c"), F.col("p_partkey"))).alias("condition_id"), F.col("p_size").alias("rank"))


MARKETS = """markets AS (
 SELECT CAST(p_partkey AS VARCHAR) AS market_id, p_brand AS event_id, p_name AS question, p_type AS category, p_size % 5 = 0 AS closed,
  p_retailprice AS liquidity, CASE WHEN p_partkey % 23 <> 0 THEN 'c' || p_partkey END AS condition_id, p_size AS rank FROM part)"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of the detector: seq is their order of arrival."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("market_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id")).alias("wallet"), F.when(F.col("event_type").isin("purchase", "signup", "view"), "BUY").otherwise("SELL").alias("side"),
        F.when(F.col("event_type").isin("purchase", "error"), "YES").otherwise("NO").alias("outcome_side"),
        (F.col("value") * 1.000123456789).alias("notional"), (F.col("value") / (F.col("value") + 10.0)).alias("price"))


STREAM = """stream AS (
 SELECT event_id AS seq, json_extract_string(props, '$.k') AS market_id, ts, 'u' || user_id AS wallet,
  CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'BUY' ELSE 'SELL' END AS side,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'YES' ELSE 'NO' END AS outcome_side,
  value * 1.000123456789 AS notional, value / (value + 10.0) AS price FROM events)"""


def kind(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Events of one type: purchases are candidates, signups alerts, views evidence, errors resolutions, clicks quotes."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    return e.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("market_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value"), F.concat(F.lit("u"), F.col("user_id")).alias("wallet"))


def kind_sql(name: str, event_type: str) -> str:
    return f"{name} AS (SELECT event_id AS id, json_extract_string(props, '$.k') AS market_id, ts, value, 'u' || user_id AS wallet FROM events WHERE event_type = '{event_type}')"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored episodes: their relative length is the score, quality the outcome."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    return l.join(d, "doc_id").select("doc_id", F.col("lang").alias("split"), F.col("source").alias("category"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"), F.col("quality").alias("label"))


SCORED = """scored AS (SELECT doc_id, lang AS split, source AS category, n_chars / (n_chars + 1000.0) AS score, quality AS label
 FROM labels JOIN documents USING (doc_id))"""
