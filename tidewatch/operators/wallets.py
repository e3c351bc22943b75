"""Wallets: activity, positions, profiles, clusters, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _wallet() -> Column:
    return F.lower(S.blank_to_null(F.col("wallet")))


def activity(trades: DataFrame) -> DataFrame:
    """Counts and sums of each wallet (in lower case); recent ones count back from the latest trade of all."""
    last = trades.agg(F.max("ts").alias("__now"))
    rows = trades.withColumn("wallet", _wallet()).where("wallet is not null").crossJoin(F.broadcast(last))  # one row
    recent = lambda days: F.col("ts") >= F.col("__now") - F.expr(f"interval {days} days")
    return rows.groupBy("wallet").agg(
        F.count("*").alias("n_trades"), F.count_if(F.col("side") == "BUY").alias("n_buy"), F.count_if(F.col("side") == "SELL").alias("n_sell"),
        S.money(F.col("notional")).alias("notional"), F.coalesce(S.money(F.when(recent(1), F.col("notional"))), F.lit(0.0)).alias("notional_1d"),
        F.coalesce(S.money(F.when(recent(7), F.col("notional"))), F.lit(0.0)).alias("notional_7d"), F.countDistinct("market_id").alias("n_markets"),
        F.countDistinct("condition_id").alias("n_conditions"), F.countDistinct("source").alias("n_sources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min(F.struct("ts", "trade_id", "market_id"))["market_id"].alias("first_market"))


def favourites(trades: DataFrame, column: str = "market_id", top: int = 5) -> DataFrame:
    """The most frequent value of each wallet (of equally frequent ones the smallest) and its top ones, comma-joined."""
    counts = trades.withColumn("wallet", _wallet()).where(F.col("wallet").isNotNull() & F.col(column).isNotNull()).groupBy("wallet", column).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("n"), column))).where(F.col("r") <= top)
    return ranked.groupBy("wallet").agg(F.max(F.when(F.col("r") == 1, F.col(column))).alias("favourite"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", column))), lambda x: x[column]), ",").alias("top"))


def positions(trades: DataFrame) -> DataFrame:
    """Net position of each wallet, market and outcome. Any side but SELL nets as BUY; flat positions are left out."""
    sells = F.col("side").eqNullSafe("SELL")
    signed = lambda c: S.money(F.when(sells, -F.col(c)).otherwise(F.col(c)))
    mean = lambda c: F.sum(F.when(c, F.col("price").cast("decimal(24,14)"))).cast("double") / F.count_if(c)
    return trades.withColumn("wallet", _wallet()).where("wallet is not null").groupBy("wallet", "market_id", "outcome_side").agg(
        signed("size").alias("net_size"), signed("notional").alias("net_notional"), mean(~sells).alias("avg_buy"), mean(sells).alias("avg_sell"),
        F.min(F.when(F.col("price") > 0, F.col("price"))).alias("low"), F.max(F.when(F.col("price") > 0, F.col("price"))).alias("high"), F.count("*").alias("n_trades")).where(F.abs("net_size") > 1e-9)


def netted(trades: DataFrame, samples: int = 5) -> DataFrame:
    """The whole record of each wallet's position in a market and outcome, flat ones left out.

    Net and gross sizes and amounts, mean prices by amount and size, price range, first and last times, the most frequent
    condition (of equally frequent ones the smallest) and the first trades by time and id, comma-joined; samples is their
    number. Any side but SELL, in any case, nets as BUY; where the amount is missing or not above 0, price times size counts.
    Null sizes, prices and amounts are 0, blank conditions aren't counted, trades without a wallet are left out.

    The trades are dealt out by position once; their places in it, the sums by condition and the sums of these are taken where
    they lie, so that nothing is computed or moved twice. No lists are made: a position with many trades or conditions is
    sorted in one task, which may spill.
    """
    keys = ("wallet", "market_id", "outcome_side")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    amount = F.when((zero("notional") <= 0) & (zero("price") > 0), zero("price") * zero("size")).otherwise(zero("notional"))
    rows = trades.select(
        _wallet().alias("wallet"), "market_id", "outcome_side", S.blank_to_null(F.col("condition_id")).alias("condition_id"), S.blank_to_null(F.col("trade_id")).alias("trade_id"), "ts", F.coalesce(F.upper(F.trim("side")) == "SELL", F.lit(False)).alias("sell"),
        "size", "notional", "price")
    rows = rows.where("wallet is not null")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("decimal(38,10)")
    sums = {f"{side}_{c}": total(c, when) for side, when in (("buy", ~F.col("sell")), ("sell", F.col("sell"))) for c in ("size", "amount")}
    w = Window.partitionBy(*keys).orderBy(F.col("trade_id").isNull(), F.col("ts").asc_nulls_last(), "trade_id")
    rows = rows.withColumn("r", F.row_number().over(w)).withColumns(  # decimals after the shuffle: numbers move as they came
        {"size": zero("size").cast("decimal(28,10)"), "amount": amount.cast("decimal(28,10)"), "price": F.when(F.col("price") > 0, F.col("price"))})
    first = [f"first_{i}" for i in range(1, samples + 1)]
    by = rows.groupBy(*keys, "condition_id").agg(
        *(x.alias(n) for n, x in sums.items()), F.count("*").alias("n"), F.count_if("sell").alias("n_sell"), F.min("price").alias("low"), F.max("price").alias("high"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *(F.max(F.when(F.col("r") == i, F.col("trade_id"))).alias(n) for i, n in enumerate(first, 1)))
    out = by.groupBy(*keys).agg(
        *(F.sum(n).alias(n) for n in sums), F.sum("n").alias("n_trades"), F.sum("n_sell").alias("n_sell"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.min(F.when(F.col("condition_id").isNotNull(), F.struct((-F.col("n")).alias("n"), "condition_id")))["condition_id"].alias("condition_id"), *(F.max(n).alias(n) for n in first))
    out = out.where(F.abs(F.col("buy_size") - F.col("sell_size")) > 1e-9)
    number = lambda x: x.cast("double")
    price = lambda side: F.when(F.col(f"{side}_size") != 0, number(F.col(f"{side}_amount")) / number(F.col(f"{side}_size"))).alias(f"avg_{side}_price")
    return out.select(
        *keys, "condition_id", number(F.col("buy_size") - F.col("sell_size")).alias("net_size"), number(F.col("buy_amount") - F.col("sell_amount")).alias("net_notional"),
        *(number(F.col(n)).alias(n) for n in sums), "n_trades", (F.col("n_trades") - F.col("n_sell")).alias("n_buy"), "n_sell", price("buy"), price("sell"), "low", "high", "first_ts", "last_ts", F.concat_ws(",", *first).alias("first_trades"))


def position_summary(positions: DataFrame) -> DataFrame:
    return positions.groupBy("wallet").agg(F.count("*").alias("n_positions"), F.count_if(F.col("net_size") > 0).alias("n_long"), S.money(F.abs("net_notional")).alias("gross"), F.max(F.abs("net_notional")).alias("largest"))


def top_positions(positions: DataFrame, n: int = 3) -> DataFrame:
    """The n largest positions of each wallet."""
    w = Window.partitionBy("wallet").orderBy(F.desc(F.abs("net_notional")), "market_id", "outcome_side")
    return positions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("wallet", "market_id", "outcome_side", "net_notional", "rank")


def clusters(trades: DataFrame, min_wallets: int = 3) -> DataFrame:
    """Wallets that trade one condition, with a confidence by their share and number of trades."""
    members = trades.withColumn("wallet", _wallet()).where(F.col("wallet").isNotNull() & S.is_present(F.col("condition_id"))).groupBy("condition_id", "wallet").agg(F.count("*").alias("n_trades"), S.money(F.col("notional")).alias("notional"))
    whole = members.groupBy("condition_id").agg(F.count("*").alias("n_wallets"), S.money(F.col("notional")).alias("cluster_notional")).where(F.col("n_wallets") >= min_wallets)
    share = S.safe_ratio(F.col("notional"), F.col("cluster_notional"))
    confidence = F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.4), share * 0.4) + F.when(F.col("n_trades") > 1, 0.1).otherwise(0.0))
    return members.join(whole, "condition_id").select(S.short_id(F.col("condition_id"), 12).alias("cluster_id"), "condition_id", "wallet", "n_trades", "n_wallets", "notional", F.round(confidence, 6).alias("confidence"))


def cluster_lists(members: DataFrame) -> DataFrame:
    """The clusters of each wallet."""
    return members.groupBy("wallet").agg(F.count("*").alias("n_clusters"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_list("cluster_id")), ",").alias("clusters"))


def profiles(activity: DataFrame, position_summary: DataFrame, cluster_lists: DataFrame) -> DataFrame:
    out = activity.join(position_summary, "wallet", "left").join(cluster_lists, "wallet", "left")
    return out.select("wallet", "n_trades", "notional", F.coalesce("n_positions", F.lit(0)).alias("n_positions"), F.coalesce("gross", F.lit(0.0)).alias("gross"), F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))


def freshness(trades: DataFrame, days: int = 30, most: int = 3) -> DataFrame:
    """Trades of wallets that were first seen at most days before and have at most most trades in all."""
    rows = trades.withColumn("wallet", _wallet())
    seen = rows.where("wallet is not null").groupBy("wallet").agg(F.min("ts").alias("first_seen"), F.count("*").alias("wallet_trades"))
    age = F.floor((F.unix_micros("ts") - F.unix_micros("first_seen")) / 86400000000.0)
    out = rows.join(seen, "wallet", "left")
    return out.select("trade_id", "wallet", (F.coalesce(age <= days, F.lit(False)) & (F.coalesce("wallet_trades", F.lit(0)) <= most) & F.col("wallet").isNotNull()).alias("fresh"), F.when(F.col("wallet").isNull(), "low").when(F.col("wallet_trades") > most, "full").otherwise("limited").alias("confidence"))


def top(rows: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(F.abs(by)), *ties).limit(n)
