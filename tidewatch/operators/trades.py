"""Trades: normal form, identity, upserts, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Rank of the sources; the larger one wins.
PRIORITY = {"ws": 1, "clob_backfill": 2, "clob": 3}


def keyed(trades: DataFrame) -> DataFrame:
    """Adds dedupe_key."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    key = S.dedupe_key(F.col("tx_hash"), F.col("condition_id"), F.col("asset_id"), F.col("side"), F.col("price"), F.col("size"), time)
    return trades.withColumn("dedupe_key", key)


def canonical(trades: DataFrame, *keep: str) -> DataFrame:
    """One trade for each dedupe key (or id): of the highest priority, then the latest, then of the largest id.

    keep: the columns that are wanted besides these three; all without it. Others aren't moved.

    A grouped maximum of rows: tasks sort and combine their own rows before the shuffle, so that a hot key sends a row from
    each task. As rows hold texts, Spark sorts on both sides of the shuffle instead of hashing.
    """
    key = F.coalesce(F.nullif("dedupe_key", F.lit("")), "trade_id")
    rest = [c for c in keep or trades.columns if c not in ("priority", "ts", "trade_id")]
    best = F.max(F.struct("priority", "ts", "trade_id", F.struct(*rest).alias("rest")))
    return trades.groupBy(key.alias("__key")).agg(best.alias("b")).select("b.priority", "b.ts", "b.trade_id", "b.rest.*")


def upserted(arrivals: DataFrame, order: str = "seq", overwrite: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Final rows after upserts by trade_id in order of arrival.

    An arrival applies unless an applied earlier one has a higher priority. overwrite columns take the last applied value;
    keep columns the last applied one that isn't null.
    """
    before = Window.partitionBy("trade_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    applied = arrivals.where("trade_id is not null").withColumn("__top", F.max("priority").over(before)).where("__top is null or priority >= __top")
    at = F.col(order)
    last = [F.max_by(c, at).alias(c) for c in ("priority", *overwrite)]
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in keep]
    return applied.groupBy("trade_id").agg(*last, *kept)


def first_seen(trades: DataFrame, order: str = "seq") -> DataFrame:
    """The time of the first arrival of each wallet, which later ones don't change."""
    return trades.where(S.is_present(F.col("wallet"))).groupBy("wallet").agg(F.min_by("ts", order).alias("first_seen"))


def sessions(trades: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("market_id", "condition_id")) -> DataFrame:
    """Episodes: a gap longer than gap ends one. Rows without a key are left out."""
    rows = trades
    for k in keys:
        rows = rows.where(S.is_present(F.col(k)))
    w = Window.partitionBy(*keys).orderBy("ts", "trade_id")
    fresh = F.col("ts") > F.lag("ts").over(w) + F.expr(f"interval {gap}")
    numbered = rows.withColumn("__n", F.sum(F.when(fresh, 1).otherwise(0)).over(w) + 1)
    return numbered.groupBy(*keys, F.col("__n").cast("long").alias("episode")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_trades"), F.countDistinct("wallet").alias("n_wallets"), S.money(F.col("notional")).alias("notional"))


def closed_missing(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """known with the rows closed that a full snapshot no longer has."""
    gone = known.join(seen.select(key).distinct(), key, "left_anti").select(key).withColumn("__gone", F.lit(True))
    return known.join(gone, key, "left").withColumn("closed", F.col("closed") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def expired(rows: DataFrame, closed_markets: DataFrame, before: F.Column) -> DataFrame:
    """What remains when old rows of closed markets are deleted."""
    old = rows.where(F.col("ts") < before).join(closed_markets.select("market_id").distinct(), "market_id", "left_semi")
    return rows.join(old.select("trade_id").distinct(), "trade_id", "left_anti")


def tokens(markets: DataFrame) -> DataFrame:
    """A row for each side of each market."""
    sides = F.array(*(F.struct(F.concat("market_id", F.lit(f"-{s}")).alias("asset_id"), F.lit(s).alias("outcome_side")) for s in ("YES", "NO")))
    return markets.select("market_id", "condition_id", F.explode(sides).alias("t")).select("market_id", "condition_id", "t.*")
