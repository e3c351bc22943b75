"""Data quality: coverage, duplicates, integrity, null rates, leakage, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def ratio_by(rows: DataFrame, matched: Column, *keys: str) -> DataFrame:
    """Total, matched and their ratio by key."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(matched).alias("matched"))
    return out.withColumn("ratio", F.round(S.safe_ratio(F.col("matched"), F.col("total")), 6))


def side_coverage(trades: DataFrame, *keys: str) -> DataFrame:
    """Markets with trades of both outcomes, by key."""
    inner = trades.groupBy(*keys, "market_id").agg(F.max(F.when(F.col("outcome_side") == "YES", 1).otherwise(0)).alias("yes"), F.max(F.when(F.col("outcome_side") == "NO", 1).otherwise(0)).alias("no"))
    out = inner.groupBy(*keys).agg(F.count("*").alias("markets"), F.count_if((F.col("yes") == 1) & (F.col("no") == 1)).alias("both"))
    return out.withColumn("ratio", F.round(S.safe_ratio(F.col("both"), F.col("markets")), 6))


def two_sided(trades: DataFrame) -> DataFrame:
    """Conditions with two sides or more."""
    return trades.where(S.is_present(F.col("condition_id"))).groupBy("condition_id").agg(F.countDistinct("outcome_side").alias("sides")).where(F.col("sides") >= 2)


def duplicate_identity(trades: DataFrame) -> DataFrame:
    """Identity of each trade: its transaction's hash, else its own fields; flags of what it rests on."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c)))
    own = F.concat_ws("|", "condition_id", "asset_id", "outcome_side", number("price"), number("size"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return trades.select("trade_id", "source", "priority", "market_id", "notional", F.coalesce(F.lower(S.blank_to_null(F.col("tx_hash"))), own).alias("identity"), S.is_present(F.col("tx_hash")).alias("by_hash"))


def duplicate_rates(identities: DataFrame, *keys: str) -> DataFrame:
    """Duplicate groups, surplus rows and their rate, by key."""
    groups = identities.groupBy(*keys, "identity").agg(F.count("*").alias("n"))
    out = groups.groupBy(*keys).agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.sum(F.col("n") - 1).alias("surplus"))
    return out.withColumn("rate", F.round(S.safe_ratio(F.col("surplus"), F.col("total")), 6))


def priority_conflicts(identities: DataFrame) -> DataFrame:
    """Duplicate groups that hold several sources, or one source under several priorities."""
    groups = identities.groupBy("identity").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("priority").alias("priorities")).where(F.col("n") > 1)
    return groups.where((F.col("sources") > 1) | (F.col("priorities") > F.col("sources")))


def duplicate_samples(identities: DataFrame, n: int = 50) -> DataFrame:
    """The largest duplicate groups with the reasons for which they count; n is the size of the report."""
    groups = identities.groupBy("identity").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("notional").alias("amounts")).where(F.col("n") > 1)
    reasons = F.array_compact(F.array(F.lit("duplicate_group"), F.when(F.col("sources") > 1, "several_sources"), F.when(F.col("amounts") > 1, "amounts_differ")))
    return groups.withColumn("reasons", F.array_join(reasons, ",")).orderBy(F.desc("n"), "identity").limit(n)


def priority_coherence(trades: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Rows by source, those whose priority isn't the source's rank, and whether the source has a rank."""
    expected = F.lit(None).cast("int")
    for k, v in ranks.items():
        expected = F.when(F.col("source") == k, v).otherwise(expected)
    return trades.groupBy("source").agg(F.count("*").alias("total"), F.count_if(~F.col("priority").eqNullSafe(expected)).alias("mismatched"), F.bool_and(expected.isNotNull()).alias("ranked"))


def wallet_integrity(trades: DataFrame, *keys: str) -> DataFrame:
    """Missing, malformed and suspicious wallets by key, and overall (key null)."""
    w = F.col("wallet")
    flags = {"missing": ~S.is_present(w), "malformed": S.is_present(w) & ~S.wallet_valid(w), "upper_case": S.is_present(w) & (w != F.lower(w)), "equals_hash": F.coalesce(F.lower(w) == F.lower("tx_hash"), F.lit(False)), "equals_asset": F.coalesce(w == F.col("asset_id"), F.lit(False))}
    out = trades.rollup(*keys) if keys else trades.groupBy()
    return out.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def null_rates(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Share of missing values of each column, by key and overall."""
    out = (rows.rollup(*keys) if keys else rows.groupBy()).agg(F.count("*").alias("total"), *(F.round(F.avg(F.when(S.is_present(F.col(c)), 0.0).otherwise(1.0)), 6).alias(c) for c in columns))
    return out


def blanks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each required column with its blank values."""
    counts = rows.agg(*(F.count_if(~S.is_present(F.col(c))).alias(c) for c in columns))
    return counts.unpivot([], columns, "column", "blank")


def condition_population(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Trades with and without a condition, and those whose condition isn't their market's."""
    own = markets.select("market_id", F.col("condition_id").alias("market_condition"))
    joined = trades.join(own, "market_id", "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(S.is_present(F.col("condition_id"))).alias("present"), F.count_if(F.coalesce(F.col("condition_id") != F.col("market_condition"), F.lit(False))).alias("mismatched"), F.count_if(F.col("market_condition").isNull()).alias("market_without"))


def condition_integrity(trades: DataFrame) -> DataFrame:
    """Of each condition: sides, markets, and the reasons for which it fails."""
    by = trades.where(S.is_present(F.col("condition_id"))).groupBy("condition_id").agg(F.bool_or(F.col("outcome_side") == "YES").alias("yes"), F.bool_or(F.col("outcome_side") == "NO").alias("no"), F.countDistinct("market_id").alias("markets"), F.count("*").alias("n"))
    reasons = F.array_compact(F.array(F.when(~F.col("yes"), "no_yes_trades"), F.when(~F.col("no"), "no_no_trades"), F.when(F.col("markets") > 1, "several_markets")))
    return by.withColumn("reasons", F.array_join(reasons, ","))


def leakage(trades: DataFrame, approved: DataFrame) -> DataFrame:
    """Markets that are traded but not approved."""
    out = trades.join(approved.select("market_id").distinct(), "market_id", "left_anti")
    return out.agg(F.countDistinct("market_id").alias("markets"), F.count("*").alias("trades"))


def rolled_up(findings: DataFrame) -> DataFrame:
    """The latest finding of each check, and the worst status of all. findings: check, at, status."""
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1).otherwise(2)
    last = findings.groupBy("check").agg(F.max_by(rank, "at").alias("r"))
    name = F.element_at(F.array(F.lit("fail"), F.lit("warn"), F.lit("pass")), F.min("r") + 1)
    return last.agg(name.alias("status"), *(F.count_if(F.col("r") == i).alias(s) for i, s in enumerate(("fail", "warn", "pass"))))


def missing_columns(tables: dict[str, DataFrame | None], contract: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(table, column) pairs that a contract asks for and the tables lack; column '*' for a missing table."""
    out = []
    for name, columns in contract.items():
        df = tables.get(name)
        out += [(name, "*")] if df is None else [(name, c) for c in columns if c not in df.columns]
    return out
