"""Replay evaluation: holdouts, paper trades, metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions import scalars as S
from ..session import written
from .folds import BLOCK_ROWS, folded, ranked
from .joins import as_of


def family_folds(rows: DataFrame, family: str, c: Evaluation = Evaluation(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the fold of each row's family: its rank among the distinct families, modulo the folds; null families have none."""
    keys = ranked(rows.where(F.col(family).isNotNull()), family, block_rows)
    fold = F.format_string("fold_%d_of_%d", ((F.col("rank") - 1) % c.folds + 1).cast("int"), F.lit(c.folds))
    return rows.join(keys.select(family, fold.alias("fold")), family, "left")


def time_split(rows: DataFrame, block: str) -> DataFrame:
    """Adds train, validation or test by the rank of the row's time block from the end."""
    blocks = rows.select(block).distinct()
    ranked = blocks.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(block)))).crossJoin(F.broadcast(blocks.agg(F.count("*").alias("__n"))))
    name = F.when(F.col("__n") == 1, "train").when(F.col("__n") == 2, F.when(F.col("__r") == 1, "test").otherwise("train")).when(F.col("__r") == 1, "test").when(F.col("__r") == 2, "validation").otherwise("train")
    return rows.join(ranked.select(block, name.alias("partition")), block)


def paper_trades(alerts: DataFrame, quotes: DataFrame, c: Evaluation = Evaluation()) -> DataFrame:
    """One simulated trade for each alert.

    alerts: id (tells them apart; without one there is no entry), market_id, ts, direction, resolved_ts, resolution. quotes:
    market_id, ts, yes. Entry is the first usable quote after the alert, a tick worse; exit the first quote that loses the
    stop share, else the resolution if it comes before the time stop, else the first quote after the time stop, else none.
    Each alert is simulated on its own.

    No pairs of alerts and quotes are made. Quotes of one time are a row with the lowest price of either side. Entries are an
    as-of join. An exit lies in the two slices of time, a hold long each, from the entry's on, or is the first quote after
    these: a market's entries of a slice are a task's unit, and look for their exits in a tree of lowest prices.
    """
    hold = c.hold_hours * 3600 * 1_000_000
    number = F.floor(F.unix_micros("ts") / hold).cast("long")
    usable = quotes.where("market_id is not null and ts is not null and yes is not null")
    prices = (F.min("yes").alias("yes"), F.min(1.0 - F.col("yes")).alias("no"))
    ticks = written(usable.groupBy("market_id", "ts").agg(*prices))
    asked = alerts.select("id", "market_id", "ts", "direction", "resolved_ts", "resolution")
    until = F.greatest(F.col("ts") + F.expr(f"interval {c.hold_hours} hours"), F.coalesce("resolved_ts", F.col("ts")))
    met = as_of(asked, ticks, "market_id", "q", forward=True).withColumn("until", until)
    usable = F.col("id").isNotNull() & F.col("q.ts").between(F.col("ts"), F.col("until")) & (F.col("resolved_ts").isNull() | (F.col("q.ts") < F.col("resolved_ts")))
    price = F.when(F.col("direction") == "YES", F.col("q.yes")).otherwise(F.col("q.no"))
    met = written(met.select(
        "id", "market_id", "direction", "resolved_ts", "resolution", "until", F.when(usable, F.col("q.ts")).alias("entry_ts"), F.when(usable, S.clamped(price + c.tick)).alias("entry")))
    own = met.where("entry_ts is not null").select(
        "*", F.unix_micros("entry_ts").alias("from_us"), F.unix_micros("until").alias("until_us"), F.unix_micros("resolved_ts").alias("resolved_us"), F.floor(F.unix_micros("entry_ts") / hold).cast("long").alias("slice"))
    placed = ticks.select("market_id", F.unix_micros("ts").alias("us"), "yes", "no", number.alias("slice"))
    near = placed.withColumn("slice", F.explode(F.array(F.col("slice"), F.col("slice") - 1)))
    first = placed.groupBy("market_id", "slice").agg(F.min(F.struct("us", "yes", "no")).alias("f"))  # a row for each slice
    w = Window.partitionBy("market_id").orderBy("slice")
    far = F.when(F.lead("slice").over(w) == F.col("slice") + 1, F.lead("f", 2).over(w)).otherwise(F.lead("f").over(w))
    far = first.select("market_id", "slice", far.alias("f")).where("f is not null").select("market_id", "f.*", "slice")
    kind = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in met.schema)}, exit_us long, exit double, why string"
    keys = ("market_id", "slice")
    out = own.groupBy(*keys).cogroup(near.unionByName(far).groupBy(*keys)).applyInArrow(_exits(met.columns, hold, c), kind)
    none = [F.lit(None).cast(k).alias(n) for n, k in (("exit_us", "long"), ("exit", "double"), ("why", "string"))]
    done = out.unionByName(met.where("entry_ts is null").select("*", *none))
    won = F.when(F.col("direction") == F.col("resolution"), 1.0).otherwise(0.0)
    why = F.when(F.col("entry").isNull(), "no_entry").when(F.col("why").isNotNull(), F.col("why")).when(F.col("resolved_ts").isNotNull(), "resolution_exit").otherwise("expired_unexitable")
    exit_price = F.when(why.isin("risk_stop", "time_stop"), F.col("exit")).when(why == "resolution_exit", won)
    quantity, fee = F.lit(c.notional) / F.col("entry"), F.lit(c.notional * c.fee * 2)
    exit_ts = F.when(F.col("why").isNotNull(), F.timestamp_micros("exit_us")).when(why == "resolution_exit", F.col("resolved_ts"))
    return done.select("id", "market_id", "direction", "entry_ts", F.round("entry", 6).alias("entry"), exit_ts.alias("exit_ts"), F.round(exit_price, 6).alias("exit"), why.alias("reason"), F.round(quantity * (exit_price - F.col("entry")) - fee, 6).alias("pnl"))


def first_at_most(values: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each start, the first place from it on whose value is at most ``most``; len(values) where there is none.

    By a tree of the smallest values of blocks of 2, 4, 8, ..., all searches a level at a time. NaN is never at most anything.
    """
    levels = [np.asarray(values, float)]
    while len(levels[-1]) > 1:
        low = levels[-1]
        low = np.append(low, np.inf) if len(low) % 2 else low
        levels.append(np.fmin(low[::2], low[1::2]))

    def has(level: int, block: np.ndarray, of: np.ndarray) -> np.ndarray:
        tree = levels[level]
        inside = block < len(tree)
        return inside & (tree[np.minimum(block, len(tree) - 1)] <= most[of])

    place, found = np.array(start, np.int64), np.full(len(start), -1)
    if not len(levels[0]):
        return place
    alive = np.arange(len(place))
    for level in range(len(levels)):  # up: blocks that begin where a search stands, each twice as long if it can be
        block = place[alive] >> level
        turn = (block % 2 == 1) | (level == len(levels) - 1)
        hit = turn & has(level, block, alive)
        found[alive[hit]] = level
        missed = alive[turn & ~hit]
        place[missed] = (block[turn & ~hit] + 1) << level
        alive = alive[~hit]
    for level in range(len(levels) - 1, 0, -1):  # down, into the first half that has one
        of = np.flatnonzero(found >= level)
        half = place[of] >> (level - 1)
        place[of] += np.where(has(level - 1, half, of), 0, 1 << (level - 1))
    return np.where(found >= 0, place, len(levels[0]))


def _exits(columns: list[str], hold: int, c: Evaluation) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Exits of a market's entries of a slice; ticks: those of this slice and the next, and the first one after."""

    def of(own: pa.Table, ticks: pa.Table) -> pa.Table:
        us = ticks["us"].to_numpy()
        order = np.argsort(us)
        us, side = us[order], {True: ticks["yes"].to_numpy()[order], False: ticks["no"].to_numpy()[order]}
        start, last = own["from_us"].to_numpy(), own["until_us"].to_numpy()
        before = pc.fill_null(own["resolved_us"], np.iinfo(np.int64).max).to_numpy()
        bound = own["entry"].to_numpy() * (1 - c.stop)
        yes = pc.fill_null(pc.equal(own["direction"], "YES"), False).to_numpy().astype(bool)
        at, price = np.zeros(len(yes), np.int64), np.zeros(len(yes))
        for kind, values in side.items():
            of = np.flatnonzero(yes == kind)
            hit = first_at_most(values, np.searchsorted(us, start[of], "right"), bound[of])
            at[of] = np.minimum(hit, np.searchsorted(us, start[of] + hold))
            price[of] = np.append(values, np.nan)[at[of]]
        when = np.append(us, 0)[at]
        none = (at == len(us)) | (when > last) | (when >= before)
        why = np.where(price <= bound, "risk_stop", "time_stop").astype(object)
        made = [pa.array(when, pa.int64(), mask=none), pa.array(np.maximum(0.0, price - c.tick), pa.float64(), mask=none), pa.array(why, pa.string(), mask=none)]
        return pa.table([*(own[n] for n in columns), *made], names=[*columns, "exit_us", "exit", "why"])

    return of


def limited(trades: DataFrame, family: str, c: Evaluation = Evaluation(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``taken``: trades in order of entry that find room among the open positions, in all and of their family.

    Taking depends on what was taken before; the state is the few open positions, and the trades are folded in blocks of
    time (``folds.folded``). Trades without an entry aren't taken; without an exit they close as they are entered.
    """
    most, each = c.open_positions, c.per_family

    def step(state, x):
        if x["t"] is None:
            return state, False
        still = [p for p in state or [] if p[0] > x["t"]]
        room = len(still) < most and sum(p[1] == x["family"] for p in still) < each
        return (still + [(x["end"], x["family"])] if room else still), room

    start = F.unix_micros("entry_ts")
    needs = {"t": start, "end": F.coalesce(F.unix_micros("exit_ts"), start), "family": F.col(family).cast("string")}
    return folded(trades, (), ("entry_ts", "id"), needs, step, "taken", block_rows)


def lead_times(rows: DataFrame, lead: str, *keys: str, c: Evaluation = Evaluation()) -> DataFrame:
    """Median, nearest-rank quartiles and the share of short lead times.

    The quartiles are the values at places max(0, int(n * q) - 1) in order, found by counting equal values, not by lists.
    """
    counts = rows.where(F.col(lead).isNotNull()).groupBy(*keys, lead).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("__to", F.sum("__c").over(w.orderBy(lead))).withColumn("__n", F.sum("__c").over(w))
    place = lambda q: F.greatest(F.lit(0), F.floor(F.col("__n") * q) - 1)
    at = lambda q: F.min(F.when(F.col("__to") > place(q), F.col(lead)))
    middle = (F.min(F.when(F.col("__to") >= F.col("__n") / 2, F.col(lead))) + F.min(F.when(F.col("__to") > F.col("__n") / 2, F.col(lead)))) / 2
    short = F.sum(F.when(F.col(lead) < c.short_lead_s, F.col("__c")).otherwise(0)) / F.sum("__c")
    return counts.groupBy(*keys).agg(F.sum("__c").alias("n"), middle.alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"), F.round(short, 6).alias("short_share"))


def trade_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Fill rate, mean and median result, hit rate and the mean of the worst tenth."""
    done = F.col("pnl").isNotNull()
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = trades.withColumn("__r", F.when(done, F.row_number().over(w.orderBy(F.col("pnl").asc_nulls_last(), "id")))).withColumn("__n", F.count("pnl").over(w))
    worst = F.when(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 10)), F.col("pnl"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.count("pnl").alias("filled"), F.round(F.avg("pnl"), 6).alias("mean_pnl"), F.round(F.median("pnl"), 6).alias("median_pnl"), F.round(F.count_if(F.col("pnl") > 0) / F.count("pnl"), 6).alias("hit_rate"), F.round(F.avg(worst), 6).alias("worst_tenth"))


def split_summary(rows: DataFrame, regimes: dict[str, str], c: Evaluation = Evaluation()) -> DataFrame:
    """Counts, labelled rows and precision by regime and key in one pass: each row goes to its key of every regime."""
    pairs = F.array(*(F.struct(F.lit(r).alias("regime"), F.col(k).cast("string").alias("key")) for r, k in regimes.items()))
    each = rows.withColumn("__p", F.explode(pairs)).select("*", "__p.*")
    status = F.when(F.count("label") == 0, "unlabelled").when(F.count("*") >= c.min_rows, "scored").otherwise("descriptive_only")
    return each.groupBy("regime", "key").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.round(F.avg("label"), 6).alias("precision"), status.alias("status"))


def dependency(rows: DataFrame, key: str) -> DataFrame:
    """The largest share that one value of key has of all rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(key, F.struct("n", F.col(key))).alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.count("*").alias("values"))


def rule_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def candidate_report(found: DataFrame, top: int = 10) -> DataFrame:
    """A report of candidates: section, key, n and largest severity, for hours, rules, the top markets, and totals.

    found: market_id, ts, severity, rules. Totals are total_candidates and unique_markets. Markets are listed by number of
    candidates, then severity, then id. Counted in one pass (a row for each hour, market and rule leaves a task), and the
    counts written: the sections are read from them.
    """
    pair = lambda section, k: F.struct(F.lit(section).alias("section"), k.cast("string").alias("key"))
    fixed = F.array(pair("hour", F.date_format("ts", "yyyy-MM-dd'T'HH:00:00")), pair("market", F.col("market_id")))
    rules = F.coalesce(F.transform("rules", lambda r: pair("rule", r)), F.slice(fixed, 1, 0))
    counted = written(found.select(F.explode(F.concat(fixed, rules)).alias("p"), "severity").groupBy("p.section", "p.key").agg(F.count("*").alias("n"), F.max("severity").alias("severity")))
    markets = counted.where("section = 'market'")
    first = markets.where("key is not null").orderBy(F.desc("n"), F.desc("severity"), "key").limit(top)
    sums = markets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates"), F.count("key").alias("unique_markets"), F.max("severity").alias("severity"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in ("total_candidates", "unique_markets")))).alias("t")
    totals = sums.select(each, "severity").select(F.lit("total").alias("section"), "t.key", "t.n", "severity")
    return counted.where("section <> 'market'").unionByName(first).unionByName(totals)


def signature_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Signatures (market, end, sorted rules) that only one of two runs has."""
    own = lambda df: df.select("market_id", "ts", F.array_join(F.array_sort("rules"), ",").alias("rules")).distinct()
    a, b = own(left), own(right)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def assessment(share: float = 0.75, useful: float = 0.5) -> Column:
    """Status of a report from its columns n_rows, n_insufficient, fills, median_pnl, usefulness, category_share and
    family_share; the first that holds. Null metrics count as not reached.
    """
    over = lambda c, x, strict=False: F.coalesce(F.col(c) > x if strict else F.col(c) >= x, F.lit(False))
    gains, helps = over("median_pnl", 0, True), over("usefulness", useful)
    spread = F.coalesce((F.col("category_share") < share) & (F.col("family_share") < share), F.lit(False))
    return (
        F.when(F.col("n_rows") == 0, "no_rows_in_window").when((F.col("n_insufficient") > 0) & (F.col("fills") == 0), "coverage_limited")
        .when(gains & helps & spread, "promising").when(gains | helps, "mixed").otherwise("not_yet_defendable")
    )


def alert_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Metrics of alerts by key: how many, how many with a label and with feedback, and the shares of useful ones among both.

    rows: label (1 useful, 0 not, null unknown), useful (boolean or null: feedback), delivered. Ratios without a
    denominator are 0.
    """
    ratio = lambda n, d: F.round(S.safe_ratio(n, d), 6)
    known, told = F.count("label"), F.count("useful")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_alerts"), known.alias("labelled"), told.alias("with_feedback"), F.count_if("delivered").alias("delivered"),
        ratio(F.count_if(F.col("label") == 1), known).alias("label_precision"), ratio(F.count_if("useful"), told).alias("usefulness_precision"),
        ratio(known, F.count("*")).alias("label_coverage"))


def holdout_metrics(families: dict[str, tuple[DataFrame, Callable[..., DataFrame]]], regimes: dict[str, str]) -> DataFrame:
    """Metrics of each family of rows by holdout regime and its key, in long form: family, regime, key, metric, value.

    families: rows and a function of rows and key columns that gives numeric metrics (``alert_metrics``, ``trade_metrics``,
    ...). regimes: name and key column. Rows go to their key of every regime in one pass; a null key is a key of its own.
    """
    pairs = F.array(*(F.struct(F.lit(r).alias("regime"), F.col(k).cast("string").alias("key")) for r, k in regimes.items()))
    out = None
    for name, (rows, metrics) in families.items():
        each = metrics(rows.withColumn("__p", F.explode(pairs)).select("*", "__p.*").drop("__p"), "regime", "key")
        values = [c for c in each.columns if c not in ("regime", "key")]
        wide = each.select("regime", "key", *(F.col(c).cast("double") for c in values))
        long = wide.unpivot(["regime", "key"], values, "metric", "value").select(F.lit(name).alias("family"), "*")
        out = long if out is None else out.unionByName(long)
    return out


def extreme_categories(rows: DataFrame, category: str, value: str, n: int = 3) -> DataFrame:
    """The n categories of largest and of smallest mean value, each with its place; n is the size of the report."""
    means = rows.groupBy(category).agg(F.round(F.avg(value), 6).alias("mean"))
    places = lambda end, *order: means.orderBy(*order, category).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order, category))).withColumn("end", F.lit(end))
    return places("strongest", F.desc("mean")).unionByName(places("weakest", F.asc("mean")))
