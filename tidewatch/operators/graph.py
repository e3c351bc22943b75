"""Features of the graph of wallets and markets, as of each decision: by spans of time in slices (``features``), else by joins.

By joins, a lookback is whole days and two rims. Edges are summed to a row for each wallet, market and day first: whole days of a
lookback meet these sums, in buckets of time as long as the lookback, so that a market or wallet with many edges is met by
the part of them that lies near. Only the days at the rims, which a lookback cuts, meet the edges themselves, by their day.
What several steps read is written once; what is met is dealt out by decision once, and all counts of a decision are taken
where its rows then lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Graph
from ..functions import scalars as S
from ..session import written
from .spans import Clock, Present

#: Amounts are added as whole numbers and billionths, so that no order of addition shows.
_PARTS = ("whole", "rest")


def _day(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int")


def day_sums(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their day and amount in parts, and their sums by wallet, market, event and day."""
    amount = F.greatest(F.lit(0.0), F.coalesce(F.col("notional").cast("double"), F.lit(0.0)))
    parts = {"whole": F.floor(amount), "rest": F.round((amount - F.floor(amount)) * 1e9).cast("long"), "day": _day(F.col("ts"))}
    raw = edges.where("wallet is not null and market_id is not null and ts is not null").withColumns(parts).select("wallet", "market_id", "event_id", "ts", "day", *_PARTS)
    return raw, _summed(raw)


def _summed(raw: DataFrame) -> DataFrame:
    return raw.groupBy("wallet", "market_id", "event_id", "day").agg(*(F.sum(p).alias(p) for p in _PARTS))


def lookback(left: DataFrame, key: str, other: str, raw: DataFrame, days: DataFrame, c: Graph) -> DataFrame:
    """left (key, at, other columns) with the edges of its key in the lookback before at: ``other``, event, day and amounts."""
    back = F.col("at") - F.expr(f"interval {c.lookback_days} days")
    n, first, last = F.lit(c.lookback_days), _day(back), _day(F.col("at"))
    timed = left.withColumns({"__from": first, "__to": last})
    columns = [F.col(f"l.{x}") for x in left.columns]
    found = [F.col(f"e.{other}").alias(f"met_{other}"), F.col("e.event_id").alias("met_event"), F.col("e.day").alias("day"), *(F.col(f"e.{p}").alias(p) for p in _PARTS)]
    bucket = lambda day: F.floor(day / n).cast("int")
    inner = timed.where(F.col("__to") - F.col("__from") > 1).withColumn("__b", F.explode(F.sequence(bucket(F.col("__from") + 1), bucket(F.col("__to") - 1)))).alias("l")
    sums = days.withColumn("__b", bucket(F.col("day"))).alias("e")
    inside = (F.col("e.day") > F.col("l.__from")) & (F.col("e.day") < F.col("l.__to"))
    whole = inner.join(sums, (F.col(f"l.{key}") == F.col(f"e.{key}")) & (F.col("l.__b") == F.col("e.__b")) & inside).select(*columns, *found)
    rims = timed.withColumn("__d", F.explode(F.array_distinct(F.array("__from", "__to")))).alias("l")
    cut = F.col("e.ts").between(F.col("l.at") - F.expr(f"interval {c.lookback_days} days"), F.col("l.at"))
    rim = rims.join(raw.alias("e"), (F.col(f"l.{key}") == F.col(f"e.{key}")) & (F.col("l.__d") == F.col("e.day")) & cut).select(*columns, *found)
    return whole.unionByName(rim)


#: Edges and decisions that meet in a task, at most; where a slice of time has more, features are taken by joins.
SLICE_ROWS = 4_000_000
#: Pairs of spans of a wallet that are looked at together.
PAIRS_HELD = 4_000_000
_COUNTS = ("deg", "repeated", "crossed", "same_event", "days", "lasting", "c", "same", "around", "pairs", "whole", "rest", "home_whole", "home_rest")


def features(decisions: DataFrame, edges: DataFrame, c: Graph = Graph(), slice_rows: int | None = None) -> DataFrame:
    """A row for each decision. decisions: id, market_id, event_id, ts. edges: wallet, market_id, event_id, ts, notional.

    W are the wallets on the decision's market, C that market and all markets of W, CW the wallets on C. A decision
    without wallets has zeros. Edges without a wallet, a market or a time count nowhere; missing and negative amounts are 0.

    Time is cut into slices of half a lookback; a task has a slice's decisions and the edges that they can see. An edge is
    there for the time of a lookback, a wallet on a market while one of its edges is, and so on: numbers are those of spans
    at a moment, so that decisions don't meet edges. That is for slices of at most slice_rows; else see ``_by_joins``.
    """
    raw = written(day_sums(edges)[0])
    reach = c.lookback_days * 86_400_000_000
    us, half = F.unix_micros("ts"), reach // 2
    number = lambda x: F.floor(x / half).cast("long")
    near = raw.select("wallet", "market_id", "event_id", us.alias("us"), "day", *_PARTS, F.explode(F.sequence(number(us), number(us + reach))).alias("slice"))
    asked = decisions.select("id", "market_id", "event_id", us.alias("us"), number(us).alias("slice"))
    timed = F.col("market_id").isNotNull() & F.col("us").isNotNull()
    sizes = near.select("slice").unionByName(asked.where(timed).select("slice")).groupBy("slice").count()
    if (sizes.agg(F.max("count")).first()[0] or 0) > (SLICE_ROWS if slice_rows is None else slice_rows):
        return _by_joins(decisions, raw, c)
    kind = f"id {decisions.schema['id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in _COUNTS)}"
    own = asked.where(timed)
    out = own.groupBy("slice").cogroup(near.groupBy("slice")).applyInArrow(_counted(reach, half, c.persistent_days), kind)
    out = out.unionByName(asked.where(~timed).select("id", *(F.lit(0).cast("long").alias(n) for n in _COUNTS)))
    share = lambda x, of="deg": F.round(S.safe_ratio(F.col(x), F.col(of)), 6)
    amount = lambda prefix: F.col(f"{prefix}whole").cast("double") + F.col(f"{prefix}rest") / 1e9
    return out.select(
        "id", F.col("deg").alias("market_wallet_degree"), F.greatest(F.lit(0), F.col("c") - 1).alias("related_market_count"), F.col("around").alias("cluster_wallet_count"),
        F.round(S.safe_ratio(F.col("pairs"), F.col("around") * F.col("c")), 6).alias("cluster_density_2hop"), share("same", "c").alias("same_event_market_share"),
        share("repeated").alias("repeat_wallet_share"), share("crossed").alias("cross_event_wallet_share"), share("same_event").alias("same_event_repeat_wallet_share"), share("days").alias("wallet_persistence_mean_days"),
        share("lasting").alias("persistent_wallet_share"), F.round(S.safe_ratio(amount("home_"), amount("")), 6).alias("cluster_notional_share"))


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], int]:
    """The columns' values as numbers, the same in all of them, -1 for null; and how many values there are."""
    whole = pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    every = pc.fill_null(whole.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(every, np.cumsum([len(c) for c in columns])[:-1]), len(whole.dictionary)


def _together(a: np.ndarray, b: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers for pairs (b from -1 to below of), and the pairs' two sides."""
    pairs, back = np.unique(a * (of + 1) + b + 1, return_inverse=True)
    return back, pairs // (of + 1), pairs % (of + 1) - 1


def _counted(reach: int, half: int, lasting: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The numbers of a slice's decisions."""

    def of(asked: pa.Table, edges: pa.Table) -> pa.Table:
        (home, market), markets = _codes(asked["market_id"], edges["market_id"])
        (wanted, event), events = _codes(asked["event_id"], edges["event_id"])
        (wallet,), _ = _codes(edges["wallet"])
        t, us = asked["us"].to_numpy(), edges["us"].to_numpy()
        out = {n: np.zeros(len(t), np.int64) for n in _COUNTS}
        if len(t) and len(us):
            _fill(out, home, wanted, t, market, event, wallet, us, *(edges[n].to_numpy() for n in ("day", *_PARTS)), markets, events)
        return pa.table([asked["id"], *(pa.array(out[n], pa.int64()) for n in _COUNTS)], names=["id", *_COUNTS])

    def _fill(out, home, wanted, t, market, event, wallet, us, day, whole, rest, markets, events):  # noqa: ANN001, ANN202
        low = t.min() // half * half
        start, end = np.maximum(us, low), np.minimum(us + reach + 1, low + half)
        times = np.unique(np.concatenate((start, end, t)))
        start, end, t = (np.searchsorted(times, x) for x in (start, end, t))
        clock = Clock(len(times))
        on, on_wallet, on_market = _together(wallet, market, markets)
        kind, kind_market, kind_event = _together(market, event, events)
        fact, fact_wallet, fact_kind = _together(wallet, kind, len(kind_market))
        # a wallet on a market: w, m, a, b; by event as well: fw, fk, fa, fb
        x, a, b = clock.union(on, start, end)
        w, m = on_wallet[x], on_market[x]
        x, fa, fb = clock.union(fact, start, end)
        fw, fk = fact_wallet[x], fact_kind[x]
        fm, fe = kind_market[fk], kind_event[fk]
        out["deg"] += clock.present(m, a, b).at(home, t)[0]

        def among(spans, least):  # noqa: ANN001, ANN202
            own, _, s, e = clock.overlaps(w, a, b, tuple(y[spans[3] >= least] for y in spans[:3]))
            return clock.present(m[own], s, e).at(home, t)[0]

        out["repeated"] += among(clock.levels(w, a, b), 2)
        known = event >= 0
        x, owner, _ = _together(wallet[known], event[known], events)
        x, s, e = clock.union(x, start[known], end[known])
        out["crossed"] += among(clock.levels(owner[x], s, e), 2)
        x, owner, _ = _together(wallet, np.unique(day, return_inverse=True)[1], len(day))
        x, s, e = clock.union(x, start, end)
        spans = clock.levels(owner[x], s, e)
        out["lasting"] += among(spans, lasting)
        own, other, s, e = clock.overlaps(w, a, b, spans[:3])
        out["days"] += clock.present(m[own], s, e, spans[3][other]).at(home, t)[1]
        _, out["home_whole"][:], out["home_rest"][:] = clock.present(market, start, end, whole, rest).at(home, t)
        by_market, by_event = np.argsort(m, kind="stable"), np.argsort(fe, kind="stable")
        by_wallet = np.argsort(fw, kind="stable")
        part = lambda order, keys, k: order[np.searchsorted(keys, k) : np.searchsorted(keys, k, "right")]
        m_sorted, fe_sorted, fw_sorted = m[by_market], fe[by_event], fw[by_wallet]
        rows = np.argsort(home, kind="stable")
        known_around: dict[bytes, tuple[Present, Present, Present]] = {}
        for h in np.unique(home):
            own, d = part(by_market, m_sorted, h), part(rows, home[rows], h)
            if not len(own):
                continue
            zero = np.zeros(len(d), np.int64)
            # C by market and event: where a wallet of the home is on both
            cluster = (zero[:0],) * 3
            first, last = np.searchsorted(fw_sorted, w[own]), np.searchsorted(fw_sorted, w[own], "right")
            ends = np.cumsum(last - first)
            for run in np.split(np.arange(len(own)), np.unique(np.searchsorted(ends, np.arange(PAIRS_HELD, ends[-1], PAIRS_HELD)))):
                n = (last - first)[run]
                mine = np.repeat(run, n)
                met = by_wallet[np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + first[mine]]
                s, e = np.maximum(a[own[mine]], fa[met]), np.minimum(b[own[mine]], fb[met])
                cluster = clock.union(*(np.concatenate((old, new[s < e])) for old, new in zip(cluster, (fk[met], s, e), strict=True)))
            for he in np.unique(wanted[d]):
                if he < 0:
                    continue
                q, in_event = d[wanted[d] == he], part(by_event, fe_sorted, he)
                in_event = in_event[fm[in_event] != h]
                pieces = clock.overlaps(w[own], a[own], b[own], clock.union(fw[in_event], fa[in_event], fb[in_event]))
                out["same_event"][q] = clock.present(zero[:1].repeat(len(pieces[0])), *pieces[2:]).at(zero[: len(q)], t[q])[0]
                x = kind_event[cluster[0]] == he
                out["same"][q] = clock.present(zero[:1].repeat(int(x.sum())), cluster[1][x], cluster[2][x]).at(zero[: len(q)], t[q])[0]
            c = clock.union(kind_market[cluster[0]], *cluster[1:])
            out["c"][d] = clock.present(zero[:1].repeat(len(c[0])), *c[1:]).at(zero, t[d])[0]
            told = b"".join(y.tobytes() for y in c)
            if told not in known_around:
                x, _, s, e = clock.overlaps(m, a, b, c)
                people = clock.union(w[x], s, e)
                y, _, s2, e2 = clock.overlaps(market, start, end, c)
                none = np.zeros(max(len(x), len(y)), np.int64)
                known_around = {told: (clock.present(none[: len(x)], s, e), clock.present(none[: len(people[0])], *people[1:]), clock.present(none[: len(y)], s2, e2, whole[y], rest[y]))}
            pairs, people, amounts = known_around[told]
            out["pairs"][d], out["around"][d] = pairs.at(zero, t[d])[0], people.at(zero, t[d])[0]
            _, out["whole"][d], out["rest"][d] = amounts.at(zero, t[d])

    return of


def _by_joins(decisions: DataFrame, raw: DataFrame, c: Graph) -> DataFrame:
    """The features by joins of decisions, sums of whole days, and edges at the rims: whatever the number of rows in a lookback."""
    days = written(_summed(raw))
    home = decisions.select("id", "market_id", F.col("event_id").alias("home_event"), F.col("ts").alias("at"))
    own = lookback(home, "market_id", "wallet", raw, days, c).select("id", F.col("market_id").alias("home"), "home_event", "at", F.col("met_wallet").alias("wallet"))
    own = written(own.distinct())
    hop1 = written(lookback(own, "wallet", "market_id", raw, days, c).drop(*_PARTS).repartition("id"))
    other = F.coalesce((F.col("met_market_id") != F.col("home")) & (F.col("met_event") == F.col("home_event")), F.lit(False))
    by_wallet = hop1.groupBy("id", "wallet").agg(
        F.size(F.collect_set("met_market_id")).alias("markets"), F.size(F.collect_set("met_event")).alias("events"), F.size(F.collect_set("day")).alias("days"), F.bool_or(other).alias("same_event"))
    share = lambda x: F.round(F.avg(x.cast("double")), 6)
    wallets = by_wallet.groupBy("id").agg(
        F.count("*").alias("market_wallet_degree"), share(F.col("markets") > 1).alias("repeat_wallet_share"), share(F.col("events") > 1).alias("cross_event_wallet_share"),
        share(F.col("same_event")).alias("same_event_repeat_wallet_share"), share(F.col("days")).alias("wallet_persistence_mean_days"), share(F.col("days") >= c.persistent_days).alias("persistent_wallet_share"))
    near = hop1.groupBy("id", "home", "at", F.col("met_market_id").alias("market_id")).agg(F.bool_or(F.coalesce(F.col("met_event") == F.col("home_event"), F.lit(False))).alias("same"))
    near = written(near)
    markets = near.groupBy("id").agg(F.count("*").alias("c"), share(F.col("same")).alias("same_event_market_share"))
    hop2 = lookback(near.select("id", "home", "at", "market_id"), "market_id", "wallet", raw, days, c).drop("met_event", "day", "at").repartition("id")
    pairs = hop2.groupBy("id", "home", "market_id", "met_wallet").agg(*(F.sum(p).alias(p) for p in _PARTS))
    cluster = pairs.groupBy("id", "met_wallet").agg(
        F.count("*").alias("pairs"), *(F.sum(p).alias(p) for p in _PARTS), *(F.sum(F.when(F.col("market_id") == F.col("home"), F.col(p)).otherwise(0)).alias(f"home_{p}") for p in _PARTS))
    amount = lambda prefix: F.sum(f"{prefix}whole").cast("double") + F.sum(f"{prefix}rest") / 1e9
    around = cluster.groupBy("id").agg(F.count("*").alias("cluster_wallet_count"), F.sum("pairs").alias("pairs"), F.round(S.safe_ratio(amount("home_"), amount("")), 6).alias("cluster_notional_share"))
    out = decisions.select("id").join(wallets, "id", "left").join(markets, "id", "left").join(around, "id", "left").na.fill(0)
    density = F.round(S.safe_ratio(F.col("pairs"), F.col("cluster_wallet_count") * F.col("c")), 6)
    return out.select(
        "id", "market_wallet_degree", F.greatest(F.lit(0), F.col("c") - 1).alias("related_market_count"), "cluster_wallet_count", F.coalesce(density, F.lit(0.0)).alias("cluster_density_2hop"), "same_event_market_share",
        "repeat_wallet_share", "cross_event_wallet_share", "same_event_repeat_wallet_share", "wallet_persistence_mean_days", "persistent_wallet_share", "cluster_notional_share")
