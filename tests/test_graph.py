"""Graph features against nested loops."""

import datetime as dt
import random

import pytest

from tidewatch.config import Graph
from tidewatch.operators import graph


def plainly(decisions, edges, days, persistent=2):
    out = {}
    for i, home, event, at in decisions:
        near = [e for e in edges if None not in (e[0], e[1], e[3], at) and at - dt.timedelta(days=days) <= e[3] <= at]
        own = {e[0] for e in near if e[1] == home}
        mine = {w: [e for e in near if e[0] == w] for w in own}
        markets = {e[1] for es in mine.values() for e in es}
        same = {e[1] for es in mine.values() for e in es if e[2] is not None and e[2] == event}
        sums = {}
        for e in near:
            if e[1] in markets:
                sums[e[1], e[0]] = sums.get((e[1], e[0]), 0) + max(0, e[4] or 0)
        wallets = {w for _, w in sums}
        n = len(own) or 1
        share = lambda f: round(sum(f(es) for es in mine.values()) / n, 6)  # noqa: B023, E731
        total = sum(sums.values())
        out[i] = (
            len(own), max(0, len(markets) - 1), len(wallets), round(len(sums) / (len(wallets) * len(markets)), 6) if sums else 0, round(len(same) / len(markets), 6) if markets else 0,
            share(lambda es: len({e[1] for e in es}) > 1), share(lambda es: len({e[2] for e in es} - {None}) > 1), share(lambda es: any(e[1] != home and e[2] is not None and e[2] == event for e in es)),  # noqa: B023
            share(lambda es: len({e[3].date() for e in es})), share(lambda es: len({e[3].date() for e in es}) >= persistent), round(sum(v for (m, _), v in sums.items() if m == home) / total, 6) if total else 0,  # noqa: B023
        )
    return out


@pytest.mark.parametrize("days", [1, 3, 8])
def test_features(spark, days):
    """Rims, whole days, a market with half of all edges, missing keys, events and amounts, and decisions without wallets."""
    rng = random.Random(days)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.choice((0, 30)) + 60 * rng.randrange(24 * 12))
    markets = {m: rng.choice(("x", "y", None)) for m in "abcdef"}
    edges = [(rng.choice((None, *"pqrstuvw")), m := rng.choice((None, "a", "a", "a", "a", *"bcde")), markets.get(m), at(), rng.choice((None, -1.0, 0.125, 3.0))) for _ in range(300)]
    edges += edges[:40]
    decisions = [(i, m := rng.choice("abcf"), markets[m], at()) for i in range(60)] + [(90, None, "x", at()), (91, "a", "x", None)]
    e = spark.createDataFrame(edges, "wallet string, market_id string, event_id string, ts timestamp, notional double").repartition(3)
    d = spark.createDataFrame(decisions, "id long, market_id string, event_id string, ts timestamp")
    got = {r.id: tuple(r)[1:] for r in graph.features(d, e, Graph(lookback_days=days)).collect()}
    want = plainly(decisions, edges, days)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=1.1e-6), i


def test_whole_days_meet_sums(spark):
    """A thousand edges of a wallet on a market in a day are one row where whole days are met."""
    rows = [("p", "a", "x", dt.datetime(2026, 1, 5, 0, 0, i % 60), 1.0) for i in range(1000)]
    e = spark.createDataFrame(rows, "wallet string, market_id string, event_id string, ts timestamp, notional double")
    raw, sums = graph.day_sums(e)
    assert (raw.count(), sums.count()) == (1000, 1)
    left = spark.createDataFrame([(1, "a", dt.datetime(2026, 1, 8))], "id long, market_id string, at timestamp")
    met = graph.lookback(left, "market_id", "wallet", raw, sums, Graph(lookback_days=5)).collect()
    assert [(r.met_wallet, r.whole) for r in met] == [("p", 1000)]


@pytest.mark.parametrize("days", [1, 2, 5])
def test_slices_and_joins(spark, days, monkeypatch):
    """Both ways give what loops give; events differ among a market's edges and decisions; slices make no joins."""
    rng = random.Random(days)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=30 * rng.randrange(24 * 12))
    edges = [(rng.choice("pqrstuvw"), rng.choice("aabcdef"), rng.choice(("x", "y", None)), at(), rng.choice((None, 2.5, 1e9))) for _ in range(250)]
    decisions = [(i, rng.choice((*"aabcfz", None)), rng.choice(("x", "y", "z", None)), at()) for i in range(80)]
    decisions += decisions[:5]
    e = spark.createDataFrame(edges, "wallet string, market_id string, event_id string, ts timestamp, notional double")
    d = spark.createDataFrame(decisions, "id long, market_id string, event_id string, ts timestamp")
    want = plainly(decisions, edges, days)
    sliced = graph.features(d, e, Graph(lookback_days=days))
    assert "Join" not in sliced._jdf.queryExecution().executedPlan().toString() and sliced.count() == len(decisions)
    joined = graph.features(d.distinct(), e, Graph(lookback_days=days), slice_rows=10)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    for out in (sliced, joined):
        got = {r.id: tuple(r)[1:] for r in out.collect()}
        assert set(got) == set(want)
        for i, x in want.items():
            assert got[i] == pytest.approx(x, abs=1.1e-6), i
    assert graph.features(d.limit(0), e).count() == 0 and graph.features(d, e.limit(0)).count() == len(decisions)
