"""The detector on a seeded hour of two markets: batch, stream, and both against each other."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.config import Detector
from tidewatch.operators import detector as X
from tidewatch.session import streaming
from tidewatch.streaming import detector as ST

EVENT = ST.EVENT


def t(minute, second=0):
    return dt.datetime(2026, 4, 20, 5, minute, second)


TRADES = [
    ("A", t(2), "a_old1", "BUY", 60.0), ("A", t(2, 10), "a_old2", "SELL", 40.0), ("A", t(6), "a_fresh1", "BUY", 180.0), ("A", t(6, 10), "a_fresh2", "BUY", 80.0), ("A", t(6, 20), "a_fresh3", "BUY", 40.0),
    ("B", t(14), "b_old1", "BUY", 70.0), ("B", t(14, 10), "b_old2", "SELL", 30.0), ("B", t(18), "b_fresh1", "BUY", 160.0), ("B", t(18, 10), "b_fresh2", "BUY", 90.0), ("B", t(18, 20), "b_fresh3", "BUY", 50.0),
]
QUOTES = [("A", t(0), 0.40), ("A", t(2), 0.42), ("A", t(4), 0.46), ("A", t(5, 30), 0.52), ("B", t(12), 0.35), ("B", t(14), 0.37), ("B", t(16), 0.44), ("B", t(17, 30), 0.50)]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(m, ts, "quote", None, None, None, None, p) for m, ts, p in QUOTES] + [(m, ts, "trade", w, s, "YES", n, None) for m, ts, w, s, n in TRADES]
    rows.sort(key=lambda r: (r[1], r[2]))
    return spark.createDataFrame([(i, r[2], r[0], r[1], *r[3:]) for i, r in enumerate(rows)], EVENT)


def check(found):
    sent = sorted((r for r in found if r.emitted), key=lambda r: r.market_id)
    assert [(r.market_id, r.ts) for r in sent] == [("A", t(6)), ("B", t(18))]
    assert len(found) - len(sent) == 4
    a, b = sent
    assert a.severity == pytest.approx(15.127473, abs=2e-6) and b.severity == pytest.approx(17.29381, abs=2e-5)
    assert (a.fresh_count, a.fresh_share, a.imbalance, a.concentration) == (3, 1.0, 0.714286, 0.642857)
    assert (a.velocity, a.acceleration, a.volume_acceleration) == (0.028571, 0.028571, 2.0)
    assert (b.imbalance, b.concentration, b.velocity) == (0.769231, 0.615385, 0.037143)
    assert all(len(r.rules) == 3 for r in sent)


def test_batch(events):
    check(X.cooled(X.candidates(events)).collect())


def run(df, folder, name):
    """A stream run to its end, as rows."""
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/{name}")
    q.awaitTermination(240)
    assert q.exception() is None
    return f"{folder}/{name}"


def streamed(spark, parts, folder, **options):
    """Candidates of events that come part by part; both queries stop after each part and go on from their checkpoints."""
    streaming(spark)
    for part in parts:
        part.coalesce(1).sortWithinPartitions("seq").write.mode("append").json(f"{folder}/in")
        seen = run(ST.with_first_seen(spark.readStream.schema(EVENT).json(f"{folder}/in")), folder, "seen")
        found = run(ST.detect(spark.readStream.schema(ST.SEEN).parquet(seen), **options), folder, "found")
    return spark.read.schema(ST.CANDIDATE).parquet(found)


def test_stream(spark, events, tmp_path):
    found = streamed(spark, [events.where("seq < 7"), events.where("seq >= 7")], f"file://{tmp_path}")
    check(found.collect())
    batch = X.cooled(X.candidates(events)).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))


def test_probability_filter(spark, events, tmp_path):
    """Candidates outside the band go before the cooldown; a market without a probability stays."""
    known = spark.createDataFrame([("A", 0.97), ("C", 0.5)], "market_id string, yes_probability double")
    found = streamed(spark, [events], f"file://{tmp_path}", probabilities=known)
    batch = X.cooled(X.candidates(events, probabilities=known)).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect())) != []
    assert {r.market_id for r in found.collect()} == {"B"}


def test_silent_market(spark, events, tmp_path):
    """The timers of markets without further events free their state."""
    streaming(spark)
    events.withColumn("first_seen", F.col("ts")).coalesce(1).write.json(f"{tmp_path}/in")
    found = ST.detect(spark.readStream.schema(ST.SEEN).json(f"{tmp_path}/in"), idle_s=2)
    q = found.writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    kept, ends = [], time.time() + 90
    while time.time() < ends and not (kept and max(kept) > 0 and kept[-1] == 0):
        time.sleep(1)
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert max(kept) > 0 and kept[-1] == 0 and spark.table("silent").where("emitted").count() == 2


def plainly(rows, c):
    """What each trade's windows hold, by looking at all points again at every trade."""
    out, trades, prices, first = [], {}, {}, {}
    reach, far = c.window_s * 1_000_000, max(c.history_s, 2 * c.window_s) * 1_000_000

    def velocity(points):
        points = sorted(points, key=lambda p: p[0])
        return (points[-1][1] - points[0][1]) / ((points[-1][0] - points[0][0]) / 60e6) if points and points[-1][0] > points[0][0] else 0.0

    for seq, market, ts, wallet, side, outcome, notional, price in sorted(rows):
        if market is None or ts is None:
            continue
        own, quotes = trades.setdefault(market, []), prices.setdefault(market, [])
        if wallet is not None and notional is not None:
            first.setdefault(wallet, ts)
        if notional is not None:
            own.append((ts, wallet, side, outcome, notional, first.get(wallet)))
        if price is not None:
            quotes.append((ts, price))
        own[:] = [p for p in own if p[0] >= ts - far]
        quotes[:] = [p for p in quotes if p[0] >= ts - far]
        if notional is None:
            continue
        start = ts - reach
        now, past = [p for p in own if p[0] >= start], [p for p in own if start - reach <= p[0] < start]
        total = sum(p[4] for p in now)
        if total < c.min_notional:
            continue
        by, outcomes = {}, {}
        for p in now:
            if p[1] is not None:
                by[p[1]] = by.get(p[1], 0) + p[4]
            if p[3] is not None:
                outcomes[p[3]] = outcomes.get(p[3], 0) + p[4]
        fresh = [p for p in now if p[1] is not None and p[5] >= start]
        side = lambda s: sum(p[4] for p in now if p[2] == s)  # noqa: B023, E731
        seen = [p for p in quotes if p[0] >= start]
        v, before = velocity(seen), velocity([p for p in quotes if start - reach <= p[0] < start])
        earlier, times = sum(p[4] for p in past), [p[0] for p in now] + [p[0] for p in seen]
        active = max(outcomes, key=outcomes.get) if outcomes else None
        out.append((seq, len({p[1] for p in fresh}), sum(p[4] for p in fresh) / total, abs(side("BUY") - side("SELL")) / total, max(by.values(), default=0) / total, v, v - before,
                    total / earlier if earlier > 0 else 2.0, total, earlier, active, outcomes.get(active, 0), len(by), len(now), len(seen), min(times), max(times)))
    return out


_COMPARED = "seq fresh_count fresh_share imbalance concentration velocity acceleration volume_acceleration notional previous_notional active_side active_notional n_wallets n_trades n_prices".split()


def random_points(rng, n, markets, spread, late):
    """Points whose times ascend by up to spread seconds, stand still, or fall back."""
    rows, now = [], dict.fromkeys(markets, 0)
    for i in range(n):
        m = rng.choice(markets)
        if m is not None:
            now[m] += rng.choice((0, 0, 1, spread)) * 1_000_000
        ts = None if rng.random() < 0.02 else now.get(m, 0) - (rng.randrange(3 * spread) * 1_000_000 if rng.random() < late else 0)
        trade = rng.random() < 0.8
        wallet = rng.choice((None, *"abcdefgh")) if trade else None
        rows.append((i, m, ts, wallet, rng.choice((None, "BUY", "SELL")), rng.choice((None, "YES", "NO")), float(rng.randrange(1, 40)) if trade else None, rng.random() if rng.random() < 0.7 else None))
    return rows


@pytest.mark.parametrize("late", [0.0, 0.3])
def test_windows_against_a_loop(spark, late):
    """Equal times, late points, quotes, missing fields, few rows in a block, and a history of another length."""
    rng = random.Random(7)
    for history, block_rows in ((20, 10_000), (75, 60)):
        c = Detector(window_s=30, history_s=history, min_notional=25.0)
        rows = random_points(rng, 500, ("m", "n", None), 20, late)
        df = spark.createDataFrame([(*r[:2], r[2], *r[3:]) for r in rows], "seq long, market_id string, t long, wallet string, side string, outcome_side string, notional double, price double")
        df = df.withColumn("ts", F.timestamp_micros("t")).drop("t")
        got = X.features(df.repartition(3), c, block_rows).withColumns({n: F.unix_micros(n) for n in ("episode_start", "episode_end")}).orderBy("seq").collect()
        want = sorted(plainly(rows, c))
        assert len(got) == len(want) > 100
        for g, w in zip(got, want, strict=True):
            assert [g[n] for n in _COMPARED] == [pytest.approx(x, abs=1.1e-6) if isinstance(x, float) else x for x in w[:15]]
            assert (g.episode_start, g.episode_end) == w[15:]


def test_hot_market(spark):
    """A hundred thousand trades of one market in one window."""
    df = spark.range(100_000).select(F.col("id").alias("seq"), F.lit("m").alias("market_id"), F.timestamp_micros(F.col("id") * 2900).alias("ts"), F.concat(F.lit("w"), F.col("id") % 997).alias("wallet"),
                                     F.lit("BUY").alias("side"), F.lit("YES").alias("outcome_side"), F.lit(0.25).alias("notional"), F.lit(0.5).alias("price"))
    began = time.time()
    rows = X.features(df).where("seq = 99999").collect()
    assert time.time() - began < 60
    assert [(r.n_trades, r.n_wallets, r.notional, r.concentration) for r in rows] == [(100_000, 997, 25_000.0, 0.00101)]


def test_escalation(spark):
    rows = [(i, "m", dt.datetime(2026, 1, 1, 0, i), s, ["r"]) for i, s in enumerate([1.0, 1.1, 1.3, 1.4, 1.7])]
    found = spark.createDataFrame(rows, "seq long, market_id string, ts timestamp, severity double, rules array<string>")
    assert [r.emitted for r in X.cooled(found).orderBy("seq").collect()] == [True, False, True, False, True]


def test_melted(spark, events):
    out = X.melted(X.features(events), ("imbalance",))
    assert out.where(F.col("feature_name") != "imbalance").count() == 0 and out.count() == X.features(events).count()
