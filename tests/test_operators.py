"""Operators on small cases with known results, and edge cases."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import alerts as A
from tidewatch.operators import evaluation as E
from tidewatch.operators import detector as X
from tidewatch.operators import joins as J
from tidewatch.operators import ml as M
from tidewatch.operators import trades as T
from tidewatch.operators import wallets as W
from tidewatch.sources import log

DAY = dt.datetime(2026, 4, 20)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "detector", "trade", "push"), [
    ("2023-11-14T22:13:20Z", 1700000000, 1700000000, 1700000000), ("1700000000", 1700000000, 1700000000, 1700000),
    ("1700000000000", 1700000000, 1700000000, 1700000000), ("1700000000.5", 1700000, 1700000000, 1700000), ("junk", None, None, None), ("", None, None, None),
])
def test_timestamps(spark, text, detector, trade, push):
    row = spark.createDataFrame([(text,)], "t string").select(*(F.floor(F.unix_micros(f(F.col("t"))) / 1000000) for f in (S.detector_timestamp, S.trade_timestamp, S.push_timestamp))).first()
    assert tuple(row) == (detector, trade, push)


def test_scalars(spark):
    assert one(spark, S.is_present(F.lit(" "))) is False and one(spark, S.is_present(F.lit(None))) is False
    assert one(spark, S.direction(F.lit(0.0))) == "NO" and one(spark, S.direction(F.lit(None).cast("double"))) is None
    assert one(spark, S.in_probability_band(F.lit(None).cast("double"))) is True
    assert one(spark, S.json_doubles(F.lit('["0.5", 2]'))) == [0.5, 2.0] and math.isnan(one(spark, S.json_doubles(F.lit('["x"]')))[0])
    assert one(spark, S.json_strings(F.lit('["a", "", null]'))) == ["a"] and one(spark, S.json_strings(F.lit("x"))) == []
    assert one(spark, S.yes_probability(F.array(F.lit("No"), F.lit("Yes")), F.array(F.lit(0.2)))) is None


def test_upsert_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"t{rng.randrange(30)}", i, rng.randrange(1, 4), rng.random(), rng.choice([None, rng.random()])) for i in range(400)]
    state = {}
    for k, _, p, size, amount in rows:
        old = state.get(k)
        if old is None or p >= old[0]:
            state[k] = (p, size, amount if amount is not None else old and old[2])
    df = spark.createDataFrame(rows, "trade_id string, seq long, priority int, size double, notional double")
    got = {r.trade_id: (r.priority, r["size"], r.notional) for r in T.upserted(df, "seq", ("size",), ("notional",)).collect()}
    assert got == state


def test_sessions_keep_the_exact_gap(spark):
    rows = [("m", "c", at(0), "1", "w", 1.0), ("m", "c", at(1800), "2", "w", 1.0), ("m", "c", at(3601), "3", "w", 1.0), (None, "c", at(0), "4", "w", 1.0)]
    df = spark.createDataFrame(rows, "market_id string, condition_id string, ts timestamp, trade_id string, wallet string, notional double")
    assert [r.n_trades for r in T.sessions(df).orderBy("episode").collect()] == [2, 1]


def test_as_of(spark):
    left = spark.createDataFrame([(1, "m", at(10)), (2, "m", at(5)), (3, "x", at(10)), (4, None, at(1))], "id long, k string, ts timestamp")
    right = spark.createDataFrame([(7, "m", at(10), 1), (8, "m", at(10), 2), (9, "m", at(6), 1)], "q long, k string, ts timestamp, tie long")
    back = {r.id: r.v and r.v.q for r in J.as_of(left, right, "k", "v", tie="tie").collect()}
    assert back == {1: 8, 2: None, 3: None, 4: None}
    forward = {r.id: r.v and r.v.q for r in J.as_of(left, right, "k", "v", forward=True, within_s=3, tie="tie").collect()}
    assert forward == {1: 7, 2: 9, 3: None, 4: None}


def test_range_join_buckets(spark):
    rng = random.Random(2)
    left = [(i, "k", at(a := rng.randrange(1000)), at(a + rng.randrange(200))) for i in range(60)]
    right = [(i, "k", at(rng.randrange(1200))) for i in range(60)]
    got = J.in_range(spark.createDataFrame(left, "id long, k string, a timestamp, b timestamp"), spark.createDataFrame(right, "rid long, k string, ts timestamp"), "k", "a", "b", 60)
    assert sorted((r.id, r.rid) for r in got.collect()) == sorted((i, j) for i, _, a, b in left for j, _, t in right if a <= t <= b)


@pytest.mark.parametrize("span", [60, 3000])
def test_met_counts_against_a_loop(spark, span):
    """Equal times, ends of the reach, gaps of many reaches, missing keys and values, rows that come twice; and no pairs."""
    rng = random.Random(span)
    left = [(i, rng.choice((None, *"aab")), at(rng.randrange(span)) if i % 30 else None) for i in range(120)]
    left += left[5:20]
    right = [(rng.choice((None, *"aabc")), at(rng.randrange(span)), rng.choice((None, *"uvwxyz"))) for _ in range(150)]
    right += right[:30] + [("b", at(-10_000), "u")]
    df = J.met_counts(spark.createDataFrame(left, "id long, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, w string"), "k", "w", 20)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, k, t in left:
        near = [(r, w) for m, r, w in right if k and t and m == k and t - dt.timedelta(seconds=20) <= r <= t]
        if near:
            want[i] = (want.get(i, (0, 0))[0] + len(near), len({w for _, w in near} - {None}))
    assert {r.id: (r.n, r.distinct) for r in df.collect()} == want
    none = spark.createDataFrame([], "k string, ts timestamp, w string")
    assert J.met_counts(spark.createDataFrame(left, "id long, k string, ts timestamp"), none, "k", "w", 20).count() == 0
    assert J.met_counts(spark.createDataFrame([], "id long, k string, ts timestamp"), none, "k", "w", 20).count() == 0


def test_suppression_counts_suppressed(spark):
    rows = [(1, at(0), "event:e", 1), (2, at(3000), "event:e", 1), (3, at(6000), "event:e", 1), (4, at(6001), "event:e", 2), (5, at(20000), "event:e", 0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, suppression_key string, rank int")
    assert [r.suppressed for r in A.suppressed(df).orderBy("id").collect()] == [False, True, True, False, False]


def test_budgets(spark):
    rows = [(i, at(i * 30), "chat", True) for i in range(20)] + [(99, at(4000), "chat", True)]
    got = A.delivered(spark.createDataFrame(rows, "id long, ts timestamp, channel string, eligible boolean"))
    assert [r.id for r in got.where("delivered").orderBy("id").collect()] == [0, 2, 4, 6, 8, 10, 99]


def test_paper_trades(spark):
    """The two-market continuation: one resolved, one stopped."""
    h = lambda hour, minute, second=0: dt.datetime(2026, 4, 20, hour, minute, second)
    alerts = spark.createDataFrame([(1, "A", h(5, 6, 45), "YES", h(7, 45), "YES"), (2, "B", h(5, 18, 45), "YES", h(8, 15), "NO"), (3, "C", h(5, 0), "YES", None, None)], "id long, market_id string, ts timestamp, direction string, resolved_ts timestamp, resolution string")
    quotes = spark.createDataFrame([("A", h(5, 6, 50), 0.54), ("A", h(5, 30), 0.58), ("A", h(6, 30), 0.71), ("B", h(5, 18, 50), 0.51), ("B", h(5, 45), 0.47), ("B", h(6, 45), 0.35)], "market_id string, ts timestamp, yes double")
    a, b, c = E.paper_trades(alerts, quotes).orderBy("id").collect()
    assert (a.entry, a.exit, a.reason, a.pnl) == (0.55, 1.0, "resolution_exit", 77.818182)
    assert (b.entry, b.exit, b.reason, b.exit_ts) == (0.52, 0.34, "risk_stop", h(6, 45))
    assert (c.entry, c.reason, c.pnl) == (None, "no_entry", None)


def plain_trade(alert, quotes, hold=dt.timedelta(hours=24)):
    i, m, ts, direction, resolved, resolution = alert
    until = max(ts + hold, resolved or ts)
    seen = sorted((q, y if direction == "YES" else 1.0 - y) for k, q, y in quotes if k == m and m and y is not None and ts <= q <= until and (resolved is None or q < resolved))
    if not seen:
        return None, None, None, "no_entry"
    at_, entry = seen[0][0], min(1.0, max(0.0, seen[0][1] + 0.01))
    for q, price in seen:
        if q > at_ and (price <= entry * 0.8 or q >= at_ + hold):
            return at_, round(entry, 6), (q, round(max(0.0, price - 0.01), 6)), "risk_stop" if price <= entry * 0.8 else "time_stop"
    if resolved:
        return at_, round(entry, 6), (resolved, 1.0 if direction == resolution else 0.0), "resolution_exit"
    return at_, round(entry, 6), None, "expired_unexitable"


@pytest.mark.parametrize("step", [600, 20_000])
def test_paper_trades_against_a_loop(spark, step):
    """Equal times, sparse and dense quotes over many slices, resolutions and keys that are missing; and no join makes pairs."""
    rng = random.Random(step)
    draw = lambda: at(rng.randrange(120) * step)
    ends = {m: rng.choice((None, draw(), at(200 * step))) for m in "abcd"}
    alerts = [(i, m := rng.choice((None, *"abcde")), draw(), rng.choice(("YES", "NO")), ends.get(m), rng.choice(("YES", "NO"))) for i in range(150)]
    quotes = [(rng.choice((None, *"aabcd")), draw(), rng.choice((None, 0.005, *(0.5 + rng.random() / 3 for _ in range(6))))) for _ in range(300)]
    df = E.paper_trades(spark.createDataFrame(alerts, "id long, market_id string, ts timestamp, direction string, resolved_ts timestamp, resolution string"), spark.createDataFrame(quotes, "market_id string, ts timestamp, yes double"))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.entry_ts, r.entry, r.exit_ts and (r.exit_ts, r.exit), r.reason) for r in df.collect()}
    want = {a[0]: plain_trade(a, quotes) for a in alerts}
    assert got == want and len({w[3] for w in want.values()}) >= 4


def test_first_at_most():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 8, 9, 64, 100):
        values = np.array([rng.choice((math.nan, *range(9))) for _ in range(n)], float)
        start, most = np.arange(n + 1), np.array([rng.randrange(-1, 9) for _ in range(n + 1)], float)
        want = [next((i for i in range(s, n) if values[i] <= m), n) for s, m in zip(start, most, strict=True)]
        assert E.first_at_most(values, start, most).tolist() == want


def test_position_limits(spark):
    rows = [(i, at(i), at(i + 100), f"f{i % 3}") for i in range(6)] + [(9, at(500), at(501), "f0")]
    got = E.limited(spark.createDataFrame(rows, "id long, entry_ts timestamp, exit_ts timestamp, family string"), "family")
    assert [r.id for r in got.where("taken").orderBy("id").collect()] == [0, 1, 2, 9]


def test_log(spark, tmp_path):
    root = str(tmp_path / "log")
    trade = '{"trades": [{"market_id": "m", "proxy_wallet": "0xAB", "side": "buy", "outcome_side": "yes", "price": "0.5", "size": "10", "trade_time": "1776664800"}]}'
    rows = [("e1", "1", "Feed A", "recent_trades_page", "t", "2026-04-20T06:00:00Z", "k1", trade), ("e2", "1", "Feed A", "events_page", "t", "2026-04-20T08:00:00Z", "k2", "{}")]
    df = spark.createDataFrame(rows, "envelope_id string, schema_version string, source_system string, entity_type string, event_type string, captured_at string, ordering_key string, payload string")
    log.append(df, root)
    got = log.read(spark, root, "2026-04-20 05:30:00", "2026-04-20 07:00:00")
    assert [r.envelope_id for r in got.collect()] == ["e1"]
    p = log.points(log.read(spark, root)).collect()
    assert [(r.kind, r.wallet, r.side, r.notional, r.ts) for r in p] == [("trade", "0xab", "BUY", 0.0, dt.datetime(2026, 4, 20, 6))]  # no amount is none


def test_pushed_frames(spark):
    """Trades and prices of pushed frames in order; NO sides, unknown events and those without a market have no points."""
    events = [
        {"event_type": "last_trade_price", "captured_at": "2026-04-20T06:00:00Z", "trade": {"market_id": "m", "proxy_wallet": "0xAB", "side": "sell", "outcome_side": "no", "usdc_notional": "7.5", "trade_time": "1776664801"}},
        {"event_type": "price_change", "captured_at": "2026-04-20T06:00:02Z", "price_changes": [{"market_id": "m", "price": "0.4", "outcome_side": "NO"}, {"market_id": "n", "price": "0.6", "outcome_side": "YES"}]},
        {"event_type": "best_bid_ask", "market_id": "m", "outcome_side": "YES", "captured_at": "2026-04-20T06:00:03Z", "best_bid_ask": {"best_bid": 0.3, "best_ask": 0.5}},
        {"event_type": "book", "market_id": None, "outcome_side": "YES", "captured_at": "2026-04-20T06:00:04Z", "book": {"best_bid": 0.3}},
        {"event_type": "book", "market_id": "m", "outcome_side": "YES", "captured_at": "2026-04-20T06:00:05Z", "book": {"best_bid": 0.35}},
        {"event_type": "other", "market_id": "m"},
    ]
    rows = [("e1", "ws_frame::market", "2026-04-20T06:00:00Z", "k1", json.dumps({"events": events})), ("e2", "events_page", "2026-04-20T06:00:00Z", "k2", "{}"), ("e3", "ws_frame::x", "2026-04-20T06:00:00Z", "k3", "junk")]
    df = spark.createDataFrame(rows, "envelope_id string, entity_type string, captured_at string, ordering_key string, payload string")
    got = [(r.kind, r.market_id, (r.ts - DAY).total_seconds() - 21600, r.wallet, r.side, r.notional, r.price) for r in log.points(df).orderBy("order_key", "pos").collect()]
    assert got == [("trade", "m", 1, "0xab", "SELL", 7.5, None), ("quote", "n", 2, None, None, None, 0.6), ("quote", "m", 3, None, None, None, 0.3), ("quote", "m", 5, None, None, None, 0.35)]
    assert [tuple(r) for r in log.ignored(df).collect()] == [("events_page", 1)]


def test_small_amounts(spark):
    """Positions of tiny sizes stay, and sums keep their decimals."""
    rows = [("w", "m", "YES", "BUY", 0.5, 0.004, 0.002), ("w", "n", "YES", "BUY", 0.5, 0.123456, 0.061728), ("w", "n", "YES", "SELL", 0.5, 0.000001, 0.0000005), ("w", "o", "NO", "BUY", 0.5, 1e-6, 5e-7)]
    df = spark.createDataFrame(rows, "wallet string, market_id string, outcome_side string, side string, price double, size double, notional double")
    got = {r.market_id: (r.net_size, r.net_notional) for r in W.positions(df).collect()}
    assert got == {"m": (0.004, 0.002), "n": (0.123455, 0.0617275), "o": (1e-6, 5e-7)}


def test_null_keys_and_bounds_match_nothing(spark):
    left = spark.createDataFrame([(1, None, at(9)), (2, "a", at(9)), (3, "b", at(9))], "id long, k string, ts timestamp")
    right = spark.createDataFrame([(None, at(1), 1), ("a", at(1), 2)], "k string, ts timestamp, v long")
    got = {r.id: r.m and r.m.v for r in J.as_of(left, right, "k", "m").collect()}
    assert got == {1: None, 2: 2, 3: None}
    ranges = spark.createDataFrame([(1, "a", at(0), at(400000)), (2, "a", None, at(9)), (3, "a", at(9), at(0)), (4, None, at(0), at(9))], "id long, k string, t0 timestamp, t1 timestamp")
    assert [(r.id, r.v) for r in J.in_range(ranges, right, "k", "t0", "t1", 86400).collect()] == [(1, 2)]


def test_content_hash(spark):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("s"))
    a, b, c, d = (M.content_hash(x, "id", "s").first() for x in (rows, rows.repartition(7), rows.where("id < 999"), rows.limit(0)))
    assert a == b and a != c and a.n == 1000 and d.n == 0 and d["hash"] == 0
    wide = spark.range(2).select(F.lit(2**62).cast("long").alias("h")).agg(F.sum(F.col("h").cast("decimal(28,0)"))).first()[0]
    assert wide == 2**63


@pytest.mark.parametrize("block_rows", [17, 1000])
def test_cooldown_against_a_loop(spark, block_rows):
    rng = random.Random(5)
    rows, now = [], {"m": 0, "n": 0}
    for i in range(300):
        m = rng.choice("mmmn")
        now[m] += rng.choice([0, 10, 300, 600, 900, 1500])
        rows.append((i, m, at(now[m]), rng.choice([1.0, 1.2, 1.6]), rng.sample(["a", "b", "c"], rng.randrange(1, 3)), i % 7))
    state, want = {}, {}
    for seq, m, ts, severity, rules, _ in rows:
        last = state.get(m)
        held = last and (ts - last[0]).total_seconds() < 900 and set(rules) & set(last[2]) and severity < 1.25 * last[1]
        want[seq] = not held
        if not held:
            state[m] = (ts, severity, rules)
    df = spark.createDataFrame(rows, "seq long, market_id string, ts timestamp, severity double, rules array<string>, other long")
    got = X.cooled(df, block_rows=block_rows)
    assert got.columns == [*df.columns, "emitted"] and {r.seq: (r.emitted, r.other) for r in got.collect()} == {s: (e, s % 7) for s, e in want.items()}


@pytest.mark.parametrize("block_rows", [17, 1000])
def test_delivery_against_a_loop(spark, block_rows):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 20, 70, 400, 4000])
        rows.append((i, at(t), rng.choice("xy"), rng.random() < 0.8))
    sent, passes, want = {"x": [], "y": []}, set(), {}
    for i, ts, channel, eligible in rows:
        s = (ts - DAY).total_seconds()
        key = (channel, int(ts.timestamp() if ts.tzinfo else s // 60))
        ok = False
        if eligible and key not in passes:
            passes.add(key)
            ok = sum(x > s - 3600 for x in sent[channel]) < 6
        if ok:
            sent[channel].append(s)
        want[i] = ok
    df = spark.createDataFrame(rows, "id long, ts timestamp, channel string, eligible boolean")
    assert {r.id: r.delivered for r in A.delivered(df, 60, block_rows=block_rows).collect()} == want


@pytest.mark.parametrize("block_rows", [17, 1000])
def test_position_limits_against_a_loop(spark, block_rows):
    rng = random.Random(7)
    rows = sorted((rng.randrange(5000), i) for i in range(200))
    rows = [(i, at(t), None if rng.random() < 0.1 else at(t + rng.choice([0, 50, 900])), f"f{rng.randrange(9)}") for t, i in rows]
    open_, want = [], {}
    for i, start, end, family in sorted(rows, key=lambda r: (r[1], r[0])):
        open_ = [(e, f) for e, f in open_ if e > start]
        want[i] = len(open_) < 5 and sum(f == family for _, f in open_) < 1
        if want[i]:
            open_.append((end or start, family))
    df = spark.createDataFrame(rows, "id long, entry_ts timestamp, exit_ts timestamp, family string")
    assert {r.id: r.taken for r in E.limited(df, "family", block_rows=block_rows).collect()} == want


@pytest.mark.parametrize("block_rows", [9, 1000])
def test_precision_threshold_against_a_loop(spark, block_rows):
    rng = random.Random(8)
    rows = [(i, rng.choice("abb") if i % 9 else None, rng.choice([None, *(x / 8 for x in range(9))]), rng.choice([0, 0, 1, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, k string, score double, label int")
    for target in (0.3, 0.5, 0.9):
        want = {}
        for k in ("a", "b", None):
            own = sorted((r for r in rows if r[1] == k and r[3] is not None), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
            hits = [r[2] for i, r in enumerate(own, 1) if sum(x[3] for x in own[:i]) / i >= target]
            known = sorted(r[2] for r in own if r[2] is not None)
            place = (len(known) - 1) * (1 - target)
            low, high = known[math.floor(place)], known[math.ceil(place)]
            want[k] = (round(hits[0] if hits and hits[0] is not None else low + (high - low) * (place - math.floor(place)), 6), len(own))
        assert {r.k: (r.threshold, r.n) for r in M.precision_threshold(df, target, "k", block_rows=block_rows).collect()} == want


def test_folds_of_empty_tables_and_of_null_keys(spark):
    df = spark.createDataFrame([], "id long, entry_ts timestamp, exit_ts timestamp, family string")
    assert E.limited(df, "family").collect() == []
    rows = [(i, None if i % 2 else "m", at(i * 10), 1.0, ["r"]) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, market_id string, ts timestamp, severity double, rules array<string>")
    got = {r.seq for r in X.cooled(df, block_rows=4).collect() if r.emitted}
    assert got == {0, 1}  # one of each market: the cooldown is longer than all of it


def test_lifecycle(spark):
    cases = [
        ((False, True, None, 1, "r", None, False, True), "filtered_domain"), ((True, False, None, 1, "r", None, False, True), "filtered_probability"),
        ((True, True, 0, 1, "r", "r", False, True), "updated_resend"), ((True, True, 1, 1, "r", "q", False, False), "updated_resend_silent"),
        ((True, True, 1, 1, "r", "r", True, True), "updated"), ((True, True, None, 1, "r", None, True, True), "suppressed"),
        ((True, True, None, 1, "r", None, False, True), "created"), ((True, True, None, 1, None, None, False, False), "created_silent"),
    ]
    schema = "domain_ok boolean, probability_ok boolean, existing_rank int, rank int, reason string, existing_reason string, suppressed boolean, delivered boolean"
    df = spark.createDataFrame([c for c, _ in cases], schema)
    assert [r.status for r in A.lifecycle(df).collect()] == [s for _, s in cases]


def test_assessment(spark):
    cases = [
        ((0, 0, 0, None, None, None, None), "no_rows_in_window"), ((5, 1, 0, 1.0, 1.0, 0.1, 0.1), "coverage_limited"), ((5, 1, 2, 1.0, 0.5, 0.7, 0.7), "promising"),
        ((5, 0, 2, 1.0, 0.5, 0.75, 0.1), "mixed"), ((5, 0, 2, 0.0, 0.5, 0.1, 0.1), "mixed"), ((5, 0, 2, 0.0, 0.4, 0.1, 0.1), "not_yet_defendable"), ((5, 0, 0, None, None, None, None), "not_yet_defendable"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "n_rows long, n_insufficient long, fills long, median_pnl double, usefulness double, category_share double, family_share double")
    assert [r.x for r in df.select(E.assessment().alias("x")).collect()] == [s for _, s in cases]
