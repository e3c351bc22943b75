"""Positions, recorded candidates, ordered scans, replays, health and contracts at their edges."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators import detector, folds, health, trades, wallets
from tidewatch.sources import log

T = dt.datetime(2026, 4, 20, 6)


def test_netted_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice(("0xA", "0xa ", "0xB", " ", None)), rng.choice(("m", None)), "YES", rng.choice(("c1", "c2", "", None)), rng.choice((f"t{i}", f"t{i}", "", None)), None if i % 17 == 0 else T + dt.timedelta(minutes=i % 40),
             rng.choice(("BUY", "sell", "SELL", None, "x")), rng.choice((None, 1.0, 2.0)), rng.choice((None, 0.0, 7.5)), rng.choice((None, 0.5, 0.25))) for i in range(300)]
    rows += [("0xC", "m", "NO", "c", "u1", T, "BUY", 5.0, 1.0, 0.5), ("0xC", "m", "NO", "c", "u2", T, "SELL", 5.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "wallet string, market_id string, outcome_side string, condition_id string, trade_id string, ts timestamp, side string, size double, notional double, price double").repartition(3)
    want = {}
    for w, m, o, c, t, ts, side, size, amount, price in rows:
        if not (w or "").strip():
            continue
        p = want.setdefault((w.strip().lower(), m, o), {"net": 0.0, "amount": 0.0, "n": 0, "sell": 0, "conditions": {}, "ids": []})
        size, price, amount = size or 0.0, price or 0.0, amount or 0.0
        amount = price * size if amount <= 0 and price > 0 else amount
        sign = -1 if (side or "").upper() == "SELL" else 1
        p["net"], p["amount"], p["n"], p["sell"] = p["net"] + sign * size, p["amount"] + sign * amount, p["n"] + 1, p["sell"] + (sign < 0)
        if c:
            p["conditions"][c] = p["conditions"].get(c, 0) + 1
        if t:
            p["ids"].append((ts is None, ts or T, t))
    got = {(r.wallet, r.market_id, r.outcome_side): r for r in wallets.netted(df).collect()}
    assert set(got) == {k for k, p in want.items() if abs(p["net"]) > 1e-9} and ("0xc", "m", "NO") not in got
    for k, r in got.items():
        p = want[k]
        assert (r.net_size, r.n_trades, r.n_sell) == (p["net"], p["n"], p["sell"]) and r.net_notional == pytest.approx(p["amount"])
        assert r.condition_id == min(((-n, c) for c, n in p["conditions"].items()))[1]
        assert r.first_trades == ",".join(t for _, _, t in sorted(p["ids"])[:5])
    assert wallets.netted(df.limit(0)).count() == 0


def test_netted_moves_trades_once(spark):
    """One shuffle and no join, whatever the conditions and first trades; a dedupe before takes what it is asked for along."""
    schema = "wallet string, market_id string, outcome_side string, condition_id string, trade_id string, ts timestamp, side string, size double, notional double, price double, priority int, dedupe_key string, more string"
    rows = [(f"w{i % 3}", "m", "YES", f"c{i % 7}", f"t{i:03}" if i % 9 else None, T, "BUY", 1.0, 2.0, 0.5, 1, f"k{i}", "x") for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    plan = wallets.netted(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    kept = trades.canonical(df, "wallet", "market_id")
    assert kept.columns == ["priority", "ts", "trade_id", "wallet", "market_id"] and kept.count() == 200
    got = {r.wallet: r for r in wallets.netted(trades.canonical(df)).collect()}
    assert got["w1"].first_trades == "t001,t004,t007,t010,t013" and got["w1"].n_trades == 67 and got["w1"].condition_id == "c0"
    assert got["w0"].first_trades == "t003,t006,t012,t015,t021"


def test_recorded_once(spark):
    rows = [(5, "m", T, 1.0), (3, "m", T, 2.0), (4, None, T, 3.0), (6, None, T, 4.0), (7, "n", None, 5.0)]
    found = spark.createDataFrame(rows, "seq long, market_id string, ts timestamp, severity double")
    got = detector.recorded(found, "v1")
    assert sorted((r.seq, r.severity) for r in got.collect()) == [(3, 2.0), (4, 3.0), (7, 5.0)] and got.select("candidate_id").distinct().count() == 3
    assert detector.recorded(found, "v1", got).count() == 0 and detector.recorded(found, "v2", got).count() == 3


def test_ordered_scan(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = [(f"e{i}", "1", s, "page", None, at, k, "{}") for i, (s, at, k) in enumerate([("Feed A", "2026-04-20T06:10:00Z", "b"), ("feed_b", "2026-04-20T06:10:00Z", "a"), ("Feed A", "2026-04-20T06:10:00Z", None), ("other", "2026-04-20T06:00:00Z", "a"), ("Feed A", "2026-04-20T05:59:59Z", "a"), ("feed_b", "2026-04-20T07:00:00Z", "a"), ("feed_b", "2026-04-20T06:00:00.5Z", "z")])]
    log.append(spark.createDataFrame(rows, "envelope_id string, schema_version string, source_system string, entity_type string, event_type string, captured_at string, ordering_key string, payload string"), root)
    scan = lambda limit=None: {r.seq: r.envelope_id for r in log.scan(spark, root, ("Feed A", "feed_b"), "2026-04-20 06:00:00", "2026-04-20 07:00:00", limit).collect()}
    assert scan() == {1: "e6", 2: "e2", 3: "e1", 4: "e0"} and scan(2) == {1: "e6", 2: "e2"} and scan(0) == {}
    again = {r.original_envelope_id: r for r in log.republished(log.read(spark, root), "run", F.lit(T)).collect()}
    one = again["e6"]
    assert len(again) == 7 and one.ordering_key == "2026-04-20T06:00:00.500000+00:00::e6" and one.raw_partition == "year=2026/month=04/day=20/hour=06/source=feed_b"
    assert json.loads(one.payload)["captured_at"] == "2026-04-20T06:00:00.5Z" and json.loads(one.payload)["event_type"] is None


@pytest.mark.parametrize("block_rows", [7, 10_000])
def test_numbered(spark, block_rows):
    rows = [(i * 37 % 101, "x") for i in range(101)]
    got = folds.numbered(spark.createDataFrame(rows, "k int, seq0 string"), "k", block_rows=block_rows).collect()
    assert sorted((r.k, r.seq) for r in got) == [(i, i + 1) for i in range(101)]
    assert folds.numbered(spark.createDataFrame([], "k int"), "k").count() == 0


DECISION = "path string, source string, n_bytes long, exists boolean, action string, tier string"


def test_summaries(spark):
    rows = [("p1", "a", 5, True, "compact_and_cold_archive", "hot"), ("p2", None, None, None, None, None), ("p3", "b", 9, True, "keep", "hot"), ("p4", "a", 4, True, "cold_archive_candidate", "cold")]
    d = spark.createDataFrame(rows, DECISION)
    got = [tuple(r) for r in health.integrity_summary(d).orderBy(F.col("source").asc_nulls_last()).collect()]
    assert got == [("a", 2, 2, 9, 0, 1, 2, None), ("b", 3, 1, 9, 0, 0, 0, None), ("unknown", 1, 1, 0, 1, 0, 0, None), (None, 3, 4, 18, 1, 1, 2, "missing_partitions_detected")]
    board = {(r.section, r.key): (r.n, r.bytes, r.missing) for r in health.dashboard(d, 1).collect()}
    assert board[("partition", "p3")] == (1, 9, 0) and board[("tier", "unknown")] == (1, 0, 1) and [k for s, k in board if s == "source"] == ["a"] and ("action", "keep") in board
    empty = [tuple(r) for r in health.integrity_summary(d.limit(0)).collect()]
    assert empty == [(None, 0, 0, 0, 0, 0, 0, "empty_window")] and health.dashboard(d.limit(0)).count() == 0


def ladder(spark, audits, scores=(), models=()):
    times = lambda rows: spark.createDataFrame([(t,) for t in rows], "ts timestamp")
    running = health.runtime(times([T, None]), times(scores), spark.createDataFrame(list(models), "model string, status string, activated_ts timestamp"), F.lit(T))
    r = health.ladders(spark.createDataFrame(list(audits), "audit_id string, ts timestamp, missing long"), running, F.lit(T)).first()
    return r.health, r.redundancy[:3], r.blockers, r.recent_alerts, r.active_model


def test_ladders(spark):
    old, late = T - dt.timedelta(hours=49), T - dt.timedelta(hours=25)
    assert ladder(spark, []) == ("no_storage_audit_yet", "not", ["no_storage_audit_yet", "no_recent_shadow_scores", "no_active_shadow_model"], 1, None)
    assert ladder(spark, [("a", T, 0), ("b", old, 9)], [T], [("m", "active", old), ("n", "active", None), ("r", "retired", T)]) == ("ok", "rea", [], 1, "m")
    assert ladder(spark, [("a", old, None)], [late], [("m", "active", None)]) == ("stale_storage_audit", "not", ["storage_audit_is_stale", "no_recent_shadow_scores"], 1, "m")
    assert ladder(spark, [("a", None, 2)], [T], [("m", "active", T)])[:3] == ("missing_archive_files", "not", ["storage_audit_has_invalid_timestamp", "missing_archive_files_detected"])


def test_contract_gaps(spark):
    schema = StructType.fromDDL
    contract = {"t": schema("a int, b string, c array<int>"), "u": schema("x int"), "v": schema("y long")}
    got = health.contract_gaps(spark, {"t": spark.createDataFrame([], "a long, c array<int>, extra int"), "v": spark.createDataFrame([], "y long")}, contract)
    assert {tuple(r) for r in got.collect()} == {("t", "a", "other_type", "int", "bigint"), ("t", "b", "missing_column", "string", None), ("u", None, "missing_table", None, None)}
    assert health.contract_gaps(spark, {}, {}).count() == 0
