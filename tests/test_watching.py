"""The universe of markets, the review of live alerts, payloads, calibration and reports at their edges."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import alerts, evaluation, ml, review, universe

DAY = dt.datetime(2026, 1, 1)
MARKET = "market_id string, event_id string, event_slug string, market_slug string, event_title string, event_description string, question string, market_description string, event_tags array<string>, event_tag_ids array<string>, yes_probability double, event_liquidity double, market_liquidity double, tier int, volume double"


def market(id, event="e", slug="s", tags=(), text="", p=None, liquidity=0.0, tier=None, volume=None, event_slug=None):
    return (id, event, event_slug, slug, text, None, None, "", None, list(tags) if tags is not None else None, p, float(liquidity), float(liquidity), tier, volume)


def test_verdicts_in_their_order(spark):
    p = universe.Policy(
        include=universe.Rules(event_slugs=("forced",), tags=("a", "b"), keywords=("zeta", "alpha", "k1", "k2", "k3", "k4"), market_liquidity=5),
        exclude=universe.Rules(tags=("x",), keywords=("spam",)), review_keywords=("maybe",), review_liquidity=100)
    rows = [
        market("forced", event_slug="FORCED", p=0.01, tags=("x",)),
        market("low", p=0.05, tags=("a",), liquidity=9),
        market("spam", text="Some SPAMMER", tags=("a",), liquidity=9),
        market("tag", tags=("b", "n", "a", "b"), liquidity=9),
        market("words", text="k4 k3 k2 k1 zeta alphabet", liquidity=9),
        market("thin", tags=("a",), text="maybe", liquidity=1),
        market("rich", liquidity=100),
        market("tagged only", tags=("a",), liquidity=1),
        market("nothing", tags=None, slug=None),
    ]
    got = {r.market_id: (r.verdict, r.reasons) for r in universe.classified(spark.createDataFrame(rows, MARKET), p).collect()}
    assert got == {
        "forced": ("named", ["manual_event_slug"]), "low": ("outside_band", []), "spam": ("excluded", []), "tag": ("included", ["tag_ids=a,b,b"]),
        "words": ("included", ["keywords=alpha,k1,k2,k3,k4"]), "thin": ("review", ["secondary_keyword_match", "include_tag_but_below_threshold"]),
        "rich": ("review", ["high_event_liquidity"]), "tagged only": ("none", []), "nothing": ("none", [])}


def test_rules_without_any_entry(spark):
    rows = spark.createDataFrame([market("m", tags=("a",), text="t", liquidity=60_000.0)], MARKET)
    assert [r.verdict for r in universe.classified(rows, universe.Policy()).collect()] == ["review"]
    assert [r.verdict for r in universe.classified(rows, universe.Policy(reviewing=False)).collect()] == ["none"]
    assert universe.classified(rows.limit(0), universe.Policy()).count() == 0


@pytest.mark.parametrize("tokens, zero", [(0, []), (1, ["b"]), (5, ["a", "b"]), (100, ["a", "b", "c"])])
def test_tiers(spark, tokens, zero):
    rows = [("c", 1, None), ("b", 1, 9.0), ("a", 1, 9.0), ("d", 2, 99.0), ("e", None, 1.0), ("f", 0, 1.0)]
    df = spark.createDataFrame([(*r, "included") for r in rows] + [("g", 1, 1e9, "review")], "market_id string, tier int, volume double, verdict string")
    got = {r.market_id: r.role for r in universe.tiers(df, tokens).collect()}
    want = {"a": "tier1", "b": "tier1", "c": "tier1", "d": "tier2", "e": "tier3", "f": "tier3"}
    order = ["a", "b", "c"]
    assert got == want | dict.fromkeys(order[: len(zero)], "tier0")


def test_review_list(spark):
    rows = [("e1", "m2", 5.0, 1.0, ["x"]), ("e1", "m1", 5.0, 1.0, ["y"]), ("e2", "m3", 7.0, None, ["a", "b"]), ("e3", "m4", None, 1.0, ["z"]), ("e4", "m5", 5.0, 1.0, [])]
    df = spark.createDataFrame([(*r, "review") for r in rows] + [("e9", "m9", 99.0, 1.0, [], "none")], "event_id string, market_id string, event_liquidity double, volume double, reasons array<string>, verdict string")
    got = [tuple(r) for r in universe.review_list(df, universe.Policy(review_most=3)).orderBy("place").collect()]
    assert got == [("e2", 7.0, "m3", "a,b", 1), ("e1", 5.0, "m1", "y", 2), ("e4", 5.0, "m5", "", 3)]


def reviewed(spark, n_alerts, with_scores=True):
    at = lambda h: DAY + dt.timedelta(hours=h)
    a = [(f"a{i}", f"c{i}" if i != 3 else None, "", "WATCH", "created", None if i == 2 else at(i), None, None, None) for i in range(n_alerts)]
    alert = spark.createDataFrame(a, "alert_id string, candidate_id string, title string, severity string, alert_status string, updated_at timestamp, created_at timestamp, first_delivery_at timestamp, last_delivery_at timestamp")
    candidate = spark.createDataFrame([("c0", "m", None, "Q?", None, "s", at(0), ["r"], 1.0, {"b": 1.0, "a": 2.0})], "candidate_id string, market_id string, event_title string, question string, event_slug string, market_slug string, trigger_time timestamp, rules array<string>, severity_score double, features map<string,double>")
    s = [(f"c{i}", j, at(1) if j < 3 else None, at(0), f"m{j}", "high", str((i * 7 + j) / 100) if i % 5 else "bad") for i in range(n_alerts) for j in range(4)] if with_scores else []
    score = spark.createDataFrame(s, "candidate_id string, score_id int, scored_at timestamp, created_at timestamp, model_version string, score_label string, score_value string")
    proof = spark.createDataFrame([(None, 1, at(0), None, "x", 0.1)], "candidate_id string, snapshot_id int, snapshot_time timestamp, created_at timestamp, evidence_state string, confidence_modifier double")
    tries = spark.createDataFrame([("a0", "sent", "chat"), ("a0", "error", "chat"), ("a0", "sent", "mail"), ("a1", "pending", ""), (None, "sent", "chat")], "alert_id string, delivery_status string, delivery_channel string")
    return review.reviewed(alert, candidate, score, proof, tries, F.lit(DAY + dt.timedelta(hours=1)))


def test_review_takes_the_last_score_and_keeps_alerts_without_a_time(spark):
    rows = {r.alert_id: r for r in reviewed(spark, 6).collect()}
    assert set(rows) == {"a1", "a2", "a3", "a4", "a5"}
    assert rows["a1"].model_version == "m2" and rows["a1"].score_value == 0.09  # the largest id of the latest scored_at; created_at is earlier
    assert rows["a2"].alert_time is None and rows["a3"].ml_state == "missing" and rows["a5"].ml_state == "scored" and rows["a5"].score_value is None
    assert rows["a1"].attempt_count == 1 and rows["a1"].sent_count == 0 and rows["a1"].channels == [] and rows["a4"].attempt_count == 0


def test_readiness(spark):
    empty = review.readiness(reviewed(spark, 0)).first()
    assert (empty.alerts_reviewed, empty.coverage, empty.distinct_values, empty.promotion_readiness) == (0, 0.0, [], "not_ready")
    assert empty.gates == ["no_alerts", "coverage", "few_scores", "flat_scores"]
    none = review.readiness(reviewed(spark, 9, with_scores=False)).first()
    assert none.gates == ["coverage", "few_scores", "flat_scores"]
    full = review.readiness(reviewed(spark, 60)).first()
    assert full.gates == [] and full.promotion_readiness == "review_for_priority_only" and full.alerts_reviewed == 59
    assert full.distinct_scores == 47 and len(full.distinct_values) == 25 and full.distinct_values == sorted(full.distinct_values)
    first = review.examples(reviewed(spark, 60), 2).where("list = 'top_scored'").orderBy("place").collect()
    assert [r.alert_id for r in first] == ["a59", "a58"]
    assert review.examples(reviewed(spark, 0), 2).count() == 0


def test_payload(spark):
    hidden = "0xABCDEF0123456789"
    columns = "candidate_id string, market_id string, event_id string, condition_id string, event_title string, question string, event_slug string, market_slug string, trigger_time timestamp, rules array<string>, severity string, severity_score double, features string, provider_summary string, outcomes array<string>, outcome_prices array<string>, evidence_state string, model_version string, score_label string, score_value string, scored_at string, detector_version string, feature_schema_version string"
    full = ("1", f"m {hidden}", "e", hidden, f'T "{hidden}" é\n', "q", " /x y/ ", "m", dt.datetime(2026, 7, 4, 16, 5), ["a"], "INFO", 0.5, json.dumps({"a": [{"w": hidden, "condition_id": hidden}], "probability_velocity": "x"}), "[1]", ["No", "YES"], ["0.1", "0.9"], "", "v", None, "nan?", None, "d", "f")
    bare = ("2", *[None] * 22)
    got = {r.candidate_id: json.loads(r.payload) for r in alerts.rendered(spark.createDataFrame([full, bare], columns), "https://h").collect()}
    one, two = got["1"], got["2"]
    assert one["title"] == 'T "[wallet_redacted]" é\n' and one["condition_id"] == hidden and one["market_evidence"]["market_id"] == "m [wallet_redacted]"
    assert one["market_evidence"]["feature_snapshot"]["a"] == [{"condition_id": hidden, "w": "[wallet_redacted]"}]
    assert one["trigger_time_display"] == "Jul 4, 2026 12:05 PM ET" and one["event_url"] == "https://h/x%20y" == one["market_url"] and one["provider_summary"] == [1]
    assert one["active_outcome_side"] == "YES" and one["active_outcome_probability"] == 0.9 and one["public_evidence_state"] == "pending_evidence"
    assert one["ml_shadow_score"] == {"state": "scored", "model_version": "v", "score_label": None, "score_value": None, "scored_at": None}
    assert set(one) == set(two) and two["title"] == "Market None" and two["ml_shadow_score"]["state"] == "pending" and two["market_url"] is None
    assert two["why_it_looks_informed"] == "Rules=None severity_score=None" and two["market_evidence"]["feature_snapshot"] == {} and two["active_outcome_probability"] is None


def test_eastern_time_at_the_changes(spark):
    times = [("2026-03-08 06:59:00", "Mar 8, 2026 1:59 AM ET"), ("2026-03-08 07:00:00", "Mar 8, 2026 3:00 AM ET"), ("2026-11-01 05:30:00", "Nov 1, 2026 1:30 AM ET"), ("2026-11-01 06:30:00", "Nov 1, 2026 1:30 AM ET"), ("2026-11-01 17:00:00", "Nov 1, 2026 12:00 PM ET"), (None, "")]
    df = spark.createDataFrame(times, "t string, shown string")
    assert df.where(S.eastern(F.col("t").cast("timestamp")) != F.col("shown")).count() == 0


@pytest.mark.parametrize("validation", [True, False])
def test_calibration_against_a_loop(spark, validation):
    rng = random.Random(4)
    rows = [(i, rng.randrange(30) / 30, rng.choice((None, 0, 1, 1)), rng.choice(("train", None, *(["validation"] if validation else []))), rng.choice(("tight", None)), rng.choice(("a", "b"))) for i in range(400)]
    got = ml.calibration_profiles(spark.createDataFrame(rows, "doc_id int, score double, label int, dataset_partition string, liquidity_bucket string, category string"), block_rows=60).collect()
    used = [r for r in rows if r[2] is not None and (r[3] == "validation" or not validation)]
    want = {}
    for scope, key in [("global", "global"), ("liquidity_bucket", "tight"), ("liquidity_bucket", None), ("category", "a"), ("category", "b")]:
        own = sorted((r for r in used if scope == "global" or key == r[4 if scope == "liquidity_bucket" else 5]), key=lambda r: (-r[1], r[0]))
        found = []
        for target in ml.PRECISIONS.values():
            hits = np.cumsum([r[2] for r in own]) / np.arange(1, len(own) + 1)
            ok = np.flatnonzero(hits >= target)
            found.append(round(own[ok[0]][1] if len(ok) else float(np.quantile([r[1] for r in own], 1 - target)), 6))
        want[scope, key] = (*found, len(own), round(sum(r[2] for r in own) / len(own), 6))
    assert {(r.scope, r.key): (r.watch_threshold, r.actionable_threshold, r.critical_threshold, r.n, r.positive_rate) for r in got} == want
    assert ml.calibration_profiles(spark.createDataFrame(rows[:0], "doc_id int, score double, label int, dataset_partition string, liquidity_bucket string, category string")).count() == 0


def test_candidate_report(spark):
    schema = "market_id string, ts timestamp, severity double, rules array<string>"
    rows = [("a", DAY, 1.0, ["x", "y"]), ("a", DAY, 3.0, ["x"]), ("b", DAY + dt.timedelta(minutes=61), 5.0, []), ("c", DAY, 5.0, None), (None, DAY, 0.5, ["x"])]
    got = {(r.section, r.key): (r.n, r.severity) for r in evaluation.candidate_report(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {
        ("hour", "2026-01-01T00:00:00"): (4, 5.0), ("hour", "2026-01-01T01:00:00"): (1, 5.0), ("rule", "x"): (3, 3.0), ("rule", "y"): (1, 1.0), ("market", "a"): (2, 3.0), ("market", "b"): (1, 5.0),
        ("total", "total_candidates"): (5, 5.0), ("total", "unique_markets"): (3, 5.0)}
    empty = evaluation.candidate_report(spark.createDataFrame([], schema)).collect()
    assert {(r.key, r.n) for r in empty} == {("total_candidates", 0), ("unique_markets", 0)}
