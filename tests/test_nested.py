"""Redaction, shifted times and canonical forms of nested JSON against Python loops."""

import datetime as dt
import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from tidewatch.operators import alerts, nested

KEYS = ("a", "b", "condition_id", "captured_at", "é \"q\"", "0x123456789abc")
TIMES = ("2026-04-20T06:00:00Z", "2026-04-20T06:00:00.250000+02:00", "no time", "")
SCALARS = (None, True, False, 0, -7, 2.5, 10**22, "", "x", "0xdeadbeef99", "id 0xDEADBEEF00 and 0xabc, 0x12345678", 'tab\t "q" \\ é 日', *TIMES)


def value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.35:
        return {k: value(rng, depth - 1) for k in rng.sample(KEYS, rng.randrange(len(KEYS)))}
    if depth and kind < 0.65:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(SCALARS)


def redacted(x):
    if isinstance(x, str):
        return re.sub(r"\b0x[a-fA-F0-9]{8,}\b", "[wallet_redacted]", x)
    if isinstance(x, list):
        return [redacted(v) for v in x]
    return {k: v if k == "condition_id" else redacted(v) for k, v in x.items()} if isinstance(x, dict) else x


def shifted(x, by):
    if isinstance(x, list):
        return [shifted(v, by) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        out[k] = shifted(v, by)
        if k == "captured_at" and isinstance(v, str) and v[:4] == "2026":
            out[k] = (dt.datetime.fromisoformat(v.replace("Z", "+00:00")) + by).astimezone(dt.timezone.utc).isoformat()
    return out


def dumped(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_nested(spark):
    rng = random.Random(5)
    values = [value(rng, rng.randrange(6)) for _ in range(250)] + [{}, [], [[]], {"a": {}}, None, [[[[[[[[1]]]]]]]]]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None), "kept", i) for i, v in enumerate(values)]
    bad = [(900, "0xdeadbeef99 {", "kept", 1), (901, '{"a": 1, "a": "0x123456789"}', "kept", 1), (902, None, "kept", 1), (903, "", "kept", 1)]
    df = spark.createDataFrame(rows + bad, "id long, doc string, json string, seconds long").repartition(4)
    got = {r.id: r for r in nested.redacted(df, "doc").collect()}
    assert len(got) == len(rows) + 4 and {r.json for r in got.values()} == {"kept"}
    assert [got[i].doc for i in range(len(values))] == [dumped(redacted(v)) for v in values]
    assert [got[i].doc for i in (900, 901, 902, 903)] == ["[wallet_redacted] {", '{"a": 1, "a": "[wallet_redacted]"}', None, ""]
    got = {r.id: r.doc for r in nested.shifted(df, "doc", F.col("seconds") / 2).collect()}
    assert [json.loads(got[i]) for i in range(len(values))] == [shifted(v, dt.timedelta(seconds=i / 2)) for i, v in enumerate(values)]
    assert [got[i] for i in (900, 902)] == [bad[0][1], None]
    got = {r.id: r.digest for r in nested.canonical(df, "doc", "digest").collect()}
    assert [got[i] for i in range(len(values))] == [hashlib.sha256(dumped(v).encode()).hexdigest() for v in values]
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4


def test_nested_empty(spark):
    assert nested.redacted(spark.createDataFrame([], "doc string"), "doc").count() == 0


def test_walk_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}')], "id long, doc string")
    assert "Exchange" not in nested.leaves(df, "doc", "id")._jdf.queryExecution().toString()


def test_texts_without_wallets_are_not_taken_apart(spark):
    """They come out as if they were; and of an alert only what is free JSON is looked into."""
    texts = ['{"b": [1, 2.50, {"z": null, "a": true}], "a": "x/y", "condition_id": "0xabcdef0123"}', '{"k": "0xABCDEF0123 \\n0xabcdef0123", "0xabcdef0123": 1}', '{"a": 1, "a": 2}', "no 0xabcdef0123", "[]", '{"b": {}, "a": [[]]}', '"\u00e9 1e40"', "1e40", '{"x": 123456789012345678901234567890.5, "\u00e9": 0}', '{"a": "\\u0030xabcdef0123"}', " 7 ", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.t for r in nested.redacted(df, "t").collect()}
    walked = {r.id: r.t for r in nested.changed(df, "t", lambda path, string, text: text).collect()}
    for i in (4, 5, 6, 7, 8, 10):
        assert got[i] == walked[i] is not None, texts[i]
    assert got[0] == walked[0] and got[1] == '{"0xabcdef0123":1,"k":"[wallet_redacted] \\n[wallet_redacted]"}' and got[9] == '{"a":"[wallet_redacted]"}'
    assert (got[2], got[3], got[11], got[12]) == ('{"a": 1, "a": 2}', "no [wallet_redacted]", None, "")
    columns = "candidate_id string, market_id string, event_id string, condition_id string, event_title string, question string, event_slug string, market_slug string, trigger_time timestamp, rules array<string>, severity string, severity_score double, features string, provider_summary string, outcomes array<string>, outcome_prices array<string>, evidence_state string, model_version string, score_label string, score_value string, scored_at string, detector_version string, feature_schema_version string"
    out = alerts.rendered(spark.createDataFrame([("1", "m 0xabcdef0123", *[None] * 10, '{"a": [1]}', *[None] * 10)], columns), "https://h")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert '"market_id":"m [wallet_redacted]"' in out.first().payload
