"""What runs live: the tailing source, tables merged by key, periodic passes that break down."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.sources import log, store, tail
from tidewatch.streaming import passes

NOW = "2026-04-20T06:30:00+00:00"


def line(i, payload="{}"):
    return json.dumps({"envelope_id": f"e{i}", "source_system": "a", "entity_type": "x", "captured_at": "2026-04-20T06:00:00Z", "ordering_key": f"k{i:04}", "payload": payload}).encode() + b"\n"


def followed(spark, tmp_path, **options):
    q = log.tail(spark, f"file://{tmp_path}/log", now=NOW, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(r.envelope_id for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_tail(spark, tmp_path):
    """Restarts in the middle of a line lose and repeat nothing; broken lines and other hours are passed over."""
    folders = {h: tmp_path / f"log/year=2026/month=04/day=20/hour={h:02}/source=a" for h in (4, 5, 6)}
    for f in folders.values():
        f.mkdir(parents=True)
    write = lambda h, data, name="part.json": (folders[h] / name).open("ab").write(data)
    third, fourth = line(3), line(4, '{"x": "é"}')
    write(4, line(99))
    write(5, line(1))
    write(6, line(2) + b"not json\n\n" + third[:20])
    assert followed(spark, tmp_path) == ["e1", "e2"]
    write(6, third[20:] + fourth[:-1])  # the fourth lacks its end
    write(5, line(5))
    assert followed(spark, tmp_path) == ["e1", "e2", "e3", "e5"]
    assert followed(spark, tmp_path) == ["e1", "e2", "e3", "e5"]
    write(6, b"\n" + line(6))
    write(6, line(7), "other.json")
    write(6, line(98), "_hidden")
    assert followed(spark, tmp_path) == ["e1", "e2", "e3", "e4", "e5", "e6", "e7"]
    size = (folders[6] / "part.json").stat().st_size
    assert tail.offsets(f"file://{tmp_path}/c")["year=2026/month=04/day=20/hour=06/source=a/part.json"] == size


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**6])
def test_tail_pieces(tmp_path, split):
    """However the bytes are cut, each line is read once, long ones too."""
    rng = random.Random(split)
    folder = tmp_path / "year=2026/month=04/day=20/hour=06"
    folder.mkdir(parents=True)
    lines = [b"x" * rng.choice((0, 1, 5, 90, 700)) for _ in range(40)] + [b"y" * 150_000]
    (folder / "f").write_bytes(b"".join(x + b"\n" for x in lines) + b"open")
    reader = tail.TailReader({"path": f"file://{tmp_path}", "now": NOW, "split_bytes": str(split if split > 50 else split * 300)})
    end = reader.latestOffset()
    got = [(p, v.encode()) for piece in reader.partitions({}, end) for b in reader.read(piece) for p, v in zip(b["position"].to_pylist(), b["value"].to_pylist(), strict=True)]
    places = [0]
    for x in lines:
        places.append(places[-1] + len(x) + 1)
    assert got == list(zip(places, lines, strict=False)) and end == {next(iter(end)): places[-1]}
    assert reader.partitions(end, end) == []


def test_log_points(spark):
    """Amounts that are missing are 0, a blank time gives way to the trade's capture, a point in a time means milliseconds."""
    trades = [
        {"market_id": "m", "price": "0.5", "size": "10", "trade_time": "1776664800"},
        {"market_id": "m", "usdc_notional": "3.5", "trade_time": "", "captured_at": "2026-04-20T07:00:00Z"},
        {"market_id": "m", "usdc_notional": "x", "captured_at": "2026-04-20T08:00:00Z"},
    ]
    df = spark.createDataFrame([("e", "recent_trades_page", "2026-04-20T06:00:00Z", "k", json.dumps({"trades": trades}))], "envelope_id string, entity_type string, captured_at string, ordering_key string, payload string")
    got = [(r.notional, r.ts) for r in log.points(df).orderBy("pos").collect()]
    assert got == [(0.0, dt.datetime(2026, 4, 20, 6)), (3.5, dt.datetime(2026, 4, 20, 7)), (0.0, dt.datetime(2026, 4, 20, 8))]


SCHEMA = "k string, j long, n long, seen timestamp, note string"


def test_merge(spark, tmp_path):
    """Merges against a dict, with repeats of a batch; only touched folders change."""
    rng, path, plain = random.Random(1), f"{tmp_path}/t", {}
    how = {"n": store.added, "seen": store.first, "note": store.known}
    for batch in range(4):
        rows = {}
        for i in range(30):
            k, j = rng.choice((None, *"abcdefghij")), rng.randrange(3)
            rows[k, j] = (k, j, rng.choice((None, 1, 5)), dt.datetime(2026, 1, 1 + i % 9), rng.choice((None, "x", "y")))
        df = spark.createDataFrame(list(rows.values()), SCHEMA)
        for _ in range(2):  # the batch comes twice
            store.merge(df, path, ("k", "j"), batch, how, buckets=8)
        for (k, j), r in rows.items():
            if k is None:
                continue
            old = plain.get((k, j))
            plain[k, j] = r if old is None else (k, j, (old[2] or 0) + (r[2] or 0), old[3], r[4] or old[4])
        got = {(r.k, r.j): tuple(r) for r in store.rows(spark, path, StructType(list(df.schema))).collect()}
        assert got == plain
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("__bucket=*/*.parquet")}
    touched = store.merge(spark.createDataFrame([("a", 1, 1, None, None)], SCHEMA), path, ("k", "j"), 9, how, buckets=8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("__bucket=*/*.parquet")}
    assert len(touched) == 1 and {p.parent.name for p in before.keys() ^ after.keys()} == {f"__bucket={touched[0]}"}
    assert store.merge(df.where("false"), path, ("k", "j"), 10, buckets=8) == []


def test_merge_takes_the_last(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, dt.datetime(2026, 1, 2), "new"), ("a", 1, 2, dt.datetime(2026, 1, 1), "old"), ("a", 1, 3, None, "none")], SCHEMA)
    store.merge(df, f"{tmp_path}/t", ("k", "j"), 1, order=("seen",), buckets=2)
    assert [r.note for r in store.rows(spark, f"{tmp_path}/t", StructType(list(df.schema))).collect()] == ["new"]


def test_alerts_go_out_once(spark, tmp_path):
    """A pass dies after it has sent; when its batch comes again nothing is sent twice, and new alerts still go out."""
    now = dt.datetime(2026, 4, 20, 12, tzinfo=dt.timezone.utc)
    sent, broken = [], [True]

    def chat(df, batch):
        sent.extend(r.alert_id for r in df.collect())
        if broken[0]:
            raise RuntimeError("killed")

    schema = "alert_id string, channel string, ts timestamp, text string"
    at = lambda h: dt.datetime(2026, 4, 20, h)
    parts = [[("a", "chat", at(11), "x"), ("a", "chat", at(11), "again"), ("old", "chat", at(3), "x"), ("none", "chat", None, "x"), (None, "chat", at(11), "x")], [("a", "chat", at(12), "x"), ("b", "chat", at(11), "x")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in{i}")

    def go(folder):
        run = passes.alert_pass({"chat": chat, "mail": lambda df, n: None}, f"{tmp_path}/ledger", now=lambda: now, buckets=4)
        q = spark.readStream.schema(schema).json(f"{tmp_path}/{folder}").writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/c-{folder}").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001  the pass that dies
            assert broken[0]

    go("in0")
    assert sent == ["a"] and [r.alert_id for r in passes.unsure(spark, f"{tmp_path}/ledger").collect()] == ["a"]
    broken[0] = False
    go("in0")
    assert sent == ["a"]
    go("in1")
    assert sent == ["a", "b"]
    ledger = {r.alert_id: r.status for r in store.rows(spark, f"{tmp_path}/ledger", passes.LEDGER).collect()}
    assert ledger == {"a": "claimed", "old": "stale", "none": "stale", "b": "sent"}
    with pytest.raises(ValueError, match="no channel"):
        passes.alert_pass({"chat": chat}, f"{tmp_path}/ledger")(spark.createDataFrame([("z", "fax", at(1), "x")], schema), 9)


def test_trailing_scores(spark, tmp_path):
    """A candidate is scored once, and only while it is in the window; repeated batches change nothing."""
    schema = "candidate_id string, ts timestamp, x double"
    at = lambda m: dt.datetime(2026, 4, 20, 12, m)
    minute = [30]
    run = passes.scoring_pass(lambda df: df.withColumn("score", F.col("x") * 2), "v1", f"{tmp_path}/cands", f"{tmp_path}/scores", 1200, now=lambda: at(minute[0]).replace(tzinfo=dt.timezone.utc), buckets=4)
    first = spark.createDataFrame([("a", at(20), 1.0), ("b", at(5), 2.0), ("c", at(40), 3.0), (None, at(20), 9.0), ("d", None, 4.0)], schema)
    run(first, 0)
    run(first, 0)
    got = lambda: {r.candidate_id: r.score for r in store.rows(spark, f"{tmp_path}/scores", passes.SCORES).collect()}
    assert got() == {"a": 2.0}
    minute[0] = 45
    run(spark.createDataFrame([("a", at(44), 7.0), ("e", at(44), 5.0)], schema), 1)
    assert got() == {"a": 2.0, "c": 6.0, "e": 10.0}
