"""Training frames against nested loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewatch.config import Evaluation
from tidewatch.operators import evaluation as E
from tidewatch.operators import folds, frames


def at(minutes):
    return None if minutes is None else dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)


def test_as_of_streams(spark):
    """Ties, ages, null keys and times, several slices, a stream without rows."""
    rng = random.Random(2)
    some = lambda n: [(i, rng.choice((None, "a", "a", "a", "b", "c")), rng.choice((None, *range(0, 9000, 30)))) for i in range(n)]
    rows, quotes, evidence = some(150), some(120), some(60)
    df = lambda x, name: spark.createDataFrame([(i, k, at(t)) for i, k, t in x], f"{name} long, market_id string, ts timestamp").repartition(3)
    streams = {"quotes": df(quotes, "id"), "evidence": df(evidence, "id"), "none": df([], "id")}
    for slice_s in (3600, 86_400, 10**9):
        got = frames.as_of_streams(df(rows, "row"), streams, "market_id", {"quotes": "id"}, {"evidence": 36_000}, slice_s).collect()
        assert len(got) == len(rows)
        for r in got:
            i, k, t = rows[r.row]
            best = max(((s, n) for n, m, s in quotes if None not in (k, t, s) and m == k and s <= t), default=None)
            assert (r.quotes and (r.quotes.ts, r.quotes.id)) == (best and (at(best[0]), best[1]))
            best = max((s for _, m, s in evidence if None not in (k, t, s) and m == k and t - 600 <= s <= t), default=None)
            assert (r.evidence and r.evidence.ts) == at(best) and r.none is None


def test_one_sort_for_all_streams(spark):
    df = spark.range(5).select(F.col("id"), F.lit("a").alias("market_id"), F.current_timestamp().alias("ts"))
    plan = frames.as_of_streams(df, dict.fromkeys("pqr", df), "market_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [last(__s_p") == 1 and "SortMergeJoin" not in plan.split("Window [last(__s_p")[1].split("Exchange")[0]


def test_ranked(spark):
    names = [f"k{i:04}" for i in random.Random(1).sample(range(5000), 700)]
    df = spark.createDataFrame([(n,) for n in names * 2], "k string").repartition(7)
    for block_rows in (50, 10**6):
        got = {r.k: r["rank"] for r in folds.ranked(df, "k", block_rows).collect()}
        assert got == {n: i + 1 for i, n in enumerate(sorted(names))}
    c = Evaluation(folds=3)
    fold = {r.k: r.fold for r in E.family_folds(df.unionByName(spark.createDataFrame([(None,)], "k string")), "k", c, 50).collect()}
    assert fold == {None: None} | {n: f"fold_{i % 3 + 1}_of_3" for i, n in enumerate(sorted(names))}


def test_training_frame(spark):
    schema = "id long, market_id string, event_family_id string, category string, ts timestamp, velocity double, acceleration double, label int"
    day = 1440
    rows = [(1, "a", "f2", " Sports ", at(0), 0.5, -0.1, 1), (2, "a", "f1", "", at(40 * day), -0.5, 0.2, None), (3, "b", None, None, at(80 * day), None, None, 0), (4, None, "f1", "x", at(120 * day), 0.0, 0.0, 1), (5, "b", "f3", "x", None, 1.0, 1.0, 1)]
    quotes = spark.createDataFrame([("a", at(5), 1, 0.01), ("a", at(3), 2, 0.04), ("b", at(80 * day + 31), 3, 0.01)], "market_id string, ts timestamp, id long, spread double")
    seen = spark.createDataFrame([("a", at(-5), 7.0), ("a", at(1), 8.0)], "market_id string, ts timestamp, x double")
    got = {r.id: r for r in frames.training_frame(spark.createDataFrame(rows, schema), {"seen": seen}, quotes).collect()}
    assert [got[i].seen and got[i].seen.x for i in range(1, 6)] == [7.0, 8.0, None, None, None]
    assert [got[i].liquidity_bucket for i in range(1, 6)] == ["mid", "unknown", "unknown", "unknown", "unknown"]
    assert [got[i].event_family_holdout for i in range(1, 6)] == ["fold_2_of_5", "fold_1_of_5", "fold_unknown", "fold_1_of_5", "fold_3_of_5"]
    assert [got[i].category_holdout for i in range(1, 6)] == ["sports", "unknown", "unknown", "x", "x"]
    assert [got[i].direction for i in range(1, 6)] == ["YES", "NO", "unknown", "NO", "YES"]
    assert [got[i].dataset_partition for i in range(1, 6)] == ["train", "train", "train", "validation", "test"]  # an unknown time comes last
    assert [(got[i].label_success, got[i].label_available, got[i].velocity_abs) for i in (1, 2, 3)] == [(1.0, True, 0.5), (None, False, 0.5), (0.0, True, None)]


def test_long_memory_folds_once_more(spark):
    """A state that never forgets: each row is folded three times at most, and blocks that are right aren't read again."""
    folded = spark.sparkContext.accumulator(0)
    rows = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 7 % 5).alias("x"))

    def step(state, x):
        folded.add(1)
        total = (state or 0) + x["x"]
        return total, total % 2 == 0

    got = {(r.k, r.seq): r.even for r in folds.folded(rows, ("k",), ("seq",), {"x": F.col("x")}, step, "even", 40).collect()}
    want, totals = {}, {}
    for i in range(1000):
        k = str(i % 3)
        totals[k] = totals.get(k, 0) + i * 7 % 5
        want[k, i] = totals[k] % 2 == 0
    assert got == want and folded.value <= 3000
