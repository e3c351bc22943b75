"""Sinks: refreshes by scope, idempotent appends, upserts, samples, feeds."""

from pyspark.sql import functions as F

from tidewatch.sources import sinks


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "s").collect())


def test_refresh_scope(spark, tmp_path):
    p = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string, s string")
    sinks.refresh(df((1, "a", "x"), (2, "b", "y")), p, "s")
    sinks.refresh(df((3, "c", "y")), p, "s")
    assert rows(spark, p) == [(1, "a", "x"), (3, "c", "y")]
    sinks.append_new(df((9, "n", "x")), str(tmp_path / "n"), "k")
    sinks.append_new(df((9, "n", "x"), (10, "m", "x"), (10, "m", "x")), str(tmp_path / "n"), "k")
    assert rows(spark, str(tmp_path / "n")) == [(9, "n", "x"), (10, "m", "x")]
    sinks.upsert(df((9, "new", "z")), str(tmp_path / "n"), str(tmp_path / "u"), "k")
    assert rows(spark, str(tmp_path / "u")) == [(9, "new", "z"), (10, "m", "x")]


def test_sample_and_channels(spark, tmp_path):
    df = spark.range(10).withColumn("channel", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    sinks.sample(df, str(tmp_path / "s"), 3, F.desc("id"))
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["9", "8", "7"]
    sent = {}
    sinks.deliver({"a": lambda d, n: sent.update(a=(n, d.count())), "b": lambda d, n: sent.update(b=(n, d.count()))})(df, 7)
    assert sent == {"a": (7, 5), "b": (7, 5)}


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><title>t</title>" + "".join(f"<item><title>i{k}</title><link>l</link></item>" for k in range(7)) + "</channel></rss>")
    assert [r.title for r in sinks.feed_items(spark, str(tmp_path / "f.xml"), 2).orderBy("place").collect()] == ["i0", "i1"]
