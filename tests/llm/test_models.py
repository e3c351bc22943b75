"""Language model, clustering and fill-in-middle against brute force, with nulls, empty texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from tidewatch.llm import centroids, middle, ngram_model

SF = "/root/testdata/sf0.001"
EXTRA = [None, "", " \n\t", "a", "A b", "a B ", "  x y", "x" * 200, "ab " * 60, "ab " * 60, "é ü ñ " * 20, "a <P> b c", "<M>", "a<b <S", "日本 語 text"]
SCHEMA = "doc_id long, text string, lang string, n long, levels string, output string"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with edge cases, clashing columns, repeated rows, a null id and a text of two megabytes."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows += [(1000 + i, t, "en") for i, t in enumerate(EXTRA)]
    rows += [(None, "no id here", None), (1003, "a", "en"), (3, "another text of a known id", "en")]
    rows.append((2000, (" ".join(t for _, t, *_ in rows[:200] if t) + "\n") * 12, "en"))
    assert len(rows[-1][1]) > 2_000_000
    return spark.createDataFrame([(*r, 7, "x", None) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(x))


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


_plain = {}


def plain_scores(rows, s):
    """The scores with exact levels of counts, and no filter; computed once for each order."""
    if s.order not in _plain:
        _plain[s.order] = _plain_scores(rows, s)
    return _plain[s.order]


def _plain_scores(rows, s):
    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % s.modulus == s.held_out

    def padded(x):
        return [None] * (s.order - 1) + words(x) + [0]

    counts, tokens = Counter(), Counter()
    for i, x in rows:
        if not held(i):
            t = padded(x)
            tokens.update(t[s.order - 1 :])
            for n in range(1, s.order + 1):
                for k in range(max(s.order - 2, n - 1), len(t)):
                    counts[tuple(t[k - n + 1 : k + 1])] += 1
    n_all, v = sum(tokens.values()), len(tokens)
    least, mid = ngram_model.thresholds(s.growth), ngram_model.middles(s.growth)

    level = {c: float(mid[np.searchsorted(least, c, "right")]) for c in {0, *counts.values()}}

    def count(g):
        return level[counts.get(g, 0)]

    out = []
    for i, x in rows:
        t = padded(x)
        own = t[s.order - 1 :]
        base = sum(math.log10((tokens[w] + 1) / (n_all + v + 1)) for w in own)
        score = 0.0
        for k in range(s.order - 1, len(t)):
            p = (min(count((t[k],)), n_all) + 1) / (n_all + v + 1)
            for n in range(1, s.order):
                c = count(tuple(t[k - n : k]))
                p = (min(count(tuple(t[k - n : k + 1])), c) + s.strength * p) / (c + s.strength)
            score += math.log10(p)
        out.append((i, held(i), len(own), sum(tokens[w] > 0 for w in own), n_all, base, score))
    return out


def compared(got, want, score_tolerance):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 3))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=score_tolerance, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(docs, rows, order):
    """With many bits nothing passes by chance, so scores are those of the quantised counts."""
    s = replace(ngram_model.Settings(), order=order, bits=600, probes=5)
    got = ngram_model.report(docs, s).collect()
    compared(got, plain_scores(rows, s), 1e-9)


def test_words():
    """Found as a regular expression finds them, however the text is cut; equal words have equal hashes, others don't."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcAB é\t\n\x0b \x1c\u2003") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x" * 5000, "y " * 900]
    for piece in (16, 1 << 20):
        ngram_model.PIECE_BYTES = piece
        try:
            got = ngram_model.words_of([t.encode() for t in texts])
        finally:
            ngram_model.PIECE_BYTES = 1 << 20
        want = [words(t) for t in texts]
        assert [got.word(i).decode() for i in range(len(got.hashes))] == [w for t in want for w in t]
        assert got.counts.tolist() == [len(t) for t in want]
        by = {}
        for h, w in zip(got.hashes.tolist(), (w for t in want for w in t), strict=True):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_scores_of_the_query(docs, rows):
    """With the filter's bits as they are: chance raises one count in fifty by a level, a quarter of the count at most."""
    s = ngram_model.Settings()
    got = ngram_model.report(docs, s).collect()
    want = plain_scores(rows, s)
    compared(got, want, 0.1)
    assert abs(sum(r.score for r in got) / sum(r[6] for r in want) - 1) < 0.01
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_in_blocks(docs, rows, monkeypatch):
    """Many blocks of the filter, and words beyond the head, give what one block and the whole vocabulary give."""
    monkeypatch.setattr(ngram_model, "SEGMENT_GRAMS", 4096)
    s = replace(ngram_model.Settings(), bits=600, probes=5)
    small = replace(s, block_bytes=4_000_000, most_blocks=1000, head_words=50)
    model = ngram_model.trained(docs, small)
    assert len(model.blocks) > 3 and not model.facts.complete and 0 < len(model.head.value[0]) <= 50 * 8
    compared(ngram_model.scored(docs, model).collect(), plain_scores(rows, s), 1e-9)
    far = ngram_model.trained(docs, replace(small, most_blocks=3, head_words=0))
    assert not far.blocks and far.segments is not None and not len(far.head.value[0])
    compared(ngram_model.scored(docs, far).collect(), plain_scores(rows, s), 1e-9)
    assert ngram_model.scored(docs.where("false"), far).count() == 0


def test_groups_of_a_lookup_are_of_bytes(spark):
    """Requests are groups times buckets: short texts share a group by the thousand, long ones have few companions."""
    short = [(i, "a b", None, None, None, None) for i in range(3000)]
    long = [(i, "word " * 200_000, None, None, None, None) for i in range(9)]
    for rows, groups in ((short, 1), (long, 2)):
        docs = ngram_model.documents(spark.createDataFrame(rows, SCHEMA).coalesce(1))
        got = docs.mapInArrow(ngram_model._grouped, "doc_id long, text string, group long")
        assert (got.count(), got.select("group").distinct().count()) == (len(rows), groups)


def test_scores_without_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_model.report(empty).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    one = spark.createDataFrame([(held, "a b", None, 1, None, None)], SCHEMA)
    r = ngram_model.report(one).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_levels():
    """Levels ascend with counts, small ones are exact, and a count is within an eighth of what stands for it."""
    least, mid = ngram_model.thresholds(1.25), ngram_model.middles(1.25)
    assert mid[:5].tolist() == [0, 1, 2, 3, 4] and len(mid) < 256
    for c in [*range(200), 12345, 10**9]:
        assert abs(mid[np.searchsorted(least, c, "right")] - c) <= c / 8


def test_filter():
    """What is in the filter is found with its level; chance finds few of the others."""
    import pyarrow as pa

    s = ngram_model.Settings()
    rng = np.random.default_rng(1)
    h, n = rng.integers(1 << 63, size=20_000, dtype=np.uint64), rng.integers(1, 50, size=20_000, dtype=np.uint32)
    table = pa.table({"bucket": pa.array([0, 0], pa.int32()), "hashes": [h[:15_000].tobytes(), h[10_000:].tobytes()], "counts": [n[:15_000].tobytes(), n[10_000:].tobytes()]})
    made = ngram_model._segment(s)(table)
    bits = made["bits"][0].as_py()
    block = ngram_model.Block([0], [len(bits)], 1, s.probes).filled([0], [bits])
    n[10_000:15_000] *= 2  # in both parts
    want = np.searchsorted(ngram_model.thresholds(s.growth), n, "right")
    got = block.levels(h)
    assert (got >= want).all() and (got > want).mean() < 0.03
    assert (block.levels(rng.integers(1 << 63, size=20_000, dtype=np.uint64)) > 0).mean() < 0.03


def plain_clusters(rows, k, rounds, size, scale, seed):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [max(min(math.floor(scale * v), centroids.LARGEST), -centroids.LARGEST) for v in x]))
    start = sorted((digest(f"{seed}:{i}"), q) for i, q in kept if i is not None)[:k]
    c = [list(q) for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        c = [[sum(v) // len(own[j]) for v in zip(*own[j], strict=True)] if j in own else x for j, x in enumerate(c)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    by = Counter()
    for _, j, d in out:
        by[j] += d
    return sorted(((i is None, i, j, d, by[j], sum(by.values()), digest(",".join(map(str, c[j])))) for i, j, d in out), key=str)


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.5, 0.25, 0.75]) + rng.random() / 8 for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1])]
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [1.0, float("-inf"), 1.0, 1.0]), (205, [1.0] * 5), (206, [-0.0, 1e-30, 1e30, -1e30])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int")
    for k in (1, 3, 16):
        got = centroids.report(df.repartition(3), k=k, rounds=3, size=4, seed=5).collect()
        want = plain_clusters(rows, k, 3, 4, 64, 5)
        assert sorted(((r.vec_id is None, r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got), key=str) == want


def test_clusters_few_or_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.report(spark.createDataFrame([], kind)).count() == 0
    assert centroids.report(spark.createDataFrame([(None, [0.5] * 64)], kind)).count() == 0
    got = centroids.report(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], kind)).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in got) == [(1, 0, 0, 0), (2, 0, 0, 0)]  # ties: the smaller number


def test_clusters_hot_vector(spark):
    """A vector that most rows hold is dealt to several tasks when it is joined back."""
    df = spark.range(9000).select(F.col("id").alias("vec_id"), F.array_repeat(F.when(F.col("id") < 7000, F.lit(0.5)).otherwise(F.col("id") % 50 / 50), 64).alias("embedding"))
    got = centroids.report(df)
    assert got.count() == 9000 and got.select("vec_id").distinct().count() == 9000
    assert got.groupBy("cluster").agg(F.sum("distance").alias("d"), F.max("cluster_inertia").alias("i")).where("d <> i").count() == 0


def plain_middle(i, x, form):
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", x)
    h = digest(f"{form.seed}:{'' if i is None else i}")
    h = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not x or any(t in x for t in (form.prefix, form.suffix, form.middle)) or h[2] % 100 >= form.rate:
        return i, len(u), "plain", None, None, x
    if h[3] % 100 < form.spm:
        return i, len(u), "spm", len(p), len(m), form.suffix + s + form.prefix + p + form.middle + m
    return i, len(u), "psm", len(p), len(m), form.prefix + p + form.suffix + s + form.middle + m


@pytest.mark.parametrize("form", [middle.Format(), middle.Format(rate=100, spm=50, seed=7), middle.Format("[p]", "(s)", "$m^", 100, 0, 1)])
def test_middle(docs, rows, form):
    want = sorted((plain_middle(i, x, form) for i, x in rows), key=str)
    made = middle.transformed(docs, form)
    got = middle.restored(made, form).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert sorted((str(r.doc_id), r.restored) for r in got) == sorted((str(i), x) for i, x in rows)
    assert {r.form for r in got} >= {"plain", "psm"}


def test_bit_vector():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for share in (0.0, 0.03, 0.5, 1.0):
            bits = rng.random(size) < share
            v = middle.BitVector(bits)
            at = np.arange(size + 1)
            assert v.rank(at).tolist() == [0, *np.cumsum(bits).tolist()]
            assert v.select(np.arange(1, bits.sum() + 1)).tolist() == np.flatnonzero(bits).tolist()


def test_middle_empty(spark):
    assert middle.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    r = middle.digests(spark.createDataFrame([(1, None, None, 1, None, None)], SCHEMA)).first()
    assert (r.n, r.form, r.prefix_chars, r.output_sha256, r.restored_sha256) == (0, "plain", None, digest(""), digest(""))


def test_sql(spark):
    c = duck("/root/testdata/sf0.01")
    for name, sql, f in (("embeddings", centroids.sql(), centroids.report), ("documents", middle.sql(), middle.digests)):
        assert differences(spark, c, lambda s, d: f(s.read.parquet(f"{d}/{name}.parquet")), sql, "/root/testdata/sf0.01") == ""  # noqa: B023
