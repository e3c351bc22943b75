"""Quality rules: statistics of each text, and an isolation forest over them that finds anomalous documents.

Fixed rules reject first (``base_failed``). Of the others, those whose anomaly score exceeds a threshold go. The forest is
fitted on all labelled documents that pass the rules: each tree draws its rows from all of them, bad ones at lower odds, as
anomalies must be rare there to be isolated early; the sizes of its leaves are counted over all of them. The threshold is the
score at which the share of all labelled bad ones above it, less ``COST`` times that of the good ones, is largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, documents, dropped, released, written

TREES = 100
SUBSAMPLE = 256
#: Bad documents are about this share of the good ones among those that the forest is fitted on, at most.
BAD_SHARE = 0.04
#: A lost good document weighs as much as so many bad ones that stay (as shares of their kinds).
COST = 20.0

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_TAIL_AND_SPACE = bytes(range(0x80, 0xC0)) + _SPACE
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "line_words", "distinct")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more in the text; distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    n, v = len(ids), len(seen)
    if n < 4:
        return 0, v
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:  # so that the triples fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * v + ids[2:]
    order = np.argsort(triples, kind="stable")
    same = np.diff(triples[order]) == 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    for j in range(3):
        cover[j : j + n - 2] |= twice
    return int(cover.sum()), v


def measured(data: bytes) -> tuple[list[int], list[float]]:
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    chars = len(data.translate(None, _TAIL_AND_SPACE))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    upper, digits = (len(data) - len(data.translate(None, x)) for x in (_UPPER, _DIGITS))
    c, w, k = max(chars, 1), max(n, 1), max(len(lines), 1)
    stats = [chars / w, symbols / c, dup / k, repeat / w, upper / c, digits / c, min(n / k, 200) / 200, distinct / w**0.9]
    return [n, chars, symbols, dup, repeat], stats


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and statistics of each text."""
    for batch in batches:
        got = [measured(x) for x in column_bytes(batch, "text")]
        counts = [pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(COUNTS))]
        stats = pa.array([g[1] for g in got], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *counts, stats], ["doc_id", *COUNTS, "stats"])


_COUNTED = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}"


def statistics(docs: DataFrame) -> DataFrame:
    """The counts of the rules, and the statistics that the forest reads, by document. A null text has no words."""
    return documents(docs).mapInArrow(lambda batches: released(_rows(batches)), f"{_COUNTED}, stats array<double>")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def usual(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    m = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


def grown(rows: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of random splits of random features: each node's feature (-1: a leaf) and cut."""
    rng = np.random.default_rng(seed)
    feature, cut = np.full(2 ** (depth + 1) - 1, -1, dtype=np.int16), np.zeros(2 ** (depth + 1) - 1)
    own = [(0, rows, 0)]
    while own:
        node, part, at = own.pop()
        if at == depth or len(part) < 2:
            continue
        low, high = part.min(0), part.max(0)
        wide = np.flatnonzero(high > low)
        if len(wide):
            f = int(rng.choice(wide))
            feature[node], cut[node] = f, rng.uniform(low[f], high[f])
            left = part[:, f] < cut[node]
            own += [(2 * node + 1, part[left], at + 1), (2 * node + 2, part[~left], at + 1)]
    return feature, cut


class Forest:
    """Isolation forest over trees of ``size`` rows; short paths mark anomalies."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, size: int) -> None:
        self.feature, self.cut, self.size = feature, cut, size
        self.depth = depth_of(size)
        self.norm = max(float(usual(np.array([size]))[0]), 1e-9)
        self.path = np.zeros(cut.shape)

    def weigh(self, mass: np.ndarray) -> None:
        """mass: the weight of the rows in each leaf of each tree; a leaf is as deep as if it held its share of ``size`` rows."""
        sizes = np.arange(1, max(self.size, 2) + 1)
        share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-300) * self.size
        depth = np.floor(np.log2(np.arange(1, mass.shape[1] + 1)))
        self.path = depth + np.interp(share, sizes, usual(sizes))

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Of each tree, the leaf of each row."""
        every = np.arange(len(rows))
        for feature, cut in zip(self.feature, self.cut, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (rows[every, np.maximum(f, 0)] >= cut[node]), node)
            yield node

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for anomalies, below 0.5 for the usual."""
        total = np.zeros(len(rows))
        for path, node in zip(self.path, self.leaves(rows), strict=True):
            total += path[node]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.norm)


def depth_of(size: int) -> int:
    return max(1, int(np.ceil(np.log2(max(size, 2)))))


def _stats(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("stats").combine_chunks() if isinstance(batch, pa.Table) else batch.column("stats")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def _grow(size: int):
    def of(key: tuple, table: pa.Table) -> pa.Table:
        own = table.sort_by([("place", "ascending"), ("doc_id", "ascending")]).slice(0, size)
        feature, cut = grown(_stats(own), depth_of(size), key[0].as_py())
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "feature": pa.array([feature.tobytes()], pa.binary()), "cut": pa.array([cut.tobytes()], pa.binary())})

    return of


def _counted(model: Broadcast):
    """A task's good and bad rows in each leaf of each tree."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        counts = np.zeros((2, *forest.cut.shape), dtype=np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for t, node in enumerate(forest.leaves(_stats(batch))):
                for own, kind in zip(counts, (good, ~good), strict=True):
                    own[t] += np.bincount(node[kind], minlength=own.shape[1])
        tree, node = np.nonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tree, node, *counts[:, tree, node])], ["tree", "node", "n_good", "n_bad"])

    return of


def _scores(model: Broadcast, keep: tuple[str, ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.value.score(_stats(batch)))], [*keep, "anomaly"])

    return of


def _best(at: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Of ascending scores with the weights of good and bad ones there: the largest gain above one, and the first such score."""
    gain = np.append(np.cumsum((bad - good)[::-1])[::-1][1:], 0.0)
    return float(gain.max()), float(at[np.argmax(gain)])


def threshold(good: np.ndarray, bad: np.ndarray, cost: float = COST) -> float:
    """The score above which documents go; 1 (none goes) without labelled good or bad ones, or if no cut is worth its cost."""
    if not len(good) or not len(bad):
        return 1.0
    at, place = np.unique(np.concatenate([good, bad]), return_inverse=True)
    good, bad = (np.bincount(x, minlength=len(at)) for x in (place[: len(good)], place[len(good) :]))
    gain, score = _best(at, cost * bad.sum() * good, good.sum() * bad)
    return score if gain > 0 else 1.0


def _range_best(n_good: int, n_bad: int, cost: float):
    """What ``threshold`` needs of one range of scores: its lowest score, its whole weight, its best gain and where."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("anomaly", "good", "bad")] for b in batches if b.num_rows]
        if parts:
            at, good, bad = (np.concatenate(x) for x in zip(*parts, strict=True))
            good, bad = cost * n_bad * good, float(n_good) * bad
            row = [float(at[0]), float((bad - good).sum()), *_best(at, good, bad)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["low", "whole", "gain", "score"])

    return of


def _threshold(scored: DataFrame, n_good: int, n_bad: int, cost: float) -> float:
    """``threshold`` of a table of scores, in ranges."""
    if not n_good or not n_bad:
        return 1.0
    counts = scored.groupBy("anomaly").agg(F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    ranges = counts.repartitionByRange("anomaly").sortWithinPartitions("anomaly").mapInArrow(_range_best(n_good, n_bad, cost), "low double, whole double, gain double, score double")
    above, best, score = 0.0, 0.0, 1.0
    for r in sorted(ranges.collect(), reverse=True):  # a row for each range
        if r.gain + above > 0 and r.gain + above >= best:
            best, score = r.gain + above, r.score
        above += r.whole
    return score


def _fitted(stats: DataFrame, labels: DataFrame, bad_share: float, cost: float) -> tuple[Forest, float]:
    spark = stats.sparkSession
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = label.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    rows = stats.where(~base_failed()).groupBy("doc_id").agg(F.min("stats").alias("stats"))  # of repeated rows, one
    rows = written(rows.join(known, "doc_id"))
    n_good, n_bad = rows.agg(F.count_if(F.col("good")), F.count_if(~F.col("good"))).first()
    odds = min(1.0, max(1.0, bad_share * n_good) / max(n_bad, 1))
    weight = F.when(F.col("good"), 1.0).otherwise(odds)
    total = n_good + odds * n_bad
    size = max(1, min(SUBSAMPLE, round(total)))
    # A tree takes the rows of smallest place; twice as many as it takes are sent to it, or all.
    place = F.pmod(F.xxhash64("doc_id", "tree"), F.lit(1 << 52)) / float(1 << 52) / weight
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long")))).withColumn("place", place)
    drawn = drawn.where(F.col("place") < min(1.0, 2 * size / max(total, 1e-9))).select("tree", "place", "doc_id", "stats")
    trees = drawn.groupBy("tree").applyInArrow(_grow(size), "tree long, feature binary, cut binary").orderBy("tree").collect()
    nodes = 2 ** (depth_of(size) + 1) - 1
    feature, cut = (np.frombuffer(b"".join(r[c] for r in trees), k).reshape(-1, nodes) for c, k in (("feature", np.int16), ("cut", np.float64)))
    forest = Forest(feature, cut, size)
    counts = rows.select("good", "stats").mapInArrow(_counted(spark.sparkContext.broadcast(forest)), "tree long, node long, n_good long, n_bad long")
    mass = np.zeros(cut.shape)
    for r in counts.groupBy("tree", "node").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad")).collect():  # one for each leaf
        mass[r.tree, r.node] = r.n_good + odds * r.n_bad
    forest.weigh(mass)
    scored = rows.select("good", "stats").mapInArrow(_scores(spark.sparkContext.broadcast(forest), ("good",)), "good boolean, anomaly double")
    most = _threshold(scored, n_good, n_bad, cost)
    dropped(rows)
    return forest, most


def fitted(docs: DataFrame, labels: DataFrame, bad_share: float = BAD_SHARE, cost: float = COST) -> tuple[Forest, float]:
    """The forest and its threshold, from all labelled documents that pass the fixed rules."""
    return _fitted(statistics(docs), labels, bad_share, cost)


def judged(docs: DataFrame, labels: DataFrame, bad_share: float = BAD_SHARE, cost: float = COST) -> DataFrame:
    """Counts, base_failed, the verdict ``kept`` and the anomaly score of each document.

    Null or empty texts have no words and fail; whole texts count, however long; equal rows get equal results, and equal
    scores an equal verdict; an empty table gives no rows.
    """
    stats = written(statistics(docs))  # else texts would be read twice
    forest, most = _fitted(stats, labels, bad_share, cost)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    out = stats.mapInArrow(_scores(model, ("doc_id", *COUNTS)), f"{_COUNTED}, anomaly double").withColumn("base_failed", base_failed())
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") <= most)).alias("kept"), "anomaly")
