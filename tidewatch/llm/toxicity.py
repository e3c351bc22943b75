"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

All words of the labelled examples are terms. A term's weight in a text is its damped frequency times its inverse document
frequency, counted over all documents, times how much its presence tells the labels apart (a floor for words that tell
nothing, so that no word is dropped). The index keeps postings by term and block of examples, with the largest weight of
each term in each block; a query visits blocks in order of their bounds and stops when no block can hold a nearer example,
so that the nearest ones are exact. The few terms that very many examples hold are kept as columns instead: their part of
the cosines comes from a matrix product for many texts at once, and is part of the bounds. The nearest examples vote with weights that fall with distance, and an isotonic curve, fitted on the
examples' own leave-one-out votes, makes the votes probabilities.

Vectors, document frequencies and votes are made in tasks. The driver holds the examples' terms (as 64-bit hashes) and
weights; their number is bounded by the two numbers of examples below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, documents, dropped, released, written

#: Labelled examples of each label that index and curve are fitted on, at most (those of smallest hash of doc_id).
TOXIC_EXAMPLES = 2000
CLEAN_EXAMPLES = 4000
NEAREST = 16
BLOCK = 64
THRESHOLD = 0.7
#: Factor of the weight of words that tell nothing about the labels.
FLOOR = 0.05
#: Blocks that are visited at once, at first; then four times as many each time.
AT_ONCE = 16
#: Terms kept as columns are in more than a COMMON-th of the examples; there are COLUMNS at most.
COMMON = 32
COLUMNS = 512
#: Texts whose parts of cosines by columns are held at once.
TOGETHER = 128

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80 else 0x20 for b in range(256))


def terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text (hashes of its words in lower case, ascending) and how often each occurs."""
    words = data.translate(_TABLE).split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.unique(np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64).view(np.int64), return_counts=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [terms_of(x) for x in column_bytes(batch, "text")]
        own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "toxic")]
        yield pa.RecordBatch.from_arrays([*own, _lists([g[0] for g in got]), _lists([g[1] for g in got])], ["doc_id", "toxic", "terms", "counts"])


def _place(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of terms are known, and their places among the sorted known ones."""
    if not len(known):
        return np.zeros(len(terms), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    hit = known[at] == terms
    return hit, at[hit]


def _frequencies(known: Broadcast):
    """Documents of the task that hold each of the known terms."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for data in column_bytes(batch, "text"):
                n[_place(known.value, terms_of(data)[0])[1]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known.value[some]), pa.array(n[some])], ["term", "n"])

    return lambda batches: released(of(batches))


class BlockMaxIndex:
    """Postings by term and block of examples, with each block's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> None:
        """vectors: terms (places) and weights of each example."""
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        none = np.zeros(0, dtype=np.int64)
        term = np.concatenate([none, *(t for t, _ in vectors)])
        weight = np.concatenate([none.astype(float), *(w for _, w in vectors)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        in_examples = np.bincount(term, minlength=n_terms)
        common = np.argsort(-in_examples, kind="stable")[:COLUMNS]
        common = common[in_examples[common] * COMMON > self.n]
        #: The column of each common term, else -1; and the columns.
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[common] = np.arange(len(common))
        self.columns = np.zeros((len(common), self.n))
        at = self.column[term]
        self.columns[at[at >= 0], example[at >= 0]] = weight[at >= 0]
        term, weight, example = term[at < 0], weight[at < 0], example[at < 0]
        order = np.lexsort((example, term))
        self.example = example[order].astype(np.int32)
        self.weight = weight[order]
        term = term[order]
        of = self.example // block
        head = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1]))) if len(term) else none
        #: An entry is a term in a block: its block, largest weight and postings.
        self.of_block = of[head].astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, head) if len(head) else self.weight
        self.start = np.append(head, len(term)).astype(np.int32)
        self.entries = np.searchsorted(term[head], np.arange(n_terms + 1)).astype(np.int32)

    def by_columns(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The common terms' part of the cosines of each query (terms, weights) with all examples."""
        q = np.zeros((len(queries), len(self.columns)))
        for row, (terms, weights) in zip(q, queries, strict=True):
            at = self.column[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return q @ self.columns

    @staticmethod
    def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the ranges, and the range of each."""
        sizes = ends - starts
        of = np.repeat(np.arange(len(sizes)), sizes)
        return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes), of

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine (of equal ones, the first) and the cosines; those without are left out.

        part: the query's row of by_columns, where known.
        """
        ids, sims = np.zeros(0, dtype=np.int64), np.zeros(0)
        if not len(terms) or not self.n:
            return ids, sims
        part = self.by_columns([(terms, weights)])[0] if part is None else part
        rare = self.column[terms] < 0
        terms, weights = terms[rare], weights[rare]
        entry, of = self._spread(self.entries[terms], self.entries[terms + 1])
        weight, block = weights[of], self.of_block[entry]
        bounds = np.bincount(block, weights=self.top[entry] * weight, minlength=self.blocks)
        bounds = bounds + np.maximum.reduceat(part, np.arange(0, self.n, self.block))
        order = np.argsort(-bounds, kind="stable")
        at, step = 0, AT_ONCE
        while at < len(order):
            bound = bounds[order[at]]
            if bound <= 0 or len(ids) == k and bound < sims[-1] - 1e-9:
                break
            blocks = np.sort(order[at : at + step])
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[blocks] = True
            own = np.flatnonzero(chosen[block])
            posting, of = self._spread(self.start[entry[own]], self.start[entry[own] + 1])
            dots = np.bincount(self.example[posting], weights=self.weight[posting] * weight[own][of], minlength=self.n) + part
            if without is not None:
                dots[without] = 0
            inside = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
            inside = inside[: np.searchsorted(inside, self.n)]
            near, least = dots[inside], max(sims[-1] - 1e-9, 0) if len(ids) == k else 0
            if len(near) > 4 * k:
                least = max(least, np.partition(near, len(near) - k)[len(near) - k] - 1e-9)
            some = inside[near > least]
            ids, sims = np.concatenate([ids, some]), np.concatenate([sims, dots[some]])
            best = np.lexsort((ids, -np.round(sims, 12)))[:k]
            ids, sims = ids[best], sims[best]
            at, step = at + step, 4 * step
        return ids, sims


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to the weighted points (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # from, to, mean, weight
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a, a, b, c])
        while len(pools) > 1 and (pools[-2][2] >= pools[-1][2] or pools[-2][1] == pools[-1][0]):
            _, high, m, n = pools.pop()
            p = pools[-1]
            p[1], p[2], p[3] = high, (p[2] * p[3] + m * n) / (p[3] + n), p[3] + n
    return np.array([v for p in pools for v in p[:2]]), np.array([p[2] for p in pools for _ in range(2)])


class Model:
    """Examples, their index, and the curve from votes to probabilities."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: float, nearest: int = NEAREST) -> None:
        """known: the terms in ascending order, with their weights. examples: id, label, terms and counts of each.

        share: of toxic documents among all labelled ones; the examples hold more of them.
        """
        self.known, self.weights, self.k = known, weights, nearest
        vectors = [(i, y, *self.vector(t, c)) for i, y, t, c in examples]
        toxic = max(sum(y for _, y, *_ in examples), 1)
        clean = max(len(examples) - toxic, 1)
        self.by_label = np.array([(1 - share) / clean, share / toxic])
        label = np.array([v[1] for v in vectors], dtype=np.int64)
        weight, bare = self.by_label[label], np.array([len(v[2]) == 0 for v in vectors], dtype=bool)
        self.bare = float((weight * label)[bare].sum() / weight[bare].sum()) if bare.any() else 0.0
        held = [v for v in vectors if len(v[2])]
        held.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))  # near examples share blocks
        self.ids = np.array([v[0] for v in held], dtype=np.int64)
        self.labels = np.array([v[1] for v in held], dtype=np.int64)
        self.index = BlockMaxIndex([(v[2], v[3]) for v in held], len(known))
        self.curve = (np.zeros(1), np.zeros(1))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms and weights of length 1; both empty if the text has no term of the examples."""
        hit, at = _place(self.known, terms)
        weights = (1 + np.log(counts[hit])) * self.weights[at]
        return at, weights / np.linalg.norm(weights) if len(at) else weights

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[tuple[float, np.ndarray] | None]:
        """For each text (terms and counts) the vote of its nearest examples and these, nearest first; None without a term.

        without: for each text, the id of the example that has no vote.
        """
        for at in range(0, len(texts), TOGETHER):
            vectors = [self.vector(*x) for x in texts[at : at + TOGETHER]]
            parts = self.index.by_columns(vectors)
            for i, ((terms, weights), part) in enumerate(zip(vectors, parts, strict=True)):
                if not len(terms):
                    yield None
                    continue
                out = None if without is None else np.flatnonzero(self.ids == without[at + i])
                ids, sims = self.index.nearest(terms, weights, self.k, out, part)
                w = self.by_label[self.labels[ids]] / (1.0 - sims + 0.05)
                yield float((w * self.labels[ids]).sum() / w.sum()) if len(ids) else 0.0, ids

    def scores(self, texts: list[bytes]) -> Iterator[tuple[float, list[int]]]:
        """Probability of label 1 of each text, and the examples that spoke for it (nearest first)."""
        for found in self.votes([terms_of(x) for x in texts]):
            if found is None:
                yield self.bare, []
            else:
                ids = found[1]
                yield float(np.interp(found[0], *self.curve)), self.ids[ids[self.labels[ids] == 1]].tolist()


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def term_weights(n: int, frequency: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Inverse document frequency among n documents, times FLOOR plus the size of the log ratio of the labels' rates."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.log1p(n / (1.0 + frequency)) * (FLOOR + np.abs(ratio))


def _votes(model: Broadcast):
    """Leave-one-out votes of examples."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            texts = [(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in rows]
            got = model.value.votes(texts, [r["doc_id"] for r in rows])
            votes = pa.array([None if r is None else r[0] for r in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), votes], ["toxic", "vote"])

    return of


def fitted(docs: DataFrame, labels: DataFrame, toxic_examples: int = TOXIC_EXAMPLES, clean_examples: int = CLEAN_EXAMPLES) -> Model:
    """The model from labelled rows that aren't held out, and from the document frequencies of all rows."""
    spark = docs.sparkSession
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = label.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    order = (F.xxhash64("doc_id"), "doc_id")
    few = lambda y, most: known.where(F.col("toxic") == y).orderBy(*order).limit(most)
    chosen = F.broadcast(written(few(1, toxic_examples).unionByName(few(0, clean_examples))))
    sample = written(documents(docs).join(chosen, "doc_id").mapInArrow(_example_terms, "doc_id long, toxic int, terms array<long>, counts array<long>"))

    each = sample.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    table = each.toArrow().sort_by("term")
    terms, with_toxic, with_any = (table.column(c).to_numpy().astype(np.int64) for c in ("term", "toxic", "n"))
    sent = spark.sparkContext.broadcast(terms)
    counted = documents(docs).mapInArrow(_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    table = counted.toArrow().sort_by("term")
    frequency = np.zeros(len(terms), dtype=np.int64)
    frequency[_place(terms, table.column("term").to_numpy())[1]] = table.column("n").to_numpy()
    sent.destroy()

    rows = sample.toArrow().to_pylist()
    n_toxic = sum(r["toxic"] for r in rows)
    weights = term_weights(docs.count(), frequency, with_toxic, with_any - with_toxic, n_toxic, len(rows) - n_toxic)
    examples = sorted(((r["doc_id"], r["toxic"], np.array(r["terms"], np.int64), np.array(r["counts"], np.int64)) for r in rows), key=lambda e: (e[0], e[1], len(e[2])))
    model = Model(terms, weights, examples, (toxic or 0) / max(n or 0, 1))
    sent = spark.sparkContext.broadcast(model)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, len(rows)))
    votes = sample.repartition(tasks).mapInArrow(_votes(sent), "toxic int, vote double").where("vote is not null").toArrow()
    sent.destroy()
    dropped(sample)
    if votes.num_rows:
        y = votes.column("toxic").to_numpy().astype(np.int64)
        model.curve = isotonic(votes.column("vote").to_numpy(), y.astype(float), model.by_label[y])
    return model


def _score(model: Broadcast):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(model.value.scores(column_bytes(batch, "text")))
            arrays = [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "evidence"])

    return lambda batches: released(of(batches))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the toxic examples among the nearest) of each document.

    Null, empty and other texts without a word of the examples get the share of toxic ones among such examples. Whole
    texts count, however long. Without toxic labels all scores are 0. Equal rows get equal results; held_out is null for a
    null id. Of examples at the same distance the first in the index's order are nearest. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    out = documents(docs).mapInArrow(_score(model), "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
