"""Benchmark decontamination: a broadcast hash set of the test items' word n-grams, scanned over training texts.

The items' windows are broadcast in blocks of at most ``block_bytes`` bytes of item text. In a worker a block takes some 16
bytes for each of its words (an id, a hash and a place), and its distinct words. A larger benchmark gives more blocks, each
scanned against all documents; the blocks' hits are then merged by document. Every hit is verified word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, column_list, documents, released, small_batches

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Words of an item that one row of the chunk table holds at most.
CHUNK_WORDS = 4096

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_TABLE = bytes(c if c in _WORD else 0x20 for c in _LOWER)
_MUL = np.uint64(0x9E3779B97F4A7C15)

SCAN = "doc_id long, row_key long, n_words long, starts array<long>, ends array<long>, items array<string>"


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and non-ASCII characters."""
    return data.translate(_TABLE).split()


def _chunks(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chunks = [], []
            for item, data in zip(column_list(batch, "item_id"), column_bytes(batch, "text"), strict=True):
                words = words_of(data)
                step = max(1, CHUNK_WORDS - window + 1)
                for i in range(0, max(len(words) - window, 0) + 1, step):
                    if part := words[i : i + step + window - 1]:
                        ids.append(item)
                        chunks.append(b" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(chunks, pa.binary())], ["item_id", "chunk"])

    return of


class WindowIndex:
    """Hash set of word windows: sorted hashes, and where each window lies in the items' words."""

    def __init__(self, chunks: list[tuple[str | None, bytes]], window: int) -> None:
        """chunks: item (None: one without an id) and words of each piece of an item."""
        self.vocabulary: dict[bytes, int] = {}
        known = self.vocabulary
        parts = [np.array([known.setdefault(w, len(known) + 1) for w in chunk.split()], dtype=np.uint32) for _, chunk in chunks]
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        self.items = [item for item, _ in chunks]
        self.words = np.concatenate([np.zeros(0, np.uint32), *parts])
        self.ends = np.cumsum(sizes)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({min(window, int(x)) for x in sizes if x}):
            own = np.flatnonzero(np.minimum(sizes, window) == n)
            starts = [np.arange(e - k, e - n + 1) for e, k in zip(self.ends[own], sizes[own], strict=True)]
            at = np.concatenate(starts)
            h = self._hash(self.words, n)[at]
            order = np.argsort(h, kind="stable")
            self.tables[n] = (h[order], at[order].astype(np.uint32))

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        size = max(len(ids) - n + 1, 0)
        h = np.zeros(size, dtype=np.uint64)
        for j in range(n):
            h = h * _MUL + ids[j : j + size]
        return h

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Merged [start, end) word ranges of hit words, and the items that have an id."""
        ids = np.array(list(map(self.vocabulary.get, words, repeat(0))), dtype=np.uint64)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        begins, stops = edges[::2], edges[1::2]
        spans, items = [], set()
        for n, (known, at) in self.tables.items():
            for a, b in zip(*(x[stops - begins >= n] for x in (begins, stops)), strict=True):
                run = ids[a:b]
                h = self._hash(run, n)
                first, last = (np.searchsorted(known, h, side) for side in ("left", "right"))
                for i in np.flatnonzero(last > first).tolist():
                    places = at[first[i] : last[i]].astype(np.int64)
                    same = (self.words[places[:, None] + np.arange(n)] == run[i : i + n]).all(1)
                    if same.any():
                        spans.append((int(a + i), int(a + i + n)))
                        owners = np.unique(np.searchsorted(self.ends, places[same], "right"))
                        items.update(self.items[o] for o in owners.tolist())
        starts, ends = merge(spans)
        return starts, ends, items - {None}


def merge(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _scan(index: Broadcast):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, starts, ends, items = [], [], [], []
            for data in column_bytes(batch, "text"):
                words = words_of(data)
                s, e, found = index.value.hits(words)
                n_words.append(len(words))
                starts.append(s)
                ends.append(e)
                items.append(sorted(found))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            made = [pa.array(x, k) for x, k in zip((n_words, starts, ends, items), kinds, strict=True)]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "row_key")]
            yield pa.RecordBatch.from_arrays([*own, *made], ["doc_id", "row_key", "n_words", "starts", "ends", "items"])

    return of


def _merged(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([merge(list(zip(s, e, strict=True))) for s, e in zip(starts, ends, strict=True)], columns=["starts", "ends"])


def indexes(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The broadcast window sets, one for each block of at most block_bytes (or of a single chunk)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    chunks = items.mapInArrow(_chunks(window), "item_id string, chunk binary")
    total = chunks.agg(F.sum(F.length("chunk")), F.max(F.length("chunk"))).first()
    blocks = max(1, -(-(total[0] or 0) // block_bytes))
    block = F.xxhash64("item_id", "chunk")
    while blocks > 1:
        sizes = chunks.groupBy(F.pmod(block, F.lit(blocks))).agg(F.sum(F.length("chunk")).alias("n"))
        if sizes.agg(F.max("n")).first()[0] <= max(block_bytes, total[1]):
            break
        blocks *= 2
    spark = benchmark.sparkSession
    return [
        spark.sparkContext.broadcast(WindowIndex([(r[0], bytes(r[1])) for r in chunks.where(F.pmod(block, F.lit(blocks)) == b).distinct().collect()], window))
        for b in range(blocks)
    ]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row_key, n_words, merged hit ranges (starts, ends; in words) and the sorted ids of the items hit, by row.

    Null or empty texts have no words; items without words are no windows, those without an id have windows but aren't
    listed among the items; repeated rows give repeated results.
    """
    rows = documents(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    parts = [rows.mapInArrow(_scan(index), SCAN) for index in indexes(benchmark, window, block_bytes)]
    blocks = len(parts)
    if blocks == 1:
        return parts[0]
    found = parts[0].unionByName(parts[1])
    for p in parts[2:]:
        found = found.unionByName(p)
    # Equal rows of one id fold here and are dealt out again.
    by = found.groupBy("doc_id", "row_key", "n_words").agg(
        F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / blocks).cast("int").alias("copies"))
    by = by.withColumn("m", F.pandas_udf(_merged, "starts array<long>, ends array<long>")("s", "e")).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return by.select("doc_id", "row_key", "n_words", "m.starts", "m.ends", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words, hit words and items of each document; contaminated if ``share * n_hit >= n_words`` with a hit."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    out = scan(docs, benchmark, window, block_bytes).select("doc_id", "row_key", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _cut(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    """data without the words of each range, from the first to the last and all between them."""
    if not starts:
        return data
    at = [m.span() for m in _WORDS.finditer(data)]
    cuts = [0, *(x for s, e in zip(starts, ends, strict=True) for x in (at[s][0], at[e - 1][1])), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _with_text(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    place = batch.schema.get_field_index("text")
    made = pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()).cast(batch.schema.field(place).type)
    return batch.set_column(place, batch.schema.field(place), made)


def _strip(index: Broadcast, share: int, spans: bool):
    """Drops contaminated documents; with spans, also cuts the hit ranges from the others."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for data in column_bytes(batch, "text"):
                words = words_of(data)
                starts, ends, _ = index.value.hits(words)
                n = sum(ends) - sum(starts)
                keep.append(not (n and share * n >= len(words)))
                texts.append(_cut(data, starts, ends) if spans and keep[-1] else data)
            yield (_with_text(batch, texts) if spans else batch).filter(pa.array(keep, pa.bool_()))

    return lambda batches: released(of(batches))


def _cut_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the ranges of the last two columns, and drops these columns."""
    for batch in batches:
        starts, ends = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
        texts = [_cut(x, s or [], e or []) for x, s, e in zip(column_bytes(batch, "text"), starts, ends, strict=True)]
        yield _with_text(batch.select(list(range(batch.num_columns - 2))), texts)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (all columns) without contaminated documents and without hit passages in the others.

    The share of hit words is that of the whole benchmark and of the whole text, however many blocks the benchmark has. A
    null text becomes empty; repeated rows get equal results; an empty table stays empty.
    """
    found = indexes(benchmark, window, block_bytes)
    if len(found) == 1:
        return small_batches(docs).mapInArrow(_strip(found[0], share, True), docs.schema)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    ranges = scan(docs, benchmark, window, block_bytes).where(F.size("starts") > 0)
    ranges = ranges.select(F.col("row_key").alias("__key"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"), (share * hit >= F.col("n_words")).alias("__bad"))
    ranges = ranges.dropDuplicates(["__key"])
    keyed = docs.withColumn("__own", _row_key())
    joined = keyed.join(ranges, F.col("__own") == F.col("__key"), "left").where(~F.coalesce("__bad", F.lit(False)))
    return small_batches(joined).select(*docs.columns, "__starts", "__ends").mapInArrow(_cut_listed, docs.schema)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (all columns) without contaminated documents; the others stay as they are.

    Null and empty texts have no words and stay; repeated rows share their fate; an empty table stays empty.
    """
    found = indexes(benchmark, window, block_bytes)
    if len(found) == 1:
        return small_batches(docs).mapInArrow(_strip(found[0], share, False), docs.schema)
    bad = contamination(docs, benchmark, window, share, block_bytes).where("contaminated").select(F.col("row_key").alias("__key")).distinct()
    return docs.withColumn("__own", _row_key()).join(bad, F.col("__own") == F.col("__key"), "left_anti").drop("__own")


def sql(window: int = WINDOW, share: int = 20) -> str:
    """The same in DuckDB's SQL over documents and benchmark."""
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT *, least({window}, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM n)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""
