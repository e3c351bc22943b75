"""Removal of byte strings that repeat across documents, by suffix arrays.

A string of ``length`` bytes counts where it also starts in a document with a smaller id. All strings of that length
contain an anchor: the substring of ``GRAM`` bytes of smallest hash among those inside. Equal strings have equal anchors
at the same place, so the work is dealt out by anchor:

1. Texts are dealt to blocks by their hash; equal texts meet in a block and are folded. (Texts with very many copies are
   folded before.) Each block sends the distinct hashes of its anchors, in packed form, to hash buckets.
2. A bucket tells the blocks which hashes occur in two texts or more.
3. For these anchors, the blocks send the distinct contexts (the bytes of all strings with that anchor) to hash buckets.
4. A bucket sorts the suffixes of its contexts in two stages; adjacent suffixes with a common prefix of ``length`` bytes
   form runs, and a run's smallest document id goes back for each string.
5. The blocks mark and remove the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .suffix_array import same_prefix, suffix_order, words_at

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 16 << 20
#: Texts are anchored in stretches of so many bytes.
_STRETCH = 4 << 20
_LOW = np.uint64((1 << 24) - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.iinfo(np.int64).max


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram bytes (a multiple of 8) from each position."""
    words, n = words_at(text), max(len(text) - gram + 1, 0)
    mul, out = _MUL, np.zeros(n, dtype=np.uint64)
    for at in range(0, gram, 8):
        out += words[at : at + n] * mul
        mul = np.uint64(int(mul) * int(_MUL) & 0xFFFFFFFFFFFFFFFF)
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, and the first and last start of the strings that it anchors."""
    parts = []
    for at in range(0, max(len(text) - length + 1, 0), _STRETCH):
        own = text[at : at + _STRETCH + length - 1]
        h = gram_hashes(own, gram)
        least = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        place = (least & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        parts.append((h[place[first]], first + at, np.append(first[1:] - 1, len(place) - 1) + at))
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _texts(table: pa.Table) -> tuple[list[int], list[bytes], dict[bytes, int]]:
    """The distinct texts of a block with their smallest ids, in order of these, then of text; all texts' place there."""
    least: dict[bytes, int] = {}
    for doc, data in zip(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True):
        if doc is not None and data:
            least[data] = min(least.get(data, _NONE), doc)
    own = sorted((d, t) for t, d in least.items())
    return [d for d, _ in own], [t for _, t in own], {t: i for i, (_, t) in enumerate(own)}


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _offer(buckets: int, length: int, gram: int):
    """Step 1. Five bytes of each hash suffice beside its bucket: a chance match costs a context, no more."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        hashes = [np.unique(anchors(np.frombuffer(t, np.uint8), length, gram)[0]) for t in _texts(table)[1]]
        h, counts = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bucket = _bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        h, twice, ends = h[order], (counts > 1)[order], np.cumsum(np.bincount(bucket, minlength=buckets))
        rows = [(b, key[0].as_py(), (x := h[a:e]).astype("<u4").tobytes(), (x >> np.uint64(32)).astype("u1").tobytes(), np.packbits(twice[a:e]).tobytes()) for b, (a, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if e > a]
        return pa.Table.from_pylist([dict(zip(_OFFER.names, r, strict=True)) for r in rows], schema=_OFFER)

    return of


_OFFER = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("twice", pa.binary())])
_SHARED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary())])
_CONTEXTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("sizes", pa.binary()), ("bytes", pa.binary()), ("least", pa.binary()), ("marks", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("lengths", pa.binary()), ("least", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'long', pa.binary(): 'binary', pa.string(): 'string'})[f.type]}" for f in schema)


def _forty(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u4").astype(np.uint64) | (np.frombuffer(high, "u1").astype(np.uint64) << np.uint64(32))


def _share(key: tuple, table: pa.Table) -> pa.Table:
    """Step 2."""
    rows = table.to_pylist()
    hashes = [_forty(r["low"], r["high"]) for r in rows]
    h = np.concatenate(hashes)
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(x)) for r, x in zip(rows, hashes, strict=True)]).astype(bool)
    block = np.repeat(np.arange(len(rows)), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    shared = np.zeros(len(s), dtype=bool)
    shared[order] = same[1:] | same[:-1]
    shared |= twice
    out = []
    for i, r in enumerate(rows):
        own = h[(a := np.searchsorted(block, i)) : (e := np.searchsorted(block, i, "right"))][shared[a:e]]
        if len(own):
            out.append({"block": r["block"], "bucket": key[0].as_py(), "hashes": own.astype("<u8").tobytes()})
    return pa.Table.from_pylist(out, schema=_SHARED)


def _contexts(texts: list[bytes], shared: dict[int, np.ndarray], buckets: int, length: int, gram: int):
    """Each text's contexts as (bucket, start, stop, hash) arrays, of its shared anchors alone."""
    for t in texts:
        h, first, last = anchors(np.frombuffer(t, np.uint8), length, gram)
        bucket = _bucket_of(h, buckets)
        low = h & np.uint64((1 << 40) - 1)
        known = shared.get(-1)
        mark = low | (bucket.astype(np.uint64) << np.uint64(40))
        at = np.minimum(np.searchsorted(known, mark), len(known) - 1) if len(known) else np.zeros(len(mark), dtype=np.int64)
        hit = known[at] == mark if len(known) else np.zeros(len(mark), dtype=bool)
        yield bucket[hit], first[hit], last[hit] + length, h[hit]


def _known(table: pa.Table) -> dict[int, np.ndarray]:
    """Under -1, the sorted shared hashes with their buckets in the bits from 40 up."""
    parts = [np.frombuffer(r["hashes"], "<u8") | np.uint64(r["bucket"] << 40) for r in table.to_pylist()]
    return {-1: np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)}


def _distinct_contexts(ids: list[int], texts: list[bytes], shared: dict, buckets: int, length: int, gram: int):
    """By bucket: the distinct contexts in order of their first place, their smallest ids and hashes; where each one occurs."""
    by: dict[int, dict[bytes, int]] = {}
    least: dict[int, list[int]] = {}
    marks: dict[int, list[int]] = {}
    places = []
    for doc, t, (bucket, start, stop, hashes) in zip(ids, texts, _contexts(texts, shared, buckets, length, gram), strict=True):
        own = []
        for b, s, e, h in zip(bucket.tolist(), start.tolist(), stop.tolist(), hashes.tolist(), strict=True):
            c, table = t[s:e], by.setdefault(b, {})
            i = table.setdefault(c, len(table))
            mins = least.setdefault(b, [])
            if i == len(mins):
                mins.append(doc)  # documents come in ascending order
                marks.setdefault(b, []).append(h & 0xFFFFFFFF)
            own.append((b, i, s))
        places.append(own)
    return by, least, marks, places


def _send(buckets: int, length: int, gram: int):
    """Step 3."""

    def of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _CONTEXTS.empty_table()
        ids, texts, _ = _texts(left)
        by, least, marks, _ = _distinct_contexts(ids, texts, _known(right), buckets, length, gram)
        rows = [{"bucket": b, "block": key[0].as_py(), "sizes": np.array([len(c) for c in table], "<u4").tobytes(), "bytes": b"".join(table), "least": np.array(least[b], "<i8").tobytes(), "marks": np.array(marks[b], "<u4").tobytes()} for b, table in by.items()]
        return pa.Table.from_pylist(rows, schema=_CONTEXTS)

    return of


def smallest(contexts: list[bytes], least: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the smallest id with each of its strings of length bytes."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    words = words_at(text)
    order = suffix_order(text, words, length)
    run = np.cumsum(~same_prefix(order, words, length))
    of = np.repeat(np.arange(len(contexts)), sizes)
    inside = ends[of[order]] - order >= length  # others reach into the next context
    order, run = order[inside], run[inside]
    best = np.full(run[-1] + 1 if len(run) else 0, _NONE, dtype=np.int64)
    np.minimum.at(best, run, least[of[order]])
    out = np.full(len(text), _NONE, dtype=np.int64)
    out[order] = best[run]
    return [out[e - n : e - length + 1] for e, n in zip(ends, sizes, strict=True)]


def _find(length: int):
    """Step 4. Equal contexts of different blocks are folded; those whose anchor has no other context need no sorting."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        place: dict[bytes, int] = {}
        least: list[int] = []
        marks: list[int] = []
        asked = []
        for r in rows:
            at, own = 0, []
            for n, m, h in zip(*(np.frombuffer(r[c], k).tolist() for c, k in (("sizes", "<u4"), ("least", "<i8"), ("marks", "<u4"))), strict=True):
                i = place.setdefault(r["bytes"][at : at + n], len(place))
                if i == len(least):
                    least.append(m)
                    marks.append(h)
                elif m < least[i]:
                    least[i] = m
                own.append(i)
                at += n
            asked.append(own)
        _, group, count = np.unique(np.array(marks), return_inverse=True, return_counts=True)
        alone, mins = count[group] == 1, np.array(least, dtype=np.int64)
        # Runs of equal answers, of all distinct contexts end to end.
        n_starts = np.array([len(c) for c in place], dtype=np.int64) - length + 1
        parts = smallest([c for c, a in zip(place, alone.tolist(), strict=True) if not a], mins[~alone], length)
        answers = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        del parts
        begins = np.cumsum(n_starts[~alone]) - n_starts[~alone]
        new = np.ones(len(answers), dtype=bool)
        new[1:] = answers[1:] != answers[:-1]
        new[begins] = True
        heads = np.flatnonzero(new)
        counts = np.ones(len(place), dtype=np.int64)
        counts[~alone] = np.diff(np.searchsorted(heads, begins), append=len(heads))
        of_alone = np.repeat(alone, counts)
        lengths, values = np.empty(len(of_alone), "<u4"), np.empty(len(of_alone), "<i8")
        lengths[of_alone], values[of_alone] = n_starts[alone], mins[alone]
        lengths[~of_alone], values[~of_alone] = np.diff(heads, append=len(answers)), answers[heads]
        firsts = np.cumsum(counts) - counts
        out = []
        for r, own in zip(rows, asked, strict=True):
            own = np.array(own, dtype=np.int64)
            n = counts[own]
            at = np.repeat(firsts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append({"block": r["block"], "bucket": key[0].as_py(), "counts": n.astype("<u4").tobytes(), "lengths": lengths[at].tobytes(), "least": values[at].tobytes()})
        return pa.Table.from_pylist(out, schema=_FOUND)

    return of


def covered(size: int, starts: list[int], stops: list[int]) -> np.ndarray:
    """Marks the bytes from each start to its stop."""
    step = np.bincount(starts, minlength=size + 1) - np.bincount(stops, minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def _remove(buckets: int, length: int, gram: int, with_text: bool):
    """Step 5. The contexts are made again, in the same order, to know where the answers belong."""

    def of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        answers: dict[int, tuple] = {}
        shared = []
        for r in right.to_pylist():
            if r["hashes"] is not None:
                shared.append({"hashes": r["hashes"], "bucket": r["bucket"]})
            else:
                counts = np.frombuffer(r["counts"], "<u4")
                heads = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
                answers[r["bucket"]] = (memoryview(heads), memoryview(r["lengths"]).cast("I"), memoryview(r["least"]).cast("q"))
        ids, texts, where = _texts(left)
        marks: list[np.ndarray | None] = [None] * len(texts)
        if answers:
            known = _known(pa.Table.from_pylist(shared, schema=pa.schema([("hashes", pa.binary()), ("bucket", pa.int64())])))
            *_, places = _distinct_contexts(ids, texts, known, buckets, length, gram)
            for j, (doc, own) in enumerate(zip(ids, places, strict=True)):
                starts, stops = [], []
                for b, i, s in own:
                    heads, lengths, least = answers[b]
                    at = s
                    for q in range(heads[i], heads[i + 1]):
                        if least[q] < doc:
                            starts.append(at)
                            stops.append(at + lengths[q] - 1 + length)
                        at += lengths[q]
                if starts:
                    marks[j] = covered(len(texts[j]), starts, stops)
        out = []
        for doc, data in zip(left.column("doc_id").to_pylist(), left.column("text").cast(pa.binary()).to_pylist(), strict=True):
            data = data or b""
            n, kept, spans = len(data), data, 0
            if doc is not None and n >= length:
                j = where[data]
                if doc > ids[j]:  # a copy of a smaller document
                    kept, spans = b"", 1
                elif marks[j] is not None:
                    kept = np.frombuffer(data, np.uint8)[~marks[j]].tobytes()
                    spans = int((np.diff(marks[j].astype(np.int8), prepend=0) > 0).sum())
            out.append((doc, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pa.Table.from_pylist([dict(zip(_RESULT.names, r, strict=True)) for r in out], schema=_RESULT)

    return of


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Bytes removed from each document, and (with_text) those kept.

    Null texts are empty; a document without an id neither removes nor loses bytes; rows with the same id don't remove
    from each other. Strings are judged on the input, not on what is left. An empty table gives no rows.
    """
    rows = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    size = F.octet_length("text")
    copies = rows.groupBy(F.md5("text").alias("digest"), size.cast("long").alias("size")).agg(F.count("*").alias("n"))
    most, n_rows, n_bytes = (x or 0 for x in copies.agg(F.max("n"), F.sum("n"), F.sum(F.col("n") * F.col("size"))).first())
    blocks = max(1, -(-n_bytes // block_bytes))
    # At most as many digests as blocks have more copies than a block has rows on average.
    limit = max(1000, n_rows // blocks)
    many = None
    if most > limit:
        many = rows.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where(F.col("n") > limit).select("digest", "least")
        joined = rows.join(F.broadcast(many), F.md5("text") == F.col("digest"), "left")
        extra = F.coalesce((F.col("doc_id") > F.col("least")) & (size >= length), F.lit(False))
        rows, folded = joined.where(~extra).select("doc_id", "text"), joined.where(extra).select("doc_id", size.cast("long").alias("n_bytes"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    by_block = dealt.groupBy("block")
    offers = by_block.applyInArrow(_offer(blocks, length, gram), _ddl(_OFFER))
    shared = offers.groupBy("bucket").applyInArrow(_share, _ddl(_SHARED))
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send(blocks, length, gram), _ddl(_CONTEXTS))
    found = sent.groupBy("bucket").applyInArrow(_find(length), _ddl(_FOUND))
    both = shared.select("block", "bucket", "hashes", *(F.lit(None).cast("binary").alias(c) for c in ("counts", "lengths", "least"))).unionByName(found.withColumn("hashes", F.lit(None).cast("binary")).select("block", "bucket", "hashes", "counts", "lengths", "least"))
    out = by_block.cogroup(both.groupBy("block")).applyInArrow(_remove(blocks, length, gram, with_text), _ddl(_RESULT))
    if many is not None:
        empty = hashlib.sha256(b"").hexdigest()
        out = out.unionByName(folded.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), (F.lit("") if with_text else F.lit(None)).cast("binary").alias("kept")))
    return out if with_text else out.drop("kept")
