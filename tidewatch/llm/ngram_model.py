"""An n-gram language model in a log-frequency Bloom filter, and the scores that it gives to texts.

Counts are quantised to levels: small counts exactly, larger ones by steps of a quarter. A gram of level q is in the filter
q times, once with each number up to q; a count is read by probing 1, 2, ... until a probe fails. The filter is cut into
segments by hash, each sized by what it holds, so that it is made where the counts meet; segments are broadcast in blocks
of at most ``block_bytes``. Blocks beyond the first are further passes over the texts: each fills in the levels of its own
grams, and only the last one turns levels into probabilities. A filter of more than ``most_blocks`` isn't broadcast: the
distinct grams of a few texts at a time go to the segments by a shuffle, and their levels come back by another.

Words are told apart by 64-bit hashes in a task and in the arrays. Besides, words have exact counts. Those of the most frequent words, at most ``head_words``, go to the workers as arrays; where
there are more, rarer words of the texts meet their counts by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, column_list, documents, dropped, released, spread_join, written

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U = np.uint64
_MUL, _TURN, _STEP = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Stand for the start and the end of a text where words have hashes.
START, END = _U(1), _U(2)
#: Distinct words that a task holds at a time with their counts.
WORDS_HELD = 300_000
#: Grams of a task that combine before they are sent.
GRAMS_HELD = 2_000_000
#: Bytes of text that a worker takes at a time.
CHUNK_BYTES = 1_500_000
#: Grams of the training texts that a segment holds, at most (on average; grams are dealt by hash).
SEGMENT_GRAMS = 1 << 19


@dataclass(frozen=True)
class Settings:
    """bits: of the filter for each level of a gram; probes: bits that are set for it, five at most. order: words of the longest gram. strength: tokens that the lower order weighs. growth: step between levels."""

    order: int = 2
    strength: float = 32.0
    growth: float = 1.25
    bits: int = 10
    probes: int = 4
    min_count: int = 1
    modulus: int = 7
    held_out: int = 2
    block_bytes: int = 128 << 20
    most_blocks: int = 4
    head_words: int = 2_000_000


def thresholds(growth: float) -> np.ndarray:
    """The least count of each level, from level 1."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


def middles(growth: float) -> np.ndarray:
    """The count that stands for each level, from level 0: the mean of what it holds."""
    least = thresholds(growth)
    return np.concatenate(([0.0], (least[:-1] + least[1:] - 1) / 2, least[-1:].astype(float)))


def chunks(texts: list[bytes]) -> Iterator[slice]:
    """The texts in runs of some CHUNK_BYTES, one text at least."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK_BYTES:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


#: Text is hashed in pieces of so many bytes, cut between words; a longer word is a longer piece.
PIECE_BYTES = 1 << 20
_IS_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
#: A random odd factor, its inverse modulo 2^64, and random values for bytes.
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=_U)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, x, _U)))) for x in (_BASE, _INVERSE))


@dataclass
class Words:
    """The words of texts between ASCII white space, A to Z in lower case: data and where words start and end in it, their
    64-bit hashes, and the number of words of each text.
    """

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def words_of(texts: list[bytes]) -> Words:
    """Found and hashed for all texts at once: a hash is a difference of running sums of byte values times powers."""
    data = b"\n".join([*texts, b""]).translate(_LOWER)
    seen = np.frombuffer(data, np.uint8)
    space = _IS_SPACE[seen]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    offsets = np.cumsum([0, *(len(x) + 1 for x in texts)])
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = np.zeros(len(starts), _U)
    i = 0
    while i < len(starts):
        low = starts[i]
        k = max(i + 1, int(np.searchsorted(ends, low + PIECE_BYTES, "right")))
        high = ends[k - 1]
        power, inverse = _powers(max(PIECE_BYTES, int(1 << int(high - low).bit_length())))
        run = np.concatenate((np.zeros(1, _U), np.cumsum(_VALUES[seen[low:high]] * power[: high - low])))
        a, b = starts[i:k] - low, ends[i:k] - low
        hashes[i:k] = (run[b] - run[a]) * inverse[a]
        i = k
    return Words(data, starts, ends, mixed(hashes), counts)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _TURN
    x = (x ^ (x >> _U(29))) * _STEP
    return x ^ (x >> _U(32))


def sequences(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as hashes, one after the other, each text with order - 1 starts before and an end; and their ends."""
    ends = np.cumsum(words.counts + order)
    seq = np.full(ends[-1] if len(ends) else 0, START, _U)
    if len(ends):
        seq[ends - 1] = END
        skipped = order * np.arange(len(ends)) + order - 1
        seq[np.arange(len(words.hashes)) + np.repeat(skipped, words.counts)] = words.hashes
    return seq, ends


def grams(seq: np.ndarray, ends: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each order the hash of the gram that ends at each place, and whether it counts: it lies in one text, and the last
    of the starts before a text is the first place.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    place = np.arange(len(seq)) - np.repeat(starts, np.diff(ends, prepend=0))
    h = mixed(seq)
    for n in range(1, order + 1):
        if n > 1:
            last, h = h, np.zeros_like(h)
            h[1:] = mixed(last[:-1] * _MUL + seq[1:] + _U(n))
        yield h, place >= max(order - 2, n - 1)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _training(s: Settings) -> Column:
    digest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.pmod(digest, F.lit(s.modulus)) != s.held_out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts, each time that it has gathered enough of them."""
    held: list[tuple[Words, np.ndarray, np.ndarray, np.ndarray]] = []
    size = texts = 0

    def out() -> pa.RecordBatch:
        hashes, first, back = np.unique(np.concatenate([h for _, h, _, _ in held]), return_index=True, return_inverse=True)
        counts = np.bincount(back, np.concatenate([n for *_, n in held])).astype(np.int64)
        edges = np.cumsum([len(h) for _, h, _, _ in held])
        owner = np.searchsorted(edges, first, "right")
        words = [held[k][0].word(held[k][2][i]) for k, i in zip(owner.tolist(), (first - (edges - np.diff(edges, prepend=0))[owner]).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(hashes.view(np.int64)), pa.array(counts)], ["word", "hash", "n"])

    for batch in batches:
        whole = column_bytes(batch, "text")
        texts += len(whole)
        for part in chunks(whole):
            words = words_of(whole[part])
            held.append((words, *np.unique(words.hashes, return_index=True, return_counts=True)))
            size += len(held[-1][1])
            words.hashes = words.counts = words.hashes[:0]
            if size >= WORDS_HELD:
                yield out()
                held, size = [], 0
    if size:
        yield out()
    if texts:  # ends are a token without a word
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["word", "hash", "n"])


def word_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word (null: the end of a text), hash and n of the training texts, all exact. Tasks combine their own before."""
    rows = documents(docs).where(_training(s)).mapInArrow(lambda x: released(_word_counts(x)), "word binary, hash long, n long")
    return rows.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def _gram_counts(order: int, buckets: int):
    """Hashes and counts of a task's grams, a row for each bucket each time that the task has gathered enough."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        own = _bucket(h, buckets)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        blobs = lambda x: pa.array([p.tobytes() for p in np.split(x, at[1:])], pa.binary())
        made = [pa.array(own[at], pa.int32()), blobs(h.astype("<u8")), blobs(n.astype("<u4"))]
        return pa.RecordBatch.from_arrays(made, ["bucket", "hashes", "counts"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = column_bytes(batch, "text")
            for part in chunks(texts):
                seq, ends = sequences(words_of(texts[part]), order)
                for h, counts in grams(seq, ends, order):
                    held.append(h[counts])
                    size += len(held[-1])
                if size >= GRAMS_HELD:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return lambda batches: released(of(batches))


def _places(h: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Of grams with a level the word of the filter that they are in (of so many), and a draw for the bits in it."""
    x = mixed(h + np.asarray(level, _U) * _MUL)
    return ((x >> _U(32)) * np.asarray(words, _U) >> _U(32)).astype(np.int64), x


def _bit(x: np.ndarray, probe: int) -> np.ndarray:
    return x >> _U(6 * probe) & _U(63)


def _segment(s: Settings):
    """The Bloom filter of one bucket, from the counts of all tasks."""
    least = thresholds(s.growth)

    def of(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, n = h[first], np.add.reduceat(n[order], first)
        h, n = h[n >= s.min_count], n[n >= s.min_count]
        levels = np.searchsorted(least, n, "right")
        items = int(levels.sum())
        words = max(1, -(-s.bits * items // 64))
        bits = np.zeros(64 * words, bool)
        many, which = np.repeat(h, levels), np.arange(items) - np.repeat(np.cumsum(levels) - levels, levels) + 1
        place, x = _places(many, which, words)
        for probe in range(s.probes):
            bits[64 * place + _bit(x, probe).astype(np.int64)] = True
        kind = pa.schema([("bucket", pa.int32()), ("grams", pa.int64()), ("items", pa.int64()), ("bits", pa.binary())])
        return pa.table([table["bucket"].combine_chunks()[:1], [len(h)], [items], [np.packbits(bits, bitorder="little").tobytes()]], schema=kind)

    return of


class Block:
    """Segments of the filter that lie side by side: levels of grams, 0 where another block has the gram or none."""

    def __init__(self, buckets: list[int], sizes: list[int], all_buckets: int, probes: int) -> None:
        """buckets and sizes (in bytes) of the segments, of all_buckets in the filter."""
        self.buckets, self.probes = all_buckets, probes
        self.sizes = np.zeros(all_buckets, np.int64)
        self.sizes[buckets] = np.array(sizes, np.int64) // 8
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = bytearray(8 * int(self.sizes.sum()))

    def filled(self, buckets: list[int], bits: list) -> Block:
        """Takes over segments (anything with a buffer)."""
        for bucket, x in zip(buckets, bits, strict=True):
            at = 8 * int(self.starts[bucket])
            self.raw[at : at + len(x)] = x
        return self

    @property
    def data(self) -> np.ndarray:
        """The filter's words: a view of plain bytes, which a worker takes from a broadcast without a second copy."""
        return np.frombuffer(self.raw, "<u8")

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels of distinct grams: probes go on with those grams that passed all before.

        All bits of a gram and level are in one word of the filter, so that a probe is one look at memory.
        """
        own = _bucket(h, self.buckets)
        data, out, level = self.data, np.zeros(len(h), np.uint8), 0
        alive = np.flatnonzero(self.sizes[own])
        h, size, start = h[alive], self.sizes[own[alive]].astype(_U), self.starts[own[alive]]
        while len(alive) and level < 255:
            level += 1
            place, x = _places(h, level, size)
            mask = _U(1) << _bit(x, 0)
            for probe in range(1, self.probes):
                mask |= _U(1) << _bit(x, probe)
            kept = np.flatnonzero(data[start + place] & mask == mask)
            alive, h, size, start = alive[kept], h[kept], size[kept], start[kept]
            out[alive] = level
        return out


@dataclass(frozen=True)
class Facts:
    """tokens, types and texts that a model was trained on, buckets of its filter, and whether the head holds all words."""

    settings: Settings
    tokens: int
    types: int
    texts: int
    buckets: int
    complete: bool


@dataclass
class Model:
    """facts; blocks of the filter, or else its segments as a table; exact counts of words."""

    facts: Facts
    blocks: list[Broadcast]
    segments: DataFrame | None
    head: Broadcast
    counts: DataFrame


def _head(counts: DataFrame, s: Settings) -> tuple[tuple[bytes, bytes], bool]:
    """Hashes (ascending) and counts of the most frequent words, at most head_words, as bytes; whether these are all."""
    words = counts.where("word is not null")
    by = sorted(((r[0], r[1]) for r in words.groupBy(F.floor(F.log2("n")).alias("g")).count().collect()), reverse=True)
    taken, least, complete = 0, None, True
    for g, n in by:
        complete = taken + n <= s.head_words
        if not complete:
            break
        taken, least = taken + n, g
    table = words.where(F.floor(F.log2("n")) >= least if least is not None else F.lit(False)).select("hash", "n").toArrow()
    hashes = table["hash"].to_numpy().astype(np.int64).view(_U)
    order = np.argsort(hashes, kind="stable")
    return (hashes[order].tobytes(), table["n"].to_numpy().astype(np.int64)[order].tobytes()), complete


#: Bytes of segments that come to the driver at a time.
SLICE_BYTES = 16 << 20


def _collected(segments: DataFrame, sizes: list[tuple[int, int]], buckets: int, probes: int) -> Block:
    """A block from its segments, which come in slices and are copied once."""
    block = Block([b for b, _ in sizes], [n for _, n in sizes], buckets, probes)
    for part in _runs(sizes, SLICE_BYTES):
        table = segments.where(F.col("bucket").between(part[0][0], part[-1][0])).select("bucket", "bits").toArrow()
        block.filled(table["bucket"].to_pylist(), [x.as_buffer() for x in table["bits"]])
        del table
        pa.default_memory_pool().release_unused()
    return block


def _runs(sizes: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Buckets and sizes in runs of at most so many bytes, or of a single bucket."""
    out: list[list[tuple[int, int]]] = []
    held = 0
    for bucket, n in sizes:
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append((bucket, n))
        held += n
    return out


def trained(docs: DataFrame, s: Settings = Settings()) -> Model:
    """The model of the training texts among docs: all grams count, whatever their number.

    Null and empty texts are an end alone; rows without an id are trained on; repeated rows count each time.
    """
    counts = written(word_counts(docs, s))
    total = counts.agg(F.sum("n"), F.count("*"), F.max(F.when(F.col("word").isNull(), F.col("n")))).first()
    tokens, types, texts = (x or 0 for x in total)
    buckets = max(1, -(-s.order * tokens // SEGMENT_GRAMS))
    rows = documents(docs).where(_training(s)).mapInArrow(_gram_counts(s.order, buckets), "bucket int, hashes binary, counts binary")
    segments = written(rows.groupBy("bucket").applyInArrow(_segment(s), "bucket int, grams long, items long, bits binary"))
    sizes = sorted((r[0], r[1]) for r in segments.select("bucket", F.length("bits")).collect())
    blocks = _runs(sizes, s.block_bytes) or [[]]
    send = docs.sparkSession.sparkContext.broadcast
    made = []
    if len(blocks) <= s.most_blocks:
        for own in blocks:
            made.append(send(_collected(segments, own, buckets, s.probes)))
        dropped(segments)
    head, complete = _head(counts, s)
    return Model(Facts(s, tokens, types, texts, buckets, complete), made, None if made else segments, send(head), counts)


def _probed(seq: np.ndarray, ends: np.ndarray, order: int, block: Block | Answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The levels of the grams that end at each place, a row for each order; distinct words, and which of them is where."""
    out = np.zeros((order, len(seq)), np.uint8)
    words, where = np.unique(seq, return_inverse=True)
    for n, (h, counts) in enumerate(grams(seq, ends, order)):
        if n:
            distinct, back = np.unique(h[counts], return_inverse=True)
            out[n, counts] = block.levels(distinct)[back]
        else:
            out[0] = np.where(counts, block.levels(mixed(words))[where], 0)
    return out, words, where


def _logs(levels: np.ndarray, ends: np.ndarray, s: Settings, tokens: int, types: int) -> np.ndarray:
    """log10 of the probability of the token at each place; of use at the tokens of the texts only.

    Each order adds ``strength`` times the order below to its counts: (c(gram) + m p) / (c(context) + m), where no gram
    counts more often than its context.
    """
    counts = middles(s.growth)[levels]
    p = (np.minimum(counts[0], tokens) + 1) / (tokens + types + 1)
    for n in range(1, s.order):
        context = np.concatenate(([0.0], counts[n - 1][:-1]))
        p = (np.minimum(counts[n], context) + s.strength * p) / (context + s.strength)
    return np.log10(p)


def _per_text(values: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Sums over the tokens of each text: starts are left out."""
    run = np.concatenate(([0], np.cumsum(values)))
    return run[ends] - run[np.concatenate(([0], ends[:-1])) + order - 1] if len(ends) else np.zeros(0)


def _passing(block: Broadcast, order: int):
    """Fills in the levels that a block knows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = []
            whole, known = column_bytes(batch, "text"), column_list(batch, "levels")
            for part in chunks(whole):
                seq, ends = sequences(words_of(whole[part]), order)
                found = _probed(seq, ends, order, block.value)[0]
                for a, b, before in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), known[part], strict=True):
                    own = found[:, a:b].tobytes()
                    levels.append(own if not before else (np.frombuffer(own, np.uint8) | np.frombuffer(before, np.uint8)).tobytes())
            place = batch.schema.get_field_index("levels")
            yield batch.set_column(place, "levels", pa.array(levels, pa.binary()))

    return lambda batches: released(of(batches))


_SCORE = "doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, n: int>>"


def _scores(whole: list[bytes], before: list[bytes | None], source: Block | Answers, head: tuple[bytes, bytes], facts: Facts) -> list[list]:
    """Numbers of tokens, of known ones, base and score of texts, and their words that aren't in the head, if it lacks any.

    before: levels that other blocks knew (None: there are none).
    """
    s = facts.settings
    words = words_of(whole)
    seq, ends = sequences(words, s.order)
    levels, distinct, where = _probed(seq, ends, s.order, source)
    at = np.concatenate(([0], ends))
    for i, old in enumerate(before):
        if old is not None:
            levels[:, at[i] : at[i + 1]] |= np.frombuffer(old, np.uint8).reshape(s.order, -1)
    hashes, counts = np.frombuffer(head[0], _U), np.frombuffer(head[1], np.int64)
    n = np.zeros(len(distinct), np.int64)
    if len(hashes):
        place = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
        n = np.where(hashes[place] == distinct, counts[place], 0)
    n[distinct == START] = 0
    n[distinct == END] = facts.texts
    n = n[where]
    size = np.diff(ends, prepend=0) - s.order + 1
    base = _per_text(np.log10(n + 1.0), ends, s.order) - size * np.log10(facts.tokens + facts.types + 1.0)
    score = _per_text(_logs(levels, ends, s, facts.tokens, facts.types), ends, s.order)
    tails: list[list[dict]] = [[] for _ in whole]
    if not facts.complete:
        rare = np.flatnonzero(n[np.arange(len(words.hashes)) + np.repeat(s.order * np.arange(len(ends)) + s.order - 1, words.counts)] == 0)
        owner = np.searchsorted(np.cumsum(words.counts), rare, "right")
        for (text, word), times in Counter(zip(owner.tolist(), map(words.word, rare.tolist()), strict=True)).items():
            tails[text].append({"word": word, "n": times})
    return [size.tolist(), _per_text(n > 0, ends, s.order).tolist(), base.tolist(), score.tolist(), tails]


_KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))
_SCORED = ["doc_id", "n_tokens", "n_known", "base", "score", "tail"]


def _scoring(block: Broadcast, head: Broadcast, facts: Facts):
    """Scores of texts by the last block of the filter."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, levels = column_bytes(batch, "text"), column_list(batch, "levels")
            out: list[list] = [[], [], [], [], []]
            for part in chunks(whole):
                for have, new in zip(out, _scores(whole[part], levels[part], block.value, head.value, facts), strict=True):
                    have += new
            made = [pa.array(x, k) for x, k in zip(out, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *made], _SCORED)

    return lambda batches: released(of(batches))


#: Bytes of text whose grams are looked up together; a row counts as ROW_BYTES more. Each group asks nearly each bucket, so
#: that requests are as many as groups times buckets: small groups make as many requests as there are grams.
GROUP_BYTES, ROW_BYTES = 4 << 20, 64


class Answers:
    """Levels of grams that were looked up."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray) -> None:
        self.hashes, self.known = hashes, levels

    def levels(self, h: np.ndarray) -> np.ndarray:
        return self.known[np.searchsorted(self.hashes, h)]


def _distinct_grams(texts: list[bytes], order: int) -> np.ndarray:
    held = []
    for part in chunks(texts):
        seq, ends = sequences(words_of(texts[part]), order)
        held.append(np.unique(np.concatenate([h[counts] for h, counts in grams(seq, ends, order)])))
    return np.unique(np.concatenate(held)) if len(held) > 1 else held[0]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their group: runs of a task's rows of some GROUP_BYTES."""
    task, before = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
        ends = before + np.cumsum(sizes)
        before = int(ends[-1]) if len(ends) else before
        yield batch.append_column("group", pa.array(task + (ends - sizes) // GROUP_BYTES, pa.int64()))


def _texts_of(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]


def _looked_up(docs: DataFrame, segments: DataFrame, head: Broadcast, facts: Facts) -> DataFrame:
    """Scores of texts whose grams meet the segments by their buckets: no part of the filter is broadcast.

    What a bucket is asked is as much as its own grams, on average; a group of rows asks for each distinct gram once, and
    each bucket at most once.
    """
    s, buckets = facts.settings, facts.buckets
    asking = pa.schema([("group", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary())])
    telling = pa.schema([("group", pa.int64()), ("bucket", pa.int32()), ("levels", pa.binary())])

    def asked(table: pa.Table) -> pa.Table:
        h = _distinct_grams(_texts_of(table), s.order)
        own = _bucket(h, buckets)
        at = np.flatnonzero(np.diff(own, prepend=-1))
        blobs = [x.astype("<u8").tobytes() for x in np.split(h, at[1:])]
        return pa.table([[table["group"][0].as_py()] * len(at), own[at], blobs], schema=asking)

    def told(requests: pa.Table, own: pa.Table) -> pa.Table:
        if not len(requests):
            return telling.empty_table()
        bits = [x.as_buffer() for x in own["bits"]]
        block = Block(own["bucket"].to_pylist(), [len(x) for x in bits], buckets, s.probes).filled(own["bucket"].to_pylist(), bits)
        asked_for = [x.as_buffer() for x in requests["hashes"]]
        ends = np.cumsum([len(x) // 8 for x in asked_for])
        found = block.levels(np.concatenate([np.frombuffer(x, "<u8") for x in asked_for]))
        blobs = [found[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.table([requests["group"], requests["bucket"], pa.array(blobs, pa.binary())], schema=telling)

    def answered(texts: pa.Table, answers: pa.Table) -> pa.Table:
        whole = _texts_of(texts)
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["levels"].to_pylist(), strict=True))
        source = Answers(_distinct_grams(whole, s.order), np.frombuffer(b"".join(x for _, x in parts), np.uint8))
        out: list[list] = [[], [], [], [], []]
        for part in chunks(whole):
            for have, new in zip(out, _scores(whole[part], [], source, head.value, facts), strict=True):
                have += new
        return pa.table([texts["doc_id"], *(pa.array(x, k) for x, k in zip(out, _KINDS, strict=True))], names=_SCORED)

    grouped = written(documents(docs).select("doc_id", "text").mapInArrow(_grouped, "doc_id long, text string, group long"))
    requests = grouped.groupBy("group").applyInArrow(asked, "group long, bucket int, hashes binary")
    replies = requests.groupBy("bucket").cogroup(segments.select("bucket", "bits").groupBy("bucket")).applyInArrow(told, "group long, bucket int, levels binary")
    return grouped.groupBy("group").cogroup(replies.groupBy("group")).applyInArrow(answered, _SCORE)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), by row.

    Whole texts, however long: words and one end are the tokens. Null and empty texts are the end alone. base_score is exact;
    score comes from the filter, which never takes a count for less than its level. Repeated rows give repeated results, a
    null id isn't held out; other columns are dropped. Of a model without texts every probability is that of its order: 1
    for the base. An empty table stays empty.
    """
    facts, s = model.facts, model.facts.settings
    if model.segments is not None:
        out = _looked_up(docs, model.segments, model.head, facts)
    else:
        rows = documents(docs).withColumn("levels", F.lit(None).cast("binary"))
        last: DataFrame | None = None
        for block in model.blocks[:-1]:
            rows = written(rows.mapInArrow(_passing(block, s.order), "doc_id long, text string, levels binary"))
            if last is not None:
                dropped(last)
            last = rows
        out = rows.mapInArrow(_scoring(model.blocks[-1], model.head, facts), _SCORE)
    if not facts.complete:
        out = written(out.withColumn("__row", F.monotonically_increasing_id()))
        rare = out.select("__row", F.explode("tail").alias("t")).select("__row", "t.word", F.col("t.n").alias("times"))
        met = spread_join(rare, model.counts.where("word is not null").select("word", F.col("n").alias("c")), "word")
        more = met.groupBy("__row").agg(F.sum(F.log10(F.col("c") + 1.0) * F.col("times")).alias("__base"), F.sum("times").alias("__known"))
        out = out.join(more, "__row", "left")
        out = out.withColumn("base", F.col("base") + F.coalesce("__base", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("__known", F.lit(0)))
    held = ~_training(s)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """All docs by the model of the training texts among them."""
    return scored(docs, trained(docs, s))
