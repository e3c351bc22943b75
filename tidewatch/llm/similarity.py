"""Exact Jaccard self-join of word-shingle sets, for connected groups of similar documents.

The index: a set's shingle hashes in ascending order are cut at fixed places of the hash range into blocks, more than two
linked sets can differ in, so that linked sets share a whole block at the same position. A list is kept for each (size
class, position, block content); all other positions are skipped without a look.

Lists are folded before they are shuffled: of the sets of one Arrow batch that share a block, only the smallest goes to the
list; the others stand in it by way of that one (their local pivot). So a block that a third of all sets hold puts a row
for each batch into one task, not a row for each set.

The answers: within a list, each set is compared with the smallest one first (those of a batch with their local pivot). Sets that this links, directly or by other
lists, share its component and need no comparison with each other, however long the list is. Only lists that still hold
several components go on: parity bits of the hashes bound the difference of two sets from below, and pairs of different
components that pass this bound are compared. Long lists are compared in chunks, so that no task holds all of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, documents, dropped, hot_keys, released, spread_join, written
from .components import components

#: Digests of texts that a task remembers, to tell copies, at most.
SEEN = 50_000
#: Sets of one list that a task holds on each side, at most (about).
CHUNK = 4096
#: Words of parity bits that are compared at once, about.
PLACES = 1 << 18
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles; of fewer words, the whole sequence is one."""
    words = data.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = out * _MUL + h[j : j + len(out)]
    return np.unique(_mixed(out))


class Classes:
    """Size classes: linked sets are in one class or in adjacent ones. percent: the least similarity in hundredths."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def bounds(self, size: int) -> tuple[int, int]:
        """The number of the class of size, and its largest size."""
        no, top = 0, 1
        while top < size:
            no, top = no + 1, (top + 1) * 100 // self.percent
        return no, top

    def blocks(self, top: int) -> tuple[int, int]:
        """Blocks that sets of up to top shingles are cut into, and how many linked ones share at least."""
        differ = 2 * top * (100 - self.percent) // (100 + self.percent)
        spare = 0 if differ < 2 else 2 + differ // 25
        return differ + 1 + spare, 1 + spare


def block_keys(hashes: np.ndarray, no: int, blocks: int, shared: int) -> np.ndarray:
    """Keys of a set's blocks in one class.

    Blocks without shingles are left out where fewer than shared are empty: then a linked set shares another one. Else
    some of their places are keys, too.
    """
    place = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    heads = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    sums = np.add.reduceat(_mixed(hashes), heads)
    keys = _mixed(sums + _mixed(place[heads] * np.uint64(1 << 20) + np.uint64(no)))
    empty = blocks - len(heads)
    if empty >= shared:
        at = np.setdiff1d(np.arange(blocks, dtype=np.uint64), place[heads])
        # Two sets that agree on shared empty places have one in common among all but the last shared - 1 of each.
        extra = [_mixed(np.array([at[i] * np.uint64(1 << 20) + np.uint64(no)], dtype=np.uint64) + _MUL) for i in range(empty - shared + 1)]
        keys = np.concatenate([keys, *extra])
    return keys


def _rows(width: int, percent: int):
    classes = Classes(percent)
    known: dict[int, list[tuple[int, int, int]]] = {}

    def own(size: int) -> list[tuple[int, int, int]]:
        if size not in known:
            no, top = classes.bounds(size)
            after = (top + 1) * 100 // percent
            known[size] = [(no, *classes.blocks(top)), (no + 1, *classes.blocks(after))]
        return known[size]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(rows(batches))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        none = np.zeros(0, np.uint64)
        for batch in batches:
            docs, sizes, keys = batch.column(0).fill_null(0).to_numpy(), [], []
            for data in column_bytes(batch, "text"):
                digest = xxhash.xxh3_128_digest(data)
                if digest in seen:  # a copy adds nothing to the lists
                    sizes.append(seen[digest])
                    keys.append(none)
                    continue
                h = shingle_set(data, width)
                if len(seen) >= SEEN:
                    seen = {}
                seen[digest] = len(h)
                sizes.append(len(h))
                keys.append(np.concatenate([block_keys(h, *c) for c in own(len(h))]) if len(h) else none)
            yield from _folded_lists(docs, np.array(sizes, dtype=np.int32), keys)

    return of


_KEYED = "doc_id long, n int, pivot long, pn int, keys array<long>"


def _folded_lists(docs: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each document with the keys that go to the lists (pivot null), and one for each of its local pivots."""
    if not len(docs):
        return
    flat, of = np.concatenate(keys), np.repeat(np.arange(len(docs)), [len(k) for k in keys])
    order = np.lexsort((docs[of], flat))
    flat, of = flat[order], of[order]
    head = np.ones(len(flat), dtype=bool)
    head[1:] = flat[1:] != flat[:-1]
    first = of[np.flatnonzero(head)][np.cumsum(head) - 1] if len(flat) else of
    head |= docs[first] == docs[of]
    out = []
    for rows, local in ((head, False), (~head, True)):
        k, o, p = flat[rows], of[rows], first[rows] if local else np.zeros(int(rows.sum()), dtype=np.int64)
        by = np.lexsort((p, o))
        k, o, p = k[by], o[by], p[by]
        if local:
            new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1]))) if len(o) else o
            own, pivots, ends = o[new], p[new], np.append(new[1:], len(o)) if len(o) else o
            docs_of, n_of = pa.array(docs[pivots], pa.int64()), pa.array(sizes[pivots], pa.int32())
        else:
            own, ends = np.arange(len(docs)), np.cumsum(np.bincount(o, minlength=len(docs)))
            docs_of, n_of = pa.nulls(len(docs), pa.int64()), pa.nulls(len(docs), pa.int32())
        offsets = pa.array(np.append(0, ends).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(k.view(np.int64)))
        out.append([pa.array(docs[own], pa.int64()), pa.array(sizes[own], pa.int32()), docs_of, n_of, lists])
    for arrays in out:
        if len(arrays[0]):
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "pivot", "pn", "keys"])


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(k) for k in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def parity_bits(hashes: np.ndarray, percent: int) -> np.ndarray:
    """For each place of a bit set, whether an odd number of hashes falls there: as 64-bit words, a power of two of them.

    Sets whose bits differ in d places differ in d shingles at least. There are some four places for each shingle in which
    linked sets may differ. Bits of twice the size fold to the smaller size by xor of their halves.
    """
    most = 2 * len(hashes) * (100 - percent) // (100 + percent)
    words = 1 << max(3, int(np.ceil(np.log2(max(most, 1) / 16))))
    place = hashes & np.uint64(64 * words - 1)
    odd = np.bincount((place >> np.uint64(6)).astype(np.int64) * 64 + (place & np.uint64(63)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _sets(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, width).view(np.int64) for x in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(sets)], ["doc_id", "hashes"])

    return of


def _bits(width: int, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, width) for x in column_bytes(batch, "text")]
            bits = [parity_bits(h, percent).view(np.int64) for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), _listed(bits)], ["doc_id", "n", "bits"])

    return of


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _close(percent: int):
    """Of the rows of each (key, i, j): pairs of different components whose sizes and bits don't rule out a link."""

    def pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, n, component, side = (rows.column(c).to_numpy() for c in ("doc", "n", "component", "side"))
        listed = rows.column("bits").combine_chunks()
        offsets, flat = listed.offsets.to_numpy(), listed.values.to_numpy().view(np.uint64)
        words = int(np.diff(offsets).min())
        x = np.stack([_folded(flat[s:e], words) for s, e in zip(offsets[:-1], offsets[1:], strict=True)])
        left = int((side == 0).sum())
        crossed = left < len(doc)
        right = np.arange(left, len(doc)) if crossed else np.arange(left)
        step = max(1, PLACES // max(1, len(right) * words))  # rows of the left side at a time
        a, b = [], []
        for at in range(0, left, step):
            i = np.arange(at, min(left, at + step))
            n1, n2 = n[i, None].astype(np.int64), n[None, right].astype(np.int64)
            may = (component[i, None] != component[None, right]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            if not crossed:
                may &= i[:, None] < right[None, :]
            p, q = np.nonzero(may)
            apart = np.bitwise_count(x[i[p]] ^ x[right[q]]).sum(1, dtype=np.int64)
            close = apart * (100 + percent) <= (n[i[p]].astype(np.int64) + n[right[q]]) * (100 - percent)
            one, two = doc[i[p[close]]], doc[right[q[close]]]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
        z = np.zeros(0, dtype=np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (z, z)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key, i, j = (rest.column(c).to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip([0, *cuts[:-1]], cuts, strict=False):
                a, b = pairs(rest.slice(s, e - s))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            if len(cuts):
                rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            a, b = pairs(rest)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return of


def _apart(x: Column, y: Column) -> Column:
    """Places in which two bit sets differ, the larger one folded."""
    k = F.least(F.size(x), F.size(y))

    def folded(bits: Column) -> Column:
        word = lambda i: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(bits) / k).cast("int") - 1), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.get(bits, i + j * k)))
        return F.transform(F.sequence(F.lit(0), k - 1), word)

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, n: a + n)


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of written pairs (a, b), those whose sizes and bits don't rule out a link."""
    side = lambda c, n, x: bits.select(F.col("doc_id").alias(c), F.col("n").alias(n), F.col("bits").alias(x))
    both = spread_join(pairs.join(side("b", "nb", "y"), "b"), side("a", "na", "x"), "a", counted=pairs)
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    close = _apart(F.col("x"), F.col("y")) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return both.where(close).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Of written pairs (a, b), those whose sets are similar. A set goes to the other side of each of its pairs."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(_chosen(rows, ids).mapInArrow(_sets(width), "doc_id long, hashes array<long>"))
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    both = spread_join(left, sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a", counted=pairs)
    common = F.size(F.array_intersect("x", "y"))
    similar = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    out = written(both.where(similar).select("a", "b").distinct())
    dropped(sets)
    return out


def _first_of(copies: DataFrame, df: DataFrame, column: str, counted: DataFrame | None = None) -> DataFrame:
    """df with the ids in column replaced by those of the smallest document of the same text.

    counted: a written table with that column, where ids may be hot."""
    of = copies.select(F.col("doc_id").alias(column), F.col("first").alias("__first"))
    joined = df.join(of, column, "left") if counted is None else spread_join(df, of, column, "left", counted)
    return joined.withColumn(column, F.coalesce("__first", column)).drop("__first")


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id and ``first``, the smallest id of the same text, of each document that isn't that one.

    Digests are counted and their smallest ids found before they are shuffled; documents of a hot digest find theirs by a
    broadcast of at most HOT_KEYS digests.
    """
    texts = rows.where("text <> ''").select("doc_id", F.md5("text").alias("digest"))
    found = texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return written(spread_join(texts, found.select("digest", "first"), "digest").where("doc_id <> first").select("doc_id", "first").distinct())


def _close_pairs(rest: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs to compare in lists of several components (a written table: key, doc, n, component)."""
    hot = hot_keys(rest, "key", CHUNK)
    chunks = F.lit(1) if hot is None else F.coalesce("__parts", F.lit(1))
    own = F.pmod(F.xxhash64("doc"), chunks).cast("int")
    meet = lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (own > o).cast("int").alias("side"))
    dealt = rest if hot is None else rest.join(F.broadcast(hot), "key", "left")
    dealt = dealt.withColumn("m", F.explode(F.transform(F.sequence(F.lit(0), chunks - 1), meet)))
    rows = dealt.join(bits.select(F.col("doc_id").alias("doc"), "bits"), "doc")
    rows = rows.select("key", "m.i", "m.j", "m.side", "doc", "n", "component", "bits").repartition("key", "i", "j")
    return rows.sortWithinPartitions("key", "i", "j", "side", "doc").mapInArrow(_close(percent), "a long, b long").distinct()


def _lists(rows: DataFrame, width: int, percent: int, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id and n_shingles of each row; and the lists, as (key, pivot, pn, doc, n, top, local).

    top is the pivot before copies are replaced by the smallest document of their text."""
    made = rows.mapInArrow(_rows(width, percent), _KEYED)
    # One more row for each document tells its size. Its key meets no other: a chance match costs a comparison.
    every = F.when(F.col("pivot").isNull(), F.concat(F.array(F.xxhash64("doc_id")), "keys")).otherwise(F.concat(F.array(F.lit(0).cast("long")), "keys"))
    keyed = made.select("doc_id", "n", "pivot", "pn", F.posexplode(every).alias("at", "key")).where("at > 0 or pivot is null")
    # Rows with a local pivot need no list and are dealt out by document.
    salt = F.when(F.col("pivot").isNotNull(), F.xxhash64("doc_id")).otherwise(F.lit(0))
    order = Window.partitionBy("key", "salt").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.struct("doc_id", "n")).over(order)
    listed = keyed.withColumn("salt", salt).withColumn("p", first).where("at = 0 or pivot is not null or doc_id <> p.doc_id")
    listed = written(listed.select(
        "at", "key", F.coalesce("pivot", "p.doc_id").alias("pivot"), F.coalesce("pivot", "p.doc_id").alias("top"),
        F.coalesce("pn", "p.n").alias("pn"), F.col("doc_id").alias("doc"), "n", F.col("pivot").isNotNull().alias("local")))
    sizes = written(listed.where("at = 0").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles")))
    own = listed.where("at > 0").drop("at")
    lists = _first_of(copies, _first_of(copies, own, "doc"), "pivot", own).where("doc <> pivot")
    lists = written(lists.select("key", "pivot", "pn", "doc", "n", "top", "local").distinct())
    dropped(listed)
    return sizes, lists


def grouped(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Documents link when 100 * shared shingles >= percent * all shingles of both; component_id is the smallest doc_id that
    links reach. Texts without words (null, empty, white space) have no shingles and are linked with nothing. Whole texts
    count, however long. Rows of one id share its links; rows without an id have none, and their component is null. An
    empty table gives no rows.
    """
    every = documents(docs)
    rows = every.where("doc_id is not null")
    copies = _copies(rows)
    sizes, lists = _lists(rows, width, percent, copies)

    asked = lists.select(F.col("pivot").alias("doc_id")).unionByName(lists.select(F.col("doc").alias("doc_id"))).distinct()
    bits = written(_chosen(rows, asked).mapInArrow(_bits(width, percent), "doc_id long, n long, bits array<long>"))
    fit = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    pairs = written(lists.where(fit).select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct())
    first = written(_possible(pairs, bits, percent))
    links = verified(first, rows, width, percent)
    found = components(links)
    # Where a list has local pivots, its own pivot hasn't met the sets behind them: it meets those of other components now.
    tops = lists.groupBy("key").agg(F.max("local").alias("local"), F.min("top").alias("top")).where("local").select("key", "top")
    tops = written(_first_of(copies, tops, "top"))
    behind = spread_join(lists.where("local").select("key", "doc").distinct(), tops, "key").select("top", "doc").distinct()
    of = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    behind = written(behind.where("top <> doc").join(of("doc", "own"), "doc", "left"))
    behind = spread_join(behind, of("top", "other"), "top", "left")
    apart = F.coalesce("own", "doc") != F.coalesce("other", "top")
    behind = written(behind.where(apart).select(F.least("top", "doc").alias("a"), F.greatest("top", "doc").alias("b")).distinct())
    near = written(_possible(behind, bits, percent))
    links = links.unionByName(verified(near, rows, width, percent))
    found = components(links)
    tops = tops.withColumnRenamed("top", "doc").join(bits.select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n")), "doc")
    placed = lists.select("key", "doc", "n").unionByName(tops.select("key", "doc", "n"))
    placed = placed.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    placed = written(placed.select("key", "doc", "n", F.coalesce("component", "doc").alias("component")).distinct())
    # Of lists with the same sets (told by two hashes and their number), one goes on.
    whole = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("doc")).alias("h"),
        F.bit_xor(F.xxhash64("doc", F.lit("again"))).alias("g"), F.count("*").alias("c"))
    mixed = whole.where("low <> high").groupBy("h", "g", "c").agg(F.min("key").alias("key")).select("key")
    rest = written(spread_join(placed, mixed, "key"))
    more = verified(written(_close_pairs(rest, bits, percent)), rows, width, percent)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    dropped(pairs, first, behind, near, placed, rest, lists, bits)

    out = written(_first_of(copies, sizes.withColumn("component_id", F.col("doc_id")), "component_id"))
    out = spread_join(out, found.withColumnRenamed("node", "component_id"), "component_id", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    lost, null = every.where("doc_id is null").mapInArrow(_rows(width, percent), _KEYED).where("pivot is null"), F.lit(None).cast("long")
    return out.unionByName(lost.select(null.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null.alias("component_id")))


#: So many ids are sent to all executors; more are joined by a shuffle.
SENT_IDS = 1 << 21


def _chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left_semi")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (all columns) with one row of each group: that of the smallest doc_id.

    Of rows with the same id one stays (that of the smallest text); of rows without an id, one of each text. Texts without
    words (null, empty) are in no group and stay. An empty table stays empty.
    """
    gone = grouped(docs, width, percent).where("component_id < doc_id")
    gone = written(gone.select(F.col("doc_id").alias("__gone")).distinct())
    few = gone.count() <= SENT_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    # Repeated rows: found by their ids (or digests) alone, so that other rows aren't shuffled.
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text "), F.md5(text)))
    again = written(kept.select(key.alias("__key")).where("__key is not null").groupBy("__key").count().where("count > 1").select("__key"))
    if again.isEmpty():
        return kept
    marked = again.withColumn("__again", F.lit(True))
    keyed = kept.withColumn("__key", key).join(F.broadcast(marked) if again.count() <= SENT_IDS else marked, "__key", "left")
    row = F.struct(*(F.col(c) for c in docs.columns))
    one = keyed.where("__again").groupBy("__key").agg(F.min_by(row, F.struct(text.isNull(), text)).alias("__row")).select("__row.*")
    return keyed.where("__again is null").select(*docs.columns).unionByName(one)


def sql(width: int = 3, percent: int = 90) -> str:
    """The same as grouped in DuckDB's SQL over documents."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {width - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - {width - 1}, 1) + 1 AS BIGINT))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""
