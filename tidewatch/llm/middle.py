"""Fill-in-middle: a text's tokens are cut in three, and the parts are put in another order behind sentinels.

Token ends are a bit for each byte of an Arrow batch, packed to words, beside a directory of popcounts by block. A rank at
both ends of a text gives its number of tokens; a select on the two drawn ranks gives the cuts in bytes. Starts of code
points are a second such vector, whose ranks give the sizes in characters. No token is ever made, nor a list of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, column_list, documents, released

SPACES = (0x20, *range(0x09, 0x0E))
_IS_SPACE = np.isin(np.arange(256), SPACES)
_IS_START = (np.arange(256) & 0xC0) != 0x80


@dataclass(frozen=True)
class Format:
    """Sentinels, shares and the seed of the draws."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 50
    spm: int = 80
    seed: int = 42


class BitVector:
    """Packed bits with a directory of popcounts: rank and select without unpacking the whole."""

    BLOCK = 8  # words of 64 bits

    def __init__(self, bits: np.ndarray) -> None:
        words = -(-len(bits) // (64 * self.BLOCK)) * self.BLOCK + self.BLOCK  # a block of zeros at the end
        packed = np.zeros(words * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, self.BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    def _words_before(self, block: np.ndarray) -> np.ndarray:
        """Popcounts before each word of each block, within the block."""
        at = block[:, None] * self.BLOCK + np.arange(self.BLOCK)
        counts = np.bitwise_count(self.words[at]).astype(np.int64)
        return np.cumsum(counts, axis=1) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits that are set before each position."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        block = word // self.BLOCK
        inside = self._words_before(block)[np.arange(len(at)), word % self.BLOCK]
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + inside + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th bit that is set, from 1."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "left") - 1
        left = k - self.before[block]
        inside = self._words_before(block)
        place = (inside < left[:, None]).sum(1) - 1
        left -= inside[np.arange(len(k)), place]
        word = block * self.BLOCK + place
        each = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + np.argmax(np.cumsum(each, axis=1) == left[:, None], axis=1)


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bit for the last byte of each token: a word's last byte, or a text's if it is white space."""
    space = _IS_SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = True
    return ends


def _cut(form: Format):
    marks = [x.encode() for x in (form.prefix, form.suffix, form.middle)]
    literal = re.compile(b"|".join(map(re.escape, marks)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch, "text")
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends, starts = BitVector(token_ends(data, offsets)), BitVector(_IS_START[data])
            base = ends.rank(offsets)
            n = np.diff(base)
            draws = np.array(column_list(batch, "draws"), np.int64).reshape(-1, 4)
            units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            cuts = np.repeat(offsets[:-1, None], 2, axis=1)
            some = units > 0
            cuts[some] = ends.select((base[:-1, None] + units)[some]) + 1
            chars = np.diff(np.stack([starts.rank(x) for x in (offsets[:-1], cuts[:, 0], cuts[:, 1])]), axis=0)
            forms, outputs = [], []
            for text, (a, b), drawn in zip(texts, (cuts - offsets[:-1, None]).tolist(), draws.tolist(), strict=True):
                if not text or drawn[2] % 100 >= form.rate or literal.search(text):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                (p, s, m), head, mid, tail = marks, text[:a], text[a:b], text[b:]
                spm = drawn[3] % 100 < form.spm
                forms.append("spm" if spm else "psm")
                outputs.append(b"".join((s, tail, p, head, m, mid) if spm else (p, head, s, tail, m, mid)))
            plain = np.array([x == "plain" for x in forms], bool)
            made = {
                "n": pa.array(n, pa.int64()),
                "form": pa.array(forms, pa.string()),
                "prefix_chars": pa.array(chars[0], pa.int64(), mask=plain),
                "middle_chars": pa.array(chars[1], pa.int64(), mask=plain),
                "output": pa.array(outputs, pa.binary()).cast(pa.string()),
            }
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *made.values()], ["doc_id", *made])

    return lambda batches: released(of(batches))


def _draws(form: Format) -> Column:
    """Four unsigned draws of 32 bits for each document, from a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{form.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def transformed(docs: DataFrame, form: Format = Format()) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, by row.

    Whole texts, however long. A null or empty text is plain, with no tokens and an empty output; so is a text that holds a
    sentinel already, which couldn't be told from ours. Draws hang on doc_id alone: rows of one id are cut at the same
    draws, repeated rows give repeated results, and a null id is drawn as an empty one. Equal draws leave the middle empty.
    Other columns are dropped; an empty table stays empty.
    """
    rows = documents(docs).withColumn("draws", _draws(form))
    return rows.mapInArrow(_cut(form), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, form: Format = Format(), name: str = "restored") -> DataFrame:
    """made with the text that its ``output`` and ``form`` came from; sentinels are searched for, no sizes are used."""
    out, at = F.col("output"), lambda mark: F.locate(mark, F.col("output"))

    def between(left: str, right: str | None) -> Column:
        start = at(left) + len(left)
        return F.substr(out, start, at(right) - start) if right else F.substr(out, start)

    p, s, m = form.prefix, form.suffix, form.middle
    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return made.withColumn(name, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))


def digests(docs: DataFrame, form: Format = Format()) -> DataFrame:
    """``transformed`` with digests of the output and of the text that is restored from it instead of the texts."""
    back = restored(transformed(docs, form), form)
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def sql(form: Format = Format()) -> str:
    """The same in DuckDB's SQL over documents."""
    p, s, m = (f"'{x}'" for x in (form.prefix, form.suffix, form.middle))
    draw = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{form.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {draw(0)} % (len(u) + 1) AS a, {draw(1)} % (len(u) + 1) AS b,
 CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {form.rate} THEN 'plain'
 WHEN {draw(3)} % 100 < {form.spm} THEN 'spm' ELSE 'psm' END AS form FROM t),
parts AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS head, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
 array_to_string(u[greatest(a, b) + 1:], '') AS tail FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || head || {s} || tail || {m} || mid ELSE {s} || tail || {p} || head || {m} || mid END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM parts"""
