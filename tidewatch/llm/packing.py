"""Bounded-space online packing of token ids into sequences.

Each partition keeps ``open_windows`` windows. A document's full sequences go out at once; its rest goes to the fullest
window it fits (best fit). If it fits none, the fullest window is topped up with the head of the rest, if its gap is worth
a piece, and goes out. What is open at the end of a partition is merged, ``merge`` partitions at a time, end to end.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, released, written
from .tokens import Encoder, crc, default_tokenizer, encoder

LENGTH = 1024
OPEN = 32
MERGE = 64
#: A gap smaller than this is padded, not topped up with a piece.
LEAST = 16
#: Bytes of text that are encoded at a time: fewer than for the files, for memory.
TEXT_BYTES = 1 << 20

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """The windows of one partition. Pieces that are settled go to ``out``; ``rest`` are those of open windows."""

    def __init__(self, first: int, length: int, open_windows: int) -> None:
        self.next, self.length, self.most = first, length, open_windows
        self.windows: list[tuple[int, int]] = []  # (fill, sequence_id), ascending
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def _piece(self, doc: tuple[int, np.ndarray], start: int, size: int, sequence: int, offset: int) -> tuple:
        doc_id, ids = doc
        return (doc_id, start, size, ids[start : start + size], len(ids), sequence, offset)

    def _settle(self, sequence: int) -> None:
        self.out += self.held.pop(sequence)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        doc, start = (doc_id, ids), 0
        while start < len(ids):
            size = min(len(ids) - start, self.length)
            if size == self.length:
                self.out.append(self._piece(doc, start, size, self.next, 0))
                self.next += 1
                start += size
                continue
            at = bisect_left(self.windows, (self.length - size + 1, -1)) - 1
            if at >= 0:
                fill, sequence = self.windows.pop(at)
            elif len(self.windows) < self.most:
                fill, sequence = 0, self.next
                self.next += 1
                self.held[sequence] = []
            else:
                fill, sequence = self.windows.pop()
                gap = self.length - fill
                if gap >= LEAST and size - gap >= LEAST:
                    self.held[sequence].append(self._piece(doc, start, gap, sequence, fill))
                    start += gap
                self._settle(sequence)
                continue
            self.held[sequence].append(self._piece(doc, start, size, sequence, fill))
            start += size
            if fill + size == self.length:
                self._settle(sequence)
            else:
                insort(self.windows, (fill + size, sequence))

    def rest(self) -> list[tuple]:
        return [p for _, sequence in self.windows for p in self.held[sequence]]


def _batch(pieces: list[tuple], part: int, is_open: bool) -> pa.RecordBatch:
    cols = list(zip(*pieces, strict=True)) or [[]] * 7
    arrays = [pa.array(cols[i], pa.int64()) for i in (0, 1, 2)] + [pa.array([crc(x) for x in cols[3]], pa.int64())] + [pa.array(cols[i], pa.int64()) for i in (4, 5, 6)]
    ids = pa.array([x.astype("<u4").tobytes() if is_open else None for x in cols[3]], pa.binary())
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(pieces), pa.int64()), ids], [*_NAMES, "part", "ids"])


def _pack(path: str, length: int, open_windows: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as coder:
            yield from released(pieces(coder, TaskContext.get().partitionId(), batches))

    def pieces(coder: Encoder, part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(part << 32, length, open_windows)
        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for ids, sizes in coder.documents(batch.column(1), TEXT_BYTES):
                for own in np.split(ids, np.cumsum(sizes)[:-1]):
                    packer.add(next(doc_ids), own)
                if len(packer.out) >= 5000:
                    yield _batch(packer.out, part, False)
                    packer.out = []
        yield _batch(packer.out, part, False)
        yield _batch(packer.rest(), part, True)

    return of


def _merge(length: int):
    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "sequence_id", "offset"])
        sequence, fill, out = (1 << 62) + (key[0] << 24), 0, []
        for r in rows.itertuples(index=False):
            ids, done = np.frombuffer(r.ids, dtype="<u4"), 0
            while done < len(ids):
                part = ids[done : done + length - fill]
                out.append((r.doc_id, r.start + done, len(part), crc(part), r.doc_tokens, sequence, fill))
                done, fill = done + len(part), fill + len(part)
                if fill == length:
                    sequence, fill = sequence + 1, 0
        return pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})

    return of


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, open_windows: int = OPEN, merge: int = MERGE) -> DataFrame:
    """The pieces of each document: where each starts there, its sequence and its offset in that.

    Null and empty texts are the end id alone; an empty table has no pieces. Each id lies in exactly one piece, however long
    its text. Repeated rows are packed each for itself, and a null doc_id stays null. Ids of sequences are unique, not
    consecutive.
    """
    made = documents(docs).mapInArrow(_pack(tokenizer or default_tokenizer(), length, open_windows), f"{PIECE}, part long, ids binary")
    made = written(made)  # else both branches below would tokenize
    settled = made.where("ids is null").select(*_NAMES)
    rest = made.where("ids is not null").groupBy(F.floor(F.col("part") / merge).alias("merged")).applyInPandas(_merge(length), PIECE)
    return settled.unionByName(rest)
