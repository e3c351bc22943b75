"""Token ids of whole texts, in Arrow stream files of fixed-size sequences, with random access without copies.

Documents are dealt out by range of doc_id, so that files in order hold documents in order. Each task writes two stream
files: ``.tokens`` holds sequences of ``length`` ids with their masks, ``rows`` to a batch, and ``.docs`` says where each
document starts. A task that runs again writes files of another name; the manifest names those that count.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, give_back, released, shared_dir, written

TOKENIZER = "byte_bpe_50k.json"
END = 0
LENGTH = 2048
ROWS = 64
#: Bytes of space-separated pieces and their ids that an encoder keeps during a task, about, and what an entry takes besides.
KEPT_BYTES = 32 << 20
ENTRY_BYTES = 150
SHORT_TAILS = 10_000
#: Pieces that are encoded in one call, and bytes of text whose pieces are collected.
TOGETHER = 2048
TEXT_BYTES = 4 << 20
#: Marks that may follow a word; no apostrophe, which can begin a token with the letters after it.
_MARKS = ".,;:!?*%$#&|"
#: A byte-level vocabulary shows each byte as a character: printable ones as they are, the others from 256 on.
_SPACE = "\u0120"
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ELSE = iter(range(256, 512))
_SHOWN = "".join(chr(b if b in _PLAIN else next(_ELSE)) for b in range(256))
#: First bytes of control characters and of white space beyond ASCII, fixed values.
_ODD = np.isin(np.arange(256), [*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])


def _odd(pieces: pa.Array) -> np.ndarray:
    """Whether the place before a piece may not be the begin of a token: it is empty or begins like white space."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    empty = offsets[1:] == offsets[:-1]
    return empty | _ODD[np.append(data, 0)[np.where(empty, len(data), offsets[:-1])]]


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


MANIFEST = "file_no long, tokens_path string, docs_path string, n_docs long, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's pre-tokenizer never joins what a space and a visible character separate, so a text's ids are those
    of its space-separated pieces. The distinct pieces of many texts are encoded together, and their ids are kept. Texts
    with other spacing are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        if any(" " in x for x in self.literals):
            raise ValueError("an added token contains a space, so that texts can't be encoded in pieces")
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)  # a character stands for a byte
        self.forget()

    def __enter__(self) -> Encoder:
        return self

    def __exit__(self, *_: object) -> None:
        self.forget()
        give_back()

    def forget(self) -> None:
        """Drops what is kept of texts; done at the end of each task, as idle workers stay alive."""
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.tails: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encodes many pieces in one call; the lengths of the ids' byte strings say which ids are whose."""
        if self.kept_bytes > KEPT_BYTES:
            self.kept, self.kept_bytes = {}, 0
        self.kept_bytes += sum(map(len, pieces)) + ENTRY_BYTES * len(pieces)
        mixed = []
        for p in pieces:
            word = p.rstrip(_MARKS)
            if not word.isalpha():
                mixed.append(p)
            elif word == p:
                self.kept[p] = self._word(p)
            else:  # letters and the marks after them are never in one token
                self.kept[p] = (self.kept.get(word) or self._word(word)) + self._tail(p[len(word) :])
        for i in range(0, len(mixed), TOGETHER):
            own = mixed[i : i + TOGETHER]
            raw = self._whole([" " + " ".join(own)])[0]
            done = np.cumsum(self.sizes[np.frombuffer(raw, dtype=self.dtype)])
            ends = np.searchsorted(done, np.cumsum([len(p.encode()) + 1 for p in own]), "left") + 1
            ends = (ends * self.dtype.itemsize).tolist()
            self.kept.update(zip(own, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _word(self, word: str) -> bytes:
        """Ids of a space and letters: one token of the pre-tokenizer, so that the model alone can encode it."""
        shown = word if word.isascii() else charmap_decode(word.encode(), "strict", _SHOWN)[0]
        return array(self.dtype.char, [t.id for t in self.model.tokenize(_SPACE + shown)]).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > SHORT_TAILS:
                self.tails = {}
            self.tails[marks] = self._whole([marks])[0]
        return self.tails[marks]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.kept.get, pieces))
        if None in found:
            self._learn([p for p, ids in zip(pieces, found, strict=True) if ids is None])
            found = [self.kept[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        return found

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary
        heads, n, count = offsets[:-1], len(pieces), len(texts)
        is_head = np.zeros(len(codes), dtype=bool)
        is_head[heads] = True
        in_odd = np.logical_or.reduceat(_odd(pieces)[codes] & ~is_head, heads)
        for x in self.literals:
            in_odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        inner = ~is_head & ~np.repeat(in_odd, np.diff(offsets))
        used = np.zeros(n, dtype=bool)
        used[codes[inner]] = True
        ids = self._pieces(_strings(pieces.take(pa.array(np.flatnonzero(used)))))
        # After the pieces' codes: each text's head (an odd text as a whole), the end id, and nothing.
        codes = np.where(inner, (np.cumsum(used, dtype=np.int32) - 1)[codes], np.int32(len(ids) + count + 1))
        first = _strings(texts.take(pa.array(np.flatnonzero(in_odd))))
        plain = _strings(split.flatten().take(pa.array(heads[~in_odd])))
        whole = iter(self._whole(first)), iter(self._whole(plain))
        codes[heads] = len(ids) + np.arange(count)
        codes = np.insert(codes, offsets[1:], len(ids) + count)
        ids += [next(whole[0] if o else whole[1]) for o in in_odd.tolist()]
        ids += [np.array([END], dtype=self.dtype).tobytes(), b""]
        sizes = np.array(list(map(len, ids)), dtype=np.int64) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        size = sizes[codes]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(ids), dtype=self.dtype)
        kind = np.int32 if max(int(ends[-1]), len(flat)) < 1 << 31 else np.int64
        place = np.repeat((starts[codes] - (ends - size)).astype(kind), size)
        place += np.arange(len(place), dtype=kind)
        return flat[place], np.add.reduceat(size, heads + np.arange(count))

    def documents(self, texts: pa.Array, text_bytes: int = TEXT_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the texts (null: empty), an end id after each, and their numbers, text_bytes of text at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + text_bytes, "right")))
            yield self._some(texts.slice(at, to - at))
            at = to

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, without an end id."""
        return self._some(pa.array([text], pa.large_string()))[0][:-1]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class SequenceWriter:
    """Fills sequences of ``length`` ids and writes them in batches of ``rows``; the last sequence is padded and masked."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int, rows: int) -> None:
        self.length, self.rows, self.dtype = length, rows, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("tokens", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.room = np.zeros(length * rows, dtype=dtype)
        self.used = self.total = 0

    def _emit(self) -> None:
        rows = -(-self.used // self.length)
        self.room[self.used :] = END
        size = rows * self.length
        mask = pa.array(np.arange(size) < self.used)
        arrays = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.room[:size]), mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.used = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            part = ids[: len(self.room) - self.used]
            self.room[self.used : self.used + len(part)] = part
            self.used += len(part)
            ids = ids[len(part) :]
            if self.used == len(self.room):
                self._emit()

    def close(self) -> None:
        if self.used:
            self._emit()
        self.stream.close()


class SequenceReader:
    """Random access to the sequences of one file; on a local file system the ids are views of the mapped file."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        with pa.ipc.open_stream(self.file) as stream:
            self.length = stream.schema.field("tokens").type.list_size
            self.batches = list(stream)
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _values(self, batch: int, name: str) -> pa.Array:
        column = self.batches[batch].column(name)
        return column.values.slice(column.offset * self.length, len(column) * self.length)

    def tokens(self, i: int) -> np.ndarray:
        at = i % self.rows * self.length
        return self._values(i // self.rows, "tokens").to_numpy()[at : at + self.length]

    def mask(self, i: int) -> np.ndarray:
        at = i % self.rows * self.length
        return self._values(i // self.rows, "mask").slice(at, self.length).to_numpy(zero_copy_only=False)

    def span(self, start: int, size: int) -> np.ndarray:
        """ids start to start + size of the file's stream; copied only where they cross batches."""
        per, parts = self.rows * self.length, []
        while size > 0:
            at = start % per
            part = self._values(start // per, "tokens").to_numpy()[at : at + size]
            if not len(part):
                raise EOFError(f"no ids at {start}")
            parts.append(part)
            start, size = start + len(part), size - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint16), *parts])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _write(folder: str, path: str, length: int, rows: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, no = encoder(path), TaskContext.get().partitionId()
        with coder:
            yield from released(files(coder, no, batches))

    def files(coder: Encoder, no: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{no:08d}-{uuid.uuid4().hex}"
        n_docs = 0
        with system.open_output_stream(f"{base}/{name}.tokens") as a, system.open_output_stream(f"{base}/{name}.docs") as b:
            sequences, index = SequenceWriter(a, coder.dtype, length, rows), pa.ipc.new_stream(b, _DOCS)
            for batch in batches:
                if not batch.num_rows:
                    continue
                before, sizes = sequences.total, []
                for ids, own in coder.documents(batch.column(1)):
                    sizes.append(own)
                    sequences.add(ids)
                sizes = np.concatenate(sizes)
                n_docs += len(sizes)
                starts = before + np.cumsum(sizes) - sizes
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_DOCS))
            sequences.close()
            index.close()
        if n_docs:
            row = [[no], [f"{folder}/{name}.tokens"], [f"{folder}/{name}.docs"], [n_docs], [sequences.total]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file_no", "tokens_path", "docs_path", "n_docs", "n_tokens"])

    return of


def write_sequences(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the files of docs below folder and returns their manifest.

    Null and empty texts are the end id alone. Documents are in ascending order of doc_id (null first), equal ids by text.
    An empty table gives no files.
    """
    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_write(f"{folder}/files", tokenizer or default_tokenizer(), length, rows), MANIFEST), f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sequences = SequenceReader(row["tokens_path"])
            system, path = fs.FileSystem.from_uri(row["docs_path"])
            with system.open_input_file(path) as f, pa.ipc.open_stream(f) as index:
                for part in index:
                    starts, sizes = (part.column(c).to_numpy() for c in ("start", "n_tokens"))
                    crcs = [crc(sequences.span(int(s), int(n))) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + row["base"], pa.int64()), part.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Place, size and checksum of each document's ids, read from the files."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    return read_documents(write_sequences(docs, folder or shared_dir(docs.sparkSession), tokenizer, length))
