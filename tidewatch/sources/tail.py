"""A streaming source that follows growing files: new lines of the log's current and previous hours, by byte offset.

Spark's own file source reads a file once; here an offset is kept for each file, so lines that are appended later come in a
later batch. Only lines that end are read: the start of a line that is still being written waits for its end. Offsets are
part of the query's checkpoint, so a restart goes on at the byte where the last batch ended. Files are opened through
pyarrow's filesystems by the driver and the workers, so the path must be one that all of them reach.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, some more: until the line ends.
SPLIT_BYTES = 32 << 20
#: Bytes that are searched at a time for the end of a line.
STEP = 1 << 16
#: Lines of an Arrow batch.
BATCH_LINES = 5000


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin in [start, end); first: start is the begin of a line."""

    file: str
    start: int
    end: int
    first: bool
    stop: int


class Tail(DataSource):
    """Options: path; hours (2: the current and the previous one); now (an ISO time instead of the clock); split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_tail"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(dict(self.options))


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.root = fs.FileSystem.from_uri(options["path"])
        self.hours, self.now = int(options.get("hours", 2)), options.get("now")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def _folders(self) -> list[str]:
        now = dt.datetime.fromisoformat(self.now) if self.now else dt.datetime.now(dt.timezone.utc)
        hours = [now - dt.timedelta(hours=h) for h in reversed(range(self.hours))]
        return [f"{self.root}/year={t:%Y}/month={t:%m}/day={t:%d}/hour={t:%H}" for t in hours]

    def latestOffset(self) -> dict:
        """Of each file, the byte after its last whole line."""
        out = {}
        for folder in self._folders():
            for info in self.files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
                if info.is_file and not info.base_name.startswith(("_", ".")):
                    out[info.path[len(self.root) + 1 :]] = self._whole(info.path, info.size)
        return out

    def _whole(self, path: str, size: int) -> int:
        with self.files.open_input_file(path) as f:
            end = size
            while end > 0:
                start = max(0, end - STEP)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file in sorted(end):
            a, b = start.get(file, 0), end[file]
            out += [Piece(file, x, min(x + self.split, b), x == a, b) for x in range(a, b, self.split)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the piece; a line across its end is the piece's, one across its start isn't."""
        with self.files.open_input_file(f"{self.root}/{piece.file}") as f:
            at = piece.start
            if not piece.first and f.read_at(1, at - 1) != b"\n":
                at = self._next_line(f, at, piece.stop)
            f.seek(at)
            lines, places, rest = [], [], b""
            while at < piece.end:
                data = f.read(min(STEP, piece.stop - at - len(rest)))
                if not data:
                    break
                *whole, rest = (rest + data).split(b"\n")
                for line in whole:
                    if at < piece.end:
                        lines.append(line)
                        places.append(at)
                    at += len(line) + 1
                if len(lines) >= BATCH_LINES:
                    yield self._batch(piece.file, lines, places)
                    lines, places = [], []
            if lines:
                yield self._batch(piece.file, lines, places)

    @staticmethod
    def _next_line(f, at: int, stop: int) -> int:  # noqa: ANN001
        while at < stop:
            data = f.read_at(min(STEP, stop - at), at)
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return stop

    @staticmethod
    def _batch(file: str, lines: list[bytes], places: list[int]) -> pa.RecordBatch:
        text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(places, pa.int64()), text], ["file", "position", "value"])

    def commit(self, end: dict) -> None:
        pass


def offsets(checkpoint: str) -> dict[str, int]:
    """The offsets of the last batch that a query with a local checkpoint folder has planned."""
    files, root = fs.FileSystem.from_uri(checkpoint)
    found = [x for x in files.get_file_info(fs.FileSelector(f"{root}/offsets")) if x.base_name.isdigit()]
    last = max(found, key=lambda x: int(x.base_name))
    with files.open_input_file(last.path) as f:
        return json.loads(f.read().decode().splitlines()[-1])
