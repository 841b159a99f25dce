"""A stream over append-only text: a folder of segments in the order of their names, of which the last still grows (or one file).

Offsets are the number of the next line (from 1, over all segments), its segment and its byte there, so a query that starts again goes
on at the byte where it stopped, and no line is read twice or lost. A line counts once its newline is there, or the next segment has
begun. What a batch covers is cut into partitions at line ends; the driver finds the cuts by counting newlines, tasks read bytes.

Options: path; piece_bytes (of a partition, about; default 16 MB); pieces_per_trigger (default all). Python opens the files: local and
mounted folders, and whatever pyarrow knows by its URI.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA, CHUNK = "line_no long, value string", 4 << 20


def _files(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def segments(path: str) -> list[str]:
    """The files of a folder by name (hidden ones and markers left out), or the file itself."""
    files, root = _files(path)
    info = files.get_file_info(root)
    if info.type == arrow_fs.FileType.File:
        return [root]
    if info.type == arrow_fs.FileType.NotFound:
        return []
    found = files.get_file_info(arrow_fs.FileSelector(root))
    return sorted(f.path for f in found if f.type == arrow_fs.FileType.File and f.base_name[:1] not in "._")


@dataclass
class Piece(InputPartition):
    """Whole lines: bytes of a segment, the number of the first one and how many there are."""

    segment: str
    begin: int
    end: int
    line: int
    lines: int


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, piece_bytes: int, per_trigger: int | None):
        self.path, self.piece_bytes, self.per_trigger = path, piece_bytes, per_trigger
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"segment": "", "byte": 0, "line": 1}

    def _pieces(self, start: dict, end: dict | None = None, most: int | None = None) -> Iterator[Piece]:
        """What lies between two offsets, or behind one, in pieces of about equal bytes, at most so many."""
        files, line, left = _files(self.path)[0], start["line"], -1 if most is None else most
        names = [s for s in segments(self.path) if s >= start["segment"] and (end is None or s <= end["segment"])]
        for name in names:
            at, closed = start["byte"] if name == start["segment"] else 0, end is not None or name != names[-1]
            with files.open_input_file(name) as f:
                stop = end["byte"] if end and name == end["segment"] else f.size()
                while left and at < stop:
                    f.seek(at)
                    chunk = f.read(min(self.piece_bytes, stop - at))
                    while b"\n" not in chunk and at + len(chunk) < stop:  # a line longer than a piece
                        chunk += f.read(min(self.piece_bytes, stop - at - len(chunk)))
                    size = chunk.rfind(b"\n") + 1
                    if not size and not closed:
                        break  # the line that is being written
                    size = size or len(chunk)  # the last line of a segment that is closed needs no newline
                    n = chunk.count(b"\n", 0, size) + (chunk[size - 1 : size] != b"\n")
                    yield Piece(name, at, at + size, line, n)
                    at, line, left = at + size, line + n, left - 1

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        for p in self._pieces(at, None, self.per_trigger):
            at = {"segment": p.segment, "byte": p.end, "line": p.line + p.lines}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.at = max(self.at or end, end, key=lambda o: o["line"])
        return list(self._pieces(start, end)) if start != end else []

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, line = _files(self.path)[0], partition.line
        with files.open_input_file(partition.segment) as f:
            f.seek(partition.begin)
            left, rest = partition.end - partition.begin, b""
            while left:
                chunk = f.read(min(CHUNK, left))
                left -= len(chunk)
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                if not left and rest:
                    lines.append(rest)
                texts = [x.removesuffix(b"\r").decode(errors="replace") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(range(line, line + len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["line_no", "value"])
                line += len(texts)

    def commit(self, end: dict) -> None:
        """Nothing to give up: segments stay."""


class LineLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linelog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> LineReader:
        o = self.options
        return LineReader(o["path"], int(o.get("piece_bytes", 4 * CHUNK)), int(o["pieces_per_trigger"]) if "pieces_per_trigger" in o else None)


def read_lines(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """line_no, value of every line, as a stream."""
    spark.dataSource.register(LineLog)
    return spark.readStream.format("linelog").options(**options).load(path)
