"""Growing logs as a stream of lines, by (file, byte) offsets.

An offset names, for each file of a folder, the byte after its last complete line and a checksum of its first bytes. A
micro-batch reads what lies between two offsets, cut into pieces that tasks read on their own; a line belongs to
the piece it starts in. A line without its end waits for it. The offsets are in the stream's checkpoint, so a query that
is started again loses and repeats no line. A file that has become shorter, or whose first bytes have changed, has been
replaced and is read from its beginning. Folders are reached through Arrow's file systems, by path or by URI.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tidewarden_log_tail"
PIECE = 64 << 20
CHUNK = 4 << 20
HEAD = 256
# Pieces of a micro-batch beyond this many are read several to a task, as long as that is no more than PIECE bytes.
TASKS = 64
FIELDS = ["file", "at", "value"]
SHAPE = pa.schema([("file", pa.string()), ("at", pa.int64()), ("value", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class LogPiece(InputPartition):
    """Bytes of a file; lines that start in them are read to their end."""

    def __init__(self, name: str, first: int, after: int, end: int):
        self.name, self.first, self.after, self.end = name, first, after, end


class LogPieces(InputPartition):
    """The pieces that one task reads, one after the other."""

    def __init__(self, pieces: list[LogPiece]):
        self.pieces = pieces


class LogTailReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, piece: int):
        self.path, self.pattern, self.piece = path, pattern, piece

    def _head(self, file: pa.NativeFile, size: int) -> int:
        file.seek(0)
        return zlib.crc32(file.read(min(HEAD, size)))

    def _lines_end(self, file: pa.NativeFile, size: int) -> int:
        """The byte after the last line end of the first ``size`` bytes."""
        at = size
        while at > 0:
            step = min(1 << 16, at)
            file.seek(at - step)
            found = file.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
        return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, folder = opened(self.path)
        found = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch.fnmatch(info.base_name, self.pattern):
                continue
            with system.open_input_file(info.path) as file:
                end = self._lines_end(file, info.size)
                if end:
                    found[info.base_name] = {"bytes": end, "head": self._head(file, end)}
        return found

    def partitions(self, start: dict, end: dict) -> list[LogPieces]:
        system, folder = opened(self.path)
        pieces = []
        for name, now in sorted(end.items()):
            first, before = 0, start.get(name)
            if before == now:
                continue
            if before and before["bytes"] <= now["bytes"]:
                with system.open_input_file(f"{folder}/{name}") as file:
                    first = before["bytes"] if self._head(file, before["bytes"]) == before["head"] else 0
            pieces += [LogPiece(name, at, min(at + self.piece, now["bytes"]), now["bytes"]) for at in range(first, now["bytes"], self.piece)]
        together = max(min(-(-len(pieces) // TASKS), PIECE // self.piece), 1)
        return [LogPieces(pieces[i : i + together]) for i in range(0, len(pieces), together)]

    def read(self, partition: LogPieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._read_piece(piece)

    def _read_piece(self, partition: LogPiece) -> Iterator[pa.RecordBatch]:
        system, folder = opened(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as file:
            at = partition.first
            if at:  # a line that starts before belongs to the piece before
                file.seek(at - 1)
                at += len(self._rest_of_line(file, at - 1, partition.end)) - 1
            while at < partition.after:
                file.seek(at)
                data = file.read(min(CHUNK, partition.after - at))
                if not data.endswith(b"\n"):
                    data += self._rest_of_line(file, at + len(data), partition.end)
                yield self._batch(partition.name, at, data)
                at += len(data)

    def _rest_of_line(self, file: pa.NativeFile, at: int, end: int) -> bytes:
        """What follows up to the line's end, with it."""
        out = b""
        while at + len(out) < end:
            more = file.read(min(1 << 16, end - at - len(out)))
            found = more.find(b"\n")
            if found >= 0:
                return out + more[: found + 1]
            out += more
        return out

    def _batch(self, name: str, at: int, data: bytes) -> pa.RecordBatch:
        lines = data[:-1].split(b"\n")
        sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        texts = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
        places = pa.array(at + np.cumsum(sizes) - sizes)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), places, texts], schema=SHAPE)


class LogTail(DataSource):
    """Options: ``path`` (a folder), ``pattern`` of file names (all), ``piece`` (bytes that are read as one; small ones share a task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("piece", PIECE)))


def tail_lines(spark: SparkSession, path: str, pattern: str = "*", piece: int = PIECE) -> DataFrame:
    """Lines added to the files of a folder: ``file``, ``at`` (the byte a line starts at) and ``value``."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format(NAME).option("path", path).option("pattern", pattern).option("piece", str(piece)).load()
