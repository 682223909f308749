"""Growing line files as a stream whose offsets are byte positions.

Spark's own file stream takes every file once; what is appended to it later is never seen. Here the
offset of a stream has, for every file, the end of its last whole line. A micro-batch reads what lies
between two offsets, cut into pieces that tasks share, and a repeated micro-batch reads the same bytes
again. A line is named by its file's number and the byte at which it begins, so equal lines stay
apart and the order of names is the order in the file.

A file is known by its inode and first line (on object stores by its path and first line), so one that
is renamed when logs rotate goes on where it was, and a new one under an old name begins anew. Numbers
of files are kept in a small folder, which every start of the stream reads.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing-lines"
SCHEMA = "value string, filename string, file_no long, position long"
#: a log id has this many bits for the byte position, and the file's number above them
POSITION_BITS = 40
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
HEAD_BYTES = 4096


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a plain path or of a URI."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    store, root = pafs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


@dataclass
class Piece(InputPartition):
    """Lines that begin in [begin, end) of a file; ``first`` is where this micro-batch starts in it."""

    path: str
    name: str
    number: int
    identity: str
    first: int
    begin: int
    end: int


class Numbers:
    """The number of every file that was ever seen: a folder with one small file per number."""

    def __init__(self, folder: str):
        self.store, self.root = _store(folder)
        self.known: dict[str, tuple[int, str]] = {}

    def _load(self) -> int:
        """Read the folder; the next free number."""
        self.store.create_dir(self.root, recursive=True)
        free = 0
        for info in self.store.get_file_info(pafs.FileSelector(self.root)):
            if not info.base_name.isdigit():
                continue
            number = int(info.base_name)
            free = max(free, number + 1)
            with self.store.open_input_file(info.path) as file:
                identity, _, name = file.read().decode().partition(" ")
            # should two streams have numbered one file at once, the smaller number holds for both
            if identity and number <= self.known.get(identity, (number, ""))[0]:
                self.known[identity] = (number, name)
        return free

    def of(self, identity: str, name: str) -> tuple[int, str]:
        """Number of a file, and the name under which it was first seen."""
        if identity not in self.known:
            free = self._load()
            while identity not in self.known:
                path, text = f"{self.root}/{free:08d}", f"{identity} {name}".encode()
                try:
                    if isinstance(self.store, pafs.LocalFileSystem):
                        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                        with os.fdopen(handle, "wb") as file:
                            file.write(text)
                    else:
                        with self.store.open_output_stream(path) as file:
                            file.write(text)
                    self.known[identity] = (free, name)
                except FileExistsError:
                    free = self._load()
        return self.known[identity]


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = options.get("pattern", "*")
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.numbers = Numbers(options.get("numbers") or f"{self.path.rstrip('/')}/_numbers")
        self.ends: dict[int, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, root = _store(self.path)
        files = {}
        selected = pafs.FileSelector(root, recursive=True, allow_not_found=True)
        for info in sorted(store.get_file_info(selected), key=lambda i: i.path):
            name = info.path[len(root) + 1 :]
            # as for Spark, names that begin with a dot or an underscore are no data
            if not info.is_file or any(p[0] in "._" for p in name.split("/")) or not fnmatch(name, self.pattern):
                continue
            try:
                identity = _identity(store, info)
                if identity is None:
                    continue
                number, first_name = self.numbers.of(identity, name)
                size, end = self.ends.get(number, (0, 0))
                if info.size > size:
                    end = _last_line_end(store, info.path, end, info.size)
                    self.ends[number] = (info.size, end)
            except FileNotFoundError:  # moved since it was listed; the next listing has it
                continue
            files[str(number)] = {"name": first_name, "path": info.path, "identity": identity, "bytes": end}
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for number, file in end["files"].items():
            first, last = start["files"].get(number, {"bytes": 0})["bytes"], file["bytes"]
            if last < first:
                raise ValueError(f"{file['path']} has become shorter; rotate files by renaming them")
            for begin in range(first, last, self.split_bytes):
                stop = min(begin + self.split_bytes, last)
                pieces.append(Piece(file["path"], file["name"], int(number), file["identity"], first, begin, stop))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        with store.open_input_file(_where(store, root, partition)) as file:
            yield from _lines(file, partition)


def _identity(store: pafs.FileSystem, info: pafs.FileInfo) -> str | None:
    """Name of a file that it keeps while it grows or moves; None while it has no whole line."""
    with store.open_input_file(info.path) as file:
        head = file.read(HEAD_BYTES)
    line, ended, _ = head.partition(b"\n")
    if not ended and len(head) < HEAD_BYTES:
        return None
    if isinstance(store, pafs.LocalFileSystem):
        status = os.stat(info.path)
        return f"{status.st_dev:x}-{status.st_ino:x}-{zlib.crc32(line):08x}"
    return f"{zlib.crc32(info.path.encode()):08x}{zlib.adler32(info.path.encode()):08x}-{zlib.crc32(line):08x}"


def _where(store: pafs.FileSystem, root: str, piece: Piece) -> str:
    """Path of a piece's file now: it may have been renamed since the micro-batch was planned."""
    def same(info: pafs.FileInfo) -> bool:
        return info.is_file and _identity(store, info) == piece.identity

    if same(store.get_file_info(piece.path)):
        return piece.path
    for info in store.get_file_info(pafs.FileSelector(root, recursive=True)):
        if same(info):
            return info.path
    raise FileNotFoundError(f"{piece.path} has gone before it was read")


def _last_line_end(store: pafs.FileSystem, path: str, known: int, size: int) -> int:
    """Where the last whole line before ``size`` ends; ``known`` is such a place."""
    with store.open_input_file(path) as file:
        high = size
        while high > known:
            low = max(known, high - HEAD_BYTES * 16)
            file.seek(low)
            at = file.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return known


def _lines(file: pa.NativeFile, piece: Piece) -> Iterator[pa.RecordBatch]:
    at = piece.begin
    if piece.begin > piece.first:
        # a line that begins before the piece belongs to the piece before
        file.seek(piece.begin - 1)
        at -= 1
        while True:
            block = file.read(HEAD_BYTES * 16)
            cut = block.find(b"\n")
            if cut >= 0 or not block:
                at += cut + 1
                break
            at += len(block)
    file.seek(at)
    rest = b""
    while at < piece.end:
        block = file.read(BLOCK_BYTES)
        if not block:
            return
        *whole, rest = (rest + block).split(b"\n")
        values, positions = [], []
        for line in whole:
            if at >= piece.end:
                break
            values.append(line.removesuffix(b"\r").decode(errors="replace"))
            positions.append(at)
            at += len(line) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(values, pa.string()),
                pa.array([piece.name] * len(values), pa.string()),
                pa.array([piece.number] * len(values), pa.int64()),
                pa.array(positions, pa.int64()),
            ],
            ["value", "filename", "file_no", "position"],
        )


class GrowingLines(DataSource):
    """``spark.readStream.format("growing-lines")``; see ``tail_lines`` for the options."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(dict(self.options))


def tail_lines(
    spark: SparkSession, path: str, pattern: str = "*", numbers: str | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Stream of the lines of all files below ``path``, as they are and as they grow.

    value, filename (relative to ``path``, as first seen), file_no, position (byte at which the line
    begins) and log_id, unique and ascending within a file. ``path`` is a folder that driver and executors
    reach by the same name. ``pattern`` selects file names; ``numbers`` is where numbers of files are kept, by default
    a folder ``_numbers`` in ``path``. A last line without its line end waits until that is written.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(FORMAT).option("pattern", pattern).option("splitBytes", str(split_bytes))
    if numbers is not None:
        reader = reader.option("numbers", numbers)
    log_id = F.shiftleft(F.col("file_no"), POSITION_BITS).bitwiseOR(F.col("position"))
    return reader.load(path).withColumn("log_id", log_id)
