"""Shards of framed records as a data source, read by byte ranges and written.

A record stands between its length (8 bytes) with the length's checksum, and a
checksum of its own; both are masked CRC-32C. ``spark.read.format(FORMAT)``
yields a row for each record:

``path``, ``part`` (where the range begins), ``nth`` (the record's number in
the range), ``start``, ``size``, ``content`` and ``fault``.

A shard of any size is cut into ranges of ``rangeBytes``, one task each. A range
has the records that begin in it. It finds its first one by checksums: the first
place from which the lengths of ``CHAIN`` records (or of as many as there are to
the shard's end) check, or whose length and content both do. A range's first
record that is not found so, being damaged, is told of by the range before. Records that themselves hold framed records need ``rangeBytes`` 0,
which makes each shard one range.

Options: ``rangeBytes`` (64 MB), ``checksums`` (``true``), ``contents``
(``true``; ``false`` reads lengths only, an index of the shards), and ``bad``:
``fail`` (an error that tells path and place) or ``keep``, where what is damaged
is a row without content whose ``fault`` is ``length`` (the length does not
check; reading goes on at the next place that does), ``content`` or ``end`` (the
shard ends within the record). Without checksums only ``end`` is noticed.

Paths are a shard, a folder (all that is in it but names that begin with a dot
or an underscore) or a pattern for names in a folder; they may lie in any store
that pyarrow reads. An empty shard has no records.

Written shards hold the binary column ``content`` of a table, one shard for
each task; they are renamed to their names when all tasks are done.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from wayline.sources.checksums import crc32c, masked, masked_of_length, masked_of_lengths

FORMAT = "framed_records"
SCHEMA = "path string, part long, nth long, start long, size long, content binary, fault string"
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]
RANGE_BYTES = 64 << 20
#: Records that must follow one another for a place to count as a record's beginning.
CHAIN = 4
HEAD, TAIL = 12, 4
#: Bytes read at a time, and bytes and records of a batch of rows.
CHUNK, BATCH_BYTES, BATCH_ROWS = 8 << 20, 16 << 20, 5_000


#: Bytes of rows whose values are Python's at a time; these take some twenty times as much.
PIECE_BYTES = 1 << 20


def in_pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about so many bytes, a row at least: Spark's batches count rows, whatever their size."""
    for b in batches:
        n = max(1, b.num_rows * most // max(1, b.nbytes))
        yield from (b.slice(k, n) for k in range(0, b.num_rows, n))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shards(path: str) -> list[tuple[str, int]]:
    """Shards of a path with their sizes, in the order of their names."""
    store, inside = opened(path)
    folder, _, name = inside.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        found = [i for i in store.get_file_info(fs.FileSelector(folder)) if fnmatchcase(posixpath.basename(i.path), name)]
    else:
        info = store.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and posixpath.basename(i.path)[0] not in "._")


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    total: int


class Shard:
    """A shard read forwards, some bytes ahead."""

    def __init__(self, path: str, total: int):
        store, inside = opened(path)
        self.file, self.total = store.open_input_file(inside), total
        self.at, self.held = 0, b""

    def read(self, start: int, size: int, ahead: int = CHUNK) -> bytes:
        """Bytes of the shard; fewer at its end."""
        if not (self.at <= start and start + size <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(min(max(size, ahead), self.total - start))
        return self.held[start - self.at : start - self.at + size]

    def length_at(self, start: int, check: bool = True) -> int | None:
        """The length that stands at a place, if it checks and its record ends within the shard."""
        head = self.read(start, HEAD)
        if len(head) < HEAD:
            return None
        (size,) = struct.unpack("<Q", head[:8])
        if check and struct.unpack("<I", head[8:])[0] != masked_of_length(head[:8]):
            return None
        return size

    def begins_at(self, start: int) -> bool:
        """Whether lengths that check follow one another from here on, or the one record here checks as a whole."""
        return self.chained(start) or self.checks(start)

    def checks(self, start: int) -> bool:
        size = self.length_at(start)
        if size is None or start + HEAD + size + TAIL > self.total:
            return False
        content = self.read(start + HEAD, size + TAIL)
        return struct.unpack("<I", content[-TAIL:])[0] == int(masked(crc32c([content[:-TAIL]]))[0])

    def chained(self, start: int) -> bool:
        for _ in range(CHAIN):
            if start == self.total:
                return True
            size = self.length_at(start)
            if size is None or start + HEAD + size + TAIL > self.total:
                return False
            start += HEAD + size + TAIL
        return True

    def first_from(self, start: int, end: int) -> int | None:
        """The first place before ``end`` at which records begin."""
        while start < end:
            buf = np.frombuffer(self.read(start, min(1 << 20, end - start) + HEAD - 1), dtype=np.uint8)
            if len(buf) < HEAD:
                return None
            windows = np.lib.stride_tricks.sliding_window_view(buf, HEAD)
            told = windows[:, 8:].astype(np.uint32) @ (np.uint32(1) << np.arange(0, 32, 8, dtype=np.uint32))
            begin = start
            for k in np.flatnonzero(told == masked_of_lengths(windows[:, :8])).tolist():
                if begin + k < end and self.begins_at(begin + k):
                    return begin + k
            start += len(windows)
        return None


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.checksums = options.get("checksums", "true").lower() == "true"
        self.contents = options.get("contents", "true").lower() == "true"
        self.bad = options.get("bad", "fail")
        if self.bad not in ("fail", "keep"):
            raise ValueError(f"unknown way with damaged records: {self.bad}")
        if self.range_bytes and not self.checksums:
            self.range_bytes = 0  # without them a range cannot find its first record

    def partitions(self) -> list[Range]:
        out = []
        for path, total in shards(self.path):
            step = self.range_bytes or max(1, total)
            out += [Range(path, b, min(b + step, total), total) for b in range(0, total, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = nth = 0

        def told() -> pa.RecordBatch:
            starts, sizes, contents, faults = (list(c) for c in zip(*rows, strict=True))
            if self.checksums and self.contents:
                whole = [i for i, f in enumerate(faults) if f is None]
                sums = masked(crc32c([contents[i][:-TAIL] for i in whole]))
                for i, c in zip(whole, sums.tolist(), strict=True):
                    if struct.unpack("<I", contents[i][-TAIL:])[0] != c:
                        faults[i] = "content"
            if self.bad == "fail":
                for s, f in zip(starts, faults, strict=True):
                    if f:
                        raise ValueError(f"damaged record ({f}) in {part.path} at {s}")
            n = len(rows)
            values = [None if f or not self.contents else c[:-TAIL] for c, f in zip(contents, faults, strict=True)]
            columns = [pa.array([part.path] * n), pa.array([part.begin] * n), pa.array(range(nth - n, nth)), pa.array(starts), pa.array(sizes, pa.int64()), pa.array(values, pa.binary()), pa.array(faults, pa.string())]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        if part.begin == part.end:
            return
        shard = Shard(part.path, part.total)
        at = part.begin if part.begin == 0 else shard.first_from(part.begin, part.end)
        while at is not None and at < part.end:
            size = shard.length_at(at, self.checksums)
            if size is None and self.checksums and at + HEAD <= part.total:
                rows.append((at, None, b"", "length"))
                after = shard.first_from(at + 1, part.end)
            elif size is None or at + HEAD + size + TAIL > part.total:
                rows.append((at, size, b"", "end"))
                after = part.total
            else:
                rows.append((at, size, shard.read(at + HEAD, size + TAIL) if self.contents else b"", None))
                held += size
                after = at + HEAD + size + TAIL
            nth += 1
            at = after
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield told()
                rows, held = [], 0
        if self.checksums and at is not None and part.end <= at < part.total and not shard.begins_at(at):
            # the range it lies in will not find it
            size = shard.length_at(at)
            rows.append((at, size, b"", "length" if size is None and at + HEAD <= part.total else "content" if size is not None and at + HEAD + size + TAIL <= part.total else "end"))
            nth += 1
        if rows:
            yield told()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.store, self.folder = opened(options["path"].rstrip("/"))
        self.options, self.overwrite, self.run = dict(options), overwrite, uuid.uuid4().hex

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "store"}  # found again where it is needed

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.store = opened(self.options["path"])[0]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}.records"
        self.store.create_dir(self.folder, recursive=True)
        beside = f"{self.folder}/_{task.taskAttemptId()}-{name}"
        some = False
        with self.store.open_output_stream(beside) as out:
            for batch in in_pieces(iterator, BATCH_BYTES):
                contents = batch["content"].to_pylist()
                if any(c is None for c in contents):
                    raise ValueError("a record must not be null")
                lengths = [struct.pack("<Q", len(c)) for c in contents]
                heads, tails = (masked(crc32c(x)).astype("<u4").tobytes() for x in (lengths, contents))
                out.write(b"".join(x for i, c in enumerate(contents) for x in (lengths[i], heads[4 * i : 4 * i + 4], c, tails[4 * i : 4 * i + 4])))
                some |= bool(contents)
        return Written([beside] if some else [])

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m is not None for n in m.names]
        self.store.create_dir(self.folder, recursive=True)
        if self.overwrite:
            for info in self.store.get_file_info(fs.FileSelector(self.folder)):
                if info.type == fs.FileType.File and info.path not in names:
                    self.store.delete_file(info.path)
        for n in names:
            self.store.move(n, f"{self.folder}/{posixpath.basename(n).split('-', 1)[1]}")

    def abort(self, messages: list[Written | None]) -> None:
        for n in (n for m in messages if m is not None for n in m.names):
            self.store.delete_file(n)


class RecordSource(DataSource):
    """Registered by ``register``; see the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if [f.name for f in schema if f.dataType.simpleString() == "binary"] != ["content"] or len(schema) != 1:
            raise ValueError("shards are written from one binary column, content")
        return RecordWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def framed(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, checksums: bool = True, bad: str = "fail", contents: bool = True) -> DataFrame:
    """The records of the shards, a row each (``SCHEMA``)."""
    register(spark)
    options = {"rangeBytes": range_bytes, "checksums": str(checksums).lower(), "bad": bad, "contents": str(contents).lower()}
    return spark.read.format(FORMAT).options(**options).load(path)


def write_framed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Shards of the binary column ``content``, one for each partition that has rows."""
    register(df.sparkSession)
    df.select("content").write.format(FORMAT).mode(mode).save(path)


def range_sizes(index: DataFrame) -> DataFrame:
    """``path, part, before``: the records of a shard before each of its ranges, from a table of ``framed`` (without contents will do). A row a range."""
    sizes = index.groupBy("path", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("path", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))


def with_places(records: DataFrame, index: DataFrame) -> DataFrame:
    """The records with ``place``, their number in the shard from 0. ``index`` has the same ranges, of which there is a row each: so few that they go to the records."""
    placed = records.join(F.broadcast(range_sizes(index)), ["path", "part"])
    return placed.withColumn("place", F.col("before") + F.col("nth")).drop("before")
