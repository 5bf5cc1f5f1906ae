"""Sources by name and version, and shards of framed records."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wayline.functions.uniform import uniform
from wayline.operators import mixture
from wayline.operators import steps as S
from wayline.sources.records import framed, in_pieces, with_places

#: Rows of parsed features that are held at a time.
ROWS = 5_000


def path_of(base: str, name: str, version: str | None = None) -> str:
    """Folder of a source; a name may carry its version after a colon. Any path that Spark reads will do."""
    name, _, own = name.partition(":")
    return "/".join(x for x in (base.rstrip("/"), name, version or own) if x)


def read_steps(spark: SparkSession, base: str, name: str, key: Sequence[str], order: Sequence[str], shuffle_seed: int | None = None) -> DataFrame:
    """Steps of a source in Parquet, numbered by ``t``; with a seed also ``file_order``, a draw for each file.

    Rows of a table have no order of their own: what reads them file by file in
    the order of the draw (``mixture.numbered`` by it, say) names the column.
    """
    df = spark.read.parquet(path_of(base, name))
    if shuffle_seed is not None:
        df = df.withColumn("file_order", uniform("file", shuffle_seed, F.element_at(F.split(F.input_file_name(), "/"), -1)))
    return S.with_t(df, order, key)


def read_shuffled(spark: SparkSession, path: str, size: int, lanes: int, seed: int = 0) -> DataFrame:
    """Rows of a Parquet table file by file in the order of a draw, through a buffer of ``size`` rows in each lane (``mixture.buffer_shuffled``).

    ``file``, ``row_index``, ``lane`` and ``place`` tell where a row comes from and where it stands.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    rows = mixture.file_lanes(rows, "file", lanes, seed)
    return mixture.buffer_shuffled(rows, ["file_draw", "file", "row_index"], size, lanes, seed).drop("file_draw")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(b: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Field number, wire type and value of each field of a message."""
    at = 0
    while at < len(b):
        tag, at = (b[at], at + 1) if b[at] < 128 else _varint(b, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(b, at)
        elif wire == 2:
            size, at = (b[at], at + 1) if b[at] < 128 else _varint(b, at)
        else:
            size = {1: 8, 5: 4}[wire]
        if wire:
            if at + size > len(b):
                raise IndexError("the message ends within a field")
            value, at = b[at : at + size], at + size
        yield number, wire, value


def parse_example(b: bytes) -> dict[str, list]:
    """Named lists of bytes, 32-bit floats or integers of a record."""
    out: dict[str, list] = {}
    for _, _, features in _fields(b):
        for _, _, entry in _fields(features):
            parts = {n: v for n, _, v in _fields(entry)}
            values: list = []
            for kind, _, content in _fields(parts.get(2, b"")):
                for _, wire, v in _fields(content):
                    if kind == 1:
                        values.append(v)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(v) // 4}f", v)
                    elif wire == 0:
                        values.append(v - (1 << 64) if v >> 63 else v)
                    else:
                        at = 0
                        while at < len(v):
                            x, at = _varint(v, at)
                            values.append(x - (1 << 64) if x >> 63 else x)
            out[parts[1].decode()] = values
    return out


def records(content: bytes) -> Iterator[bytes]:
    """The records of a small shard held as bytes, whose checksums are not looked at; ``records.framed`` reads any shard."""
    at = 0
    while at < len(content):
        (size,) = struct.unpack_from("<Q", content, at)
        if at + 16 + size > len(content):
            raise ValueError("the shard ends within a record")
        yield content[at + 12 : at + 12 + size]
        at += 16 + size


_SHORT = [bytes([n]) for n in range(128)]


def _number(n: int) -> bytes:
    if n < 128:
        return _SHORT[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, content: bytes) -> bytes:
    return _SHORT[number << 3 | 2] + _number(len(content)) + content


@cache
def _name_field(name: str) -> bytes:
    return _field(1, name.encode())


def encode_example(features: dict[str, list]) -> bytes:
    """A record of named lists of bytes, texts, 32-bit floats or integers; ``parse_example`` reads it."""
    entries = []
    for name, values in features.items():
        if not values:
            kind = b""
        elif isinstance(values[0], (bytes, str)):
            kind = _field(1, b"".join([_field(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values]))
        elif isinstance(values[0], float):
            kind = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            kind = _field(3, _field(1, b"".join([_number(v % (1 << 64)) for v in values])))
        entries.append(_field(1, _name_field(name) + _field(2, kind)))
    return _field(1, b"".join(entries))


def as_examples(df: DataFrame, columns: Sequence[str], content: str = "content") -> DataFrame:
    """The rows with ``content``, the record of the named columns: arrays or single values; a null has no values."""
    rows = df.drop(content)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            lists = zip(*(([] if v is None else v if isinstance(v, list) else [v] for v in b[c].to_pylist()) for c in columns), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encode_example(dict(zip(columns, v, strict=True))) for v in lists], pa.binary())], [*b.schema.names, content])

    return rows.mapInArrow(encoded, T.StructType([*rows.schema.fields, T.StructField(content, T.BinaryType())]))


#: What goes wrong with a record that is no example of the wanted columns.
_UNREADABLE = (IndexError, KeyError, TypeError, ValueError, OverflowError, struct.error, pa.ArrowInvalid, pa.ArrowTypeError)


def parse_examples(df: DataFrame, schema: str, content: str = "content", fault: str = "fault") -> DataFrame:
    """The rows without ``content`` but with the columns of ``schema``, read from it, and ``fault``.

    Columns are arrays of float, long, binary or string, or such values alone,
    which take a list's first. A feature that the record lacks is null. A record
    that cannot be read, or whose values are of another kind, has nulls and the
    fault ``fields``; faults that the rows bring along stay.
    """
    wanted = T.StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in wanted]
    rows = df.drop(*wanted.names)
    if fault not in rows.columns:
        rows = rows.withColumn(fault, F.lit(None).cast("string"))
    rest = rows.drop(content, fault)
    kept = rest.columns

    def read(b: bytes | None, check: bool) -> list:
        features = parse_example(b)
        out = []
        for f, kind in zip(wanted, kinds, strict=True):
            values = features.get(f.name)
            if values is not None and not isinstance(f.dataType, T.ArrayType):
                values = values[0] if values else None
            if values is not None and (pa.types.is_string(kind) or pa.types.is_list(kind) and pa.types.is_string(kind.value_type)):
                values = values.decode() if isinstance(values, bytes) else [v.decode() for v in values]
            if check:
                pa.scalar(values, kind)  # of the wanted kind, or an error
            out.append(values)
        return out

    def columns_of(b: pa.RecordBatch, check: bool) -> list[pa.Array]:
        columns: list[list] = [[] for _ in kinds]
        faults = b[fault].to_pylist()
        for i, c in enumerate(b[content].to_pylist()):
            values: list = [None] * len(kinds)
            if faults[i] is None and c is not None:
                try:
                    values = read(c, check)
                except _UNREADABLE:
                    faults[i] = "fields"
            for own, v in zip(columns, values, strict=True):
                own.append(v)
        return [*(pa.array(v, k) for v, k in zip(columns, kinds, strict=True)), pa.array(faults, pa.string())]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            try:
                arrays = columns_of(b, False)
            except _UNREADABLE:  # some record has values of another kind: which one is found value by value
                arrays = columns_of(b, True)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), *arrays], [*kept, *wanted.names, fault])

    out = T.StructType([*rest.schema.fields, *wanted.fields, T.StructField(fault, T.StringType())])
    return rows.select(*kept, content, fault).mapInArrow(parsed, out)


def episode_steps(df: DataFrame, widths: dict[str, int], t: str = "t") -> DataFrame:
    """A row for each step of episodes whose columns hold the values of all steps one after the other.

    ``widths`` says how many belong to one step: 1 makes single values, more
    make arrays. The first of the columns tells how many steps there are; of a
    column with fewer the steps beyond are null.
    """
    first, n = next(iter(widths.items()))
    places = F.sequence(F.lit(0), F.floor(F.size(first) / n).cast("int") - 1)

    def step(i: Column) -> Column:
        values = ((F.get(F.col(c), i) if w == 1 else F.when(F.size(c) >= (i + 1) * w, F.slice(c, i * w + 1, w))).alias(c) for c, w in widths.items())
        return F.struct(i.alias(t), *values)

    steps = F.when(F.size(first) >= n, F.transform(places, step))
    return df.select(*(c for c in df.columns if c not in widths), F.inline(steps))


def read_records(spark: SparkSession, path: str, skip_bad: bool = False, range_bytes: int = 0, checksums: bool = False) -> DataFrame:
    """``path, place, name, texts, floats, ints``: a row for each feature of each record of the shards.

    With checksums the shards are checked and, if ``range_bytes`` is above 0,
    cut into ranges of that size. With ``skip_bad`` records that are damaged or
    do not parse are left out.
    """
    records_ = partial(framed, spark, path, range_bytes, checksums, "keep" if skip_bad else "fail")
    placed = with_places(records_(), records_(contents=False))
    names = ["path", "place", "name", "texts", "floats", "ints"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for p, i, record in zip(batch["path"], batch["place"], batch["content"], strict=True):
                if not len(record):
                    continue
                try:
                    features = parse_example(record)
                except (IndexError, KeyError, struct.error):
                    if not skip_bad:
                        raise
                    continue
                for name, values in features.items():
                    kind = type(values[0]) if values else bytes
                    rows.append((p, i, name, *(values if kind is k else None for k in (bytes, float, int))))
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    sound = placed.where("fault is null").select("path", "place", "content")
    return sound.mapInPandas(parse, "path string, place long, name string, texts array<binary>, floats array<float>, ints array<long>")
