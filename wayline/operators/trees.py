"""Nested records: maps over leaves, merges, names by pattern, and tasks put together from parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.steps import padding_of


def tree_map(column: Column, kind: T.DataType, f: Callable[[Column, tuple[str, ...], T.DataType], Column], path: tuple[str, ...] = ()) -> Column:
    """The record with ``f(leaf, path, type)`` for each leaf."""
    if not isinstance(kind, T.StructType):
        return f(column, path, kind)
    return F.struct(*(tree_map(column[x.name], x.dataType, f, (*path, x.name)).alias(x.name) for x in kind.fields))


def tree_merge(a: Column, a_kind: T.StructType, b: Column, b_kind: T.StructType) -> Column:
    """Fields of both records; where both have one, records are merged and else the second wins."""
    of_b = {x.name: x.dataType for x in b_kind.fields}
    out = []
    for x in a_kind.fields:
        other = of_b.pop(x.name, None)
        if other is None:
            c = a[x.name]
        elif isinstance(x.dataType, T.StructType) and isinstance(other, T.StructType):
            c = tree_merge(a[x.name], x.dataType, b[x.name], other)
        else:
            c = b[x.name]
        out.append(c.alias(x.name))
    return F.struct(*out, *(b[n].alias(n) for n in of_b))


def selective_map(column: Column, kind: T.StructType, wanted: Callable[[str], bool], f: Callable[[Column], Column]) -> Column:
    """``f`` over the leaves whose path, joined by slashes, is wanted."""
    return tree_map(column, kind, lambda c, path, _: f(c) if wanted("/".join(path)) else c)


def matching(names: Sequence[str], pattern: str) -> list[str]:
    """The names that a shell pattern matches; an error if there is none."""
    out = [n for n in names if fnmatchcase(n, pattern)]
    if not out:
        raise ValueError(f"nothing matches {pattern}: {', '.join(names)}")
    return out


def starting_with(names: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """The names that some regular expression matches from their beginning on."""
    return [n for n in names if any(re.match(p, n) for p in patterns)]


def schema_differences(wanted: T.StructType, given: T.StructType, path: str = "") -> list[tuple[str, str]]:
    """``missing``, ``extra`` and ``type`` differences of nested fields, by path."""
    w, g = ({x.name: x.dataType for x in s.fields} for s in (wanted, given))
    out = [(f"{path}{n}", "missing") for n in w if n not in g] + [(f"{path}{n}", "extra") for n in g if n not in w]
    for n in w.keys() & g.keys():
        if isinstance(w[n], T.StructType) and isinstance(g[n], T.StructType):
            out += schema_differences(w[n], g[n], f"{path}{n}/")
        elif w[n] != g[n]:
            out.append((f"{path}{n}", "type"))
    return sorted(out)


def create_tasks(df: DataFrame, wanted: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """``task``, a record of the wanted fields, from the columns that are there; others are padding. ``task.pad_mask_dict`` tells which."""
    if not any(n in df.columns for n, _ in wanted):
        raise ValueError("a task needs a goal or an instruction")
    values = [(F.col(n) if n in df.columns else padding_of(kind)).alias(n) for n, kind in wanted]
    masks = [F.lit(n in df.columns).alias(n) for n, _ in wanted]
    return df.withColumn("task", F.struct(*values, F.struct(*masks).alias("pad_mask_dict")))


def without_text(df: DataFrame, column: str = "language_instruction") -> DataFrame:
    return df.withColumn(column, F.lit(""))


def tolerant(df: DataFrame, column: str, parse: Column, name: str) -> DataFrame:
    """``name`` parsed from a column by a function that gives null for what it cannot read; such rows go."""
    return df.withColumn(name, parse).where(F.col(name).isNotNull() | F.col(column).isNull())


def norms(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """``count`` of the numbers in a vector column and their common length ``norm``."""
    flat = df.select(*group, F.explode(column).alias("_x"))
    return flat.groupBy(*group).agg(F.count("*").alias("count"), F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("norm"))
