"""Statistics of vectors by dimension, their merge, and their use."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import vectors as V
from wayline.sources.shared import checkpointed


#: Intervals into which a pass of ``exact_quantiles`` cuts each range.
BINS = 1024
#: Open ranges up to which these go to the rows; with more the rows go to the ranges.
FEW_RANGES = 100_000


def _magnitude(x: Column) -> Column:
    """Grows with x, by its logarithm to both sides of zero; doubles lie within 1,460 of it."""
    return F.signum(x) * (F.coalesce(F.ln(F.nullif(F.abs(x), F.lit(0.0))), F.lit(0.0)) + 746)


def _interval(x: Column, low: Column, high: Column) -> Column:
    """Of equal width, by magnitude in ranges that span zero or a factor over 1,024; the ends have intervals of their own, so that every pass narrows every range."""
    wide = (F.signum(low) * F.signum(high) <= 0) | (F.greatest(F.abs(low), F.abs(high)) / 1024 > F.least(F.abs(low), F.abs(high)))
    y = lambda c: F.when(wide, _magnitude(c)).otherwise(c / 2)  # noqa: E731  halves, as the width may be no double
    share = F.nanvl((y(x) - y(low)) / (y(high) - y(low)), F.lit(0.0))
    inner = F.least(F.greatest(F.floor(share * (BINS - 2)).cast("int"), F.lit(0)), F.lit(BINS - 3)) + 1
    return F.when(x == low, 0).when(x == high, BINS - 1).otherwise(inner)


def exact_quantiles(flat: DataFrame, key: Sequence[str], quantiles: Sequence[float], x: str = "x") -> DataFrame:
    """``<key>, q``: for each key the interpolated quantiles of its numbers, in the order asked for.

    Order statistics are found by passes over the rows. Each pass counts the
    numbers of a range in ``BINS`` intervals, with the least and greatest in
    each, and the interval that holds the wanted rank is the next range, until
    a range is one value: a pass for the magnitude, and one for each factor of a
    thousand in what numbers differ by within it, six at most. What is kept of a key is a few ranges, and of a pass the
    intervals of these, whatever the rows. Nulls do not count; NaN is above all
    numbers; a key without numbers has no row.
    """
    k = F.struct(*key)
    rows = flat.where(F.col(x).isNotNull()).select(k.alias("_k"), F.col(x).cast("double").alias("_x"))
    ends = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil))))
    found = checkpointed(ends.select("_k", "n", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before")))
    while n := (open_ := found.where("low < high")).count():
        ranges = open_.select("_k", "low", "high", "before").distinct()
        # few keys would bring their rows together in as few tasks
        ranges = F.broadcast(ranges) if n <= FEW_RANGES else ranges
        inside = rows.join(ranges, "_k").where(F.col("_x").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("_k", "low", "high", "before", _interval(F.col("_x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        upto = F.sum("c").over(Window.partitionBy("_k", "low", "high").orderBy("bin"))
        counts = counts.withColumn("_upto", F.col("before") + upto).withColumn("_before", F.col("_upto") - F.col("c"))
        narrowed = open_.drop("before").join(counts.drop("before"), ["_k", "low", "high"]).where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto")))
        narrowed = narrowed.select("_k", "n", "rank", F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_before").alias("before"))
        found = checkpointed(found.where("not low < high").unionByName(narrowed))
    values = found.groupBy("_k").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("_v"))

    def between(p: Column) -> Column:
        low, high = (F.element_at("_v", f(p).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (p - F.floor(p)) * (high - low))

    return values.select("_k.*", F.array(*(between(p) for p in place)).alias("q"))


def statistics(df: DataFrame, column: str, group: Sequence[str] = (), traj: Sequence[str] = ("traj",), exact: bool = False) -> DataFrame:
    """For each group and dimension: mean, population deviation, extremes, 1st and 99th percentile, and the numbers of steps and trajectories.

    Percentiles are approximate (to a ten-thousandth of the rows) in one pass.
    With ``exact=True`` they are exact and interpolated, in several passes
    (``exact_quantiles``). Memory is bounded either way.
    """
    flat = df.select(*group, F.posexplode(F.col(column)).alias("dim", "x"))
    sums = [F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min")]
    if exact:
        quantiles = exact_quantiles(flat, [*group, "dim"], (0.01, 0.99)).select(F.struct(*group, "dim").alias("_k"), F.col("q").alias("_q"))
        by_dim = flat.groupBy(*group, "dim").agg(*sums).withColumn("_k", F.struct(*group, "dim")).join(quantiles, "_k", "left").drop("_k")
    else:
        by_dim = flat.groupBy(*group, "dim").agg(*sums, F.percentile_approx("x", F.array(F.lit(0.01), F.lit(0.99)), 10_000).alias("_q"))
    by_dim = by_dim.withColumns({"p99": F.get("_q", 1), "p01": F.get("_q", 0)}).drop("_q")
    counts = df.groupBy(*group).agg(F.count("*").alias("num_transitions"), F.count_distinct(*traj).alias("num_trajectories"))
    if not group:
        return by_dim.crossJoin(F.broadcast(counts))  # one row
    return by_dim.join(counts, list(group))


def combine(stats: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Statistics of several sources as one's: means weighted by steps, pooled deviations, extremes; percentiles do not combine."""
    n = F.col("num_transitions")
    both = stats.groupBy(*group, "dim").agg(
        (F.sum(F.col("mean") * n) / F.sum(n)).alias("mean"),
        (F.sum((F.col("std") * F.col("std") + F.col("mean") * F.col("mean")) * n) / F.sum(n)).alias("_square"),
        F.max("max").alias("max"),
        F.min("min").alias("min"),
        F.sum(n).alias("num_transitions"),
        F.sum("num_trajectories").alias("num_trajectories"),
    )
    return both.withColumn("std", F.sqrt(F.greatest(F.col("_square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("_square")


def vectors_of(stats: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """A row for each group with a vector for each statistic."""
    names = [c for c in ("mean", "std", "max", "min", "p99", "p01") if c in stats.columns]
    rows = stats.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("dim", *names))).alias("s"), F.first("num_transitions").alias("num_transitions"), F.first("num_trajectories").alias("num_trajectories")
    )
    return rows.select(*group, *(F.col(f"s.{c}").alias(c) for c in names), "num_transitions", "num_trajectories")


def normalized(df: DataFrame, stats: DataFrame, column: str, kind: str = "normal", mask: Sequence[bool] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """The column normalised by the rows of ``vectors_of``: one row without a group, which is broadcast; rows of groups are left to the optimiser, which knows their size."""
    if kind not in ("normal", "bounds"):
        raise ValueError(f"unknown kind of normalisation: {kind}")
    m = None if mask is None else F.array(*(F.lit(bool(x)) for x in mask))
    s = stats.select(*group, F.struct("mean", "std", "p01", "p99").alias("_s"))
    both = df.join(s, list(group)) if group else df.crossJoin(F.broadcast(s))
    if kind == "normal":
        z = V.normalize(F.col(column), F.col("_s.mean"), F.col("_s.std"), m)
    else:
        z = V.normalize_bounds(F.col(column), F.col("_s.p01"), F.col("_s.p99"), m)
    return both.withColumn(column, z).drop("_s")


def check_mask(mask: Sequence[bool] | None, dim: int) -> None:
    if mask is not None and len(mask) != dim:
        raise ValueError(f"a mask of {len(mask)} for {dim} dimensions")


def cache_key(*parts: str) -> str:
    """Name of what depends on the parts: sha256 of them, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cache_key_column(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def as_json(stats: DataFrame, name: str = "action") -> str:
    """The text of one row of ``vectors_of``."""
    row = stats.first().asDict(recursive=True)
    counts = {k: row.pop(k) for k in ("num_transitions", "num_trajectories")}
    return json.dumps({name: row, **counts}, sort_keys=True)


def write_json(spark: SparkSession, text: str, path: str) -> None:
    """One file of one line, by Spark, so that any store will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def cached(spark: SparkSession, folder: str, depends_on: Sequence[str], compute, force: bool = False, fallback: str | None = None) -> dict:
    """The statistics kept under the key of what they depend on; computed and kept if there are none.

    Where the folder cannot be written to they are kept in the fallback folder, which is read after it.
    """
    paths = [f"{own}/stats_{cache_key(*depends_on)}" for own in (folder, fallback) if own]
    for path in [] if force else paths:
        try:
            return read_json(spark, path)
        except Exception as e:  # noqa: BLE001  Spark tells of a missing path by an analysis error
            if "PATH_NOT_FOUND" not in str(e):
                raise
    text = compute()
    for place, path in enumerate(paths):
        try:
            write_json(spark, text, path)
            break
        except Exception:  # noqa: BLE001  of what kind depends on the store
            if place == len(paths) - 1:
                raise
    return json.loads(text)
