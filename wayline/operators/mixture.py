"""Splits, weights, interleaving, shuffles and batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.uniform import plain_uniform, uniform
from wayline.sources.shared import checkpointed

#: Slots of a mix that are numbered together.
BLOCK = 1 << 16
#: Parts of equal width into which draws are cut for ``numbered_by_draw``.
CELLS = 1 << 14


def numbered(df: DataFrame, by: Column, ties: Sequence[str] = (), name: str = "rn", parts: int | None = None) -> DataFrame:
    """Row numbers from 1 in the order of a column and the ties, nulls first, without gathering all rows in one task.

    Rows are range-partitioned in that order and kept in the shared folder; a
    row's number is its place in its partition and the rows in those before, of
    which there is a row a partition. Wide rows are better fetched by a key
    afterwards (``pipelines.interleaved`` does). Rows that tie in all may swap
    numbers in a rerun.
    """
    order = ["_own", *ties]
    ordered = [F.col(c).asc_nulls_first() for c in order]
    rows = df.withColumn("_own", by).repartitionByRange(*([parts] if parts else []), *ordered).sortWithinPartitions(*ordered).drop("_own").withColumn("_at", F.monotonically_increasing_id())
    rows = checkpointed(rows).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_count"))
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(parts), "_part").withColumn(name, place).drop("_at", "_part", "_before")


def numbered_by_draw(df: DataFrame, draw: Column, ties: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Row numbers from 1 in the order of a draw from 0 up to 1 and the ties, as ``numbered`` gives them.

    Draws are spread evenly, so parts of equal width hold about as many rows
    each: neither a sample of the rows nor a copy of them is needed. A row's
    number is its place in its part and the rows in the parts before. Rows must
    come out alike when they are read twice. Parts are never
    null, or the join would draw once more to leave nulls out.
    """
    rows = df.withColumn("_draw", draw).withColumn("_cell", F.coalesce(F.floor(F.col("_draw") * CELLS), F.lit(0)))
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_cell").agg(F.count("*").alias("_count")).select("_cell", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(F.col("_draw").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in ties)))
    return rows.withColumn("_place", place).join(F.broadcast(sizes), "_cell").withColumn(name, F.col("_before") + F.col("_place")).drop("_draw", "_cell", "_place", "_before")


def numbered_within(df: DataFrame, group: str, order: Sequence[str], name: str = "rn") -> DataFrame:
    """Row numbers from 0 within each group by the order, whatever the groups' sizes.

    All rows are range-partitioned by group and order; a row's number is its
    place in its partition, less the rows there of groups before its own, plus
    those of its group in partitions before. Of a partition only its first row
    of each group is told, so a row a partition and group is gathered. Rows that
    tie in all of the order may swap numbers in a rerun.
    """
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = checkpointed(rows).withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(F.col(group).alias("_group"), "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_offset", F.coalesce(before, F.lit(0)) - F.col("_first")).withColumnRenamed("_part", "_of").drop("_count", "_first")
    met = rows.join(runs, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_part", "_of", "_offset", "_group")


def split(df: DataFrame, key: str, share: float = 0.95, name: str = "split") -> DataFrame:
    """``train`` for the first share of the trajectories by key, rounded to a whole number of them, ``val`` for the rest."""
    keys = numbered(df.select(key).distinct(), F.col(key), name="_rn")  # keys of any type that has an order
    n = keys.count()
    last = int(np.floor(share * n + 0.5))
    edge = keys.where(F.col("_rn") == last).select(key).first()
    train = F.lit(False) if edge is None else F.col(key) <= F.lit(edge[0])
    return df.withColumn(name, F.when(train, "train").otherwise("val"))


def balanced(weights: DataFrame, balance: bool = True) -> DataFrame:
    """``sampling_weight`` of rows ``weight, num_transitions``: in proportion to their product, or to the weight alone; they sum to 1."""
    w = F.col("weight") * F.col("num_transitions") if balance else F.col("weight")
    return weights.withColumn("sampling_weight", w / F.sum(w).over(Window.partitionBy()))


def allocate(n: int, weights: Sequence[float]) -> list[int]:
    """n units by weight, by largest remainders (of equal ones the last first): at least one for each weight above zero, none for zero; an error if there are fewer units than weights."""
    w = np.asarray(weights, dtype=float)
    if (w < 0).any() or n < len(w):
        raise ValueError("weights must not be negative, nor more than the units")
    out, left, open_ = np.zeros(len(w), dtype=int), n, w > 0
    if not open_.any():
        raise ValueError("no weight is above zero")
    while True:
        share = np.where(open_, w / max(w[open_].sum(), 1e-300) * left, 0)
        small = open_ & (share < 1)
        if not small.any():
            break
        out[small] = 1
        left -= int(small.sum())
        open_ &= ~small
        if not open_.any():
            return out.tolist()
    whole = np.floor(share).astype(int)
    out[open_] = whole[open_]
    for i in np.argsort((share - whole) * open_, kind="stable")[::-1][: left - int(whole[open_].sum())]:
        out[i] += 1
    return out.tolist()


def allocated(rows: DataFrame, n: int, weight: str = "sampling_weight") -> DataFrame:
    """``units`` of n for each row, as ``allocate`` deals them out to the rows in the order of ``name``.

    Sources that would get less than one unit get one, the lightest first;
    each takes more from the rest than its share, so the next may fall below
    one too, until the first that does not. There is a row for each source, so
    few that one task takes them all.
    """
    lightest = Window.orderBy(weight, "name")
    before, everyone = lightest.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    some = F.when(F.col(weight) > 0, 1).otherwise(0)
    left = F.lit(n) - F.coalesce(F.sum(some).over(before), F.lit(0))
    unit = left / (F.sum(weight).over(everyone) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    out = rows.withColumn("_one", (F.col(weight) > 0) & (F.col(weight) * unit < 1))
    enough = F.max((~F.col("_one") & (F.col(weight) > 0)).cast("int")).over(lightest.rowsBetween(Window.unboundedPreceding, 0)) == 1
    out = out.withColumn("_open", enough)
    rest = F.lit(n) - F.sum(F.when(~F.col("_open"), some).otherwise(0)).over(everyone)
    share = F.when(F.col("_open"), F.col(weight) * rest / F.sum(F.when(F.col("_open"), F.col(weight))).over(everyone)).otherwise(some.cast("double"))
    out = out.withColumn("_share", share).withColumn("_whole", F.floor("_share"))
    remainder = Window.orderBy(F.desc(F.col("_share") - F.col("_whole")), F.desc("name"))
    spare = F.lit(n) - F.sum("_whole").over(everyone)
    return out.withColumn("units", (F.col("_whole") + (F.row_number().over(remainder) <= spare).cast("int")).cast("long")).drop("_one", "_open", "_share", "_whole")


def interleaved(frames: DataFrame, weights: DataFrame, n: int, seed: int = 0, name: str = "name") -> DataFrame:
    """n frames, each from a source drawn by weight; a source's frames come in turn, again and again.

    ``frames`` has ``frame_no`` from 0 within each source. Slots meet their
    frames by a join on source and number; the weights, one row a source, are
    gathered on the driver.
    """
    rows = weights.select(name, "sampling_weight", "num_transitions").orderBy(name).collect()
    sums = np.cumsum([r["sampling_weight"] for r in rows])
    spark = frames.sparkSession
    u = uniform("slot", seed, F.col("slot"))
    slots = spark.range(n if rows else 0).withColumnRenamed("id", "slot").withColumn("_u", u)

    def of_source(values: Sequence) -> Column:
        """The value of the first source whose sum is above the draw; never null, or joins would draw once more to leave nulls out."""
        return reduce(lambda rest, pair: F.when(F.col("_u") < float(pair[0]), pair[1]).otherwise(rest), [*zip(sums, values)][-2::-1], F.lit(values[-1] if values else None))

    slots = slots.withColumns({name: of_source([r[name] for r in rows]), "_n": of_source([r["num_transitions"] for r in rows])}).drop("_u")
    # A source's turns are counted in blocks of slots, so that no source, however large its share, is sorted in one task.
    slots = slots.withColumn("_block", F.floor(F.col("slot") / BLOCK))
    so_far = F.sum("count").over(Window.partitionBy(name).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    before = slots.groupBy(name, "_block").count().withColumn("_before", F.coalesce(so_far, F.lit(0))).drop("count")
    turn = F.row_number().over(Window.partitionBy(name, "_block").orderBy("slot")) - 1
    slots = slots.withColumn("_turn", turn).join(before, [name, "_block"])
    slots = slots.withColumn("frame_no", ((F.col("_turn") + F.col("_before")) % F.col("_n")).cast("long")).drop("_n", "_turn", "_before", "_block")
    return slots.join(frames, ["frame_no", name])  # sorted by number first: names are alike in most rows


def fetched(frames: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The frames, told by a key only, with the other columns of the rows of that key; a hash before the key is what rows are sorted by."""
    own = [c for c in rows.columns if c not in key]
    both = {"_hash": F.xxhash64(*key), "_key": F.struct(*key)}
    there = rows.select(*(c.alias(n) for n, c in both.items()), *own)
    return frames.drop(*own).withColumns(both).join(there, [*both]).drop(*both)


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """The rows in the order of a draw for each key."""
    return df.orderBy(uniform("shuffle", seed, *(F.col(k) for k in key)), *key)


def batches(df: DataFrame, size: int, seed: int, *key: str) -> DataFrame:
    """``batch_id`` and ``place`` in it, in shuffled order; the last batch may be smaller."""
    out = numbered(df, uniform("shuffle", seed, *(F.col(k) for k in key)), key, name="_rn")
    return out.withColumns({"batch_id": F.floor((F.col("_rn") - 1) / size), "place": (F.col("_rn") - 1) % size}).drop("_rn")


def file_lanes(df: DataFrame, file: str, lanes: int, seed: int = 0) -> DataFrame:
    """``lane`` and ``file_draw`` of each row: files in the order of a draw, dealt out to the lanes in turn. A row a file is ordered in one task."""
    draw = uniform("file", seed, F.col(file))
    files = df.select(F.col(file).alias("_file")).distinct()
    rank = F.row_number().over(Window.orderBy(uniform("file", seed, F.col("_file")), "_file")) - 1
    dealt = files.select("_file", (rank % lanes).cast("int").alias("lane"))
    return df.join(dealt, F.col(file).eqNullSafe(F.col("_file"))).drop("_file").withColumn("file_draw", draw)


def buffer_shuffled(df: DataFrame, order: Sequence[str], size: int, lanes: int, seed: int = 0, lane: str = "lane") -> DataFrame:
    """The rows of each lane from 0 to ``lanes`` in the order in which a buffer of ``size`` rows lets them go, numbered by ``place`` from 0.

    A lane is a partition, read in the given order. Its first rows fill the
    buffer; each further row takes the place in it that a draw of the lane and
    the row's number names, and the row that was there goes. What is left at the
    end goes by a draw for each place of the buffer. So a row moves forwards by
    less than ``size`` places, backwards by any number, and memory holds a
    buffer and a batch. A rerun, or another partitioning of the input, gives the
    same order if ``order`` leaves no ties.
    """
    if size < 1 or lanes < 1:
        raise ValueError("a buffer needs a row, and rows a lane")
    rows = df.drop("place").repartitionById(lanes, F.col(lane)).sortWithinPartitions(lane, *order)

    def let_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n, at = None, None, 0, 0

        def numbered_from(t: pa.Table, start: int) -> list[pa.RecordBatch]:
            return t.append_column("place", pa.array(range(start, start + len(t)), pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            if not len(batch):
                continue
            own = batch[lane][0].as_py() if own is None else own
            kept = 0 if held is None else len(held)
            slots, gone = list(range(kept)), []
            for k in range(len(batch)):
                if n < size:
                    slots.append(kept + k)
                else:
                    s = int(plain_uniform("buffer", seed, own, n) * size)
                    gone.append(slots[s])
                    slots[s] = kept + k
                n += 1
            new = pa.Table.from_batches([batch])
            both = new if held is None else pa.concat_tables([held, new])
            yield from numbered_from(both.take(pa.array(gone, pa.int64())), at)
            at += len(gone)
            held = both.take(pa.array(slots, pa.int64())).combine_chunks()
        if held is not None:
            rest = sorted(range(len(held)), key=lambda s: (plain_uniform("flush", seed, own, s), s))
            yield from numbered_from(held.take(rest), at)

    return rows.mapInArrow(let_go, T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())]))


def iterate(df: DataFrame, prefetch: bool = True):
    """Rows one by one, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


def expected_length(stats: DataFrame, share: float = 0.95) -> int:
    """Steps of an epoch: the sources' steps times their weights, and of these the split's share."""
    return int((stats.agg(F.sum(F.col("num_transitions") * F.col("weight"))).first()[0] or 0) * share)


def chosen(sources: DataFrame, names: Sequence[str] | None = None, name: str = "name", weight: str = "weight") -> DataFrame:
    """The sources to evaluate on: all for None, else those named; without weights all weigh 1."""
    out = sources if weight in sources.columns else sources.withColumn(weight, F.lit(1.0))
    return out if names is None else out.where(F.col(name).isin(*names) if names else F.lit(False))


def report(sources: DataFrame, width: int = 80, name: str = "name", weight: str = "weight") -> DataFrame:
    """``line``: each source with its weight to six digits, filled up with equals signs."""
    filled = F.lpad(F.format_string("%.6f", F.col(weight)), F.lit(width) - F.length(name), F.lit("="))
    return sources.select(F.concat(F.lit("# "), F.col(name), F.lit(": "), filled, F.lit(" #")).alias("line"))
