"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted words in proportion to its weight but
at most ``max_epochs`` times its own words; what a capped source cannot take
is shared out among the others by weight until nobody is above the cap. All
documents of a source are then taken the whole number of times that fits its
target, and a seeded sample of them once more: those whose hash of seed and id
lies below a cut, which is where the sample's words come nearest the rest of
the target. The cut is found by three histograms of the hash, so no source,
however large, is sorted or gathered in one place.

Defined cases: a null text has no words; a null source is a source, the last
in order; sources without words or of weight 0 get the target 0 and are taken 0 times; rows
of equal id fall on the same side of the cut; an empty table gives an empty
result. Columns of the caller with the names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import checkpointed, table, words

#: A table of sources up to so many rows is broadcast, a larger one joined.
FEW_SOURCES = 10_000
SEED = 17


def uniform32(doc_id: Column, seed: int) -> Column:
    """The first 32 bits of md5 of seed and id."""
    key = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, cycle: Sequence[float], source: str = "source") -> DataFrame:
    """``weight`` for each row of a table of sources: the cycle over them by code point, null last. One row a source."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (rank % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", weight)


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``target`` for each row of ``source_size`` and ``weight``.

    With the sources by cap over weight, the first k are capped and the rest
    take a common level times their weight; k is the least for which that
    level is not above the next cap. For every larger k the level fits too but
    is lower, so the greatest level that fits is the one.
    """
    ordered = Window.orderBy(F.try_divide("_cap", "weight").asc_nulls_last(), "weight", "_cap")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    level = F.try_divide(
        F.col("_all") * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    filled = (
        sources.withColumn("_cap", F.col("source_size") * float(max_epochs))
        .withColumn("_all", F.sum("source_size").over(everyone).cast("double"))
        .withColumn("_level", level)
        .withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level")))
        .withColumn("_common", F.max("_fits").over(everyone))
    )
    target = F.when(F.col("weight") > 0, F.coalesce(F.least("_cap", F.col("_common") * F.col("weight")), F.col("_cap"))).otherwise(0.0)
    return filled.withColumn("target", target).drop("_cap", "_all", "_level", "_fits", "_common")


def _crossing(sizes: DataFrame, bin_: Column) -> DataFrame:
    """For each source the bin in which the running words first pass ``rest``, and the words before it."""
    w = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sizes.groupBy("_source", bin_.alias("_bin")).agg(F.sum("size").alias("_n"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    passed = sums.withColumn("_to", F.col("_before") + F.sum("_n").over(w)).where("_to > _rest")
    return passed.groupBy("_source").agg(F.min(F.struct("_bin", (F.col("_to") - F.col("_n")).alias("_from"), "_to")).alias("_x")).select("_source", "_x.*")


def _near(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    return left.join(F.broadcast(right) if few else right, F.col("_source").eqNullSafe(F.col("_key")), "left").drop("_key")


def cuts(sizes: DataFrame, cycle: Sequence[float], share: float, max_epochs: float) -> tuple[DataFrame, bool]:
    """``source, source_size, target, whole, cut`` for each source of the rows ``source, size, u``, and whether they are few."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = water_fill(cycled_weights(sources, cycle), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = checkpointed(sources)
    few = sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    rows = sizes.withColumnRenamed("source", "_source")
    rows = _near(rows, sources.where("_rest > 0").select(F.col("source").alias("_key"), "_rest"), few).where("_rest is not null").withColumn("_before", F.lit(0).cast("long"))
    for shift, width in ((20, 12), (8, 12)):
        found = _crossing(rows, F.shiftright("u", shift)).select(F.col("_source").alias("_key"), F.col("_bin").alias("_in"), F.col("_from"))
        rows = _near(rows, found, few).where(F.shiftright("u", shift) == F.col("_in")).withColumn("_before", F.col("_from")).drop("_in", "_from")
    last = _crossing(rows, F.col("u")).join(sources.select(F.col("source").alias("_key"), "_rest"), F.col("_source").eqNullSafe(F.col("_key"))).drop("_key")
    cut = F.col("_bin") + ((F.col("_from") + F.col("_to")) / 2 <= F.col("_rest")).cast("long")
    last = last.select(F.col("_source").alias("_key"), cut.alias("cut"))
    out = sources.join(last, F.col("source").eqNullSafe(F.col("_key")), "left").drop("_key", "_rest", "weight")
    return checkpointed(out.withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))), few


def with_copies(docs: DataFrame, cycle: Sequence[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows with ``size, source_size, target`` and ``copies``, the times that the mix takes the document."""
    sized = docs.withColumn("size", F.size(words(F.col(text))).cast("long")).withColumn("_u", uniform32(F.col(doc_id), seed))
    narrow = checkpointed(sized.select(F.col(source).alias("source"), "size", F.col("_u").alias("u")))
    by_source, few = cuts(narrow, cycle, share, max_epochs)
    by_source = by_source.withColumnsRenamed({"source": "_key", "source_size": "_source_size", "target": "_target"})
    taken = sized.join(F.broadcast(by_source) if few else by_source, F.col(source).eqNullSafe(F.col("_key")))
    copies = F.col("whole") + (F.col("_u") < F.col("cut")).cast("long")
    return taken.select(*sized.drop("_u", "source_size", "target", "copies").columns, F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"))


def mix(docs: DataFrame, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """The documents of the mix with the columns they came with, a row for each time one is taken."""
    taken = with_copies(docs, cycle, share, max_epochs, seed).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = with_copies(docs, (5, 2, 1))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
