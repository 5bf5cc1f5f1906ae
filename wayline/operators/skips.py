"""Leaving out what cannot be used, with a count.

The counts are aggregates of their own over the same rows, run when they are
asked for; of the source they read the columns that tell bad rows, and no
others. (Metrics observed in passing would save that pass, but Spark adds them
up again wherever it runs a stage twice, as sampling for a range partitioning
and lost executors make it do; so they cannot be relied on.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import steps as S


class Skipped:
    """What was left out of each named source."""

    def __init__(self) -> None:
        self._counts: dict[str, DataFrame] = {}

    def _counted(self, df: DataFrame, name: str, trajectories: Column, skipped: Column, steps: Column) -> DataFrame:
        if name in self._counts:
            raise ValueError(f"{name} is counted already")
        counts = df.agg(trajectories.alias("trajectories"), skipped.alias("skipped_trajectories"), steps.alias("skipped_steps"))
        self._counts[name] = counts.select(F.lit(name).alias("source"), *counts.columns)
        return df.where("not _bad").drop("_bad")

    def rows(self, df: DataFrame, bad: Column, name: str) -> DataFrame:
        """The rows that are not bad, where each row is a trajectory, as records are; a null is not bad. How many steps they would have had is not known."""
        rows = df.withColumn("_bad", F.coalesce(bad, F.lit(False)))
        return self._counted(rows, name, F.count(F.lit(1)), F.count_if("_bad"), F.max(F.lit(None).cast("long")))

    def trajectories(self, df: DataFrame, bad: Column, name: str, key: S.Keys = S.KEY) -> DataFrame:
        """The steps of the trajectories that have no bad step; a null is not bad. Steps are numbered by ``t`` from 0."""
        rows = df.withColumn("_bad", F.coalesce(F.bool_or(bad).over(S.whole(key)), F.lit(False)))
        first = F.col("t") == 0
        return self._counted(rows, name, F.count_if(first), F.count_if(F.col("_bad") & first), F.count_if("_bad"))

    def report(self, spark: SparkSession) -> DataFrame:
        """``source, trajectories, skipped_trajectories, skipped_steps``, a row a source."""
        schema = "source string, trajectories long, skipped_trajectories long, skipped_steps long"
        return reduce(DataFrame.unionByName, self._counts.values(), spark.createDataFrame([], schema))
