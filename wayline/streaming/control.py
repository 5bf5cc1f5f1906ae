"""Stateful windows over streams of steps, and their batch forms.

Each stream operator keeps a few last items for every key, by Spark's state
store, and takes the steps of a key in the order of ``t`` within a micro-batch.
A step with ``t`` 0 starts the key anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.functions import vectors as V
from wayline.operators import steps as S


def history_stream(df: DataFrame, size: int) -> DataFrame:
    """``traj, t, history, mask`` of a stream ``traj, t, x``: the last values, before the first its own value."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, x in zip(rows["t"], rows["x"], strict=True):
            if t == 0:
                held, n = [], 0
            held, n = ([x] * size if not held else [*held[1:], x]), n + 1
            out.append((key[0], int(t), held, [i >= size - min(n, size) for i in range(size)]))
        state.update((held, n))
        yield pd.DataFrame(out, columns=["traj", "t", "history", "mask"])

    return df.groupBy("traj").applyInPandasWithState(
        run, "traj long, t int, history array<double>, mask array<boolean>", "held array<double>, n int", "append", GroupStateTimeout.NoTimeout
    )


def history_batch(df: DataFrame, size: int) -> DataFrame:
    return df.select("traj", "t", S.history("x", size).alias("history"), S.history_mask(size).alias("mask"))


def ensemble_stream(df: DataFrame, horizon: int, decay: float = 0.0) -> DataFrame:
    """``traj, t, action`` of a stream ``traj, t, chunk``: the mean of what the last chunks say of this step, weighing ``exp(-decay i)``, i = 0 for the oldest."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat = list(state.get[0]) if state.exists else []
        held = [flat[i : i + horizon] for i in range(0, len(flat), horizon)]
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, chunk in zip(rows["t"], rows["chunk"], strict=True):
            held = [*([] if t == 0 else held), [float(x) for x in chunk]][-horizon:]
            said = [c[len(held) - 1 - i] for i, c in enumerate(held)]
            w = [math.exp(-decay * i) for i in range(len(said))]
            out.append((key[0], int(t), sum(a * b for a, b in zip(w, said, strict=True)) / sum(w)))
        state.update(([x for c in held for x in c],))
        yield pd.DataFrame(out, columns=["traj", "t", "action"])

    return df.groupBy("traj").applyInPandasWithState(run, "traj long, t int, action double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def ensemble_batch(df: DataFrame, horizon: int, decay: float = 0.0) -> DataFrame:
    """The same of a table: each chunk's entries go to the steps that they speak of."""
    said = df.select("traj", F.col("t").alias("made"), F.posexplode("chunk").alias("j", "x")).where(F.col("j") < horizon)
    said = said.withColumn("t", (F.col("made") + F.col("j")).cast("int"))
    age = F.row_number().over(Window.partitionBy("traj", "t").orderBy("made")) - 1
    w = F.exp(F.col("i") * -decay)
    means = said.withColumn("i", age).groupBy("traj", "t").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("action"))
    return means.join(df.select("traj", "t"), ["traj", "t"], "left_semi")


def executed(df: DataFrame, exec_horizon: int) -> DataFrame:
    """``traj, chunk_no, i, action, reward`` of chunks ``traj, t, chunk, rewards, dones``: their first actions, up to and with the first that ends the episode.

    ``reward_so_far`` sums the chunk's rewards up to the action.
    """
    rows = df.select("traj", F.col("t").alias("chunk_no"), F.posexplode(F.slice(F.arrays_zip("chunk", "rewards", "dones"), 1, exec_horizon)).alias("i", "s"))
    rows = rows.select("traj", "chunk_no", "i", F.col("s.chunk").alias("action"), F.col("s.rewards").alias("reward"), F.col("s.dones").alias("done"))
    w = Window.partitionBy("traj", "chunk_no").orderBy("i")
    ended = F.coalesce(F.bool_or("done").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumns({"_ended": ended, "reward_so_far": F.sum("reward").over(w)})
    return rows.where(~F.col("_ended")).drop("_ended")


def normalised(df: DataFrame, statistics: dict, column: str = "proprio") -> DataFrame:
    """Vectors of a table or stream normalised by given statistics: ``mean, std`` and, if not all dimensions are, ``mask``."""
    number = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    mask = statistics.get("mask")
    return df.withColumn(column, V.normalize(F.col(column), number(statistics["mean"]), number(statistics["std"]), None if mask is None else F.array(*(F.lit(bool(x)) for x in mask))))


def hooked(df: DataFrame, hooks, checkpoint: str):
    """A query that calls every hook with each micro-batch and its number, the step."""

    def each(batch: DataFrame, step: int) -> None:
        batch.persist()
        for hook in hooks:
            hook(batch, step)
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
