"""Streams whose steps come late, against their batch forms."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F
from wayline.operators import steps as S
from wayline.streaming import control, ordered


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    ordered.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def run(spark, streamed, name, folder):
    q = streamed.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table(name).collect()
    q.stop()
    return rows


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_shuffled_arrival_over_three_batches(spark, store, tmp_path):
    df = spark.range(240).select((F.col("id") % 5).alias("traj"), F.floor(F.col("id") / 5).cast("int").alias("t"), F.array((F.col("id") * 0.5), F.col("id") * 1.0).alias("x"))
    df = df.withColumn("chunk", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.col("x")[0] + j * j))
    for k in range(3):
        df.where(F.pmod(F.xxhash64("traj", "t"), F.lit(3)) == k).orderBy(F.xxhash64("t")).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    stream = lambda: source(spark, tmp_path / "in/*", df.schema)
    wanted = df.select("traj", "t", S.history("x", 4).alias("history"), S.history_mask(4).alias("mask"))
    got = run(spark, ordered.histories(stream(), 4), "late_history", tmp_path / "c1")
    assert not any(r["late"] for r in got)
    assert sorted((r["traj"], r["t"], [list(x) for x in r["history"]], list(r["mask"])) for r in got) == sorted((r["traj"], r["t"], [list(x) for x in r["history"]], list(r["mask"])) for r in wanted.collect())
    means = {(r["traj"], r["t"]): r["action"] for r in control.ensemble_batch(df, 3, 0.1).collect()}
    got = run(spark, ordered.ensembles(stream(), 3, 0.1), "late_ensemble", tmp_path / "c2")
    assert {(r["traj"], r["t"]): pytest.approx(r["action"]) for r in got} == means and len(got) == 240


def test_gaps_are_given_up_and_what_comes_then_is_late(spark, store, tmp_path):
    schema = "traj long, t int, x array<double>"
    turns = [[(1, 0, [0.0]), (1, 3, [3.0]), (1, 4, None)], [(2, 1, [9.0])], [(1, 2, [2.0]), (1, 5, [5.0]), (1, 0, [7.0])]]
    (tmp_path / "in").mkdir()
    streamed = ordered.histories(source(spark, tmp_path / "in", schema), 2, patience=500)
    q = streamed.writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    try:
        for k, (rows, least) in enumerate(zip(turns, (3, 4, 7))):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            until = time.time() + 40
            while spark.table("gaps").count() < least and time.time() < until:
                time.sleep(0.3)
        got = {(r["traj"], r["t"], r["late"]): (r["history"] and [list(x) for x in r["history"]], r["mask"]) for r in spark.table("gaps").collect()}
    finally:
        q.stop()
    assert got == {
        (1, 0, False): ([[0.0], [0.0]], [False, True]), (1, 3, False): ([[0.0], [3.0]], [True, True]), (1, 4, False): ([[3.0], []], [True, True]),
        (2, 1, False): ([[9.0], [9.0]], [False, True]), (1, 2, True): (None, None), (1, 0, True): (None, None), (1, 5, False): ([[], [5.0]], [True, True]),
    }


def test_executions_of_chunks(spark):
    rows = [(1, 0, [0.1, 0.2, 0.3], [1.0, 2.0, 3.0], [False, True, False]), (1, 3, [0.4, 0.5, 0.6], [1.0, 1.0, 1.0], [False] * 3), (2, 0, [], [], []), (2, 1, [0.7], [4.0], [True])]
    df = spark.createDataFrame(rows, "traj long, t int, chunk array<double>, rewards array<double>, dones array<boolean>")
    for n in (1, 2, 5):
        both = [sorted((r["traj"], r["chunk_no"], r["i"], r["action"], r["reward"], r["reward_so_far"]) for r in f(df, n).collect()) for f in (ordered.executions, control.executed)]
        assert both[0] == both[1] and len(both[0]) == {1: 3, 2: 5, 5: 6}[n]
