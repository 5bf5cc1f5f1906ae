"""Skipping with counts, and shuffles through a bounded buffer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from wayline.functions.uniform import plain_uniform
from wayline.operators import mixture
from wayline.operators.skips import Skipped
from wayline.plans.pipelines import Source, TrajectoryTransforms, interleaved, single
from wayline.sources import files


def steps(spark, bad):
    rows = [(k, t, [float(t)], (k, t) in bad) for k in range(6) for t in range(5)]
    return spark.createDataFrame(rows, "traj long, t int, action array<double>, broken boolean")


def test_trajectories_with_bad_steps_go_whole(spark):
    skipped = Skipped()
    df = skipped.trajectories(steps(spark, {(1, 3), (4, 0), (4, 4)}), F.col("broken"), "a")
    assert sorted({r["traj"] for r in df.collect()}) == [0, 2, 3, 5] and df.columns == ["traj", "t", "action", "broken"]
    assert [tuple(r) for r in skipped.report(spark).collect()] == [("a", 6, 2, 10)]
    with pytest.raises(ValueError, match="already"):
        skipped.trajectories(steps(spark, set()), F.col("broken"), "a")


def test_nulls_are_not_bad_and_nothing_may_be_left(spark):
    skipped = Skipped()
    none = steps(spark, set()).withColumn("broken", F.lit(None).cast("boolean"))
    assert skipped.trajectories(none, F.col("broken"), "null").count() == 30
    assert skipped.trajectories(none, F.lit(True), "all").count() == 0
    assert skipped.rows(none.limit(0), F.lit(True), "empty").count() == 0
    assert sorted(tuple(r) for r in skipped.report(spark).collect()) == [("all", 6, 6, 30), ("empty", 0, 0, None), ("null", 6, 0, 0)]


def test_pipelines_count_what_they_skip(spark):
    """Skipped trajectories count once, are in no statistic, and the mix does not hold them."""
    skipped = Skipped()
    sources = [Source(n, steps(spark, bad), bad=F.col("broken"), skip_norm=n == "b") for n, bad in (("a", {(0, 0)}), ("b", {(k, 2) for k in range(3)}))]
    sources.append(Source("c", steps(spark, {(0, 0)})))
    rows = interleaved(sources, TrajectoryTransforms(), skipped=skipped).collect()
    assert {(r["name"], r["traj"]) for r in rows} <= {("a", k) for k in range(1, 6)} | {("b", k) for k in range(3, 6)} | {("c", k) for k in range(6)}
    assert sorted(tuple(r) for r in skipped.report(spark).collect()) == [("a", 6, 1, 5), ("b", 6, 3, 15)]  # however often the mix ran through them
    _, stats = single(sources[0], TrajectoryTransforms())
    assert stats["action"].first()["num_trajectories"] == 5


def plain_buffer(rows, size, lane, seed):
    """One row at a time, as the buffer is described."""
    held, out = [], []
    for n, r in enumerate(rows):
        if n < size:
            held.append(r)
            continue
        s = int(plain_uniform("buffer", seed, lane, n) * size)
        out.append(held[s])
        held[s] = r
    return out + [held[s] for s in sorted(range(len(held)), key=lambda s: (plain_uniform("flush", seed, lane, s), s))]


@pytest.mark.parametrize("size", [1, 7, 64, 5_000])
def test_buffer_against_a_plain_one(spark, size):
    df = spark.range(3_000).select("id", F.when(F.col("id") < 2_500, 0).otherwise(2).alias("lane"), F.lit("own").alias("place"))
    got = [r for r in mixture.buffer_shuffled(df, ["id"], size, 3, 5).orderBy("lane", "place").collect()]
    for lane, ids in ((0, range(2_500)), (2, range(2_500, 3_000))):
        own = [r for r in got if r["lane"] == lane]
        assert [r["id"] for r in own] == plain_buffer(list(ids), size, lane, 5) and [r["place"] for r in own] == list(range(len(own)))
        assert all(r["place"] > r["id"] - ids[0] - size for r in own)  # forwards by less than the buffer
        assert size > 1 or [r["id"] for r in own] == list(ids)
    again = mixture.buffer_shuffled(df.repartition(7), ["id"], size, 3, 5).orderBy("lane", "place").collect()
    assert again == got
    other = mixture.buffer_shuffled(df, ["id"], size, 3, 6).orderBy("lane", "place").collect()
    assert size == 1 or other != got


def test_small_batches_change_nothing(spark):
    df = spark.range(1_000).select("id", F.lit(0).alias("lane"))
    whole = mixture.buffer_shuffled(df, ["id"], 50, 1).collect()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 13)
        assert mixture.buffer_shuffled(df, ["id"], 50, 1).collect() == whole
    finally:
        spark.conf.set(name, before)
    with pytest.raises(ValueError, match="a buffer needs"):
        mixture.buffer_shuffled(df, ["id"], 0, 1)
    assert mixture.buffer_shuffled(df.limit(0), ["id"], 5, 2).count() == 0


def test_files_in_the_order_of_a_draw(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4_000).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    rows = files.read_shuffled(spark, path, 1, 2, seed=3).orderBy("lane", "place").collect()
    assert sorted(r["id"] for r in rows) == list(range(4_000))
    names = sorted({r["file"] for r in rows}, key=lambda f: (plain_uniform("file", 3, f), f))
    for lane in (0, 1):
        own = [(r["file"], r["row_index"]) for r in rows if r["lane"] == lane]
        order = {f: k for k, f in enumerate(names[lane::2])}
        assert own == sorted(own, key=lambda x: (order[x[0]], x[1]))
    far = files.read_shuffled(spark, path, 300, 2, seed=3).orderBy("lane", "place").collect()
    assert far == files.read_shuffled(spark, path, 300, 2, seed=3).orderBy("lane", "place").collect() and [r["id"] for r in far] != [r["id"] for r in rows]
