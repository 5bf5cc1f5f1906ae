"""Steps that made queries grow faster than their input, or lie in few tasks."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wayline.operators import mixture, statistics
from wayline.plans import loading, standards, views
from wayline.plans.queries import QUERIES
from wayline.sources import records
from wayline.sources.checksums import masked_of_length, masked_of_lengths
from wayline.streaming import ordered

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@here
@pytest.mark.parametrize("name", ["dobbe", "roboturk"])
def test_standard_steps_are_dealt_out_and_drawn_once(spark, name):
    kind = next(own[name][0] for own in standards.SOURCES.values() if name in own)
    rows = standards._told(spark, DIR, kind, [name])
    tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2 and not re.search(r"lambdafunction\([^\n]*md5\(", plan)


@here
@pytest.mark.parametrize("query", [*standards.SOURCES])
def test_sources_share_the_making_of_their_steps(spark, query):
    plan = standards.QUERIES[query](spark, DIR)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("md5(") == 2 and "Union" not in plan


@here
def test_weighted_sums_of_any_length(spark):
    vectors = [[], [1.5], [0.1 * i for i in range(16)], [0.1 * i for i in range(17)], [0.1 * i for i in range(49)]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    got = [r[0] for r in rows.orderBy("i").select(standards._weighted("v")).collect()]
    assert got == [round(sum(x * (i * i + 1) for i, x in enumerate(v)), 5) for v in vectors]


@here
@pytest.mark.parametrize("query", ["standard_as_is", "standard_shorter"])
def test_sums_of_standard_steps_are_generated_code(spark, query):
    plan = standards.QUERIES[query](spark, DIR)._jdf.queryExecution().sparkPlan().toString()
    assert "lambdafunction(" not in plan and "round(" not in plan and "Filter (" not in plan


@here
def test_wide_standard_steps_are_not_summed_value_by_value(spark):
    plan = standards.QUERIES["standard_slices"](spark, DIR)._jdf.queryExecution().sparkPlan().toString()
    widest = max(standards.WIDTHS.values())
    assert f"[{widest - 1}] * {float((widest - 1) ** 2 + 1)}" in plan and "round(" not in plan
    assert "lambdafunction(0.0," not in plan  # zeros are repeated


@here
@pytest.mark.parametrize("width", [16, 17, 33, 49])
def test_sums_with_a_width_are_those_of_python(spark, width):
    vectors = [[], [1.5], [-0.1 * i for i in range(16)], *([[0.1 * i for i in range(17)], [0.1 * i for i in range(60)]] if width > 16 else [])]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    got = [r["v_sum"] for r in standards.with_sum(rows, "v", width).orderBy("i").collect()]
    assert got == [round(sum(x * (i * i + 1) for i, x in enumerate(v)), 5) for v in vectors]


def test_longer_vectors_than_the_width_are_an_error(spark):
    rows = spark.createDataFrame([([1.0] * 17,)], "v array<double>")
    with pytest.raises(Exception, match="17 values where at most 16 may be"):
        standards.with_sum(rows, "v").collect()


def test_halves_are_rounded_away_from_zero(spark):
    rows = spark.createDataFrame([(0.5 / 2**5,), (-0.5 / 2**5,), (0.000005,), (-0.0,), (float("inf"),), (None,)], "x double")  # 1562.5 hundred-thousandths
    assert [r[0] for r in rows.select(standards._to_five_digits(F.col("x"))).collect()] == [0.01563, -0.01563, 0.00001, 0.0, float("inf"), None]


@here
def test_frames_of_a_mix_are_numbered_without_copies_and_slots_drawn_once(spark):
    plan = QUERIES["mixed_sources"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "ExistingRDD" not in plan
    assert not re.search(r"Filter [^\n]*md5\(", plan)


def test_numbers_by_draw_are_those_by_order(spark):
    draws = [0.0, 0.25, 0.25, 0.5, 0.999999, 0.25, 1e-9]
    df = spark.createDataFrame([(d, k) for k, d in enumerate([*draws, 0.25], -1)] + [(0.25, None)], "d double, k int")
    plain = {tuple(r) for r in mixture.numbered(df, F.col("d"), ["k"]).select("d", "k", "rn").collect()}
    assert {tuple(r) for r in mixture.numbered_by_draw(df, F.col("d"), ["k"]).select("d", "k", "rn").collect()} == plain and len(plain) == 9


class _State:
    """A key's state that counts the calls made to it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda *_: self
        raise AttributeError(name)

    def _called(self):
        self.calls += 1
        return self.held

    def get(self):
        return self._called().get("place")

    def update(self, value):
        self._called()["place"] = value

    def getValue(self, k):  # noqa: N802
        return self._called().get(k)

    def updateValue(self, k, v):  # noqa: N802
        self._called()[k] = v

    def removeKey(self, k):  # noqa: N802
        self._called().pop(k, None)


def test_calls_to_the_state_do_not_grow_with_the_steps_of_a_batch():
    state, history = _State(), ordered.History(2, None)
    history.init(state)
    batches = [[*range(199, 99, -1)], [*range(99, 0, -1)], [5, 0]]
    out = [[(r["t"], r["late"], r["history"]) for r in history.handleInputRows((1,), iter([Row(traj=1, t=t, x=[float(t)]) for t in b]), None)] for b in batches]
    assert out[:2] == [[], []] and out[2][0] == (5, True, None)
    assert [r[0] for r in out[2][1:]] == [*range(200)] and out[2][-1][2] == [[198.0], [199.0]]
    assert state.calls <= 12 and list(state.held) == ["place"]


def test_lengths_are_checked_one_by_one_without_arrays():
    heads = np.random.default_rng(0).integers(0, 256, (50, 8), dtype=np.uint8)
    assert [masked_of_length(h.tobytes()) for h in heads] == masked_of_lengths(heads).tolist()


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pylist([{"x": "a" * 1000}] * 2000)
    pieces = [*records.in_pieces(iter([batch, batch.slice(0, 0)]), 100_000)]
    assert max(p.nbytes for p in pieces) <= 110_000 and pa.Table.from_batches(pieces) == pa.Table.from_batches([batch])
    assert [p.num_rows for p in records.in_pieces(iter([batch.slice(0, 3)]), 10)] == [1, 1, 1]


@here
def test_episodes_are_dealt_out(spark):
    rows = loading._episodes(spark, DIR, 0.0)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == views.tasks(spark)


def test_rows_do_not_meet_their_ranges_by_key(spark, monkeypatch):
    plans = []
    kept = statistics.checkpointed
    monkeypatch.setattr(statistics, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flat = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
        got = {r["k"]: list(r["q"]) for r in statistics.exact_quantiles(flat, ["k"], (0.5,)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {0: [499.0], 1: [500.0]}
    assert len(plans) > 1 and all("BroadcastHashJoin" in p for p in plans[1:])
