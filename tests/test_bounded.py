"""Operators that must not gather a trajectory, a group or all distinct values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayline.operators import mixture, relabel, statistics


def plain_quantile(xs, q):
    """Nulls left out, NaN above all, interpolated between neighbours."""
    xs = sorted((x for x in xs if x is not None), key=lambda x: (math.isnan(x), x))
    p = q * (len(xs) - 1)
    low, high = xs[math.floor(p)], xs[math.ceil(p)]
    return low if low == high else low + (p - math.floor(p)) * (high - low)


@pytest.mark.parametrize("bins", [64, 1024])
def test_exact_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(statistics, "BINS", bins)
    rng = np.random.default_rng(0)
    inf, nan = math.inf, math.nan
    groups = {
        "normal": rng.normal(size=700).tolist(), "skewed": (10.0 ** rng.uniform(-300, 300, 200)).tolist(), "ties": [1.0] * 50 + [2.0] * 3 + [1e9], "one": [5.0], "two": [-1.0, 1.0],
        "extremes": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0], "infinite": [-inf, inf, 1.0, 2.0, 3.0, -inf, inf], "nulls": [None, 3.0, None, 1.0], None: [1.0, 2.0, 4.0], "zeros": [-0.0, 0.0, 0.0],
    }
    quantiles = (0.0, 0.01, 0.3, 0.5, 0.99, 1.0)
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("none", None)], "g string, x double").repartition(5)
    got = {r["g"]: r["q"] for r in statistics.exact_quantiles(df, ["g"], quantiles).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        wanted = [plain_quantile(xs, q) for q in quantiles]
        assert got[g] == pytest.approx(wanted, rel=1e-12, nan_ok=True), g
    with_nan = spark.createDataFrame([(x,) for x in [nan, 1.0, 2.0, 3.0, nan]], "x double")
    assert statistics.exact_quantiles(with_nan, [], (0.0, 0.25, 0.5)).first()["q"] == [1.0, 2.0, 3.0]
    assert statistics.exact_quantiles(df.limit(0), ["g"], quantiles).count() == 0


def test_statistics_exact_and_sketched_agree_on_few_rows(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("traj"), (F.col("id") % 2).alias("kind"), F.array(F.col("id") * 1.0, F.sqrt("id")).alias("action"))
    exact, plain = ({(r["kind"], r["dim"]): r for r in statistics.statistics(df, "action", ["kind"], exact=e).collect()} for e in (True, False))
    assert exact.keys() == plain.keys() == {(k, d) for k in (0, 1) for d in (0, 1)}
    for k, r in exact.items():
        xs = [i * 1.0 if k[1] == 0 else math.sqrt(i) for i in range(k[0], 300, 2)]
        assert (r["p01"], r["p99"]) == pytest.approx(tuple(np.quantile(xs, [0.01, 0.99]))) and r["mean"] == plain[k]["mean"] and abs(r["p99"] - plain[k]["p99"]) < 3


def test_goals_are_fetched_not_gathered(spark):
    """Every goal is the step it names, also beside other keys and null ones; no row of the plan holds a list of steps."""
    rows = [(k, j, t, bytes([j, t]) * 3, f"x{t}") for k in ("a", None) for j in (0, 1) for t in range(12 if j else 1)]
    df = spark.createDataFrame(rows, "traj string, part int, t int, image binary, own string").repartition(3)
    out = relabel.relabel_goals(df, ["image"], 4, None, key=("traj", "part"))
    got = out.collect()
    assert len(got) == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    plain = relabel.relabel_goals(df, ["image"], 4, 5, key=("traj", "part")).collect()
    assert len(plain) == len(rows)
    for r in plain:
        assert r["t"] <= r["task_timestep"] <= min(r["t"] + 5, 11 if r["part"] else 0) and bytes(r["task_image"]) == bytes([r["part"], r["task_timestep"]]) * 3
    assert {r["task_timestep"] - r["t"] for r in plain if r["part"]} >= {0, 1, 2}


def test_numbers_within_groups(spark):
    df = spark.range(5_000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") * 7919 % 5_003).alias("x"), F.lit("own").alias("_n"))
    got = mixture.numbered_within(df.repartition(6), "g", ["x"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["rn"], r["x"]))
    assert len(got) == 5_000 and None in by and len(by["hot"]) == 3_500
    for own in by.values():
        assert [n for n, _ in sorted(own)] == list(range(len(own))) and [x for _, x in sorted(own)] == sorted(x for _, x in own)
    assert mixture.numbered_within(df.limit(0), "g", ["x"]).count() == 0
