"""Small hand-written cases against plain loops, and the errors that guard inputs."""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from wayline.functions import vectors as V
from wayline.operators import evaluate, mixture, model, relabel, standardise, statistics
from wayline.operators import steps as S
from wayline.plans import specs
from wayline.plans.pipelines import Source, TrajectoryTransforms, interleaved, single
from wayline.sources import catalog
from wayline.streaming import control


def frame(spark, trajectories, schema="traj long, t int, action array<double>"):
    return spark.createDataFrame([(i, t, list(a)) for i, own in enumerate(trajectories) for t, a in enumerate(own)], schema)


LENGTHS = (1, 2, 3, 7)


@pytest.mark.parametrize(("window", "horizon"), [(1, 1), (2, 3), (4, 5), (3, 12)])
def test_chunks_match_a_loop(spark, window, horizon):
    rng = np.random.default_rng(0)
    trajectories = [rng.normal(size=(n, 2)).round(3).tolist() for n in LENGTHS]
    df = frame(spark, trajectories).withColumn("state", F.col("action"))
    got = S.chunked(df, ["state"], window, horizon).collect()
    assert len(got) == sum(LENGTHS)
    for r in got:
        own = trajectories[r["traj"]]
        n, t = len(own), r["t"]
        assert r["state"] == [own[max(0, t - window + 1 + k)] for k in range(window)]
        assert r["timestep_pad_mask"] == [t - window + 1 + k >= 0 for k in range(window)]
        assert r["action"] == [[own[min(n - 1, max(0, t - window + 1 + k) + h)] for h in range(horizon)] for k in range(window)]
        done = [[n - 1 - (t - (window + 1) + w + h) <= 0 for h in range(horizon)] for w in range(window)]
        assert r["task_completed"] == done
        assert r["action_pad_mask"] == [[[not d] * 2 for d in row] for row in done]


def grippers(spark, values):
    return spark.createDataFrame([(i, t, float(x)) for i, own in enumerate(values) for t, x in enumerate(own)], "traj long, t int, g double")


VALUES = [[0.5], [0.99, 0.5, 0.02, 0.5], [0.5, 0.4, 0.3], [0.0, 1.0, 0.5, 0.5, 1.0]]


def test_binarized_gripper(spark):
    got = grippers(spark, VALUES).select("traj", "t", S.binarized_gripper(F.col("g")).alias("x")).orderBy("traj", "t").collect()
    for i, own in enumerate(VALUES):
        carry, want = own[-1], []
        for x in reversed(own):
            carry = 1.0 if x > 0.95 else 0.0 if x < 0.05 else carry
            want.append(carry)
        assert [r["x"] for r in got if r["traj"] == i] == want[::-1]


def test_absolute_gripper(spark):
    values = [[0.0], [0.0, -0.5, 0.0, 0.5], [0.3, 0.0], [0.05, -0.05]]
    got = grippers(spark, values).select("traj", "t", S.absolute_gripper(F.col("g")).alias("x"), S.open_or_closed(F.col("g")).alias("o")).orderBy("traj", "t").collect()
    for i, own in enumerate(values):
        moves = [1.0 if x < -0.1 else -1.0 if x > 0.1 else 0.0 for x in own]
        first = next((m for m in moves if m), 0.0)
        carry, want = (-first if first else 1.0), []
        for m in moves:
            carry = m or carry
            want.append(carry / 2 + 0.5)
        assert [r["x"] for r in got if r["traj"] == i] == want
        assert {r["o"] for r in got if r["traj"] == i} == {next((0.0 if x > 1e-3 else 1.0 for x in own if abs(x) > 1e-3), 0.0)}


def test_rolls_go_around(spark):
    df = grippers(spark, VALUES)
    ks = (1, 2, 4, -1, -3)
    got = S.rolled(df, {f"k{k}": ("g", k) for k in ks}).orderBy("traj", "t").collect()
    for i, own in enumerate(VALUES):
        for k in ks:  # also further than the trajectory is long
            assert [r[f"k{k}"] for r in got if r["traj"] == i] == np.roll(own, k).tolist()


def closings(spark, pred, truth, height):
    """Steps of one trajectory with gripper states and heights; the other six dimensions are zero."""
    rows = [(0, t, [0.0] * 6 + [p], [0.0] * 6 + [q], h) for t, (p, q, h) in enumerate(zip(pred, truth, height, strict=True))]
    return evaluate.step_metrics(spark.createDataFrame(rows, "traj long, t int, pred array<double>, truth array<double>, height double"))


def test_gripping_and_releasing_by_hand(spark):
    truth = [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    m = evaluate.trajectory_metrics(closings(spark, truth, truth, [0.0] * 10)).orderBy("t").collect()
    # Closed at 4 and 5. Gripping: three steps before a closed one while open, or closed and open three before.
    assert [r["t"] for r in m if r["gripping"]] == [1, 2, 4, 5]
    # Releasing: open and closed three before, or closed and open three after.
    assert [r["t"] for r in m if r["releasing"]] == [4, 5, 7, 8]
    assert [r["t"] for r in m if r["gripper_changing"]] == [1, 2, 4, 5, 7, 8] and [r["t"] for r in m if r["still"]] == [0, 3, 6, 9]
    assert [r["t"] for r in m if r["is_first_grip"]] == [4]


def test_early_grips_by_hand(spark):
    truth = [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0]
    pred = [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    height = [0.0, 0.0, 0.3, 0.0, 0.1, 0.101, 0.0, 0.0, 0.1, 0.0]
    m = {r["t"]: r for r in evaluate.early_grip_metrics(closings(spark, pred, truth, height)).collect()}
    assert [t for t in m if m[t]["is_first_grip"]] == [4, 8]
    # At 4 the prediction two steps back was closed, 0.2 above; the next one is closed, so it is on time too.
    assert m[4]["early_gripped"] and m[4]["early_gripped_height_aware"] and m[4]["timestep_to_grip"] == 2 and m[4]["gripped_on_time"]
    assert math.isclose(m[4]["height_to_grip"], 0.2)
    # At 8 that three steps back was, only 0.001 above; neither this nor the next is closed.
    assert m[8]["early_gripped"] and not m[8]["early_gripped_height_aware"] and m[8]["timestep_to_grip"] == 3 and not m[8]["gripped_on_time"]
    assert all(not m[t]["early_gripped"] and m[t]["timestep_to_grip"] == 0 and m[t]["height_to_grip"] == 0 for t in m if t not in (4, 8))


def test_rephrasing_keeps_instructions_without_paraphrases(spark):
    rows = spark.createDataFrame([(i, t, x) for i, x in enumerate(["stay", "go", ""] * 30) for t in range(3)], "traj long, t int, language_instruction string")
    phrases = spark.createDataFrame([("go", "walk.run"), ("stay", "")], "instruction string, paraphrases string")
    got = relabel.rephrase(rows, phrases, 1.0).collect()
    assert {r["language_instruction"] for r in got if r["traj"] % 3 == 0} == {"stay"}
    assert {r["language_instruction"] for r in got if r["traj"] % 3 == 1} == {"go", "walk", "run"}
    assert {r["language_instruction"] for r in got if r["traj"] % 3 == 2} == {""}


def test_positions_at_rest_do_not_divide_by_zero(spark):
    rows = [(0, t, [1.0, 0.0], ([0.0, 0.0], 0.0, [0.0, 0.0]), "go") for t in range(8)]
    schema = "traj long, t int, action array<double>, observation struct<position: array<double>, yaw: double, state: array<double>>, language_instruction string"
    got = standardise.standardised(spark.createDataFrame(rows, schema), "gnm_dataset").collect()
    assert len(got) == 2 and all(math.isnan(x) for r in got for x in r["action"])


def test_split_by_text_and_by_large_numbers(spark):
    names = spark.createDataFrame([(f"episode-{i:03d}",) for i in range(40)], "traj string")
    got = {r["traj"]: r["split"] for r in mixture.split(names, "traj").collect()}
    assert [k for k in sorted(got) if got[k] == "val"] == ["episode-038", "episode-039"]
    large = spark.createDataFrame([(2**60 + i,) for i in range(40)], "traj long")
    got = {r["traj"]: r["split"] for r in mixture.split(large, "traj").collect()}
    assert [k - 2**60 for k in sorted(got) if got[k] == "val"] == [38, 39]


def test_depth_is_cut_to_its_first_channel(spark):
    schema = "traj long, t int, action array<double>, observation struct<depth: array<array<array<int>>>, depth_additional_view: array<array<array<int>>>, state: array<double>>, language_instruction string"
    image = [[[1, 9], [2, 9]], [[3, 9], [4, 9]]]
    rows = spark.createDataFrame([(0, 0, [0.5] * 10, (image, image, [0.0] * 8), "x")], schema)
    got = standardise.standardised(rows, f"nyu_franka_play_dataset{standardise.RLDS}").first()
    assert got["observation"]["depth"] == [[1.0, 2.0], [3.0, 4.0]] == got["observation"]["depth_additional_view"]


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    df = frame(spark, [x[:20].tolist(), x[20:].tolist()])
    near = {r["dim"]: r for r in statistics.statistics(df, "action").collect()}
    s = {r["dim"]: r for r in statistics.statistics(df, "action", exact=True).collect()}
    for d in range(3):
        assert near[d]["p01"] == x[:, d].min() and near[d]["p99"] == x[:, d].max()
        assert math.isclose(s[d]["std"], x[:, d].std(), rel_tol=1e-9)
        assert math.isclose(s[d]["p99"], np.quantile(x[:, d], 0.99), rel_tol=1e-9)
        assert (s[d]["num_transitions"], s[d]["num_trajectories"]) == (50, 2)
    parts = statistics.statistics(df, "action", ["traj"])
    both = {r["dim"]: r for r in statistics.combine(parts).collect()}
    assert all(math.isclose(both[d]["std"], x[:, d].std(), rel_tol=1e-9) and math.isclose(both[d]["mean"], x[:, d].mean(), abs_tol=1e-9) for d in range(3))


def test_statistics_cache(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return statistics.as_json(statistics.vectors_of(statistics.statistics(frame(spark, [[[1.0], [3.0]]]), "action")))

    first = statistics.cached(spark, str(tmp_path), ["a", "b"], compute)
    assert statistics.cached(spark, str(tmp_path), ["a", "b"], compute) == first
    assert first["action"]["mean"] == [2.0] and first["num_transitions"] == 2 and len(calls) == 1
    statistics.cached(spark, str(tmp_path), ["a", "b"], compute, force=True)
    assert len(calls) == 2
    (tmp_path / "file").write_text("no folder can be made under a file")
    for _ in range(2):  # kept in the other folder, and read from there
        assert statistics.cached(spark, str(tmp_path / "file" / "x"), ["c"], compute, fallback=str(tmp_path / "other")) == first
    assert len(calls) == 3


def test_normalise_and_back(spark):
    df = spark.createDataFrame([([1.0, 5.0], [0.5, 0.5], [2.0, 0.0], [True, False])], "v array<double>, m array<double>, s array<double>, k array<boolean>")
    z = V.normalize(F.col("v"), F.col("m"), F.col("s"), F.col("k"))
    r = df.select(z.alias("z"), V.unnormalize(z, F.col("m"), F.col("s"), F.col("k")).alias("b")).first()
    assert math.isclose(r["z"][0], 0.25, rel_tol=1e-6) and r["z"][1] == 5.0
    assert np.allclose(r["b"], [1.0, 5.0], atol=1e-6)


def test_errors(spark):
    df = frame(spark, [[[1.0, 2.0, 3.0]]])
    with pytest.raises(Exception, match="values where at most"):
        S.pad_vectors(df, 2).collect()
    with pytest.raises(ValueError, match="mask"):
        statistics.check_mask([True], 2)
    with pytest.raises(ValueError, match="no labels"):
        S.skip_unlabeled(df)
    with pytest.raises(ValueError, match="lacks"):
        standardise.standardised(df, "dobbe")
    with pytest.raises(ValueError, match="twice"):
        interleaved([Source("a", df), Source("a", df)], TrajectoryTransforms(), 1)
    with pytest.raises(ValueError, match="unknown kind"):
        statistics.normalized(df, df, "action", "other")
    with pytest.raises(ValueError, match="may not attend"):
        model.check_causal([("task", True, {"obs": "causal"}), ("obs", False, {})])
    with pytest.raises(ValueError, match="no view"):
        catalog.source_config("kuka", views=("above",))
    with pytest.raises(ValueError, match="mask"):
        single(Source("a", df, mask=(True,)), TrajectoryTransforms())
    with pytest.raises(ValueError):
        mixture.allocate(1, [0.5, 0.5])


def test_allocation():
    for n, w in ((48, [0.5, 0.3, 0.2]), (10, [0.97, 0.01, 0.01, 0.01]), (3, [1, 1, 1])):
        got = mixture.allocate(n, w)
        assert sum(got) == n and min(got) >= 1
    assert mixture.allocate(10, [0.98, 0.01, 0.01]) == [8, 1, 1] and mixture.allocate(10, [0.9, 0.1, 0.0]) == [9, 1, 0]


def test_allocation_of_rows_is_the_same(spark):
    for n, w in ((10, [0.98, 0.01, 0.01]), (10, [0.9, 0.1, 0.0]), (48, [0.5, 0.3, 0.2]), (7, [0.25, 0.25, 0.25, 0.25]), (9, [0.05, 0.1, 0.2, 0.3, 0.35])):
        rows = spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate(w)], "name string, sampling_weight double")
        assert [r["units"] for r in mixture.allocated(rows, n).orderBy("name").collect()] == mixture.allocate(n, w)


def test_catalogue():
    mixes = catalog.mixes()
    assert {k: len(v) for k, v in mixes.items()} == {"bridge": 1, "rtx": 11, "rtx_franka": 29, "oxe_magic_soup": 25, "oxe_flex_act_soup": 32, "full": 50}
    assert set(catalog.entries()) == set(standardise.SPECS)
    with pytest.warns(UserWarning):
        assert len(catalog.first_of_each(mixes["rtx_franka"])) == 25
    with pytest.raises(KeyError):
        catalog.mix_configs([("unknown", 1.0)])
    configs, weights = catalog.mix_configs("oxe_magic_soup", views=("primary", "wrist"))
    assert len(configs) == len(weights) == 25 and configs[1]["images"] == {"primary": "image", "wrist": None}
    with pytest.warns(UserWarning):
        assert catalog.mix_configs("bridge", views=("above",)) == ([], [])


def test_numbered_in_any_number_of_parts(spark):
    df = spark.range(100).withColumn("x", (F.col("id") * 37 % 10).cast("double"))
    want = None
    for parts in (1, 3, 16):
        got = [r["id"] for r in mixture.numbered(df, F.col("x"), ["id"], parts=parts).orderBy("rn").collect()]
        want = want or got
        assert got == want
    assert want == [r["id"] for r in df.orderBy("x", "id").collect()]


def test_split_is_whole(spark):
    df = spark.range(0, 200).withColumnRenamed("id", "traj")
    got = mixture.split(df, "traj").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 190, "val": 10}


#: A source row for each specification, with vectors of different values.
def _value(n, at=1.0):
    return [at + i / 10 for i in range(n)]


def _rows(spark, observation, action, more=None, n=6, numbers=("gripper", "yaw", "state_gripper_pose", "gripper_width", "open_gripper")):
    """A trajectory whose vectors grow with time."""
    scaled = lambda v, t: [x * (1 + t) for x in v] if isinstance(v, list) else v * (1 + t) if isinstance(v, float) else v
    rows = []
    for t in range(n):
        o = {k: scaled(v, t) for k, v in observation.items()}
        a = {k: scaled(v, t) for k, v in action.items()} if isinstance(action, dict) else scaled(action, t)
        rows.append({"traj": 1, "t": t, "observation": o, "action": a, "language_instruction": "say", **(more or {})})

    def kind(v):
        if isinstance(v, dict):
            return "struct<" + ",".join(f"`{k}`:{kind(x)}" for k, x in v.items()) + ">"
        return {list: "array<double>", float: "double", str: "string", bytes: "binary"}[type(v)]

    schema = ", ".join(f"{k} {'long' if k == 'traj' else 'int' if k == 't' else kind(v)}" for k, v in rows[0].items())
    return spark.createDataFrame(rows, schema)


G = {"gripper_closedness_action": [0.5], "world_vector": _value(3), "rotation_delta": _value(3, 2.0)}
CASES = {
    # name: (observation, action, the action wanted at t = 1, the state wanted at t = 1)
    "taco_play": ({"robot_obs": _value(8), "natural_language_instruction": "x"}, {"rel_actions_world": _value(7)}, [x * 2 for x in _value(7)[:6]] + [1.0], [x * 2 for x in _value(8)[:6] + _value(8)[7:8]]),
    "roboturk": ({"natural_language_instruction": "x"}, G, [x * 2 for x in _value(3) + _value(3, 2.0)] + [0.0], [0.0]),
    "stanford_hydra_dataset_converted_externally_to_rlds": ({"state": _value(12)}, _value(7), [x * 2 for x in _value(7)[:6]] + [1 - 3.2], [x * 2 for x in _value(12)[:3] + _value(12)[7:10] + _value(12)[-3:-2]]),
    "nyu_franka_play_dataset_converted_externally_to_rlds": ({"state": _value(13)}, _value(15), [x * 2 for x in _value(15)[-8:-2]] + [1.0], [x * 2 for x in _value(13)[-6:]]),
    "robo_net": ({"state": _value(5)}, _value(5), [x * 2 for x in _value(5)[:4]] + [0.0, 0.0] + [2.8], [x * 2 for x in _value(5)[:4]] + [0.0, 0.0] + [2.8]),
    "berkeley_fanuc_manipulation": ({"state": _value(8)}, _value(6), [x * 2 for x in _value(6)] + [1 - 3.2], [x * 2 for x in _value(7)]),
    "uiuc_d3field": ({}, _value(3), [x * 2 for x in _value(3)] + [0.0] * 4, [0.0]),
    "cmu_play_fusion": ({"state": _value(4)}, _value(9), [x * 2 for x in _value(9)[:3] + _value(9)[-4:]], [x * 2 for x in _value(4)]),
    "roboset": ({"state": _value(4)}, _value(8, -0.5), [x * 2 for x in _value(8, -0.5)[:7]] + [1 - 0.4], [x * 2 for x in _value(4)]),
    "rh20t": ({"tcp_base": _value(3), "gripper_width": 0.25}, {"tcp_base": _value(6), "gripper": 0.5}, [x * 2 for x in _value(6)] + [1.0], [x * 2 for x in _value(3)] + [0.5]),
    "mujoco_manip": ({}, _value(7), [x * 2 for x in _value(7)[:6]] + [1 - 3.2 / 255], None),
    "bc_z": (
        {"present/xyz": _value(3), "present/axis_angle": _value(3), "present/sensed_close": [0.5], "natural_language_instruction": "x"},
        {"future/xyz_residual": _value(30), "future/axis_angle_residual": _value(30), "future/target_close": _value(10)},
        [x * 2 for x in _value(3) + _value(3)] + [-1.0], [x * 2 for x in _value(3) + _value(3)] + [1.0],
    ),
}


@pytest.mark.parametrize("name", [*CASES])
def test_standard_form(spark, name):
    observation, action, want_action, want_state = CASES[name]
    df = _rows(spark, observation or {"none": 0.0}, action)
    r = standardise.standardised(df, name).where("t = 1").first()
    assert np.allclose(r["action"], want_action)
    if want_state is not None:
        assert np.allclose(r["proprio"], want_state)
    if standardise.SPECS[name].language == "blank":
        assert r["language_instruction"] == ""


def test_standard_quaternion_is_no_turn(spark):
    df = _rows(spark, {"state": _value(9)}, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0, 0.5], n=1)
    r = standardise.standardised(df, "furniture_bench_dataset_converted_externally_to_rlds").first()
    assert np.allclose(r["action"], [1, 2, 3, 0, 0, 0, 0.5])


def test_standard_strides(spark):
    df = _rows(spark, {"state": _value(2)}, _value(3), n=11)
    assert standardise.standardised(df, "aloha_static_dataset").orderBy("t").select("t").collect() == [(0,), (1,), (2,)]
    df = _rows(spark, {"joint_pos": _value(8), "gripper": 0.25}, _value(8), n=7)
    out = standardise.standardised(df, "berkeley_rpt_converted_externally_to_rlds").orderBy("t").collect()
    assert [r["t"] for r in out] == [0, 1] and np.allclose(out[0]["action"][:7], [x * 3 for x in _value(7)])


def test_inflated_state(spark):
    packed = zlib.compress(np.array(_value(7), dtype="<f4").tobytes())
    one = zlib.compress(np.array([0.5], dtype="<f4").tobytes())
    df = _rows(spark, {"clip_function_input/base_pose_tool_reached": packed, "gripper_closed": one}, G, n=2)
    r = standardise.standardised(df, "kuka").first()
    assert np.allclose(r["proprio"], _value(7) + [0.5]) and r["language_instruction"] == ""


def test_policy_batches(spark):
    df = spark.range(0, 10).repartition(1)

    def policy(batch):
        assert len(batch) == 4
        return pd.DataFrame({"id": batch["id"], "y": batch["id"] * 2})

    got = model.apply_policy(df, policy, 4, "id long, y long").collect()
    assert sorted((r["id"], r["y"]) for r in got) == [(i, 2 * i) for i in range(10)]


def test_streams_match_tables(spark, tmp_path):
    rows = [(k, t, float(10 * k + t), [float(k + t + j) for j in range(3)]) for k in range(3) for t in range(6)]
    df = spark.createDataFrame(rows, "traj long, t int, x double, chunk array<double>")
    folder = str(tmp_path / "in")
    df.where("t < 3").coalesce(1).write.parquet(f"{folder}/a")
    df.where("t >= 3").coalesce(1).write.parquet(f"{folder}/b")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    for name, streamed, batch in (
        ("history", control.history_stream(stream(), 4), control.history_batch(df, 4)),
        ("ensemble", control.ensemble_stream(stream(), 3, 0.1), control.ensemble_batch(df, 3, 0.1)),
    ):
        q = streamed.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, want = (sorted(map(tuple, x.collect())) for x in (spark.table(name), batch))
        assert len(got) == len(want) == 18
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2] and np.allclose(np.array(a[2], dtype=float), np.array(b[2], dtype=float))


def test_empty_table(spark):
    df = frame(spark, [])
    assert S.chunked(df.withColumn("state", F.col("action")), ["state"], 2, 3).count() == 0
    assert mixture.batches(df.select("traj", "t"), 4, 0, "traj", "t").count() == 0


def test_specifications_by_name(spark):
    given = specs.spec(S.stride, k=2)
    assert given == specs.spec("wayline.operators.steps:stride", k=2) == json.loads(json.dumps(given))
    assert specs.text_of(given) == "wayline.operators.steps:stride(k=2)" and specs.text_of(specs.spec(S.stride, 3, k=2)) == "wayline.operators.steps:stride(3, k=2)"
    df = spark.createDataFrame([(0, t) for t in range(5)], "traj long, t int")
    assert sorted(r["t"] for r in specs.instantiate(given)(df).collect()) == [0, 1, 2]
    for bad in ({"module": "os", "name": "system", "args": [], "kwargs": {}}, {"module": "wayline.operators.steps"}):
        with pytest.raises(ValueError):
            specs.instantiate(bad)
    with pytest.raises(ValueError):
        specs.spec("no colon")
    assert specs.formatted("{a}-{b_c}", {"a": 1, "b": {"c": "x"}}) == "1-x"


def test_hooks_and_normalisation_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "traj long, proprio array<double>").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("traj long, proprio array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, steps = [], []
    out = control.normalised(stream, {"mean": [1.0, 0.0], "std": [2.0, 1.0], "mask": [True, False]})
    control.hooked(out, [lambda b, k: seen.extend(b.collect()), lambda b, k: steps.append(k)], str(tmp_path / "c")).awaitTermination()
    assert steps == [0, 1] and {r["traj"]: round(r["proprio"][0], 5) for r in seen} == {i: round((i - 1) / 2, 5) for i in range(6)}
    assert {r["proprio"][1] for r in seen} == {1.0}
