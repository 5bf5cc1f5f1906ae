"""Standard form of many sources, each by a short specification of its columns.

A specification names, in terms of the source's own columns, the action, the
state (``proprio``) and what becomes of the instruction; steps that thin out or
drop rows are named beside it. Rows are steps: ``traj, t`` and the source's
columns. A part of a vector is written as a slice, parts are put together
with ``+``.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.functions import vectors as V
from wayline.operators import steps as S
from wayline.operators.relabel import pick_column


class Vec:
    """A vector column that is sliced and put together as a list is."""

    def __init__(self, col: Column):
        self.col = col

    def __getitem__(self, s: slice) -> Vec:
        if s.step:
            return Vec(V.every(self.col, s.step))
        return Vec(V.part(self.col, s.start or 0, s.stop))

    def __add__(self, other: Vec) -> Vec:
        return Vec(F.concat(self.col, other.col))

    def zeros(self) -> Vec:
        """As many zeros as there are values."""
        return Vec(F.array_repeat(F.lit(0.0), F.size(self.col)))

    def map(self, f: Callable[[Column], Column]) -> Vec:
        return Vec(F.transform(self.col, f))


def vec(path: str) -> Vec:
    """A column of numbers; a single number is a vector of one."""
    name = ".".join(f"`{p}`" for p in path.split("."))
    return Vec(F.col(name).cast("array<double>"))


def num(path: str) -> Vec:
    return Vec(F.array(F.col(".".join(f"`{p}`" for p in path.split("."))).cast("double")))


def zero(n: int) -> Vec:
    return Vec(V.zeros(n))


def one(n: int) -> Vec:
    return Vec(F.array_repeat(F.lit(1.0), n))


def inverted(v: Vec) -> Vec:
    return v.map(lambda x: 1 - x)


def clipped(v: Vec) -> Vec:
    return v.map(lambda x: V.clip(x, 0, 1))


def euler(v: Vec) -> Vec:
    return Vec(V.euler_of_quaternion(v.col))


def binarized(v: Vec) -> Vec:
    return Vec(F.array(S.binarized_gripper(F.get(v.col, 0))))


def absolute(v: Vec) -> Vec:
    return Vec(F.array(S.absolute_gripper(F.get(v.col, 0))))


@dataclass(frozen=True)
class Spec:
    """``action`` and ``proprio`` make vectors (None: as it is, or none); ``language`` is ``keep``, ``blank`` or a column's name."""

    action: Callable[[], Vec] | None = None
    proprio: Callable[[], Vec] | None = None
    language: str = "keep"
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None


A = lambda: vec("action")
O = lambda name: vec(f"observation.{name}")  # noqa: E731, E741
STATE = lambda: O("state")
GRIPPER = "action.gripper_closedness_action"
SPOKEN = "observation.natural_language_instruction"
MOVE = lambda: vec("action.world_vector") + vec("action.rotation_delta")
SOFT = lambda k=6: A()[:k] + inverted(clipped(A()[-1:]))
FIRST_OUT = lambda: A()[:-1]


def inflated(values: Column, width: int) -> Column:
    """Vectors of 32-bit numbers from their compressed bytes."""

    @pandas_udf("array<double>")
    def inflate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for blobs in batches:
            yield pd.Series([None if b is None else np.frombuffer(zlib.decompress(b), dtype="<f4").astype(float)[:width] for b in blobs], dtype=object)

    return inflate(values)


def spoken_from_codes(codes: Column) -> Column:
    """Text of code points up to the first zero."""
    zero_at = F.array_position(codes, F.lit(0)).cast("int")
    own = F.slice(codes, F.lit(1), F.when(zero_at > 0, zero_at - 1).otherwise(F.size(codes)))
    return F.decode(F.unhex(F.array_join(F.transform(own, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


def _relabelled(df: DataFrame) -> DataFrame:
    return S.relabelled_actions(df.withColumn("_state", vec("observation.state").col), state="_state").drop("_state")


def _joint_steps(df: DataFrame) -> DataFrame:
    ahead = S.difference_ahead("_joints")
    rows = df.withColumn("_joints", V.part(vec("observation.joint_pos").col, 0, 7)).withColumn("_ahead", ahead)
    rows = rows.withColumn("action", F.concat("_ahead", F.transform(V.part(F.col("action").cast("array<double>"), -1), lambda x: 1 - x)))
    return S.drop_last(rows).drop("_joints", "_ahead")


def _plane_start(df: DataFrame) -> DataFrame:
    """Trajectories of two steps or more, every third step, with the scale of the first action to the first move: infinite if that is none, NaN if the action is none too."""
    df = S.longer_than(df, 1).withColumns({"_p": vec("observation.position").col, "_a": vec("action").col})
    first, move = V.norm(S.at_step("_a", 0)), F.sqrt(V.squared_distance(S.at_step("_p", 1), S.at_step("_p", 0)))
    scale = F.when(move > 0, F.try_divide(first, move)).when(first > 0, float("inf")).otherwise(float("nan"))
    return S.stride(df.withColumn("_scale", scale).drop("_p", "_a"), 3)


def _plane_end(df: DataFrame) -> DataFrame:
    rows = df.withColumn("_p", vec("observation.position").col).withColumn("_d", S.difference_ahead("_p"))
    x, y = V.rotate(F.get("_d", 0), F.get("_d", 1), F.col("observation.yaw").cast("double"))
    return S.drop_last(rows.withColumn("action", F.array(x * F.col("_scale"), y * F.col("_scale")))).drop("_p", "_d", "_scale")


def _first_channel(df: DataFrame, *names: str) -> DataFrame:
    """Depths that are rows of points of channels, cut to rows of their first channel; others stay."""
    own = df.schema["observation"].dataType
    out = F.col("observation")
    for name in names:
        if name in own.fieldNames() and own[name].dataType.simpleString().startswith("array<array<array<"):
            cut = F.transform(F.col(f"observation.`{name}`"), lambda row: F.transform(row, lambda point: F.get(point, 0).cast("float")))
            out = out.withField(f"`{name}`", cut)
    return df.withColumn("observation", out)


def _inflate_state(df: DataFrame) -> DataFrame:
    return df.withColumns({"_pose": inflated(F.col("observation.`clip_function_input/base_pose_tool_reached`"), 7), "_closed": inflated(F.col("observation.gripper_closed"), 1)})


RLDS = "_converted_externally_to_rlds"
SPECS: dict[str, Spec] = {
    "bridge_dataset": Spec(lambda: A()[:6] + binarized(A()[-1:]), STATE, after=_relabelled),
    "fractal20220817_data": Spec(lambda: MOVE() + absolute(vec(GRIPPER)), lambda: O("base_pose_tool_reached") + O("gripper_closed"), SPOKEN),
    "kuka": Spec(lambda: MOVE() + absolute(vec(GRIPPER)), lambda: vec("_pose") + vec("_closed"), "blank", before=_inflate_state, after=lambda df: df.drop("_pose", "_closed")),
    "taco_play": Spec(lambda: vec("action.rel_actions_world")[:6] + clipped(vec("action.rel_actions_world")[-1:]), lambda: O("robot_obs")[:6] + O("robot_obs")[7:8], SPOKEN),
    "jaco_play": Spec(lambda: vec("action.world_vector") + zero(3) + absolute(vec(GRIPPER)), lambda: O("end_effector_cartesian_pos"), SPOKEN),
    "berkeley_cable_routing": Spec(lambda: MOVE() + zero(1), lambda: O("robot_state"), "blank"),
    "roboturk": Spec(lambda: MOVE() + inverted(clipped(vec(GRIPPER))), lambda: zero(1), "blank"),
    "nyu_door_opening_surprising_effectiveness": Spec(lambda: MOVE() + absolute(vec(GRIPPER)), lambda: zero(1), "blank"),
    "viola": Spec(lambda: MOVE() + inverted(clipped(num(GRIPPER))), lambda: O("joint_states") + O("gripper_states"), "blank"),
    "berkeley_autolab_ur5": Spec(
        lambda: MOVE() + absolute(num(GRIPPER)), lambda: O("robot_state")[6:14], SPOKEN,
        after=lambda df: df.withColumn("observation", F.col("observation").withField("depth", F.col("observation.image_with_depth")).dropFields("image_with_depth")),
    ),
    "toto": Spec(lambda: MOVE() + num("action.open_gripper"), STATE, "blank"),
    "language_table": Spec(
        lambda: A() + A().zeros() + A().zeros() + one(1), lambda: O("effector_translation"),
        after=lambda df: df.withColumn("language_instruction", spoken_from_codes(F.col("observation.instruction"))),
    ),
    "columbia_cairlab_pusht_real": Spec(lambda: MOVE() + num(GRIPPER), lambda: O("robot_state"), SPOKEN),
    f"stanford_kuka_multimodal_dataset{RLDS}": Spec(lambda: A()[:3] + zero(3) + A()[-1:], lambda: O("ee_position") + O("ee_orientation"), after=lambda df: _first_channel(df, "depth_image")),
    f"nyu_rot_dataset{RLDS}": Spec(lambda: A()[:7], STATE),
    f"stanford_hydra_dataset{RLDS}": Spec(lambda: A()[:6] + inverted(A()[-1:]), lambda: STATE()[:3] + STATE()[7:10] + STATE()[-3:-2], "blank"),
    f"austin_buds_dataset{RLDS}": Spec(SOFT, lambda: STATE()[:8], "blank"),
    f"nyu_franka_play_dataset{RLDS}": Spec(lambda: A()[-8:-2] + clipped(A()[-2:-1]), lambda: STATE()[-6:], "blank", after=lambda df: _first_channel(df, "depth", "depth_additional_view")),
    f"maniskill_dataset{RLDS}": Spec(None, lambda: O("tcp_pose") + STATE()[7:8]),
    f"furniture_bench_dataset{RLDS}": Spec(lambda: A()[:3] + euler(A()[3:7]) + inverted(clipped(A()[-1:])), lambda: STATE()[:7] + STATE()[-1:]),
    f"cmu_franka_exploration_dataset{RLDS}": Spec(FIRST_OUT, lambda: zero(1)),
    f"ucsd_kitchen_dataset{RLDS}": Spec(FIRST_OUT, lambda: STATE()[:7]),
    f"ucsd_pick_and_place_dataset{RLDS}": Spec(lambda: A()[:3] + zero(3) + A()[-1:], STATE),
    f"austin_sailor_dataset{RLDS}": Spec(SOFT, STATE, "blank"),
    f"austin_sirius_dataset{RLDS}": Spec(SOFT, STATE, "blank"),
    "bc_z": Spec(
        lambda: vec("action.future/xyz_residual")[:3] + vec("action.future/axis_angle_residual")[:3] + inverted(vec("action.future/target_close")[:1]),
        lambda: O("present/xyz") + O("present/axis_angle") + O("present/sensed_close"), SPOKEN,
    ),
    f"utokyo_pr2_opening_fridge{RLDS}": Spec(FIRST_OUT, STATE),
    f"utokyo_pr2_tabletop_manipulation{RLDS}": Spec(FIRST_OUT, STATE),
    f"utokyo_xarm_pick_and_place{RLDS}": Spec(),
    f"utokyo_xarm_bimanual{RLDS}": Spec(lambda: A()[-7:], lambda: O("end_effector_pose")),
    "robo_net": Spec(lambda: A()[:4] + zero(2) + A()[-1:], lambda: STATE()[:4] + zero(2) + STATE()[-1:]),
    f"berkeley_mvp{RLDS}": Spec(lambda: FIRST_OUT() + inverted(A()[-1:]), lambda: O("pose") + num("observation.gripper")),
    f"berkeley_rpt{RLDS}": Spec(None, lambda: O("joint_pos") + num("observation.gripper"), before=lambda df: S.stride(df, 3), after=_joint_steps),
    f"kaist_nonprehensile{RLDS}": Spec(lambda: A()[:6] + zero(1), lambda: STATE()[-7:]),
    f"stanford_mask_vit{RLDS}": Spec(lambda: A()[:4] + zero(2) + A()[-1:], lambda: O("end_effector_pose")[:4] + zero(2) + O("end_effector_pose")[-1:]),
    f"tokyo_u_lsmo{RLDS}": Spec(None, lambda: STATE()[:6] + STATE()[-1:]),
    f"dlr_sara_pour{RLDS}": Spec(None, STATE),
    f"dlr_sara_grid_clamp{RLDS}": Spec(None, lambda: STATE()[:6]),
    f"dlr_edan_shared_control{RLDS}": Spec(lambda: A()[:6] + inverted(A()[-1:]), STATE),
    f"asu_table_top{RLDS}": Spec(None, lambda: vec("ground_truth_states.EE") + STATE()[-1:]),
    f"stanford_robocook{RLDS}": Spec(None, STATE),
    "imperialcollege_sawyer_wrist_cam": Spec(FIRST_OUT, lambda: zero(1)),
    f"iamlab_cmu_pickup_insert{RLDS}": Spec(lambda: A()[:3] + euler(A()[3:7]) + A()[7:8], lambda: STATE()[:7] + STATE()[7:8]),
    "uiuc_d3field": Spec(lambda: A() + A().zeros() + zero(1), lambda: zero(1)),
    "utaustin_mutex": Spec(SOFT, lambda: STATE()[:8], "blank"),
    "berkeley_fanuc_manipulation": Spec(lambda: A() + inverted(STATE()[6:7]), lambda: STATE()[:6] + STATE()[6:7]),
    "cmu_playing_with_food": Spec(lambda: A()[:3] + euler(A()[3:7]) + A()[-1:], STATE),
    "cmu_play_fusion": Spec(lambda: A()[:3] + A()[-4:], STATE),
    "cmu_stretch": Spec(FIRST_OUT, lambda: STATE()[:3] + zero(3) + STATE()[-1:]),
    "gnm_dataset": Spec(None, STATE, before=_plane_start, after=_plane_end),
    "aloha_static_dataset": Spec(None, STATE, before=lambda df: S.stride(df, 5)),
    "aloha_dagger_dataset": Spec(None, STATE, before=lambda df: S.stride(df, 5)),
    "aloha_mobile_dataset": Spec(None, STATE, before=lambda df: S.stride(df, 5)),
    "fmb_dataset": Spec(None, lambda: O("eef_pose") + num("observation.state_gripper_pose")),
    "dobbe": Spec(None, STATE),
    "roboset": Spec(lambda: SOFT(7), STATE),
    "rh20t": Spec(lambda: vec("action.tcp_base") + num("action.gripper"), lambda: O("tcp_base") + num("observation.gripper_width")),
    "mujoco_manip": Spec(lambda: A()[:6] + inverted(A()[-1:].map(lambda x: x / 255))),
}


def standardised(df: DataFrame, name: str) -> DataFrame:
    """Steps of a source in standard form: ``action``, ``proprio`` if it has a state, ``language_instruction``; other columns stay.

    Required are ``traj, t, observation`` and ``action``. Columns the
    specification needs and the source lacks are an error of analysis.
    """
    if missing := {"observation", "action"} - set(df.columns):
        raise ValueError(f"{name}: lacks {', '.join(sorted(missing))}")
    spec = SPECS[name]
    if spec.before:
        df = spec.before(df)
    out: dict[str, Column] = {}
    if spec.proprio:
        out["proprio"] = spec.proprio().col
    if spec.action:
        out["action"] = spec.action().col
    if spec.language == "blank":
        out["language_instruction"] = F.lit("")
    elif spec.language != "keep":
        out["language_instruction"] = F.col(spec.language)
    df = df.withColumns(out) if out else df
    return spec.after(df) if spec.after else df


def restructured(df: DataFrame, name: str, images: dict[str, str | None] | None = None, depths: dict[str, str | None] | None = None, proprio: bool = False, language: str | None = "language_instruction", seed: int = 0) -> DataFrame:
    """Standard steps: ``dataset_name, traj, t``, ``image_*`` and ``depth_*`` (empty where a view is None), ``proprio``, ``timestep``, ``language_instruction``, ``action``.

    ``language`` names the column of instructions; of several that match it as a pattern each trajectory draws one. It must be text.
    """
    rows = standardised(df, name)
    views = [(f"{kind}_{new}", old) for kind, own in (("image", images), ("depth", depths)) for new, old in (own or {}).items()]
    cols = [(F.lit(b"") if old is None else F.col(f"observation.`{old}`").cast("binary")).alias(new) for new, old in views]
    if proprio:
        cols.append(F.col("proprio").cast("array<double>"))
    if language:
        own = fnmatch.filter(rows.columns, language)
        if bad := [c for c in own if rows.schema[c].dataType.simpleString() != "string"]:
            raise ValueError(f"{', '.join(bad)} must be text")
        cols.append(pick_column(own, seed).alias("language_instruction"))
    return rows.select(F.lit(name).alias("dataset_name"), "traj", "t", F.col("t").alias("timestep"), *cols, F.col("action").cast("array<double>").alias("action"))
