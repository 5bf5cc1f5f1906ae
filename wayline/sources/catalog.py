"""The catalogue of known sources and the named mixes of them."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ActionEncoding(Enum):
    """What an action's dimensions are; the value tells which of them are normalised."""

    EEF_POS = [True] * 6 + [False]
    JOINT_POS = [True] * 7 + [False]
    JOINT_POS_BIMANUAL = ([True] * 6 + [False]) * 2
    NAV_2D = [True] * 2
    JOINT_POS_BIMANUAL_NAV = ([True] * 6 + [False]) * 2 + [True] * 2


class ProprioEncoding(Enum):
    NONE = -1
    POS_EULER = 1
    POS_QUAT = 2
    JOINT = 3
    JOINT_BIMANUAL = 4
    POS_NAV = 5


VIEWS = ("primary", "secondary", "wrist")

# Source | columns of its primary, secondary and wrist images | of its depths | state encoding | action encoding.
SOURCES = """
fractal20220817_data | image - - | - - - | POS_QUAT | EEF_POS
kuka | image - - | - - - | POS_QUAT | EEF_POS
bridge_dataset | image_0 image_1 - | - - - | POS_EULER | EEF_POS
taco_play | rgb_static - rgb_gripper | depth_static - depth_gripper | POS_EULER | EEF_POS
jaco_play | image - image_wrist | - - - | POS_EULER | EEF_POS
berkeley_cable_routing | image top_image wrist45_image | - - - | JOINT | EEF_POS
roboturk | front_rgb - - | - - - | NONE | EEF_POS
nyu_door_opening_surprising_effectiveness | - - image | - - - | NONE | EEF_POS
viola | agentview_rgb - eye_in_hand_rgb | - - - | JOINT | EEF_POS
berkeley_autolab_ur5 | image - hand_image | depth - - | POS_QUAT | EEF_POS
toto | image - - | - - - | JOINT | EEF_POS
language_table | rgb - - | - - - | POS_EULER | EEF_POS
columbia_cairlab_pusht_real | image - wrist_image | - - - | POS_EULER | EEF_POS
stanford_kuka_multimodal_dataset_converted_externally_to_rlds | image - - | depth_image - - | POS_QUAT | EEF_POS
nyu_rot_dataset_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
stanford_hydra_dataset_converted_externally_to_rlds | image - wrist_image | - - - | POS_EULER | EEF_POS
austin_buds_dataset_converted_externally_to_rlds | image - wrist_image | - - - | JOINT | EEF_POS
nyu_franka_play_dataset_converted_externally_to_rlds | image image_additional_view - | depth depth_additional_view - | POS_EULER | EEF_POS
maniskill_dataset_converted_externally_to_rlds | image - wrist_image | depth - wrist_depth | POS_QUAT | EEF_POS
furniture_bench_dataset_converted_externally_to_rlds | image - wrist_image | - - - | POS_QUAT | EEF_POS
cmu_franka_exploration_dataset_converted_externally_to_rlds | highres_image - - | - - - | NONE | EEF_POS
ucsd_kitchen_dataset_converted_externally_to_rlds | image - - | - - - | JOINT | EEF_POS
ucsd_pick_and_place_dataset_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
austin_sailor_dataset_converted_externally_to_rlds | image - wrist_image | - - - | POS_QUAT | EEF_POS
austin_sirius_dataset_converted_externally_to_rlds | image - wrist_image | - - - | POS_QUAT | EEF_POS
bc_z | image - - | - - - | POS_EULER | EEF_POS
utokyo_pr2_opening_fridge_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
utokyo_xarm_pick_and_place_converted_externally_to_rlds | image image2 hand_image | - - - | POS_EULER | EEF_POS
utokyo_xarm_bimanual_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
robo_net | image image1 - | - - - | POS_EULER | EEF_POS
berkeley_mvp_converted_externally_to_rlds | - - hand_image | - - - | POS_QUAT | JOINT_POS
berkeley_rpt_converted_externally_to_rlds | - - hand_image | - - - | JOINT | JOINT_POS
kaist_nonprehensile_converted_externally_to_rlds | image - - | - - - | POS_QUAT | EEF_POS
stanford_mask_vit_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
tokyo_u_lsmo_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
dlr_sara_pour_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
dlr_sara_grid_clamp_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
dlr_edan_shared_control_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
asu_table_top_converted_externally_to_rlds | image - - | - - - | POS_EULER | EEF_POS
stanford_robocook_converted_externally_to_rlds | image_1 image_2 - | depth_1 depth_2 - | POS_EULER | EEF_POS
imperialcollege_sawyer_wrist_cam | image - wrist_image | - - - | NONE | EEF_POS
iamlab_cmu_pickup_insert_converted_externally_to_rlds | image - wrist_image | - - - | JOINT | EEF_POS
uiuc_d3field | image_1 image_2 - | depth_1 depth_2 - | NONE | EEF_POS
utaustin_mutex | image - wrist_image | - - - | JOINT | EEF_POS
berkeley_fanuc_manipulation | image - wrist_image | - - - | JOINT | EEF_POS
cmu_playing_with_food | image - finger_vision_1 | - - - | POS_EULER | EEF_POS
cmu_play_fusion | image - - | - - - | JOINT | EEF_POS
cmu_stretch | image - - | - - - | POS_EULER | EEF_POS
gnm_dataset | image - - | - - - | POS_NAV | NAV_2D
aloha_static_dataset | cam_high cam_low cam_right_wrist | - - - | JOINT_BIMANUAL | JOINT_POS_BIMANUAL
aloha_dagger_dataset | cam_high cam_low cam_right_wrist | - - - | JOINT_BIMANUAL | JOINT_POS_BIMANUAL
aloha_mobile_dataset | cam_high - cam_right_wrist | - - - | JOINT_BIMANUAL | JOINT_POS_BIMANUAL_NAV
fmb_dataset | image_side_1 image_side_2 image_wrist_1 | image_side_1_depth image_side_2_depth image_wrist_1_depth | POS_EULER | EEF_POS
dobbe | - - wrist_image | - - - | POS_EULER | EEF_POS
roboset | image_left image_right image_wrist | - - - | JOINT | JOINT_POS
rh20t | image_front image_side_right image_wrist | - - - | POS_EULER | EEF_POS
mujoco_manip | image - - | - - - | POS_EULER | EEF_POS
"""

# Each mix's sources with their weights.
MIXES = """
bridge:
bridge_dataset 1.0
rtx:
fractal20220817_data 0.54087122203
kuka 0.8341046294
bridge_dataset 1.0
taco_play 2.0
jaco_play 2.0
berkeley_cable_routing 3.0
roboturk 1.0
nyu_door_opening_surprising_effectiveness 5.0
viola 2.0
berkeley_autolab_ur5 1.0
toto 1.0
franka:
taco_play 1.0
berkeley_cable_routing 1.0
viola 1.0
toto 1.0
stanford_hydra_dataset_converted_externally_to_rlds 1.0
austin_buds_dataset_converted_externally_to_rlds 3.0
nyu_franka_play_dataset_converted_externally_to_rlds 3.0
maniskill_dataset_converted_externally_to_rlds 0.1
furniture_bench_dataset_converted_externally_to_rlds 0.1
cmu_franka_exploration_dataset_converted_externally_to_rlds 5.0
austin_sailor_dataset_converted_externally_to_rlds 1.0
austin_sirius_dataset_converted_externally_to_rlds 1.0
berkeley_rpt_converted_externally_to_rlds 1.0
kaist_nonprehensile_converted_externally_to_rlds 3.0
stanford_robocook_converted_externally_to_rlds 1.0
iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0
utaustin_mutex 1.0
cmu_play_fusion 1.0
oxe_magic_soup:
fractal20220817_data 0.54087122203
kuka 0.8341046294
bridge_dataset 1.0
taco_play 2.0
jaco_play 1.0
berkeley_cable_routing 1.0
roboturk 2.0
nyu_door_opening_surprising_effectiveness 1.0
viola 2.0
berkeley_autolab_ur5 2.0
toto 1.0
language_table 0.1
stanford_hydra_dataset_converted_externally_to_rlds 2.0
austin_buds_dataset_converted_externally_to_rlds 1.0
nyu_franka_play_dataset_converted_externally_to_rlds 3.0
furniture_bench_dataset_converted_externally_to_rlds 0.1
ucsd_kitchen_dataset_converted_externally_to_rlds 2.0
austin_sailor_dataset_converted_externally_to_rlds 1.0
austin_sirius_dataset_converted_externally_to_rlds 1.0
bc_z 0.2
dlr_edan_shared_control_converted_externally_to_rlds 1.0
iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0
utaustin_mutex 1.0
berkeley_fanuc_manipulation 2.0
cmu_stretch 1.0
oxe_flex_act_soup:
fractal20220817_data 0.54087122203
kuka 0.8341046294
bridge_dataset 1.0
taco_play 2.0
jaco_play 1.0
berkeley_cable_routing 1.0
roboturk 2.0
nyu_door_opening_surprising_effectiveness 1.0
viola 2.0
berkeley_autolab_ur5 2.0
toto 1.0
language_table 0.1
stanford_hydra_dataset_converted_externally_to_rlds 2.0
austin_buds_dataset_converted_externally_to_rlds 1.0
nyu_franka_play_dataset_converted_externally_to_rlds 3.0
furniture_bench_dataset_converted_externally_to_rlds 0.1
ucsd_kitchen_dataset_converted_externally_to_rlds 2.0
austin_sailor_dataset_converted_externally_to_rlds 1.0
austin_sirius_dataset_converted_externally_to_rlds 1.0
bc_z 0.2
berkeley_mvp_converted_externally_to_rlds 1.0
dlr_edan_shared_control_converted_externally_to_rlds 1.0
iamlab_cmu_pickup_insert_converted_externally_to_rlds 1.0
utaustin_mutex 1.0
berkeley_fanuc_manipulation 2.0
cmu_stretch 1.0
gnm_dataset 1.0
aloha_static_dataset 3.0
aloha_mobile_dataset 2.0
dobbe 1.0
roboset 0.5
rh20t 0.5
"""
#: The mix of all: every source up to this one in the catalogue, at weight 1.
FULL_UP_TO = "gnm_dataset"


def entries() -> dict[str, dict]:
    out = {}
    for line in SOURCES.strip().splitlines():
        name, images, depths, proprio, action = (x.strip() for x in line.split("|"))
        views = lambda text: dict(zip(VIEWS, (None if x == "-" else x for x in text.split()), strict=True))
        out[name] = {"images": views(images), "depths": views(depths), "proprio": ProprioEncoding[proprio], "action": ActionEncoding[action]}
    return out


def mixes() -> dict[str, list[tuple[str, float]]]:
    """Named mixes; ``rtx_franka`` is two of them, one after the other, with the sources both have twice."""
    out: dict[str, list[tuple[str, float]]] = {}
    for line in MIXES.strip().splitlines():
        if line.endswith(":"):
            own = out[line[:-1]] = []
        else:
            name, weight = line.split()
            own.append((name, float(weight)))
    out["rtx_franka"] = out["rtx"] + out.pop("franka")
    names = [*entries()]
    out["full"] = [(n, 1.0) for n in names[: names.index(FULL_UP_TO) + 1]]
    return out


def source_config(name: str, views: Sequence[str] = ("primary",), depth: bool = False, proprio: bool = False, language: bool = True) -> dict:
    """The columns that are wanted of a source, and which dimensions of its action are normalised.

    A view without a column is None and becomes padding; one that no source has is an error.
    """
    entry = entries()[name]
    if unknown := [v for v in views if v not in entry["images"]]:
        raise ValueError(f"{name} has no view {', '.join(unknown)}")
    out = {"name": name, "images": {v: entry["images"][v] for v in views}, "action_normalization_mask": entry["action"].value}
    if depth:
        out["depths"] = {v: entry["depths"][v] for v in views}
    if proprio:
        out["proprio_key"] = "proprio"
    if language:
        out["language_key"] = "language_instruction"
    return out


def first_of_each(mix: Iterable[tuple[str, float]]) -> list[tuple[str, float]]:
    """A mix without later entries of a source that it has already; it warns of these."""
    out: dict[str, float] = {}
    for name, weight in mix:
        if name in out:
            warnings.warn(f"{name} is in the mix twice; the first entry counts", stacklevel=2)
        else:
            out[name] = weight
    return [*out.items()]


def mix_configs(mix: str | Sequence[tuple[str, float]], **wanted) -> tuple[list[dict], list[float]]:
    """Configurations and weights of a mix's sources; with a warning those are skipped for which a view is unknown, and an unknown source is an error."""
    configs, weights = [], []
    for name, weight in first_of_each(mixes()[mix] if isinstance(mix, str) else mix):
        try:
            configs.append(source_config(name, **wanted))
            weights.append(weight)
        except ValueError as e:
            warnings.warn(f"skipped: {e}", stacklevel=2)
    return configs, weights


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (n, *(e["images"][v] for v in VIEWS), *(e["depths"][v] for v in VIEWS), e["proprio"].name, e["action"].name, len(e["action"].value))
        for n, e in entries().items()
    ]
    views = ", ".join(f"{k}_{v} string" for k in ("image", "depth") for v in VIEWS)
    return spark.createDataFrame(rows, f"name string, {views}, proprio_encoding string, action_encoding string, action_dim int")


def mix_frame(spark: SparkSession) -> DataFrame:
    rows = [(m, i, n, w) for m, own in mixes().items() for i, (n, w) in enumerate(own)]
    return spark.createDataFrame(rows, "mix string, pos int, name string, weight double")


def distinct_entries(mix: DataFrame) -> DataFrame:
    """The first entry of each source in each mix."""
    first = F.row_number().over(Window.partitionBy("mix", "name").orderBy("pos"))
    return mix.withColumn("_first", first).where("_first = 1").drop("_first")
