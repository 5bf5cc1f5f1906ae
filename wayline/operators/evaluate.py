"""Metrics of predicted actions, and their conditional means.

Rows are steps with the predicted and the true vector (``pred``, ``truth``):
position change, rotation change and gripper; for some metrics also the
measured height. Metrics that look some steps back or ahead go around the
trajectory's ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import vectors as V
from wayline.operators import steps as S

# Each metric's name, the quantity it averages and the conditions under which it counts.
METRICS = {
    "mse": ("mse", ()),
    "xyz_angle": ("xyz_angle", ("moving",)),
    "xyz_angle_accuracy": ("xyz_angle_accuracy", ("moving",)),
    "xyz_accuracy": ("xyz_accuracy", ("moving",)),
    "gripping_accuracy": ("gripper_correct", ("gripper_changing",)),
    "gripping_accuracy_full": ("gripper_correct", ()),
}
# Metrics that need the measured height.
GRIP_METRICS = {
    "grip_height": ("height_to_grip", ("is_first_grip",)),
    "early_gripped": ("early_gripped", ("is_first_grip",)),
    "early_gripped_height_aware": ("early_gripped_height_aware", ("is_first_grip",)),
    "grip_timestep_early": ("timestep_to_grip", ("is_first_grip",)),
}
# The names of conditions by the distance to the end.
NEAR_END, FAR_FROM_END = "<10_to_end", ">20_to_end"


def squared_error(dims: Sequence[int]) -> Column:
    """Sum, not mean, over the dimensions."""
    return sum(((F.get("pred", i) - F.get("truth", i)) * (F.get("pred", i) - F.get("truth", i)) for i in dims), F.lit(0.0))


def step_metrics(df: DataFrame, dims: int = 7) -> DataFrame:
    """The metrics that look at one step alone."""
    p, q = F.slice("pred", 1, 3), F.slice("truth", 1, 3)
    closed = lambda c: F.get(c, dims - 1) > 0.5
    rows = df.withColumns(
        {
            "mse": squared_error(range(dims)),
            "mse_xyz": squared_error((0, 1, 2)),
            "mse_gripper": squared_error((dims - 1,)),
            "mse_xyzrotation": squared_error((3, 4, 5)),
            "xyz_angle": V.angle(p, q),
            "_np": V.norm(p),
            "_nq": V.norm(q),
            "closed_pred": closed("pred"),
            "closed_truth": closed("truth"),
        }
    )
    near = (F.col("_np") < F.col("_nq") * 2) & (F.col("_nq") < F.col("_np") * 2)
    return rows.withColumns(
        {
            "xyz_angle_accuracy": F.col("xyz_angle") < 0.5,
            "xyz_accuracy": (F.col("xyz_angle") < 0.5) & near,
            "gripper_correct": F.col("closed_pred") == F.col("closed_truth"),
            "moving": F.col("_nq") > 0.01,
        }
    ).drop("_np", "_nq")


def trajectory_metrics(df: DataFrame, key: S.Keys = S.KEY, around: int = 3) -> DataFrame:
    """Whether the gripper grips, releases, changes or rests, by its state now, some steps before and after; first grips; how near the end is.

    It grips where it is closed and was open before, or is open and will be
    closed; it releases the other way round, and may do both.
    """
    rolls = {"_before": ("closed_truth", around), "_after": ("closed_truth", -around), "_one": ("closed_truth", 1)}
    rows = S.rolled(df, rolls, key).withColumn("_left", S.to_end(key))
    now, before, after = F.col("closed_truth"), F.col("_before"), F.col("_after")
    gripping, releasing = (now & ~before) | (after & ~now), (before & ~now) | (now & ~after)
    return rows.withColumns(
        {
            "gripping": gripping,
            "releasing": releasing,
            "gripper_changing": gripping | releasing,
            "still": ~(gripping | releasing),
            "is_first_grip": now & ~F.col("_one"),
            NEAR_END: F.col("_left") < 10,
            FAR_FROM_END: F.col("_left") > 20,
        }
    ).drop("_before", "_after", "_one", "_left")


def early_grip_metrics(df: DataFrame, height: str = "height", back: int = 4, rise: float = 0.005, key: S.Keys = S.KEY) -> DataFrame:
    """At each first grip: whether a prediction some steps back was closed already, also only from more than ``rise`` above; how far back and above the farthest was; and whether this step's or the next one's is closed.

    At other steps all of them are false or zero.
    """
    ks = range(1, back + 1)
    rolls = {"_one": ("closed_truth", 1), "_next": ("closed_pred", -1)} | {f"_c{k}": ("closed_pred", k) for k in ks} | {f"_z{k}": (height, k) for k in ks}
    rows = S.rolled(df, rolls, key)
    first = F.col("closed_truth") & ~F.col("_one")
    above = {k: F.col(f"_z{k}") - F.col(height) for k in ks}
    any_of = lambda xs: F.exists(F.array(*xs), lambda x: x)
    to_grip = F.greatest(*(F.when(F.col(f"_c{k}"), F.lit(k)).otherwise(0) for k in ks))
    to_height = F.greatest(*(F.when(F.col(f"_c{k}"), F.greatest(above[k], F.lit(0.0))).otherwise(0.0) for k in ks))
    return rows.withColumns(
        {
            "is_first_grip": first,
            "early_gripped": first & any_of([F.col(f"_c{k}") for k in ks]),
            "early_gripped_height_aware": first & any_of([F.col(f"_c{k}") & (above[k] > rise) for k in ks]),
            "timestep_to_grip": F.when(first, to_grip).otherwise(0),
            "height_to_grip": F.when(first, to_height).otherwise(0.0),
            "gripped_on_time": first & (F.col("closed_pred") | F.col("_next")),
        }
    ).drop(*rolls)


def conditional_means(df: DataFrame, metrics: dict[str, tuple[str, Sequence[str]]] = METRICS, conditions: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    """``metric, condition, value`` (and the group): each quantity's mean over the steps where all its conditions hold; null over none.

    Each metric is told over ``all`` steps and over those of each further condition.

    All means are made in one pass; steps of all trajectories count alike.
    """
    out = []
    for name, (quantity, own) in metrics.items():
        for c in ("all", *conditions):
            where = [F.coalesce(F.col(f"`{x}`"), F.lit(False)) for x in (*own, *(() if c == "all" else (c,)))]
            x = F.col(quantity).cast("double")
            for w in where:
                x = F.when(w, x)
            out.append((name, c, F.avg(x)))
    sums = df.groupBy(*group).agg(*(m.alias(f"_{i}") for i, (_, _, m) in enumerate(out)))
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(c).alias("condition"), F.col(f"_{i}").alias("value")) for i, (n, c, _) in enumerate(out)))
    return sums.select(*group, F.explode(rows).alias("r")).select(*group, "r.*")


def mean_of_batch_means(df: DataFrame, value: str, batch: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Every batch counts alike, however many rows it has."""
    return df.groupBy(*group, *batch).agg(F.avg(value).alias("_m")).groupBy(*group).agg(F.avg("_m").alias(value))


def returns(df: DataFrame, reward: str = "reward", key: S.Keys = S.KEY) -> DataFrame:
    """``episode_return``, ``episode_length`` and ``best``, whether the greatest possible reward of 1 was reached, of each trajectory."""
    return df.groupBy(*key).agg(F.sum(reward).alias("episode_return"), F.count("*").alias("episode_length"), (F.max(reward) >= 1).alias("best"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin`` from 0 and ``n``; values out of range are not counted, the upper bound is in the last bin."""
    place = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def metric_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested metrics as rows ``name, value``; names of nested fields are joined by slashes."""
    flat = []

    def walk(kind, path):
        for f in kind.fields:
            if hasattr(f.dataType, "fields"):
                walk(f.dataType, [*path, f.name])
            else:
                flat.append([*path, f.name])

    walk(df.drop(*keys).schema, [])
    rows = F.array(*(F.struct(F.lit("/".join(p)).alias("name"), F.col(".".join(f"`{x}`" for x in p)).cast("double").alias("value")) for p in flat))
    return df.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.*")
