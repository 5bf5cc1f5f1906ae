"""Operators on steps: one row for each trajectory and time ``t`` from 0.

All windows of a trajectory share one partitioning and one order, so a chain
of these operators shuffles and sorts once. A trajectory must fit a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions import vectors as V

Keys = Sequence[str]
KEY: Keys = ("traj",)
#: From so many steps on, chunks are cut from collected windows instead of built from one neighbour at a time.
WIDE = 9


def by(key: Keys = KEY) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("t")


def whole(key: Keys = KEY) -> WindowSpec:
    return by(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_t(df: DataFrame, order: Sequence[str], key: Keys = KEY) -> DataFrame:
    """``t`` by a total order of each trajectory's rows."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("int"))


def length(key: Keys = KEY) -> Column:
    return F.count("*").over(Window.partitionBy(*key))


# -- filters --------------------------------------------------------------------------------------------------------


def keep_trajectories(df: DataFrame, holds: Column, how: str = "all", key: Keys = KEY) -> DataFrame:
    """The trajectories of which every step (or any) makes ``holds`` true; null counts as false."""
    f = F.bool_and if how == "all" else F.bool_or
    flag = f(F.coalesce(holds, F.lit(False))).over(Window.partitionBy(*key))
    return df.withColumn("_keep", flag).where("_keep").drop("_keep")


def skip_unlabeled(df: DataFrame, label: str = "language_instruction", key: Keys = KEY) -> DataFrame:
    """The trajectories with a label at some step; an error if there is no such column."""
    if label not in df.columns:
        raise ValueError(f"no labels to tell by: {label}")
    return keep_trajectories(df, F.col(label) != "", "any", key)


def max_abs(df: DataFrame, column: str, bound: float, key: Keys = KEY) -> DataFrame:
    """The trajectories whose vectors never leave the bounds; all of them if there is no such column."""
    if column not in df.columns:
        return df
    return keep_trajectories(df, F.forall(column, lambda x: F.abs(x) <= bound), "all", key)


def longer_than(df: DataFrame, n: int, key: Keys = KEY) -> DataFrame:
    return df.withColumn("_n", length(key)).where(F.col("_n") > n).drop("_n")


# -- padding --------------------------------------------------------------------------------------------------------


def padding_of(kind: T.DataType) -> Column:
    """What stands for a missing value of a type: zero, false or the empty text."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    raise ValueError(f"no padding for {kind.simpleString()}")


def pad_mask(df: DataFrame, columns: Sequence[str]) -> Column:
    """A struct of whether each column is there: a text or binary by its length in bytes, anything else always."""
    texts = (T.StringType, T.BinaryType)
    return F.struct(
        *(((F.octet_length(c) != 0) if isinstance(df.schema[c].dataType, texts) else F.lit(True)).alias(c) for c in columns)
    )


def pad_vectors(df: DataFrame, max_action_dim: int | None = None, max_proprio_dim: int | None = None, action: str = "action", proprio: str = "proprio") -> DataFrame:
    """Vectors filled up with zeros on the right, and ``action_pad_mask``, true for the dimensions that were there."""
    chunks = isinstance(df.schema[action].dataType.elementType, T.ArrayType)
    one = F.get(action, 0) if chunks else F.col(action)
    out = df.withColumn("action_pad_mask", F.transform(one, lambda _: F.lit(True)))
    if max_action_dim is not None:
        fill = F.array_repeat(F.lit(False), F.greatest(F.lit(max_action_dim) - F.size(one), F.lit(0)))
        padded = F.transform(action, lambda v: V.pad_right(v, max_action_dim)) if chunks else V.pad_right(F.col(action), max_action_dim)
        out = out.withColumn("action_pad_mask", F.concat("action_pad_mask", fill)).withColumn(action, padded)
    if max_proprio_dim is not None and proprio in df.columns:
        out = out.withColumn(proprio, V.pad_right(F.col(proprio), max_proprio_dim))
    return out


# -- windows --------------------------------------------------------------------------------------------------------


def history(column: str, size: int, key: Keys = KEY) -> Column:
    """The values of the last ``size`` steps, this one last; before the start its first value stands."""
    if size < WIDE:
        first = F.first(column).over(whole(key))
        back = [F.when(F.col("t") >= k, F.lag(column, k).over(by(key))).otherwise(first) for k in range(size - 1, 0, -1)]
        return F.array(*back, F.col(column))
    seen = F.collect_list(F.struct(column)).over(by(key).rowsBetween(-(size - 1), 0))
    return V.let(seen, lambda s: F.transform(F.concat(F.array_repeat(s[0], F.lit(size) - F.size(s)), s), lambda x: x[column]))


def history_mask(size: int) -> Column:
    return F.array(*(F.col("t") - (size - 1) + k >= 0 for k in range(size)))


def future(column: str, size: int, key: Keys = KEY) -> Column:
    """The values of ``size`` steps from this one on; after the end its last value stands."""
    if size < WIDE:
        last, n = F.last(column).over(whole(key)), length(key)
        ahead = [F.when(F.col("t") + k < n, F.lead(column, k).over(by(key))).otherwise(last) for k in range(1, size)]
        return F.array(F.col(column), *ahead)
    seen = F.collect_list(F.struct(column)).over(by(key).rowsBetween(0, size - 1))
    return V.let(seen, lambda s: F.transform(F.concat(s, F.array_repeat(F.element_at(s, -1), F.lit(size) - F.size(s))), lambda x: x[column]))


def first_of_chunk(column: str, size: int, chunk: Column) -> Column:
    """An existing chunk cut to ``size`` steps; an error if it has fewer."""
    return F.when(F.size(chunk) < size, F.raise_error(F.lit(f"{column}: chunks of fewer than {size} steps")).cast("array<array<double>>")).otherwise(F.slice(chunk, 1, size))


def chunked(df: DataFrame, observations: Sequence[str], window: int = 1, horizon: int = 1, action: str = "action", goal: str | None = None, key: Keys = KEY) -> DataFrame:
    """Observations as histories, the action as a history of futures, and their masks.

    An action that is made of chunks already (vectors of vectors) is cut to the
    horizon instead of chunked; chunks shorter than that are an error.

    ``task_completed`` compares the goal's time (that of the last step if no
    column gives it) with a time counted from ``window + 1`` steps back: so the
    end is seen two steps late, by definition. ``action_pad_mask`` holds for
    dimensions that are there, until the task is completed.
    """
    ready = isinstance(df.schema[action].dataType.elementType, T.ArrayType)
    n = length(key)
    out = df.withColumn("_goal", F.coalesce(F.col(goal), n - 1) if goal else n - 1)
    if "action_pad_mask" not in df.columns:
        out = out.withColumn("action_pad_mask", F.transform(F.col(action)[0] if ready else F.col(action), lambda _: F.lit(True)))
    out = out.withColumn("_future", first_of_chunk(action, horizon, F.col(action)) if ready else future(action, horizon, key))
    out = out.select("*", *(history(c, window, key).alias(f"_h_{c}") for c in (*observations, "_future")))
    done = F.array(*(F.array(*(F.col("_goal") - (F.col("t") - (window + 1) + w + h) <= 0 for h in range(horizon))) for w in range(window)))
    out = out.withColumns({"timestep_pad_mask": history_mask(window), "task_completed": done})
    out = out.withColumns({c: F.col(f"_h_{c}") for c in observations} | {action: F.col("_h__future")})
    mask = F.transform("task_completed", lambda row: F.transform(row, lambda d: F.transform("action_pad_mask", lambda m: m & ~d)))
    return out.withColumn("action_pad_mask", mask).drop("_goal", "_future", "_h__future", *(f"_h_{c}" for c in observations))


def over_history(df: DataFrame, f, observations: Sequence[str], tasks: Sequence[str] = ()) -> DataFrame:
    """A function of a value's column applied to every entry of the observations' histories, and to the tasks as they are."""
    return df.withColumns({c: F.transform(c, f) for c in observations} | {c: f(F.col(c)) for c in tasks})


def transposed(rows: Column, fields: Sequence[str]) -> Column:
    """A struct of arrays from an array of structs."""
    return F.struct(*(rows[c].alias(c) for c in fields))


def rollout(df: DataFrame, observations: Sequence[str], key: Keys = KEY) -> DataFrame:
    """What a policy is asked at each step of chunked trajectories: ``task_<c>``, the last step's last observation as the goal, and ``truth``, the step's own first action."""
    newest = lambda x: F.get(x, F.size(x) - 1)
    goals = {f"task_{c}": F.last(newest(F.col(c))).over(whole(key)) for c in observations}
    return df.withColumns(goals | {"truth": F.get(newest(F.col("action")), 0)})


def first_predictions(chunks: Column) -> Column:
    """Of each sampled chunk of actions the first action."""
    return F.transform(chunks, lambda chunk: F.get(chunk, 0))


def difference_ahead(column: str, key: Keys = KEY) -> Column:
    """The next step's vector less this one's; null at the last step."""
    return F.zip_with(F.lead(column).over(by(key)), F.col(column), lambda b, a: b - a)


def drop_last(df: DataFrame, key: Keys = KEY) -> DataFrame:
    return df.withColumn("_n", length(key)).where(F.col("t") < F.col("_n") - 1).drop("_n")


def stride(df: DataFrame, k: int) -> DataFrame:
    """Every k-th step, numbered anew."""
    return df.where(F.col("t") % k == 0).withColumn("t", (F.col("t") / k).cast("int"))


def rolled(df: DataFrame, wanted: dict[str, tuple[str, int]], key: Keys = KEY) -> DataFrame:
    """Columns, each of a name, a column and k: its value k steps before (after, for negative k), going around the ends.

    Neighbours come from the window; only the few values at the ends, which
    go around, are gathered, so a trajectory of n steps costs n.
    """
    most = max(abs(k) for _, k in wanted.values())
    columns = sorted({c for c, _ in wanted.values()})
    df = df.withColumn("_n", length(key))
    ends = {"_first": F.col("t") < most, "_last": F.col("t") >= F.col("_n") - most}
    df = df.withColumns({name: F.collect_list(F.when(near, F.struct("t", *columns))).over(whole(key)) for name, near in ends.items()})
    out = {}
    for name, (column, k) in wanted.items():
        there = F.pmod(F.col("t") - k, F.col("_n")).cast("int")
        around = F.get("_first", there) if k < 0 else F.get("_last", there - (F.col("_n") - F.size("_last")).cast("int"))
        beside = F.lag(column, k).over(by(key)) if k > 0 else F.lead(column, -k).over(by(key))
        out[name] = F.when((F.col("t") - k >= 0) & (F.col("t") - k < F.col("_n")), beside).otherwise(around[column])
    return df.withColumns(out).drop("_n", *ends)


def at_step(column: str, t: int, key: Keys = KEY) -> Column:
    """The trajectory's value at a step (-1: the last), for every step."""
    if t == 0:
        return F.first(column).over(whole(key))
    return F.last(column).over(whole(key)) if t == -1 else F.nth_value(column, t + 1).over(whole(key))


def to_end(key: Keys = KEY) -> Column:
    return length(key) - F.col("t")


def subsample(df: DataFrame, size: int, u: Column, key: Keys = KEY) -> DataFrame:
    """At most ``size`` steps of each trajectory, those of the least u."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(u, "t"))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def picked_steps(df: DataFrame, n: int, key: Keys = KEY) -> DataFrame:
    """n steps at even distances from the first to the last."""
    last = length(key) - 1
    df = df.withColumn("_last", last)
    wanted = F.array(*(F.floor(F.col("_last") * i / float(n - 1)).cast("int") for i in range(n)))
    return df.where(F.array_contains(wanted, F.col("t"))).drop("_last")


def nested(df: DataFrame, key: Keys = KEY) -> DataFrame:
    """A row for each trajectory with its steps in order."""
    rest = [c for c in df.columns if c not in (*key, "t")]
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", *rest))).alias("steps"))


def flattened(df: DataFrame) -> DataFrame:
    """A row for each step of nested trajectories."""
    rest = [c for c in df.columns if c != "steps"]
    return df.select(*rest, F.explode("steps").alias("_s")).select(*rest, "_s.*")


# -- grippers -------------------------------------------------------------------------------------------------------


def binarized_gripper(g: Column, key: Keys = KEY) -> Column:
    """1 above 0.95, 0 below 0.05, in between what the next decided step has; at an undecided end the last value as it is."""
    decided = F.when(g > 0.95, 1.0).when(g < 0.05, 0.0)
    after = by(key).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.first(decided, ignorenulls=True).over(after), F.last(g).over(whole(key)))


def open_or_closed(g: Column, key: Keys = KEY) -> Column:
    """0 if the first motion opens the gripper (above 1e-3), 1 if it closes it, then as moved; 0 without any motion."""
    moved = F.when(g > 1e-3, 0.0).when(g < -1e-3, 1.0)
    return F.coalesce(F.first(moved, ignorenulls=True).over(whole(key)), F.lit(0.0))


def absolute_gripper(g: Column, key: Keys = KEY) -> Column:
    """Openness from 0 to 1 by relative motions: below -0.1 opens, above 0.1 closes, else it stays; it starts opposite to the first motion, or open."""
    moved = F.when(g < -0.1, 1.0).when(g > 0.1, -1.0)
    so_far = F.last(moved, ignorenulls=True).over(by(key).rowsBetween(Window.unboundedPreceding, 0))
    at_first = F.coalesce(-F.first(moved, ignorenulls=True).over(whole(key)), F.lit(1.0))
    return F.coalesce(so_far, at_first) / 2 + 0.5


def inverted_gripper(g: Column) -> Column:
    return 1 - g


def relabelled_actions(df: DataFrame, action: str = "action", state: str = "state", key: Keys = KEY) -> DataFrame:
    """The first six dimensions replaced by the state's change to the next step; the last step goes."""
    change = F.slice(difference_ahead(state, key), 1, 6)
    out = df.withColumn("_n", length(key)).withColumn(action, F.concat(change, F.slice(action, -1, 1)))
    return out.where(F.col("t") < F.col("_n") - 1).drop("_n")


def sticky_gripper(df: DataFrame, wanted: str, patience: int, start: bool = False, out: str = "closed", key: Keys = KEY) -> DataFrame:
    """``out`` flips only when ``wanted`` has differed from it ``patience`` times in a row.

    A run of at least ``patience`` equal wishes settles the state from its
    ``patience``-th step on; shorter runs leave it as it is.
    """
    w = by(key)
    changed = F.coalesce((F.col(wanted) != F.lag(wanted).over(w)).cast("int"), F.lit(1))
    runs = df.withColumn("_run", F.sum(changed).over(w))
    place = F.row_number().over(Window.partitionBy(*key, "_run").orderBy("t"))
    settled = F.when(F.col("_place") >= patience, F.col(wanted))
    so_far = F.last(settled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("_place", place).withColumn(out, F.coalesce(so_far, F.lit(start))).drop("_run", "_place")
