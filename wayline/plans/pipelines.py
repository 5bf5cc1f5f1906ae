"""Whole pipelines of the operators, in the fixed order that they need."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.uniform import uniform
from wayline.operators import mixture, relabel, statistics, steps
from wayline.operators.skips import Skipped
from wayline.sources.shared import checkpointed


@dataclass(frozen=True)
class TrajectoryTransforms:
    """What happens to trajectories; the order is fixed: filters, masks, padding, goals, augmentation, chunks, subsample, the rest."""

    train: bool = True
    skip_unlabeled: bool = False
    max_action: float | None = None
    max_proprio: float | None = None
    max_action_dim: int | None = None
    max_proprio_dim: int | None = None
    goals: str | None = None
    goal_columns: Sequence[str] = ()
    most_ahead: int | None = None
    augment: Sequence[Callable[[DataFrame], DataFrame]] = ()
    window: int = 1
    horizon: int = 1
    observations: Sequence[str] = ()
    subsample: int | None = None
    after: Sequence[Callable[[DataFrame], DataFrame]] = ()
    seed: int = 0
    key: Sequence[str] = ("traj",)
    masked: Sequence[str] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.skip_unlabeled:
            df = steps.skip_unlabeled(df, key=self.key)
        if self.max_action is not None:
            df = steps.max_abs(df, "action", self.max_action, self.key)
        if self.max_proprio is not None:
            df = steps.max_abs(df, "proprio", self.max_proprio, self.key)
        if self.masked:
            df = df.withColumn("pad_mask_dict", steps.pad_mask(df, self.masked))
        df = steps.pad_vectors(df, self.max_action_dim, self.max_proprio_dim)
        if self.goals is not None:
            if self.goals != "uniform":
                raise ValueError(f"unknown goals: {self.goals}")
            df = relabel.relabel_goals(df, self.goal_columns, self.seed, self.most_ahead, self.key)
        if self.train:
            df = reduce(lambda d, f: f(d), self.augment, df)
        goal = "task_timestep" if "task_timestep" in df.columns else None
        df = steps.chunked(df, self.observations, self.window, self.horizon, goal=goal, key=self.key)
        if self.train and self.subsample is not None:
            df = steps.subsample(df, self.subsample, uniform("subsample", self.seed, *(F.col(k) for k in self.key), F.col("t")), self.key)
        return reduce(lambda d, f: f(d), self.after, df)


@dataclass(frozen=True)
class Source:
    """A named source: its steps, filters of raw steps, its standard form and how it is normalised.

    ``mask`` says which dimensions of the action are normalised; ``given`` may
    hold rows of ``statistics.vectors_of`` for ``action`` and ``proprio``;
    with ``skip_norm`` both stay as they are. ``bad`` is true of standard steps
    that cannot be used: their trajectories are skipped whole, and counted.
    """

    name: str
    steps: DataFrame
    filters: Sequence[Callable[[DataFrame], DataFrame]] = ()
    standard: Callable[[DataFrame], DataFrame] = lambda df: df
    kind: str = "normal"
    mask: Sequence[bool] | None = None
    weight: float = 1.0
    given: dict[str, DataFrame] = field(default_factory=dict)
    skip_norm: bool = False
    bad: Column | None = None

    def standard_steps(self) -> DataFrame:
        return self.standard(reduce(lambda d, f: f(d), self.filters, self.steps))


def single(source: Source, transforms: TrajectoryTransforms, split: str | None = None, skipped: Skipped | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Steps of one source, action and proprio (if it has one) normalised by the statistics of all of it, and these.

    Trajectories with steps that cannot be used count in ``skipped`` under the
    source's name, and in no statistic.
    """
    rows = source.standard_steps()
    if source.bad is not None:
        rows = (skipped or Skipped()).trajectories(rows, source.bad, source.name, transforms.key)
    stats = dict(source.given)
    for column in ("action", "proprio"):
        if column in rows.columns and column not in stats:
            stats[column] = statistics.vectors_of(statistics.statistics(rows, column, traj=transforms.key))
    if source.mask is not None:
        dims = stats["action"].select(F.size("mean")).first()
        statistics.check_mask(source.mask, dims[0] if dims and dims[0] >= 0 else len(source.mask))
    if split:
        rows = mixture.split(rows, transforms.key[0]).where(F.col("split") == split).drop("split")
    if not source.skip_norm:
        rows = statistics.normalized(rows, stats["action"], "action", source.kind, source.mask)
        if "proprio" in rows.columns:
            rows = statistics.normalized(rows, stats["proprio"], "proprio", source.kind)
    return transforms(rows), stats


def validation(source: Source, transforms: TrajectoryTransforms, train: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The held-out part of a source as ``single`` makes it, without augmentation or subsampling; with ``train`` the other part, with both."""
    return single(source, replace(transforms, train=train), "train" if train else "val")


def interleaved(sources: Sequence[Source], transforms: TrajectoryTransforms, n: int | None = None, balance: bool = True, seed: int = 0, skipped: Skipped | None = None) -> DataFrame:
    """n frames (by default those of an epoch) drawn from the sources by weight, each source normalised by its own statistics."""
    names = [s.name for s in sources]
    if len({*names}) < len(names):
        raise ValueError("a source is there twice")
    frames, numbers, sizes = [], [], []
    own = ["name", *transforms.key, "t"]
    for s in sources:
        rows, stats = single(s, transforms, skipped=skipped)
        frames.append(rows.withColumn("name", F.lit(s.name)))
        numbers.append(numbered_frames(rows.select(*own[1:]), s.name, transforms.key, seed))
        sizes.append(stats["action"].select(F.lit(s.name).alias("name"), F.lit(float(s.weight)).alias("weight"), F.col("num_transitions")))
    known = checkpointed(reduce(DataFrame.unionByName, sizes))  # a row a source, read twice
    n = mixture.expected_length(known) if n is None else n
    slots = mixture.interleaved(reduce(DataFrame.unionByName, numbers), mixture.balanced(known, balance), n, seed)
    return mixture.fetched(slots, reduce(DataFrame.unionByName, frames), own)


def numbered_frames(rows: DataFrame, name: str, key: Sequence[str], seed: int) -> DataFrame:
    u: Column = uniform("frame", seed, *(F.col(k) for k in key), F.col("t"))
    return mixture.numbered_by_draw(rows, u, (*key, "t"), "_rn").withColumns({"name": F.lit(name), "frame_no": F.col("_rn") - 1}).drop("_rn")
