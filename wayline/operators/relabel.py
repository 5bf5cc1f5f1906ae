"""Seeded relabelling and augmentation: every draw depends on a key, so on neither partitioning nor order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.uniform import uniform
from wayline.operators import steps as S


def goal_index(u: Column, n: Column, most_ahead: int | None = None, t: Column | None = None) -> Column:
    """A step from this one on, at most ``most_ahead`` ahead, drawn by u and kept within the trajectory."""
    t = F.col("t") if t is None else t
    high = n if most_ahead is None else F.least(t + most_ahead, n)
    return F.least((t + F.floor(u * (high - t))).cast("int"), (n - 1).cast("int"))


def relabel_goals(df: DataFrame, columns: Sequence[str], seed: int = 0, most_ahead: int | None = None, key: S.Keys = S.KEY) -> DataFrame:
    """``task_<column>`` of a later step of the same trajectory, and ``task_timestep``, its time.

    Steps are numbered by ``t`` from 0. Each step fetches its goal's columns by
    trajectory and place, in a join; the lengths of trajectories come from a
    count. So no task or row holds more of a trajectory than the steps that
    fall to it, and what is not fetched does not move twice.
    """
    u = uniform("goal", seed, *(F.col(k) for k in key), F.col("t"))
    own = F.struct(*key)
    lengths = df.groupBy(own.alias("_own")).agg(F.count(F.lit(1)).alias("_n"))
    goals = df.select(F.struct(*key, F.col("t").cast("int").alias("t")).alias("_goal"), *(F.col(c).alias(f"task_{c}") for c in columns))
    there = goal_index(u, F.col("_n"), most_ahead)
    rows = df.drop("task_timestep", *(f"task_{c}" for c in columns)).withColumn("_own", own).join(lengths, "_own").withColumn("task_timestep", there)
    rows = rows.withColumn("_goal", F.struct(*key, F.col("task_timestep").alias("t"))).join(goals, "_goal", "left")
    return rows.select(*df.columns, "task_timestep", *(f"task_{c}" for c in columns))


def rephrase(df: DataFrame, phrases: DataFrame, prob: float, seed: int = 0, column: str = "language_instruction", key: S.Keys = S.KEY) -> DataFrame:
    """Instructions replaced by one of their paraphrases, or themselves.

    ``phrases`` holds ``instruction`` and ``paraphrases``, joined by full
    stops; the first step's instruction is looked up, and cut at full
    stops itself. Each step draws its own candidate, each trajectory whether it
    is rephrased at all; one with an empty instruction never is. The table is
    left to the optimiser to broadcast or shuffle.
    """
    first = F.first(column).over(S.whole(key))
    some_empty = F.bool_or(F.octet_length(column) == 0).over(S.whole(key))
    rows = df.withColumns({"_first": first, "_empty": some_empty})
    found = rows.join(phrases.select(F.col("instruction").alias("_first"), F.col("paraphrases").alias("_para")), "_first", "left")
    more = F.when(F.octet_length("_para") > 0, F.concat(F.lit("."), F.col("_para"))).otherwise("")
    options = F.split(F.concat(F.col("_first"), more), r"\.")
    pick = F.floor(uniform("phrase", seed, *(F.col(k) for k in key), F.col("t")) * F.size(options)).cast("int")
    coin = uniform("rephrase", seed, *(F.col(k) for k in key)) < prob
    return found.withColumn(column, F.when(coin & ~F.col("_empty"), F.get(options, pick)).otherwise(F.col(column))).select(*df.columns)


def delete_conditioning(df: DataFrame, images: Sequence[str], keep_image_prob: float, seed: int = 0, language: str = "language_instruction", key: S.Keys = S.KEY) -> DataFrame:
    """Each step keeps its goal images or its instruction, the other replaced by padding.

    Images stay by a coin, and where there is no instruction; ``task_timestep``
    is the goal's where they stay and the last step's where not.
    ``keep_images`` tells which, and so does ``pad_mask_dict``, where there is
    one. Without images or instruction nothing changes.
    """
    if language not in df.columns or not images:
        return df.withColumn("keep_images", F.lit(True))
    coin = uniform("delete", seed, *(F.col(k) for k in key), F.col("t")) < keep_image_prob
    out = df.withColumns({"keep_images": coin | (F.octet_length(language) == 0), "_last": (S.length(key) - 1).cast("int")})
    gone = {c: F.when(F.col("keep_images"), F.col(c)).otherwise(S.padding_of(df.schema[c].dataType)) for c in images}
    gone[language] = F.when(F.col("keep_images"), F.lit("")).otherwise(F.col(language))
    if "task_timestep" in df.columns:
        gone["task_timestep"] = F.when(F.col("keep_images"), F.col("task_timestep")).otherwise(F.col("_last"))
    gone |= _masked(df, {c: F.col("keep_images") for c in images} | {language: ~F.col("keep_images")})
    return out.withColumns(gone).drop("_last")


def _masked(df: DataFrame, stays: dict[str, Column]) -> dict[str, Column]:
    """``pad_mask_dict`` after some of its columns have stayed or gone, if there is one."""
    if "pad_mask_dict" not in df.columns:
        return {}
    own = [f.name for f in df.schema["pad_mask_dict"].dataType.fields]
    kept = ((F.col(f"pad_mask_dict.`{c}`") & stays[c] if c in stays else F.col(f"pad_mask_dict.`{c}`")).alias(c) for c in own)
    return {"pad_mask_dict": F.struct(*kept)}


def drop_images(df: DataFrame, images: Sequence[str], prob: float, seed: int = 0, always_keep: str | None = None, key: S.Keys = S.KEY) -> DataFrame:
    """Images replaced by padding, each by a coin; one that is there, drawn by the step, always stays. ``<image>_kept`` tells, and so does ``pad_mask_dict``, where there is one."""
    there = F.filter(F.array(*(F.when(F.octet_length(c) != 0, F.lit(c)) for c in images)), lambda x: x.isNotNull())
    own = [*(F.col(k) for k in key), F.col("t")]
    pick = F.get(there, F.floor(uniform("keep", seed, *own) * F.size(there)).cast("int"))
    out = df.withColumn("_keep", F.lit(always_keep) if always_keep else pick)
    for c in images:
        stays = (F.octet_length(c) != 0) & ((F.col("_keep") == c) | (uniform("drop", seed, F.lit(c), *own) >= prob))
        out = out.withColumn(f"{c}_kept", F.coalesce(stays, F.lit(False)))
    gone = {c: F.when(F.col(f"{c}_kept"), F.col(c)).otherwise(S.padding_of(df.schema[c].dataType)) for c in images}
    return out.withColumns(gone | _masked(df, {c: F.col(f"{c}_kept") for c in images})).drop("_keep")


def pick_column(columns: Sequence[str], seed: int, key: S.Keys = S.KEY) -> Column:
    """One of the columns by a draw of the trajectory; as the bound is exclusive twice, the last of several is never taken."""
    if not columns:
        raise ValueError("no column matches")
    place = F.floor(uniform("pick", seed, *(F.col(k) for k in key)) * max(1, len(columns) - 1)).cast("int")
    return F.get(F.array(*columns), place)


def modes(df: DataFrame, images: Sequence[str], language: str = "language_instruction") -> DataFrame:
    """Each row four times: as it is, with its text only, with its images only, and with neither."""
    out = df.withColumn("mode", F.explode(F.array(*(F.lit(m) for m in ("base", "text_conditioned", "image_conditioned", "unconditioned")))))
    no_text = F.col("mode").isin("image_conditioned", "unconditioned")
    no_image = F.col("mode").isin("text_conditioned", "unconditioned")
    gone = {c: F.when(no_image, S.padding_of(df.schema[c].dataType)).otherwise(F.col(c)) for c in images}
    return out.withColumns(gone | {language: F.when(no_text, F.lit("")).otherwise(F.col(language))})


# How each modality relabels goals and how often it keeps images.
MODALITIES = {
    "image_conditioned": {"goals": "uniform", "keep_image_prob": 1.0},
    "text_conditioned": {"goals": None, "keep_image_prob": 0.0},
    "multimodal": {"goals": "uniform", "keep_image_prob": 0.5},
}


def conditioned(df: DataFrame, modality: str, images: Sequence[str], seed: int = 0, most_ahead: int | None = None, key: S.Keys = S.KEY) -> DataFrame:
    """Goal images and instructions as a modality has them: goals relabelled where it says so, then one of the two kept."""
    how = MODALITIES[modality]
    if how["goals"]:
        df = relabel_goals(df, images, seed, most_ahead, key)
        df = df.drop(*images).withColumnsRenamed({f"task_{c}": c for c in images})
    return delete_conditioning(df, images, how["keep_image_prob"], seed, key=key)
