"""What surrounds a model and is relational: masks, losses, schedules, attention rules and configurations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import vectors as V


def masked_mean(x: Column, mask: Column) -> Column:
    """Aggregate: the mean of x times mask over the mean of the mask, this at least 1e-5."""
    m = mask.cast("double")
    return F.avg(x * m) / F.greatest(F.avg(m), F.lit(1e-5))


def loss(pred: Column, truth: Column, mask: Column, kind: str, dims: int) -> tuple[Column, Column]:
    """Aggregates: the masked loss, times the action's dimensions, and the masked squared error, likewise."""
    d = pred - truth
    each = {"mse": d * d, "l1": F.abs(d)}[kind]
    return masked_mean(each, mask) * dims, masked_mean(d * d, mask) * dims


def combined_mask(timestep_mask: Column, action_mask: Column) -> Column:
    """The action mask of a history where the history's step is there."""
    return F.zip_with(timestep_mask, action_mask, lambda t, rows: F.transform(rows, lambda row: F.transform(row, lambda m: m & t)))


def any_present(masks: Sequence[Column]) -> Column:
    """Whether any of the columns is there; true if none is asked."""
    out = F.lit(not masks)
    for m in masks:
        out = out | m
    return out


def cosine_betas(spark: SparkSession, steps: int, s: float = 0.008) -> DataFrame:
    """``i, beta, alpha, alpha_hat``: noise of a diffusion by a cosine, at most 0.999; ``alpha_hat`` is the product of the alphas so far."""
    rows, product = [], 1.0
    f = [math.cos((i / steps + s) / (1 + s) * math.pi / 2) ** 2 for i in range(steps + 1)]
    for i in range(steps):
        beta = min(max(1 - f[i + 1] / f[i], 0.0), 0.999)
        product *= 1 - beta
        rows.append((i, beta, 1 - beta, product))
    return spark.createDataFrame(rows, "i int, beta double, alpha double, alpha_hat double")


def noised(x: Column, noise: Column, alpha_hat: Column) -> Column:
    return F.zip_with(x, noise, lambda a, e: F.sqrt(alpha_hat) * a + F.sqrt(1 - alpha_hat) * e)


def learning_rate(step: Column, kind: str, peak: float, warmup: int, decay: int = 0, init: float = 0.0, end: float = 0.0) -> Column:
    """A linear rise, then a constant, a cosine down to ``end`` at step ``decay``, or the inverse root of the step."""
    up = F.lit(init) + (peak - init) * step / float(max(1, warmup))
    after = step - warmup
    if kind == "constant":
        then = F.lit(peak)
    elif kind == "cosine":
        share = F.least(after / float(max(1, decay - warmup)), F.lit(1.0))
        then = (F.cos(share * math.pi) + 1) * 0.5 * (peak - end) + end
    elif kind == "rsqrt":
        timescale = 10_000.0
        then = F.lit(peak) / F.sqrt((after + timescale) / timescale)
    else:
        raise ValueError(f"unknown schedule: {kind}")
    return F.when(step < warmup, up).otherwise(then)


RULES = ("never", "causal", "current", "strict_past", "all")


def rule_of(name: str, rules: dict[str, str]) -> str:
    """The rule of the first pattern that the name matches; ``never`` if none does."""
    return next((rule for pattern, rule in rules.items() if fnmatchcase(name, pattern)), "never")


def check_causal(tokens: Sequence[tuple[str, bool, dict[str, str]]]) -> None:
    """Groups ``name, is prefix, rules``: a prefix must not attend to a step's group, and no step's group to all of another."""
    for name, prefix, rules in tokens:
        for other, other_prefix, _ in tokens:
            rule = rule_of(other, rules)
            if prefix and not other_prefix and rule != "never" or not prefix and not other_prefix and rule == "all":
                raise ValueError(f"{name} may not attend to {other} by {rule}")


def attention(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """``from_pos, to_pos, attends`` for every pair of tokens ``pos, name, step, present``; a prefix has step -1.

    ``rules`` has ``name, other, rule`` for each pair of groups. A sequence's
    tokens are few: the pairs are the mask itself.
    """
    a = tokens.select(F.col("pos").alias("from_pos"), F.col("name"), F.col("step").alias("s"))
    b = tokens.select(F.col("pos").alias("to_pos"), F.col("name").alias("other"), F.col("step").alias("o"), "present")
    both = a.join(F.broadcast(rules), "name").join(b, "other")
    s, o, r = F.col("s"), F.col("o"), F.col("rule")
    may = F.when(r == "causal", o <= s).when(r == "current", o == s).when(r == "strict_past", o < s).otherwise(r == "all")
    return both.select("from_pos", "to_pos", (may & F.col("present")).alias("attends"))


def rule_frame(spark: SparkSession, groups: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(n, other, rule_of(other, rules)) for n, rules in groups.items() for other in groups]
    return spark.createDataFrame(rows, "name string, other string, rule string")


def config_rows(spark: SparkSession, config: dict, sep: str = ".") -> DataFrame:
    """``path, value`` of a nested configuration's leaves, values as text."""
    rows: list[tuple[str, str]] = []

    def walk(x, path):
        if isinstance(x, dict) and x:
            for k, v in x.items():
                walk(v, [*path, str(k)])
        else:
            rows.append((sep.join(path), repr(x)))

    walk(config, [])
    return spark.createDataFrame(rows, "path string, value string")


def config_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """``path, status, old_value, new_value`` of what was added, removed or changed."""
    n = new.select("path", F.col("value").alias("new_value"))
    o = old.select("path", F.col("value").alias("old_value"))
    both = n.join(o, "path", "full_outer")
    status = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed")
    return both.withColumn("status", status).where("status is not null").select("path", "status", "old_value", "new_value")


def merged(target: DataFrame, source: DataFrame) -> DataFrame:
    """``path, shape, value``: the source's values where it has the path in the same shape, else the target's; ``taken`` tells."""
    s = source.select("path", F.col("shape").alias("_shape"), F.col("value").alias("_value"))
    both = target.join(s, "path", "left")
    same = F.coalesce(F.col("shape") == F.col("_shape"), F.lit(False))
    return both.select("path", "shape", F.when(same, F.col("_value")).otherwise(F.col("value")).alias("value"), same.alias("taken"))


def tokenized(text: Column, max_length: int, vocabulary: int = 32_000) -> Column:
    """Struct ``input_ids, attention_mask`` of a text's words by hash, cut or filled up with zeros to a length; ids from 1."""
    words = F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), 1, max_length)
    ids = F.transform(words, lambda w: (F.crc32(w.cast("binary")) % (vocabulary - 1) + 1).cast("int"))

    def filled(x: Column) -> Column:
        rest = F.lit(max_length) - F.size(x)
        mask = F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), rest))
        return F.struct(F.concat(x, F.array_repeat(F.lit(0), rest)).alias("input_ids"), mask.alias("attention_mask"))

    return V.let(ids, filled)


def apply_policy(df: DataFrame, policy, size: int, schema: str) -> DataFrame:
    """Rows passed to a policy in batches of exactly ``size``, the last filled up with its own last row and the result cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True)
            while len(held) >= size:
                yield policy(held.iloc[:size].reset_index(drop=True))
                held = held.iloc[size:]
        if len(held):
            filled = pd.concat([held, *[held.iloc[-1:]] * (size - len(held))], ignore_index=True)
            yield policy(filled).iloc[: len(held)]

    return df.mapInPandas(run, schema)
