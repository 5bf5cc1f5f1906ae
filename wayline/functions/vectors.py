"""Functions of numeric vectors, as columns of arrays of doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def vec(*values: Column | float) -> Column:
    return F.array(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def part(v: Column, start: int, stop: int | None = None, size: Column | None = None) -> Column:
    """``v[start:stop]`` with Python's meaning of negative bounds."""
    if start >= 0 and stop is not None and stop >= 0:
        return F.slice(v, start + 1, max(stop - start, 0))  # slices end where the vector does
    n = F.size(v) if size is None else size
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else n + stop
    return F.slice(v, lo + 1, F.greatest(hi - lo, F.lit(0)))


def item(v: Column, i: int) -> Column:
    """``v[i]``, null out of range."""
    return F.get(v, F.lit(i)) if i >= 0 else F.get(v, F.size(v) + i)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def each(v: Column, f) -> Column:
    return F.transform(v, f)


def pad_right(v: Column, n: int, value: float = 0.0) -> Column:
    """The vector with zeros up to n values; an error if it is longer."""
    long = F.size(v) > n
    return F.when(long, F.raise_error(F.format_string("%d values where at most %d may be", F.size(v), F.lit(n))).cast("array<double>")).otherwise(
        F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(v), F.lit(0))))
    )


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def angle(a: Column, b: Column) -> Column:
    """Angle between vectors, each divided by 1e-6 more than its length."""
    cosine = dot(a, b) / ((norm(a) + 1e-6) * (norm(b) + 1e-6))
    return F.acos(clip(cosine, -1.0, 1.0))


def argmax(v: Column) -> Column:
    """First place, from 0, of the greatest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == i).cast("double"))


def log_softmax(v: Column) -> Column:
    def body(x: Column) -> Column:
        top = F.array_max(x)
        return let(top + F.ln(total(F.transform(x, lambda y: F.exp(y - top)))), lambda z: F.transform(x, lambda y: y - z))

    return let(v, body)


def cross_entropy(logits: Column, target: Column) -> Column:
    return -F.get(log_softmax(logits), target)


def mish(x: Column) -> Column:
    return x * F.tanh(F.log1p(F.exp(x)))


def normalize(v: Column, mean: Column, std: Column, mask: Column | None = None) -> Column:
    """``(x - mean) / (std + 1e-8)`` where the mask holds."""
    z = F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), std, lambda d, s: d / (s + EPS))
    return masked(v, z, mask)


def normalize_bounds(v: Column, low: Column, high: Column, mask: Column | None = None) -> Column:
    """``clip(2 (x - low) / (high - low + 1e-8) - 1, -1, 1)`` where the mask holds."""
    z = F.zip_with(F.zip_with(v, low, lambda x, a: x - a), F.zip_with(high, low, lambda b, a: b - a + EPS), lambda d, w: clip(d * 2.0 / w - 1.0, -1, 1))
    return masked(v, z, mask)


def unnormalize(v: Column, mean: Column, std: Column, mask: Column | None = None) -> Column:
    z = F.zip_with(F.zip_with(v, std, lambda x, s: x * s), mean, lambda d, m: d + m)
    return masked(v, z, mask)


def unnormalize_bounds(v: Column, low: Column, high: Column, mask: Column | None = None) -> Column:
    z = F.zip_with(F.zip_with(v, F.zip_with(high, low, lambda b, a: b - a), lambda x, w: (x + 1.0) * w / 2.0), low, lambda d, a: d + a)
    return masked(v, z, mask)


def masked(v: Column, z: Column, mask: Column | None) -> Column:
    """Values of z where the mask holds, else of v; null where v has more values than the mask."""
    if mask is None:
        return z
    return F.zip_with(F.arrays_zip(v.alias("v"), z.alias("z")), mask, lambda p, m: F.when(m, p["z"]).otherwise(p["v"]))


def uniform_bins(x: Column, low: float, high: float, n: int) -> Column:
    """Number, from 0, of the bin of equal width that holds x, first clipped to 1e-6 within the bounds."""
    return F.floor((clip(x, low + 1e-6, high - 1e-6) - low) / (high - low) * n).cast("int")


def uniform_bin_centre(i: Column, low: float, high: float, n: int) -> Column:
    return (i + 0.5) * (high - low) / n + low


def normal_thresholds(n: int) -> list[float]:
    """Bounds of n bins that a standard normal variate falls into equally often."""
    lo, hi = 1e-6, 1 - 1e-6
    return [NormalDist().inv_cdf(lo + (hi - lo) * i / n) for i in range(n + 1)]


def normal_bins(x: Column, n: int) -> Column:
    """Number of the bin between quantiles of the normal distribution; 0 out of range."""
    bounds = F.array(*(F.lit(t) for t in normal_thresholds(n)))
    below = F.size(F.filter(bounds, lambda t: t <= x))
    return F.when((below < 1) | (below > n), 0).otherwise(below - 1).cast("int")


def euler_of_quaternion(q: Column) -> Column:
    """Roll, pitch and yaw of a quaternion x, y, z, w."""

    def body(v: Column) -> Column:
        x, y, z, w = (F.get(v, i) for i in range(4))
        roll = F.atan2((w * x + y * z) * 2.0, F.lit(1.0) - (x * x + y * y) * 2.0)
        pitch = F.asin(clip((w * y - z * x) * 2.0, -1, 1))
        yaw = F.atan2((w * z + x * y) * 2.0, F.lit(1.0) - (y * y + z * z) * 2.0)
        return vec(roll, pitch, yaw)

    return let(q, body)


def rotate(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """A plane vector in the frame turned by ``yaw``."""
    return dx * F.cos(yaw) + dy * F.sin(yaw), dy * F.cos(yaw) - dx * F.sin(yaw)


def fourier(x: Column, size: int) -> Column:
    """Cosines, then sines, of x times falling frequencies."""
    half = size // 2
    step = math.log(10000) / max(1, half - 1)
    waves = [x * math.exp(-i * step) for i in range(half)]
    return F.array(*(F.cos(w) for w in waves), *(F.sin(w) for w in waves))


def pixels(v: Column, kind: str = "default") -> Column:
    """Normalised 0 to 255 values: to -1 to 1, or by channel means and deviations for values of three channels in turn."""
    if kind == "default":
        return F.transform(v, lambda x: x / 127.5 - 1.0)
    mean, std = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)  # fixed values: of a common picture collection
    m, s = (F.array(*(F.lit(k) for k in ks)) for ks in (mean, std))
    return F.transform(v, lambda x, i: (x / 255.0 - F.get(m, i % 3)) / F.get(s, i % 3))


def chunks(v: Column, size: int) -> Column:
    """A flat vector as vectors of ``size`` values."""
    return F.transform(F.sequence(F.lit(0), (F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))


def every(v: Column, k: int) -> Column:
    """``v[::k]``"""
    return F.filter(v, lambda _, i: i % k == 0)


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
