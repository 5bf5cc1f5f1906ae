"""Images in tasks: decoding, resizing and seeded augmentation of bytes, by numpy.

An image is the bytes of a portable pixmap (P6 or P5), a PNG or a baseline
JPEG; an empty binary stands for no image.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from wayline.functions import jpeg, png

IMAGE = "struct<height:int,width:int,channels:int,data:binary>"


def _read(b: bytes) -> tuple[np.ndarray, int]:
    """Samples, and the greatest value that one can have."""
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return png.decode(b)
    if b[:2] == b"\xff\xd8":
        return jpeg.decode(b), 255
    if b[:2] in (b"P6", b"P5"):
        parts, at = [], 2
        while len(parts) < 3:
            while b[at : at + 1].isspace():
                at += 1
            end = at
            while not b[end : end + 1].isspace():
                end += 1
            parts.append(int(b[at:end]))
            at = end
        width, height, most = parts
        samples = np.frombuffer(b, dtype=np.uint8 if most < 256 else ">u2", offset=at + 1)
        return samples.reshape(height, width, 3 if b[:2] == b"P6" else 1), most
    raise ValueError("not an image of a known form")


def decode(b: bytes) -> np.ndarray:
    """Height, width and channels of 8-bit samples; of deeper ones the upper bits, of shallower ones the same share of the whole."""
    x, most = _read(b)
    if most > 255:
        return (x >> (most.bit_length() - 8)).astype(np.uint8)
    return x if most == 255 else np.rint(x * (255 / most)).astype(np.uint8)


def decode_depth(b: bytes) -> np.ndarray:
    """Height and width of the first channel's samples, as 32-bit shares of the greatest value."""
    x, most = _read(b)
    return (x[..., 0] / np.float32(most)).astype(np.float32)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


def weights(n: int, m: int, kernel: Callable[[np.ndarray], np.ndarray] = _lanczos) -> np.ndarray:
    """What each of n samples gives to each of m: the kernel about the target's centre, as wide as a target where that is wider than a sample."""
    scale = n / m
    centre = (np.arange(m) + 0.5) * scale
    w = kernel((np.arange(n) + 0.5 - centre[:, None]) / max(scale, 1))
    return w / w.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, height: int, width: int, kernel: Callable[[np.ndarray], np.ndarray] = _lanczos) -> np.ndarray:
    """Samples at another size, down and then across, neither rounded nor bounded."""
    down, across = weights(x.shape[0], height, kernel), weights(x.shape[1], width, kernel)
    tall = np.tensordot(down, x.astype(float), (1, 0))
    return np.tensordot(across, tall, (1, 1)).swapaxes(0, 1)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """By a windowed sinc of three lobes; shrinking averages."""
    return _whole(resampled(image, height, width))


def resize_depth(depth: np.ndarray, height: int, width: int) -> np.ndarray:
    """By a triangle, which makes no values beyond those there are."""
    return resampled(depth, height, width, _triangle).astype(np.float32)


def crop_and_resize(x: np.ndarray, box: tuple[float, float, float, float], height: int, width: int) -> np.ndarray:
    """A box (top, left, bottom, right, as shares) at another size, each target between the four samples about it."""

    def places(low: float, high: float, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = low * (n - 1) + np.arange(m) * ((high - low) * (n - 1) / (m - 1)) if m > 1 else np.array([(low + high) / 2 * (n - 1)])
        at = np.clip(at, 0, n - 1)
        first = np.minimum(np.floor(at).astype(int), max(0, n - 2))
        return first, np.minimum(first + 1, n - 1), at - first

    y, y2, dy = places(box[0], box[2], x.shape[0], height)
    z, z2, dz = places(box[1], box[3], x.shape[1], width)
    dy, dz = dy[:, None, None], dz[None, :, None]
    x = x.astype(float)
    top = x[y][:, z] * (1 - dz) + x[y][:, z2] * dz
    bottom = x[y2][:, z] * (1 - dz) + x[y2][:, z2] * dz
    return top * (1 - dy) + bottom * dy


def _extent(scale: float, ratio: float) -> tuple[float, float]:
    """Height and width, as shares, of a crop of so much area and so wide for its height."""
    return min(1.0, float(np.sqrt(scale / ratio))), min(1.0, float(np.sqrt(scale * ratio)))


def for_model(image: np.ndarray, height: int, width: int, cropped: bool = True, scale: float = 0.9, ratio: float = 1.0) -> np.ndarray:
    """As a trained model expects an image: resized, and for one whose training cropped it at random, the mean crop about the centre."""
    x = resampled(image, height, width)
    if cropped:
        h, w = _extent(scale, ratio)
        x = crop_and_resize(x, ((1 - h) / 2, (1 - w) / 2, (1 + h) / 2, (1 + w) / 2), height, width)
    return _whole(x)


def centre_crop(image: np.ndarray, share: float) -> np.ndarray:
    h, w = image.shape[:2]
    ch, cw = max(1, round(h * share)), max(1, round(w * share))
    y, x = (h - ch) // 2, (w - cw) // 2
    return image[y : y + ch, x : x + cw]


def to_hsv(x: np.ndarray) -> np.ndarray:
    """Hue (a share of the circle), saturation and value of colours from 0 to 1."""
    most, least = x.max(axis=-1), x.min(axis=-1)
    spread = most - least
    r, g, b = np.moveaxis(x, -1, 0)
    safe = np.where(spread > 0, spread, 1)
    hue = np.select([spread == 0, most == r, most == g], [0.0, (g - b) / safe, (b - r) / safe + 2], (r - g) / safe + 4) / 6
    return np.stack([hue % 1.0, np.where(most > 0, spread / np.where(most > 0, most, 1), 0), most], axis=-1)


def from_hsv(x: np.ndarray) -> np.ndarray:
    hue, saturation, value = np.moveaxis(x, -1, 0)
    # each colour falls from the value by what the distance of its own hue takes
    off = np.array([5.0, 3.0, 1.0])
    k = (off + hue[..., None] * 6) % 6
    fall = np.clip(np.minimum(k, 4 - k), 0, 1)
    return value[..., None] * (1 - saturation[..., None] * fall)


def augment(image: np.ndarray, order: Sequence[str], options: dict, rng: np.random.Generator) -> np.ndarray:
    """The named changes in order, each drawn within its options; the size stays.

    Brightness is added, contrast stretches about each channel's mean,
    saturation is multiplied and hue turned in hue, saturation and value; colours
    are bounded after each change. Images of one channel keep their hue and
    saturation.
    """
    x = image.astype(float) / 255
    for name in order:
        o = options.get(name)
        if name == "random_resized_crop":
            h, w = _extent(rng.uniform(*o["scale"]), rng.uniform(*o["ratio"]))
            y, z = rng.uniform(0, 1 - h), rng.uniform(0, 1 - w)
            x = crop_and_resize(x, (y, z, y + h, z + w), *x.shape[:2])
        elif name == "random_brightness":
            x = x + rng.uniform(-o[0], o[0])
        elif name == "random_contrast":
            mean = x.mean(axis=(0, 1), keepdims=True)
            x = (x - mean) * rng.uniform(*o) + mean
        elif name in ("random_saturation", "random_hue"):
            change = rng.uniform(*o) if name == "random_saturation" else rng.uniform(-o[0], o[0])
            if x.shape[2] == 3:
                hsv = to_hsv(x)
                if name == "random_saturation":
                    hsv[..., 1] = np.clip(hsv[..., 1] * change, 0, 1)
                else:
                    hsv[..., 0] = (hsv[..., 0] + change) % 1.0
                x = from_hsv(hsv)
        else:
            raise ValueError(f"unknown change: {name}")
        x = np.clip(x, 0, 1)
    return np.rint(x * 255).astype(np.uint8)


def decoded(content: Column, size: tuple[int, int] | None = None, augmentation: dict | None = None, seed: Column | None = None) -> Column:
    """Struct of an image's samples, resized and augmented; no image becomes zeros of the size, or one pixel.

    ``augmentation`` has ``augment_order`` and the options by name; draws depend
    on the text of ``seed`` alone. Missing images are not augmented.
    """
    order = (augmentation or {}).get("augment_order", ())

    @pandas_udf(IMAGE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, seeds in batches:
            rows = []
            for b, s in zip(blobs, seeds, strict=True):
                if not b:
                    image = np.zeros((*(size or (1, 1)), 3), dtype=np.uint8)
                else:
                    image = decode(bytes(b))
                    image = resize(image, *size) if size else image
                    if order:
                        image = augment(image, order, augmentation, np.random.default_rng(int(hashlib.md5(s.encode()).hexdigest()[:8], 16)))
                rows.append((*image.shape, image.tobytes()))
            yield pd.DataFrame(rows, columns=["height", "width", "channels", "data"])

    return run(content, (seed if seed is not None else F.lit("")).cast("string"))


def frame_transforms(df: DataFrame, images: Sequence[str], size: tuple[int, int] | None, augmentation: dict | None = None, seed: int = 0, train: bool = True, key: Sequence[str] = ("traj", "t")) -> DataFrame:
    """Every image column decoded and, in training, augmented, each by a seed of its own."""
    out = {c: decoded(F.col(c), size, augmentation if train else None, F.concat_ws(":", F.lit(seed), F.lit(c), *key)) for c in images}
    return df.withColumns(out)


DEPTH = "struct<height:int,width:int,data:array<float>>"


def _rng(seed: str, *parts: int) -> np.random.Generator:
    return np.random.default_rng([int(hashlib.md5(seed.encode()).hexdigest()[:8], 16), *parts])


def observed(blobs: dict[str, bytes | None], sizes: dict[str, tuple[int, int]], seed: str, changes: dict[str, dict], dropout: float = 0.0, always_keep: str | None = None) -> dict[str, np.ndarray]:
    """One observation's images: decoded and resized, some dropped, the others augmented.

    Images are dropped independently, but one of those that are there, drawn by
    the seed, always stays (or the one named). Each image is augmented by the
    seed and its place among the names; missing and dropped ones are zeros.
    """
    names = sorted(blobs)
    if always_keep is not None and always_keep not in names:
        raise ValueError(f"no image {always_keep}: {', '.join(names)}")
    there = [n for n in names if blobs[n]]
    draws = _rng(seed, 0)
    first, lots = draws.random(), draws.random(len(names))
    stays = always_keep if always_keep is not None else there[int(first * len(there))] if there else None
    out = {}
    for k, n in enumerate(names):
        if not blobs[n] or not (n == stays or lots[k] >= dropout):
            size = sizes.get(n)
            if size is None and blobs[n]:
                size = decode(bytes(blobs[n])).shape[:2]
            out[n] = np.zeros((*(size or (1, 1)), 3), dtype=np.uint8)
            continue
        x = decode(bytes(blobs[n]))
        x = resize(x, *sizes[n]) if n in sizes else x
        out[n] = augment(x, changes[n].get("augment_order", ()), changes[n], _rng(seed, 1, k)) if n in changes else x
    return out


def window_transforms(
    df: DataFrame, images: Sequence[str], tasks: dict[str, str] | None = None, sizes: dict[str, tuple[int, int]] | None = None, changes: dict | None = None, dropout: float = 0.0, always_keep: str | None = None,
    depths: dict[str, tuple[int, int] | None] | None = None, seed: int = 0, train: bool = True, key: Sequence[str] = ("traj", "t"),
) -> DataFrame:
    """Frames whose image columns hold a window of images each, and task columns one image, in one pass.

    A frame has one seed, of its key, for every step of its window and for its
    task: so an image is changed alike wherever in the frame it stands. With the
    trajectory alone as key, frames too share one, and a step has the same
    pixels in every window that holds it. ``tasks`` names the image that each
    task column goes with; ``changes`` holds options for all images, or for each
    by name (others stay as they are). Images are dropped before the others are
    augmented. Depth columns, windows too, become shares of the greatest value.
    """
    tasks, sizes, depths = tasks or {}, sizes or {}, depths or {}
    changes = {} if not train or not changes else {n: changes for n in images} if "augment_order" in changes else changes
    share = dropout if train else 0.0
    picture = T.StructType.fromDDL("height int, width int, channels int, data binary")
    deep = T.StructType.fromDDL("height int, width int, data array<float>")
    kinds = {n: T.ArrayType(picture) for n in images} | {c: picture for c in tasks} | {c: T.ArrayType(deep) for c in depths}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in df.schema.fields])
    text = F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in key))
    columns = df.columns

    def told(x: np.ndarray) -> dict:
        return {"height": x.shape[0], "width": x.shape[1], "channels": x.shape[2], "data": x.tobytes()}

    def told_depth(b: bytes | None, size: tuple[int, int] | None) -> dict:
        x = decode_depth(bytes(b)) if b else np.zeros(size or (1, 1), dtype=np.float32)
        x = resize_depth(x, *size) if b and size else x
        return {"height": x.shape[0], "width": x.shape[1], "data": x.reshape(-1).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a frame at a time: decoded images are large
                row = batch.slice(i, 1)
                own = {c: row[c][0].as_py() for c in kinds}
                s = row["_seed"][0].as_py()
                done: dict[str, object] = {}
                steps = max((len(own[n] or ()) for n in images), default=0)
                window = [observed({n: (own[n] or [None] * steps)[w] for n in images}, sizes, s, changes, share, always_keep) for w in range(steps)]
                done |= {n: [told(x[n]) for x in window] for n in images}
                if tasks:
                    goal = {n: None for n in images} | {n: own[c] for c, n in tasks.items()}
                    goal = observed(goal, sizes, s, changes, share, always_keep)
                    done |= {c: told(goal[n]) for c, n in tasks.items()}
                done |= {c: [told_depth(b, size) for b in own[c] or ()] for c, size in depths.items()}
                yield pa.RecordBatch.from_arrays([pa.array([done[c]], to_arrow_type(kinds[c])) if c in kinds else row[c] for c in columns], columns)

    return df.withColumn("_seed", text).select(*columns, "_seed").mapInArrow(run, schema)
