"""Shards, image forms and their changes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayline.operators import images
from wayline.sources import files


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(number, content):
    return varint(number << 3 | 2) + varint(len(content)) + content


def example(features):
    entries = b""
    for name, values in features.items():
        if isinstance(values[0], bytes):
            kind = field(1, b"".join(field(1, v) for v in values))
        elif isinstance(values[0], float):
            kind = field(2, field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            kind = field(3, field(1, b"".join(varint(v % (1 << 64)) for v in values)))
        entries += field(1, field(1, name.encode()) + field(2, kind))
    return field(1, entries)


def test_shards(spark, tmp_path):
    rows = [{"steps/action": [0.5, -1.0], "steps/text": [b"go", b""], "id": [7, -3]}, {"id": [1]}]
    shard = b"".join(struct.pack("<Q", len(e)) + b"\0" * 4 + e + b"\0" * 4 for e in map(example, rows))
    (tmp_path / "a-train.tfrecord-00000-of-00001").write_bytes(shard)
    got = {(r["place"], r["name"]): r for r in files.read_records(spark, str(tmp_path)).collect()}
    assert got[0, "steps/action"]["floats"] == [0.5, -1.0]
    assert [bytes(x) for x in got[0, "steps/text"]["texts"]] == [b"go", b""]
    assert got[0, "id"]["ints"] == [7, -3] and got[1, "id"]["ints"] == [1]
    with pytest.raises(ValueError, match="within a record"):
        list(files.records(shard[:-3]))


def test_paths():
    assert files.path_of("s3://x/", "bridge:1.0.0") == "s3://x/bridge/1.0.0" and files.path_of("/d", "a") == "/d/a"


def png(image, filters):
    """Bytes of an RGB image with the given filter of each row."""
    h, w, _ = image.shape
    x = image.astype(int)
    raw = b""
    for y in range(h):
        left = np.pad(x[y], ((1, 0), (0, 0)))[:-1]
        up = x[y - 1] if y else np.zeros_like(x[0])
        corner = np.pad(up, ((1, 0), (0, 0)))[:-1]
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        row = x[y] - (0, left, up, (left + up) // 2, near)[filters[y]]
        raw += bytes([filters[y]]) + (row & 255).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark):
    image = np.random.default_rng(0).integers(0, 256, (5, 4, 3)).astype(np.uint8)
    encoded = png(image, [0, 1, 2, 3, 4])
    assert (images.decode(encoded) == image).all()
    pixmap = b"P6\n4 5\n255\n" + image.tobytes()
    assert (images.decode(pixmap) == image).all()
    assert images.resize(np.full((6, 8, 3), 9, dtype=np.uint8), 3, 2).tolist() == [[[9] * 3] * 2] * 3
    assert images.centre_crop(image, 0.5).shape == (2, 2, 3)
    df = spark.createDataFrame([(0, 0, encoded), (0, 1, b""), (0, 2, pixmap)], "traj long, t int, image_a binary")
    change = {"augment_order": ["random_resized_crop", "random_brightness", "random_contrast", "random_saturation", "random_hue"], "random_resized_crop": {"scale": [0.8, 1.0], "ratio": [0.9, 1.1]}, "random_brightness": [0.1], "random_contrast": [0.9, 1.1], "random_saturation": [0.9, 1.1], "random_hue": [0.05]}
    plain = [r["image_a"] for r in images.frame_transforms(df, ["image_a"], None, train=False).orderBy("t").collect()]
    assert bytes(plain[0]["data"]) == bytes(plain[2]["data"]) == image.tobytes() and bytes(plain[1]["data"]) == b"\0" * 3
    runs = [[bytes(r["image_a"]["data"]) for r in images.frame_transforms(df.repartition(n), ["image_a"], (4, 4), change, 1).orderBy("t").collect()] for n in (1, 3)]
    assert runs[0] == runs[1] and runs[0][0] != runs[0][2] and runs[0][1] == b"\0" * 48
    assert df.select(F.octet_length("image_a")).count() == 3
