"""Codecs against an independent encoder and decoder, resampling, colours, and frames in windows."""

from __future__ import annotations

import colorsys
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayline.functions import jpeg, png
from wayline.operators import images


def smooth(seed, h, w, c=3):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    waves = [128 + 60 * np.sin(x / rng.uniform(3, 9) + rng.uniform(0, 6)) + 60 * np.cos(y / rng.uniform(3, 9)) for _ in range(c)]
    return np.clip(np.stack(waves, axis=2) + rng.normal(0, 4, (h, w, c)), 0, 255).astype(np.uint8)


class Java:
    """The virtual machine's own image library."""

    def __init__(self, spark):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway

    def encode(self, x, form, progressive=False):
        h, w, c = x.shape
        kinds = self.jvm.java.awt.image.BufferedImage
        kind = kinds.TYPE_INT_RGB if c == 3 else kinds.TYPE_USHORT_GRAY if x.dtype == np.uint16 else kinds.TYPE_BYTE_GRAY
        image = self.jvm.java.awt.image.BufferedImage(w, h, kind)
        raster = image.getRaster()
        values = self.gateway.new_array(self.jvm.int, x.size)
        for i, v in enumerate(x.reshape(-1).tolist()):
            values[i] = v
        raster.setPixels(0, 0, w, h, values)
        out = self.jvm.java.io.ByteArrayOutputStream()
        writer = self.jvm.javax.imageio.ImageIO.getImageWritersByFormatName(form).next()
        how = writer.getDefaultWriteParam()
        if progressive:
            how.setProgressiveMode(self.jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
        stream = self.jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, self.jvm.javax.imageio.IIOImage(image, None, None), how)
        stream.flush()
        return bytes(out.toByteArray())

    def decode(self, b, shape):
        image = self.jvm.javax.imageio.ImageIO.read(self.jvm.java.io.ByteArrayInputStream(bytearray(b)))
        values = image.getRaster().getPixels(0, 0, shape[1], shape[0], self.gateway.new_array(self.jvm.int, int(np.prod(shape))))
        return np.array(list(values)).reshape(shape)


@pytest.fixture(scope="module")
def java(spark):
    return Java(spark)


@pytest.mark.parametrize("shape", [(16, 16, 3), (19, 21, 3), (9, 30, 1), (8, 8, 1), (1, 1, 3)])
def test_jpeg_within_one_level_of_another_decoder(java, shape):
    """Halved colour planes, edges that fill no block, and grey images."""
    b = java.encode(smooth(sum(shape), *shape), "jpeg")
    got, wanted = jpeg.decode(b).astype(int), java.decode(b, shape)
    assert got.shape == shape
    off = np.abs(got - wanted)
    assert off.max() <= 2 and (off > 1).mean() < 0.01


def test_jpeg_that_is_not_baseline(java):
    with pytest.raises(ValueError, match="baseline"):
        jpeg.decode(java.encode(smooth(1, 16, 16), "jpeg", progressive=True))


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 3, 3), (17, 20, 3), (13, 9, 1)])
def test_png_of_another_encoder(java, shape, interlaced):
    x = smooth(2, *shape)
    got, most = png.decode(java.encode(x, "png", interlaced))
    assert most == 255 and (got == x).all()


def test_depth_of_sixteen_bits(java):
    x = np.random.default_rng(3).integers(0, 1 << 16, (11, 7, 1)).astype(np.uint16)
    for interlaced in (False, True):
        b = java.encode(x, "png", interlaced)
        got, most = png.decode(b)
        assert most == 65_535 and (got == x).all()
        assert images.decode_depth(b) == pytest.approx(x[..., 0] / 65_535) and (images.decode(b) == x >> 8).all()
    assert images.decode_depth(b"P5\n1 1\n65535\n\x80\x00")[0, 0] == pytest.approx(32_768 / 65_535)


def plain_lanczos(xs, m):
    """One target at a time, from the definition."""
    kernel = lambda x: 1.0 if x == 0 else 0.0 if abs(x) >= 3 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2
    scale = len(xs) / m
    out = []
    for i in range(m):
        w = [kernel((j + 0.5 - (i + 0.5) * scale) / max(scale, 1)) for j in range(len(xs))]
        out.append(sum(a * b for a, b in zip(w, xs)) / sum(w))
    return out


def test_resampling():
    rng = np.random.default_rng(4)
    for n, m in ((7, 7), (12, 5), (5, 12), (3, 1)):
        xs = rng.uniform(0, 255, n)
        assert images.resampled(xs[:, None, None], m, 1)[:, 0, 0] == pytest.approx(plain_lanczos(xs.tolist(), m))
        assert images.resampled(xs[None, :, None], 1, m)[0, :, 0] == pytest.approx(plain_lanczos(xs.tolist(), m))
    # by hand: halving four equal pairs keeps an edge where it is, and overshoots beside it
    step = images.resampled(np.array([0.0] * 8 + [240.0] * 8)[:, None, None], 8, 1)[:, 0, 0]
    assert (step + step[::-1]) == pytest.approx(240.0) and step[2] < 0 < step[3] < 120 and abs(step[0]) < 3
    assert (images.resize(np.full((6, 8, 3), 9, dtype=np.uint8), 3, 2) == 9).all()
    flat = images.resize_depth(np.array([[0.0, 1.0], [0.0, 1.0]], dtype=np.float32), 2, 4)
    assert flat[0] == pytest.approx([0, 0.25, 0.75, 1]) and flat.dtype == np.float32


def test_boxes():
    x = np.arange(16, dtype=float).reshape(4, 4, 1)
    assert (images.crop_and_resize(x, (0, 0, 1, 1), 4, 4) == x).all()
    assert images.crop_and_resize(x, (0.25, 0.25, 0.75, 0.75), 2, 2)[..., 0] == pytest.approx(np.array([[3.75, 5.25], [9.75, 11.25]]))
    assert images.crop_and_resize(x, (0, 0, 1, 1), 1, 1)[0, 0, 0] == pytest.approx(7.5)
    image = smooth(5, 20, 30)
    assert (images.for_model(image, 10, 10, cropped=False) == images.resize(image, 10, 10)).all()
    edge = (1 - math.sqrt(0.9)) / 2
    mean = images.crop_and_resize(images.resampled(image, 10, 10), (edge, edge, 1 - edge, 1 - edge), 10, 10)
    assert (images.for_model(image, 10, 10) == np.clip(np.rint(mean), 0, 255)).all()


def test_colours_against_scalars():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.uniform(0, 1, (200, 3)), np.eye(3), np.zeros((1, 3)), np.ones((1, 3)), rng.choice([0.0, 0.5, 1.0], (60, 3))])
    hsv = images.to_hsv(x)
    assert hsv == pytest.approx(np.array([colorsys.rgb_to_hsv(*p) for p in x]))
    assert images.from_hsv(hsv) == pytest.approx(x)
    turned = np.stack([(hsv[:, 0] + 0.3) % 1, hsv[:, 1] * 0.5, hsv[:, 2]], axis=1)
    assert images.from_hsv(turned) == pytest.approx(np.array([colorsys.hsv_to_rgb(*p) for p in turned]))


ORDER = ["random_resized_crop", "random_brightness", "random_contrast", "random_saturation", "random_hue"]


def test_changes_of_nothing_change_nothing():
    none = {"random_resized_crop": {"scale": [1.0, 1.0], "ratio": [1.0, 1.0]}, "random_brightness": [0.0], "random_contrast": [1.0, 1.0], "random_saturation": [1.0, 1.0], "random_hue": [0.0]}
    image = smooth(7, 9, 12)
    assert np.abs(images.augment(image, ORDER, none, np.random.default_rng(0)).astype(int) - image).max() == 0
    grey = images.augment(image, ["random_saturation"], {"random_saturation": [0.0, 0.0]}, np.random.default_rng(0))
    assert (grey == image.max(axis=2, keepdims=True)).all()  # value stays when colour goes
    flat = images.augment(image, ["random_contrast"], {"random_contrast": [0.0, 0.0]}, np.random.default_rng(0))
    assert np.abs(flat - image.mean(axis=(0, 1))).max() <= 0.5


def pixmap(seed):
    return b"P6\n6 5\n255\n" + smooth(seed, 5, 6).tobytes()


def windows(spark, n=4, size=2):
    """Frames of one trajectory with the last ``size`` images of two cameras each."""
    blobs = [(pixmap(t), b"" if t == 2 else pixmap(50 + t)) for t in range(n)]
    rows = [(1, t, *([blobs[max(0, t - k)][c] for k in reversed(range(size))] for c in (0, 1)), blobs[t][0], [b"P5\n1 1\n255\n\x33"]) for t in range(n)]
    return spark.createDataFrame(rows, "traj long, t int, image_a array<binary>, image_b array<binary>, goal binary, depth_a array<binary>")


CHANGES = {"augment_order": ORDER, "random_resized_crop": {"scale": [0.7, 0.9], "ratio": [0.9, 1.1]}, "random_brightness": [0.2], "random_contrast": [0.8, 1.2], "random_saturation": [0.8, 1.2], "random_hue": [0.1]}


def test_windows_of_images(spark):
    df = windows(spark)
    run = lambda **k: images.window_transforms(df, ["image_a", "image_b"], {"goal": "image_a"}, changes=CHANGES, depths={"depth_a": (2, 2)}, **k).orderBy("t").collect()
    plain = run(train=False)
    assert [bytes(r["goal"]["data"]) for r in plain] == [pixmap(t)[11:] for t in range(4)]
    assert plain[2]["image_b"][1]["data"] == b"\0" * 3 and plain[3]["image_b"][0]["height"] == 1 and len(plain[0]["depth_a"][0]["data"]) == 4
    assert plain[0]["depth_a"][0]["data"] == pytest.approx([0.2] * 4)
    # one seed a frame: an image that stands twice in it, in the window and as its goal, is changed alike
    own = run()
    first = own[0]
    assert first["image_a"][0] == first["image_a"][1] == first["goal"] and bytes(first["goal"]["data"]) != pixmap(0)[11:]
    assert own[1]["image_a"][0]["data"] != first["image_a"][1]["data"] and own[3]["image_a"][1] == own[3]["goal"]
    assert run() == own and run(seed=1) != own
    # one seed a trajectory: a step has the same pixels in every window that holds it
    shared = run(key=("traj",))
    for a, b in zip(shared, shared[1:]):
        assert a["image_a"][1] == b["image_a"][0] and a["image_b"][1] == b["image_b"][0]


def test_dropping_before_augmenting(spark):
    df = windows(spark, 6)
    rows = images.window_transforms(df, ["image_a", "image_b"], sizes={"image_a": (3, 3), "image_b": (3, 3)}, changes={"image_a": CHANGES}, dropout=1.0, seed=5).collect()
    gone = lambda x: not any(x["data"])
    for r in rows:
        for a, b in zip(r["image_a"], r["image_b"]):
            assert gone(a) != gone(b) and a["height"] == b["width"] == 3  # one stays, whatever the share
    assert {gone(r["image_a"][1]) for r in rows} == {True, False}
    kept = images.window_transforms(df, ["image_a", "image_b"], dropout=1.0, always_keep="image_b").collect()
    assert all(gone(a) for r in kept for a in r["image_a"])
    with pytest.raises(Exception, match="no image image_c"):
        images.window_transforms(df, ["image_a"], always_keep="image_c").collect()
    assert images.window_transforms(df.limit(0), ["image_a"]).count() == 0
    assert images.window_transforms(df.withColumn("image_a", F.lit(None).cast("array<binary>")), ["image_a"]).where(F.size("image_a") == 0).count() == 6
