"""PNG images by numpy: every bit depth and colour type, interlaced or not."""

from __future__ import annotations

import struct
import zlib

import numpy as np

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows, each told by the filter in its first byte; ``step`` bytes lie between a sample and the one before it."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(out.shape[1], dtype=np.int64)
    for y, line in enumerate(raw):
        how, x = int(line[0]), line[1:].astype(np.int64)
        if how == 1:
            whole = np.pad(x, (0, -len(x) % step)).reshape(-1, step)
            x = np.cumsum(whole, axis=0).reshape(-1)[: len(x)] & 255
        elif how == 2:
            x = (x + above) & 255
        elif how in (3, 4):
            left = corner = np.zeros(step, dtype=np.int64)
            for i in range(0, len(x), step):
                up = above[i : i + step]
                left, corner = left[: len(up)], corner[: len(up)]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                x[i : i + step] = left = (x[i : i + step] + guess) & 255
                corner = up
        elif how:
            raise ValueError("unknown filter of a row")
        out[y], above = x, x
    return out


def _samples(data: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    if depth == 16:
        v = data.reshape(len(data), -1, 2).astype(np.uint16)
        v = v[..., 0] << 8 | v[..., 1]
    elif depth == 8:
        v = data
    else:
        bits = np.unpackbits(data, axis=1)
        bits = bits[:, : bits.shape[1] // depth * depth].reshape(len(data), -1, depth)
        v = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    return v[:, : width * channels].reshape(len(data), width, channels)


def decode(b: bytes) -> tuple[np.ndarray, int]:
    """Height, width and channels (grey or colours, without transparency), and the greatest value that a sample can have."""
    at, parts, palette = 8, [], None
    width = height = depth = colour = interlace = 0
    while at < len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    channels = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8)
    step = max(1, depth * channels // 8)
    out = np.zeros((height, width, channels), dtype=np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = 1 + -(-w * depth * channels // 8)
        out[y0::dy, x0::dx] = _samples(_unfiltered(raw[at : at + h * line].reshape(h, line), step), w, depth, channels)
        at += h * line
    if colour == 3:
        return palette[out[..., 0]], 255
    return (out[..., : channels - 1] if colour in (4, 6) else out), (1 << depth) - 1
