"""Baseline JPEG images by numpy.

The entropy-coded bits are read symbol by symbol; the rest (dequantisation,
inverse cosine transform, upsampling of halved colour planes by a triangle
filter, conversion from luminance and colour differences) is done on whole
planes. Progressive and arithmetic-coded images, and samples of other than 8
bits, are errors.
"""

from __future__ import annotations

import numpy as np

_COSINE = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


def _zigzag() -> np.ndarray:
    """Places of coefficients in the order in which they are stored: along diagonals, to and fro."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


_ORDER = _zigzag()


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits that may come: the length of the code they begin with, and its symbol."""
    out = [(0, 0)] * (1 << 16)
    code = k = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [(length, symbols[k])] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of an entropy-coded stretch, without the zeros stuffed in after 255."""

    def __init__(self, b: bytes):
        self.b, self.at, self.held, self.n = b.replace(b"\xff\x00", b"\xff") + bytes(64), 0, 0, 0

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 32:
            self.held = (self.held << 64) | int.from_bytes(self.b[self.at : self.at + 8].ljust(8, b"\0"))
            self.at, self.n = self.at + 8, self.n + 64
        length, value = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not length:
            raise ValueError("no such code")
        self.n -= length
        self.held &= (1 << self.n) - 1
        return value

    def number(self, size: int) -> int:
        """A signed number of so many bits; those with a first bit of 0 are below zero."""
        if not size:
            return 0
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


def _widened(x: np.ndarray) -> np.ndarray:
    """Twice as many columns, each three parts of the nearer and one of the other neighbour."""
    before, after = np.pad(x, ((0, 0), (1, 0)), mode="edge")[:, :-1], np.pad(x, ((0, 0), (0, 1)), mode="edge")[:, 1:]
    return np.stack([3 * x + before, 3 * x + after], axis=2).reshape(len(x), -1) / 4


def _upsampled(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    if down == 2:
        plane = _widened(plane.T).T
    elif down > 1:
        plane = plane.repeat(down, axis=0)
    if across == 2:
        plane = _widened(plane)
    elif across > 1:
        plane = plane.repeat(across, axis=1)
    return plane


def _segments(b: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 2
    while at < len(b):
        if b[at] != 0xFF:
            raise ValueError("no marker where one should be")
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0xD9:
            break
        else:
            size = int.from_bytes(b[at + 2 : at + 4])
            out.append((kind, b[at + 4 : at + 2 + size]))
            at += 2 + size
            if kind == 0xDA:
                begin = at
                while not (b[at] == 0xFF and b[at + 1] not in (0, *range(0xD0, 0xD8))):
                    at = b.index(b"\xff", at + (2 if b[at] == 0xFF else 1))
                out.append((0, b[begin:at]))
    return out


def decode(b: bytes) -> np.ndarray:
    """Height, width and one or three channels of 8-bit samples."""
    quant, codes, parts, restart, frame = {}, {}, [], 0, None
    adobe = None
    planes: list[np.ndarray] = []
    for kind, body in _segments(b):
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if wide else np.uint8).astype(float)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2])
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only samples of 8 bits are read")
            frame = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            parts = [{"id": c[0], "h": c[1] >> 4, "v": c[1] & 15, "q": c[2]} for c in (body[6 + 3 * k : 9 + 3 * k] for k in range(body[5]))]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images are read")
        elif kind == 0xDA:
            for k in range(body[0]):
                part = next(p for p in parts if p["id"] == body[1 + 2 * k])
                part["dc"], part["ac"] = codes[body[2 + 2 * k] >> 4], codes[16 | body[2 + 2 * k] & 15]
            if body[0] != len(parts):
                raise ValueError("only images in one scan are read")
        elif kind == 0:
            planes = _planes(body, frame, parts, quant, restart)
    height, width = frame
    if len(planes) == 1:
        out = planes[0][..., None]
    elif len(planes) == 3:
        y, cb, cr = planes
        rgb = planes if adobe == 0 else (y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128))
        out = np.stack(rgb, axis=2)
    else:
        raise ValueError("only grey and three-coloured images are read")
    return np.clip(np.rint(out[:height, :width]), 0, 255).astype(np.uint8)


def _planes(coded: bytes, frame: tuple[int, int], parts: list[dict], quant: dict, restart: int) -> list[np.ndarray]:
    """Samples of each component, brought to the image's size."""
    height, width = frame
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    if len(parts) == 1:
        parts[0]["h"] = parts[0]["v"] = most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    blocks = [np.zeros((down * p["v"], across * p["h"], 64)) for p in parts]
    stretches, begin = [], 0
    at = coded.find(b"\xff")
    while at >= 0:
        if 0xD0 <= coded[at + 1] <= 0xD7:
            stretches.append(coded[begin:at])
            begin = at + 2
        at = coded.find(b"\xff", at + 2)
    stretches.append(coded[begin:])
    unit = 0
    for stretch in stretches:
        bits, last = _Bits(stretch), [0] * len(parts)
        for _ in range(min(restart or across * down, across * down - unit)):
            row, column = divmod(unit, across)
            for k, p in enumerate(parts):
                dc, ac = p["dc"], p["ac"]
                for v in range(p["v"]):
                    for h in range(p["h"]):
                        block = blocks[k][row * p["v"] + v, column * p["h"] + h]
                        last[k] += bits.number(bits.symbol(dc))
                        block[0] = last[k]
                        i = 1
                        while i < 64:
                            s = bits.symbol(ac)
                            if not s:
                                break
                            i += s >> 4
                            if s & 15:
                                block[_ORDER[i]] = bits.number(s & 15)
                            i += 1
            unit += 1
    out = []
    for p, x in zip(parts, blocks, strict=True):
        table = np.zeros(64)
        table[_ORDER] = quant[p["q"]]
        pixels = np.einsum("yu,abuv,xv->abyx", _COSINE, (x * table).reshape(*x.shape[:2], 8, 8), _COSINE, optimize=True)
        plane = np.clip(np.rint(pixels.transpose(0, 2, 1, 3).reshape(x.shape[0] * 8, -1) + 128), 0, 255)
        own_h, own_w = -(-height * p["v"] // most_v), -(-width * p["h"] // most_h)
        out.append(_upsampled(plane[:own_h, :own_w], most_h // p["h"], most_v // p["v"])[:height, :width])
    return out
