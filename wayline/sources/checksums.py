"""CRC-32C of many byte strings at once, by numpy.

Strings are cut into lanes of ``LANE`` bytes, filled up with zeros in front
(which change nothing, as the register begins at zero). All lanes go through
the table byte by byte side by side; then each lane is shifted by the bytes
that follow it in its string, and a string's lanes are added up. What a
register that begins with ones contributes depends on the length alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

LANE = 64
_POLYNOMIAL = 0x82F63B78
#: Bits of a length that shifts are made for.
_BITS = 40


@cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1))
    return t


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map given by its values for each byte of the register."""
    return tables[0][c & 255] ^ tables[1][(c >> np.uint32(8)) & 255] ^ tables[2][(c >> np.uint32(16)) & 255] ^ tables[3][c >> np.uint32(24)]


@cache
def _shifts() -> list[np.ndarray]:
    """Maps of the register over 1, 2, 4, ... zero bytes."""
    by_byte = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    one = _table()[by_byte & 255] ^ (by_byte >> np.uint32(8))
    out = [one]
    for _ in range(_BITS - 1):
        out.append(_through(out[-1], out[-1]))
    return out


def _shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each register over n zero bytes of its own."""
    for b, tables in enumerate(_shifts()):
        on = (n >> b) & 1 == 1
        if not on.any():
            if not (n >> b).any():
                break
            continue
        c = np.where(on, _through(tables, c), c)
    return c


def crc32c(strings: Sequence[bytes | memoryview]) -> np.ndarray:
    """The checksum of each string."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    lanes = -(-sizes // LANE)
    buf = np.zeros(int(lanes.sum()) * LANE, dtype=np.uint8)
    ends = np.cumsum(lanes) * LANE
    for s, n, e in zip(strings, sizes.tolist(), ends.tolist(), strict=True):
        buf[e - n : e] = np.frombuffer(s, dtype=np.uint8)
    columns, table = buf.reshape(-1, LANE), _table()
    c = np.zeros(len(columns), dtype=np.uint32)
    for k in range(LANE):
        c = table[(c ^ columns[:, k]) & 255] ^ (c >> np.uint32(8))
    ahead = (np.repeat(np.cumsum(lanes), lanes) - 1 - np.arange(len(columns))) * LANE
    c = _shifted(c, ahead)
    out = _shifted(np.full(len(sizes), 0xFFFFFFFF, dtype=np.uint32), sizes)
    some = np.flatnonzero(lanes)
    if len(some):
        out[some] ^= np.bitwise_xor.reduceat(c, (np.cumsum(lanes) - lanes)[some])
    return out ^ np.uint32(0xFFFFFFFF)


def masked(c: np.ndarray) -> np.ndarray:
    """Checksums as they stand beside what they check: turned by 15 bits, with a constant added."""
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(0xA282EAD8)


def masked_of_lengths(windows: np.ndarray) -> np.ndarray:
    """Masked checksums of rows of eight bytes."""
    table, c = _table(), np.full(len(windows), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(8):
        c = table[(c ^ windows[:, k]) & 255] ^ (c >> np.uint32(8))
    return masked(c ^ np.uint32(0xFFFFFFFF))


def masked_of_length(head: bytes) -> int:
    """The masked checksum of eight bytes, without arrays, which cost more than they save for one length."""
    table, c = _plain_table(), 0xFFFFFFFF
    for b in head:
        c = table[(c ^ b) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


@cache
def _plain_table() -> tuple[int, ...]:
    return tuple(_table().tolist())
