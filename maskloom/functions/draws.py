"""Random draws that depend only on a seed and a row's key.

Row order, partitioning, retries and the engine do not change them, so a lost task repeats the same draw.
"""

from __future__ import annotations

from fractions import Fraction
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: Column) -> Column:
    """32 hex digits from the seed and the key columns."""
    parts = [F.lit(str(seed))]
    for key in keys:
        parts += [F.lit(":"), key.cast("string")]
    return F.md5(F.concat(*parts))


# fixed values: what MD5 adds and by how much it turns in its 64 steps, and where it starts
_ADDED = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [turn for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for turn in four * 4]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
# messages of more bytes need a second block; so many messages are summed side by side
_ONE_BLOCK, _TOGETHER = 55, 8192


def _md5_blocks(blocks: np.ndarray) -> np.ndarray:
    """The four numbers of the MD5 of each message: a column of 16 little-endian numbers, padding and length included."""
    a, b, c, d = (np.full(blocks.shape[1], start, np.uint32) for start in _START)
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += blocks[at]
        mixed += _ADDED[i]
        turned = mixed << np.uint32(_TURNS[i])
        turned |= mixed >> np.uint32(32 - _TURNS[i])
        turned += b
        a, b, c, d = d, turned, b, c
    return np.stack([x + np.uint32(start) for x, start in zip((a, b, c, d), _START)])


def draws_at(prefixes: list[bytes], rows: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Draws for many positions: the MD5 of ``prefixes[row]`` and the position in digits.

    A line for each, of four numbers: eight hex digits of ``draw`` each.
    """
    if not len(rows):
        return np.zeros((0, 4), np.int64)
    digits = [str(i).encode() for i in range(int(positions.max()) + 1)]
    if max(map(len, prefixes)) + len(digits[-1]) > _ONE_BLOCK:
        some = [md5(prefixes[r] + digits[p], usedforsecurity=False).digest() for r, p in zip(rows.tolist(), positions.tolist())]
        return np.frombuffer(b"".join(some), ">u4").reshape(-1, 4).astype(np.int64)
    width = len(digits[-1])
    starts = np.frombuffer(b"".join([p.ljust(64, b"\0") for p in prefixes]), np.uint8).reshape(-1, 64)
    # a position's digits and the bit behind them
    ends = np.frombuffer(b"".join([(d + b"\x80").ljust(width + 1, b"\0") for d in digits]), np.uint8).reshape(-1, width + 1)
    sizes, counts = np.array([len(p) for p in prefixes]), np.array([len(d) for d in digits])
    out = np.empty((len(rows), 4), np.int64)
    for first in range(0, len(rows), _TOGETHER):
        row, position = rows[first : first + _TOGETHER], positions[first : first + _TOGETHER]
        messages, lines = starts[row], np.arange(len(row))
        for i in range(width + 1):
            messages[lines, sizes[row] + i] = ends[position, i]
        bits = 8 * (sizes[row] + counts[position])
        messages[:, 56], messages[:, 57] = bits & 255, bits >> 8
        blocks = np.ascontiguousarray(messages.view("<u4").T.astype(np.uint32))
        out[first : first + _TOGETHER] = _md5_blocks(blocks).T.astype("<u4").view(">u4")
    return out


def threshold(probability: float, digits: int = 16) -> str:
    """The hex text below which a share ``probability`` of all draws lies."""
    if not 0 <= probability < 1:
        raise ValueError("a probability must lie in [0, 1)")
    return format(int(Fraction(str(probability)) * 16**digits), f"0{digits}x")


def below(hex_text: Column, probability: float, start: int = 1, digits: int = 16) -> Column:
    """True for a share ``probability`` of the draws, judged by ``digits`` digits from ``start``."""
    return F.substring(hex_text, start, digits) < F.lit(threshold(probability, digits))


def integer(hex_text: Column, start: int, bound: int) -> Column:
    """A whole number in [0, bound) from the eight digits at ``start``."""
    return (F.conv(F.substring(hex_text, start, 8), 16, 10).cast("long") % bound).cast("int")
