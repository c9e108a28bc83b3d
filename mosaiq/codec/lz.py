"""Lengths, distances and the colour cache of the lossless format."""

from __future__ import annotations

import numpy as np

LENGTH_CODES, DISTANCE_CODES, NEAR_CODES = 24, 40, 120
MAX_LENGTH, MAX_DISTANCE = 4096, 1 << 20
CACHE_MULTIPLIER = 0x1E35A7BD


def prefix_base(code: int) -> tuple[int, int]:
    """The least value of a length or distance code, and its extra bits."""
    if code < 4:
        return code + 1, 0
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + 1, extra


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, extra bits' number and extra bits of each value from 1 up."""
    v = np.asarray(values, np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1  # the highest bit's place
    small = v < 4
    extra = np.where(small, 0, top - 1)
    code = np.where(small, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return code, extra, v & ((1 << extra) - 1)


#: (x, y) of the near-distance codes: pixels up to 7 rows above and up to 8 columns left or 7 right of
#: the current one, by distance, then by columns aside, left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def near_distance(code: int, width: int) -> int:
    """The pixel distance of a coded distance: near codes depend on the image's width."""
    if code > NEAR_CODES:
        return code - NEAR_CODES
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def near_codes(width: int) -> dict[int, int]:
    """The first near code of each distance that has one: shorter than the plain distance's code."""
    out: dict[int, int] = {}
    for code in range(1, NEAR_CODES + 1):
        out.setdefault(near_distance(code, width), code)
    return out


def cache_keys(argb: np.ndarray, bits: int) -> np.ndarray:
    return (((argb.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
