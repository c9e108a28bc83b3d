"""Least-significant-bit-first bit streams."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Fields of up to 32 bits in a row, all at once; the last byte is filled with zeros."""
    values, sizes = values.astype(np.uint64), sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    at = ends - sizes
    out = np.zeros((int(ends[-1]) + 7) // 8 + 8 if len(ends) else 0, np.uint8)
    shifted = values << (at & 7).astype(np.uint64)
    for i in range(5):  # a field touches five bytes at most, and no bit twice
        part = ((shifted >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8)
        some = part > 0
        np.add.at(out, (at[some] >> 3) + i, part[some])
    return out[: (int(ends[-1]) + 7) // 8].tobytes() if len(ends) else b""


class BitWriter:
    """Collects fields; bytes() packs them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.parts.append((values, sizes))

    def _flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        self._flush()
        if not self.parts:
            return b""
        return pack(*(np.concatenate([p[i] for p in self.parts]) for i in (0, 1)))


class BitReader:
    """Reads fields; beyond the end there are zeros unless ``strict``, which raises there."""

    def __init__(self, data: bytes, strict: bool = False) -> None:
        self.end = 8 * len(data)
        self.data = bytes(data) + bytes(16)
        self.at = 0
        self.strict = strict

    def window(self) -> int:
        """At least 56 bits from here on."""
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)

    def read(self, size: int) -> int:
        out = self.window() & ((1 << size) - 1)
        self.skip(size)
        return out

    def skip(self, size: int) -> None:
        self.at += size
        if self.strict and self.at > self.end:
            from mosaiq.codec import WebpError

            raise WebpError("bit stream ends early")

    @property
    def byte_position(self) -> int:
        return (self.at + 7) >> 3

    def align(self) -> None:
        self.at = (self.at + 7) & ~7

    def more(self) -> bool:
        return self.at < self.end
