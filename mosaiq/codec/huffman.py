"""Prefix codes: lengths, canonical codes, their transmission and decoding tables."""

from __future__ import annotations

import numpy as np

from mosaiq.codec import WebpError
from mosaiq.codec.bits import BitReader, BitWriter

# The order in which code-length codes are sent, and the repeat codes (base, extra bits).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_REVERSED = sum(((np.arange(1 << 16) >> i & 1) << (15 - i) for i in range(16)), np.zeros(1 << 16, np.int64))
REPEATS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """The best code's lengths of at most ``limit`` bits, by package-merge; a lone symbol gets length 1.

    Each list has the leaves and the packages of two of the list before, leaves first of equals; from the last
    list on, the packages among the items that count say how many count in the list before."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = items = counts[order]
    lists = [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        both = np.concatenate([leaves, items[0 : len(items) // 2 * 2 : 2] + items[1::2]])
        at = np.argsort(both, kind="stable")
        items = both[at]
        lists.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for of_leaves in reversed(lists):
        n = int(of_leaves[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as sent, first bit lowest: canonical codes with their bits reversed."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    top = int(size[-1]) if len(size) else 0
    width = 1 << (top - size)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = _REVERSED[(np.cumsum(width) - width) >> (top - size)] >> (16 - size)
    return codes


def write_code(out: BitWriter, lengths: np.ndarray) -> None:
    """Send a code: in the short form for one or two symbols below 256, else as coded lengths."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(int(wide), 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    out.put(0, 1)
    tokens = _runs(np.asarray(lengths).tolist())
    counts = np.bincount([t for t, _ in tokens], minlength=19)
    own = code_lengths(counts, 7)
    sent = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if own[s]) + 1)
    out.put(sent - 4, 4)
    for s in LENGTH_ORDER[:sent]:
        out.put(int(own[s]), 3)
    out.put(0, 1)  # all symbols' lengths follow
    codes = canonical(own)
    single = np.count_nonzero(own) == 1
    for t, extra in tokens:
        if not single:
            out.put(int(codes[t]), int(own[t]))
        if t in REPEATS:
            out.put(extra, REPEATS[t][1])


def _runs(lengths: list[int]) -> list[tuple[int, int]]:
    """Lengths as tokens: a run of zeros, a repeat of the last length other than zero, or one length."""
    out, i, last = [], 0, 8
    while i < len(lengths):
        v, n = lengths[i], 1
        while i + n < len(lengths) and lengths[i + n] == v and n < 138:
            n += 1
        if v == 0 and n >= 3:
            out.append((18, n - 11) if n >= 11 else (17, n - 3))
        elif v == last and n >= 3:
            n = min(n, 6)
            out.append((16, n - 3))
        else:
            n = 1
            out.append((v, 0))
            last = v or last
        i += n
    return out


class Table:
    """Decoding table of one code: the next ``bits`` bits give (symbol, length)."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise WebpError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.mask, self.symbols, self.sizes = 0, 0, [int(used[0])], [0]
            return
        if (1 << 15 >> lengths[used]).sum() != 1 << 15:
            raise WebpError("prefix code lengths don't make a complete code")
        self.bits = int(lengths.max())
        self.mask = (1 << self.bits) - 1
        codes = canonical(lengths)
        symbol, size = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
        for s in used.tolist():
            symbol[codes[s] :: 1 << lengths[s]] = s
            size[codes[s] :: 1 << lengths[s]] = lengths[s]
        self.symbols, self.sizes = symbol.tolist(), size.tolist()

    def read(self, bits: BitReader) -> int:
        i = bits.window() & self.mask
        bits.skip(self.sizes[i])
        return self.symbols[i]


def read_code(bits: BitReader, alphabet: int) -> Table:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebpError("prefix code symbol outside its alphabet")
        lengths[symbols] = 1
        return Table(lengths)
    own = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[s] = bits.read(3)
    table = Table(own)
    budget = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    i, last = 0, 8
    while i < alphabet and budget > 0:
        budget -= 1
        t = table.read(bits)
        if t < 16:
            lengths[i] = t
            i, last = i + 1, t or last
            continue
        base, extra = REPEATS[t]
        n = base + bits.read(extra)
        if i + n > alphabet:
            raise WebpError("prefix code lengths run over their alphabet")
        lengths[i : i + n] = last if t == 16 else 0
        i += n
    return Table(lengths)
