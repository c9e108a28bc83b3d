"""Many images at once: the lossless encoder and decoder over the concatenated pixels of a batch.

Small images spend nearly all of the kernel's time between array operations; here an operation works on all images. The bytes
are those of ``lossless.encode``. What isn't handled here (palettes, several groups of codes, damaged data, very
large images) goes to the kernel, one image after the other. A batch is cut to about CHUNK pixels, which bounds memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from mosaiq.codec import WebpError, lossless, lz
from mosaiq.codec import transforms as tf
from mosaiq.codec.huffman import _REVERSED as REVERSED
from mosaiq.codec.huffman import LENGTH_ORDER
from mosaiq.codec.lossless import GREEN, Image, Options

CHUNK = 1 << 19  # pixels that are worked on together
LARGEST = 1 << 20  # pixels of an image that comes here
FEW = 40  # streams that are read one after the other rather than side by side
_INF = 1 << 58
_FAR = lz.MAX_DISTANCE - lz.NEAR_CODES
_ORDER = np.array(LENGTH_ORDER)
_REV15 = (REVERSED[: 1 << 15] >> 1).astype(np.int64)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def spots(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every element of rows of these sizes, one row after the other: its row, and its place there."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(starts_of(sizes), sizes)


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[list[int]]:
    """Rows of like sizes, about ``most`` in sum."""
    out, held = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if out and held + sizes[i] > most:
            yield out
            out, held = [], 0
        out.append(i)
        held += sizes[i]
    if out:
        yield out


# -- prefix codes ---------------------------------------------------------------------------------------------------


def code_lengths(code: np.ndarray, counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """huffman.code_lengths of many codes: a length for each used symbol, given by code, then symbol."""
    out = np.ones(len(code), np.int64)
    if not len(code):
        return out
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    sizes = np.diff(np.r_[begin, len(code)])
    rank = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort((rank << 40) + counts, kind="stable")
    weights = counts[order] * 2  # the lowest bit tells packages from leaves, which come first of equals
    todo = np.flatnonzero(sizes > 1)
    todo = todo[np.argsort(sizes[todo], kind="stable")]
    while len(todo):
        k = max(1, min(len(todo), (1 << 17) // int(sizes[todo[0]])))
        k = int(np.searchsorted(sizes[todo[:k]], 2 * sizes[todo[0]] + 8, side="right"))
        now, todo = todo[:k], todo[k:]
        n, m = sizes[now], int(sizes[now].max())
        row, column = spots(n)
        at = np.repeat(begin[now], n) + column
        leaves = np.full((k, m), 2 * _INF)
        leaves[row, column] = weights[at]
        items, flags = leaves, [np.ones((k, m), bool)]
        for _ in range(limit - 1):
            half, last = items.shape[1] // 2, items
            pairs = np.minimum((items[:, 0 : 2 * half : 2] >> 1) + (items[:, 1 : 2 * half : 2] >> 1), _INF) * 2 + 1
            items = np.concatenate([leaves, pairs], axis=1)
            items.sort(axis=1)
            items = items[:, : 2 * m - 2] if m > 1 else items
            flags.append((items & 1) == 0)
            if items.shape == last.shape and (items == last).all():
                break  # so are all lists that follow
        flags += flags[-1:] * (limit - len(flags))
        lengths, take, sums = np.zeros((k, m), np.int64), 2 * n - 2, (None, None)
        rows, columns = np.arange(k), np.arange(m)
        for f in reversed(flags):
            if sums[0] is not f:
                sums = (f, f.cumsum(axis=1))
            leaf = np.where(take > 0, sums[1][rows, np.clip(take - 1, 0, f.shape[1] - 1)], 0)
            lengths += leaf[:, None] > columns
            take = 2 * (take - leaf)
        out[order[at]] = lengths[row, column]
    return out


def canonical(code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of used symbols, given by code, then symbol; first bit highest."""
    if not len(code):
        return np.zeros(0, np.int64)
    order = np.argsort(code * 16 + lengths, kind="stable")
    width = np.int64(1) << (15 - lengths[order])
    before = np.cumsum(width) - width
    first = np.r_[True, code[order][1:] != code[order][:-1]]
    before -= np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(code)]))
    out = np.zeros(len(code), np.int64)
    out[order] = before >> (15 - lengths[order])
    return out


def reversed_codes(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return REVERSED[codes] >> (16 - lengths)


def merged(n: int, *sections: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections (owner, values, sizes), each by owner, as one: for every owner of n the first section's fields, then the second's."""
    counts = [np.bincount(o, minlength=n) for o, _, _ in sections]
    at = starts_of(sum(counts))
    total = sum(len(o) for o, _, _ in sections)
    out = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    for (o, v, s), c in zip(sections, counts, strict=True):
        place = np.arange(len(o)) + (at - starts_of(c))[o]
        for to, of in zip(out, (o, v, s), strict=True):
            to[place] = of
        at = at + c
    return out


def fixed(n: int, *fields: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A section of the same fields (value, size) for all of n owners; both may be arrays."""
    value, size = (np.stack([np.broadcast_to(np.asarray(f[i], np.int64), n) for f in fields], axis=1).ravel() for i in (0, 1))
    return np.repeat(np.arange(n), len(fields)), value, size


def code_fields(alphabet: np.ndarray, code: np.ndarray, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """huffman.write_code of many codes, as one section."""
    n = len(alphabet)
    used = np.bincount(code, minlength=n)
    wide = np.bincount(code, weights=symbol > 255, minlength=n) > 0
    short = (used <= 2) & ~wide
    at, inside = starts_of(used), used > 0
    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[inside] = symbol[at[inside]]
    two = used == 2
    second[two] = symbol[at[two] + 1]
    s = np.flatnonzero(short)
    f, t = first[s], two[s]
    simple = fixed(len(s), (1, 1), (t, 1), (f > 1, 1), (f, np.where(f > 1, 8, 1)), (np.where(t, second[s], 0), np.where(t, 8, 0)))
    long = np.flatnonzero(~short)
    k = len(long)
    if not k:
        return s[simple[0]], simple[1], simple[2]
    offset = np.full(n, -1)
    offset[long] = starts_of(alphabet[long])
    dense = np.zeros(int(alphabet[long].sum()), np.int64)
    some = offset[code] >= 0
    dense[offset[code[some]] + symbol[some]] = lengths[some]
    owner = np.repeat(np.arange(k), alphabet[long])
    run = np.flatnonzero(np.r_[True, (dense[1:] != dense[:-1]) | (owner[1:] != owner[:-1])])
    v, o, size = dense[run], owner[run], np.diff(np.r_[run, len(dense)])
    before = lambda a, j, of: np.r_[np.full(min(j, len(a)), of), a[:-j]] if len(a) else a
    prev, prev2 = np.where(before(o, 1, -1) == o, before(v, 1, 8), 8), np.where(before(o, 2, -1) == o, before(v, 2, 8), 8)
    last = np.where(prev == 0, prev2, prev)
    head = (v != last).astype(np.int64)
    zero, (full, rest), (six, left) = v == 0, np.divmod(size, 138), np.divmod(size - head, 6)
    few, less = rest < 3, left < 3
    pick = lambda *forms: np.stack([np.where(zero, a, b) for a, b in forms], axis=1).ravel()
    number = pick((full, head), (~few, six), (np.where(few, rest, 0), np.where(less, left, 1)))
    kind = pick((18, v), (np.where(rest >= 11, 18, 17), 16), (0, np.where(less, v, 16)))
    more = pick((127, 0), (np.where(rest >= 11, rest - 11, rest - 3), 3), (0, np.where(less, 0, left - 3)))
    token, extra, whose = np.repeat(kind, number), np.repeat(more, number), np.repeat(np.repeat(o, 3), number)
    tally = np.bincount(whose * 19 + token, minlength=19 * k)
    there = np.flatnonzero(tally)
    sizes = np.zeros(19 * k, np.int64)
    sizes[there] = code_lengths(there // 19, tally[there], 7)
    codes = np.zeros(19 * k, np.int64)
    codes[there] = reversed_codes(canonical(there // 19, sizes[there]), sizes[there])
    own = sizes.reshape(k, 19)[:, _ORDER]
    sent = np.maximum(4, 19 - np.argmax(own[:, ::-1] > 0, axis=1))
    headed = fixed(k, (0, 1), (sent - 4, 4), *((np.where(sent > i, own[:, i], 0), np.where(sent > i, 3, 0)) for i in range(19)), (0, 1))
    single = (own > 0).sum(axis=1) == 1
    bits = np.where(single[whose], 0, sizes[whose * 19 + token])
    value = np.where(single[whose], 0, codes[whose * 19 + token])
    tokens = whose, value | extra << bits, bits + np.array([0] * 16 + [2, 3, 7])[token]
    normal = merged(k, headed, tokens)
    return merged(n, (s[simple[0]], *simple[1:]), (long[normal[0]], *normal[1:]))


def pack(n: int, owner: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The fields of each of n streams, up to 57 bits each, as bytes."""
    bits = np.bincount(owner, weights=sizes, minlength=n).astype(np.int64)
    words = (bits + 63) // 64 + 1
    begin = starts_of(words)
    ends = np.cumsum(sizes)
    at = ends - sizes + (begin * 64 - starts_of(bits))[owner]
    out = np.zeros(int(words.sum()), np.uint64)
    v, shift, word = values.astype(np.uint64), (at & 63).astype(np.uint64), at >> 6
    np.add.at(out, word, v << shift)
    over = np.flatnonzero((at & 63) + sizes > 64)
    np.add.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    raw = out.tobytes()
    return [raw[8 * b : 8 * b + (m + 7) // 8] for b, m in zip(begin.tolist(), bits.tolist(), strict=True)]


# -- copies and cache -----------------------------------------------------------------------------------------------


def earlier(argb: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far back the newest place with the same three pixels of the same row lies; 0 where there is none. Fewer than 2^21
    pixels. Exact: pixels are ranked, then pairs, then triples."""
    n = len(argb)
    pos, low, mask = np.arange(n, dtype=np.uint64), np.uint64(21), np.uint64((1 << 21) - 1)
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)

    def ranked(key: np.ndarray) -> np.ndarray:
        s = np.sort(key << low | pos)
        out = np.empty(n, np.uint64)
        out[s & mask] = np.cumsum(np.r_[False, (s[1:] >> low) != (s[:-1] >> low)])
        return out

    back = np.zeros(n, np.int64)
    if n < 4:
        return back
    one = ranked(ranked(argb.astype(np.uint64)) << low | owner)
    after = lambda a, k: np.r_[a[k:], np.zeros(k, np.uint64)]
    two = ranked(one << low | after(one, 1))
    s = np.sort((two << low | after(one, 2)) << low | pos) if n else pos
    end = np.repeat(np.cumsum(sizes), sizes)
    at = (s & mask).astype(np.int64)
    same = ((s[1:] >> low) == (s[:-1] >> low)) & (at[1:] + 2 < end[at[1:]])
    back[at[1:][same]] = (at[1:] - at[:-1])[same]
    back[back >= _FAR] = 0
    return back


def match_lengths(argb: np.ndarray, sizes: np.ndarray, back: np.ndarray) -> np.ndarray:
    """How many pixels, 4,096 at most, from each place with ``back`` on equal those so far back."""
    n = len(argb)
    end = np.repeat(np.cumsum(sizes), sizes)
    some = back > 0
    last = some & np.r_[(back[1:] != back[:-1]) | (end[1:] != end[:-1]), True][:n]
    at = np.flatnonzero(last)
    stop = at + 3
    d, limit = back[at], np.minimum(end[at], at + 2 * lz.MAX_LENGTH)
    open_, step = np.flatnonzero(stop < limit), 4
    while len(open_):  # runs of one distance share their end
        step = min(2 * step, 512, max(8, (1 << 20) // len(open_)))
        p = stop[open_][:, None] + np.arange(step)
        inside = p < limit[open_][:, None]
        p = np.minimum(p, n - 1)
        equal = inside & (argb[p] == argb[p - d[open_][:, None]])
        all_ = equal.all(axis=1)
        stop[open_] += np.where(all_, step, np.argmin(equal, axis=1))
        open_ = open_[all_]
    to = np.zeros(n, np.int64)
    to[at] = stop
    shared = at[np.minimum(np.searchsorted(at, np.flatnonzero(some)), max(len(at) - 1, 0))] if len(at) else at
    out = np.zeros(n, np.int64)
    where = np.flatnonzero(some)
    out[where] = np.minimum(to[shared] - where, lz.MAX_LENGTH)
    return out


def slots(argb: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((argb.astype(np.uint64) * np.uint64(lz.CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> (32 - bits).astype(np.uint64)).astype(np.int64)


def cache_bits(pixels: np.ndarray) -> np.ndarray:
    """No more than 11, nor than the use of a cache of an image of so many pixels."""
    return np.minimum(11, np.maximum(1, np.frexp(pixels.astype(float))[1] - 3))


def before_in_slot(owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """The last place before each with the same owner and slot, or -1. Fewer than 2^21 places, owners and slots together under 2^42."""
    s = np.sort((owner << 11 | slot) << 21 | np.arange(len(slot)))
    at = s & ((1 << 21) - 1)
    same = (s[1:] >> 21) == (s[:-1] >> 21)
    out = np.full(len(slot), -1)
    out[at[1:][same]] = at[:-1][same]
    return out


@lru_cache(64)
def near_table(width: int) -> np.ndarray:
    """The coded distance of each distance that has a near code, 0 for others."""
    near = lz.near_codes(width)
    out = np.zeros(max(near) + 1, np.int64)
    out[list(near)] = list(near.values())
    return out


def coded_distances(back: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = back + lz.NEAR_CODES
    for w in np.unique(width).tolist():
        table = near_table(w)
        on = np.flatnonzero((width == w) & (back < len(table)))
        found = table[back[on]]
        out[on[found > 0]] = found[found > 0]
    return out


# -- writing --------------------------------------------------------------------------------------------------------


def pixel_fields(argb: np.ndarray, sizes: np.ndarray, width: np.ndarray, cache: np.ndarray, lz77: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lossless._pixels of many pixel rows: codes and coded pixels, as one section."""
    n = len(sizes)
    owner, _ = spots(sizes)
    literal = np.ones(len(argb), bool)
    copy, length, back = np.zeros(len(argb), bool), None, None
    if lz77:
        back = earlier(argb, sizes)
        length = match_lengths(argb, sizes, back)
        places = np.flatnonzero(back)
        end, starts, stops = 0, [], []
        for i, m in zip(places.tolist(), length[places].tolist(), strict=True):
            if i >= end:
                end = i + m
                starts.append(i)
                stops.append(end)
        covered = np.zeros(len(argb) + 1, np.int64)
        covered[starts] += 1
        np.subtract.at(covered, stops, 1)
        literal = np.cumsum(covered[:-1]) == 0
        copy[starts] = True
    hit, key = np.zeros(len(argb), bool), None
    if cache.any():
        key = slots(argb, cache[owner])
        before = before_in_slot(owner, key)
        hit = (before >= 0) & (argb[before] == argb) & literal & (cache[owner] > 0)
        literal &= ~hit
    at = np.flatnonzero(literal | hit | copy)
    o, p = owner[at], argb[at].astype(np.int64)
    lit, cop = literal[at], copy[at]
    green = np.where(lit, p >> 8 & 255, GREEN + (key[at] if key is not None else 0))
    alphabet = np.tile(np.array([GREEN, 256, 256, 256, lz.DISTANCE_CODES]), (n, 1))
    alphabet[:, 0] += np.where(cache > 0, 1 << cache, 0)
    alphabet = alphabet.ravel()
    offset = starts_of(alphabet)
    c = np.flatnonzero(cop)
    if len(c):
        lc, lx, lv = lz.prefix_of(length[at[c]])
        dc, dx, dv = lz.prefix_of(coded_distances(back[at[c]], width[o[c]]))
        green[c] = 256 + lc
    g = offset[5 * o] + green
    r = np.flatnonzero(lit)
    spot = [offset[5 * o[r] + k] + (p[r] >> s & 255) for k, s in ((1, 16), (2, 0), (3, 24))]
    far = offset[5 * o[c] + 4] + dc if len(c) else c
    counts = np.bincount(np.concatenate([g, *spot, far]), minlength=int(alphabet.sum()))
    there = np.flatnonzero(counts)
    code = np.searchsorted(offset, there, side="right") - 1
    lengths = code_lengths(code, counts[there])
    codes = code_fields(alphabet, code, there - offset[code], lengths)
    value, size = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    value[there] = reversed_codes(canonical(code, lengths), lengths)
    size[there] = lengths
    lone = np.bincount(code, minlength=5 * n) == 1
    alone = there[lone[code]]
    value[alone] = size[alone] = 0
    fields, bits = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
    fields[:, 0], bits[:, 0] = value[g], size[g]
    for k, s in ((0, spot[0]), (1, spot[1]), (1, spot[2])):
        fields[r, k] |= value[s] << bits[r, k]
        bits[r, k] += size[s]
    if len(c):
        fields[c, 0] |= lv << bits[c, 0]
        bits[c, 0] += lx
        fields[c, 1] = value[far] | dv << size[far]
        bits[c, 1] = size[far] + dx
    return merged(n, (codes[0] // 5, *codes[1:]), (np.repeat(o, 2), fields.ravel(), bits.ravel()))


def encode(images: list[Image], options: Options = Options()) -> list[bytes]:
    """lossless.encode of many images."""
    out: list[bytes] = [b""] * len(images)
    mine = []
    for i, x in enumerate(images):
        if 1 < x.width <= lossless.MAX_SIDE and 1 < x.height <= lossless.MAX_SIDE and x.width * x.height <= LARGEST and len(x.data) >= 4 * x.width * x.height:
            mine.append(i)
        else:
            out[i] = lossless.encode(x, options)
    for some in chunks([images[i].width * images[i].height for i in mine]):
        some = [mine[k] for k in some]
        sizes = np.array([images[i].width * images[i].height for i in some])
        argb = tf.from_rgba(b"".join(images[i].data[: 4 * n] for i, n in zip(some, sizes.tolist(), strict=True)))
        owner, _ = spots(sizes)
        if options.color_index:
            s = np.sort(owner.astype(np.uint64) << np.uint64(32) | argb)
            colours = np.bincount((s[np.r_[True, s[1:] != s[:-1]]] >> np.uint64(32)).astype(np.int64), minlength=len(some))
            for k in np.flatnonzero(colours <= 16).tolist():
                out[some[k]] = lossless.encode(images[some[k]], options)
            keep = colours > 16
            argb, sizes, some = argb[keep[owner]], sizes[keep], [i for i, k in zip(some, keep.tolist(), strict=True) if k]
        if some:
            for i, payload in zip(some, _encoded(argb, sizes, np.array([images[i].width for i in some]), options), strict=True):
                out[i] = payload
    return out


def _encoded(argb: np.ndarray, sizes: np.ndarray, width: np.ndarray, options: Options) -> list[bytes]:
    n, height = len(sizes), sizes // width
    owner, i = spots(sizes)
    y, x = np.divmod(i, width[owner])
    opaque = np.bincount(owner, weights=argb >> np.uint32(24) != 255, minlength=n) == 0
    sections = [fixed(n, (0x2F, 8), (width - 1, 14), (height - 1, 14), (~opaque, 1), (0, 3))]

    def blocks(bits: int) -> tuple[np.ndarray, np.ndarray]:
        across, down = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
        return across * down, starts_of(across * down)[owner] + (y >> bits) * across[owner] + (x >> bits)

    def block_image(kind: int, bits: int, number: np.ndarray, image: np.ndarray) -> None:
        none = np.zeros(n, np.int64)
        sections.extend([fixed(n, (1, 1), (kind, 2), (bits - 2, 3), (0, 1)), pixel_fields(image, number, number, none, False)])

    if options.color:
        number, block = blocks(options.color_bits)
        argb, elements = tf.color_forward_blocks(argb, block, int(number.sum()))
        block_image(1, options.color_bits, number, elements)
    if options.subtract_green:
        sections.append(fixed(n, (1, 1), (2, 2)))
        argb = tf.subtract_green(argb)
    if options.predictor:
        number, block = blocks(options.predictor_bits)
        argb, modes = tf.predictor_forward_blocks(argb, x, y, width[owner], block, int(number.sum()), options.predictor_modes)
        block_image(0, options.predictor_bits, number, modes)
    cache = np.minimum(options.cache_bits, cache_bits(sizes)) if options.color_cache else np.zeros(n, np.int64)
    sections.append(fixed(n, (0, 1), (cache > 0, 1), (cache, np.where(cache > 0, 4, 0)), (0, 1)))
    sections.append(pixel_fields(argb, sizes, width, cache, options.lz77))
    return pack(n, *merged(n, *sections))


# -- reading --------------------------------------------------------------------------------------------------------


class _Reader:
    """Many bit streams in one buffer, each with its own place. ``odd``: streams that the kernel has to read."""

    def __init__(self, data: list[bytes], skip: int) -> None:
        sizes = np.array([len(d) for d in data])
        begin = starts_of(sizes)
        raw = b"".join(data) + bytes(24)
        self.raw = raw
        self.words = np.ndarray(len(raw) - 8, "<u8", raw, strides=(1,)).astype(np.int64)  # eight bytes from each byte on
        self.at = 8 * begin + skip
        self.end = 8 * (begin + sizes)
        self.odd = np.zeros(len(data), bool)

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 56 bits from each place on; higher ones mean nothing."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] >> (at & 7)

    def peek(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self.window(at) & ((np.int64(1) << np.asarray(size, np.int64)) - 1)

    def read(self, ids: np.ndarray, size: int) -> np.ndarray:
        out = self.peek(self.at[ids], size)
        self.at[ids] += size
        self.odd[ids] |= self.at[ids] > self.end[ids]
        return out


def _tables(lengths: np.ndarray, offset: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decoding tables of codes with dense lengths, one after the other: entries 16 x symbol + length; for each code where its
    table begins, its bits, and whether it is complete. The table is asked with its bits, first highest."""
    there = np.flatnonzero(lengths)
    code = np.searchsorted(offset, there, side="right") - 1
    n = lengths[there]
    order = np.argsort(code * 16 + n, kind="stable")
    there, code, n = there[order], code[order], n[order]
    used, bits = np.bincount(code, minlength=len(sizes)), np.zeros(len(sizes), np.int64)
    np.maximum.at(bits, code, n)
    weight = np.bincount(code, weights=np.int64(1) << (15 - n), minlength=len(sizes))
    lone = used == 1
    fine = lone | (weight == 1 << 15)
    bits[lone] = 0
    on = fine[code]
    code, n, there = code[on], n[on], there[on]
    share = np.where(lone[code], 1, np.int64(1) << (bits[code] - n))
    entry = (there - offset[code]) << 4 | np.where(lone[code], 0, n)
    room = np.bincount(code, weights=share, minlength=len(sizes)).astype(np.int64)
    return np.repeat(entry, share), starts_of(room), bits, fine


def _read_codes(r: _Reader, ids: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One code of each stream: entries, where each stream's begin, and their bits."""
    offset = starts_of(alphabet)
    dense = np.zeros(int(alphabet.sum()), np.int64)
    at = r.at[ids].copy()
    bad = np.zeros(len(ids), bool)
    short = r.peek(at, 1) == 1
    k = np.flatnonzero(short)
    if len(k):
        two, wide = r.peek(at[k] + 1, 1), np.where(r.peek(at[k] + 2, 1) == 1, 8, 1)
        first, second = r.peek(at[k] + 3, wide), r.peek(at[k] + 3 + wide, 8)
        out = (first >= alphabet[k]) | ((two == 1) & (second >= alphabet[k]))
        bad[k] = out
        dense[(offset[k] + first)[~out]] = 1
        dense[(offset[k] + second)[~out & (two == 1)]] = 1
        at[k] += 3 + wide + 8 * two
    k = np.flatnonzero(~short)
    if len(k):
        number = 4 + r.peek(at[k] + 1, 4)
        own = np.zeros((len(k), 19), np.int64)
        for i, s in enumerate(LENGTH_ORDER):
            own[:, s] = np.where(i < number, r.peek(at[k] + 5 + 3 * i, 3), 0)
        at[k] += 5 + 3 * number
        bad[k] |= r.peek(at[k], 1) == 1  # lengths for a part of the alphabet only
        at[k] += 1
        entries, begin, bits, fine = _tables(own.ravel(), np.arange(len(k)) * 19, np.full(len(k), 19))
        bad[k] |= ~fine
        live = np.flatnonzero(~bad[k])
        b, s, t = begin[live], 15 - bits[live], at[k][live]
        room, filled, last = alphabet[k][live], np.zeros(len(live), np.int64), np.full(len(live), 8)
        ends, who, runs = r.end[ids[k]][live], live, []
        while len(who):
            w = r.window(t)
            e = entries[b + (_REV15[w & 0x7FFF] >> s)]
            token, used = e >> 4, e & 15
            more = np.where(token < 16, 0, np.where(token == 18, 7, token - 14))
            n = np.where(token < 16, 1, np.where(token == 18, 11, 3) + ((w >> used) & ((1 << more) - 1)))
            value = np.where(token < 16, token, np.where(token == 16, last, 0))
            last = np.where((token > 0) & (token < 16), token, last)
            runs.append((who, filled, n, value))
            filled, t = filled + n, t + used + more
            going = (filled < room) & (t <= ends)
            if not going.all():
                over = ~going
                at[k[who[over]]] = t[over]
                bad[k[who[over]]] |= (filled[over] != room[over]) | (t[over] > ends[over])
                b, s, t, room, filled, last, ends, who = (a[going] for a in (b, s, t, room, filled, last, ends, who))
        if runs:
            who, filled, n, value = (np.concatenate(a) for a in zip(*runs, strict=True))
            on = ~bad[k[who]] & (value > 0)
            which, inside = spots(n[on])
            dense[(offset[k[who[on]]] + filled[on])[which] + inside] = value[on][which]
    r.at[ids] = at
    entries, begin, bits, fine = _tables(dense, offset, alphabet)
    r.odd[ids] |= bad | ~fine
    return entries, begin, bits


def _one_by_one(raw: bytes, at: int, end: int, left: int, tables: list[tuple[list, int]], width: int) -> tuple[list, int]:
    """A stream's tokens (kind, a, b) up to ``left`` pixels, and its place after them."""
    (green, gs), (red, rs), (blue, bs), (alpha, as_), (far, fs) = tables
    turn, bases, out = _REV15_LIST, _BASES, []
    while left > 0 and at <= end:
        w = int.from_bytes(raw[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        e = green[turn[w & 0x7FFF] >> gs]
        s, used = e >> 4, e & 15
        if s < 256:
            e = red[turn[w >> used & 0x7FFF] >> rs]
            used += e & 15
            f = blue[turn[w >> used & 0x7FFF] >> bs]
            used += f & 15
            g = alpha[turn[w >> used & 0x7FFF] >> as_]
            out.append((0, g >> 4 << 24 | e >> 4 << 16 | s << 8 | f >> 4, 0))
            at += used + (g & 15)
            left -= 1
        elif s < GREEN:
            base, extra = bases[s - 256]
            n = base + (w >> used & ((1 << extra) - 1))
            at += used + extra
            w = int.from_bytes(raw[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
            e = far[turn[w & 0x7FFF] >> fs]
            used = e & 15
            base, extra = bases[e >> 4]
            out.append((2, n, lz.near_distance(base + (w >> used & ((1 << extra) - 1)), width)))
            at += used + extra
            left -= n
        else:
            out.append((1, s - GREEN, 0))
            at += used
            left -= 1
    return out, at


_REV15_LIST = _REV15.tolist()
_BASES = [lz.prefix_base(c) for c in range(lz.DISTANCE_CODES)]
_BASE, _EXTRA = (np.array([b[i] for b in _BASES]) for i in (0, 1))
_NEAR = np.array(lz.NEAR)


def _read_pixels(r: _Reader, ids: np.ndarray, pixels: np.ndarray, width: np.ndarray, cache: np.ndarray) -> np.ndarray:
    """The pixels of each stream, one stream after the other; those of odd streams are zeros."""
    tables = []
    for k, size in enumerate((GREEN, 256, 256, 256, lz.DISTANCE_CODES)):
        alphabet = np.full(len(ids), size) + (np.where(cache > 0, 1 << cache, 0) if k == 0 else 0)
        tables.append(_read_codes(r, ids, alphabet))
    free = sum(t[2] for t in tables[:4]) == 0  # pixels without bits
    out = np.zeros(int(pixels.sum()), np.uint32)
    begin = starts_of(pixels)
    entries = np.concatenate([t[0] for t in tables])
    shift = np.cumsum([0] + [len(t[0]) for t in tables[:-1]])
    base = np.stack([t[1] + s for t, s in zip(tables, shift, strict=True)])
    drop = np.stack([15 - t[2] for t in tables])
    fine = ~r.odd[ids]
    solid = np.flatnonzero(free & fine)
    if len(solid):
        g, red, b, a = (entries[base[k][solid]] >> 4 for k in range(4))
        plain = g < 256
        r.odd[ids[solid[~plain]]] = True
        solid, colour = solid[plain], (a << 24 | red << 16 | g << 8 | b)[plain]
        which, inside = spots(pixels[solid])
        out[begin[solid][which] + inside] = colour[which].astype(np.uint32)
    who = np.flatnonzero(fine & ~free)
    at, end, left, B, D = r.at[ids[who]], r.end[ids[who]], pixels[who].copy(), base[:, who], drop[:, who]
    steps: list[tuple] = []
    while len(who) >= FEW:
        w = r.window(at)
        e = entries[B[0] + (_REV15[w & 0x7FFF] >> D[0])]
        s, used = e >> 4, e & 15
        w = w >> used
        e1 = entries[B[1] + (_REV15[w & 0x7FFF] >> D[1])]
        t = at + used + (e1 & 15)
        w = r.window(t)
        e2 = entries[B[2] + (_REV15[w & 0x7FFF] >> D[2])]
        used2 = e2 & 15
        e3 = entries[B[3] + (_REV15[(w >> used2) & 0x7FFF] >> D[3])]
        after = t + used2 + (e3 & 15)
        value = (e3 >> 4) << 24 | (e1 >> 4) << 16 | s << 8 | e2 >> 4
        n = 1
        other = np.flatnonzero(s > 255)
        if len(other):
            n, kind, back = np.ones(len(who), np.int64), np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
            hit, copy = other[s[other] >= GREEN], other[s[other] < GREEN]
            kind[hit], value[hit], after[hit] = 1, s[hit] - GREEN, (at + used)[hit]
            if len(copy):
                c, a = s[copy] - 256, (at + used)[copy]
                n[copy] = _BASE[c] + r.peek(a, _EXTRA[c])
                a = a + _EXTRA[c]
                f = entries[B[4][copy] + (_REV15[r.window(a) & 0x7FFF] >> D[4][copy])]
                a, f = a + (f & 15), f >> 4
                d = _BASE[f] + r.peek(a, _EXTRA[f])
                near = _NEAR[np.clip(d - 1, 0, lz.NEAR_CODES - 1)]
                back[copy] = np.where(d > lz.NEAR_CODES, d - lz.NEAR_CODES, np.maximum(1, near[:, 0] + near[:, 1] * width[who[copy]]))
                kind[copy], value[copy], after[copy] = 2, n[copy], a + _EXTRA[f]
            steps.append((who, value, kind, back))
        else:
            steps.append((who, value, None, None))
        at, left = after, left - n
        going = (left > 0) & (at <= end)
        if not going.all():
            over = ~going
            r.at[ids[who[over]]] = at[over]
            r.odd[ids[who[over]]] |= (left[over] > 0) | (at[over] > end[over])
            who, at, end, left, B, D = who[going], at[going], end[going], left[going], B[:, going], D[:, going]
    for k, j in enumerate(who.tolist()):
        own = []
        for i in range(5):
            size = 1 << int(15 - D[i][k])
            own.append((entries[B[i][k] : B[i][k] + size].tolist(), int(D[i][k])))
        found, stop = _one_by_one(r.raw, int(at[k]), int(end[k]), int(left[k]), own, int(width[j]))
        r.at[ids[j]] = stop
        r.odd[ids[j]] |= stop > int(end[k])
        if found:
            kind, value, back = np.array(found, np.int64).T
            steps.append((np.full(len(found), j), value, kind, back))
    if not steps:
        return out
    whole = np.concatenate([s[0] for s in steps])
    order = np.argsort(whole.astype(np.uint16) if len(ids) < 1 << 16 else whole, kind="stable")
    order = order[~r.odd[ids[whole[order]]]]
    whole, value = whole[order], np.concatenate([s[1] for s in steps])[order]
    if all(s[2] is None for s in steps):
        _, inside = spots(np.bincount(whole, minlength=len(ids)))
        out[begin[whole] + inside] = value.astype(np.uint32)
        return out
    kind, back = (np.concatenate([np.zeros(len(s[0]), np.int64) if s[k] is None else s[k] for s in steps])[order] for k in (2, 3))
    _resolved(out, begin, pixels, cache, whole, kind, value, back, r, ids)
    return out


def _resolved(out: np.ndarray, begin: np.ndarray, pixels: np.ndarray, cache: np.ndarray, who: np.ndarray, kind: np.ndarray, value: np.ndarray, back: np.ndarray, r: _Reader, ids: np.ndarray) -> None:
    """Copies and cached colours followed back to literals, by pointer jumping (see operators.reading.pixels_of)."""
    n = np.where(kind == 2, value, 1)
    before = starts_of(n)
    count = np.bincount(who, minlength=len(begin))
    at = before - np.repeat(before[starts_of(count)[count > 0]], count[count > 0])
    n = np.minimum(n, pixels[who] - at)  # the last copy may go on beyond the image
    broken = (kind == 2) & (back > at)
    if broken.any():
        r.odd[ids[who[broken]]] = True
        on = ~r.odd[ids[who]]
        who, kind, value, back, n, at = (a[on] for a in (who, kind, value, back, n, at))
    token, inside = spots(n)
    place = (begin[who] + at)[token] + inside
    first = (begin[who] + at)[token]
    k = kind[token]
    to = np.arange(len(out))
    b = np.maximum(back[token], 1)
    to[place] = np.where(k == 2, first - b + inside % b, place)

    def ended(to: np.ndarray) -> np.ndarray:
        while True:
            on = to[to]
            if (on == to).all():
                return on
            to = on

    root = ended(to)
    colour = out.astype(np.int64)
    plain = k == 0
    colour[place[plain]] = value[token][plain]
    named = place[k == 1]
    if len(named):
        owner = np.repeat(np.arange(len(pixels)), pixels)
        slot = slots(colour, np.maximum(cache[owner], 1))
        slot[named] = value[token][k == 1]
        slot = slot[root]
        last = before_in_slot(owner, slot)
        source = np.arange(len(out))
        some = named[last[named] >= 0]
        source[some] = root[last[some]]
        root = ended(source)[root]
        r.odd[ids[owner[named[last[named] < 0]]]] = True  # an empty slot's 0 goes into slot 0 then
    out[:] = colour[root].astype(np.uint32)


def decode_streams(data: list[bytes], width: np.ndarray, height: np.ndarray, skip: int = 0) -> list[np.ndarray | None]:
    """ARGB of many streams, ``skip`` bits into the data; None for those that the kernel has to read."""
    r = _Reader(data, skip)
    n = len(data)
    live = np.arange(n)
    chain: list[list[tuple]] = [[] for _ in range(n)]
    for _ in range(4):
        more = live[(r.read(live, 1) == 1) & ~r.odd[live]] if len(live) else live
        live = more
        if not len(live):
            break
        kind = r.read(live, 2)
        r.odd[live[kind == 3]] = True
        for j in live[kind == 2].tolist():
            chain[j].append((2, 0, None))
        k = live[kind < 2]
        if len(k):
            what, bits = kind[kind < 2], r.read(k, 3) + 2
            r.odd[k] |= r.read(k, 1) == 1
            across, down = (width[k] + (1 << bits) - 1) >> bits, (height[k] + (1 << bits) - 1) >> bits
            found = _read_pixels(r, k, across * down, across, np.zeros(len(k), np.int64))
            begin = starts_of(across * down)
            for i, j in enumerate(k.tolist()):
                chain[j].append((int(what[i]), int(bits[i]), found[begin[i] : begin[i] + across[i] * down[i]]))
        live = live[~r.odd[live]]
    for j, c in enumerate(chain):
        r.odd[j] |= len({k for k, _, _ in c}) < len(c)
    live = np.flatnonzero(~r.odd)
    if not len(live):
        return [None] * n
    cached = r.read(live, 1) == 1
    cache = np.zeros(len(live), np.int64)
    cache[cached] = r.read(live[cached], 4)
    r.odd[live] |= (cached & ((cache < 1) | (cache > 11))) | (r.read(live, 1) == 1)
    cache = np.where(cache > 11, 0, cache)
    pixels = (width * height)[live]
    argb = _read_pixels(r, live, pixels, width[live], cache)
    begin = starts_of(pixels)
    out: list[np.ndarray | None] = [None] * n
    groups: dict[tuple, list[int]] = {}
    for i, j in enumerate(live.tolist()):
        if not r.odd[j]:
            groups.setdefault(tuple((k, b) for k, b, _ in chain[j]), []).append(i)
    for steps, some in groups.items():
        own = live[some]
        which, inside = spots(pixels[some])
        px = argb[begin[some][which] + inside]
        w = width[own][which]
        y, x = np.divmod(inside, w)
        fine = np.ones(len(some), bool)
        for level in reversed(range(len(steps))):
            kind, bits = steps[level]
            if kind == 2:
                px = tf.subtract_green(px, 1)
                continue
            extra = [chain[j][level][2] for j in own.tolist()]
            across = (width[own] + (1 << bits) - 1) >> bits
            block = starts_of(np.array([len(e) for e in extra]))[which] + (y >> bits) * across[which] + (x >> bits)
            image = np.concatenate(extra)
            if kind == 1:
                px = tf.color_inverse_blocks(px, image[block])
            else:
                mode = (image >> np.uint32(8) & np.uint32(15)).astype(np.int64)[block]
                fine &= np.bincount(which, weights=mode > 13, minlength=len(some)) == 0
                px = tf.predictor_inverse_places(px, np.where(mode > 13, 0, mode), x, y, w)
        ends = np.cumsum(pixels[some])
        for i, j in enumerate(own.tolist()):
            if fine[i]:
                out[j] = px[ends[i] - pixels[some[i]] : ends[i]]
    return out


def decode(data: list[bytes], max_pixels: int = lossless.MAX_SIDE**2, strict: bool = False) -> list[Image | WebpError]:
    """lossless.decode of many payloads; an error in place of an image that can't be read."""
    heads: list = []
    for d in data:
        try:
            heads.append(lossless.header(d))
        except WebpError as e:
            heads.append(e)
    out: list = [h if isinstance(h, WebpError) else None for h in heads]
    mine = [i for i, h in enumerate(heads) if not isinstance(h, WebpError) and h[0] * h[1] <= min(LARGEST, max_pixels)]
    for some in chunks([heads[i][0] * heads[i][1] for i in mine]):
        some = [mine[k] for k in some]
        found = decode_streams([data[i] for i in some], np.array([heads[i][0] for i in some]), np.array([heads[i][1] for i in some]), 40)
        for i, px in zip(some, found, strict=True):
            if px is not None:
                out[i] = Image(tf.to_rgba(px), *heads[i])
    for i, x in enumerate(out):
        if x is None:
            try:
                out[i] = lossless.decode(data[i], max_pixels, strict)
            except (WebpError, IndexError) as e:
                out[i] = e if isinstance(e, WebpError) else WebpError(str(e))
    return out
