"""The lossless bit stream: encoder and decoder."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mosaiq.codec import WebpError, lz
from mosaiq.codec import transforms as tf
from mosaiq.codec.bits import BitReader, BitWriter
from mosaiq.codec.huffman import canonical, code_lengths, read_code, write_code

MAX_SIDE = 16384
GREEN = 256 + lz.LENGTH_CODES


@dataclass(frozen=True)
class Options:
    subtract_green: bool = True
    predictor: bool = True
    predictor_bits: int = 4
    predictor_modes: tuple[int, ...] = (11,)
    color: bool = False
    color_bits: int = 4
    color_index: bool = True
    lz77: bool = True
    color_cache: bool = True
    cache_bits: int = 11  # at most


@dataclass(frozen=True)
class Image:
    data: bytes  # RGBA
    width: int
    height: int
    has_alpha: bool | None = None


def encode(image: Image, options: Options = Options()) -> bytes:
    """A lossless chunk's payload. The alpha flag follows the pixels, whatever ``has_alpha`` says."""
    w, h = image.width, image.height
    if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE):
        raise WebpError(f"a side must be 1 to {MAX_SIDE} pixels")
    if len(image.data) < 4 * w * h:
        raise WebpError("fewer pixels than width times height")
    argb = tf.from_rgba(image.data[: 4 * w * h])
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int((argb >> np.uint32(24) != 255).any()), 1)
    out.put(0, 3)
    palette = tf.palette_of(argb) if options.color_index else argb
    if options.color_index and len(palette) <= 16:
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(palette) - 1, 8)
        _sub_image(out, tf.palette_deltas(palette))
        argb, w = tf.index_forward(argb, palette, w, h)
    else:
        if options.color and w > 1 and h > 1:
            argb, elements = tf.color_forward(argb, w, h, options.color_bits)
            _block_transform(out, 1, options.color_bits, elements)
        if options.subtract_green:
            out.put(1, 1)
            out.put(2, 2)
            argb = tf.subtract_green(argb)
        if options.predictor and w > 1 and h > 1:
            argb, modes = tf.predictor_forward(argb, w, h, options.predictor_bits, options.predictor_modes)
            _block_transform(out, 0, options.predictor_bits, modes)
    out.put(0, 1)  # no more transforms
    cache = min(options.cache_bits, max(1, len(argb).bit_length() - 3)) if options.color_cache else 0  # no larger than its use
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    out.put(0, 1)  # one group of codes
    _pixels(out, argb, w, cache, options.lz77)
    return out.bytes()


def _block_transform(out: BitWriter, kind: int, bits: int, image: np.ndarray) -> None:
    out.put(1, 1)
    out.put(kind, 2)
    out.put(bits - 2, 3)
    _sub_image(out, image)


def _sub_image(out: BitWriter, argb: np.ndarray) -> None:
    out.put(0, 1)  # no colour cache
    _pixels(out, argb, len(argb), 0, False)


def matches(argb: np.ndarray) -> np.ndarray:
    """For each pixel the newest earlier pixel that starts the same three pixels, or -1."""
    n = len(argb)
    before = np.full(n, -1, np.int64)
    if n > 3:
        a = argb.astype(np.uint64)
        key = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        before[order[1:][same]] = order[:-1][same]
    return before


def _match_length(argb: np.ndarray, at: int, back: int) -> int:
    most, n, step = min(lz.MAX_LENGTH, len(argb) - at), 0, 16
    while n < most:
        m = min(step, most - n)
        differ = np.flatnonzero(argb[at + n : at + n + m] != argb[back + n : back + n + m])
        if len(differ):
            return n + int(differ[0])
        n, step = n + m, step * 4
    return n


def _pixels(out: BitWriter, argb: np.ndarray, width: int, cache: int, lz77: bool) -> None:
    """Codes and coded pixels: copies of earlier runs, colours in the cache, or literals."""
    n = len(argb)
    copy_at, copy_len, copy_back = [], [], []
    literal = np.ones(n, bool)
    if lz77:
        before = matches(argb)
        places = np.flatnonzero((before >= 0) & (np.arange(n) - before < lz.MAX_DISTANCE - lz.NEAR_CODES)).tolist()
        end = 0
        for i in places:
            if i < end:
                continue
            size = _match_length(argb, i, int(before[i]))
            if size >= 3:
                copy_at.append(i)
                copy_len.append(size)
                copy_back.append(i - int(before[i]))
                end = i + size
                literal[i:end] = False
    hit = np.zeros(n, bool)
    if cache:
        keys = lz.cache_keys(argb, cache)
        order = np.argsort(keys, kind="stable")
        same = (keys[order][1:] == keys[order][:-1]) & (argb[order][1:] == argb[order][:-1])
        hit[order[1:][same]] = True
        hit &= literal
        literal &= ~hit
    starts = np.flatnonzero(literal | hit)
    at = np.concatenate([starts, np.array(copy_at, np.int64)])
    order = np.argsort(at, kind="stable")
    plain = literal[starts]
    px = argb[starts].astype(np.int64)
    near = lz.near_codes(width)
    back = np.array([near.get(d, d + lz.NEAR_CODES) for d in copy_back], np.int64)
    (lc, lx, lv), (dc, dx, dv) = lz.prefix_of(np.array(copy_len, np.int64)), lz.prefix_of(back)
    green = np.concatenate([np.where(plain, px >> 8 & 255, GREEN + (keys[starts] if cache else 0)), 256 + lc])
    lit = px[plain]
    alphabets = (GREEN + ((1 << cache) if cache else 0), 256, 256, 256, lz.DISTANCE_CODES)
    symbols = (green, lit >> 16 & 255, lit & 255, lit >> 24, dc)
    codes = []
    for s, size in zip(symbols, alphabets, strict=True):
        lengths = code_lengths(np.bincount(s, minlength=size))
        write_code(out, lengths)
        code = canonical(lengths)
        codes.append((code, np.where(np.count_nonzero(lengths) > 1, lengths, 0)))
    # a token has up to five fields: green; red, blue and alpha, or length bits, distance and its bits
    fields = np.zeros((len(at), 5), np.int64)
    sizes = np.zeros((len(at), 5), np.int64)
    fields[:, 0], sizes[:, 0] = codes[0][0][green], codes[0][1][green]
    rows = np.flatnonzero(plain)
    for k in (1, 2, 3):
        fields[rows, k], sizes[rows, k] = codes[k][0][symbols[k]], codes[k][1][symbols[k]]
    rows = np.arange(len(starts), len(at))
    fields[rows, 1], sizes[rows, 1] = lv, lx
    fields[rows, 2], sizes[rows, 2] = codes[4][0][dc], codes[4][1][dc]
    fields[rows, 3], sizes[rows, 3] = dv, dx
    fields, sizes = fields[order].ravel(), sizes[order].ravel()
    some = sizes > 0
    out.put_all(fields[some], sizes[some])


def header(data: bytes) -> tuple[int, int, bool]:
    if len(data) < 5 or data[0] != 0x2F:
        raise WebpError("lossless data without its signature")
    bits = int.from_bytes(data[1:5], "little")
    if bits >> 29:
        raise WebpError("unknown version of the lossless format")
    return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1)


def decode(data: bytes, max_pixels: int = MAX_SIDE**2, strict: bool = False) -> Image:
    """The image of a lossless chunk's payload. Data that end early read as zeros unless ``strict``."""
    w, h, alpha = header(data)
    if w * h > max_pixels:
        raise WebpError(f"{w} x {h} is more than {max_pixels} pixels")
    bits = BitReader(data, strict)
    bits.skip(40)
    return Image(tf.to_rgba(decode_stream(bits, w, h)), w, h, alpha)


def decode_stream(bits: BitReader, width: int, height: int) -> np.ndarray:
    """ARGB of a stream without its header."""
    chain, w, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            across, down, _ = tf.blocks_of(w, 1, size)[0], -(-height // (1 << size)), 0
            chain.append((kind, w, size, _image(bits, across, down, False)))
        elif kind == 2:
            chain.append((kind, w, 0, None))
        else:
            palette = tf.palette_sums(_image(bits, bits.read(8) + 1, 1, False))
            chain.append((kind, w, 0, palette))
            w = -(-w // (1 << tf.index_bits(len(palette))))
    argb = _image(bits, w, height, True)
    for kind, w, size, extra in reversed(chain):
        if kind == 0:
            argb = tf.predictor_inverse(argb, extra, w, height, size)
        elif kind == 1:
            argb = tf.color_inverse(argb, extra, w, height, size)
        elif kind == 2:
            argb = tf.subtract_green(argb, 1)
        else:
            argb = tf.index_inverse(argb, extra, w, height)
    return argb


def _image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache = bits.read(4) if bits.read(1) else -1
    if cache != -1 and not 1 <= cache <= 11:
        raise WebpError("colour cache of a wrong size")
    cache = max(cache, 0)
    groups, group_of, group_bits = 1, None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across, down = -(-width // (1 << group_bits)), -(-height // (1 << group_bits))
        meta = _image(bits, across, down, False) >> np.uint32(8) & np.uint32(0xFFFF)
        group_of, groups = meta.astype(np.int64).tolist(), int(meta.max()) + 1
    alphabets = (GREEN + ((1 << cache) if cache else 0), 256, 256, 256, lz.DISTANCE_CODES)
    tables = [[read_code(bits, a) for a in alphabets] for _ in range(groups)]
    return _coded_pixels(bits, width, height, cache, tables, group_of, group_bits)


def _coded_pixels(bits: BitReader, width: int, height: int, cache: int, tables: list, group_of: list | None, group_bits: int) -> np.ndarray:
    n = width * height
    out: list[int] = []
    kept = [0] * (1 << cache) if cache else []
    shift = 32 - cache
    data, at, end = bits.data, bits.at, bits.end
    across = -(-width // (1 << group_bits)) if group_bits else 0
    bases = [lz.prefix_base(c) for c in range(lz.DISTANCE_CODES)]
    done = 0  # pixels that are in the cache
    group = -1
    while len(out) < n:
        i = len(out)
        g = group_of[(i // width >> group_bits) * across + (i % width >> group_bits)] if group_of else 0
        if g != group:
            group = g
            green, red, blue, alpha, far = tables[g]
            gm, gs, gz = green.mask, green.symbols, green.sizes
            rm, rs, rz, bm, bs, bz, am, as_, az = red.mask, red.symbols, red.sizes, blue.mask, blue.symbols, blue.sizes, alpha.mask, alpha.symbols, alpha.sizes
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        k = window & gm
        symbol, used = gs[k], gz[k]
        if symbol < 256:
            k = window >> used & rm
            r = rs[k]
            used += rz[k]
            k = window >> used & bm
            b = bs[k]
            used += bz[k]
            k = window >> used & am
            out.append(as_[k] << 24 | r << 16 | symbol << 8 | b)
            at += used + az[k]
        elif symbol < GREEN:
            base, extra = bases[symbol - 256]
            size = base + (window >> used & ((1 << extra) - 1))
            at += used + extra
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
            k = window & far.mask
            base, extra = bases[far.symbols[k]]
            used = far.sizes[k]
            back = lz.near_distance(base + (window >> used & ((1 << extra) - 1)), width)
            at += used + extra
            if back > i:
                raise WebpError("a copy starts before the image")
            size = min(size, n - i)
            if back >= size:
                out += out[i - back : i - back + size]
            else:
                run = out[i - back :]
                out += (run * (size // back + 1))[:size]
        else:
            if not cache:
                raise WebpError("a cached colour without a cache")
            for c in out[done:]:
                kept[(c * lz.CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = c
            done = i
            out.append(kept[symbol - GREEN])
            at += used
        if at > end + 64 and len(out) < n:  # far beyond the data all bits are zero
            if bits.strict:
                raise WebpError("bit stream ends early")
            data, at, end = bytes(16), 0, 1 << 60
            data = _Zeros()
    bits.at = at if not isinstance(data, _Zeros) else bits.end
    if bits.strict:
        bits.skip(0)
    return np.array(out, np.uint32)


class _Zeros:
    """What a reader finds beyond the end."""

    def __getitem__(self, _: slice) -> bytes:
        return b""
