"""The lossy bit stream: key frames in both directions.

Coefficient and sub-block mode probabilities are parameters (see Tables): the format fixes 2,956 of them and
256 quantiser steps without a rule behind them. Encoder and decoder agree under any valid tables;
files of other programs need the format's own."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from mosaiq.codec import WebpError
from mosaiq.codec import lossy as k
from mosaiq.codec.lossless import Image

# Scan order, coefficient bands, and the probabilities of modes and large values' extra bits.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
DC, V, H, TM, B = "dc", "v", "h", "tm", "b"
LUMA_PROBS, CHROMA_PROBS = (145, 156, 163, 128), (142, 114, 183)
EXTRA = {"c1": (5, (159,)), "c2": (7, (165, 145)), "c3": (11, (173, 148, 140)), "c4": (19, (176, 155, 140, 135)), "c5": (35, (180, 157, 141, 134, 130)), "c6": (67, (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))}
# Trees: (index of the probability, branch of 0, branch of 1).
LUMA_TREE = (0, B, (1, (2, DC, V), (3, H, TM)))
CHROMA_TREE = (0, DC, (1, V, (2, H, TM)))
SUB_TREE = (0, "dc", (1, "tm", (2, "ve", (3, (4, "he", (5, "rd", "vr")), (6, "ld", (7, "vl", (8, "hd", "hu")))))))
SUB_MODES = ("dc", "tm", "ve", "he", "ld", "rd", "vr", "vl", "hd", "hu")
NONZERO_TREE = (2, 1, (3, (4, 2, (5, 3, 4)), (6, (7, "c1", "c2"), (8, (9, "c3", "c4"), (10, "c5", "c6")))))
IMPLIED = {DC: "dc", V: "ve", H: "he", TM: "tm"}


@dataclass(frozen=True)
class Tables:
    coefficients: np.ndarray  # 4 kinds x 8 bands x 3 contexts x 11
    updates: np.ndarray  # the same shape: chances that a frame changes them
    sub_modes: np.ndarray  # 10 above x 10 left x 9
    dc: np.ndarray  # 128 quantiser steps
    ac: np.ndarray

    @classmethod
    def load(cls, path: str) -> Tables:
        """From a JSON file with the five fields as nested or flat lists."""
        with open(path) as f:
            raw = json.load(f)
        shapes = {"coefficients": (4, 8, 3, 11), "updates": (4, 8, 3, 11), "sub_modes": (10, 10, 9), "dc": (128,), "ac": (128,)}
        return cls(**{name: np.array(raw[name], np.int64).reshape(shape) for name, shape in shapes.items()})


def read_tree(bits: k.BoolDecoder, tree, probs):
    while isinstance(tree, tuple):
        tree = tree[1 + bits.get(int(probs[tree[0]]))]
    return tree


def paths(tree, so_far=()) -> dict:
    """Leaf: the (probability index, bit) steps that lead to it."""
    if not isinstance(tree, tuple):
        return {tree: so_far}
    return paths(tree[1], (*so_far, (tree[0], 0))) | paths(tree[2], (*so_far, (tree[0], 1)))


def write_tree(out: k.BoolEncoder, steps, probs) -> None:
    for i, bit in steps:
        out.put(bit, int(probs[i]))


@dataclass
class Header:
    width: int
    height: int
    profile: int = 0
    show: bool = True
    color_space: int = 0
    clamp: int = 0
    segments: bool = False
    update_map: bool = False
    absolute: bool = False
    segment_q: list[int] = field(default_factory=lambda: [0] * 4)
    segment_level: list[int] = field(default_factory=lambda: [0] * 4)
    segment_probs: list[int] = field(default_factory=lambda: [255] * 3)
    simple: bool = False
    level: int = 0
    sharpness: int = 0
    deltas: bool = False
    ref_delta: list[int] = field(default_factory=lambda: [0] * 4)
    mode_delta: list[int] = field(default_factory=lambda: [0] * 4)
    partitions: int = 1
    q: int = 0
    q_delta: list[int] = field(default_factory=lambda: [0] * 5)  # y dc, y2 dc, y2 ac, uv dc, uv ac
    probs: np.ndarray | None = None
    skip_prob: int | None = None


def read_header(data: bytes, tables: Tables) -> tuple[Header, k.BoolDecoder, int]:
    """The header, the decoder of the first partition behind it, and where the other partitions start."""
    if len(data) < 10 or data[3:6] != b"\x9d\x01\x2a":
        raise WebpError("no lossy key frame")
    tag = int.from_bytes(data[:3], "little")
    h = Header(int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF, tag >> 1 & 7, bool(tag >> 4 & 1))
    if tag & 1 or h.profile > 3 or not h.width or not h.height or not h.show:
        raise WebpError("not a key frame that can be shown")
    rest = 10 + (tag >> 5)
    if rest > len(data):
        raise WebpError("the first partition is cut off")
    bits = k.BoolDecoder(data[10:rest])
    h.color_space, h.clamp, h.segments = bits.get(), bits.get(), bool(bits.get())
    if h.segments:
        h.update_map, data_too = bool(bits.get()), bits.get()
        if data_too:
            h.absolute = bool(bits.get())
            h.segment_q, h.segment_level = [bits.signed(7) for _ in range(4)], [bits.signed(6) for _ in range(4)]
        if h.update_map:
            h.segment_probs = [bits.literal(8) if bits.get() else 255 for _ in range(3)]
    h.simple, h.level, h.sharpness, h.deltas = bool(bits.get()), bits.literal(6), bits.literal(3), bool(bits.get())
    if h.deltas and bits.get():
        h.ref_delta, h.mode_delta = [bits.signed(6) for _ in range(4)], [bits.signed(6) for _ in range(4)]
    h.partitions, h.q = 1 << bits.literal(2), bits.literal(7)
    h.q_delta = [bits.signed(4) for _ in range(5)]
    bits.get()  # whether probabilities outlive the frame: there is only one
    h.probs = tables.coefficients.copy()
    for at in np.ndindex(h.probs.shape):
        if bits.get(int(tables.updates[at])):
            h.probs[at] = bits.literal(8)
    if bits.get():
        h.skip_prob = bits.literal(8)
    return h, bits, rest


def steps_of(h: Header, q: int, tables: Tables) -> dict[str, tuple[int, int]]:
    """Quantiser steps (first coefficient, others) of luma, second-order luma and chroma."""
    at = lambda i, top=127: min(top, max(0, q + h.q_delta[i] if i >= 0 else q))
    return {"y": (int(tables.dc[at(0)]), int(tables.ac[at(-1)])), "y2": (2 * int(tables.dc[at(1)]), max(8, int(tables.ac[at(2)]) * 155 // 100)), "uv": (int(tables.dc[at(3, 117)]), int(tables.ac[at(4)]))}


def read_block(bits: k.BoolDecoder, probs: np.ndarray, first: int, context: int, step: tuple[int, int], out: np.ndarray) -> bool:
    """Coefficients of one block into ``out``; whether it has any token but the end."""
    n, fresh, some = first, True, False
    while n < 16:
        p = probs[BANDS[n]][context]
        if fresh and not bits.get(int(p[0])):
            return some
        some = True
        if not bits.get(int(p[1])):
            n, fresh, context = n + 1, False, 0
            continue
        leaf = read_tree(bits, NONZERO_TREE, p)
        if leaf in EXTRA:
            base, each = EXTRA[leaf]
            value = 0
            for q in each:
                value = 2 * value + bits.get(q)
            value += base
        else:
            value = leaf
        context = 1 if value == 1 else 2
        out[ZIGZAG[n]] = (-value if bits.get() else value) * step[n > 0]
        n, fresh = n + 1, True
    return some


def _sub_weights() -> dict[str, np.ndarray]:
    """Sub-block predictions as weights on the 13 pixels around: left from below, corner, eight above.

    A whole number stands for the smoothed pixel of that place, a half for the mean of two; places
    beyond the ends are the ends."""
    r, c = np.divmod(np.arange(16), 4)
    centre = {
        "ve": 5 + c,
        "he": 3 - r,
        "ld": 6 + r + c,
        "rd": 4 - r + c,
        "vr": [4.5, 5.5, 6.5, 7.5, 4, 5, 6, 7, 3, 4.5, 5.5, 6.5, 2, 4, 5, 6],
        "vl": [5.5, 6.5, 7.5, 8.5, 6, 7, 8, 9, 6.5, 7.5, 8.5, 10, 7, 8, 9, 11],
        "hd": [3.5, 4, 5, 6, 2.5, 3, 3.5, 4, 1.5, 2, 2.5, 3, 0.5, 1, 1.5, 2],
        "hu": [2.5, 2, 1.5, 1, 1.5, 1, 0.5, 0, 0.5, 0, -1, -1, -1, -1, -1, -1],
    }
    out = {}
    for name, places in centre.items():
        w = np.zeros((16, 13), np.int64)
        for i, p in enumerate(places):
            taps = ((p - 0.5, 2), (p + 0.5, 2)) if p % 1 else ((p - 1, 1), (p, 2), (p + 1, 1))
            for at, weight in taps:
                w[i, min(12, max(0, int(at)))] += weight
        out[name] = w
    return out


SUB_WEIGHTS = _sub_weights()


def predict_square(plane: np.ndarray, y: int, x: int, size: int, mode: str) -> np.ndarray:
    """Prediction of a luma or chroma square; the plane has a border row and column."""
    top, left, corner = plane[y - 1, x : x + size], plane[y : y + size, x - 1], plane[y - 1, x - 1]
    if mode == V:
        return np.broadcast_to(top, (size, size))
    if mode == H:
        return np.broadcast_to(left[:, None], (size, size))
    if mode == TM:
        return np.clip(left[:, None] + top[None] - corner, 0, 255)
    edges = ([top] if y > 1 else []) + ([left] if x > 1 else [])
    n = size * len(edges)
    return np.full((size, size), (sum(int(e.sum()) for e in edges) + n // 2) // n if n else 128)


def predict_sub(around: np.ndarray, mode: str) -> np.ndarray:
    if mode == "dc":
        return np.full((4, 4), (int(around[:4].sum() + around[5:9].sum()) + 4) >> 3)
    if mode == "tm":
        return np.clip(around[3::-1][:, None] + around[5:9][None] - around[4], 0, 255)
    return ((SUB_WEIGHTS[mode] @ around + 2) >> 2).reshape(4, 4)


def bordered(rows: int, columns: int) -> np.ndarray:
    """A plane with 127 above and 129 to its left."""
    out = np.zeros((rows + 1, columns + 1), np.int64)
    out[1:, 0] = 129
    out[0] = 127
    return out


def decode(data: bytes, tables: Tables) -> Image:
    """RGBA of a key frame, opaque."""
    h, bits, at = read_header(data, tables)
    mw, mh = (h.width + 15) >> 4, (h.height + 15) >> 4
    parts, start = [], at + 3 * (h.partitions - 1)
    if start > len(data):
        raise WebpError("the partitions' sizes are cut off")
    for i in range(h.partitions):
        size = int.from_bytes(data[at + 3 * i : at + 3 * i + 3], "little") if i < h.partitions - 1 else len(data)
        parts.append(k.BoolDecoder(data[start : start + size]))
        start += size
    planes = {"y": bordered(16 * mh, 16 * mw), "u": bordered(8 * mh, 8 * mw), "v": bordered(8 * mh, 8 * mw)}
    quants = [steps_of(h, (s if h.absolute else h.q + s) if h.segments else h.q, tables) for s in h.segment_q]
    above_modes = [["dc"] * 4 for _ in range(mw)]
    above_some = [{"y": [0] * 4, "u": [0] * 2, "v": [0] * 2, "y2": [0]} for _ in range(mw)]
    filters = []
    for my in range(mh):
        left_modes, left_some = ["dc"] * 4, {"y": [0] * 4, "u": [0] * 2, "v": [0] * 2, "y2": [0]}
        for mx in range(mw):
            segment = 0
            if h.update_map:
                p = h.segment_probs
                segment = 2 + bits.get(p[2]) if bits.get(p[0]) else bits.get(p[1])
            skip = bool(bits.get(h.skip_prob)) if h.skip_prob is not None else False
            luma = read_tree(bits, LUMA_TREE, LUMA_PROBS)
            subs: list[str] = []
            if luma == B:
                for i in range(16):
                    up, side = above_modes[mx][i % 4], left_modes[i // 4]
                    mode = read_tree(bits, SUB_TREE, tables.sub_modes[SUB_MODES.index(up), SUB_MODES.index(side)])
                    above_modes[mx][i % 4] = left_modes[i // 4] = mode
                    subs.append(mode)
            else:
                above_modes[mx], left_modes = [IMPLIED[luma]] * 4, [IMPLIED[luma]] * 4
            chroma = read_tree(bits, CHROMA_TREE, CHROMA_PROBS)
            blocks = {"y": np.zeros((16, 16), np.int64), "u": np.zeros((4, 16), np.int64), "v": np.zeros((4, 16), np.int64)}
            some = False
            if skip:
                for side in (above_some[mx], left_some):
                    for name in ("y", "u", "v"):
                        side[name][:] = [0] * len(side[name])
                    if luma != B:
                        side["y2"][0] = 0
            else:
                some = _residuals(parts[my % h.partitions], h.probs, quants[segment], luma, above_some[mx], left_some, blocks)
            _rebuild(planes, mx, my, mw, luma, subs, chroma, blocks)
            level = (h.segment_level[segment] if h.absolute else h.level + h.segment_level[segment]) if h.segments else h.level
            if h.deltas:
                level += h.ref_delta[0] + (h.mode_delta[0] if luma == B else 0)
            filters.append((k.filter_strength(level, h.sharpness), min(63, max(0, level)), some or luma == B))
    if h.level:
        filter_frame(planes, mw, filters, h.simple)
    y = planes["y"][1 : h.height + 1, 1 : h.width + 1]
    u, v = (k.upsample(planes[c][1:, 1:], h.width, h.height) for c in "uv")
    rgba = np.full((h.height, h.width, 4), 255, np.uint8)
    rgba[..., :3] = k.yuv_to_rgb(y, u, v)
    return Image(rgba.tobytes(), h.width, h.height, False)


def _residuals(bits, probs, quant, luma, above, left, blocks) -> bool:
    some, first, kind = False, 0, 3
    if luma != B:
        dc = np.zeros(16, np.int64)
        found = read_block(bits, probs[1], 0, above["y2"][0] + left["y2"][0], quant["y2"], dc)
        above["y2"][0] = left["y2"][0] = int(found)
        some |= found
        blocks["y"][:, 0] = k.inverse_wht(dc.reshape(4, 4)).ravel()
        first, kind = 1, 0
    for name, side, kind_of, start in (("y", 4, kind, first), ("u", 2, 2, 0), ("v", 2, 2, 0)):
        for i in range(side * side):
            r, c = divmod(i, side)
            found = read_block(bits, probs[kind_of], start, above[name][c] + left[name][r], quant["y" if name == "y" else "uv"], blocks[name][i])
            above[name][c] = left[name][r] = int(found)
            some |= found
    return some


def _rebuild(planes, mx, my, mw, luma, subs, chroma, blocks) -> None:
    plane, y0, x0 = planes["y"], 16 * my + 1, 16 * mx + 1
    rest = k.inverse_dct(blocks["y"].reshape(16, 4, 4))
    if luma == B:
        beyond = plane[y0 - 1, x0 + 16 : x0 + 20] if mx < mw - 1 else np.full(4, 127 if my == 0 else plane[y0 - 1, x0 + 15])
        for i, mode in enumerate(subs):
            y, x = y0 + 4 * (i // 4), x0 + 4 * (i % 4)
            right = beyond if i % 4 == 3 else plane[y - 1, x + 4 : x + 8]
            around = np.concatenate([plane[y : y + 4, x - 1][::-1], plane[y - 1, x - 1 : x + 4], right])
            plane[y : y + 4, x : x + 4] = np.clip(predict_sub(around, mode) + rest[i], 0, 255)
    else:
        whole = rest.reshape(4, 4, 4, 4).transpose(0, 2, 1, 3).reshape(16, 16)
        plane[y0 : y0 + 16, x0 : x0 + 16] = np.clip(predict_square(plane, y0, x0, 16, luma) + whole, 0, 255)
    for name in "uv":
        plane, y0, x0 = planes[name], 8 * my + 1, 8 * mx + 1
        whole = k.inverse_dct(blocks[name].reshape(4, 4, 4)).reshape(2, 2, 4, 4).transpose(0, 2, 1, 3).reshape(8, 8)
        plane[y0 : y0 + 8, x0 : x0 + 8] = np.clip(predict_square(plane, y0, x0, 8, chroma) + whole, 0, 255)


def filter_frame(planes: dict[str, np.ndarray], mw: int, filters: list, simple: bool) -> None:
    """Smooth block edges in place, macroblock by macroblock: left, inner upright, top, inner level edges."""
    for i, ((edge, inner, hev), level, has_inner) in enumerate(filters):
        if not level:
            continue
        my, mx = divmod(i, mw)
        for name, size in (("y", 16), ("u", 8), ("v", 8)):
            if simple and name != "y":
                continue
            y, x = size * my + 1, size * mx + 1
            for turned in (False, True):
                plane, r, c = (planes[name].T, x, y) if turned else (planes[name], y, x)
                for offset in range(0, size, 4):
                    if offset == 0 and c == 1 or offset and not has_inner:
                        continue
                    span = plane[r : r + size, c + offset - 4 : c + offset + 4]
                    filter_edge(span, edge + 4 if offset == 0 else edge, inner, hev, offset == 0, simple)


def filter_edge(span: np.ndarray, edge: int, inner: int, hev: int, outer: bool, simple: bool) -> None:
    """Filter rows of eight pixels across an edge in their middle, in place."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (span[:, i].copy() for i in range(8))
    on = 2 * np.abs(p0 - q0) + (np.abs(p1 - q1) >> 1) <= edge
    if not simple:
        for a, b in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0)):
            on &= np.abs(a - b) <= inner
    clip = lambda v: np.clip(v, -128, 127)
    rough = (np.abs(p1 - p0) > hev) | (np.abs(q1 - q0) > hev)
    if simple:
        rough = np.ones_like(on)
    slope = 3 * (q0 - p0)

    def move(where: np.ndarray, shift: np.ndarray, p: int, q: int, back: np.ndarray | None = None) -> None:
        for at, d in ((p, shift if back is None else back), (q, -shift)):
            v = np.clip(span[:, at] - 128 + d, -128, 127) + 128
            span[:, at] = np.where(where, v, span[:, at])

    strong = clip(clip(p1 - q1) + slope)
    near = on & rough
    move(near, clip(strong + 4) >> 3, 3, 4, clip(strong + 3) >> 3)
    smooth = on & ~rough
    if outer and not simple:
        for weight, p, q in ((27, 3, 4), (18, 2, 5), (9, 1, 6)):
            move(smooth, clip((weight * strong + 63) >> 7), p, q)
    elif not simple:
        weak = clip(slope)
        move(smooth, clip(weak + 4) >> 3, 3, 4, clip(weak + 3) >> 3)
        move(smooth, ((clip(weak + 4) >> 3) + 1) >> 1, 2, 5)


_SIZES = [(v, leaf) for leaf, (v, _) in EXTRA.items()]
_NONZERO, _LUMA, _CHROMA = paths(NONZERO_TREE), paths(LUMA_TREE), paths(CHROMA_TREE)


def write_block(out: k.BoolEncoder, levels: list[int], probs: np.ndarray, first: int, context: int) -> bool:
    """Tokens of a block's levels in scan order; whether there is any but the end."""
    last = max((i for i in range(first, 16) if levels[i]), default=-1)
    fresh = True
    for n in range(first, last + 1):
        p = probs[BANDS[n]][context]
        if fresh:
            out.put(1, int(p[0]))
        v = abs(levels[n])
        out.put(int(v > 0), int(p[1]))
        fresh = v > 0
        if v:
            leaf = v if v <= 4 else max((b, x) for b, x in _SIZES if b <= v)[1]
            write_tree(out, _NONZERO[leaf], p)
            if v > 4:
                base, each = EXTRA[leaf]
                for i, q in enumerate(each):
                    out.put(v - base >> (len(each) - 1 - i) & 1, q)
            out.put(int(levels[n] < 0))
        context = min(v, 2)
    if last < 15:
        out.put(0, int(probs[BANDS[max(last + 1, first)]][context][0]))
    return last >= first


def encode(image: Image, q: int, tables: Tables) -> bytes:
    """A key frame: mean prediction throughout, one segment, one token partition, no filter."""
    if not (0 < image.width < 16384 and 0 < image.height < 16384):
        raise WebpError("a side must be 1 to 16383 pixels")
    if len(image.data) < 4 * image.width * image.height:
        raise WebpError("fewer pixels than width times height")
    rgba = np.frombuffer(image.data[: 4 * image.width * image.height], np.uint8).reshape(image.height, image.width, 4)
    source = dict(zip("yuv", (p.astype(np.int64) for p in k.rgb_to_yuv(rgba)), strict=True))
    mh, mw = source["y"].shape[0] // 16, source["y"].shape[1] // 16
    head, tokens = k.BoolEncoder(), k.BoolEncoder()
    for value, size in ((0, 1), (0, 1), (0, 1), (0, 1), (0, 6), (0, 3), (0, 1), (0, 2), (q, 7)):
        head.literal(value, size)
    for _ in range(5):
        head.put(0)
    head.put(0)
    for p in tables.updates.ravel().tolist():
        head.put(0, p)
    head.put(0)
    step = steps_of(Header(image.width, image.height), q, tables)
    planes = {"y": bordered(16 * mh, 16 * mw), "u": bordered(8 * mh, 8 * mw), "v": bordered(8 * mh, 8 * mw)}
    above = [{"y": [0] * 4, "u": [0] * 2, "v": [0] * 2, "y2": 0} for _ in range(mw)]
    scan = np.array(ZIGZAG)
    for my in range(mh):
        left = {"y": [0] * 4, "u": [0] * 2, "v": [0] * 2, "y2": 0}
        for mx in range(mw):
            write_tree(head, _LUMA[DC], LUMA_PROBS)
            write_tree(head, _CHROMA[DC], CHROMA_PROBS)
            for name, size in (("y", 16), ("u", 8), ("v", 8)):
                side = size // 4
                y0, x0 = size * my + 1, size * mx + 1
                guess = predict_square(planes[name], y0, x0, size, DC)
                rest = source[name][size * my : size * my + size, size * mx : size * mx + size] - guess
                c = k.forward_dct(rest.reshape(side, 4, side, 4).transpose(0, 2, 1, 3).reshape(-1, 4, 4)).reshape(-1, 16)
                dc_step, ac_step = step["y" if name == "y" else "uv"]
                level, back = k.quantise(c, ac_step)
                if name == "y":
                    second = k.forward_wht(c[:, 0].reshape(4, 4)).ravel()
                    dc_level, dc_back = k.quantise(second, step["y2"][1])
                    dc_level[0], dc_back[0] = (int(v[0]) for v in k.quantise(second[:1], step["y2"][0]))
                    found = write_block(tokens, dc_level[scan].tolist(), tables.coefficients[1], 0, above[mx]["y2"] + left["y2"])
                    above[mx]["y2"] = left["y2"] = int(found)
                    back[:, 0] = k.inverse_wht(dc_back.reshape(4, 4)).ravel()
                else:
                    level[:, 0], back[:, 0] = k.quantise(c[:, 0], dc_step)
                kind, first = (0, 1) if name == "y" else (2, 0)
                for i, row in enumerate(level[:, scan].tolist()):
                    r, col = divmod(i, side)
                    found = write_block(tokens, row, tables.coefficients[kind], first, above[mx][name][col] + left[name][r])
                    above[mx][name][col] = left[name][r] = int(found)
                whole = k.inverse_dct(back.reshape(-1, 4, 4)).reshape(side, side, 4, 4).transpose(0, 2, 1, 3).reshape(size, size)
                planes[name][y0 : y0 + size, x0 : x0 + size] = np.clip(guess + whole, 0, 255)
    first_part = head.finish()
    if len(first_part) >= 1 << 19:
        raise WebpError("the first partition is too large")
    tag = (len(first_part) << 5 | 1 << 4).to_bytes(3, "little")
    return tag + b"\x9d\x01\x2a" + image.width.to_bytes(2, "little") + image.height.to_bytes(2, "little") + first_part + tokens.finish()
