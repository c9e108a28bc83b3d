"""Pixel transforms of the lossless format on packed ARGB words (uint32 arrays)."""

from __future__ import annotations

import numpy as np

from mosaiq.codec import WebpError

BLACK = 0xFF000000


def from_rgba(data: bytes) -> np.ndarray:
    p = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.uint32)
    return p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]


def to_rgba(argb: np.ndarray) -> bytes:
    out = np.empty((len(argb), 4), np.uint8)
    for i, shift in enumerate((16, 8, 0, 24)):
        out[:, i] = argb >> np.uint32(shift) & np.uint32(255)
    return out.tobytes()


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, modulo 256."""
    ag = np.uint32(0xFF00FF00)
    rb = np.uint32(0x00FF00FF)
    return ((a & ag) + (b & ag)) & ag | ((a & rb) + (b & rb)) & rb


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ag, rb = np.uint32(0xFF00FF00), np.uint32(0x00FF00FF)
    return ((a | rb) - (b & ag)) & ag | ((a | ag) - (b & rb)) & rb


def subtract_green(argb: np.ndarray, sign: int = -1) -> np.ndarray:
    """Green off red and blue, or (sign 1) back on."""
    g = argb >> np.uint32(8) & np.uint32(255)
    both = g << np.uint32(16) | g
    return sub(argb, both) if sign < 0 else add(argb, both)


def blocks_of(width: int, height: int, bits: int) -> tuple[int, int, np.ndarray]:
    """Blocks across and down, and each pixel's block."""
    across, down = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(width * height), width)
    return across, down, (y >> bits) * across + (x >> bits)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 0xFF) - ((v & 0x80) << 1)


def color_forward(argb: np.ndarray, width: int, height: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Take what green predicts off red, and what green and red predict off blue; (pixels, block image).

    Coefficients come from -16..16 in steps of 8, the first of those that leave the least sum of
    magnitudes in the block. An element holds red-to-blue in red, green-to-blue in green and
    green-to-red in blue, as the format's specification has it."""
    across, down, block = blocks_of(width, height, bits)
    return color_forward_blocks(argb, block, across * down)


def color_forward_blocks(argb: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for pixels whose blocks are given, of one image or of many."""
    v = argb.astype(np.int64)
    r, g, b = v >> 16 & 255, v >> 8 & 255, v & 255
    sg, sr = _signed(g), _signed(r)
    grid = np.array([-16, -8, 0, 8, 16])

    def cost(left: np.ndarray) -> np.ndarray:
        return np.bincount(block, weights=np.abs(_signed(left)), minlength=blocks)

    g2r = grid[np.argmin([cost(r - (c * sg >> 5)) for c in grid], axis=0)]
    pairs = [(a, c) for a in grid for c in grid]
    best = np.argmin([cost(b - (a * sg >> 5) - (c * sr >> 5)) for a, c in pairs], axis=0)
    g2b, r2b = np.array(pairs).T[:, best]
    r2 = (r - (g2r[block] * sg >> 5)) & 255
    b2 = (b - (g2b[block] * sg >> 5) - (r2b[block] * sr >> 5)) & 255
    image = (0xFF << 24 | (r2b & 255) << 16 | (g2b & 255) << 8 | g2r & 255).astype(np.uint32)
    return ((v & 0xFF00FF00) | r2 << 16 | b2).astype(np.uint32), image


def color_inverse(argb: np.ndarray, image: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    _, _, block = blocks_of(width, height, bits)
    return color_inverse_blocks(argb, image[block])


def color_inverse_blocks(argb: np.ndarray, element: np.ndarray) -> np.ndarray:
    """The same for pixels that have their block's element each."""
    v, e = argb.astype(np.int64), element.astype(np.int64)
    sg = _signed(v >> 8)
    r = ((v >> 16) + (_signed(e) * sg >> 5)) & 255
    b = (v + (_signed(e >> 8) * sg >> 5) + (_signed(e >> 16) * _signed(r) >> 5)) & 255
    return ((v & 0xFF00FF00) | r << 16 | b).astype(np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> np.uint32(1) & np.uint32(0x7F7F7F7F))


def _split(v: np.ndarray) -> np.ndarray:
    return np.stack([v >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)]).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = np.clip(c, 0, 255).astype(np.uint32)
    return c[0] << np.uint32(24) | c[1] << np.uint32(16) | c[2] << np.uint32(8) | c[3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The predictions of one mode from the neighbours: left, top, top right and top left."""
    if mode == 0:
        return np.full_like(left, BLACK)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    ls, ts, cs = _split(left), _split(top), _split(corner)
    if mode == 11:  # the neighbour nearer to left + top - corner
        return np.where(np.abs(ts - cs).sum(0) < np.abs(ls - cs).sum(0), left, top)
    if mode == 12:
        return _join(ls + ts - cs)
    if mode == 13:
        a = (ls + ts) >> 1
        return _join(a + np.sign(a - cs) * (np.abs(a - cs) >> 1))
    raise WebpError(f"predictor mode {mode}")


def neighbours(argb: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Left, top, top right and top left of every pixel, where the first row and column have them."""
    n = len(argb)
    out = []
    for back in (1, width, width - 1, width + 1):
        v = np.zeros(n, np.uint32)
        v[back:] = argb[: n - back] if back else argb
        out.append(v)
    return tuple(out)


def _borders(predicted: np.ndarray, left: np.ndarray, top: np.ndarray, width: int) -> np.ndarray:
    """Black for the first pixel, left in the first row, top in the first column."""
    predicted[:width] = left[:width]
    predicted[::width] = top[::width]
    predicted[0] = BLACK
    return predicted


def predictor_forward(argb: np.ndarray, width: int, height: int, bits: int, modes: tuple[int, ...] = (11,)) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and the block image of modes. Of several modes, each block takes the one that leaves
    the least sum of magnitudes, the first of equals."""
    across, down, block = blocks_of(width, height, bits)
    around = neighbours(argb, width)
    each = [sub(argb, _borders(predict(m, *around), around[0], around[1], width)) for m in modes]
    if len(modes) == 1:
        pick = np.zeros(across * down, np.int64)
    else:
        pick = np.argmin([np.bincount(block, weights=np.abs(_signed(_split(r))).sum(0), minlength=across * down) for r in each], axis=0)
    image = (BLACK | np.array(modes)[pick] << 8).astype(np.uint32)
    return np.choose(pick[block], each).astype(np.uint32) if len(modes) > 1 else each[0], image


def predictor_forward_blocks(argb: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, block: np.ndarray, blocks: int, modes: tuple[int, ...] = (11,)) -> tuple[np.ndarray, np.ndarray]:
    """The same for pixels of many images, one after the other, whose places, widths and blocks are given."""
    i = np.arange(len(argb))
    around = [argb[np.maximum(i - back, 0)] for back in (1, width, width - 1, width + 1)]
    first_row, first_column, first = y == 0, x == 0, (x == 0) & (y == 0)

    def residual(mode: int) -> np.ndarray:
        p = predict(mode, *around)
        p = np.where(first_row, around[0], np.where(first_column, around[1], p))
        p[first] = BLACK
        return sub(argb, p.astype(np.uint32))

    best, out, pick = None, None, np.zeros(blocks, np.int64)
    for k, mode in enumerate(modes):  # the first of equals stays
        r = residual(mode)
        if len(modes) == 1:
            out = r
            break
        cost = np.bincount(block, weights=np.abs(_signed(_split(r))).sum(0), minlength=blocks)
        better = np.ones(blocks, bool) if best is None else cost < best
        best = cost if best is None else np.minimum(cost, best)
        pick[better] = k
        out = r if out is None else np.where(better[block], r, out)
    return out, (BLACK | np.array(modes)[pick] << 8).astype(np.uint32)


def predictor_inverse(residual: np.ndarray, image: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """Pixels from residuals. Pixels with equal x + 2 y don't need one another, so they are done at once."""
    _, _, block = blocks_of(width, height, bits)
    mode = (image >> np.uint32(8) & np.uint32(15)).astype(np.int64)[block]
    if (mode > 13).any():
        raise WebpError("predictor mode beyond 13")
    if min(width // 2, height) < 24:
        return _inverse_narrow(residual, mode, width)
    y, x = np.divmod(np.arange(width * height), width)
    order = np.argsort(x + 2 * y, kind="stable")
    out = residual.copy()
    ends = np.cumsum(np.bincount(x + 2 * y))
    start = 0
    kinds = np.unique(mode).tolist()
    for end in ends.tolist():
        at = order[start:end]
        start = end
        xs, ys = x[at], y[at]
        left, top, right, corner = (out[np.maximum(at - back, 0)] for back in (1, width, width - 1, width + 1))
        if len(kinds) == 1:
            p = predict(kinds[0], left, top, right, corner)
        else:
            m = mode[at]
            p = np.zeros(len(at), np.uint32)
            for k in np.unique(m).tolist():
                on = m == k
                p[on] = predict(k, left[on], top[on], right[on], corner[on])
        p = np.where(ys == 0, left, np.where(xs == 0, top, p))
        if at[0] == 0:
            p[0] = BLACK
        out[at] = add(out[at], p)
    return out


def predictor_inverse_places(residual: np.ndarray, mode: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The same for pixels of many images, one after the other, whose modes, places and widths are given: those with equal x + 2 y
    of all images are done at once. ``known``: pixels that are decoded already."""
    step = x + 2 * y
    order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
    if known is not None:
        order = order[~known[order]]
    out = residual.copy()
    xs, ys, ws, step = x[order], y[order], width[order], step[order]
    ends = np.flatnonzero(np.r_[step[1:] != step[:-1], True]) + 1 if len(step) else order
    kinds = np.unique(mode).tolist()
    start = 0
    for end in ends.tolist():
        at, px, py, w = order[start:end], xs[start:end], ys[start:end], ws[start:end]
        near = [out[np.maximum(at - back, 0)] for back in (1, w, w - 1, w + 1)]
        if len(kinds) == 1:
            p = predict(kinds[0], *near)
        else:
            m = mode[at]
            p = np.zeros(len(at), np.uint32)
            for k in np.unique(m).tolist():
                on = m == k
                p[on] = predict(k, *(v[on] for v in near))
        p = np.where(py == 0, near[0], np.where(px == 0, near[1], p))
        if step[start] == 0:
            p[:] = BLACK
        out[at] = add(out[at], p)
        start = end
    return out


def _inverse_narrow(residual: np.ndarray, mode: np.ndarray, width: int) -> np.ndarray:
    """The same, one pixel after the other, for images too small for array steps."""
    out: list[int] = []
    for i, (r, m) in enumerate(zip(residual.tolist(), mode.tolist(), strict=True)):
        if i == 0:
            p = BLACK
        elif i < width:
            p = out[i - 1]
        elif i % width == 0:
            p = out[i - width]
        elif m == 11:
            left, top, corner = out[i - 1], out[i - width], out[i - width - 1]
            near_left = near_top = 0
            for s in (24, 16, 8, 0):
                c = corner >> s & 255
                near_left += abs((top >> s & 255) - c)
                near_top += abs((left >> s & 255) - c)
            p = left if near_left < near_top else top
        else:
            p = int(predict(m, *(np.array([out[i - b]], np.uint32) for b in (1, width, width - 1, width + 1)))[0])
        out.append(((r & 0xFF00FF00) + (p & 0xFF00FF00)) & 0xFF00FF00 | ((r & 0xFF00FF) + (p & 0xFF00FF)) & 0xFF00FF)
    return np.array(out, np.uint32)


def index_bits(colors: int) -> int:
    """log2 of the pixels that share a byte."""
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def palette_of(argb: np.ndarray) -> np.ndarray:
    """Distinct colours in the order of their first pixels."""
    colors, first = np.unique(argb, return_index=True)
    return colors[np.argsort(first)]


def index_forward(argb: np.ndarray, palette: np.ndarray, width: int, height: int) -> tuple[np.ndarray, int]:
    """Palette indices in green, several in a byte where they fit; (pixels, packed width)."""
    order = np.argsort(palette)
    index = order[np.searchsorted(palette, argb, sorter=order)].reshape(height, width)
    share = index_bits(len(palette))
    packed = -(-width // (1 << share))
    grid = np.zeros((height, packed << share), np.int64)
    grid[:, :width] = index
    shifts = np.arange(1 << share) * (8 >> share)
    green = (grid.reshape(height, packed, 1 << share) << shifts).sum(axis=2)
    return (BLACK | green.ravel() << 8).astype(np.uint32), packed


def index_inverse(argb: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    """Colours again; an index beyond the palette is opaque black."""
    share = index_bits(len(palette))
    green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64).reshape(height, -1)
    shifts = np.arange(1 << share) * (8 >> share)
    index = (green[:, :, None] >> shifts & (255 >> (8 - (8 >> share)))).reshape(height, -1)[:, :width].ravel()
    full = np.full(256, BLACK, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def palette_deltas(palette: np.ndarray) -> np.ndarray:
    return sub(palette, np.concatenate([np.zeros(1, np.uint32), palette[:-1]]))


def palette_sums(deltas: np.ndarray) -> np.ndarray:
    """Running sums, channel by channel."""
    c = np.cumsum(_split(deltas), axis=1) & 255
    return _join(c)
