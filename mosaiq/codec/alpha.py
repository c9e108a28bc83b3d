"""The alpha chunk: raw or losslessly coded planes and their row filters."""

from __future__ import annotations

import numpy as np

from mosaiq.codec import WebpError, batch, lossless
from mosaiq.codec.bits import BitReader


def decode_alphas(data: list[bytes], width: list[int], height: list[int]) -> list[np.ndarray | WebpError]:
    """decode_alpha of many chunks; an error in place of a plane that can't be read."""
    out: list = [None] * len(data)
    coded = [i for i, d in enumerate(data) if len(d) and d[0] & 3 == 1 and not d[0] >> 6 and 0 < width[i] * height[i] <= batch.LARGEST]
    for some in batch.chunks([width[i] * height[i] for i in coded]):
        some = [coded[k] for k in some]
        found = batch.decode_streams([bytes(data[i][1:]) for i in some], np.array([width[i] for i in some]), np.array([height[i] for i in some]))
        for i, px in zip(some, found, strict=True):
            if px is not None:
                out[i] = unfilter((px >> np.uint32(8) & np.uint32(255)).astype(np.uint8), data[i][0] >> 2 & 3, width[i], height[i])
    for i, plane in enumerate(out):
        if plane is None:
            try:
                out[i] = decode_alpha(data[i], width[i], height[i])
            except (WebpError, IndexError) as e:
                out[i] = e if isinstance(e, WebpError) else WebpError(str(e))
    return out


def decode_alpha(data: bytes, width: int, height: int) -> np.ndarray:
    """The alpha plane. Pre-processing is a hint for players and not undone."""
    if not len(data):
        raise WebpError("empty alpha chunk")
    method, kind = data[0] & 3, data[0] >> 2 & 3
    if data[0] >> 6:
        raise WebpError("reserved bits of the alpha chunk are set")
    if method == 0:
        if len(data) - 1 < width * height:
            raise WebpError("alpha plane is too short")
        plane = np.frombuffer(bytes(data[1 : 1 + width * height]), np.uint8)
    elif method == 1:
        plane = (lossless.decode_stream(BitReader(bytes(data[1:])), width, height) >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
    else:
        raise WebpError("unknown alpha compression")
    return unfilter(plane, kind, width, height)


def unfilter(plane: np.ndarray, kind: int, width: int, height: int) -> np.ndarray:
    """Undo a row filter: 0 none, 1 horizontal, 2 vertical, 3 gradient."""
    v = plane.reshape(height, width).astype(np.int64)
    if kind == 0:
        return plane
    if kind == 1:  # a row starts from the pixel above, so first columns add up downwards
        v[:, 0] = np.cumsum(v[:, 0])
        return (np.cumsum(v, axis=1) & 255).astype(np.uint8).ravel()
    v[0] = np.cumsum(v[0]) & 255
    if kind == 2:
        return (np.cumsum(v, axis=0) & 255).astype(np.uint8).ravel()
    rows = v.tolist()
    for above, row in zip(rows, rows[1:], strict=False):
        row[0] = (row[0] + above[0]) & 255
        for x in range(1, width):
            row[x] = (row[x] + min(255, max(0, row[x - 1] + above[x] - above[x - 1]))) & 255
    return np.array(rows, np.uint8).ravel()


def _as_green(plane: np.ndarray, width: int, height: int) -> lossless.Image:
    rgba = np.zeros((width * height, 4), np.uint8)
    rgba[:, 1], rgba[:, 3] = plane, 255
    return lossless.Image(rgba.tobytes(), width, height)


def encode_alpha(plane: np.ndarray, width: int, height: int) -> bytes:
    """Losslessly coded, unfiltered: the plane as the green channel of an image without its header."""
    return b"\1" + lossless.encode(_as_green(plane, width, height))[5:]


def encode_alphas(planes: list[np.ndarray], width: list[int], height: list[int]) -> list[bytes]:
    """encode_alpha of many planes."""
    return [b"\1" + x[5:] for x in batch.encode([_as_green(*x) for x in zip(planes, width, height, strict=True)])]
