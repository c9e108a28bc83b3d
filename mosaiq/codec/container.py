"""Whole files: dispatch by chunk, extended headers, alpha and animation frames."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from mosaiq.codec import WebpError, batch, lossless, lossy_stream, riff
from mosaiq.codec.alpha import decode_alpha, encode_alpha
from mosaiq.codec.lossless import Image, Options


def quality_index(quality: float = 75) -> int:
    """Quantiser index, 0 finest to 127, of a quality from 0 to 100; halves round up."""
    return math.floor(127 - min(100.0, max(0.0, quality)) / 100 * 127 + 0.5)


def has_translucency(data: bytes) -> bool:
    return bool((np.frombuffer(data, np.uint8)[3::4] != 255).any())


def encode(image: Image, options: Options = Options(), extended: bool = False) -> bytes:
    """A file with one lossless chunk; ``extended`` puts a header with an alpha flag before it."""
    return _file(image, lossless.encode(image, options), extended)


def encode_many(images: list[Image], options: Options = Options(), extended: bool = False) -> list[bytes]:
    """encode() of many images together."""
    return [_file(i, p, extended) for i, p in zip(images, batch.encode(images, options), strict=True)]


def encode_both(images: list[Image], options: Options = Options()) -> list[tuple[bytes, bytes]]:
    """Of each image its file without and with an extended header; pixels are coded once."""
    return [(_file(i, p, False), _file(i, p, True)) for i, p in zip(images, batch.encode(images, options), strict=True)]


def _file(image: Image, payload: bytes, extended: bool) -> bytes:
    chunks = [("VP8L", payload)]
    if extended:
        chunks.insert(0, ("VP8X", riff.vp8x(image.width, image.height, has_translucency(image.data))))
    return riff.build_riff(chunks)


def encode_animation(frames: list[tuple[Image, dict]], width: int, height: int, loops: int = 0, background: int = 0) -> bytes:
    """Lossless frames with their places: x, y, duration_ms, blend, dispose."""
    return encode_animations([(frames, width, height, loops, background)])[0]


def encode_animations(animations: list[tuple[list[tuple[Image, dict]], int, int, int, int]]) -> list[bytes]:
    """encode_animation() of many; an image that stands in several frames is coded once."""
    images = {id(image): image for frames, *_ in animations for image, _ in frames}
    coded = dict(zip(images, batch.encode(list(images.values())), strict=True))
    return [_animation([(i, coded[id(i)], place) for i, place in frames], *rest) for frames, *rest in animations]


def _animation(frames: list[tuple[Image, bytes, dict]], width: int, height: int, loops: int = 0, background: int = 0) -> bytes:
    b, g, r, a = (background >> s & 255 for s in (0, 8, 16, 24))
    chunks = [("VP8X", riff.vp8x(width, height, True, True)), ("ANIM", bytes([b, g, r, a]) + loops.to_bytes(2, "little"))]
    for image, data, place in frames:
        own = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
        chunks.append(("ANMF", riff.frame_chunk(own, width=image.width, height=image.height, **place)))
    return riff.build_riff(chunks)


@cache
def lossy_tables(path: str) -> lossy_stream.Tables:
    return lossy_stream.Tables.load(path)


def encode_lossy(image: Image, quality: float, tables: str) -> bytes:
    """A lossy file; translucent images get an extended header and an alpha chunk before the pixels."""
    chunks = [("VP8 ", lossy_stream.encode(image, quality_index(quality), lossy_tables(tables)))]
    if has_translucency(image.data):
        plane = np.frombuffer(image.data, np.uint8)[3 : 4 * image.width * image.height : 4]
        chunks = [("VP8X", riff.vp8x(image.width, image.height, True)), ("ALPH", encode_alpha(plane, image.width, image.height)), *chunks]
    return riff.build_riff(chunks)


def decode_chunks(chunks: list[riff.Chunk], max_pixels: int, strict: bool = False, tables: str | None = None) -> Image:
    """Lossless data first; else lossy data, with the alpha chunk wherever it stands."""
    first = {c.four_cc: bytes(c.data) for c in reversed(chunks)}
    if "VP8L" in first:
        return lossless.decode(first["VP8L"], max_pixels, strict)
    if "VP8 " in first:
        info = riff.vp8_info(first["VP8 "])
        if info.width * info.height > max_pixels:
            raise WebpError(f"{info.width} x {info.height} is more than {max_pixels} pixels")
        if tables is None:
            raise WebpError("lossy data need a table file of the format's probabilities")
        image = lossy_stream.decode(first["VP8 "], lossy_tables(tables))
        if "ALPH" not in first:
            return image
        rgba = np.frombuffer(image.data, np.uint8).reshape(-1, 4).copy()
        rgba[:, 3] = decode_alpha(first["ALPH"], image.width, image.height)
        return Image(rgba.tobytes(), image.width, image.height, True)
    raise WebpError("no image data")


def decode(content: bytes, form: str = "rgba", max_pixels: int = lossless.MAX_SIDE**2, strict: bool = False, tables: str | None = None) -> Image:
    image = decode_chunks(riff.parse_riff(content), max_pixels, strict, tables)
    return image if form == "rgba" else Image(rgb_of(image.data), image.width, image.height, image.has_alpha)


def decode_many(contents: list[bytes], form: str = "rgba", max_pixels: int = lossless.MAX_SIDE**2, strict: bool = False, tables: str | None = None) -> list[Image | WebpError]:
    """decode() of many files together; an error in place of an image that can't be read."""
    parsed: list = []
    for c in contents:
        try:
            parsed.append(riff.parse_riff(c))
        except WebpError as e:
            parsed.append(e)
    out = decode_chunks_many(parsed, max_pixels, strict, tables)
    return [i if isinstance(i, WebpError) or form == "rgba" else Image(rgb_of(i.data), i.width, i.height, i.has_alpha) for i in out]


def decode_chunks_many(parsed: list[list[riff.Chunk] | WebpError], max_pixels: int, strict: bool = False, tables: str | None = None) -> list[Image | WebpError]:
    """decode_chunks() of many; errors stay."""
    first = [None if isinstance(chunks, WebpError) else next((bytes(c.data) for c in chunks if c.four_cc == "VP8L"), None) for chunks in parsed]
    mine = [i for i, d in enumerate(first) if d is not None]
    found = dict(zip(mine, batch.decode([first[i] for i in mine], max_pixels, strict), strict=True))
    out: list = []
    for i, chunks in enumerate(parsed):
        if i in found or isinstance(chunks, WebpError):
            out.append(found.get(i, chunks))
            continue
        try:
            out.append(decode_chunks(chunks, max_pixels, strict, tables))
        except (WebpError, IndexError) as e:
            out.append(e if isinstance(e, WebpError) else WebpError(str(e)))
    return out


def rgb_of(rgba: bytes) -> bytes:
    return np.frombuffer(rgba, np.uint8).reshape(-1, 4)[:, :3].tobytes()


def decode_frame(frame: riff.Frame, max_pixels: int = lossless.MAX_SIDE**2, tables: str | None = None) -> Image:
    image = decode_frames([frame], max_pixels, tables)[0]
    if isinstance(image, WebpError):
        raise image
    return image


def decode_frames(frames: list[riff.Frame], max_pixels: int = lossless.MAX_SIDE**2, tables: str | None = None) -> list[Image | WebpError]:
    """decode_frame() of many; an error in place of a frame that can't be read."""
    out = decode_chunks_many([f.chunks for f in frames], max_pixels, tables=tables)
    return [WebpError("a frame's image has another size than its frame") if not isinstance(i, WebpError) and (i.width, i.height) != (f.width, f.height) else i for i, f in zip(out, frames, strict=True)]


__all__ = ["Image", "Options", "decode", "decode_frame", "encode", "encode_alpha", "encode_animation", "encode_lossy"]
