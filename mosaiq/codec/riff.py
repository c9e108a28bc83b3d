"""The container: chunks, image facts, extended header and animation frames."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from mosaiq.codec import WebpError


@dataclass(frozen=True)
class Chunk:
    four_cc: str
    size: int  # as declared
    offset: int  # of the payload
    data: memoryview  # what the file has of it


@dataclass(frozen=True)
class Info:
    width: int
    height: int
    has_alpha: bool
    is_lossless: bool
    has_animation: bool
    is_extended: bool


def parse_riff(content: bytes) -> list[Chunk]:
    """All chunks to the end of the file. A payload that is cut off is given as far as it goes; the size
    in the file's own header is not relied on."""
    view = memoryview(content)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WEBP":
        raise WebpError("not a RIFF file of type WEBP")
    out, at = [], 12
    while at + 8 <= len(view):
        (size,) = struct.unpack_from("<I", view, at + 4)
        out.append(Chunk(bytes(view[at : at + 4]).decode("latin-1"), size, at + 8, view[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def build_riff(chunks: list[tuple[str, bytes]]) -> bytes:
    body = b"WEBP" + b"".join(c.encode("latin-1") + struct.pack("<I", len(d)) + bytes(d) + b"\0" * (len(d) % 2) for c, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def u24(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 3], "little")


def vp8x(width: int, height: int, alpha: bool, animation: bool = False) -> bytes:
    """The payload of an extended header."""
    return bytes([16 * alpha + 2 * animation, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def vp8l_info(data: bytes) -> Info:
    if len(data) < 5 or data[0] != 0x2F:
        raise WebpError("lossless chunk without its signature")
    bits = int.from_bytes(data[1:5], "little")
    return Info((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, bool(bits >> 28 & 1), True, False, False)


def vp8_info(data: bytes) -> Info:
    if len(data) < 10:
        raise WebpError("lossy chunk is shorter than its header")
    if data[0] & 1:
        raise WebpError("lossy chunk doesn't hold a key frame")
    if bytes(data[3:6]) != b"\x9d\x01\x2a":
        raise WebpError("lossy chunk without its start code")
    width, height = struct.unpack_from("<HH", data, 6)
    return Info(width & 0x3FFF, height & 0x3FFF, False, False, False, False)


def image_info(chunks: list[Chunk]) -> Info:
    """Facts from the headers alone: of an extended header first, then of lossless, then of lossy data."""
    first = {c.four_cc: c.data for c in reversed(chunks)}
    if "VP8X" in first:
        data = first["VP8X"]
        if len(data) < 10:
            raise WebpError("extended header is too short")
        return Info(u24(data, 4) + 1, u24(data, 7) + 1, bool(data[0] & 16), False, bool(data[0] & 2), True)
    if "VP8L" in first:
        return vp8l_info(first["VP8L"])
    if "VP8 " in first:
        return vp8_info(first["VP8 "])
    raise WebpError("no image data")


@dataclass(frozen=True)
class Frame:
    x: int
    y: int
    width: int
    height: int
    duration_ms: int
    blend: str
    dispose: str
    chunks: list[Chunk]


@dataclass(frozen=True)
class Animation:
    width: int
    height: int
    loop_count: int
    background_argb: int
    frames: list[Frame]


def sub_chunks(data: memoryview, base: int) -> list[Chunk]:
    out, at = [], 0
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        out.append(Chunk(bytes(data[at : at + 4]).decode("latin-1"), size, base + at + 8, data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def parse_animation(content: bytes) -> Animation:
    """Canvas, loop count, background and the frames in order; frames are not composed."""
    chunks = parse_riff(content)
    head = next((c.data for c in chunks if c.four_cc == "VP8X"), None)
    if head is None or len(head) < 10 or not head[0] & 2:
        raise WebpError("not an animation")
    background, loops = 0, 0
    frames = []
    for c in chunks:
        if c.four_cc == "ANIM" and len(c.data) >= 6:
            b, g, r, a, loops = struct.unpack_from("<4BH", c.data)
            background = a << 24 | r << 16 | g << 8 | b
        elif c.four_cc == "ANMF":
            if len(c.data) < 16:
                raise WebpError("animation frame is too short")
            flags = c.data[15]
            frames.append(Frame(2 * u24(c.data, 0), 2 * u24(c.data, 3), u24(c.data, 6) + 1, u24(c.data, 9) + 1, u24(c.data, 12), "replace" if flags & 2 else "overlay", "background" if flags & 1 else "none", sub_chunks(c.data[16:], c.offset + 16)))
    return Animation(u24(head, 4) + 1, u24(head, 7) + 1, loops, background, frames)


def frame_chunk(frame: bytes, x: int, y: int, width: int, height: int, duration_ms: int, blend: str = "overlay", dispose: str = "none") -> bytes:
    """The payload of an animation frame from its image chunks' bytes; offsets are even."""
    numbers = (x // 2, y // 2, width - 1, height - 1, duration_ms)
    return b"".join(n.to_bytes(3, "little") for n in numbers) + bytes([2 * (blend == "replace") + (dispose == "background")]) + frame
