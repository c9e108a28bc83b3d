"""Codec functions for columns: Arrow-batched, one image a row; register() names them for SQL."""

from __future__ import annotations

import dataclasses
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.codec import WebpError, batch, container, lossless, riff
from mosaiq.codec.alpha import decode_alphas, encode_alphas

IMAGE = "data binary, width int, height int, has_alpha boolean, error string"
MAX_PIXELS = lossless.MAX_SIDE**2  # the format's own limit


def _images(data: pd.Series, width: pd.Series, height: pd.Series) -> list[container.Image | None]:
    return [None if d is None or pd.isna(w) or pd.isna(h) else container.Image(d, int(w), int(h)) for d, w, h in zip(data, width, height, strict=True)]


def _filled(there: list[bool], values: list) -> pd.Series:
    """The values where there are any, nulls elsewhere."""
    found = iter(values)
    return pd.Series([next(found) if t else None for t in there], dtype=object)


def webp_encode(data: Column, width: Column, height: Column, options: lossless.Options = lossless.Options(), extended: bool = False, failfast: bool = True) -> Column:
    """Lossless file of an RGBA image; null for null, or where the image can't be written and not failfast."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def one(i):
            try:
                return container.encode(i, options, extended)
            except WebpError:
                return None

        images = _images(data, width, height)
        there = [i for i in images if i is not None]
        try:
            coded = container.encode_many(there, options, extended)
        except WebpError:
            if failfast:
                raise
            coded = [one(i) for i in there]
        return _filled([i is not None for i in images], coded)

    return run(data, width, height)


def webp_encode_both(data: Column, width: Column, height: Column, options: lossless.Options = lossless.Options()) -> Column:
    """struct(plain, extended): the lossless files of an RGBA image without and with an extended header; nulls for null."""

    @F.pandas_udf("plain binary, extended binary")
    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        images = _images(data, width, height)
        found = iter(container.encode_both([i for i in images if i is not None], options))
        return pd.DataFrame([(None, None) if i is None else next(found) for i in images], columns=["plain", "extended"], dtype=object)

    return run(data, width, height)


def stream_encode(data: Column, width: Column, height: Column, options: lossless.Options = lossless.Options()) -> Column:
    """A lossless chunk's payload of an RGBA image; null for null."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        images = _images(data, width, height)
        return _filled([i is not None for i in images], batch.encode([i for i in images if i is not None], options))

    return run(data, width, height)


def stream_decode(content: Column, max_pixels: int = MAX_PIXELS) -> Column:
    """struct(data, width, height) of a lossless chunk's payload; nulls for what can't be read."""

    @F.pandas_udf("data binary, width int, height int")
    def run(content: pd.Series) -> pd.DataFrame:
        found = iter(batch.decode([c for c in content if c is not None], max_pixels))
        images = [None if c is None else next(found) for c in content]
        out = [(None, None, None) if i is None or isinstance(i, WebpError) else (i.data, i.width, i.height) for i in images]
        return pd.DataFrame(out, columns=["data", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return run(content)


def webp_encode_lossy(data: Column, width: Column, height: Column, quality: float, tables: str, backend: str = "auto", external: str = "cwebp") -> Column:
    """Lossy file of an RGBA image; null for null. ``backend``: "own", "external", or "auto", which takes the
    external encoder where the executor has it and it succeeds. ``tables``: see codec.lossy_stream."""
    if backend not in ("auto", "own", "external"):
        raise ValueError(f"no backend {backend}")

    @F.pandas_udf("binary")
    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def one(d, w, h):
            if d is None or pd.isna(w) or pd.isna(h):
                return None
            image = container.Image(d, int(w), int(h))
            found = encode_externally(image, quality, path=external) if backend != "own" else None
            return found if found is not None or backend == "external" else container.encode_lossy(image, quality, tables)

        return pd.Series([one(*x) for x in zip(data, width, height, strict=True)], dtype=object)

    return run(data, width, height)


def webp_decode(content: Column, form: str = "rgba", max_pixels: int = MAX_PIXELS, strict: bool = False, tables: str | None = None) -> Column:
    """struct(data, width, height, has_alpha, error) of a file; what can't be read gives its error.
    Lossy files need ``tables``, a file of the format's probabilities that every executor has."""

    @F.pandas_udf(IMAGE)
    def run(content: pd.Series) -> pd.DataFrame:
        found = iter(container.decode_many([c for c in content if c is not None], form, max_pixels, strict, tables))
        images = [WebpError("null") if c is None else next(found) for c in content]
        out = [(None, None, None, None, str(i)) if isinstance(i, WebpError) else (i.data, i.width, i.height, i.has_alpha, None) for i in images]
        return pd.DataFrame(out, columns=["data", "width", "height", "has_alpha", "error"]).astype({"width": "Int32", "height": "Int32", "has_alpha": "boolean"})

    return run(content)


def alpha_encode(plane: Column, width: Column, height: Column) -> Column:
    """An alpha chunk of a plane; null where any of the three is."""
    import numpy as np

    @F.pandas_udf("binary")
    def run(plane: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        there = [p is not None and not pd.isna(w) and not pd.isna(h) for p, w, h in zip(plane, width, height, strict=True)]
        some = [(np.frombuffer(p, np.uint8), int(w), int(h)) for p, w, h, t in zip(plane, width, height, there, strict=True) if t]
        return _filled(there, encode_alphas(*map(list, zip(*some, strict=True))) if some else [])

    return run(plane, width, height)


def alpha_decode(chunk: Column, width: Column, height: Column) -> Column:
    """The plane of an alpha chunk; null where any of the three is, and for a damaged chunk."""

    @F.pandas_udf("binary")
    def run(chunk: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        there = [c is not None and not pd.isna(w) and not pd.isna(h) for c, w, h in zip(chunk, width, height, strict=True)]
        some = [(c, int(w), int(h)) for c, w, h, t in zip(chunk, width, height, there, strict=True) if t]
        found = decode_alphas(*map(list, zip(*some, strict=True))) if some else []
        return _filled(there, [None if isinstance(p, WebpError) else p.tobytes() for p in found])

    return run(chunk, width, height)


@F.udtf(returnType="chunk_idx int, four_cc string, size bigint, offset bigint, data binary")
class RiffChunks:
    """LATERAL riff_chunks(content): a row for each chunk; none for null or another kind of file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = riff.parse_riff(content) if content is not None else []
        except WebpError:
            found = []
        for i, c in enumerate(found):
            yield i, c.four_cc, c.size, c.offset, bytes(c.data)


@F.udtf(returnType="frame_idx int, x int, y int, width int, height int, duration_ms int, blend string, dispose string, loop_count int, background_color bigint, data binary")
class AnimationFrames:
    """LATERAL animation_frames(content, with_pixels[, tables]): a row for each frame, pixels only if asked for;
    those of lossy frames need the path of the format's tables (``codec.lossy_stream.Tables``).

    No row for null or another kind of file; null pixels for a frame that is damaged or cannot be read here."""

    def eval(self, content: bytes, with_pixels: bool, tables: str | None = None) -> Iterator[tuple]:
        try:
            found = riff.parse_animation(content) if content is not None else None
        except WebpError:
            found = None
        for i, f in enumerate(found.frames if found else ()):
            try:
                data = container.decode_frame(f, tables=tables).data if with_pixels else None
            except (WebpError, IndexError):
                data = None
            yield i, f.x, f.y, f.width, f.height, f.duration_ms, f.blend, f.dispose, found.loop_count, found.background_argb, data


FRAME = "frame_idx int, x int, y int, width int, height int, duration_ms int, blend string, dispose string, loop_count int, background_color bigint, data binary"


def animation_frames(files: DataFrame, with_pixels: bool, tables: str | None = None) -> DataFrame:
    """The rows of LATERAL animation_frames for (image_id, content), with image_id; the frames of a batch are decoded together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image_id", pa.int64()), *((n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in FRAME.split(", ")))])
        for table in batches:
            out = []
            for image_id, content in zip(table["image_id"].to_pylist(), table["content"].to_pylist(), strict=True):
                try:
                    found = riff.parse_animation(content) if content is not None else None
                except WebpError:
                    found = None
                out += [(image_id, i, f, found) for i, f in enumerate(found.frames if found else ())]
            for start in range(0, len(out), 2000):
                some = out[start : start + 2000]
                data = container.decode_frames([f for _, _, f, _ in some], tables=tables) if with_pixels else [None] * len(some)
                data = [None if d is None or isinstance(d, WebpError) else d.data for d in data]
                found = [(k, i, f.x, f.y, f.width, f.height, f.duration_ms, f.blend, f.dispose, a.loop_count, a.background_argb, d) for (k, i, f, a), d in zip(some, data, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return files.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(rows, f"image_id bigint, {FRAME}")


def register(spark: SparkSession) -> None:
    spark.udtf.register("riff_chunks", RiffChunks)
    spark.udtf.register("animation_frames", AnimationFrames)


def byte_at(content: Column, i: int | Column) -> Column:
    """The byte at an offset, from 0, as a number; null beyond the end. Stays in the JVM."""
    one = F.substring(content, F.lit(i).cast("int") + 1, F.lit(1))
    return F.conv(F.nullif(F.hex(one), F.lit("")), 16, 10).cast("int")


def little_endian(content: Column, i: int | Column, size: int) -> Column:
    return sum((F.shiftleft(byte_at(content, F.lit(i) + k).cast("long"), 8 * k) for k in range(1, size)), byte_at(content, i).cast("long"))


def to_little_endian(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def webp_info(content: Column) -> Column:
    """struct(width, height, has_alpha, is_lossless, has_animation, is_extended) from the headers, by byte
    arithmetic in the JVM: of an extended header, wherever it stands, then of lossless, then of lossy data;
    null for null, for what isn't such a file, and where the header is damaged.

    The chunks behind the first are walked only where there are any and the first isn't an extended header."""
    name = lambda at: F.decode(F.substring(content, F.lit(at).cast("int") + 1, F.lit(4)), "ISO-8859-1")
    end = F.octet_length(content).cast("long")  # as the parser has it, whatever the file's own size says
    after = lambda at: F.lit(at).cast("long") + 8 + (lambda n: n + n % 2)(little_endian(content, F.lit(at) + 4, 4))

    def step(s, _):
        at = s["at"]
        found = [F.coalesce(s[k], F.when(name(at) == four, at)).alias(k) for k, four in (("x", "VP8X"), ("l", "VP8L"), ("v", "VP8 "))]
        return F.when(at + 8 > end, s).otherwise(F.struct(after(at).alias("at"), *found))

    none = F.lit(None).cast("long")
    begin = F.struct(F.lit(12).cast("long").alias("at"), none.alias("x"), none.alias("l"), none.alias("v"))
    single = (name(12) == "VP8X") | (after(12) >= end)
    first = F.struct(F.lit(0).cast("long").alias("at"), *(F.when(name(12) == four, F.lit(12).cast("long")).alias(k) for k, four in (("x", "VP8X"), ("l", "VP8L"), ("v", "VP8 "))))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (end / 8).cast("int"))), begin, step)

    def facts(w, h, alpha, lossless_, animated, extended):
        return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), alpha.alias("has_alpha"), lossless_.alias("is_lossless"), animated.alias("has_animation"), extended.alias("is_extended"))

    def whole(at, size):  # a chunk's first bytes, in the chunk and in the file
        return (little_endian(content, at + 4, 4) >= size) & (at + 8 + size <= end)

    def read(at):
        no, yes, flags = F.lit(False), F.lit(True), lambda o: byte_at(content, o + 8)
        o = at["x"]
        x = facts(little_endian(content, o + 12, 3) + 1, little_endian(content, o + 15, 3) + 1, flags(o).bitwiseAND(16) != 0, no, flags(o).bitwiseAND(2) != 0, yes)
        o = at["l"]
        bits = little_endian(content, o + 9, 4)
        l = facts(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 28).bitwiseAND(1) != 0, yes, no, no)  # noqa: E741
        l = F.when((flags(o) == 0x2F) & whole(o, 5), l)  # noqa: E741
        o = at["v"]
        v = facts(little_endian(content, o + 14, 2).bitwiseAND(0x3FFF), little_endian(content, o + 16, 2).bitwiseAND(0x3FFF), no, no, no, no)
        v = F.when((flags(o).bitwiseAND(1) == 0) & (F.hex(F.substring(content, o.cast("int") + 12, F.lit(3))) == "9D012A") & whole(o, 10), v)
        return F.when(at["x"].isNotNull() & whole(at["x"], 10), x).when(at["x"].isNotNull(), F.lit(None)).when(at["l"].isNotNull(), l).when(at["v"].isNotNull(), v)

    webp = (name(0) == "RIFF") & (name(8) == "WEBP") & (F.octet_length(content) >= 20)
    places = F.array(F.when(single, first).otherwise(walked))  # one element, so that it is worked out once
    return F.when(webp, F.transform(places, read)[0])


def riff_build(chunks: Column) -> Column:
    """A container of array<struct<four_cc, data>>, in the JVM."""
    one = lambda c: F.concat(F.encode(c["four_cc"], "ISO-8859-1"), to_little_endian(F.octet_length(c["data"]), 4), c["data"], F.when(F.octet_length(c["data"]) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    body = F.aggregate(chunks, F.encode(F.lit("WEBP"), "ISO-8859-1"), lambda out, c: F.concat(out, one(c)))
    return F.concat(F.encode(F.lit("RIFF"), "ISO-8859-1"), to_little_endian(F.octet_length(body), 4), body)


def quality_index(quality: Column) -> Column:
    return F.floor(127 - F.least(F.greatest(quality.cast("double"), F.lit(0.0)), F.lit(100.0)) / 100 * 127 + 0.5).cast("int")


def has_external_encoder(path: str = "cwebp") -> bool:
    return shutil.which(path) is not None


def encode_externally(image: container.Image, quality: float = 75, lossless_: bool = False, path: str = "cwebp") -> bytes | None:
    """The file that an external encoder makes of the image's PAM form; null if it is absent or fails."""
    head = f"P7\nWIDTH {image.width}\nHEIGHT {image.height}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n".encode()
    args = [path, "-quiet", *(["-lossless"] if lossless_ else ["-q", str(quality)]), "-metadata", "none", "-o", "-", "--", "-"]
    try:
        done = subprocess.run(args, input=head + image.data, capture_output=True, check=False, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 and done.stdout else None


def option_names() -> list[str]:
    return [f.name for f in dataclasses.fields(lossless.Options)]
