"""Header facts and containers of odd files, in the JVM, against the parser's."""

import random

from mosaiq import functions as fn
from mosaiq.codec import WebpError, container, riff
from pyspark.sql import functions as F


def chunk(four, data):
    return four.encode() + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)


def wrapped(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def files():
    image = container.Image(bytes(range(256)) * 4, 16, 16)
    plain = container.encode(image)
    lossless = plain[20 : 20 + int.from_bytes(plain[16:20], "little")]
    vp8x = bytes([18, 0, 0, 0, 9, 0, 0, 4, 1, 0])
    vp8 = b"\x10\x00\x00\x9d\x01\x2a\x21\x40\x22\x00" + b"\0" * 9
    l, x, v, icc = chunk("VP8L", lossless), chunk("VP8X", vp8x), chunk("VP8 ", vp8), chunk("ICCP", b"abc")
    out = [plain, wrapped(l), wrapped(icc, l), wrapped(x, l), wrapped(l, x), wrapped(v), wrapped(icc, v, l), wrapped(v, icc, x), wrapped(icc), wrapped(), wrapped(*[icc] * 200, v), b"", b"RIFF", None]
    out += [b"JUNKjunkJUNK" + x, b"RIFF" + plain[4:8] + b"WAVE" + plain[12:], wrapped(chunk("VP8X", b"abc")), wrapped(chunk("VP8L", b"\x2f")), wrapped(chunk("VP8L", b"\x2e" + lossless[1:])), wrapped(chunk("VP8 ", vp8[:7]))]
    return out


def test_webp_info_equals_the_parser(spark):
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(files())], "i int, content binary")
    got = {r["i"]: r["f"] for r in rows.select("i", fn.webp_info(F.col("content")).alias("f")).collect()}
    some = 0
    for i, c in enumerate(files()):
        try:
            want = riff.image_info(riff.parse_riff(c)) if c is not None else None
        except (WebpError, IndexError):
            want = None
        some += want is not None
        assert (got[i] is None) == (want is None), (i, got[i], want)
        if want is not None:
            assert tuple(got[i]) == tuple(getattr(want, f) for f in ("width", "height", "has_alpha", "is_lossless", "has_animation", "is_extended")), i
    assert some == 9


def test_nulls_and_damage_never_fail_a_job(spark):
    plane = bytes(random.Random(1).randrange(256) for _ in range(64))
    rows = spark.createDataFrame([(bytearray(plane), 8, 8), (None, 8, 8), (bytearray(plane), None, 8)], "p binary, w int, h int")
    coded = [r[0] for r in rows.select(fn.alpha_encode(F.col("p"), F.col("w"), F.col("h"))).collect()]
    assert coded[0] and coded[1] is None and coded[2] is None
    back = spark.createDataFrame([(bytearray(coded[0]), 8, 8), (None, 8, 8), (bytearray(b"\x01"), 8, 8)], "p binary, w int, h int")
    planes = [r[0] for r in back.select(fn.alpha_decode(F.col("p"), F.col("w"), F.col("h"))).collect()]
    assert bytes(planes[0]) == plane and planes[1] is None
