"""Codec columns over batches: bad rows and nulls beside good ones."""

import random

from mosaiq import functions as fn
from mosaiq.codec import container, lossless
from pyspark.sql import functions as F


def rows():
    rng = random.Random(1)
    good = [(rng.randbytes(4 * 16 * h), 16, h) for h in range(1, 30)]
    return [(i, *r) for i, r in enumerate([*good, (b"short", 16, 9), (None, 16, 1), (good[3][0], None, 4), (good[5][0], 16, 6)])]


def test_bad_images_do_not_touch_their_neighbours(spark):
    table = spark.createDataFrame(rows(), "i int, data binary, width int, height int").coalesce(1)
    files = table.select("i", "data", fn.webp_encode(F.col("data"), F.col("width"), F.col("height"), failfast=False).alias("c"))
    got = files.select("i", "data", "c", fn.webp_decode(F.col("c")).alias("d")).collect()
    assert [r["i"] for r in got if r["c"] is None] == [29, 30, 31]
    assert all(bytes(r["d"]["data"]) == bytes(r["data"]) and r["d"]["error"] is None for r in got if r["c"] is not None)
    assert all(r["d"]["error"] == "null" for r in got if r["c"] is None)
    by_kernel = {i: container.encode(lossless.Image(d, w, h)) for i, d, w, h in rows() if d is not None and w and len(d) >= 4 * w * h}
    assert {r["i"]: bytes(r["c"]) for r in got if r["c"] is not None} == by_kernel


def test_a_batch_goes_through_few_calls(spark, monkeypatch):
    """Roundtrips don't call the kernel image by image: it is missing here, and rich images pass all the same."""
    good = [lossless.Image(d, w, h) for _, d, w, h in rows()[1:29]]
    monkeypatch.setattr(lossless, "encode", None)
    monkeypatch.setattr(lossless, "decode", None)
    assert [i.data for i in container.decode_many(container.encode_many(good))] == [i.data for i in good]


def test_alpha_columns(spark):
    table = spark.createDataFrame([(i, d, w, h) for i, d, w, h in [(0, bytes(range(240)), 16, 15), (1, None, 3, 3), (2, b"\7" * 12, 4, 3), (3, bytes(5), None, 5)]], "i int, p binary, w int, h int").coalesce(1)
    chunks = table.select("i", "p", "w", "h", fn.alpha_encode(F.col("p"), F.col("w"), F.col("h")).alias("c"))
    got = chunks.select("i", "p", fn.alpha_decode(F.col("c"), F.col("w"), F.col("h")).alias("b")).orderBy("i").collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in got] == [bytes(range(240)), None, b"\7" * 12, None]
    bad = spark.createDataFrame([(b"",), (b"\3x",), (None,)], "c binary").select(fn.alpha_decode(F.col("c"), F.lit(2), F.lit(2)).alias("b")).collect()
    assert [r["b"] for r in bad] == [None] * 3


def test_both_files_from_one_encoding(spark, monkeypatch):
    table = spark.createDataFrame([r for r in rows() if r[1] is None or len(r[1]) >= 64], "i int, data binary, width int, height int").coalesce(1)
    got = table.select("i", fn.webp_encode_both(F.col("data"), F.col("width"), F.col("height")).alias("f")).select("i", "f.*").collect()
    by_kernel = {i: [container.encode(lossless.Image(d, w, h), extended=e) if d is not None and w else None for e in (False, True)] for i, d, w, h in rows() if i != 29}
    assert len(got) == 32 and all([None if c is None else bytes(c) for c in r[1:]] == by_kernel[r["i"]] for r in got)
    from mosaiq.codec import batch

    calls, real = [], batch.encode
    monkeypatch.setattr(batch, "encode", lambda *a: calls.append(a) or real(*a))
    assert len(container.encode_both([lossless.Image(bytes(64), 4, 4)])) == len(calls) == 1
