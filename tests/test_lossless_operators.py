"""The lossless format as Spark operators, against the kernel and against brute force."""

import itertools
import random

import numpy as np
import pytest
from mosaiq.codec import lossless, lz
from mosaiq.codec.huffman import code_lengths
from mosaiq.operators import codes, copies, reading
from pyspark.sql import functions as F


def pictures():
    rng = random.Random(3)
    pick = lambda n, of: b"".join(bytes(rng.choice(of)) for _ in range(n))
    few = [(1, 2, 3, 255), (4, 5, 6, 255), (250, 9, 1, 30)]
    base = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(40)]
    noise = lambda n: bytes(rng.randrange(256) for _ in range(4 * n))
    mixed = b"".join(bytes(base[(k * k // 7) % 40 if rng.random() < 0.98 else rng.randrange(40)]) for k in range(120 * 90))
    sizes = [(1, 1, bytes(4)), (1, 1, b"\xff" * 4), (2, 1, noise(2)), (3, 1, bytes([7, 8, 9, 255]) * 3), (4, 1, pick(4, few)), (100, 90, bytes([7, 8, 9, 255]) * 9000), (64, 50, pick(3200, few)), (120, 90, mixed), (30, 30, noise(900)), (200, 25, pick(5000, few[:2]))]
    return [(i, d, w, h) for i, (w, h, d) in enumerate(sizes)]


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame(pictures(), "image_id long, data binary, width int, height int").cache()


def options(**on):
    return lossless.Options(**({"subtract_green": False, "predictor": False, "color_index": False, "lz77": False, "color_cache": False} | on))


def kernel(o):
    return {i: lossless.encode(lossless.Image(d, w, h), o) for i, d, w, h in pictures()}


def best_cost(counts, limit):
    """Least sum of length times count over all complete codes: brute force over lengths."""
    best = None
    for lengths in itertools.product(range(1, limit + 1), repeat=len(counts)):
        if sum(1 << (limit - n) for n in lengths) == 1 << limit:
            cost = sum(c * n for c, n in zip(counts, lengths, strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_code_lengths_are_best(spark):
    rng = random.Random(1)
    cases = [[5], [1, 1], [0, 3, 0], [1, 1, 2, 3, 5], [1, 2, 4, 8, 16], [7, 7, 7, 7, 7], [100, 1, 1, 1, 1]] + [[rng.randrange(0, 30) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    rows = [(i, "t", s, n) for i, c in enumerate(cases) for s, n in enumerate(c)]
    table = spark.createDataFrame(rows, "image_id long, tree string, symbol int, n long").cache()
    for limit in (3, 4, 15):
        got = {}
        for r in codes.code_lengths(table, limit).collect():
            got.setdefault(r["image_id"], {})[r["symbol"]] = r["len"]
        for i, c in enumerate(cases):
            used = {s: n for s, n in enumerate(c) if n}
            mine = got.get(i, {})
            assert mine.keys() == used.keys()
            assert [mine.get(s, 0) for s in range(len(c))] == code_lengths(np.array(c), limit).tolist()
            if len(used) > 1:
                assert max(mine.values()) <= limit and sum(2.0**-n for n in mine.values()) == 1
                assert sum(n * mine[s] for s, n in used.items()) == best_cost(list(used.values()), min(limit, 4))


def test_depth_is_limited(spark):
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    table = spark.createDataFrame([(0, "t", s, n) for s, n in enumerate(fib)], "image_id long, tree string, symbol int, n long")
    lengths = [r["len"] for r in codes.code_lengths(table).orderBy("symbol").collect()]
    assert max(lengths) == 15 and sum(2**-n for n in lengths) == 1 and lengths == code_lengths(np.array(fib)).tolist()


def test_bits_and_bytes(spark):
    rng = random.Random(2)
    strings = ["", "1", "00000001", "101", "1" * 64, "0" * 65, "".join(rng.choice("01") for _ in range(1003))]
    rows = spark.createDataFrame([(s,) for s in strings], "s string")
    got = rows.select("s", codes.to_bytes(F.col("s")).alias("b"), codes.to_bits(codes.to_bytes(F.col("s"))).alias("back")).collect()
    for r in got:
        n = -(-len(r["s"]) // 8)
        assert bytes(r["b"]) == int(("0" + r["s"][::-1]), 2).to_bytes(n, "little") and r["back"] == r["s"].ljust(8 * n, "0")
    parts = [[rng.choice("01") * rng.choice([0, 0, 1, 2, 3, 7, 9, 40]) for _ in range(30)] for _ in range(6)] + [[""], ["", "1"]]
    table = spark.createDataFrame([(i, k, s) for i, p in enumerate(parts) for k, s in enumerate(p)], "image_id int, seq int, bits string").repartition(5)
    got = {r["image_id"]: bytes(r["content"]) for r in codes.packed(table).collect()}
    assert got == {i: int("0" + s[::-1], 2).to_bytes(-(-len(s) // 8), "little") for i, p in enumerate(parts) if (s := "".join(p))}


def test_literal_streams_equal_the_kernel(images):
    assert {r["image_id"]: bytes(r["content"]) for r in codes.literal_stream(images).collect()} == kernel(options())


@pytest.mark.parametrize("on", [{"lz77": True, "color_cache": True}, {"lz77": True, "subtract_green": True}, {"color_cache": True, "subtract_green": True}])
def test_streams_with_copies_and_cache(images, on):
    got = copies.stream(images, on.get("lz77", False), on.get("color_cache", False), on.get("subtract_green", False))
    assert {r["image_id"]: bytes(r["content"]) for r in got.collect()} == kernel(options(**on))


@pytest.mark.parametrize("on", [{}, {"lz77": True, "color_cache": True}, {"color_cache": True, "subtract_green": True}])
def test_parallel_reading_equals_the_serial_one(spark, on):
    files = spark.createDataFrame(list(kernel(options(**on)).items()), "image_id long, content binary")
    want = {i: d for i, d, _, _ in pictures()}
    px = reading.pixels_of(reading.placed(reading.tokens(files)))
    assert {r["image_id"]: bytes(r["data"]) for r in reading.images_of(px).collect()} == want
    if not on:
        assert {r["image_id"]: bytes(r["data"]) for r in reading.literal_images(files).collect()} == want


def test_wide_symbol_codes_and_other_streams(spark):
    """Streams with other transforms, damaged ones and none at all have no row or null data; nothing fails."""
    i, d, w, h = pictures()[7]
    good = lossless.encode(lossless.Image(d, w, h), options(lz77=True))
    odd = [b"", b"\x2f", good[:5], b"\x00" + good[1:], lossless.encode(lossless.Image(d, w, h), options(predictor=True)), good[: len(good) // 2], bytes(len(good)), None]
    files = spark.createDataFrame([(k, c) for k, c in enumerate(odd)] + [(99, good)], "image_id long, content binary")
    got = {r["image_id"]: r["data"] for r in reading.images_of(reading.pixels_of(reading.placed(reading.tokens(files)))).collect()}
    assert bytes(got.pop(99)) == d and all(v is None or bytes(v) != d for v in got.values())


def test_near_codes_are_cheapest(spark):
    extra = lambda c: 0 if c <= 4 else (c - 1).bit_length() - 2
    rows = [(w, d) for w in (1, 2, 7, 8, 16, 300, 16384) for d in (*range(1, 40), 115, 128, 299, 300, 301, 599, 2100, 16383, 16384, 16385, 99999)]
    table = spark.createDataFrame(rows, "width int, back int").withColumn("near", copies.near_of(F.col("width")))
    for r in table.select("width", "back", copies.cheapest_distance(F.col("back"), F.col("near")).alias("code")).collect():
        able = [c for c in range(1, 121) if lz.near_distance(c, r["width"]) == r["back"]] + [r["back"] + 120]
        assert r["code"] == min(able, key=lambda c: (extra(c), c))


def test_no_images(spark):
    none = spark.createDataFrame([], "image_id long, data binary, width int, height int")
    assert codes.literal_stream(none).collect() == [] and copies.stream(none).collect() == []
    assert reading.literal_images(spark.createDataFrame([], "image_id long, content binary")).collect() == []


def test_no_python_on_the_path(images):
    plan = codes.literal_stream(images)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
