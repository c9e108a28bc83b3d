"""Operators over Arrow batches: large images in pieces give what whole ones give, and what the pixel operators give."""

import numpy as np
import pytest
from mosaiq.codec import batch
from mosaiq.operators import batched, codes, copies
from mosaiq import operators as op
from mosaiq import plans
from mosaiq.plans import lossless
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")


def pictures():
    rng = np.random.default_rng(9)
    sizes = [(1, 1), (1, 7), (7, 1), (2, 9), (16, 40), (33, 21), (5, 300), (64, 65), (3, 4)]
    out = [(i, rng.integers(0, 5 if i % 2 else 256, (w * h, 4)).astype(np.uint8).tobytes(), w, h) for i, (w, h) in enumerate(sizes)]
    return [*out, (20, bytes([1, 2, 3, 255]) * 900, 30, 30), (None, bytes(range(64)), 4, 4), (30, None, 4, 4)]


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame(pictures(), "image_id long, data binary, width int, height int").coalesce(2).cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def sums(px, *names):
    return rows(px.groupBy("image_id").agg(*(F.sum(F.col(c) * (F.col("pos") + 1)).cast("long").alias(f"sum_{c}") for c in names)))


@pytest.mark.parametrize("most", [None, 40, 700])
def test_predictions_in_pieces(images, most):
    px = op.pixels(images.where("data is not null"))
    got = batched.weighted(images, list("rgba"), lambda p: batched.channels(batched.select_residuals(p)), above=1, most=most)
    assert rows(got) == sums(op.predictor_residuals(px), *CHANNELS)
    assert rows(batched.select_roundtrip(images, most)) == sums(px, *CHANNELS)


@pytest.mark.parametrize("most", [None, 40, 700])
def test_samples_in_pieces(images, most):
    px = op.pixels(images.where("data is not null and image_id is not null"))
    chroma = px.where("x % 2 = 0 and y % 2 = 0").select("image_id", F.shiftright("x", 1).alias("cx"), F.shiftright("y", 1).alias("cy"), F.col("r").alias("v"))
    got = batched.weighted(images.where("image_id is not null"), ["v"], lambda p: [batched.upsampled(p, p.rgba[:, 0])], above=2, below=2, most=most)
    assert rows(got) == sums(op.chroma_upsample(px, chroma), "v")


@pytest.mark.parametrize("sign", [-1, 1])
def test_colours_move_as_the_joined_operator_moves_them(images, sign):
    px = op.pixels(images.where("data is not null and image_id is not null"))
    elements = px.select("image_id", F.shiftright("x", 4).alias("block_x"), F.shiftright("y", 4).alias("block_y")).distinct().select("*", F.lit(-16).alias("green_to_red"), F.lit(8).alias("green_to_blue"), F.lit(16).alias("red_to_blue"))
    want = (op.color_inverse if sign > 0 else op.color_forward)(px, elements)
    k = lambda p, v: np.full(len(p.x), v)
    got = batched.weighted(images.where("image_id is not null"), list("rgba"), lambda p: batched.channels(batched.colour_moved(p.argb, k(p, -16), k(p, 8), k(p, 16), sign)), most=300)
    assert rows(got) == sums(want, *CHANNELS)


@pytest.mark.parametrize("most", [None, 300])
def test_codes_in_pieces(images, most):
    there = images.where("data is not null and image_id is not null")
    lengths = codes.code_lengths(codes.literal_histogram(codes.strips(there)))
    want = op.canonical_codes(lengths).join(lengths.select("image_id", "tree", "symbol", "n"), ["image_id", "tree", "symbol"]) if "n" not in op.canonical_codes(lengths).columns else op.canonical_codes(lengths)
    columns = ["image_id", "tree", "symbol", "n", "len", "code"]
    as_long = lambda df: rows(df.select("image_id", "tree", *(F.col(c).cast("long").alias(c) for c in columns[2:])))
    assert as_long(batched.literal_codes(images.where("image_id is not null"), most)) == as_long(want)


@pytest.mark.parametrize("most", [None, 50, 800])
def test_cached_symbols_in_pieces(images, most):
    there = images.where("data is not null and image_id is not null")
    want = copies.histogram(copies.fields(copies.tokens(there, copies=False))).groupBy("tree", "symbol").agg(F.sum("n").alias("n"))
    got = batched.cached_symbols(images.where("image_id is not null"), most).groupBy("tree", "symbol").agg(F.sum("n").alias("n"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("largest, piece", [(1 << 20, 1 << 19), (200, 90)])
def test_copies_in_pieces(images, largest, piece):
    there = images.where("data is not null and image_id is not null")
    px = op.pixels(there).select("image_id", F.col("pos").cast("long").alias("pos"), F.expr("a * 16777216L + r * 65536 + g * 256 + b").alias("argb"))
    found = copies.matched(px).where("back is not null").join(there.select("image_id", "width"), "image_id").withColumn("near", copies.near_of(F.col("width")))
    at = F.col("pos") + 1
    code = copies.cheapest_distance(F.col("back").cast("int"), F.col("near"))
    want = found.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(at * F.col("back")).alias("sum_back"), F.sum(at * F.col("length")).cast("long").alias("sum_length"), F.sum(at * code).cast("long").alias("sum_code"))
    got = batched.copy_sums(images.where("image_id is not null"), largest, piece).groupBy("image_id").agg(*(F.sum(c).alias(c) for c in ("n", "sum_back", "sum_length", "sum_code")))
    assert rows(got) == rows(want)


def test_large_images_are_divided_among_tasks(spark):
    """Some images together, some by the operators: as all together, and as SQL has it (tests of queries)."""
    for query in (lossless.lossless_streams, lossless.lossless_copies):
        docs = "/root/testdata/sf0.001"
        assert rows(query(spark, docs, largest=1500)) == rows(query(spark, docs))


@pytest.mark.parametrize("name", ["predictor_residuals", "predictor_inverse", "color_roundtrip", "chroma_upsample", "code_lengths", "canonical_codes", "token_histogram", "copy_matches"])
def test_no_pixel_is_shuffled(spark, name):
    """Pixels were rows of exchanges, or of joins; now what moves is one row for an image, a code or a symbol."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Window" not in plan and "MapInArrow" in plan


def test_pieces():
    import pyarrow as pa

    table = pa.RecordBatch.from_pylist([{"image_id": i, "data": d, "width": w, "height": h} for i, d, w, h in pictures()])
    for most in (20, 500, batch.CHUNK):
        seen = {}
        for p in batched.pieces(table, 1, 2, most):
            assert len(p.x) <= max(most, 20 * 64) + 6 * 64
            for k in range(len(p.row)):
                on = (p.owner == k) & p.core
                seen[int(p.row[k])] = seen.get(int(p.row[k]), b"") + p.rgba[on].tobytes()
        assert seen == {i: d for i, (_, d, _, _) in enumerate(pictures()) if d}
