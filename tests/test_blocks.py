"""Block, colour and index operators against the kernels that code whole streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import functions as fn
from mosaiq import operators as op
from mosaiq.codec import lossy, riff
from mosaiq.codec import lossy_stream as stream
from mosaiq.codec import transforms as tf
from mosaiq.codec.lossless import Image
from mosaiq.operators import alpha_gradient
from mosaiq.operators import blocks as bl

RNG = np.random.default_rng(3)


def frame(spark, rows: np.ndarray, name: str = "block"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())] + [(len(rows), None)], f"i int, {name} array<int>")


def arrays(df, name: str):
    found = [r[name] for r in df.orderBy("i").select(name).collect()]
    assert found[-1] is None
    return np.array(found[:-1])


def test_transforms(spark):
    c = RNG.integers(-2000, 2000, (60, 16))
    df = frame(spark, c)
    square = c.reshape(-1, 4, 4)
    assert (arrays(bl.inverse_dct(df), "residual") == lossy.inverse_dct(square).reshape(-1, 16)).all()
    assert (arrays(bl.inverse_wht(df), "dc") == lossy.inverse_wht(square).reshape(-1, 16)).all()
    assert (arrays(bl.forward_wht(df), "wht") == lossy.forward_wht(square).reshape(-1, 16)).all()
    assert (arrays(df.select("i", bl.forward_dct(F.col("block")).alias("c")), "c") == lossy.forward_dct(square).reshape(-1, 16)).all()
    flat = np.zeros((1, 4, 4), np.int64)
    flat[0, 0, 0] = -77
    got = spark.range(1).select(bl.inverse_dct_flat(F.lit(-77)).alias("r")).first()["r"]
    assert got == lossy.inverse_dct(flat).ravel().tolist()


def test_forward_is_the_inverse_of_inverse():
    block = RNG.integers(-255, 256, (500, 4, 4))
    assert np.abs(lossy.inverse_dct(lossy.forward_dct(block)) - block).max() <= 1


@pytest.mark.parametrize("mode", ["dc", "v", "h", "tm"])
def test_square(spark, mode):
    for y, x in ((1, 1), (1, 9), (9, 1), (9, 9)):
        plane = RNG.integers(0, 256, (17, 17))
        want = stream.predict_square(plane, y, x, 8, mode).ravel().tolist()
        top, left = plane[y - 1, x : x + 8].tolist(), plane[y : y + 8, x - 1].tolist()
        if mode == "dc":
            top, left = top if y > 1 else None, left if x > 1 else None
        df = spark.createDataFrame([(top, left, int(plane[y - 1, x - 1]))], "t array<int>, l array<int>, c int")
        assert df.select(bl.predict_square(F.col("t"), F.col("l"), F.col("c"), mode, 8).alias("p")).first()["p"] == want


@pytest.mark.parametrize("mode", stream.SUB_MODES)
def test_sub(spark, mode):
    around = RNG.integers(0, 256, (20, 13))
    got = arrays(frame(spark, around).select("i", bl.predict_sub(F.col("block"), mode).alias("p")), "p")
    assert got.tolist() == [stream.predict_sub(a, mode).ravel().tolist() for a in around]


@pytest.mark.parametrize("outer, simple", [(True, True), (True, False), (False, False)])
def test_edges(spark, outer, simple):
    rows = np.clip(np.concatenate([128 + RNG.integers(-6, 7, (200, 8)), RNG.integers(0, 256, (100, 8)), 2 + RNG.integers(-2, 3, (50, 8)), 252 + RNG.integers(-3, 4, (50, 8))]), 0, 255)
    want = rows.copy()
    stream.filter_edge(want, 40, 9, 3, outer, simple)
    assert (want != rows).any(axis=1).sum() > 50
    got = frame(spark, rows).select("i", bl.filter_edge(F.col("block"), F.lit(40), F.lit(9), F.lit(3), outer, simple).alias("o"))
    assert (arrays(got, "o") == want).all()


def test_gradient_filter_of_one_row_and_one_column(spark):
    px = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 0, 4), (2, 0, 0, 7), (2, 0, 1, 250)], "image_id int, x int, y int, v int")
    assert sorted(r["v"] for r in alpha_gradient(px).collect()) == [7, 9, 243, 251]
    assert alpha_gradient(px.limit(0)).count() == bl.blocks(px.limit(0)).count() == 0


def test_color_elements(spark):
    data = RNG.integers(0, 256, (20, 36, 4), dtype=np.uint8)
    images = spark.createDataFrame([(1, data.tobytes(), 36, 20)], "image_id int, data binary, width int, height int")
    _, want = tf.color_forward(tf.from_rgba(data.tobytes()), 36, 20, 4)
    got = op.color_elements(op.pixels(images)).orderBy("block_y", "block_x").collect()
    assert [0xFF << 24 | (r["red_to_blue"] & 255) << 16 | (r["green_to_blue"] & 255) << 8 | r["green_to_red"] & 255 for r in got] == want.tolist()


@pytest.mark.parametrize("levels", [1, 2, 3, 9, 40])
def test_packed_indices(spark, levels):
    argb = (0xFF000000 + RNG.integers(0, levels, 13 * 5)).astype(np.uint32)
    colors = tf.palette_of(argb)
    want, width = tf.index_forward(argb, colors, 13, 5)
    idx = [int(np.flatnonzero(colors == v)[0]) for v in argb]
    rows = [(1, i % 13, i // 13, k, len(colors)) for i, k in enumerate(idx)]
    got = op.pack_indices(spark.createDataFrame(rows, "image_id int, x int, y int, idx int, colors int")).orderBy("y", "x").collect()
    assert [r["g"] for r in got] == (want >> np.uint32(8) & np.uint32(255)).tolist() and len(got) == width * 5


def test_lossy_animation_frames(spark, tmp_path):
    from mosaiq.plans.lossy import ruled_tables

    tables = ruled_tables()
    path = str(tmp_path / "t.json")
    with open(path, "w") as f:
        json.dump({n: getattr(tables, n).tolist() for n in ("coefficients", "updates", "sub_modes", "dc", "ac")}, f)
    data = stream.encode(Image(bytes([90, 90, 90, 255]) * 256, 16, 16), 0, tables)
    own = b"VP8 " + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    frame_chunk = riff.frame_chunk(own, width=16, height=16, x=0, y=0, duration_ms=50)
    content = riff.build_riff([("VP8X", riff.vp8x(16, 16, False, True)), ("ANIM", bytes(6)), ("ANMF", frame_chunk)])
    fn.register(spark)
    files = spark.createDataFrame([(content,)], "content binary")
    with_tables = spark.sql("SELECT f.data FROM {files}, LATERAL animation_frames(content, true, {path}) f", files=files, path=path).first()["data"]
    assert np.abs(np.frombuffer(with_tables, np.uint8).reshape(-1, 4)[:, :3].astype(int) - 90).max() < 12
    assert spark.sql("SELECT f.data FROM {files}, LATERAL animation_frames(content, true) f", files=files).first()["data"] is None
