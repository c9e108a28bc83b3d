"""Every image query against its SQL in DuckDB, and what isn't a query."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mosaiq import functions as fn
from mosaiq import operators as op
from mosaiq import plans, sources, streaming
from mosaiq.codec import container, lossless, lossy
from mosaiq.codec import transforms as tf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(map(repr, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None))) for x in (a, b)]
    return rows[0] == rows[1]


@pytest.mark.parametrize("name", plans.QUERIES)
def test_query(spark, db, name):
    assert same(plans.QUERIES[name](spark, SF).toPandas(), db.sql(plans.ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_columns_agree_with_kernels(spark):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (12, 20, 4), dtype=np.uint8)
    images = spark.createDataFrame([(1, data.tobytes(), 20, 12, None)], "image_id int, data binary, width int, height int, has_alpha boolean")
    px = op.pixels(images)
    argb = tf.from_rgba(data.tobytes())
    words = lambda df: (df.orderBy("pos").toPandas()[list("argb")].to_numpy(np.uint32) * np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)).sum(axis=1, dtype=np.uint32)
    assert (words(px) == argb).all()
    assert (words(op.subtract_green(px)) == tf.subtract_green(argb)).all()
    assert (words(op.subtract_green(op.subtract_green(px), 1)) == argb).all()
    assert (words(op.predictor_residuals(px)) == tf.predictor_forward(argb, 20, 12, 4)[0]).all()
    block = op.green_to_red(px, 3).orderBy("block_y", "block_x").toPandas().green_to_red.to_numpy()
    assert (block & 255 == (tf.color_forward(argb, 20, 12, 3)[1] & np.uint32(255))).all()
    y, _, _ = lossy.rgb_to_yuv(data)
    assert (op.rgb_to_yuv(px).orderBy("y", "x").toPandas().luma.to_numpy() == y[:12, :20].ravel()).all()


def test_files(spark, tmp_path):
    images = sources.document_images(spark.read.parquet(f"{SF}/documents.parquet")).limit(5)
    files = images.select(F.format_string("%d.webp", "image_id").alias("name"), fn.webp_encode(F.col("data"), F.col("width"), F.col("height")).alias("content"))
    written = sources.write_webp(files, f"file://{tmp_path}/w").collect()
    got = sources.read_webp(spark, f"{tmp_path}/w")
    assert {r["length"] for r in got.collect()} == {r["size"] for r in written}
    assert got.select(fn.webp_decode(F.col("content"))["error"].alias("e")).where("e is not null").count() == 0
    query = streaming.stream_webp(spark, f"{tmp_path}/w").select(fn.webp_info(F.col("content")).alias("i")).writeStream.format("memory").queryName("mosaiq_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("mosaiq_stream").where("i.width = 16 and i.is_lossless").count() == 5


def test_lossy_columns(spark, tmp_path):
    import json

    rng = np.random.default_rng(5)
    raw = {"coefficients": rng.integers(1, 256, 1056), "updates": rng.integers(200, 256, 1056), "sub_modes": rng.integers(1, 256, 900), "dc": np.arange(4, 132), "ac": np.arange(4, 132)}
    (tmp_path / "t.json").write_text(json.dumps({k: v.tolist() for k, v in raw.items()}))
    images = sources.document_images(spark.read.parquet(f"{SF}/documents.parquet")).limit(3)
    files = images.select(fn.webp_encode_lossy(F.col("data"), F.col("width"), F.col("height"), 80, str(tmp_path / "t.json"), "auto", "no-such-encoder").alias("content"), "height")
    back = files.select("height", fn.webp_decode(F.col("content"), tables=str(tmp_path / "t.json")).alias("i")).select("height", "i.height", "i.error")
    assert all(r[0] == r[1] and r[2] is None for r in back.collect())
    assert files.select(fn.webp_decode(F.col("content"))["error"].alias("e")).where("e is null").count() == 0


def test_bad_rows(spark):
    rows = spark.createDataFrame([(b"junk",), (None,), (container.encode(lossless.Image(bytes(4), 1, 1)),)], "content binary")
    out = rows.select(fn.webp_decode(F.col("content")).alias("i")).select("i.*").collect()
    assert [r["error"] is None for r in out] == [False, False, True]
    assert [r[0] is None for r in rows.select(fn.webp_info(F.col("content"))).collect()] == [True, True, False]
    assert fn.encode_externally(lossless.Image(bytes(4), 1, 1), path="no-such-encoder") is None and not fn.has_external_encoder("no-such-encoder")
