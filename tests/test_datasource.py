"""The source ``webp``: rows by file, chunk and frame, planned partitions, pushed conditions, writing and aborting."""

import glob
import os

import pytest
from mosaiq.codec import container, riff
from mosaiq.codec.lossless import Image
from mosaiq.sources import datasource
from pyspark.sql import functions as F

PIXELS = bytes(range(64)) * 4


def images():
    plain = container.encode(Image(PIXELS, 8, 8))
    extended = container.encode(Image(PIXELS, 8, 8), extended=True)
    late = riff.build_riff([("ICCP", b"x" * 5001), *((c.four_cc, bytes(c.data)) for c in riff.parse_riff(plain))])
    still = Image(PIXELS, 8, 8)
    moving = container.encode_animation([(still, {"x": 2, "y": 4, "duration_ms": 70}), (still, {"x": 0, "y": 0, "duration_ms": 9, "blend": "replace"})], 16, 16)
    return {"plain.webp": plain, "extended.webp": extended, "late.webp": late, "moving.webp": moving, "bad.webp": b"RIFF", "empty.webp": b""}


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    rows = spark.createDataFrame([(n, bytearray(c), 7) for n, c in images().items()], "name string, content binary, other int")
    rows.repartition(3).write.format("webp").mode("append").save(f"file://{tmp_path}/in")
    (tmp_path / "in" / "note.txt").write_text("no image")
    (tmp_path / "in" / "_hidden").mkdir()
    (tmp_path / "in" / "_hidden" / "a.webp").write_bytes(b"x")
    return f"file://{tmp_path}/in"


def by_name(df):
    return {os.path.basename(r["path"]): r for r in df.collect()}


def test_files(spark, folder):
    got = by_name(spark.read.format("webp").load(folder))
    assert {n: bytes(r["content"] or b"") for n, r in got.items() if not r["error"]} == {n: c for n, c in images().items() if len(c) > 4}
    assert {n: r["kind"] for n, r in got.items()} == {"plain.webp": "lossless", "late.webp": "lossless", "extended.webp": "extended", "moving.webp": "extended", "bad.webp": None, "empty.webp": None}
    assert got["moving.webp"]["has_animation"] and got["bad.webp"]["error"] and got["late.webp"]["width"] == 8
    lean = spark.read.format("webp").option("content", "false").load(folder)
    assert all(r["content"] is None for r in lean.collect()) and lean.count() == 6


def test_conditions_are_pushed(spark, folder):
    files = spark.read.format("webp").load(folder)
    some = files.where((F.col("size") > 4000) & (F.col("kind") == "lossless"))
    assert list(by_name(some)) == ["late.webp"]
    assert sorted(by_name(files.where(F.col("kind").isin("extended", "lossy")))) == ["extended.webp", "moving.webp"]
    assert files.where("kind is null").count() == 2 and files.where("kind <> 'lossless'").count() == 2 and files.where("size < 0").count() == 0
    reader = datasource.WebpReader({"path": folder}, "file", files.schema)
    asked = [datasource.GreaterThan(("size",), 4000), datasource.EqualTo(("kind",), "lossless"), datasource.EqualTo(("width",), 8)]
    assert list(reader.pushFilters(asked)) == asked[2:]
    assert [len(p.files) for p in reader.partitions()] == [1]


def test_partitions_follow_sizes(spark, folder):
    reader = datasource.WebpReader({"path": folder, "splitbytes": str(3 << 20)}, "file", None)
    parts = [p.files for p in reader.partitions()]
    assert [len(p) for p in parts] == [2, 2, 2] and [f for p in parts for f in p] == sorted(f for p in parts for f in p)
    assert spark.read.format("webp").option("splitBytes", 3 << 20).load(folder).rdd.getNumPartitions() == 3
    assert spark.read.format("webp").load(f"{folder}/none").count() == 0


def test_chunks_and_frames(spark, folder):
    chunks = spark.read.format("webp").option("rows", "chunk").load(folder).where("error is null").collect()
    want = sorted((n, k, c.four_cc, c.size, c.offset, bytes(c.data)) for n, x in images().items() if len(x) > 4 for k, c in enumerate(riff.parse_riff(x)))
    assert sorted((os.path.basename(r["path"]), r["chunk_idx"], r["four_cc"], r["size"], r["offset"], bytes(r["data"])) for r in chunks) == want
    frames = [r for r in spark.read.format("webp").option("rows", "frame").load(folder).collect() if not r["error"]]
    assert [(r["x"], r["y"], r["duration_ms"], r["blend"]) for r in sorted(frames, key=lambda r: r["frame_idx"])] == [(2, 4, 70, "overlay"), (0, 0, 9, "replace")]
    assert all(container.decode(bytes(r["data"])).data == PIXELS for r in frames)


def test_an_aborted_write_leaves_nothing(spark, folder, tmp_path):
    before = sorted(glob.glob(f"{tmp_path}/in/**", recursive=True))
    bad = spark.createDataFrame([("new.webp", bytearray(b"1")), ("none.webp", None)], "name string, content binary").repartition(2)
    with pytest.raises(Exception, match="none.webp"):
        bad.write.format("webp").mode("append").save(folder)
    assert sorted(glob.glob(f"{tmp_path}/in/**", recursive=True)) == before
    with pytest.raises(Exception, match="name and content"):
        spark.range(1).write.format("webp").mode("append").save(folder)
    spark.createDataFrame([("new.webp", bytearray(b"1"))], "name string, content binary").write.format("webp").mode("overwrite").save(folder)
    assert os.listdir(f"{tmp_path}/in") == ["new.webp"]
