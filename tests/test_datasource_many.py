"""The source ``webp`` with more files than the driver names one by one."""

import glob
import os
import tracemalloc

from mosaiq.codec import container
from mosaiq.codec.lossless import Image
from mosaiq.sources import datasource


def table(spark, n):
    file = container.encode(Image(bytes(range(64)) * 4, 8, 8))
    return spark.createDataFrame([(f"{i}.webp", bytearray(file + bytes(8 * (i % 3)))) for i in range(n)], "name string, content binary").repartition(3)


def test_folders_hold_every_file_once(spark, tmp_path, monkeypatch):
    datasource.register(spark)
    for _ in range(2):  # equal names of a second write replace the first
        table(spark, 50).write.format("webp").option("folders", 7).mode("append").save(f"file://{tmp_path}/in")
    files = glob.glob(f"{tmp_path}/in/*/*")
    assert sorted(map(os.path.basename, files)) == sorted(f"{i}.webp" for i in range(50)) and 1 < len(os.listdir(tmp_path / "in")) <= 7
    flat = datasource.WebpReader({"path": f"file://{tmp_path}/in"}, "file", None).partitions()
    monkeypatch.setattr(datasource, "MANY", 20)
    reader = datasource.WebpReader({"path": f"file://{tmp_path}/in", "splitbytes": str(3 << 20)}, "file", spark.read.format("webp").load(f"file://{tmp_path}/in").schema)
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) <= 20 and any(p.folder for p in parts)
    read = [r for p in parts for b in reader.read(p) for r in b.column("path").to_pylist()]
    assert sorted(read) == sorted(files) == [f for p in flat for f, _ in p.files]
    reader.sizes.append(("__gt__", min(map(os.path.getsize, files))))
    assert 0 < sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < 50
    assert spark.read.format("webp").load(f"file://{tmp_path}/in").count() == 50
    table(spark, 3).write.format("webp").option("folders", 2).mode("overwrite").save(f"file://{tmp_path}/in")
    assert spark.read.format("webp").load(f"file://{tmp_path}/in").count() == 3


def test_the_plan_does_not_grow_with_the_files(tmp_path, monkeypatch):
    for k in range(20):
        os.makedirs(tmp_path / str(k))
        for i in range(200):
            (tmp_path / str(k) / f"{i}.webp").touch()
    monkeypatch.setattr(datasource, "MANY", 100)
    reader = datasource.WebpReader({"path": f"file://{tmp_path}"}, "file", None)
    tracemalloc.start()
    parts = reader.partitions()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(p.files) for p in parts) <= 100 and len(parts) == 20 * 2 and peak < 500_000  # 4,000 files by name take more
