"""Helpers that the corpus operators share: shared-folder tables, row numbers, components."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder is made and set;
    on a cluster its absence raises, since executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class _Made(threading.local):
    """The paths that this thread's operators have made."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/mosaiq/{name}-{uuid.uuid4().hex}"
    _MADE.paths.append(path)
    return path


def made() -> list[str]:
    """The paths that this thread has made so far, the newest last."""
    return list(_MADE.paths)


def clean(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables (by default all that this thread made) once nothing reads them any more. Their number."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for name in made() if paths is None else paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
        _MADE.paths.remove(name)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back.

    A lost executor then costs only the tasks that read the table, never a recomputation of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_numbers(df: DataFrame, order: list[str], out: str = "row_no") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order, and their count.

    Range partitions are sorted on their own; one count per partition goes to the driver, which has a
    status for each of these tasks anyway. Rows that tie in every order column are ordered by where
    they lie in the written table, so that no value can swell one partition."""
    spark = df.sparkSession
    at = written(df.withColumn("_tie", F.monotonically_increasing_id()), "to-number")
    at = at.repartitionByRange(partitions(spark), *order, "_tie").sortWithinPartitions(*order, "_tie")
    at = written(at.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["p"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    at = at.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return at.withColumn(out, F.col("_start") + local).drop("_at", "_part", "_start"), total


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, root), root the least node reached.

    Each round hooks every node to its least neighbour, follows the hooks to their roots by pointer
    jumping and contracts the edges, so the edge table shrinks at least by half of its nodes a round.
    All steps are equi-joins and partial aggregates over written tables; no node's links meet in one
    task. Null ends and self-loops are ignored; an empty input gives an empty result."""
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        hook = written(hook, "hooks")
        while True:  # pointer jumping: the height of the hook trees halves
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = hook.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved"))
            jumped = written(jumped, "jumped")
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.select("u", "p")
            if not moved:
                break
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = hook.select(F.col("u").alias("root"), "p")
            roots = roots.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = written(roots, "roots")
        left = hook.select("u", F.col("p").alias("pu"))
        right = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(left, "u").join(right, "v").where("pu <> pv")
        edges = written(edges.select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    if roots is None:
        kind = dict(edges.dtypes)["u"]
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return roots


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the folds that the contracts fix. Null ids: null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by
