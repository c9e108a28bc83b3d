"""Images from files, from tables, and back into files."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_webp(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """path, modificationTime, length, content. Columns that aren't selected aren't read, and conditions on
    length and modificationTime are answered from the listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def write_webp(files: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content) as one file each into a folder that all executors share; (name, size) of them.

    A file is renamed into place when whole, so tasks may run again."""
    @F.pandas_udf("long")
    def put(names: pd.Series, contents: pd.Series) -> pd.Series:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        for name, content in zip(names, contents, strict=True):
            own = f"{at}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(content)
            fs.move(own, f"{at}/{name}")
        return contents.map(len)

    return files.where(F.col("content").isNotNull()).select("name", put("name", "content").alias("size"))


def spread(images: DataFrame) -> DataFrame:
    """Deal images out to all cores where they lie in fewer files than there are cores: coding an image costs
    far more than moving it. Larger inputs are left as they are read, without a shuffle."""
    cores = images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(4 * cores) if len(images.inputFiles()) < cores else images


def text_hex(text: Column) -> Column:
    """A text's bytes as hexadecimal digits, padded with zeros to whole rows of 16 RGBA pixels."""
    digits = F.hex(F.encode(text, "utf-8"))
    return F.rpad(digits, F.ceil(F.length(digits) / 128).cast("int") * 128, "0")


def document_images(documents: DataFrame) -> DataFrame:
    """image_id, data, width, height, has_alpha: each text as an image 16 pixels wide. Texts without
    characters have no image."""
    h = text_hex(F.col("text"))
    return documents.where(F.length("text") > 0).select(F.col("doc_id").alias("image_id"), F.unhex(h).alias("data"), F.lit(16).alias("width"), (F.length(h) / 128).cast("int").alias("height"), F.lit(None).cast("boolean").alias("has_alpha"))


def embedding_pixels(embeddings: DataFrame) -> DataFrame:
    """image_id, pos, x, y, v: 64 numbers from -1 to 1 as an 8 x 8 grey image."""
    each = embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "e"))
    return each.select("image_id", "pos", (F.col("pos") % 8).alias("x"), F.expr("cast(pos div 8 as int)").alias("y"), F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("v"))
