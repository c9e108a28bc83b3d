"""Images from the driver's tables, in Spark and in SQL: documents as RGBA, 16 pixels wide; embeddings as 8 x 8 grey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.sources import document_images, embedding_pixels, spread

_HEX = "rpad(hex(encode(text)), CAST(ceil(length(hex(encode(text))) / 128.0) * 128 AS INT), '0')"
IMAGES = f"img AS (SELECT doc_id AS image_id, {_HEX} AS h FROM documents WHERE length(text) > 0)"
_BYTE = "((instr('0123456789ABCDEF', substr(h, {0}, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, {0} + 1, 1)) - 1)"
PIXELS = (
    IMAGES
    + ", spots AS (SELECT image_id, h, unnest(range(0, length(h) // 8)) AS pos FROM img), px AS (SELECT image_id, pos, pos % 16 AS x, pos // 16 AS y, "
    + ", ".join(f"CAST({_BYTE.format(f'pos * 8 + {2 * i + 1}')} AS INT) AS {c}" for i, c in enumerate("rgba"))
    + " FROM spots)"
)
GREY = "grey AS (SELECT image_id, pos, pos % 8 AS x, pos // 8 AS y, CAST(floor((CAST(embedding[pos + 1] AS DOUBLE) + 1) * 127.5) AS INT) AS v FROM (SELECT vec_id AS image_id, embedding, unnest(range(0, 64)) AS pos FROM embeddings))"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_images(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pixels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
