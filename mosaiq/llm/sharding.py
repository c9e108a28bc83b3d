"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import row_numbers, table, written

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A permutation of 0..n-1, computable for each number on its own.

    A balanced Feistel network permutes 0..4^w-1, the least such domain that holds n. Numbers that it
    sends to n or beyond walk on along their cycle until they fall below n; as the domain is at most
    4n, that takes fewer than four steps on average."""
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if n <= 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    with np.errstate(over="ignore"):
        keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 64)))
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> half, x[todo] & mask
            for key in keys:
                left, right = right, left ^ (_mix(right + key) & mask)
            x[todo] = (left << half) | right
            todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def shard_of(numbers: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers: without any table, from n, the shard count and the seed."""
    at = permute(numbers, n, seed)
    return at % shards, at // shards


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, row_no, shard, slot, and the columns to ``carry``.

    Row numbers follow doc_id (null first), then hashes of the text, so the same rows give the same
    placing whatever files hold them. Shards' counts differ by one at most and slots have no gaps.
    Only ids, sizes and hashes are shuffled, never texts.

    Null or empty text: size 1, crc32 0. A null doc_id and repeated rows count as rows of their own.
    An empty table gives an empty result. Other columns of the input are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_h"), *carry)
    numbered, n = row_numbers(narrow, ["doc_id", "text_crc32", "_h"])

    @F.pandas_udf("long")
    def place(no: pd.Series) -> pd.Series:
        return pd.Series(permute(no.to_numpy(), n, seed))

    placed = numbered.select("doc_id", "size", "text_crc32", "row_no", *carry, place("row_no").alias("_at"))
    return placed.select("doc_id", "size", "text_crc32", "row_no", *carry, (F.col("_at") % shards).cast("int").alias("shard"), F.expr(f"_at div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, parts_per_shard: int = 1) -> DataFrame:
    """Write the rows' ids and texts as one folder per shard, in slot order within each file.

    The rows are numbered in a written copy, so that every row finds its own text again, whatever ids and
    texts repeat. The texts move once to meet their places, once to the task that owns their slot range.
    Returns the placing. Null texts stay null; an empty table leaves no shard."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "to-shard")
    placed = shard(rows, shards, seed, ("key",))
    joined = placed.select("key", "doc_id", "shard", "slot").join(rows.select("key", "text"), "key").drop("key")
    joined.repartitionByRange(shards * parts_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.drop("key")


def op3_feistel_shards(spark, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
