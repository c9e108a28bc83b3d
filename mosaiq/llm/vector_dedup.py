"""Embedding near-duplicates: codes from learned rotations, multi-index Hamming tables, cosines of the original vectors.

Codes: iterative quantisation on a bounded sample (``sample`` vectors with the least hashes) learns rotations whose signs
fit the vectors best; no mean is taken off, since two vectors' codes then differ in a share angle / pi of their bits however
the vectors crowd. A rotation gives as many bits as a vector has components; more bits come from rotations learned
from other starts.

Tables: each is keyed by the label and ``width`` bits of the code, and holds every vector. The width follows the number of
vectors of the largest label, so that unrelated ones seldom meet; the number of tables then follows from ``miss``, the
share of pairs right at the threshold that may meet in no table. A pair counts in the first table that it shares. Members
of a table's entry are compared by whole codes first, without vectors; only those near some other member by Hamming
distance travel on with their vectors, whose cosine, in doubles, decides. No pair of cosine under the threshold is a link.

An entry of more than ``block`` members is dealt over blocks, which meet in pairs, each in a group of its own; pairs are
never rows: a group sends per member its number of links and the least member it hangs together with there.
Equal vectors of a label are one member with a weight, so copies cost nothing and their links are exact.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do those of null
labels; vectors of different lengths don't link. Each row counts for itself: repeated rows link with each other.
A component_id is the least non-null vec_id of its component. An empty table has no rows; other columns pass unread."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import components, table, written
from mosaiq.llm.vector_codes import finite

GROUP = ["label", "dim", "slot", "bits", "one", "two"]


def learn(sample: np.ndarray, bits: int, rounds: int = 20) -> np.ndarray:
    """Rotations side by side (dimensions x bits): each turns the sample until its signs are the nearest corners of a cube."""
    dims, out = sample.shape[1], []
    for seed in range(-(-bits // dims)):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
        for _ in range(rounds):
            signs = np.where(sample @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(sample.T @ signs)
            turn = u @ v
        out.append(turn)
    return np.concatenate(out, axis=1)[:, :bits]


def layout(largest: int, threshold: float, miss: float) -> tuple[int, int, int]:
    """Bits of a table's key, number of tables, and the Hamming distance of whole codes that pairs at the threshold keep to (six deviations)."""
    p = math.acos(threshold) / math.pi
    width = max(8, math.ceil(math.log2(max(largest, 2))))
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - p) ** width)))
    bits = width * tables
    return width, tables, math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def keys(vectors: np.ndarray, turn: np.ndarray, width: int) -> np.ndarray:
    """A row's key in each table."""
    bits = vectors @ turn[: vectors.shape[1]] >= 0
    return bits.reshape(len(bits), -1, width) @ (1 << np.arange(width, dtype=np.int64))


def _stacked(column: pa.Array | pa.ChunkedArray, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of lists as matrices, by length: (places, matrix)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), n)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches cut where a group ends: (rows, start of each group)."""
    rest = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            new[1:] = False
            for c in by:
                a = t.column(c).combine_chunks()
                new[1:] |= pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, int(s[-1])), s[:-1]
        rest = t.slice(int(s[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def _pairs(starts: np.ndarray, n: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within groups, some at a time."""
    ends = np.append(starts[1:], n)
    left = np.repeat(ends, ends - starts) - np.arange(n) - 1  # partners that follow
    done = np.cumsum(left)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, side="right")))
        i = np.repeat(np.arange(at, to), left[at:to])
        if len(i):
            first = np.repeat(np.cumsum(left[at:to]) - left[at:to], left[at:to])
            yield i, i + 1 + np.arange(len(i)) - first
        at = to


def _meeting(code: np.ndarray, slot: np.ndarray, chunk: np.ndarray, apart: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs count here: this is the first table that they share, their blocks are those that meet, and their codes are near."""
    ok = ~apart[i] | (chunk[i] != chunk[j])
    i, j = i[ok], j[ok]
    a, b = code[i], code[j]
    first = (a == b).argmax(1) == slot[i]
    near = np.bitwise_count(a[first] ^ b[first]).sum(1) <= radius
    at = np.flatnonzero(ok)[first]
    return at[near]


def _in_tables(rows: DataFrame, block: int) -> DataFrame:
    """Members of entries that hold more than one, dealt over the pairs of blocks that meet: sorted groups."""
    entry = ["label", "dim", "slot", "bits"]
    sizes = rows.groupBy(*entry).agg(F.count("*").alias("_n")).where("_n > 1")
    at = rows.join(sizes, entry).withColumn("_k", F.ceil(F.col("_n") / block).cast("int"))
    at = at.withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("_k")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    at = at.withColumns({"one": F.least("chunk", "_with"), "two": F.greatest("chunk", "_with")}).drop("_n", "_k", "_with")
    return at.repartition(*GROUP).sortWithinPartitions(*GROUP)


def near(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-6, sample: int = 4096, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & finite(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(usable, v).alias("v"))
    members = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("vid", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    members = written(members, "members")
    largest = members.groupBy("label", "dim").count().agg(F.max("count").alias("n"), F.max("dim").alias("dim")).first()
    if largest["n"] is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, tables, radius = layout(largest["n"], threshold, miss)
    drawn = [r["v"] for r in members.orderBy(F.xxhash64("v"), "vid").limit(sample).select("v").collect()]
    padded = np.zeros((len(drawn), largest["dim"]))
    for i, x in enumerate(drawn):
        padded[i, : len(x)] = x
    turn = learn(units(padded), width * tables)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.zeros((b.num_rows, tables), np.int64)
            for at, x in _stacked(b.column("v"), np.float64):
                code[at] = keys(units(x), turn, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables, pa.int32()), pa.array(code.ravel().astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("label"), b.column("dim"), lists], ["vid", "label", "dim", "code"])

    label = members.schema["label"].dataType.simpleString()
    codes = written(members.select("vid", "label", "dim", "v").mapInArrow(coded, f"vid long, label {label}, dim int, code array<int>"), "codes")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, GROUP):
            code = np.zeros((t.num_rows, tables), np.int64)
            for at, x in _stacked(t.column("code"), np.int64):
                code[at] = x
            slot, chunk, one, two = (t.column(c).to_numpy() for c in ("slot", "chunk", "one", "two"))
            found = np.zeros(t.num_rows, bool)
            for i, j in _pairs(starts, t.num_rows):
                at = _meeting(code, slot, chunk, one != two, i, j, radius)
                found[i[at]] = found[j[at]] = True
            yield from t.filter(pa.array(found)).select([*GROUP, "chunk", "vid"]).to_batches()

    shape = f"label {label}, dim int, slot int, bits int, one int, two int, chunk int, vid long"
    entries = codes.select("vid", "label", "dim", "code", F.posexplode("code").alias("slot", "bits"))
    found = written(_in_tables(entries, block).mapInArrow(candidates, shape), "candidates")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, GROUP):
            vectors_, code, size = [None] * t.num_rows, np.zeros((t.num_rows, tables), np.int64), t.column("dim").to_numpy()
            unit = np.zeros((t.num_rows, int(size.max())))
            for at, x in _stacked(t.column("v"), np.float64):
                u = units(x)
                unit[at, : x.shape[1]], code[at] = u, keys(u, turn, width)
            slot, chunk, one, two, vid, copies = (t.column(c).to_numpy() for c in ("slot", "chunk", "one", "two", "vid", "copies"))
            links, root, left, right = np.zeros(t.num_rows, np.int64), vid.copy(), [], []
            for i, j in _pairs(starts, t.num_rows):
                at = _meeting(code, slot, chunk, one != two, i, j, radius)
                i, j = i[at], j[at]
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                left.append(i[ok])
                right.append(j[ok])
                np.add.at(links, i[ok], copies[j[ok]])
                np.add.at(links, j[ok], copies[i[ok]])
            i, j = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
            while len(i) and (root[i] != root[j]).any():
                least = np.minimum(root[i], root[j])
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(vid[some]), pa.array(links[some]), pa.array(root[some])], ["vid", "links", "root"])

    near_ = found.join(members.select("vid", "v", "copies"), "vid").repartition(*GROUP).sortWithinPartitions(*GROUP)
    links = written(near_.mapInArrow(linked, "vid long, links long, root long"), "links")
    roots = components(links.select(F.col("vid").alias("u"), F.col("root").alias("v")))
    degree = links.groupBy("vid").agg(F.sum("links").alias("links"))
    known = members.select("vid", "label", "v", "copies", "least").join(roots.withColumnRenamed("node", "vid"), "vid", "left").join(degree, "vid", "left")
    known = written(known.withColumn("root", F.coalesce("root", "vid")), "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(known.join(least, "root").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "facts")
    out = rows.where("v is not null").join(facts, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
