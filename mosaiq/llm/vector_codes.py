"""Vector code compression: product codes from integer Lloyd rounds with Hamerly's bounds.

A vector's components become integers floor(1024 x) and are cut into equal parts; every part position has a codebook
of up to 256 entries, at first the parts of the first vectors by id. A round assigns every part to its nearest entry and
replaces each entry by the floored mean of its parts. Between rounds a table in the shared folder keeps, for every part,
its entry, one upper bound of the distance to it and one lower bound of the distance to any other entry. Entries' moves
widen the bounds; only where they fail strictly, first with the old upper bound, then with the exact distance, are
all entries tried, in integers, so that of equally near entries the lower index stays. Bounds are rounded away from each
other, so no rounding can decide.

A task holds one Arrow batch and the codebooks (parts x 256 entries, whatever the input); it sends one row of sums for
each entry. The driver collects the summed entries, parts x 256 rows, once a round.

Rows are dropped whose vector is null, empty, has null or non-finite components, or a length other than that of the
first kept vector, or one that can't be cut into equal parts. Repeated rows and ids count each; ids tie by their vector;
null ids come last. Fewer vectors than entries give so many entries. Null labels are one label. No vectors: no rows.
A component of 2^28 or more after scaling raises, as errors would no longer fit a long. Other columns pass unread."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import new_path, table, written

SCALE, LIMIT = 1024, 1 << 28
STATE = "vec_id long, label int, x array<int>, entry array<int>, upper array<double>, lower array<double>, error long, part int, used long, sums array<long>, kind int"


def finite(v: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole(vectors: DataFrame, parts: int) -> DataFrame:
    """vec_id, label, x: the kept vectors as integers."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v")).where(finite(F.col("_v")) & (F.size("_v") % parts == 0))
    first = v.orderBy(F.asc_nulls_last("vec_id"), "_v").limit(1).select(F.size("_v").alias("n")).first()
    scaled = lambda x: F.when(F.abs(x) < LIMIT / SCALE, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for its error to fit"))).cast("int")
    return v.where(F.size("_v") == (first["n"] if first else 0)).select("vec_id", "label", F.transform("_v", scaled).alias("x"))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: in doubles where these hold every sum, else in longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def assign(x: np.ndarray, book: np.ndarray, entry: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of ``x`` (rows of longs), new bounds, and how many rows needed all entries.

    ``entry``, ``upper``, ``lower``: of the round before (None: none yet); ``moved``: how far each entry has moved, rounded up."""
    n = len(x)
    if entry is None or moved is None:
        entry, upper, lower, todo = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        order = np.argsort(moved)
        most, second = moved[order[-1]], moved[order[-2]] if len(moved) > 1 else 0.0
        entry, upper = entry.copy(), np.nextafter(upper + moved[entry], np.inf)
        lower = np.nextafter(lower - np.where(entry == order[-1], second, most), -np.inf)
        todo = np.flatnonzero(~(upper < lower))
        exact = ((x[todo] - book[entry[todo]]) ** 2).sum(1)
        upper[todo] = np.nextafter(np.sqrt(exact.astype(np.float64)), np.inf)
        todo = todo[~(upper[todo] < lower[todo])]
    for at in range(0, len(todo), 4096):
        rows = todo[at : at + 4096]
        d = _distances(x[rows], book)
        best = d.argmin(1)  # of equals the first
        each = np.arange(len(rows))
        entry[rows], upper[rows] = best, np.nextafter(np.sqrt(d[each, best].astype(np.float64)), np.inf)
        d[each, best] = np.iinfo(np.int64).max
        lower[rows] = np.nextafter(np.sqrt(d.min(1).astype(np.float64)), -np.inf) if len(book) > 1 else np.inf
    return entry, upper, lower, len(todo)


def _fixed(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.int32()), pa.array(values.ravel(), kind))


def _pass(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """STATE rows: kind 0, every vector with its entries and bounds; kind 1 but for the last pass, a task's sums for each entry."""
    parts, size, width = books.shape
    label = next(f.dataType.simpleString() for f in rows.schema if f.name == "label")
    ids = next(f.dataType.simpleString() for f in rows.schema if f.name == "vec_id")
    shape = STATE.replace("vec_id long", f"vec_id {ids}").replace("label int", f"label {label}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, sums, kinds = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64), None
        for b in batches:
            kinds = [b.schema.field(c).type for c in ("vec_id", "label")]
            n = b.num_rows
            if not n:
                continue
            x = _fixed(b.column("x"), parts * width, np.int64).reshape(n, parts, width)
            old = [_fixed(b.column(c), parts, k) for c, k in (("entry", np.int64), ("upper", np.float64), ("lower", np.float64))] if moved is not None else None
            entry, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
            error = np.zeros(n, np.int64)
            for p in range(parts):
                before = [a[:, p] for a in old] if old else [None, None, None]
                entry[:, p], upper[:, p], lower[:, p], _ = assign(x[:, p], books[p], *before, moved[p] if moved is not None else None)
                if last:
                    error += ((x[:, p] - books[p][entry[:, p]]) ** 2).sum(1)
                else:
                    used[p] += np.bincount(entry[:, p], minlength=size)
                    np.add.at(sums[p], entry[:, p], x[:, p])
            nothing = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("x"), _lists(entry, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), pa.array(error), *nothing, pa.array(np.zeros(n, np.int32))], [c.split()[0] for c in shape.split(", ")])
        if kinds and not last:
            p, e = np.nonzero(used)
            n = len(p)
            empty = [pa.nulls(n, k) for k in (*kinds, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())]
            empty[3] = _lists(e[:, None], pa.int32())
            yield pa.RecordBatch.from_arrays([*empty, pa.array(p.astype(np.int32)), pa.array(used[p, e]), _lists(sums[p, e], pa.int64()), pa.array(np.ones(n, np.int32))], [c.split()[0] for c in shape.split(", ")])

    return rows.mapInArrow(run, shape)


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, entry array<int> by part, error) of every kept vector, and the codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    rows = written(whole(vectors, parts), "vectors")
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    if not first:
        return rows.select("vec_id", "label", F.col("x").alias("entry"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = np.array(first, np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    moved = None
    for _ in range(rounds):
        path = new_path(spark, "lloyd")
        done = _pass(rows, books, moved, False)
        done.write.partitionBy("kind").option("compression", "zstd").parquet(path)
        state = spark.read.schema(done.schema).parquet(path)
        rows = state.where("kind = 0")
        each = state.where("kind = 1").select("part", F.col("entry")[0].alias("e"), "used", F.posexplode("sums").alias("i", "s"))
        sums = each.groupBy("part", "e", "i").agg(F.sum("s").alias("s"), F.sum("used").alias("n"))
        new = books.copy()
        for r in sums.collect():
            new[r["part"], r["e"], r["i"]] = r["s"] // r["n"]
        moved = np.nextafter(np.sqrt(((new - books) ** 2).sum(2).astype(np.float64)), np.inf) * (new != books).any(2)
        books = new
    done = _pass(rows, books, moved, True)
    return done.select("vec_id", "label", "entry", "error"), books


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    done, books = encode(vectors, parts, entries, rounds)
    done = written(done, "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = done.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round(i: int) -> str:
    """SQL of one more round: nearest entries under codebook i, then codebook i + 1."""
    return f"""
a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT x.r, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts x JOIN c{i} c USING (p)) GROUP BY r, p),
m{i} AS (SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS y FROM (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT a.p, a.e, x.v, unnest(range(1, len(x.v) + 1)) AS i FROM a{i} a JOIN parts x USING (r, p)) GROUP BY p, e, i)),
n{i} AS (SELECT p, e, list(y ORDER BY i) AS v FROM m{i} GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n USING (p, e)),"""


OP13_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS v FROM k, range(0, 4) q(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256),{"".join(map(_round, range(5)))}
h AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS s FROM (SELECT p, e, CAST(unnest(v) AS VARCHAR) AS y, unnest(range(len(v))) AS i FROM c4)),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM k JOIN o USING (r), h"""
