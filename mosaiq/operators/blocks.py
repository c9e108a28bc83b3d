"""Blocks of the lossy format as array columns: transforms, predictions and edge filters, all in the JVM.

A block is an array of integers, row by row, one block a row of the table, so that nothing here shuffles but
``blocks``, which makes them from pixels. Null arrays give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.codec.lossy import FORWARD, FORWARD_BITS


def blocks(px: DataFrame, v: str = "v", size: int = 4) -> DataFrame:
    """image_id, block_x, block_y, block: squares of ``size`` pixels a side; at most size * size rows meet in a group."""
    place = (F.col("y") % size * size + F.col("x") % size).cast("int")
    at = px.select("image_id", *(F.floor(F.col(c) / size).cast("int").alias(f"block_{c}") for c in "xy"), F.struct(place.alias("i"), F.col(v).alias("v")).alias("p"))
    found = at.groupBy("image_id", "block_x", "block_y").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return found.select("image_id", "block_x", "block_y", F.col("p.v").alias("block"))


def clip(c: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _two_passes(df: DataFrame, block: str, out: str, once: Callable[..., tuple], bias: int, shift: int) -> DataFrame:
    """Down the columns, then along the rows, then a rounding shift. The first pass is a column of its own, so
    that its terms are worked out once."""
    c = [F.col(block)[i].cast("long") for i in range(16)]
    columns = [once(*c[x::4]) for x in range(4)]
    t = [F.col("_t")[i] + (bias if i % 4 == 0 else 0) for i in range(16)]
    rows = [v for r in range(4) for v in once(*t[4 * r : 4 * r + 4])]
    first = df.withColumn("_t", F.array(*(columns[i % 4][i // 4] for i in range(16))))
    return first.withColumn(out, F.when(F.col(block).isNotNull(), F.array(*(F.shiftright(v, shift).cast("int") for v in rows)))).drop("_t")


def inverse_dct(df: DataFrame, block: str = "block", out: str = "residual") -> DataFrame:
    """Adds the residuals of 16 coefficients."""
    turn = lambda p, factor: F.shiftright(p * factor, 16)

    def once(p0, p1, p2, p3):
        x, y = turn(p1, 35468) - turn(p3, 85627), turn(p1, 85627) + turn(p3, 35468)
        return p0 + p2 + y, p0 - p2 + x, p0 - p2 - x, p0 + p2 - y

    return _two_passes(df, block, out, once, 4, 3)


def inverse_dct_flat(dc: Column) -> Column:
    """The residuals of a first coefficient alone: all the same."""
    return F.array_repeat(F.shiftright(dc + 4, 3), 16)


def forward_dct(block: Column) -> Column:
    """The 16 coefficients of residuals, each a weighted sum rounded once."""
    sums = [sum((block[i].cast("long") * int(w) for i, w in enumerate(row)), F.lit(1 << FORWARD_BITS - 1)) for row in FORWARD]
    return F.when(block.isNotNull(), F.array(*(F.shiftright(s, FORWARD_BITS).cast("int") for s in sums)))


def inverse_wht(df: DataFrame, block: str = "block", out: str = "dc") -> DataFrame:
    """Adds the first coefficients of a macroblock's 16 blocks."""
    return _two_passes(df, block, out, lambda p0, p1, p2, p3: (p0 + p1 + p2 + p3, p0 + p1 - p2 - p3, p0 - p1 - p2 + p3, p0 - p1 + p2 - p3), 3, 3)


def forward_wht(df: DataFrame, block: str = "block", out: str = "wht") -> DataFrame:
    return _two_passes(df, block, out, lambda p0, p1, p2, p3: (p0 + p1 + p2 + p3, p0 + p1 - p2 - p3, p0 - p1 - p2 + p3, p0 - p1 + p2 - p3), 0, 1)


def add_clip(prediction: Column, residual: Column) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clip(p + r))


def predict_square(top: Column, left: Column, corner: Column, mode: str, size: int) -> Column:
    """Prediction of a square from the pixels above, to the left and at the corner: dc, v, h or tm. A null ``top``
    or ``left`` lies outside the image; only dc does without."""
    if mode == "v":
        return F.flatten(F.array_repeat(top, size))
    if mode == "h":
        return F.flatten(F.transform(left, lambda p: F.array_repeat(p, size)))
    if mode == "tm":
        return F.flatten(F.transform(left, lambda p: F.transform(top, lambda t: clip(p + t - corner))))
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0), lambda s, v: s + v), F.lit(0))
    n = size * (top.isNotNull().cast("int") + left.isNotNull().cast("int"))
    mean = F.floor((total(top) + total(left) + F.floor(n / 2)) / n).cast("int")
    return F.array_repeat(F.when(n > 0, mean).otherwise(128), size * size)


def predict_sub(around: Column, mode: str) -> Column:
    """Prediction of a 4 x 4 block from 13 pixels: left from below, corner, eight above; ten modes."""
    from mosaiq.codec.lossy_stream import SUB_WEIGHTS

    a = [around[i] for i in range(13)]
    if mode == "dc":
        pixels = [F.shiftright(sum(a[:4] + a[5:9], F.lit(4)), 3)] * 16
    elif mode == "tm":
        pixels = [clip(a[3 - r] + a[5 + c] - a[4]) for r in range(4) for c in range(4)]
    else:
        pixels = [F.shiftright(sum((a[i] * int(w) for i, w in enumerate(row) if w), F.lit(2)), 2) for row in SUB_WEIGHTS[mode]]
    return F.when(around.isNotNull(), F.array(*pixels))


def filter_edge(span: Column, edge: Column, inner: Column, hev: Column, outer: bool, simple: bool) -> Column:
    """Eight pixels across an edge in their middle, filtered: ``outer`` between macroblocks, else within one."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (span[i] for i in range(8))
    apart = lambda a, b: F.abs(a - b)
    small = lambda v: clip(v, -128, 127)
    moved = lambda p, d: small(p - 128 + d) + 128
    on = 2 * apart(p0, q0) + F.shiftright(apart(p1, q1), 1) <= edge
    slope = 3 * (q0 - p0)
    strong = small(small(p1 - q1) + slope)
    up, down = (F.shiftright(small(strong + k), 3) for k in (4, 3))
    if simple:
        return F.when(on, F.array(p3, p2, p1, moved(p0, down), moved(q0, -up), q1, q2, q3)).otherwise(span)
    for a, b in ((p3, p2), (p2, p1), (p1, p0), (q3, q2), (q2, q1), (q1, q0)):
        on = on & (apart(a, b) <= inner)
    rough = (apart(p1, p0) > hev) | (apart(q1, q0) > hev)
    near = F.array(p3, p2, p1, moved(p0, down), moved(q0, -up), q1, q2, q3)
    if outer:
        a, b, c = (small(F.shiftright(w * strong + 63, 7)) for w in (27, 18, 9))
        smooth = F.array(p3, moved(p2, c), moved(p1, b), moved(p0, a), moved(q0, -a), moved(q1, -b), moved(q2, -c), q3)
    else:
        up, down = (F.shiftright(small(small(slope) + k), 3) for k in (4, 3))
        half = F.shiftright(up + 1, 1)
        smooth = F.array(p3, p2, moved(p1, half), moved(p0, down), moved(q0, -up), moved(q1, -half), q2, q3)
    return F.when(span.isNull() | ~on, span).when(rough, near).otherwise(smooth)
