"""Predictions undone in the JVM: a fold over an image's rows that carries the last decoded row as an array.

Within a row each value needs the one before, so a row is a fold too. An image is one row of arrays here and what is decoded is copied
with every step of a fold: meant for images up to some hundred pixels wide; wider ones are the kernel's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.codes import once

_HIGH, _LOW = 0xFF00FF00, 0x00FF00FF


def _folded(rows: DataFrame, value) -> DataFrame:
    """(image_id, rows array<array<bigint>>) of (image_id, y, r array<bigint>, extra columns bound in ``value``). ``value``(v, x, row, above,
    done): the decoded value at x, from the residual v, the row decoded before (empty for the first) and this row so far."""

    def row(state: Column, at: Column) -> Column:
        done = F.aggregate(at["r"], F.array().cast("array<bigint>"), lambda done, v: F.concat(done, F.array(value(v, F.size(done), at, state["above"], done))))
        return once(done, lambda d: F.struct(d.alias("above"), F.concat(state["out"], F.array(d)).alias("out")))

    begin = F.struct(F.array().cast("array<bigint>").alias("above"), F.array().cast("array<array<bigint>>").alias("out"))
    whole = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "r", "modes"))).alias("_rows"))
    return whole.select("image_id", F.aggregate("_rows", begin, row)["out"].alias("rows"))


def _clip(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255))


def gradient_inverse(rows: DataFrame) -> DataFrame:
    """(image_id, rows) of an alpha plane's gradient filter, from (image_id, y, r): each value is added to left + above - corner, clipped, or to
    the one neighbour that there is."""

    def value(v: Column, x: Column, _: Column, above: Column, done: Column) -> Column:
        left, top, corner = F.get(done, x - 1), F.get(above, x), F.get(above, x - 1)
        return F.pmod(v + F.coalesce(F.when(corner.isNotNull(), _clip(left + top - corner)), F.when(x == 0, top), left, F.lit(0)), F.lit(256)).cast("long")

    return _folded(rows.select("image_id", "y", "r", F.array().cast("array<int>").alias("modes")), value)


def _half(a: Column, b: Column) -> Column:
    """Channels' averages, rounded down, of colours as numbers."""
    return F.shiftright(a.bitwiseXOR(b).bitwiseAND(0xFEFEFEFE), 1) + a.bitwiseAND(b)


def _each(use) -> Column:
    """A colour from ``use`` of each channel's place."""
    return sum((F.shiftleft(use(k), k) for k in (8, 16, 24)), use(0))


def _byte(c: Column, k: int) -> Column:
    return F.shiftright(c, k).bitwiseAND(255)


def _select(left: Column, top: Column, corner: Column) -> Column:
    apart = lambda side: sum((F.abs(_byte(side, k) - _byte(corner, k)) for k in (8, 16, 24)), F.abs(_byte(side, 0) - _byte(corner, 0)))
    return F.when(apart(top) < apart(left), left).otherwise(top)


def predicted(mode: Column, left: Column, top: Column, corner: Column, right: Column) -> Column:
    """The colour that one of the 14 modes predicts from its neighbours; ``right``: the one right of the top."""

    def half_step(k: int) -> Column:
        mean = _byte(_half(left, top), k)
        far = mean - _byte(corner, k)
        return _clip(mean + F.floor((far + (far < 0).cast("int")) / 2))  # halved towards zero

    full = _each(lambda k: _clip(_byte(left, k) + _byte(top, k) - _byte(corner, k)))
    forms = [F.lit(0xFF000000), left, top, right, corner, _half(_half(left, right), top), _half(left, corner), _half(left, top), _half(corner, top), _half(top, right), _half(_half(left, corner), _half(top, right)), _select(left, top, corner), full, _each(half_step)]
    out = F.when(mode == 0, forms[0])
    for k, form in enumerate(forms[1:], 1):
        out = out.when(mode == k, form)
    return out.cast("long")


def predictor_inverse(rows: DataFrame, bits: int = 4) -> DataFrame:
    """(image_id, rows) of (image_id, y, r, modes): residual colours as numbers, and the modes of the blocks of 2^bits pixels in row y. The first
    pixel is predicted as opaque black, the first row from the left, the first column from above; right of the top's end stands
    this row's first pixel. An unknown mode gives nulls."""

    def value(v: Column, x: Column, at: Column, above: Column, done: Column) -> Column:
        left, top, corner = F.get(done, x - 1), F.get(above, x), F.get(above, x - 1)
        right = F.coalesce(F.get(above, x + 1), F.get(done, F.lit(0)))
        inner = once(F.struct(left.alias("l"), top.alias("t"), corner.alias("c"), right.alias("r"), F.get(at["modes"], F.shiftright(x, bits)).alias("m")), lambda n: predicted(n["m"], n["l"], n["t"], n["c"], n["r"]))
        guess = F.when((F.size(above) == 0) & (x == 0), F.lit(0xFF000000)).when(F.size(above) == 0, left).when(x == 0, top).otherwise(inner)
        return once(guess.cast("long"), lambda g: ((v.bitwiseAND(_HIGH) + g.bitwiseAND(_HIGH)).bitwiseAND(_HIGH)).bitwiseOR((v.bitwiseAND(_LOW) + g.bitwiseAND(_LOW)).bitwiseAND(_LOW)))

    return _folded(rows, value)
