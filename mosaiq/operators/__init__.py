"""Pixel operators as DataFrame expressions, windows and aggregates.

Pixel tables have image_id, pos (row-major, from 0), x, y and channels as integers. Windows are always
partitioned by image, so one image's pixels are what a task sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHANNELS = ("a", "r", "g", "b")


def pixels(images: DataFrame) -> DataFrame:
    """image_id, width, height, pos, x, y, r, g, b, a from RGBA bytes; no Python."""
    each = F.posexplode(F.regexp_extract_all(F.hex("data"), F.lit("(.{8})"), 1)).alias("pos", "p")
    rows = images.select("image_id", "width", "height", each)
    channel = lambda i: F.conv(F.substring("p", 2 * i + 1, 2), 16, 10).cast("int")
    return rows.select("image_id", "width", "height", "pos", (F.col("pos") % F.col("width")).alias("x"), F.expr("cast(pos div width as int)").alias("y"), *(channel(i).alias(c) for i, c in enumerate("rgba")))


def rgb_bytes(data: Column) -> Column:
    """RGBA bytes without every fourth."""
    return F.unhex(F.regexp_replace(F.hex(data), "(.{6})..", "$1"))


def alpha_bytes(data: Column) -> Column:
    return F.unhex(F.regexp_replace(F.hex(data), ".{6}(..)", "$1"))


def translucent(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.bool_or(F.col("a") != 255).alias("translucent"))


def subtract_green(px: DataFrame, sign: int = -1) -> DataFrame:
    move = lambda c: F.pmod(F.col(c) + sign * F.col("g"), F.lit(256)).cast("int")
    return px.withColumns({"r": move("r"), "b": move("b")})


def predictor_residuals(px: DataFrame) -> DataFrame:
    """Residuals of the select predictor: the neighbour nearer to left + top - corner, channel-wise modulo 256."""
    w = W.partitionBy("image_id").orderBy("pos")
    row = W.partitionBy("image_id", "x").orderBy("y")
    at = px.withColumns({f"top_{c}": F.lag(c).over(row) for c in CHANNELS})
    # the corner is the top of the pixel to the left
    at = at.withColumns({f"{to}_{c}": F.lag(f"{of}{c}").over(w) for c in CHANNELS for to, of in (("left", ""), ("corner", "top_"))})
    apart = lambda side: sum((F.abs(F.col(f"{side}_{c}") - F.col(f"corner_{c}")) for c in CHANNELS[1:]), F.abs(F.col(f"{side}_a") - F.col("corner_a")))
    nearer_left = apart("top") < apart("left")
    out = {}
    for c in CHANNELS:
        predicted = F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(255 if c == "a" else 0)).when(F.col("y") == 0, F.col(f"left_{c}")).when(F.col("x") == 0, F.col(f"top_{c}")).otherwise(F.when(nearer_left, F.col(f"left_{c}")).otherwise(F.col(f"top_{c}")))
        out[c] = F.pmod(F.col(c) - predicted, F.lit(256)).cast("int")
    return at.withColumns(out).select(px.columns)


def signed(c: Column) -> Column:
    v = F.pmod(c, F.lit(256))
    return F.when(v > 127, v - 256).otherwise(v)


def green_to_red(px: DataFrame, bits: int = 4) -> DataFrame:
    """Per block the coefficient, of -16 to 16 in steps of 8, that leaves red with the least sum of
    magnitudes; of equals the first. All candidates are summed in one aggregate, without a join."""
    block = [F.shiftright("x", bits).alias("block_x"), F.shiftright("y", bits).alias("block_y")]
    grid = (-16, -8, 0, 8, 16)
    cost = lambda k: F.sum(F.abs(signed(F.col("r") - F.shiftright(signed(F.col("g")) * k, 5))))
    sums = px.groupBy("image_id", *block).agg(*(cost(k).cast("long").alias(f"c{i}") for i, k in enumerate(grid)))
    least = F.array_min(F.array(*(F.struct(F.col(f"c{i}").alias("cost"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(grid))))
    return sums.select("image_id", "block_x", "block_y", least["k"].alias("green_to_red"), least["cost"].alias("cost"))


def color_elements(px: DataFrame, bits: int = 4) -> DataFrame:
    """Per block green_to_red as green_to_red() finds it, and the pair (green_to_blue, red_to_blue) of the same grid
    that leaves blue with the least sum of magnitudes; of equals the first, green_to_blue slowest. One aggregate."""
    grid = (-16, -8, 0, 8, 16)
    part = lambda c, k: F.shiftright(signed(F.col(c)) * k, 5)
    cost = lambda left: F.sum(F.abs(signed(left))).cast("long")
    red = {k: cost(F.col("r") - part("g", k)) for k in grid}
    blue = {(k, m): cost(F.col("b") - part("g", k) - part("r", m)) for k in grid for m in grid}
    named = [c.alias(f"r{i}") for i, c in enumerate(red.values())] + [c.alias(f"b{i}") for i, c in enumerate(blue.values())]
    sums = px.groupBy("image_id", F.shiftright("x", bits).alias("block_x"), F.shiftright("y", bits).alias("block_y")).agg(*named)
    r = F.array_min(F.array(*(F.struct(F.col(f"r{i}").alias("cost"), F.lit(i), F.lit(k).alias("k")) for i, k in enumerate(red))))
    b = F.array_min(F.array(*(F.struct(F.col(f"b{i}").alias("cost"), F.lit(i), F.lit(k).alias("k"), F.lit(m).alias("m")) for i, (k, m) in enumerate(blue))))
    return sums.select("image_id", "block_x", "block_y", r["k"].alias("green_to_red"), b["k"].alias("green_to_blue"), b["m"].alias("red_to_blue"))


def pack_indices(indices: DataFrame) -> DataFrame:
    """image_id, x, y, g of (image_id, x, y, idx, colors): as many indices in a row's green byte as ``packing``
    has of the image's colours, the first lowest; a row's last byte may hold fewer."""
    each = indices.withColumn("_n", packing(F.col("colors")))
    place = (F.col("x") % F.col("_n")) * (8 / F.col("_n")).cast("int")
    byte = F.call_function("shiftleft", F.col("idx"), place.cast("int"))
    return each.groupBy("image_id", F.floor(F.col("x") / F.col("_n")).cast("int").alias("x"), "y").agg(F.sum(byte).cast("int").alias("g"))


def palette(px: DataFrame) -> DataFrame:
    """image_id, r, g, b, a, idx: distinct colours numbered by first appearance."""
    first = px.groupBy("image_id", "r", "g", "b", "a").agg(F.min("pos").alias("first"))
    return first.withColumn("idx", F.row_number().over(W.partitionBy("image_id").orderBy("first")) - 1).drop("first")


def packing(colors: Column) -> Column:
    return F.when(colors <= 2, 8).when(colors <= 4, 4).when(colors <= 16, 2).otherwise(1)


def palette_deltas(colors: DataFrame) -> DataFrame:
    w = W.partitionBy("image_id").orderBy("idx")
    return colors.withColumns({c: F.pmod(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(256)).cast("int") for c in CHANNELS})


def palette_sums(deltas: DataFrame) -> DataFrame:
    w = W.partitionBy("image_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    return deltas.withColumns({c: (F.sum(c).over(w) % 256).cast("int") for c in CHANNELS})


def histogram(px: DataFrame) -> DataFrame:
    """image_id, tree, symbol, n: literal symbols of each channel's alphabet."""
    each = px.select("image_id", F.explode(F.array(*(F.struct(F.lit(c).alias("tree"), F.col(c).alias("symbol")) for c in CHANNELS))).alias("s"))
    return each.groupBy("image_id", "s.tree", "s.symbol").agg(F.count("*").alias("n"))


def canonical_codes(lengths: DataFrame, limit: int = 15) -> DataFrame:
    """Adds ``code`` to (image_id, tree, symbol, len): the canonical prefix code, first bit highest."""
    w = W.partitionBy("image_id", "tree").orderBy("len", "symbol").rowsBetween(W.unboundedPreceding, -1)
    with_sum = lengths.withColumn("_before", F.coalesce(F.sum(F.expr(f"shiftleft(1L, cast({limit} - len as int))")).over(w), F.lit(0).cast("long")))
    return with_sum.withColumn("code", F.expr(f"shiftright(_before, cast({limit} - len as int))")).drop("_before")


def alpha_horizontal(px: DataFrame, v: str = "v") -> DataFrame:
    """Undo the horizontal filter: running sums along a row, from those down the first column."""
    row = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, -1)
    at = px.withColumn("_above", F.when(F.col("x") == 0, F.coalesce(F.sum(v).over(down), F.lit(0))).otherwise(0))
    return at.withColumn(v, (F.sum(F.col(v) + F.col("_above")).over(row) % 256).cast("int")).drop("_above")


def alpha_vertical(px: DataFrame, v: str = "v") -> DataFrame:
    """Undo the vertical filter: the first row by running sums, then each column."""
    row = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    at = px.withColumn(v, F.when(F.col("y") == 0, F.sum(v).over(row)).otherwise(F.col(v)))
    return at.withColumn(v, (F.sum(v).over(down) % 256).cast("int"))


def alpha_gradient(px: DataFrame, v: str = "v") -> DataFrame:
    """The gradient filter: each value less left + above - corner, clipped, or less the one neighbour that there is."""
    row, down = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    at = px.withColumn("_above", F.lag(v).over(down)).withColumns({"_left": F.lag(v).over(row), "_corner": F.lag("_above").over(row)})
    both = F.least(F.greatest(F.col("_left") + F.col("_above") - F.col("_corner"), F.lit(0)), F.lit(255))
    both = F.when(F.col("_corner").isNotNull(), both)
    return at.withColumn(v, F.pmod(F.col(v) - F.coalesce(both, "_left", "_above", F.lit(0)), F.lit(256))).drop("_above", "_left", "_corner")


def rgb_to_yuv(px: DataFrame) -> DataFrame:
    """image_id, x, y, luma, u, v: u and v only where both x and y are even, from that pixel."""
    r, g, b = (F.col(c) for c in "rgb")
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")
    even = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)
    return px.select("image_id", "x", "y", clip(F.shiftright(66 * r + 129 * g + 25 * b + 128, 8) + 16).alias("luma"), F.when(even, clip(F.shiftright(-38 * r - 74 * g + 112 * b + 128, 8) + 128)).alias("u"), F.when(even, clip(F.shiftright(112 * r - 94 * g - 18 * b + 128, 8) + 128)).alias("v"))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> list[Column]:
    luma = F.shiftright(y * 19077, 8)
    clip = lambda c: F.least(F.greatest(F.shiftright(c, 6), F.lit(0)), F.lit(255)).cast("int")
    return [clip(luma + F.shiftright(v * 26149, 8) - 14234).alias("r"), clip(luma - F.shiftright(u * 6419, 8) - F.shiftright(v * 13320, 8) + 8708).alias("g"), clip(luma + F.shiftright(u * 33050, 8) - 17685).alias("b")]


def quantise(value: Column, step: Column) -> Column:
    magnitude = F.least(F.floor((F.abs(value) + F.shiftright(step, 1)) / step), F.lit(2047))
    return (F.signum(value.cast("double")) * magnitude).cast("int")


def filter_limits(level: Column, sharpness: Column) -> Column:
    """struct(edge, inner, hev) of a loop filter level; all 0 for level 0, which is off."""
    level = F.least(F.greatest(level, F.lit(0)), F.lit(63))
    inner = F.when(sharpness > 4, F.shiftright(level, 2)).when(sharpness > 0, F.shiftright(level, 1)).otherwise(level)
    inner = F.greatest(F.when(sharpness > 0, F.least(inner, 9 - sharpness)).otherwise(inner), F.lit(1))
    inner = F.when(level > 0, inner).otherwise(0)
    return F.struct((2 * level + inner).alias("edge"), inner.alias("inner"), F.when(level >= 40, 2).when(level >= 15, 1).otherwise(0).alias("hev"))


def prefix_code(value: Column) -> Column:
    """struct(code, extra, bits) of a copy length or coded distance from 1 up, without a lookup table."""
    v = value.cast("long") - 1
    top = F.length(F.bin(F.greatest(v, F.lit(1)))) - 1  # the highest bit's place
    extra = F.when(v < 4, 0).otherwise(top - 1)
    code = F.when(v < 4, v.cast("int")).otherwise(2 * top + F.call_function("shiftright", v, top - 1).bitwiseAND(1).cast("int"))
    bits = v.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), extra) - 1)
    return F.struct(code.alias("code"), extra.cast("int").alias("extra"), bits.cast("int").alias("bits"))


def prefix_value(code: Column, bits: Column) -> Column:
    """The value again."""
    extra = F.shiftright(code - 2, 1)
    base = F.call_function("shiftleft", code.bitwiseAND(1) + 2, F.greatest(extra, F.lit(0)))
    return F.when(code < 4, code + 1).otherwise(base + bits + 1).cast("int")


def near_distances(coded: DataFrame, width: str = "width", code: str = "code") -> DataFrame:
    """Adds ``distance``: near codes, from 1 to 120, by a join with their table of 120 rows; others less 120."""
    from mosaiq.codec import lz

    table = coded.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(lz.NEAR, 1)], "_code int, _x int, _y int")
    at = coded.join(F.broadcast(table), F.col(code) == F.col("_code"), "left")
    near = F.greatest(F.lit(1), F.col("_x") + F.col("_y") * F.col(width))  # of a null it would make 1
    return at.withColumn("distance", F.when(F.col("_x").isNull(), F.col(code) - lz.NEAR_CODES).otherwise(near).cast("int")).drop("_code", "_x", "_y")


def color_inverse(px: DataFrame, elements: DataFrame, bits: int = 4) -> DataFrame:
    """Undo the colour transform: a join of pixels with (image_id, block_x, block_y, green_to_red, green_to_blue,
    red_to_blue) on their block."""
    at = px.withColumns({"block_x": F.shiftright("x", bits), "block_y": F.shiftright("y", bits)}).join(elements, ["image_id", "block_x", "block_y"])
    move = lambda k, c: F.shiftright(F.col(k) * signed(c), 5)
    r = F.pmod(F.col("r") + move("green_to_red", F.col("g")), F.lit(256))
    b = F.pmod(F.col("b") + move("green_to_blue", F.col("g")) + move("red_to_blue", F.col("_r")), F.lit(256))
    return at.withColumn("_r", r).withColumn("b", b.cast("int")).withColumn("r", F.col("_r").cast("int")).select(px.columns)


def color_forward(px: DataFrame, elements: DataFrame, bits: int = 4) -> DataFrame:
    at = px.withColumns({"block_x": F.shiftright("x", bits), "block_y": F.shiftright("y", bits)}).join(elements, ["image_id", "block_x", "block_y"])
    move = lambda k, c: F.shiftright(F.col(k) * signed(F.col(c)), 5)
    b = F.pmod(F.col("b") - move("green_to_blue", "g") - move("red_to_blue", "r"), F.lit(256))
    r = F.pmod(F.col("r") - move("green_to_red", "g"), F.lit(256))
    return at.withColumn("b", b.cast("int")).withColumn("r", r.cast("int")).select(px.columns)


def palette_lookup(indices: DataFrame, colors: DataFrame) -> DataFrame:
    """Colours of (image_id, pos, idx); an index that the palette lacks is opaque black."""
    at = indices.join(colors, ["image_id", "idx"], "left")
    return at.select("image_id", "pos", *(F.coalesce(F.col(c), F.lit(255 if c == "a" else 0)).alias(c) for c in "rgba"))


def chroma_upsample(px: DataFrame, chroma: DataFrame, v: str = "v") -> DataFrame:
    """image_id, pos, v at every pixel of ``px`` (image_id, pos, x, y, width, height) from samples (image_id, cx, cy, v):
    9, 3, 3 and 1 sixteenths of the four nearest, edges repeated. Each pixel's four places are rows of one join."""
    last = {"x": F.expr("cast((width + 1) div 2 as int) - 1"), "y": F.expr("cast((height + 1) div 2 as int) - 1")}

    def near(c: str) -> Column:
        return F.shiftright(c, 1)

    def far(c: str) -> Column:
        return F.least(F.greatest(near(c) + F.when(F.col(c) % 2 == 1, 1).otherwise(-1), F.lit(0)), last[c])

    places = [(near("x"), near("y"), 9), (far("x"), near("y"), 3), (near("x"), far("y"), 3), (far("x"), far("y"), 1)]
    each = px.select("image_id", "pos", F.explode(F.array(*(F.struct(x.alias("cx"), y.alias("cy"), F.lit(w).alias("w")) for x, y, w in places))).alias("p"))
    joined = each.select("image_id", "pos", "p.cx", "p.cy", "p.w").join(chroma.select("image_id", "cx", "cy", v), ["image_id", "cx", "cy"])
    return joined.groupBy("image_id", "pos").agg(F.shiftright(F.sum(F.col(v) * F.col("w")) + 8, 4).cast("int").alias(v))
