"""Copies and cached colours of the lossless format, found within an image in parallel.

Rules: at a pixel whose next three pixels occurred before, the newest such place is copied from, as far as it goes (4,096
pixels at most); else a colour that its slot of the cache holds is named by the slot; else the pixel is literal. The
choice runs from the first pixel on, each copy skipping what it covers.

As Spark does it: earlier places are a window over equal triples; a run of pixels with one distance shares the place where
its match ends; only where the distance changes the match is followed on, by doubling over hashes of 1, 2, 4, ... pixels. The
parse is a walk through rows of 4,096 pixels whose maps are composed by doubling (``reading.entered``). The slot's last
writer is a window over slots. Everything stays in the JVM; windows are partitioned by image, triple or slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.codec import lz
from mosaiq.operators import prefix_code
from mosaiq.operators.codes import alphabets, by_tree, channel, code_lengths, field, head, numbers, once, packed, sent_codes, strips
from mosaiq.operators.reading import entered, staged, walk
from mosaiq.sources.scratch import checkpointed

BLOCK = lz.MAX_LENGTH
LEVELS = 13  # 2^12 pixels are the longest copy


def cache_bits(pixels: Column) -> Column:
    """Bits of the cache for an image of so many pixels: no more than 11, nor than its use."""
    return F.least(F.lit(11), F.greatest(F.lit(1), F.length(F.bin(pixels)) - 3))


def slot(argb: Column, bits: Column) -> Column:
    return F.call_function("shiftright", (argb * F.lit(lz.CACHE_MULTIPLIER)).bitwiseAND(F.lit(0xFFFFFFFF)), (F.lit(32) - bits).cast("int")).cast("int")


def matched(px: DataFrame) -> DataFrame:
    """(image_id, pos, argb) with ``back`` and ``length``: how far back the newest place with the same three pixels lies, and how
    many pixels follow alike from there; null where there is none."""
    w = W.partitionBy("image_id").orderBy("pos")
    rows = px.select("image_id", "pos", "argb", F.lead("argb", 1).over(w).alias("_1"), F.lead("argb", 2).over(w).alias("_2"), F.col("argb").alias("_h0"))
    for k in range(1, LEVELS):
        rows = rows.withColumn(f"_h{k}", F.when(F.lead(f"_h{k - 1}", 1 << (k - 1)).over(w).isNotNull(), F.xxhash64(f"_h{k - 1}", F.lead(f"_h{k - 1}", 1 << (k - 1)).over(w))))
    rows = rows.select("image_id", "pos", "argb", "_1", "_2", F.array(*(F.col(f"_h{k}") for k in range(LEVELS))).alias("_h"))
    back = F.col("pos") - F.lag("pos").over(W.partitionBy("image_id", "argb", "_1", "_2").orderBy("pos"))
    near = F.when(F.col("_2").isNotNull() & (back < lz.MAX_DISTANCE - lz.NEAR_CODES), back)
    rows = checkpointed(rows.withColumn("back", near).drop("_1", "_2"))
    after = F.lead("back").over(w)
    ends = rows.drop("_h").withColumn("_last", F.col("back").isNotNull() & ~F.coalesce(after == F.col("back"), F.lit(False)))
    ends = ends.withColumn("_open", F.col("_last") & after.isNotNull())
    open_ = ends.where("_open").select("image_id", "pos", "back")
    longer = _followed_on(open_, rows.select("image_id", F.col("pos").alias("at"), "_h"))
    ends = ends.join(longer, ["image_id", "pos"], "left").withColumn("_end", F.when(F.col("_last"), F.col("pos") + 3 + F.coalesce("more", F.lit(0))))
    end = F.last("_end", ignorenulls=True).over(W.partitionBy("image_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0))
    return ends.select("image_id", "pos", "argb", "back", F.when(F.col("back").isNotNull(), F.least(end - F.col("pos"), F.lit(lz.MAX_LENGTH))).cast("int").alias("length"))


def _followed_on(asked: DataFrame, hashes: DataFrame) -> DataFrame:
    """(image_id, pos, more): how many pixels from pos + 3 on equal those ``back`` before, up to the longest copy.

    A round goes on by the most pixels, 2^k, whose hashes agree there; as fewer than that remain, k falls from round to
    round, and no row takes more than 13. An answered row leaves the rounds."""
    here = hashes.select("image_id", F.col("at").alias("_at"), F.col("_h").alias("_a"))
    there = hashes.select("image_id", F.col("at").alias("_from"), F.col("_h").alias("_b"))
    rows = asked.select("image_id", "pos", "back", F.lit(0).alias("more"))
    done = None
    while True:
        rows = rows.withColumn("_at", F.col("pos") + 3 + F.col("more")).withColumn("_from", F.col("_at") - F.col("back"))
        rows = rows.join(here, ["image_id", "_at"], "left").join(there, ["image_id", "_from"], "left")
        equal = F.size(F.filter(F.zip_with("_a", "_b", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda e: e))  # the shorter ones agree where a longer one does
        step = F.when(F.coalesce(equal, F.lit(0)) > 0, F.call_function("shiftleft", F.lit(1), equal - 1)).otherwise(0)
        rows = checkpointed(rows.select("image_id", "pos", "back", (F.col("more") + step).alias("more"), (step < 2).alias("_over")))
        over = F.col("_over") | (F.col("more") >= lz.MAX_LENGTH)
        answered = rows.where(over).select("image_id", "pos", "more")
        done = answered if done is None else done.unionByName(answered)
        rows = rows.where(~over).drop("_over")
        if rows.isEmpty():
            return done


def cached(px: DataFrame, bits: Column) -> DataFrame:
    """Rows of (image_id, pos, argb) with ``slot`` and ``hit``: whether the slot's last writer wrote the same colour."""
    rows = px.withColumn("slot", slot(F.col("argb"), bits))
    return rows.withColumn("hit", F.coalesce(F.lag("argb").over(W.partitionBy("image_id", "slot").orderBy("pos")) == F.col("argb"), F.lit(False)))


def tokens(images: DataFrame, copies: bool = True, cache: bool = True, subtract_green: bool = False) -> DataFrame:
    """(image_id, width, height, cache, stretch, tokens array<struct<kind, a, b>>): what an image's stream says, 4,096 pixels a row. Kind 0, a
    literal colour a; 1, the colour in slot a of the cache; 2, a copy of a pixels from b pixels back."""
    each = strips(images, BLOCK).select("image_id", "width", "height", "strip", F.posexplode("px").alias("_i", "argb"))
    px = each.select("image_id", "width", "height", (F.col("strip").cast("long") * BLOCK + F.col("_i")).alias("pos"), "argb")
    if subtract_green:
        less = lambda c: (channel(F.col("argb"), c) - channel(F.col("argb"), "green")).bitwiseAND(255).cast("long")
        px = px.withColumn("argb", channel(F.col("argb"), "alpha").cast("long") * 16777216 + less("red") * 65536 + channel(F.col("argb"), "green") * 256 + less("blue"))
    bits = cache_bits(F.col("width").cast("long") * F.col("height")) if cache else F.lit(0)
    px = px.withColumn("cache", bits.cast("int"))
    px = cached(px, F.col("cache")) if cache else px.withColumns({"slot": F.lit(0), "hit": F.lit(False)})
    if copies:
        px = px.join(matched(px.select("image_id", "pos", "argb")).drop("argb"), ["image_id", "pos"])
    else:
        px = px.withColumns({"back": F.lit(None).cast("long"), "length": F.lit(None).cast("int")})
    token = F.struct("pos", F.when(F.col("back").isNotNull(), 2).when(F.col("hit"), 1).otherwise(0).alias("kind"), F.coalesce(F.col("length").cast("long"), F.when(F.col("hit"), F.col("slot").cast("long")), "argb").alias("a"), F.coalesce(F.col("back").cast("int"), F.lit(0)).alias("b"))
    rows = px.groupBy("image_id", "width", "height", "cache", F.expr(f"cast(pos div {BLOCK} as int)").alias("stretch")).agg(F.sort_array(F.collect_list(token)).alias("_t"))
    onward = F.transform("_t", lambda t, o: o + F.when(t["kind"] == 2, t["a"].cast("int")).otherwise(1))
    rows = checkpointed(rows.withColumn("_n", F.size("_t")))
    rows = staged(rows, _next=F.concat(onward, F.array_repeat(F.lit(BLOCK), F.lit(BLOCK) - F.size("_t"))))
    if copies:
        most = images.agg(F.max(F.col("width").cast("long") * F.col("height")).alias("n")).first()["n"] or 1
        rows = rows.join(entered(rows, BLOCK, BLOCK, (most - 1) // BLOCK, F.lit(0), F.col("_n")), ["image_id", "stretch"])
        rows = staged(rows, _seen=walk(F.col("entry"), F.col("_next"), BLOCK, F.col("_n")))
    else:
        rows = staged(rows, _seen=F.sequence(F.lit(0), F.size("_t") - 1))
    chosen = F.transform(F.filter("_seen", lambda o: o < F.size("_t")), lambda o: once(F.col("_t")[o], lambda t: F.struct(t["kind"].alias("kind"), t["a"].alias("a"), t["b"].alias("b"))))
    return rows.select("image_id", "width", "height", "cache", "stretch", chosen.alias("tokens"))


def cheapest_distance(back: Column, near: Column) -> Column:
    """The coded distance with the fewest extra bits, of equals the least: the first near code for this distance, if there is one.

    Extra bits never fall as the coded distance rises, and a distance's own code lies over all near ones, so the least
    coded distance is it. ``near``: the distances of the near codes under the image's width."""
    code = F.array_position(near, back)
    return F.when(code > 0, code.cast("int")).otherwise(back + lz.NEAR_CODES)


def near_of(width: Column) -> Column:
    x, y = (numbers(p[i] for p in lz.NEAR) for i in (0, 1))
    return F.zip_with(x, y, lambda x, y: F.greatest(F.lit(1), x + y * width))


def fields(read: DataFrame) -> DataFrame:
    """Token rows with ``fields``: for each token struct(green, argb, length, far), the symbols and extra bits that the stream has.
    length and far are struct(code, extra, bits), null but for copies; argb is null but for literals."""
    rows = staged(read, _near=near_of(F.col("width")))

    def of(t: Column) -> Column:
        return once(F.struct(F.when(t["kind"] == 2, prefix_code(t["a"])).alias("length"), F.when(t["kind"] == 2, prefix_code(cheapest_distance(t["b"], F.col("_near")))).alias("far")), lambda p: F.struct(F.when(t["kind"] == 0, channel(t["a"], "green")).when(t["kind"] == 1, (256 + lz.LENGTH_CODES + t["a"]).cast("int")).otherwise(256 + p["length"]["code"]).alias("green"), F.when(t["kind"] == 0, t["a"]).alias("argb"), p["length"].alias("length"), p["far"].alias("far")))

    return staged(rows, fields=F.transform("tokens", of)).drop("_near", "tokens")


def histogram(rows: DataFrame) -> DataFrame:
    """(image_id, tree, symbol, n) over the five alphabets, of rows with ``fields``."""
    each = rows.select("image_id", F.explode("fields").alias("f"))
    symbols = F.array(F.struct(F.lit("green").alias("tree"), F.col("f.green").alias("symbol")), *(F.struct(F.lit(t).alias("tree"), channel(F.col("f.argb"), t).alias("symbol")) for t in ("red", "blue", "alpha")), F.struct(F.lit("far").alias("tree"), F.col("f.far.code").alias("symbol")))
    each = each.select("image_id", F.explode(symbols).alias("s")).where("s.symbol is not null")
    return each.groupBy("image_id", "s.tree", "s.symbol").agg(F.count("*").alias("n"))


def stream(images: DataFrame, copies: bool = True, cache: bool = True, subtract_green: bool = False) -> DataFrame:
    """(image_id, content): a lossless chunk's payload of every image, with copies, colour cache and subtract-green as asked for."""
    rows = checkpointed(fields(tokens(images, copies, cache, subtract_green)))
    sizes = alphabets(rows.where("stretch = 0").select("image_id", "cache"), F.col("cache"))
    codes = by_tree(sent_codes(code_lengths(histogram(rows)), sizes))
    opaque = images.select("image_id", F.regexp_like(F.hex("data"), F.lit("^(.{6}FF)*$")).alias("_opaque"))
    first = rows.where("stretch = 0").withColumns({"stretch": F.lit(-1), "fields": F.slice("fields", 1, 0)}).join(opaque, "image_id")
    flags = F.concat(F.lit("1010" if subtract_green else "0"), F.when(F.col("cache") > 0, F.concat(F.lit("1"), field(F.col("cache"), 4))).otherwise("0"), F.lit("0"))
    begin = F.concat(head(F.col("width"), F.col("height"), ~F.col("_opaque")), flags, "sent")

    def one(f: Column) -> Column:
        literal = F.concat(*(F.col(t)[channel(f["argb"], t)] for t in ("red", "blue", "alpha")))
        copy = F.concat(field(f["length"]["bits"], f["length"]["extra"]), F.col("far")[f["far"]["code"]], field(f["far"]["bits"], f["far"]["extra"]))
        return F.concat(F.col("green")[f["green"]], F.when(f["argb"].isNotNull(), literal).when(f["far"].isNotNull(), copy).otherwise(""))

    rows = rows.withColumn("_opaque", F.lit(None).cast("boolean")).unionByName(first).join(codes, "image_id")
    bits = F.when(F.col("stretch") < 0, begin).otherwise(F.array_join(F.transform("fields", one), ""))
    return packed(rows.select("image_id", F.col("stretch").alias("seq"), bits.alias("bits")))
