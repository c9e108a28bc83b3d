"""Lossless data read in parallel: within an image, every stretch of bits is decoded by a task of its own.

Where a token starts is known only once all before it are read. So a stretch first works out, for every bit as if a
token started there, where the next one would, and by doubling where each of its first bits leads beyond its end: a map
of entry to exit, 64 numbers, as no token has more bits. Maps are composed by doubling over an image's stretches, which
gives every stretch its true entry; then it reads its tokens. Copies and cached colours are followed by pointer
jumping over pixels. Everything stays in the JVM.

Read here: streams without transforms or with subtract-green only, one group of codes, with or without copies and colour cache.
Others, and damaged ones, give null data; the kernel (``functions.webp_decode``) reads all kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.codec import lz
from mosaiq.codec.huffman import LENGTH_ORDER
from mosaiq.operators.codes import TREES, numbers, once, times
from mosaiq.sources.scratch import checkpointed

STRETCH = 128  # bytes
SPAN = 64  # stretches that travel together, with their image's codes
LONGEST = 64  # more bits than a token has
HEAD = 16384  # bytes, more than the codes of a stream take
_REVERSED = [int(f"{i:08b}"[::-1], 2) for i in range(256)]


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with more columns that later expressions read, rather than work out again inside their lambdas."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def byte_array(content: Column, start: Column, n: Column) -> Column:
    """n bytes from ``start`` on as numbers; zeros beyond the end."""
    one = F.transform(F.sequence(F.lit(0), F.greatest(F.least(n, F.octet_length(content) - start), F.lit(1)).cast("int") - 1), lambda i: F.coalesce(F.conv(F.nullif(F.hex(F.substring(content, (start + i + 1).cast("int"), F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(0)))
    return once(one, lambda b: F.concat(b, times(F.lit(0), n - F.size(b))))


def number(octets: Column, at: Column, size: Column | int) -> Column:
    """Up to 17 bits at a bit offset, the first lowest; zeros beyond the end."""
    byte = lambda k: F.coalesce(F.get(octets, F.shiftright(at, 3) + k), F.lit(0))
    three = byte(0) + 256 * byte(1) + 65536 * byte(2)
    return F.call_function("shiftright", three, at.bitwiseAND(7)).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.lit(size).cast("int")) - 1)


def table(lengths: Column) -> Column:
    """struct(bits, entries) of a code's dense lengths: the next ``bits`` bits, first highest, give 16 x symbol + length.
    A lone symbol takes no bits. No entries for lengths that don't make a complete code."""
    used = F.sort_array(F.filter(F.transform(lengths, lambda n, s: F.struct(n.alias("n"), s.alias("s"))), lambda e: e["n"] > 0))

    def of(u: Column) -> Column:
        top = F.get(u, F.size(u) - 1)["n"]
        many = F.flatten(F.transform(u, lambda e: times(16 * e["s"] + e["n"], F.call_function("shiftleft", F.lit(1), top - e["n"]))))
        lone = F.size(u) == 1
        return F.struct(F.when(lone, 0).otherwise(top).alias("bits"), F.when(lone, F.array(16 * F.get(u, F.lit(0))["s"])).when(F.size(u) > 0, many).alias("entries"))

    return once(once(used, of), lambda t: F.struct(t["bits"].alias("bits"), F.when(F.size(t["entries"]) == F.call_function("shiftleft", F.lit(1), t["bits"]), t["entries"]).alias("entries")))


def read_code(octets: Column, at: Column, alphabet: Column) -> Column:
    """struct(at, lengths) of a code that the stream sends at a bit offset; no lengths for one that runs over its alphabet."""
    bit = lambda k, n=1: number(octets, at + k, n)
    wide = F.when(bit(2) == 1, 8).otherwise(1)
    two = bit(1) == 1
    first, second = number(octets, at + 3, wide), number(octets, at + 3 + wide, 8)
    simple = F.struct((at + 3 + wide + F.when(two, 8).otherwise(0)).alias("at"), F.transform(F.sequence(F.lit(0), alphabet - 1), lambda s: ((s == first) | (two & (s == second))).cast("int")).alias("lengths"))
    order = numbers(LENGTH_ORDER)

    def begun(n: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda s: once(F.array_position(order, s).cast("int"), lambda i: F.when(i <= n, bit(5 + 3 * (i - 1), 3)).otherwise(0)))
        after = at + 5 + 3 * n
        size = 2 + 2 * number(octets, after + 1, 3)
        limited = number(octets, after, 1) == 1
        budget = F.when(limited, 2 + number(octets, after + 4, size)).otherwise(alphabet)
        return F.struct(table(own).alias("t"), F.when(limited, after + 4 + size).otherwise(after + 1).alias("at"), budget.cast("int").alias("budget"))

    def step(state: Column, _: Column, t: Column) -> Column:
        window = F.coalesce(F.get(numbers(i >> 1 for i in _REVERSED[:128]), number(octets, state["at"], 7)), F.lit(0))
        entry = F.get(t["entries"], F.call_function("shiftright", window, 7 - t["bits"]))

        def taken(e: Column) -> Column:
            token, then = F.shiftright(e, 4), state["at"] + e.bitwiseAND(15)
            repeat = token >= 16
            extra = F.when(token == 16, 2).when(token == 17, 3).otherwise(7)
            n = F.when(repeat, number(octets, then, extra) + F.when(token == 18, 11).otherwise(3)).otherwise(1)
            value = F.when(token < 16, token).when(token == 16, state["last"]).otherwise(0)
            return F.struct((then + F.when(repeat, extra).otherwise(0)).alias("at"), (state["budget"] - 1).alias("budget"), F.when((token > 0) & (token < 16), token).otherwise(state["last"]).alias("last"), F.concat(state["lengths"], times(value, n)).alias("lengths"))

        more = (F.size(state["lengths"]) < alphabet) & (state["budget"] > 0)
        return F.when(more, once(entry, taken)).otherwise(state)

    def normal(b: Column) -> Column:
        start = F.struct(b["at"].alias("at"), b["budget"].alias("budget"), F.lit(8).alias("last"), F.array().cast("array<int>").alias("lengths"))
        done = F.aggregate(F.sequence(F.lit(1), alphabet), start, lambda s, i: step(s, i, b["t"]))
        return once(done, lambda d: F.struct(d["at"].alias("at"), F.when(F.size(d["lengths"]) <= alphabet, F.concat(d["lengths"], times(F.lit(0), alphabet - F.size(d["lengths"])))).alias("lengths")))

    return F.when(bit(0) == 1, simple).otherwise(once(once(4 + bit(1, 4), begun), normal))


def headers(files: DataFrame) -> DataFrame:
    """(image_id, width, height, green_added, cache, at, and a decoding table for each code) of (image_id, content), the
    payloads of lossless chunks; no row for what isn't read here."""
    spread = files.select("image_id", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    rows = staged(spread, _h=byte_array(F.col("content"), F.lit(0), F.least(F.lit(HEAD), F.octet_length("content"))))
    bit = lambda at, n: number(F.col("_h"), F.lit(at).cast("int"), n)
    plain = bit(40, 1) == 0
    green = (bit(40, 3) == 5) & (bit(43, 1) == 0)
    rows = staged(rows, width=bit(8, 14) + 1, height=bit(22, 14) + 1, green_added=green, _at=F.when(plain, 41).otherwise(44), _ok=(bit(0, 8) == 0x2F) & (bit(37, 3) == 0) & (plain | green)).where("_ok")
    cached = number(F.col("_h"), F.col("_at"), 1) == 1
    rows = staged(rows, cache=F.when(cached, number(F.col("_h"), F.col("_at") + 1, 4)).otherwise(0), _after=F.col("_at") + F.when(cached, 5).otherwise(1))
    rows = rows.where((number(F.col("_h"), F.col("_after"), 1) == 0) & (F.col("cache") <= 11)).withColumn("at", F.col("_after") + 1)
    for tree, size in zip(TREES, (lz.LENGTH_CODES + 256, 256, 256, 256, lz.DISTANCE_CODES), strict=True):
        alphabet = F.lit(size) + (F.when(F.col("cache") > 0, F.call_function("shiftleft", F.lit(1), F.col("cache"))).otherwise(0) if tree == "green" else 0)
        rows = staged(rows, _code=read_code(F.col("_h"), F.col("at"), alphabet))
        rows = staged(rows, _next=F.col("_code.at"), **{tree: table(F.col("_code.lengths"))}).drop("_code", "at").withColumnRenamed("_next", "at")
    complete = F.lit(True)
    for tree in TREES:
        complete &= F.col(tree)["entries"].isNotNull()
    return rows.where(complete).select("image_id", "content", "width", "height", "green_added", "cache", "at", *TREES)


def _symbols(tree: str) -> Column:
    """A code's table entry at every bit of a stretch, from the windows ``_w`` of 15 bits, first highest."""
    return F.transform("_w", lambda w: F.get(F.col(tree)["entries"], F.call_function("shiftright", w, 15 - F.col(tree)["bits"])))


def entered(rows: DataFrame, size: int, reach: int, last: int, start: Column, steps: Column) -> DataFrame:
    """(image_id, stretch, entry): where, among a row's first ``reach`` places, the walk that ``_next`` describes enters it.
    ``last``: the greatest stretch, or more.

    ``_next``: for each of a row's ``size`` places the place after it, counted on beyond the row's end, never by more than
    ``reach``. The walk enters an image's first row at ``start``; ``steps``: no fewer than a walk through one row takes.
    Doubling: first within a row until all lead out of it, then over the rows of an image, of which only the maps travel."""
    doublings = F.ceil(F.log2(F.greatest(steps, F.lit(1)).cast("double"))).cast("int")
    out = F.aggregate(F.sequence(F.lit(0), doublings), F.col("_next"), lambda to, _: F.transform(to, lambda e: F.when(e >= size, e).otherwise(to[e])))
    rows = rows.select("image_id", "stretch", start.alias("_start"), once(out, lambda o: F.transform(F.slice(o, 1, reach), lambda e: e - size)).alias("_map"))
    w = W.partitionBy("image_id").orderBy("stretch")
    far = 1
    while far <= last:
        rows = rows.withColumn("_before", F.lag("_map", far).over(w))
        both = once(F.struct(F.col("_before").alias("b"), F.col("_map").alias("m")), lambda s: F.when(s["b"].isNull(), s["m"]).otherwise(F.transform(s["b"], lambda e: s["m"][e])))
        rows = staged(rows, _both=both).drop("_before", "_map").withColumnRenamed("_both", "_map")
        far *= 2
    before = F.lag("_map", 1).over(w)
    return rows.withColumn("_before", before).select("image_id", "stretch", F.when(F.col("_before").isNull(), F.col("_start")).otherwise(F.col("_before")[F.col("_start")]).alias("entry"))


def walk(entry: Column, after: Column, size: int, steps: Column) -> Column:
    """The places of a row that the walk from ``entry`` on touches, in order: those of 1, 2, 4, ... steps together."""

    def twice(s: Column, _: Column) -> Column:
        more = F.filter(F.transform(s["seen"], lambda e: s["to"][e]), lambda e: e < size)
        return F.struct(F.concat(s["seen"], more).alias("seen"), F.transform(s["to"], lambda e: F.when(e >= size, e).otherwise(s["to"][e])).alias("to"))

    begin = F.struct(F.filter(F.array(entry), lambda e: e < size).alias("seen"), after.alias("to"))
    doublings = F.ceil(F.log2(F.greatest(steps, F.lit(1)).cast("double"))).cast("int")
    return F.sort_array(F.array_distinct(F.aggregate(F.sequence(F.lit(0), doublings), begin, twice)["seen"]))


def _stretches(rows: DataFrame) -> DataFrame:
    """A row for each stretch of a span of bytes: ``_b``, its bytes; ``_green`` and so on, the symbol and length that each code finds at
    every bit; ``_next``, where a token that starts at a bit would end; ``_steps``, no fewer than it has tokens."""
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(F.col("_bits") > 0, F.greatest(F.least(F.ceil(F.octet_length("_cut") / STRETCH).cast("int"), F.lit(SPAN)) - 1, F.lit(0))).otherwise(0))))
    steps = F.when(F.col("_bits") > 0, F.ceil(8.0 * STRETCH / F.col("_bits"))).otherwise(1).cast("int")
    rows = staged(rows, _b=byte_array(F.col("_cut"), F.col("_i") * STRETCH, F.lit(STRETCH + 16)), stretch=F.col("_span") * SPAN + F.col("_i"), _steps=steps).drop("_cut")
    turn = numbers(_REVERSED)
    rows = staged(rows, _r=F.transform("_b", lambda b: turn[b]))
    size = 8 * STRETCH
    window = lambda o: F.call_function("shiftright", 65536 * F.col("_r")[F.shiftright(o, 3)] + 256 * F.col("_r")[F.shiftright(o, 3) + 1] + F.col("_r")[F.shiftright(o, 3) + 2], 9 - o.bitwiseAND(7)).bitwiseAND(0x7FFF)
    rows = staged(rows, _w=F.transform(F.sequence(F.lit(0), F.lit(size + LONGEST - 1)), window)).drop("_r")
    rows = staged(rows, **{f"_{t}": _symbols(t) for t in TREES}).drop("_w")
    bits = lambda tree, o: F.get(F.col(f"_{tree}"), o).bitwiseAND(15)
    extra = lambda code: F.greatest(F.shiftright(code - 2, 1), F.lit(0))
    past = lambda tree: lambda o: o + bits(tree, o)
    literal = F.transform(F.slice("_green", 1, size), lambda e, o: o + e.bitwiseAND(15))
    for tree in ("red", "blue", "alpha"):
        literal = F.transform(literal, past(tree))
    distance = lambda o: o + bits("far", o) + extra(F.shiftright(F.get(F.col("_far"), o), 4))
    copies = F.transform(F.slice("_green", 1, size), lambda e, o: F.when((e >= 16 * 256) & (e < 16 * (256 + lz.LENGTH_CODES)), once(o + e.bitwiseAND(15) + extra(F.shiftright(e, 4) - 256), distance)).when(e >= 16 * 256, o + e.bitwiseAND(15)))
    return staged(rows, _next=F.zip_with(literal, copies, lambda a, b: F.coalesce(b, a)))


def tokens(files: DataFrame) -> DataFrame:
    """(image_id, width, height, green_added, cache, stretch, tokens array<struct<kind, a, b>>) of (image_id, content): kind 0,
    a literal colour a; 1, the colour in slot a of the cache; 2, a copy of a pixels from b pixels back.

    The last stretch's tokens may go on beyond the image: what follows its last pixel means nothing. An image
    whose codes take no bits at all has one token; it stands for every pixel."""
    rows = checkpointed(headers(files))
    least = lambda tree: F.array_min(F.transform(F.col(tree)["entries"], lambda e: e.bitwiseAND(15)))
    shortest = F.array_min(F.transform(F.col("green")["entries"], lambda e: e.bitwiseAND(15) + F.when(F.shiftright(e, 4) < 256, F.col("_rest")).otherwise(0)))
    rows = staged(staged(rows, _rest=least("red") + least("blue") + least("alpha")), _bits=shortest)
    first = F.shiftright("at", 3)
    last = F.greatest(F.ceil((F.octet_length("content") - first) / (STRETCH * SPAN)).cast("int") - 1, F.lit(0))
    rows = rows.withColumn("_span", F.explode(F.sequence(F.lit(0), F.when(F.col("_bits") > 0, last).otherwise(0)))).withColumn("_from", first + F.col("_span") * STRETCH * SPAN)
    cut = F.substring("content", F.col("_from") + 1, F.lit(STRETCH * SPAN + 16))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_cut", cut).drop("content").repartition(tasks, "image_id", "_span")
    longest = files.agg(F.max(F.octet_length("content")).alias("n")).first()["n"] or 0
    begun = _stretches(rows)
    size = 8 * STRETCH
    entries = entered(begun, size, LONGEST, longest // STRETCH + SPAN, F.col("at").bitwiseAND(7), F.col("_steps"))
    entries = entries.groupBy("image_id", F.expr(f"cast(stretch div {SPAN} as int)").alias("_span")).agg(F.map_from_entries(F.collect_list(F.struct("stretch", "entry"))).alias("_entries"))
    rows = _stretches(rows.join(entries, ["image_id", "_span"]).repartition(tasks, "image_id", "_span"))  # small inputs would else lie in one task
    rows = staged(rows, _seen=walk(F.col("_entries")[F.col("stretch")], F.col("_next"), size, F.col("_steps")))
    bits = lambda tree, o: F.get(F.col(f"_{tree}"), o).bitwiseAND(15)
    extra = lambda code: F.greatest(F.shiftright(code - 2, 1), F.lit(0))
    symbol = lambda tree, o: F.shiftright(F.get(F.col(f"_{tree}"), o), 4).cast("long")
    value = lambda code, o: once(code.cast("int"), lambda c: F.when(c < 4, c + 1).otherwise(F.call_function("shiftleft", c.bitwiseAND(1) + 2, extra(c)) + _bits_at(o, extra(c)) + 1))
    token = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("int").alias("b"))

    def read(o: Column) -> Column:
        def literal_at(o1: Column) -> Column:
            return once(o1 + bits("red", o1), lambda o2: once(o2 + bits("blue", o2), lambda o3: token(0, symbol("alpha", o3) * (1 << 24) + symbol("red", o1) * 65536 + symbol("green", o) * 256 + symbol("blue", o2), F.lit(0))))

        def copy_at(o1: Column) -> Column:
            length = symbol("green", o) - 256
            return once(o1 + extra(length.cast("int")), lambda o2: token(2, value(length, o1), _distance(value(symbol("far", o2), o2 + bits("far", o2)))))

        at = o + bits("green", o)
        g = symbol("green", o)
        return F.when(g < 256, once(at, literal_at)).when(g < 256 + lz.LENGTH_CODES, once(at, copy_at)).otherwise(token(1, g - 256 - lz.LENGTH_CODES, F.lit(0)))

    return rows.select("image_id", "width", "height", "green_added", "cache", "stretch", F.transform("_seen", read).alias("tokens"))


def _bits_at(o: Column, n: Column) -> Column:
    """Up to 25 bits of the stretch at a bit offset, the first lowest."""
    byte = lambda k: F.coalesce(F.get(F.col("_b"), F.shiftright(o, 3) + k), F.lit(0)).cast("long")
    four = byte(0) + 256 * byte(1) + 65536 * byte(2) + 16777216 * byte(3)
    return F.call_function("shiftright", four, o.bitwiseAND(7)).bitwiseAND(F.call_function("shiftleft", F.lit(1), n) - 1).cast("int")


def _distance(code: Column) -> Column:
    """The pixel distance of a coded distance, under the row's ``width``."""
    x, y = (numbers(p[i] for p in lz.NEAR) for i in (0, 1))
    return once(code, lambda c: F.when(c > lz.NEAR_CODES, c - lz.NEAR_CODES).otherwise(F.greatest(F.lit(1), F.get(x, c - 1) + F.get(y, c - 1) * F.col("width"))))


def placed(read: DataFrame) -> DataFrame:
    """(image_id, width, height, green_added, cache, pos, kind, a, b, n): each token with its first pixel and number of pixels, none beyond the image."""
    count = lambda t: F.when(t["kind"] == 2, t["a"]).otherwise(1)
    rows = staged(read, _n=F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + count(t)))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("image_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_from", before)
    whole = F.col("width").cast("long") * F.col("height")
    rows = rows.where(F.col("_from") < whole).select("image_id", "width", "height", "green_added", "cache", "stretch", "_from", F.posexplode("tokens").alias("i", "t"))
    n = count(F.col("t"))
    inside = F.sum(n).over(W.partitionBy("image_id", "stretch").orderBy("i")) - n
    rows = rows.withColumn("pos", F.col("_from") + inside).where(F.col("pos") < whole)
    alone = F.count("*").over(W.partitionBy("image_id")) == 1
    n = F.when(alone & (F.col("t.kind") < 2), whole).otherwise(F.least(n, whole - F.col("pos")))
    return rows.select("image_id", "width", "height", "green_added", "cache", "pos", "t.kind", "t.a", "t.b", n.alias("n"))


def _followed(points: DataFrame) -> DataFrame:
    """(image_id, pos, root) of (image_id, pos, to), to null where a pixel stands for itself: where pointers end, by jumping."""
    rows = points.select("image_id", "pos", F.coalesce("to", "pos").alias("root"), F.col("to").isNotNull().alias("open"))
    while True:
        onward = rows.select("image_id", F.col("pos").alias("root"), F.col("root").alias("_then"), F.col("open").alias("_more"))
        jumped = rows.where("open").join(onward, ["image_id", "root"], "left")
        jumped = jumped.select("image_id", "pos", F.coalesce("_then", F.lit(-1)).alias("root"), F.coalesce("_more", F.lit(False)).alias("open"))
        rows = checkpointed(rows.where("not open").unionByName(jumped))
        if rows.where("open").isEmpty():
            return rows.select("image_id", "pos", "root")


def pixels_of(placed_: DataFrame) -> DataFrame:
    """(image_id, width, height, green_added, pos, argb) of placed tokens: copies and cached colours followed to their literals.

    A copied pixel points to its source, reduced to before the copy where both overlap. A cached one points to the last pixel
    before it that wrote its slot: slots are known without the colours, from the token where a pointer ends. An empty
    slot holds 0. A copy from before the image gives null."""
    each = placed_.select("image_id", "width", "height", "green_added", "cache", "kind", "a", "b", F.col("pos").alias("_p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_t"))
    each = each.withColumn("pos", F.col("_p") + F.col("_t")).withColumn("to", F.when(F.col("kind") == 2, F.col("_p") - F.col("b") + F.col("_t") % F.col("b")))
    each = checkpointed(each.drop("_p", "_t", "b"))
    roots = _followed(each.where("kind = 2").select("image_id", "pos", "to").unionByName(each.where("kind < 2").select("image_id", "pos", F.lit(None).cast("long").alias("to"))))
    ends = each.where("kind < 2").select("image_id", F.col("pos").alias("root"), F.col("kind").alias("_kind"), F.col("a").alias("_a"))
    rows = each.drop("a", "to").join(roots, ["image_id", "pos"]).join(ends, ["image_id", "root"], "left")
    hash_ = F.expr(f"shiftrightunsigned(cast((_a * {lz.CACHE_MULTIPLIER}L) & 4294967295L as bigint), 32 - cache)").cast("int")
    rows = rows.withColumn("slot", F.when(F.col("_kind") == 1, F.col("_a").cast("int")).when(F.col("cache") > 0, hash_))
    earlier = W.partitionBy("image_id", "slot").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.when(F.col("kind") == 1, F.last(F.when(F.col("kind") != 1, F.col("root")), ignorenulls=True).over(earlier)))
    rows = checkpointed(rows)
    hits = rows.where("kind = 1").select("image_id", "pos", F.col("_last").alias("to"))
    starts = rows.where("kind = 0").select("image_id", "pos", F.lit(None).cast("long").alias("to"))
    found = _followed(hits.unionByName(starts)).select("image_id", F.col("pos").alias("root"), F.col("root").alias("source"))
    colours = rows.where("kind = 0").select("image_id", F.col("pos").alias("source"), F.col("_a").alias("argb"))
    valued = found.join(colours, ["image_id", "source"], "left").select("image_id", "root", F.coalesce("argb", F.lit(0)).alias("argb"))
    return rows.select("image_id", "width", "height", "green_added", "pos", "root").join(valued, ["image_id", "root"], "left").drop("root")


def images_of(px: DataFrame, strip: int = 4096) -> DataFrame:
    """(image_id, width, height, data) of pixels: RGBA bytes; null data where a pixel is missing or null."""
    moved = lambda c: F.pmod(F.shiftright("argb", c) + F.when(F.col("green_added"), F.shiftright("argb", 8)).otherwise(0), F.lit(256)).bitwiseAND(255)
    one = F.lpad(F.hex(moved(16) * 16777216 + F.shiftright("argb", 8).bitwiseAND(255) * 65536 + moved(0) * 256 + F.shiftright("argb", 24).bitwiseAND(255)), 8, "0")
    rows = px.select("image_id", "width", "height", "pos", one.alias("d"))
    parts = rows.groupBy("image_id", "width", "height", F.expr(f"pos div {strip}").alias("s")).agg(F.count("d").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda p: p["d"]), "").alias("d"))
    whole = parts.groupBy("image_id", "width", "height").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "d"))), lambda p: p["d"]), "").alias("d"))
    return whole.select("image_id", "width", "height", F.when(F.col("n") == F.col("width").cast("long") * F.col("height"), F.unhex("d")).alias("data"))


def literal_images(files: DataFrame) -> DataFrame:
    """(image_id, width, height, data) of streams that have literals only, as ``codes.literal_stream`` writes them: no table of
    pixels is made, a stretch's tokens are its pixels. Streams with other tokens give null data."""
    rows = tokens(files).withColumn("_n", F.size("tokens"))
    whole = F.col("width").cast("long") * F.col("height")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("image_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    alone = F.count("*").over(W.partitionBy("image_id")) == 1
    rows = rows.withColumns({"_from": before, "_alone": alone})
    keep = F.least(F.col("_n"), F.greatest(whole - F.col("_from"), F.lit(0))).cast("int")
    rows = staged(rows, _t=F.when(F.col("_alone") & (F.col("_n") == 1), times(F.col("tokens")[0], whole)).otherwise(F.slice("tokens", F.lit(1), keep)))
    colour = lambda p: F.lpad(F.hex(_turned(p, F.col("green_added"))), 8, "0")
    digits = F.when(F.forall("_t", lambda t: t["kind"] == 0), F.array_join(F.transform("_t", lambda t: colour(t["a"])), ""))
    parts = rows.select("image_id", "width", "height", "stretch", digits.alias("d"))
    joined = parts.groupBy("image_id", "width", "height").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stretch", "d"))), lambda p: p["d"]), "").alias("d"))
    return joined.select("image_id", "width", "height", F.when(F.length("d") == 8 * whole, F.unhex("d")).alias("data"))


def _turned(p: Column, green_added: Column) -> Column:
    """Red, green, blue, alpha of alpha, red, green, blue; green added to red and blue where it had been taken off."""
    g = F.shiftright(p, 8).bitwiseAND(255)
    add = F.when(green_added, g).otherwise(0)
    return ((F.shiftright(p, 16) + add).bitwiseAND(255)) * 16777216 + g * 65536 + ((p + add).bitwiseAND(255)) * 256 + F.shiftright(p, 24).bitwiseAND(255)
