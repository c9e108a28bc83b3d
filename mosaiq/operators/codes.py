"""Prefix codes as column expressions and aggregates: lengths, their transmission, bits of coded pixels, files.

A code is one row of (image_id, tree): alphabets are small (2,328 symbols at most), so arrays of a code's symbols are
bounded. Pixels are in strips, rows of bounded arrays, so that one image spreads over tasks; a strip's bits are a string
of 0 and 1 in the order of the stream. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.codec.huffman import LENGTH_ORDER
from mosaiq.operators import canonical_codes

TREES = ("green", "red", "blue", "alpha", "far")
STRIP = 4096


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out a single time, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def times(what: Column, n: Column) -> Column:
    """An array of n equal elements, none for n under 1 or null."""
    return F.array_repeat(what, F.greatest(F.coalesce(n, F.lit(0)).cast("int"), F.lit(0)))


def numbers(values: Iterable[int]) -> Column:
    """A constant array, made in one piece."""
    return F.expr(f"array({', '.join(map(str, values))})")


def field(value: Column, size: Column | int) -> Column:
    """A number's lowest ``size`` bits as the stream has them, the lowest first."""
    return F.when(F.lit(size) > 0, F.reverse(F.lpad(F.bin(value.cast("long")), F.lit(size), F.lit("0")))).otherwise("")


# -- code lengths ---------------------------------------------------------------------------------------------------


def merged_lengths(counts: Column, limit: int) -> Column:
    """Code lengths of at most ``limit`` bits with the least sum of length times count: array<int>, for an array of
    struct<n, symbol> sorted by n, then symbol. A lone symbol gets 1.

    Package-merge: ``limit`` times the leaves and the packages of two so far are put in order, leaves first of equals. Of the
    last list 2n - 2 items count; the packages among them say how many items of the list before count. A leaf's length
    is the number of lists in which it counts."""
    item = "struct<w: bigint, p: int>"

    def more(state: Column, _: Column) -> Column:
        def paired(items: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / 2).cast("int") - 1), lambda i: F.struct((items[2 * i]["w"] + items[2 * i + 1]["w"]).alias("w"), F.lit(1).alias("p")).cast(item))
            return F.sort_array(F.concat(state["leaves"], pairs))

        return once(paired(state["items"]), lambda items: F.struct(state["leaves"].alias("leaves"), items.alias("items"), F.concat(state["lists"], F.array(F.transform(items, lambda x: x["p"]))).alias("lists")))

    def counted(state: Column, flags: Column) -> Column:
        leaves = F.size(F.filter(F.slice(flags, F.lit(1), state["take"]), lambda p: p == 0))
        return once(leaves, lambda n: F.struct((2 * (state["take"] - n)).cast("int").alias("take"), F.concat(state["leaves"], F.array(n)).alias("leaves")))

    leaves = F.transform(counts, lambda c: F.struct(c["n"].cast("long").alias("w"), F.lit(0).alias("p")).cast(item))
    begin = once(leaves, lambda x: F.struct(x.alias("leaves"), x.alias("items"), F.array(F.transform(x, lambda i: i["p"])).alias("lists")))
    lists = F.aggregate(F.sequence(F.lit(2), F.lit(limit)), begin, more)["lists"]
    of_leaves = F.aggregate(F.reverse(lists), F.struct((2 * F.size(counts) - 2).cast("int").alias("take"), F.array().cast("array<int>").alias("leaves")), counted)["leaves"]
    lengths = once(of_leaves, lambda n: F.transform(counts, lambda _, i: F.size(F.filter(n, lambda k: k > i))))
    return F.when(F.size(counts) < 2, F.transform(counts, lambda _: F.lit(1))).otherwise(lengths)


def code_lengths(histogram: DataFrame, limit: int = 15) -> DataFrame:
    """(image_id, tree, symbol, n) with ``len``: the lengths of each image's and tree's best code; counts of 0 have none."""
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), "symbol")))
    codes = histogram.where("n > 0").groupBy("image_id", "tree").agg(sorted_.alias("_c"))
    each = codes.select("image_id", "tree", F.explode(F.arrays_zip(F.col("_c").alias("c"), merged_lengths(F.col("_c"), limit).alias("len"))).alias("e"))
    return each.select("image_id", "tree", "e.c.symbol", "e.c.n", "e.len")


# -- sending a code -------------------------------------------------------------------------------------------------


def _dense(entries: Column, size: Column, value, empty: Column) -> Column:
    """An array with ``value`` of each entry (sorted by its ``symbol``) at the symbol's place, ``empty`` elsewhere."""
    ends = F.concat(F.transform(F.slice(entries, F.lit(2), F.greatest(F.size(entries), F.lit(1))), lambda e: e["symbol"]), F.array(size))
    filled = F.flatten(F.zip_with(entries, ends, lambda e, to: F.concat(F.array(value(e)), times(empty, to - e["symbol"] - 1))))
    return F.concat(times(empty, F.coalesce(F.get(entries, F.lit(0))["symbol"], size)), filled)


def _length_tokens(lengths: Column) -> Column:
    """Lengths as struct<t, extra>: repeats of zeros (17, 18) or of the last length other than zero (16), or one length each."""
    token = lambda t, extra=0: F.struct(F.lit(t).cast("int").alias("t"), F.lit(extra).cast("int").alias("extra"))

    def run(of: Column, starts: Column, k: Column) -> Column:
        v = of[starts[k]]
        n = F.coalesce(F.get(starts, k + 1), F.size(of)) - starts[k]
        before = F.get(starts, F.when(of[F.coalesce(F.get(starts, k - 1), F.lit(0))] == 0, k - 2).otherwise(k - 1))  # of the last run other than zeros
        last = F.when((k == 0) | (F.coalesce(before, F.lit(-1)) < 0), 8).otherwise(of[F.coalesce(before, F.lit(0))])
        full, rest = F.floor(n / 138), n % 138
        zeros = F.concat(times(token(18, 127), full), F.when(rest >= 11, F.array(token(18, rest - 11))).when(rest >= 3, F.array(token(17, rest - 3))).otherwise(times(token(0), rest)))
        first = (v != last).cast("int")
        k6, left = F.floor((n - first) / 6), (n - first) % 6
        same = F.concat(times(token(v), first), times(token(16, 3), k6), F.when(left >= 3, F.array(token(16, left - 3))).otherwise(times(token(v), left)))
        return F.when(v == 0, zeros).otherwise(same)

    both = once(lengths, lambda of: F.struct(of.alias("of"), F.filter(F.sequence(F.lit(0), F.size(of) - 1), lambda i: (i == 0) | (of[i] != of[F.greatest(i - 1, F.lit(0))])).alias("starts")))
    return once(both, lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b["starts"]) - 1), lambda k: run(b["of"], b["starts"], k))))


def _small_codes(lengths: Column) -> Column:
    """Code strings, first bit first, of dense lengths of few symbols, where more than one is used."""

    def coded(of: Column) -> Column:
        lengths, top = of["lengths"], of["top"]
        before = lambda s: F.aggregate(F.transform(lengths, lambda n, t: F.when((n > 0) & ((n < lengths[s]) | ((n == lengths[s]) & (t < s))), F.call_function("shiftleft", F.lit(1), top - n)).otherwise(0)), F.lit(0), lambda a, b: a + b)
        code = lambda s: F.lpad(F.bin(F.call_function("shiftright", before(s), top - lengths[s]).cast("long")), lengths[s], F.lit("0"))
        return F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda s: F.when(of["many"] & (lengths[s] > 0), code(s)).otherwise(""))

    many = F.size(F.filter(lengths, lambda n: n > 0)) > 1
    return once(F.struct(lengths.alias("lengths"), F.array_max(lengths).alias("top"), many.alias("many")), coded)


def sent_codes(lengths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, tree, sent, bits, not_255): how the stream sends each code, and the code of each symbol of its alphabet, both as
    strings of bits, '' for the only symbol of a code; whether there is a symbol other than 255. ``lengths``: (image_id, tree, symbol, len); ``sizes``: (image_id, tree,
    size), a row for every code, with symbols or without."""
    coded = canonical_codes(lengths.select("image_id", "tree", "symbol", "len"))
    text = F.lpad(F.bin("code"), F.col("len"), F.lit("0"))
    entries = F.sort_array(F.collect_list(F.struct("symbol", F.col("len").cast("int").alias("len"), text.alias("code"))))
    rows = sizes.join(coded.groupBy("image_id", "tree").agg(entries.alias("e")), ["image_id", "tree"], "left")
    rows = rows.withColumn("e", F.coalesce("e", F.array().cast("array<struct<symbol: int, len: int, code: string>>")))
    rows = rows.withColumn("bits", _dense(F.col("e"), F.col("size"), lambda e: F.when(F.size("e") < 2, "").otherwise(e["code"]), F.lit("")))
    short = (F.size("e") <= 2) & F.forall("e", lambda e: e["symbol"] < 256)
    first = F.coalesce(F.get("e", F.lit(0))["symbol"], F.lit(0))
    simple = F.concat(F.lit("1"), field(F.greatest(F.size("e"), F.lit(1)) - 1, 1), F.when(first > 1, F.concat(F.lit("1"), field(first, 8))).otherwise(F.concat(F.lit("0"), field(first, 1))), F.when(F.size("e") == 2, field(F.get("e", F.lit(1))["symbol"], 8)).otherwise(""))
    rows = rows.withColumn("_tokens", F.when(~short, _length_tokens(_dense(F.col("e"), F.col("size"), lambda e: e["len"], F.lit(0)))))
    tally = F.filter(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda s: F.struct(F.size(F.filter("_tokens", lambda t: t["t"] == s)).cast("long").alias("n"), s.alias("symbol"))), lambda c: c["n"] > 0)
    rows = rows.withColumn("_tally", F.sort_array(tally))
    own = F.sort_array(F.zip_with("_tally", merged_lengths(F.col("_tally"), 7), lambda c, n: F.struct(c["symbol"].alias("symbol"), n.alias("len"))))
    rows = rows.withColumn("_own", F.when(F.col("_tokens").isNotNull(), _dense(own, F.lit(19), lambda e: e["len"], F.lit(0))))
    rows = rows.withColumn("_codes", _small_codes(F.col("_own")))
    order = numbers(LENGTH_ORDER)
    number = F.greatest(F.lit(4), F.array_max(F.transform(order, lambda s, i: F.when(F.col("_own")[s] > 0, i + 1).otherwise(0))))
    extra = lambda t: field(t["extra"], F.when(t["t"] == 16, 2).when(t["t"] == 17, 3).when(t["t"] == 18, 7).otherwise(0))
    lengths_sent = once(F.col("_own"), lambda own: F.array_join(F.transform(F.slice(order, F.lit(1), number), lambda s: field(own[s], 3)), ""))
    tokens_sent = once(F.col("_codes"), lambda codes: F.array_join(F.transform("_tokens", lambda t: F.concat(codes[t["t"]], extra(t))), ""))
    normal = F.concat(F.lit("0"), field(number - 4, 4), lengths_sent, F.lit("0"), tokens_sent)
    translucent = F.exists("e", lambda e: e["symbol"] != 255)
    return rows.select("image_id", "tree", F.when(short, simple).otherwise(normal).alias("sent"), "bits", translucent.alias("not_255"))


# -- bits into bytes ------------------------------------------------------------------------------------------------


def to_bytes(bits: Column) -> Column:
    """Bytes of a string of bits, the first bit lowest; the last byte is filled with zeros."""
    whole = F.reverse(F.rpad(bits, (F.ceil(F.length(bits) / 64) * 64).cast("int"), "0"))
    digits = F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("(.{64})"), F.lit(1)), lambda x: F.lpad(F.conv(x, 2, 16), 16, "0")), "")
    return F.substring(F.unhex(F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")), F.lit(1), F.ceil(F.length(bits) / 8).cast("int"))


def to_bits(content: Column) -> Column:
    """The string again, eight for every byte."""
    n = (F.ceil(F.octet_length(content) / 8) * 16).cast("int")
    digits = F.reverse(F.regexp_replace(F.rpad(F.hex(content), n, "0"), "(.)(.)", "$2$1"))
    binary = F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("(.{16})"), F.lit(1)), lambda x: F.lpad(F.conv(x, 16, 2), 64, "0")), "")
    return F.substring(F.reverse(binary), F.lit(1), 8 * F.octet_length(content))


def packed(strings: DataFrame) -> DataFrame:
    """(image_id, content) of (image_id, seq, bits): an image's bit strings in the order of seq, as bytes.

    A string's place is the sum of the lengths before it. Each becomes bytes where it lies; a byte that several strings
    share is the ``bit_or`` of their shares. Only a finished file lies in one row."""
    before = F.coalesce(F.sum(F.length("bits").cast("long")).over(W.partitionBy("image_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = strings.withColumn("_at", before).where(F.length("bits") > 0)
    rows = rows.select("image_id", F.expr("_at div 8").alias("at"), to_bytes(F.concat(F.repeat(F.lit("0"), (F.col("_at") % 8).cast("int")), "bits")).alias("c"))
    size = F.octet_length("c")
    byte = lambda at: F.struct((F.col("at") + at).alias("at"), F.conv(F.hex(F.substring("c", at + 1, F.lit(1))), 16, 10).cast("int").alias("byte"), F.lit(None).cast("string").alias("inner"))
    inner = F.struct((F.col("at") + 1).alias("at"), F.lit(None).cast("int").alias("byte"), F.hex(F.substring("c", F.lit(2), size - 2)).alias("inner"))
    pieces = rows.select("image_id", F.explode(F.array_compact(F.array(byte(F.lit(0)), F.when(size > 1, byte(size - 1)), F.when(size > 2, inner)))).alias("p"))
    once_each = pieces.groupBy("image_id", "p.at").agg(F.coalesce(F.max("p.inner"), F.lpad(F.hex(F.bit_or("p.byte")), 2, "0")).alias("digits"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("at", "digits"))), lambda p: p["digits"])
    return once_each.groupBy("image_id").agg(F.unhex(F.array_join(whole, "")).alias("content"))


# -- pixels and their codes -----------------------------------------------------------------------------------------


def strips(images: DataFrame, size: int = STRIP) -> DataFrame:
    """(image_id, width, height, strip, px): an image's pixels as numbers alpha, red, green, blue, ``size`` at a time."""
    pixel = lambda c, i: F.conv(F.hex(F.substring(c, 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    turned = lambda v: F.shiftright(v, 8).bitwiseOR(F.shiftleft(v.bitwiseAND(255), 24))
    last = F.ceil(F.col("width").cast("long") * F.col("height") / size).cast("int") - 1
    cut = images.select("image_id", "width", "height", "data", F.explode(F.sequence(F.lit(0), last)).alias("strip"))
    n = F.least(F.lit(size).cast("long"), F.col("width").cast("long") * F.col("height") - F.col("strip").cast("long") * size)
    cut = cut.select("image_id", "width", "height", "strip", F.substring("data", F.col("strip") * 4 * size + 1, (4 * n).cast("int")).alias("_d"))
    px = F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("_d") / 4).cast("int") - 1), lambda i: turned(pixel(F.col("_d"), i)))
    return cut.select("image_id", "width", "height", "strip", px.alias("px"))


def channel(argb: Column, name: str) -> Column:
    return F.shiftright(argb, {"alpha": 24, "red": 16, "green": 8, "blue": 0}[name]).bitwiseAND(255).cast("int")


def literal_histogram(rows: DataFrame) -> DataFrame:
    """(image_id, tree, symbol, n) of strips: a pixel's four channels, summed by colour first."""
    colors = rows.select("image_id", F.explode("px").alias("p")).groupBy("image_id", "p").agg(F.count("*").alias("n"))
    each = colors.select("image_id", "n", F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), channel(F.col("p"), t).alias("symbol")) for t in TREES[:4]))).alias("e"))
    return each.groupBy("image_id", "e.tree", "e.symbol").agg(F.sum("n").alias("n"))


def alphabets(images: DataFrame, cache: Column | None = None) -> DataFrame:
    """(image_id, tree, size): the five codes of every image; ``cache``: bits of its colour cache."""
    green = F.lit(280) if cache is None else F.lit(280) + F.when(cache > 0, F.call_function("shiftleft", F.lit(1), cache)).otherwise(0)
    sizes = F.array(*(F.struct(F.lit(t).alias("tree"), n.cast("int").alias("size")) for t, n in zip(TREES, (green, F.lit(256), F.lit(256), F.lit(256), F.lit(40)), strict=True)))
    return images.select("image_id", F.explode(sizes).alias("s")).select("image_id", "s.tree", "s.size")


def by_tree(sent: DataFrame) -> DataFrame:
    """(image_id, sent, translucent, and an array of code strings for each tree): one row for each image."""
    pick = lambda c, t: F.max(F.when(F.col("tree") == t, F.col(c)))
    return sent.groupBy("image_id").agg(F.concat(*(pick("sent", t) for t in TREES)).alias("sent"), pick("not_255", "alpha").alias("translucent"), *(F.first(F.when(F.col("tree") == t, F.col("bits")), ignorenulls=True).alias(t) for t in TREES))


def head(width: Column, height: Column, alpha: Column) -> Column:
    """The first 40 bits: signature, size, alpha flag, version."""
    return F.concat(field(F.lit(0x2F), 8), field(width - 1, 14), field(height - 1, 14), F.when(alpha, "1").otherwise("0"), F.lit("000"))


def literal_stream(images: DataFrame) -> DataFrame:
    """(image_id, content): a lossless chunk's payload of every image, without transforms, cache or copies."""
    rows = strips(images)
    codes = by_tree(sent_codes(code_lengths(literal_histogram(rows)), alphabets(images)))
    first = images.select("image_id", "width", "height", F.lit(-1).alias("strip"), F.array().cast("array<bigint>").alias("px"))
    begin = F.concat(head(F.col("width"), F.col("height"), F.col("translucent")), F.lit("000"), "sent")
    one = lambda p: F.concat(*(F.col(t)[channel(p, t)] for t in TREES[:4]))
    bits = F.when(F.col("strip") < 0, begin).otherwise(F.array_join(F.transform("px", one), ""))
    return packed(rows.unionByName(first).join(codes, "image_id").select("image_id", F.col("strip").alias("seq"), bits.alias("bits")))
