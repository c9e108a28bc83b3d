"""Queries of the lossless format as Spark operators write and read it, and their SQL.

What the SQL says is found another way: costs of codes by merging the two least counts again and again, codes by
package-merge over lists, lengths of matches by comparing pixel after pixel, distances by trying all near codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq import functions as fn
from mosaiq import operators as op
from mosaiq.codec import batch, lz
from mosaiq.codec.lossless import Options
from mosaiq.operators import batched, codes, copies, inverse, reading
from mosaiq.plans.grey import GREY, IMAGES, PIXELS, grey, images
from mosaiq.sources.scratch import checkpointed


def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits that each image's channels take under their best codes."""
    lengths = batched.literal_codes(images(spark, sf_dir))
    return lengths.groupBy("image_id", "tree").agg(F.count("*").alias("symbols"), F.sum(F.col("n") * F.col("len")).cast("long").alias("bits"))


def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = batched.literal_codes(images(spark, sf_dir))
    return coded.groupBy("image_id", "tree").agg(F.sum(F.col("code") * (F.col("symbol") + 1)).cast("long").alias("sum_code"), F.sum(F.col("len") * (F.col("symbol") + 1)).cast("long").alias("sum_len"))


def _through(all_images: DataFrame, options: Options, operators: Callable[[DataFrame], DataFrame], largest: int) -> DataFrame:
    """Images written as streams and read again: those of up to ``largest`` pixels many at a time, each in one task; larger ones by
    operators that divide an image among tasks."""
    size = F.col("width").cast("long") * F.col("height")
    coded = all_images.where(size <= largest).select("image_id", fn.stream_encode(F.col("data"), F.col("width"), F.col("height"), options).alias("content"))
    out = coded.select("image_id", fn.stream_decode(F.col("content")).alias("i")).select("image_id", "i.data", "i.width", "i.height")
    large = all_images.where(size > largest)
    return out if large.isEmpty() else out.unionByName(operators(large).select("image_id", "data", "width", "height"))


def lossless_streams(spark: SparkSession, sf_dir: str, largest: int = batch.LARGEST) -> DataFrame:
    """Every document's image written as a stream of literals and read again, large ones by stretches."""
    plain = Options(subtract_green=False, predictor=False, color_index=False, lz77=False, color_cache=False)
    back = _through(images(spark, sf_dir), plain, lambda large: reading.literal_images(checkpointed(codes.literal_stream(large))), largest)
    return back.select("image_id", F.md5("data").alias("md5"), "width", "height")


def lossless_copies(spark: SparkSession, sf_dir: str, largest: int = batch.LARGEST) -> DataFrame:
    """The same with copies, colour cache and subtract-green, followed back to literals by pointer jumping."""

    def operators(large: DataFrame) -> DataFrame:
        files = checkpointed(copies.stream(large, subtract_green=True))
        return reading.images_of(reading.pixels_of(reading.placed(checkpointed(reading.tokens(files)))))

    back = _through(images(spark, sf_dir), Options(predictor=False, color_index=False), operators, largest)
    return back.select("image_id", F.md5("data").alias("md5"), "width", "height")


def copy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image the places that could be copied, how far back and how long, and their coded distances."""
    found = batched.copy_sums(images(spark, sf_dir))
    return found.groupBy("image_id").agg(*(F.sum(c).alias(c) for c in ("n", "sum_back", "sum_length", "sum_code")))


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the five alphabets over all images, cached colours by their slot."""
    return batched.cached_symbols(images(spark, sf_dir)).groupBy("tree", "symbol").agg(F.sum("n").alias("n"))


def _at_places(rows: DataFrame) -> DataFrame:
    """image_id, pos, v of an image's rows of values."""
    each = rows.select("image_id", F.posexplode("rows").alias("y", "r")).select("image_id", "y", F.size("r").alias("w"), F.posexplode("r").alias("x", "v"))
    return each.select("image_id", (F.col("y") * F.col("w") + F.col("x")).alias("pos"), "v")


def predictor_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the select predictor, made and undone where the images are read."""
    return batched.select_roundtrip(images(spark, sf_dir))


def gradient_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey planes through the gradient filter, by windows, and back, by a fold over rows."""
    filtered = op.alpha_gradient(grey(spark, sf_dir))
    rows = filtered.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.col("v").cast("long").alias("v")))).alias("_r"))
    back = _at_places(inverse.gradient_inverse(rows.select("image_id", "y", F.transform("_r", lambda e: e["v"]).alias("r"))))
    return back.groupBy("image_id").agg(F.sum(F.col("v") * (F.col("pos") + 1)).cast("long").alias("sum_v"))


_TREES = " UNION ALL ".join(f"SELECT image_id, '{t}' AS tree, {c} AS symbol FROM px" for t, c in (("green", "g"), ("red", "r"), ("blue", "b"), ("alpha", "a")))
_HIST = f"hist AS (SELECT image_id, tree, symbol, count(*) AS n FROM ({_TREES}) GROUP BY ALL)"
_MD5 = f"WITH {IMAGES} SELECT image_id, md5(unhex(h)) AS md5, CAST(16 AS INT) AS width, CAST(length(h) // 128 AS INT) AS height FROM img"
_NEAR = "near AS (SELECT x, y, row_number() OVER (ORDER BY x * x + y * y, abs(x), x < 0) AS code FROM range(-7, 9) a(x), range(0, 8) b(y) WHERE y > 0 OR x > 0)"
_ARGB = f"{PIXELS}, q AS MATERIALIZED (SELECT image_id, pos, ((a::BIGINT * 256 + r) * 256 + g) * 256 + b AS p FROM px)"
_EXTRA = "CASE WHEN {0} <= 4 THEN 0 ELSE CAST(floor(log2({0} - 1)) AS INT) - 1 END"

ORACLES = {
    "code_lengths": f"""
        WITH RECURSIVE {PIXELS}, {_HIST},
        s AS (SELECT image_id, tree, list(n ORDER BY n) AS w, CAST(count(*) AS BIGINT) AS symbols FROM hist GROUP BY image_id, tree),
        m AS (SELECT image_id, tree, symbols, w, CASE WHEN symbols = 1 THEN w[1] ELSE 0 END AS bits FROM s
          UNION ALL SELECT image_id, tree, symbols, list_sort(list_append(w[3:], w[1] + w[2])), bits + w[1] + w[2] FROM m WHERE len(w) > 1)
        SELECT image_id, tree, symbols, CAST(bits AS BIGINT) AS bits FROM m WHERE len(w) = 1""",
    "canonical_codes": f"""
        WITH RECURSIVE {PIXELS}, {_HIST},
        s AS (SELECT image_id, tree, list(symbol ORDER BY n, symbol) AS symbols, list({{'w': n, 'p': 0}} ORDER BY n, symbol) AS leaves FROM hist GROUP BY image_id, tree),
        m AS (SELECT image_id, tree, 1 AS k, leaves AS items FROM s
          UNION ALL SELECT image_id, tree, k + 1, list_sort(list_concat(leaves, list_transform(range(0, len(items) // 2), lambda i: {{'w': items[2 * i + 1].w + items[2 * i + 2].w, 'p': 1}}))) FROM m JOIN s USING (image_id, tree) WHERE k < 15),
        t AS (SELECT image_id, tree, 15 AS k, 2 * len(leaves) - 2 AS take, 0 AS n FROM s
          UNION ALL SELECT image_id, tree, k - 1, 2 * (take - l), l FROM (SELECT image_id, tree, k, take, len(list_filter(items[1:take], lambda x: x.p = 0)) AS l FROM t JOIN m USING (image_id, tree, k)) WHERE k > 0),
        c AS (SELECT image_id, tree, list(n) AS used FROM t WHERE k < 15 GROUP BY image_id, tree),
        l AS (SELECT image_id, tree, symbols[i] AS symbol, CASE WHEN len(symbols) = 1 THEN 1 ELSE len(list_filter(used, lambda n: n >= i)) END AS len FROM s JOIN c USING (image_id, tree), range(1, 257) r(i) WHERE i <= len(symbols)),
        d AS (SELECT *, CAST(coalesce(sum(1 << CAST(15 - len AS INT)) OVER (PARTITION BY image_id, tree ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> CAST(15 - len AS INT) AS code FROM l)
        SELECT image_id, tree, CAST(sum(code * (symbol + 1)) AS BIGINT) AS sum_code, CAST(sum(len * (symbol + 1)) AS BIGINT) AS sum_len FROM d GROUP BY image_id, tree""",
    "lossless_streams": _MD5,
    "lossless_copies": _MD5,
    "copy_matches": f"""
        WITH RECURSIVE {_ARGB}, {_NEAR},
        t AS (SELECT *, lead(p, 1) OVER w AS p1, lead(p, 2) OVER w AS p2 FROM q WINDOW w AS (PARTITION BY image_id ORDER BY pos)),
        f AS MATERIALIZED (SELECT image_id, pos, pos - lag(pos) OVER (PARTITION BY image_id, p, p1, p2 ORDER BY pos) AS back FROM t WHERE p2 IS NOT NULL),
        x AS (SELECT image_id, pos, back, 3 AS n FROM f WHERE back < {lz.MAX_DISTANCE - lz.NEAR_CODES}
          UNION ALL SELECT x.image_id, x.pos, x.back, n + 1 FROM x JOIN q a ON a.image_id = x.image_id AND a.pos = x.pos + n JOIN q b ON b.image_id = x.image_id AND b.pos = x.pos + n - back WHERE a.p = b.p AND n < {lz.MAX_LENGTH}),
        l AS (SELECT image_id, pos, back, max(n) AS n FROM x GROUP BY ALL),
        d AS (SELECT l.*, c FROM l JOIN (SELECT back, arg_min(c, ({_EXTRA.format("c")}) * 10000000 + c) AS c FROM
          (SELECT DISTINCT l.back, code AS c FROM l JOIN near ON greatest(1, x + 16 * y) = l.back UNION ALL SELECT DISTINCT back, back + {lz.NEAR_CODES} FROM l) GROUP BY back) USING (back))
        SELECT image_id, count(*) AS n, CAST(sum((pos + 1) * back) AS BIGINT) AS sum_back, CAST(sum((pos + 1) * n) AS BIGINT) AS sum_length, CAST(sum((pos + 1) * c) AS BIGINT) AS sum_code FROM d GROUP BY image_id""",
    "predictor_inverse": f"WITH {PIXELS} SELECT image_id, " + ", ".join(f"CAST(sum({c} * (pos + 1)) AS BIGINT) AS sum_{c}" for c in "rgba") + " FROM px GROUP BY image_id",
    "gradient_inverse": f"WITH {GREY} SELECT image_id, CAST(sum(v * (pos + 1)) AS BIGINT) AS sum_v FROM grey GROUP BY image_id",
    "token_histogram": f"""
        WITH {_ARGB}, n AS (SELECT image_id, least(11, greatest(1, CAST(floor(log2(count(*))) AS INT) + 1 - 3)) AS bits FROM q GROUP BY image_id),
        s AS (SELECT q.*, ((p * {lz.CACHE_MULTIPLIER}) & 4294967295) >> CAST(32 - bits AS INT) AS slot FROM q JOIN n USING (image_id)),
        h AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY image_id, slot ORDER BY pos) = p, false) AS hit FROM s),
        y AS (SELECT 'green' AS tree, CASE WHEN hit THEN 280 + slot ELSE (p >> 8) & 255 END AS symbol FROM h
          UNION ALL SELECT 'red', (p >> 16) & 255 FROM h WHERE NOT hit UNION ALL SELECT 'blue', p & 255 FROM h WHERE NOT hit UNION ALL SELECT 'alpha', p >> 24 FROM h WHERE NOT hit)
        SELECT tree, CAST(symbol AS INT) AS symbol, count(*) AS n FROM y GROUP BY ALL""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
