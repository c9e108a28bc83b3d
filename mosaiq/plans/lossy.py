"""Queries of the lossy format's parts over grey images, and their SQL.

Those that code a whole stream use tables made by a rule (``ruled_tables``): the format's own are a parameter."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq import functions as fn
from mosaiq import operators as op
from mosaiq.codec import lossy
from mosaiq.codec import lossy_stream as stream
from mosaiq.codec.lossless import Image
from mosaiq.operators import blocks as bl
from mosaiq.plans.grey import GREY, grey

#: No pixel of an 8 x 8 grey image is further off after coding with the finest steps of ``ruled_tables``.
LUMA_ERROR = 8


@cache
def ruled_tables() -> stream.Tables:
    """Tables of the right shapes: linear steps, chances that follow the place."""
    steps = 4 + np.arange(128)
    place = lambda *shape: np.arange(int(np.prod(shape))).reshape(shape)
    return stream.Tables(1 + place(4, 8, 3, 11) * 31 % 255, 200 + place(4, 8, 3, 11) % 56, 1 + place(10, 10, 9) * 17 % 255, steps, steps + steps // 2)


def _sum(array: Column, name: str) -> Column:
    """The array's sum weighted by position."""
    return F.aggregate(F.zip_with(array, F.sequence(F.lit(1), F.size(array)), lambda v, k: v * k), F.lit(0).cast("long"), lambda s, v: s + v).alias(name)


def _bytes(px: DataFrame) -> DataFrame:
    """image_id, data: the 64 values as bytes."""
    found = px.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.lpad(F.hex("v"), 2, "0").alias("h")))).alias("p"))
    return found.select("image_id", F.unhex(F.array_join("p.h", "")).alias("data"))


def _blocks(spark: SparkSession, sf_dir: str, factor: int = 1) -> DataFrame:
    return bl.blocks(grey(spark, sf_dir).withColumn("v", (F.col("v") - 128) * factor))


def fdct_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir).withColumn("c", bl.forward_dct(F.col("block")))
    return found.select("image_id", "block_x", "block_y", F.col("c")[0].alias("dc"), _sum(F.col("c"), "sum_c"))


def idct_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bl.inverse_dct(_blocks(spark, sf_dir, 5))
    pixels = bl.add_clip(F.array_repeat(F.lit(128), 16), F.col("residual"))
    flat = bl.inverse_dct_flat(F.col("block")[0])
    return found.select("image_id", "block_x", "block_y", _sum(F.col("residual"), "sum_residual"), _sum(pixels, "sum_pixels"), _sum(flat, "sum_flat"))


def wht_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bl.inverse_wht(bl.forward_wht(_blocks(spark, sf_dir)), "wht", "back")
    return found.select("image_id", "block_x", "block_y", _sum(F.col("wht"), "sum_wht"), _sum(F.col("back"), "sum_back"))


def intra_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.blocks(grey(spark, sf_dir), size=8)
    top, left = F.slice("block", 1, 8), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at("block", (i * 8 + 1).cast("int")))
    some = lambda edge, bit: F.when(F.col("image_id").bitwiseAND(bit) == 0, edge)
    modes = [F.struct(F.lit(m).alias("mode"), _sum(bl.predict_square(some(top, 1) if m == "dc" else top, some(left, 2) if m == "dc" else left, F.col("block")[63], m, 8), "sum_v")) for m in ("dc", "v", "h", "tm")]
    return b.select("image_id", F.inline(F.array(*modes)))


def intra_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.blocks(grey(spark, sf_dir), size=8)
    return b.select("image_id", F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), _sum(bl.predict_sub(F.col("block"), m), "sum_v")) for m in stream.SUB_MODES))))


def edge_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = grey(spark, sf_dir).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", F.expr("120 + shiftright(v, 4)").alias("v")))).alias("p"))
    i = F.col("image_id")
    limits = ((i % 64).cast("int"), (i % 12 + 1).cast("int"), (i % 3).cast("int"))
    kinds = {"simple": (True, True), "outer": (True, False), "within": (False, False)}
    return px.select("image_id", "y", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), _sum(bl.filter_edge(F.col("p.v"), *limits, *how), "sum_v")) for k, how in kinds.items()))))


def alpha_unfilter_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _bytes(op.alpha_gradient(grey(spark, sf_dir)))  # an alpha chunk: raw, gradient filter
    chunk = F.concat(F.unhex(F.lit("0C")), F.col("data"))
    return raw.select("image_id", F.md5(fn.alpha_decode(chunk, F.lit(8), F.lit(8))).alias("md5"))


def bool_coder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def through(data: pd.Series) -> pd.Series:
        def one(d: bytes) -> bytes:
            chances = [1 + 37 * i % 255 for i in range(8 * len(d))]
            out = lossy.BoolEncoder()
            for bit, chance in zip(np.unpackbits(np.frombuffer(d, np.uint8)).tolist(), chances, strict=True):
                out.put(bit, chance)
            back = lossy.BoolDecoder(out.finish())
            return np.packbits([back.get(chance) for chance in chances]).tobytes()

        return data.map(one)

    return _bytes(grey(spark, sf_dir)).select("image_id", F.md5(through("data")).alias("md5"))


def lossy_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, whether every alpha is 255, and whether no pixel's luma is off by more than LUMA_ERROR."""

    @F.pandas_udf("width int, height int, opaque boolean, is_near boolean")
    def through(data: pd.Series) -> pd.DataFrame:
        def one(d: bytes) -> tuple:
            rgba = np.repeat(np.frombuffer(d, np.uint8), 4).reshape(8, 8, 4).copy()
            rgba[..., 3] = 255
            back = stream.decode(stream.encode(Image(rgba.tobytes(), 8, 8), 0, ruled_tables()), ruled_tables())
            got = np.frombuffer(back.data, np.uint8).reshape(8, 8, 4)
            apart = np.abs(lossy.rgb_to_yuv(got)[0].astype(int) - lossy.rgb_to_yuv(rgba)[0])
            return back.width, back.height, bool((got[..., 3] == 255).all()), bool(apart.max() <= LUMA_ERROR)

        return pd.DataFrame([one(d) for d in data], columns=["width", "height", "opaque", "is_near"])

    return _bytes(grey(spark, sf_dir)).select("image_id", through("data").alias("r")).select("image_id", "r.*")


_WHT = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
_SPOT = "CAST(image_id AS BIGINT) AS image_id, CAST(x // 4 AS INT) AS block_x, CAST(y // 4 AS INT) AS block_y, y % 4 * 4 + x % 4 AS i, v - 128 AS v"
_BY = "image_id, block_x, block_y"


def _weights(name: str, matrix: np.ndarray) -> str:
    rows = ", ".join(f"({j}, {i}, {int(w)})" for j, row in enumerate(matrix) for i, w in enumerate(row))
    return f"{name}(j, i, w) AS (VALUES {rows})"


def _apply(source: str, weights: str, bias: int, shift: int) -> str:
    return f"SELECT {_BY}, j AS i, CAST(sum(v * w) + {bias} AS BIGINT) >> {shift} AS v FROM {source} JOIN {weights} USING (i) GROUP BY {_BY}, j"


def _idct_levels() -> tuple[str, str]:
    turn = lambda p, f: f"((({p}) * {f}) >> 16)"

    def once(p: list[str]) -> list[str]:
        x, y = f"{turn(p[1], 35468)} - {turn(p[3], 85627)}", f"{turn(p[1], 85627)} + {turn(p[3], 35468)}"
        return [f"({p[0]} + {p[2]} + {y})", f"({p[0]} - {p[2]} + {x})", f"({p[0]} - {p[2]} - ({x}))", f"({p[0]} + {p[2]} - ({y}))"]

    down = [once([f"c[{4 * r + x + 1}]" for r in range(4)]) for x in range(4)]
    along = [v for r in range(4) for v in once([f"(t[{4 * r + 1}] + 4)", *(f"t[{4 * r + x + 1}]" for x in range(1, 4))])]
    return ", ".join(down[i % 4][i // 4] for i in range(16)), ", ".join(f"({v} >> 3)" for v in along)


_T, _O = _idct_levels()
_TOTAL = lambda array, name: f"CAST(list_sum(list_transform(range(1, len({array}) + 1), lambda k: {array}[k] * k)) AS BIGINT) AS {name}"
_CLIP = lambda v, a=-128, b=127: f"greatest(least({v}, {b}), {a})"
_MOVE = lambda p, d: f"({_CLIP(f'{p} - 128 + ({d})')} + 128)"
_SAME = f"WITH {GREY} SELECT image_id, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY pos))) AS md5 FROM grey GROUP BY image_id"


def _edges() -> str:
    names = ("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3")
    steps = " AND ".join(f"abs({a} - {b}) <= image_id % 12 + 1" for a, b in zip(names, names[1:], strict=False) if (a, b) != ("p0", "q0"))
    third = lambda base, k: f"({_CLIP(f'{base} + {k}')} >> 3)"
    tap = lambda w: _CLIP(f"(({w} * strong + 63) >> 7)")
    weak = third(_CLIP("slope"), 4)
    moves = {
        "near": {"p0": third("strong", 3), "q0": f"-{third('strong', 4)}"},
        "outer": {n: s + tap(w) for w, p, q in ((27, "p0", "q0"), (18, "p1", "q1"), (9, "p2", "q2")) for n, s in ((p, ""), (q, "-"))},
        "within": {"p0": third(_CLIP("slope"), 3), "q0": f"-{weak}", "p1": f"(({weak} + 1) >> 1)", "q1": f"-(({weak} + 1) >> 1)"},
    }
    lists = {k: "[" + ", ".join(_MOVE(n, m[n]) if n in m else n for n in names) + "]" for k, m in moves.items()}
    return f"""
        WITH {GREY}, s AS (SELECT image_id, y, list(CAST(120 + (v >> 4) AS BIGINT) ORDER BY x) AS s FROM grey GROUP BY image_id, y),
        n AS (SELECT image_id, y, s, {", ".join(f"s[{i + 1}] AS {n}" for i, n in enumerate(names))} FROM s),
        e AS (SELECT *, 3 * (q0 - p0) AS slope, {_CLIP(_CLIP("p1 - q1") + " + 3 * (q0 - p0)")} AS strong, 2 * abs(p0 - q0) + (abs(p1 - q1) >> 1) <= image_id % 64 AS low,
          {steps} AS even, abs(p1 - p0) > image_id % 3 OR abs(q1 - q0) > image_id % 3 AS rough FROM n),
        k AS (SELECT image_id, y, 'simple' AS kind, CASE WHEN low THEN {lists["near"]} ELSE s END AS o FROM e
          UNION ALL SELECT image_id, y, 'outer', CASE WHEN NOT (low AND even) THEN s WHEN rough THEN {lists["near"]} ELSE {lists["outer"]} END FROM e
          UNION ALL SELECT image_id, y, 'within', CASE WHEN NOT (low AND even) THEN s WHEN rough THEN {lists["near"]} ELSE {lists["within"]} END FROM e)
        SELECT image_id, CAST(y AS INT) AS y, kind, {_TOTAL("o", "sum_v")} FROM k"""


_SUB = np.concatenate([stream.SUB_WEIGHTS[m] for m in stream.SUB_MODES if m in stream.SUB_WEIGHTS])
_SUB_NAMES = "[" + ", ".join(f"'{m}'" for m in stream.SUB_MODES if m in stream.SUB_WEIGHTS) + "]"

ORACLES = {
    "fdct_block": f"WITH {GREY}, s AS (SELECT {_SPOT} FROM grey), {_weights('w', lossy.FORWARD)}, c AS ({_apply('s', 'w', 1 << lossy.FORWARD_BITS - 1, lossy.FORWARD_BITS)}) SELECT {_BY}, CAST(max(v) FILTER (i = 0) AS INT) AS dc, CAST(sum(v * (i + 1)) AS BIGINT) AS sum_c FROM c GROUP BY {_BY}",
    "idct_block": f"""
        WITH {GREY}, s AS (SELECT {_SPOT} FROM grey), c AS (SELECT {_BY}, list(CAST(5 * v AS BIGINT) ORDER BY i) AS c FROM s GROUP BY {_BY}),
        t AS (SELECT {_BY}, c, [{_T}] AS t FROM c), o AS (SELECT {_BY}, c, [{_O}] AS o FROM t)
        SELECT {_BY}, {_TOTAL("o", "sum_residual")}, {_TOTAL("list_transform(o, lambda r: greatest(least(r + 128, 255), 0))", "sum_pixels")}, CAST(136 * ((c[1] + 4) >> 3) AS BIGINT) AS sum_flat FROM o""",
    "wht_block": f"WITH {GREY}, s AS (SELECT {_SPOT} FROM grey), {_weights('w', np.kron(_WHT, _WHT))}, f AS ({_apply('s', 'w', 0, 1)}), b AS ({_apply('f', 'w', 3, 3)}) SELECT {_BY}, CAST(sum(f.v * (i + 1)) AS BIGINT) AS sum_wht, CAST(sum(b.v * (i + 1)) AS BIGINT) AS sum_back FROM f JOIN b USING ({_BY}, i) GROUP BY {_BY}",
    "intra_square": f"""
        WITH {GREY}, e AS (SELECT image_id, list(v ORDER BY x) FILTER (y = 0) AS top, list(v ORDER BY y) FILTER (x = 0) AS lft, max(v) FILTER (pos = 63) AS corner FROM grey GROUP BY image_id),
        d AS (SELECT *, CASE WHEN image_id & 1 = 0 THEN 8 ELSE 0 END + CASE WHEN image_id & 2 = 0 THEN 8 ELSE 0 END AS n, CASE WHEN image_id & 1 = 0 THEN list_sum(top) ELSE 0 END + CASE WHEN image_id & 2 = 0 THEN list_sum(lft) ELSE 0 END AS total FROM e),
        p AS (SELECT image_id, pos, mode, CASE mode WHEN 'v' THEN top[x + 1] WHEN 'h' THEN lft[y + 1] WHEN 'tm' THEN {_CLIP("top[x + 1] + lft[y + 1] - corner", 0, 255)} ELSE CASE WHEN n = 0 THEN 128 ELSE (total + n // 2) // n END END AS v
          FROM grey JOIN d USING (image_id), (VALUES ('dc'), ('v'), ('h'), ('tm')) m(mode))
        SELECT image_id, mode, CAST(sum(v * (pos + 1)) AS BIGINT) AS sum_v FROM p GROUP BY image_id, mode""",
    "intra_sub": f"""
        WITH {GREY}, {_weights('w', _SUB)}, a AS (SELECT image_id, list(v ORDER BY pos) AS a FROM grey WHERE pos < 13 GROUP BY image_id),
        d AS (SELECT image_id, j, CAST(sum(v * w) + 2 AS BIGINT) >> 2 AS v FROM grey JOIN w ON pos = i GROUP BY image_id, j),
        o AS (SELECT image_id, {_SUB_NAMES}[j // 16 + 1] AS mode, j % 16 AS i, v FROM d
          UNION ALL SELECT image_id, 'dc', i, (a[1] + a[2] + a[3] + a[4] + a[6] + a[7] + a[8] + a[9] + 4) >> 3 FROM a, range(16) r(i)
          UNION ALL SELECT image_id, 'tm', i, {_CLIP("a[4 - i // 4] + a[6 + i % 4] - a[5]", 0, 255)} FROM a, range(16) r(i))
        SELECT image_id, mode, CAST(sum(v * (i + 1)) AS BIGINT) AS sum_v FROM o GROUP BY image_id, mode""",
    "edge_filters": _edges(),
    "alpha_unfilter_gradient": _SAME,
    "bool_coder_roundtrip": _SAME,
    "lossy_roundtrip_error": "SELECT vec_id AS image_id, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, true AS opaque, true AS is_near FROM embeddings",
}

QUERIES = {name: globals()[name] for name in ORACLES}
