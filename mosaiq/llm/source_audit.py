"""Source divergence audit: which sources of a language use its common words differently, and which words.

Every (language, source) group and every language gives each of the language's kept terms a smoothed share

    p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))

with N the group's occurrences of kept terms and V their number. Two sources lie as far apart as their shares
differ, summed over all kept terms. That sum is not taken over all terms: a pair starts at V times the difference of
the shares of zero counts. Each group's own terms then correct it once for every other source (from the group's
shares with their frequency, not term by term), and the postings of a term that both sources use correct it once
more. So the work follows the postings, not sources times terms.

Nulls in text, lang and source are read as ''. Texts without terms count for their group, which still gets its
rows. Repeated rows are documents of their own. Equal values rank by the item's UTF-8 bytes. A language with no
kept term has pairs of value 0 and no terms; an empty table has no rows; other columns pass unread."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.llm.common import table, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as terms see them: A-Z lower-cased, what stands between terms as spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a task holds at a time.
HELD = 1 << 18
SCALE, SMOOTH = 1_000_000_000, 5


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it). A task counts the terms of whole texts, hands its
    counts on once it holds HELD of them, and Spark adds them up: no row for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            for lang, source, text in zip(*(b.column(c).cast(pa.binary()) for c in ("lang", "source", "text")), strict=True):
                n, with_it = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                terms, before = text.as_py().translate(_TERMS).split(), len(n)
                n.update(terms)
                with_it.update(set(terms))
                size += len(n) - before
                if size >= HELD:
                    yield from counted(held)
                    held, size = {}, 0
        yield from counted(held)

    def counted(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, with_it) in held.items():
            texts = ([lang] * len(n), [source] * len(n), list(n))
            counts = (list(n.values()), [with_it[t] for t in n])
            columns = [pa.array(x, pa.binary()).cast(pa.string()) for x in texts] + [pa.array(x, pa.int64()) for x in counts]
            yield pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])

    each = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = each.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p, exactly: decimals hold SCALE times any count."""
    whole = F.call_function("div", (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + SMOOTH * kept).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + whole


def _ranked(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts = written(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs)
    kept = written(kept.select("lang", "term", "n_lang"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    used = counts.select("lang", "term", "source", "n").join(kept, ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "total_lang"])
    groups = written(groups.withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))), "groups")
    posts = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    posts = written(posts.withColumn("q", share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))).select("lang", "source", "term", "p", "p0", "q"), "postings")
    terms = posts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(_pairs(groups, posts)).unionByName(_ranked(terms).where(F.col("rank") <= top))


def _pairs(groups: DataFrame, posts: DataFrame) -> DataFrame:
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), *extra) for s, extra in (("a", ["kept"]), ("b", [])))
    both = written(one.join(two, "lang").where("a <> b").withColumn("base", F.coalesce(F.abs(F.col("a0") - F.col("b0")), F.lit(0))), "pairs")
    start = both.where("a < b").select("lang", "a", "b", (F.col("kept") * F.col("base")).alias("v"))
    shares = posts.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("m"))
    own = shares.join(both, ["lang", "a"]).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * (F.abs(F.col("p") - F.col("b0")) - F.col("base"))).alias("v"))
    left, right = (posts.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"{s}p"), F.col("p0").alias(f"{s}0")) for s in "ab")
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    shared = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (apart("ap", "bp") - apart("ap", "b0") - apart("a0", "bp") + apart("a0", "b0")).alias("v")).where("v <> 0")
    sums = start.unionByName(own).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return sums.select("lang", "value", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.n AS nl FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
t AS (SELECT *, sum(n) OVER s AS total, sum(nl) OVER s AS total_l, count(*) OVER s AS v FROM c WINDOW s AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, CAST(1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (total + {SMOOTH} * v) AS BIGINT) AS p, CAST(1 + ({SCALE}::HUGEINT * (nl + {SMOOTH})) // (total_l + {SMOOTH} * v) AS BIGINT) AS q FROM t),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
a AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM a)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
