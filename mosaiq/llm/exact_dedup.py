"""Exact deduplication over an extendible-hash index in the shared folder, JVM-side throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import partitions, table, written

#: Buckets that an owner task gets, about, where no capacity is given: each is at least half full.
BUCKETS_PER_TASK = 4
#: A bucket of more rows than so many times the mean is dealt to several owners; only its copies are so many.
HEAVY = 2
#: Bits of the repeat filter for each hash that occurs twice, and log2 of the bits that are sent to tasks at most.
FILTER_RATE, FILTER_BITS = 16, 28

_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def hashed(norm: Column, hash_bits: int = 64) -> Column:
    """The index's key; fewer than 64 bits force collisions, for tests."""
    h = F.xxhash64(norm)
    return h if hash_bits == 64 else F.shiftleft(h, 64 - hash_bits)


@dataclass
class Directory:
    """Buckets as (local depth, prefix, keys, rows); the directory's 2^depth entries point at them."""

    buckets: list[tuple[int, int, int, int]]

    @property
    def depth(self) -> int:
        """The global depth: the greatest of the buckets', one at least."""
        return max([1, *(d for d, *_ in self.buckets)])

    def entries(self, spark) -> DataFrame:
        """_entry, bucket, slices: every entry of the directory. Their number is some times that of the tasks."""
        rows, top = [], self.depth
        mean = max(1.0, sum(n for *_, n in self.buckets) / max(1, len(self.buckets)))
        for k, (d, p, _, n) in enumerate(sorted(self.buckets, key=lambda b: b[1] << (64 - b[0]))):
            slices = max(1, int(n / (HEAVY * mean)))
            rows += [((p << (top - d)) + i, k, slices) for i in range(1 << (top - d))]
        return spark.createDataFrame(rows or [(0, 0, 1)], "_entry long, bucket int, slices int")

    def entry(self) -> Column:
        return F.shiftrightunsigned("h", 64 - self.depth)


def directory(keys: DataFrame, capacity: int | None = None) -> Directory:
    """Grow the directory by doubling until no bucket holds more than ``capacity`` distinct keys.

    ``keys`` has each distinct hash ``h`` once, with its ``n`` rows. A round counts the keys under the
    overfull buckets by some bits more, one aggregate whose result has a row for each bucket to come, and
    splits buckets level by level; what is still overfull takes another round. Equal hashes are one key,
    so that every bucket ends at a single key at the latest. By default the capacity gives each task
    BUCKETS_PER_TASK full buckets, whatever the number of keys."""
    total = keys.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if capacity is None:
        capacity = max(1, -(-total["k"] // (BUCKETS_PER_TASK * partitions(keys.sparkSession))))
    done: list[tuple[int, int, int, int]] = []
    level, depth = {0: (total["k"], total["n"] or 0)}, 0
    while True:
        over = {p: kn for p, kn in level.items() if kn[0] > capacity}
        done += [(depth, p, *kn) for p, kn in level.items() if p not in over]
        if not over:
            return Directory(done)
        more = min(64 - depth, max(1, (max(k for k, _ in over.values()) // capacity).bit_length()))
        under = keys
        if depth:
            full = keys.sparkSession.createDataFrame([(p,) for p in over], "_p long")
            under = keys.withColumn("_p", F.shiftrightunsigned("h", 64 - depth)).join(F.broadcast(full), "_p")
        prefix = F.shiftrightunsigned("h", 64 - depth - more) if depth + more < 64 else F.col("h")
        counts = under.groupBy(prefix.alias("p")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
        fine = {r["p"] % (1 << 64): (r["k"], r["n"]) for r in counts}
        for step in range(1, more + 1):  # double: every overfull bucket becomes two
            level = {2 * p + i: (0, 0) for p in over for i in (0, 1)}
            for q, (k, n) in fine.items():
                if (p := q >> (more - step)) in level:
                    level[p] = (level[p][0] + k, level[p][1] + n)
            depth += 1
            if step < more:
                over = {p: kn for p, kn in level.items() if kn[0] > capacity}
                done += [(depth, p, *kn) for p, kn in level.items() if p not in over]
                if not over:
                    return Directory(done)


def repeated(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with the column ``_again``: whether its hash ``h`` may occur in two rows; false is certain.

    A bit filter whose size follows the number of such hashes is sent to the tasks, if it has no more than
    2^FILTER_BITS bits; beyond that a join by hash tells."""
    twice = keys.where("n > 1").select("h")
    bits = max(12, (FILTER_RATE * twice.count()).bit_length())
    if bits > FILTER_BITS:
        return docs.join(twice.withColumn("_again", F.lit(True)), "h", "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
    at = f"cast(shiftrightunsigned(h, {64 - bits}) & 63 as int)"
    word = F.shiftrightunsigned("h", 64 - bits + 6)
    words = twice.groupBy(word.alias("_w")).agg(F.bit_or(F.expr(f"shiftleft(1L, {at})")).alias("_bits"))
    found = docs.withColumn("_w", word).join(F.broadcast(words), "_w", "left")
    return found.withColumn("_again", F.expr(f"coalesce(shiftrightunsigned(_bits, {at}) & 1 = 1, false)")).drop("_w", "_bits")


def index(docs: DataFrame, capacity: int | None = None, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, Directory]:
    """Build the index: (entries, links, directory), the first two written in the shared folder.

    entries: doc_id, h, sha, n_cp, x, one row per document. links: bucket, h, sha, rep, rep_cp, group_size:
    what the owners of the buckets found; sha is null where a key occurs once.

    The directory sends each row to the task that owns its bucket, a range of keys. There the rows of one
    key chain, and their texts' bytes tell the links of a chain apart: each link counts its rows and keeps
    the best. A text whose key occurs once goes without its bytes. A heavy bucket's rows are dealt to several
    owners first, who each leave one row of equal texts to the bucket; so a hot text never meets in one task."""
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    n_cp = F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp")
    read = docs.select("doc_id", norm.alias("norm"), n_cp, F.xxhash64("text").alias("x"))
    entries = read.select("doc_id", hashed(F.col("norm"), hash_bits).alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "n_cp", "x")
    entries = written(entries, "dedup-entries")
    keys = written(entries.groupBy("h").agg(F.count("*").alias("n")), "dedup-keys")
    grown = directory(keys, capacity)

    rows = repeated(read.withColumn("h", hashed(F.col("norm"), hash_bits)), keys).withColumn("_entry", grown.entry())
    rows = rows.join(F.broadcast(grown.entries(spark)), "_entry")
    rows = rows.select("bucket", "slices", F.pmod(F.xxhash64("doc_id", "x"), "slices").alias("slice"), "h", F.when(F.col("_again"), F.col("norm")).alias("norm"), "n_cp", "doc_id")
    owned = rows.repartition(partitions(spark), "bucket", "slice")
    best = F.max(F.struct("n_cp", (-F.col("doc_id")).alias("neg"))).alias("best")
    chain = owned.groupBy("bucket", "slices", "slice", "h", "norm").agg(best, F.count("*").alias("n"))
    chain = written(chain.drop("slice"), "dedup-chains")
    heavy = chain.where("slices > 1").repartition(partitions(spark), "bucket", "h").groupBy("bucket", "slices", "h", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    links = chain.where("slices = 1").select(heavy.columns).unionByName(heavy)
    sha = F.when(F.col("norm").isNotNull(), F.sha2(F.col("norm").cast("binary"), 256))
    links = links.select("bucket", "h", sha.alias("sha"), (-F.col("best.neg")).alias("rep"), F.col("best.n_cp").alias("rep_cp"), F.col("n").alias("group_size"))
    links = written(links, "dedup-index")
    if not links.where("sha is not null").groupBy("h", "sha").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two texts share a hash and a SHA-256")
    return entries, links, grown


def dedup(docs: DataFrame, capacity: int | None = None, hash_bits: int = 64) -> DataFrame:
    """Group equal texts: doc_id, keep_id, group_size, kept, text_sha256, n_cp, x (hash of the text as it is).

    Texts are equal when the same after deleting [\\x20\\x09-\\x0D]. The row with the most code points
    of the original text stays, of these the one with the smallest doc_id.

    Null text counts as empty; all empty texts are one group. A null doc_id loses every tie, and where
    only null ids reach the most code points, keep_id is null. Repeated rows (same id, same text) all
    carry kept = true when theirs is the id that stays; keep() passes on one of them. An empty table
    gives an empty result; other columns are not read. Raises if two texts share hash and SHA-256."""
    entries, links, _ = index(docs.select("doc_id", "text"), capacity, hash_bits)
    group = links.where("sha is not null").select("h", "sha", "rep", "rep_cp", "group_size")
    out = entries.join(group, ["h", "sha"], "left")  # a key that occurs once is a link of its own
    one = F.col("group_size").isNull()
    rep = F.when(one, F.col("doc_id")).otherwise(F.col("rep"))
    kept = one | (F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("n_cp") == F.col("rep_cp")))
    return out.select("doc_id", rep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "n_cp", "x")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay; of repeated rows one.

    The rows that go are taken out by their ids and hashes, the smaller side, so that the texts stay where
    they lie as long as Catalyst can broadcast those. Nulls and empty tables: as in dedup()."""
    found = written(dedup(docs).select("doc_id", "x", "n_cp", "kept"), "dedup-found")
    text = F.col("text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), F.char_length(F.coalesce(text, F.lit(""))).alias("cp"))
    same = F.expr("id <=> doc_id and hash = x and cp = n_cp")
    rows = rows.join(found.where("not kept").drop("kept").distinct(), same, "left_anti")
    again = written(found.where("kept").groupBy("doc_id", "x", "n_cp").agg(F.count("*").alias("n")).where("n > 1"), "dedup-again")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, same, "left_semi").dropDuplicates(["id", "hash", "cp"])
    return rows.join(again, same, "left_anti").unionByName(once).select("row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("n_cp", "x")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
