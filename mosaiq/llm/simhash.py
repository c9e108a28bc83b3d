"""SimHash near-duplicates by segment-popcount embedding, grid range-join and exact verification; and the
pipeline's near copies: the same grid, verified on word shingles, and after it a prefix join, exact for the links that
fingerprints miss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import clean, components, made, partitions, table, written

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits; the grid's cells are built for this radius.
RADIUS = 2
#: Segments of 4 bits each; a popcount of 0 to 4 takes 3 bits of a cell's key.
SEGMENTS = 16
#: Cells of more fingerprints than this are verified through one-bit variants rather than pair by pair.
DENSE = 64
#: Variants that are sorted at a time in a dense cell.
VARIANTS_AT_ONCE = 1 << 22

#: Near copies share so many in a hundred of their shingles of so many words.
NEAR_SHINGLE = 5
NEAR_PERCENT = 80
#: Bits of a shingle set's parity sketch: of the one that goes with a set's buckets, and at most of the one that
#: grows with the set and is held against another's before the sets are made.
SKETCH, WIDE_SKETCH = 512, 1 << 15
#: Shingles that occur so often in one text of SAMPLE come last in the join's order; order changes costs, not links.
SAMPLE, COMMON, COMMON_SHINGLES = 16, 4, 1 << 18
#: Members of a bucket that meet all others of it in the first round, at most, and by how much they grow a round.
HUBS, HUBS_GROW = 16, 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text; no word gives zero."""
    words = (text or "").encode().translate(_LOWER).split()  # splits at [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text, to find the row again), fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(fp)], ["doc_id", "h", "fp"])

    read = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return read.mapInArrow(run, read.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells at Manhattan distance 0 or 1 of each fingerprint's popcount vector: (cell, fp).

    Differing bits bound the vectors' Manhattan distance from above. Two vectors at distance 2 or less
    have a cell within 1 of both, so fingerprints that link always meet in some cell."""
    x = fps.view(np.uint64)
    pops = [np.bitwise_count((x >> np.uint64(4 * s)) & np.uint64(15)).astype(np.int64) for s in range(SEGMENTS)]
    base = np.zeros(len(x), np.int64)
    for s, p in enumerate(pops):
        base |= p << (3 * s)
    keys, owners = [base], [fps]
    for s, p in enumerate(pops):
        for step, ok in ((1, p < 4), (-1, p > 0)):
            keys.append(base[ok] + (step << (3 * s)))
            owners.append(fps[ok])
    return np.concatenate(keys), np.concatenate(owners)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges enough to connect what the given edges connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out[0].append(x)
            out[1].append(y)
    return out


def dense_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact links within many distinct fingerprints, without trying pairs.

    Two fingerprints differ in at most 2 bits exactly when they share a variant with at most one bit
    flipped; so each run of equal variants is a chain of links."""
    x = fps.view(np.uint64)
    turns = max(1, -(-len(x) * len(_BITS) // VARIANTS_AT_ONCE))
    left, right = [], []
    for turn in range(turns):
        parts = []
        for bit in _BITS:  # only this turn's variants are held
            v = x ^ bit
            at = np.flatnonzero(v % np.uint64(turns) == turn)
            parts.append((v[at], at))
        variant = np.concatenate([v for v, _ in parts])
        owner = np.concatenate([at for _, at in parts])
        order = np.argsort(variant, kind="stable")
        variant, owner = variant[order], owner[order]
        same = np.flatnonzero(variant[1:] == variant[:-1])
        left.append(fps[owner[same]])
        right.append(fps[owner[same + 1]])
    return np.concatenate(left), np.concatenate(right)


def cell_links(cell: np.ndarray, fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Verified links of whole cells, sorted by cell: a spanning forest of them."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    left, right = [], []
    for s, n in zip(starts[sizes > DENSE], sizes[sizes > DENSE], strict=True):
        a, b = dense_links(fp[s : s + n])
        left.append(a)
        right.append(b)
    some = np.repeat((sizes > 1) & (sizes <= DENSE), sizes)
    cell, fp = cell[some], fp[some]
    for d in range(1, DENSE):
        near = cell[d:] == cell[:-d]
        if not near.any():
            break
        near &= np.bitwise_count(fp[d:].view(np.uint64) ^ fp[:-d].view(np.uint64)) <= RADIUS
        left.append(fp[:-d][near])
        right.append(fp[d:][near])
    return forest(np.concatenate(left), np.concatenate(right)) if left else ([], [])


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` at RADIUS or fewer differing bits."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch(list(map(pa.array, cells(b.column("fp").to_numpy(zero_copy_only=False)))), ["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for b in batches:
            held.append((b.column("cell").to_numpy(), b.column("fp").to_numpy()))
            n += b.num_rows
            if n < 1 << 16 or held[-1][0][-1] == held[0][0][:1].sum() and len(held[0][0]):
                continue  # few rows, or all of one cell so far
            cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if whole:
                yield edges(cell[:whole], fp[:whole])
            held, n = [(cell[whole:], fp[whole:])], len(cell) - whole
        yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def edges(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = cell_links(cell, fp)
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    grid = distinct.select("fp").mapInArrow(explode, "cell long, fp long")
    grid = grid.repartition(partitions(distinct.sparkSession), "cell").sortWithinPartitions("cell", "fp")
    return grid.mapInArrow(verify, "u long, v long")


def label(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups: doc_id, h, fp, component_id, and rep_h, the least h of component_id's rows.

    A component's id is the smallest doc_id that links reach. Null and empty texts and those without a
    word have the fingerprint zero, linked like any other. Equal fingerprints are collapsed before the
    grid and expanded by an equi-join at the end, so copies never meet in pairs. A null doc_id counts
    as no id: it is never a component's id unless all rows of the component have none, where the id is
    null. Repeated rows get the same group. An empty table gives an empty result; other columns are
    not read. ``h`` is xxhash64 of the text (of nothing, for null)."""
    fps = written(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    return grouped(fps, lambda distinct: components(links(distinct)))


def grouped(fps: DataFrame, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The groups of rows (doc_id, h, fp) under the roots (node, root) of their distinct ``fp``."""
    ids = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = written(fps.groupBy("fp").agg(F.min(ids).alias("least")), "distinct-fingerprints")
    roots = roots_of(distinct)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.select("fp", "root").join(least, "root")
    named = written(named.select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("rep_h")), "components")
    return fps.join(named, "fp").select("doc_id", "h", "fp", "component_id", "rep_h")


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's distinct shingles of NEAR_SHINGLE words, sorted; a shorter text is one shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    each = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    k = min(NEAR_SHINGLE, len(each))
    h = np.full(len(each) - k + 1, k, np.uint64)
    for i in range(k):  # the order of the words counts: each step mixes what came before
        h = (h ^ each[i : len(each) - k + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def sorted_has(values: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of ``s`` are among the sorted values; the values are searched, never sorted again for a text."""
    if not len(values):
        return np.zeros(len(s), bool)
    return values[np.minimum(np.searchsorted(values, s), len(values) - 1)] == s


def prefix_length(n: int) -> int:
    """Two sets that are near share one of so many first members under any order common to all sets."""
    return n - -(-NEAR_PERCENT * n // 100) + 1 if n else 0


def most_apart(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Members that only one of two near sets of these sizes has, at most."""
    return n + m + 2 * (-NEAR_PERCENT * (n + m) // (100 + NEAR_PERCENT))


def parity(s: np.ndarray, bits: int) -> bytes:
    """For each class of members by their last bits, whether the set has an odd number of them.

    Two sets differ in at least as many members as their sketches differ in bits; half of a sketch XORed
    onto the other half is the sketch of half its bits."""
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the shorter's length."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, h, bits (the SimHash fingerprint), fp (hash of the shingle set), n (its size), sketch, wide (a longer
    sketch), first (its prefix, common shingles last)."""
    spark = docs.sparkSession

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.record_batch([pa.array(shingle_set(t.as_py()))], ["s"])

    read = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    seen = read.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("text").mapInArrow(hashes, "s long").groupBy("s").count()
    seen = seen.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(COMMON_SHINGLES)
    sent = spark.sparkContext.broadcast(np.sort(np.array([r["s"] for r in seen.collect()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            texts = b.column("text").to_pylist()
            bits = np.array(list(map(fingerprint, texts)), np.uint64).view(np.int64)
            for t in texts:
                s = shingle_set(t)
                late = sorted_has(sent.value, s)
                first = np.concatenate([s[~late], s[late]])[: prefix_length(len(s))]
                sketch = np.frombuffer(parity(s, SKETCH), np.int64)
                wide = parity(s, min(WIDE_SKETCH, max(SKETCH, 1 << len(s).bit_length())))
                fp = xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0
                for x, y in zip(out, (fp - (fp >> 63 << 64), len(s), sketch, wide, first), strict=True):
                    x.append(y)
            made = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(bits), *made], ["doc_id", "h", "bits", "fp", "n", "sketch", "wide", "first"])

    kind = dict(read.dtypes)["doc_id"]
    return read.mapInArrow(run, f"doc_id {kind}, h long, bits long, fp long, n long, sketch array<long>, wide binary, first array<long>")


def grid_pairs(each: DataFrame) -> DataFrame:
    """Pairs (u, v) of shingle sets ``fp`` whose fingerprints ``bits`` are equal, or that the grid finds and XOR verifies
    at RADIUS or fewer differing bits: as many as connect all such. Each fingerprint is in the grid once, for the
    least set that has it."""
    least = written(each.groupBy("bits").agg(F.min("fp").alias("least")), "near-fingerprints")
    same = each.join(least, "bits").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    a, b = (least.select(F.col("bits").alias(x), F.col("least").alias(y)) for x, y in ("ua", "vb"))
    apart = links(least.select(F.col("bits").alias("fp"))).join(a, "u").join(b, "v").select("a", "b")
    return same.unionByName(apart).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def grid_roots(each: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the shingle sets that the grid's pairs connect, each verified on whole sets too."""
    pairs = written(likely(written(grid_pairs(each), "near-grid"), sets), "near-likely")
    return components(pairs if pairs.isEmpty() else verified(pairs, sets, docs))


def shared(prefixes: DataFrame) -> DataFrame:
    """The rows (s, fp, root, lead, others) of the buckets (s) that more than one root lies in; others is at most too
    large here.

    Of buckets with the same members one stays: texts that share a passage share many shingles of it. Equal members
    are told by their number and 128 bits of hashes. Buckets are counted, by partial aggregates, before their rows are sent."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "fp")).alias(f"x{i}") for i in range(2)]
    counts = prefixes.groupBy("s").agg(F.count("*").alias("n"), F.min("root").alias("lead"), F.max("root").alias("last"), *hashes).where("lead < last")
    once = counts.groupBy("n", "x0", "x1").agg(F.min(F.struct("s", "lead")).alias("b"))
    return prefixes.join(once.select("b.*", (F.col("n") - 1).alias("others")), "s")


def weighed(live: DataFrame) -> DataFrame:
    """The rows of the buckets that are not yet connected, with lead, a root that most of a bucket's members have,
    and others, how many have another: every pair that is open has one of those."""
    each = live.groupBy("s", "root").count()
    sizes = each.groupBy("s").agg(F.max_by("root", "count").alias("lead"), (F.sum("count") - F.max("count")).alias("others"))
    return live.join(sizes.where("others > 0"), "s")


def hubs(live: DataFrame, most: int) -> DataFrame:
    """s, hub: all members with another root than the lead, of a bucket that has up to ``most`` of them; of others,
    the least members of as many classes of their members, combined before they are sent."""
    kind = F.when(F.col("others") <= most, F.col("fp")).otherwise(F.pmod(F.xxhash64("fp", "s"), F.lit(most))).alias("kind")
    open_ = live.where((F.col("others") > most) | (F.col("root") != F.col("lead")))
    return open_.groupBy("s", kind).agg(F.min(F.struct("fp", "root", "n", "sketch")).alias("hub")).drop("kind")


def hub_pairs(live: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (u, v) of a hub and another member of its bucket, without those that already have a root in common or
    that sizes or sketches prove not near. An equi-join: no bucket has to lie in one task."""
    n, m = F.col("hub.n"), F.col("n")
    words = range(SKETCH // 64)
    apart = sum((F.bit_count(F.col("hub.sketch")[i].bitwiseXOR(F.col("sketch")[i])) for i in words), F.lit(0))
    most = n + m - 2 * F.expr(f"({NEAR_PERCENT} * (hub.n + n) + {99 + NEAR_PERCENT}) div {100 + NEAR_PERCENT}")
    near = (F.col("hub.root") != F.col("root")) & (100 * F.least(n, m) >= NEAR_PERCENT * F.greatest(n, m)) & (apart <= most)
    pairs = live.join(met, "s").where(near)
    return pairs.select(F.least("hub.fp", "fp").alias("u"), F.greatest("hub.fp", "fp").alias("v")).distinct()


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that their wide sketches don't prove not near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = most_apart(b.column("n").to_numpy(), b.column("m").to_numpy())
            ends = zip(b.column("a"), b.column("b"), most.tolist(), strict=True)
            near = pa.array([bits_apart(x.as_py(), y.as_py()) <= at for x, y, at in ends], pa.bool_())
            yield b.select(["u", "v"]).filter(near)

    a = sets.select(F.col("fp").alias("u"), "n", F.col("wide").alias("a"))
    b = sets.select(F.col("fp").alias("v"), F.col("n").alias("m"), F.col("wide").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "n", "m", "a", "b").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose shingle sets share NEAR_PERCENT of their union, written. Only texts that a pair needs are
    read again; their sets are deleted once the links are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingle_set(t.as_py()) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.record_batch([b.column("fp"), made], ["fp", "set"])

    ends = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    need = sets.join(ends, "fp").select("fp", "doc_id", "h")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("x"), "text").join(need, F.expr("id <=> doc_id and x = h"))
    before = len(made())
    whole = written(texts.select("fp", "text").mapInArrow(run, "fp long, set array<long>").dropDuplicates(["fp"]), "near-sets")
    a = whole.select(F.col("fp").alias("u"), F.col("set").alias("a"))
    b = whole.select(F.col("fp").alias("v"), F.col("set").alias("b"))
    both = pairs.join(b, "v").join(a, "u").withColumn("same", F.size(F.array_intersect("a", "b")))
    found = written(both.where((100 + NEAR_PERCENT) * F.col("same") >= NEAR_PERCENT * (F.size("a") + F.size("b"))).select("u", "v"), "near-links")
    clean(docs.sparkSession, made()[before:-1])
    return found


def near_roots(sets: DataFrame, docs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the shingle sets that the given roots and links at NEAR_PERCENT or more connect: all such links count.

    Near sets share a shingle of their prefixes, so they meet in a bucket. A bucket with few members besides
    those of its most frequent root is done at once: these are held against all others. In a larger one some members, its
    hubs, are, and then leave it; a group of near copies is so connected by few rows a member, and what its root
    doesn't hold is few. The rounds end when every bucket is done or connected."""
    own = sets.select("fp", "n", "sketch")
    first = sets.select("fp", "first").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    first = first.select(F.explode("first").alias("s"), "fp", F.coalesce("root", "fp").alias("root"))
    live = written(shared(first).join(own, "fp"), "near-buckets")
    most, live_at = HUBS, made()[-1]
    while not live.isEmpty():
        before = len(made())
        met = written(hubs(live, most), "near-hubs")
        pairs = written(hub_pairs(live, met), "near-pairs")
        pairs = written(likely(pairs, sets), "near-likely")
        spent = [live_at, *made()[before:]]
        if not pairs.isEmpty():
            roots = components(verified(pairs, sets, docs).unionByName(roots.selectExpr("node as u", "root as v")))
        left = live.where(F.col("others") > most).join(met.select("s", F.col("hub.fp").alias("fp")), ["s", "fp"], "left_anti")
        left = left.drop("root", "lead", "others").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        live = written(weighed(left.withColumn("root", F.coalesce("root", "fp"))), "near-buckets")
        live_at = made()[-1]
        clean(docs.sparkSession, spent)  # what this round has read
        most *= HUBS_GROW
    return roots


def near_label(docs: DataFrame) -> DataFrame:
    """Groups of near copies, as ``label`` gives them; fp is the hash of the shingle set.

    Texts are linked when they share NEAR_PERCENT or more of their shingles of NEAR_SHINGLE words. Operator 5's grid
    goes first: what it finds is verified on these shingles. Most near copies lie more than RADIUS bits apart, so a prefix
    join, exact for all, finds the links between the groups that the grid leaves. Texts without a word have the same, empty set."""
    before = len(made())
    fps = written(shingled(docs.select("doc_id", "text")), "shingled")
    by = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    sets = fps.where("n > 0").groupBy("fp").agg(F.min_by(F.struct("doc_id", "h", "n", "sketch", "wide", "first"), by).alias("r")).select("fp", "r.*")
    sets, rows = written(sets, "near-distinct"), written(fps.select("doc_id", "h", "fp"), "near-rows")
    each = written(fps.select("fp", "bits").distinct(), "near-bits")
    clean(docs.sparkSession, made()[before : before + 1])  # the prefixes of all rows
    return grouped(rows, lambda _: near_roots(sets, docs, grid_roots(each, sets, docs)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns: one of each group of near copies, that of the smallest doc_id.

    The rows that go are taken out by id and hash, the smaller side, so that the texts stay where they lie as
    long as Catalyst can broadcast those. Nulls, empty texts and tables: as in label()."""
    found = near_label(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("rep_h"))
    found = written(found.select("doc_id", "h", kept.alias("kept")), "near-found")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("x"))
    same = F.expr("id <=> doc_id and x = h")
    rows = rows.join(found.where("not kept").drop("kept").distinct(), same, "left_anti")
    again = written(found.where("kept").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1"), "near-again")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, same, "left_semi").dropDuplicates(["id", "x"])
    return rows.join(again, same, "left_anti").unionByName(once).select("row.*")


def op5_simhash_components(spark, sf_dir: str) -> DataFrame:
    found = label(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
