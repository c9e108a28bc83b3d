"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import table, written

WINDOW = 10
#: Words of a shard before it is indexed; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Every so many text positions one suffix position is kept.
SAMPLE = 16
#: Bytes of benchmark text that a task holds at a time (some 100 MB as windows); more are searched in
#: blocks, one pass each.
BLOCK_BYTES = 4 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; null has none."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet tree in levels (most significant bit first), each a stable partition of the one above."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, depth = np.zeros_like(i), len(self.levels)
        for d, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (depth - 1 - d)) & 1).astype(bool)
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + ri, i - ri)
            start = np.where(one, zeros + rs, start - rs)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            out = 2 * out + one
            i = np.where(one, zeros + r, i - r)
        return out


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, by prefix doubling that goes on only with those not yet told apart.

    The first sort takes as many symbols at once as fit a key."""
    n = len(text)
    width = max(1, (sigma - 1).bit_length())
    first = max(1, min(8, 62 // width))
    padded = np.concatenate([text.astype(np.int64), np.zeros(first, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(first):
        key = (key << width) | padded[j : j + n]
    order = np.argsort(key)  # the text ends in a symbol found nowhere else, so no suffix is a prefix
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = start, -1
    size = np.diff(np.r_[np.flatnonzero(new), n])
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the order, by group
    h = first
    while len(open_):
        at = order[open_]
        group, behind = rank[at], rank[np.minimum(at + h, n)]
        by = np.argsort(group * (n + 1) + behind + 1)
        at, group, behind = at[by], group[by], behind[by]
        order[open_] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        heads = np.flatnonzero(new)
        size = np.diff(np.r_[heads, len(at)])
        rank[at] = np.repeat(open_[heads], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order


class FMIndex:
    """Backward search over a text of symbols 1..sigma-2; 0 parts pieces of text."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.concatenate([text + 1, [0]])  # the end sorts first; symbol s is s + 1 inside
        order = suffix_array(text, sigma + 1)
        self.n = len(text)
        self.tree = Wavelet(text[order - 1], sigma + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        kept = order % SAMPLE == 0
        self.marked = Bits(kept)
        self.samples = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long phrases, one a row, all narrowed together from the last word on."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        at = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[at, j].astype(np.int64) + 1
            low[at] = self.before[c] + self.tree.rank(c, low[at])
            high[at] = self.before[c] + self.tree.rank(c, high[at])
            at = at[high[at] > low[at]]  # phrases that don't occur are done
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back through the text to the nearest kept position."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        at = np.arange(len(rows))
        while len(at):
            known = self.marked.get(rows[at])
            done = at[known]
            out[done] = self.samples[self.marked.rank(rows[done])] + steps
            at = at[~known]
            c = self.tree.symbol(rows[at])
            rows[at] = self.before[c] + self.tree.rank(c, rows[at])
            steps += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: its words, windows by length, and the items of each window."""

    vocab: dict[bytes, int]
    windows: dict[int, np.ndarray]  # length: one window a row
    items: dict[int, list[set]]  # length: ids of the items with that window

    @classmethod
    def of(cls, rows: Iterable[tuple[object, str | None]]) -> Phrases:
        vocab: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in rows:
            ids = [vocab.setdefault(w, len(vocab)) for w in words(text)]
            n = min(WINDOW, len(ids))
            for s in range(len(ids) - n + 1 if n else 0):
                found[n][tuple(ids[s : s + n])].add(item)
        return cls(vocab, {n: np.array(list(w), np.int64) for n, w in found.items()}, {n: list(w.values()) for n, w in found.items()})


class Shard:
    """All words of some documents in one FM-index, under the shard's own vocabulary; 0 parts documents."""

    def __init__(self, texts: list[list[bytes]]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1  # a document and the 0 behind it
        self.vocab: dict[bytes, int] = {}
        text = np.zeros(int(self.sizes.sum()) + len(texts), np.int64)
        number = self.vocab.setdefault
        for t, at in zip(texts, self.starts.tolist(), strict=True):
            text[at : at + len(t)] = [number(w, len(self.vocab) + 1) for w in t]
        self.index = FMIndex(text, len(self.vocab) + 1)

    def occurrences(self, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length of windows, which of them, and the text position, of every occurrence."""
        symbol = np.fromiter((self.vocab.get(w, 0) for w in phrases.vocab), np.int64, len(phrases.vocab))
        for n, windows in phrases.windows.items():
            spelt = symbol[windows]
            able = np.flatnonzero((spelt > 0).all(axis=1))  # a word that the shard lacks has an empty suffix range
            low, high = self.index.search(spelt[able])
            count = high - low
            which = np.repeat(able, count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            yield n, which, self.index.locate(rows)


def search_shard(phrases: Phrases, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
    """Per document of a shard: merged spans (first word, end) of occurring windows, and their items."""
    out: list[tuple[list, set]] = [([], set()) for _ in texts]
    if not phrases.windows or not any(texts):
        return out
    shard = Shard(texts)
    change = np.zeros(int(shard.sizes.sum()) + len(texts) + 1, np.int64)
    for n, which, at in shard.occurrences(phrases):
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        if len(at):
            doc = np.searchsorted(shard.starts, at, side="right") - 1
            for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                out[d][1].update(phrases.items[n][w])
    hit = np.cumsum(change) > 0  # never at the 0 behind a document
    start, stop = np.flatnonzero(hit & ~np.r_[False, hit[:-1]]), np.flatnonzero(hit & ~np.r_[hit[1:], False]) + 1
    doc = np.searchsorted(shard.starts, start, side="right") - 1
    for d, s, e in zip(doc.tolist(), (start - shard.starts[doc]).tolist(), (stop - shard.starts[doc]).tolist(), strict=True):
        out[d][0].append((s, e))
    return out


_SPANS = "array<struct<start:int,end:int>>"


def _scan(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """k, doc_id, n_words, spans, items of every row, from one index a shard; ``docs``: k, doc_id, text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for k, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("k", "doc_id", "text")), strict=True):
                texts.append(words(text))
                ids.append((k, doc_id))
                held += len(texts[-1])
                if held >= SHARD_WORDS:
                    yield shard(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield shard(ids, texts)

    def shard(ids: list, texts: list) -> pa.RecordBatch:
        found = search_shard(sent.value, texts)
        spans = [[{"start": s, "end": e} for s, e in x] for x, _ in found]
        items = [sorted(str(i) for i in x if i is not None) for _, x in found]
        return pa.record_batch([pa.array([k for k, _ in ids], pa.int64()), pa.array([i for _, i in ids], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["k", "doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"k long, doc_id long, n_words long, spans {_SPANS}, items array<string>")


def phrase_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[Broadcast]]:
    """How many blocks of about ``block_bytes`` of text the benchmark has, one at least, and their phrases.

    The driver makes and sends a block when it is asked for and gives it up at the next, so that it and the
    tasks hold one at a time; whoever asks must have finished with the one before."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def made() -> Iterator[Broadcast]:
        for i in range(blocks):
            part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
            sent = spark.sparkContext.broadcast(Phrases.of((r["item_id"], r["text"]) for r in part.toLocalIterator()))
            yield sent
            if blocks > 1:
                sent.unpersist()

    return blocks, made()


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans, items of every row: merged word spans to remove, and the items found there.

    One pass without a shuffle where the benchmark fits a block; a larger one is searched block by block
    over a written copy of the texts, each block's spans are written, and merged by row at the end.

    Null and empty texts have no words and no spans. Items without words have no windows; an item
    without an id marks words but isn't listed; rows of one item_id count as one item. Repeated rows
    and null doc_ids are searched each on their own. Empty tables give no rows, or no spans. Other
    columns are not read."""
    docs = docs.select("doc_id", "text")
    n, blocks = phrase_blocks(benchmark, block_bytes)
    if n == 1:
        return _scan(docs.select(F.lit(0).cast("long").alias("k"), "doc_id", "text"), next(blocks)).drop("k")
    docs = written(docs.withColumn("k", F.monotonically_increasing_id()).select("k", "doc_id", "text"), "to-search")
    found = reduce(DataFrame.unionByName, [written(_scan(docs, sent), "found") for sent in blocks])
    found = found.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # merge sorted spans: the last one grows while the next begins before its end
    merged = F.expr(f"""aggregate(spans, cast(array() as {_SPANS}), (out, x) -> if(size(out) > 0 and x.start <= element_at(out, -1).end,
        concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, x.end)))),
        concat(out, array(x))))""")
    return found.select("doc_id", "n_words", merged.alias("spans"), "items")


def keep(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no benchmark window occurs; no shuffle of texts.

    Rows are gathered into a shard of SHARD_WORDS words, searched, and passed on without the hit ones. Where the
    benchmark has several blocks, each leaves the numbers of its hit rows, and those rows go at the end.
    Nulls, empty and repeated rows and tables: as in contamination()."""
    n, blocks = phrase_blocks(benchmark, block_bytes)
    if n > 1:
        rows = written(docs.select(F.monotonically_increasing_id().alias("k"), F.struct(*docs.columns).alias("row")), "to-search")
        texts = rows.select("k", F.lit(None).cast("long").alias("doc_id"), F.col("row.text").alias("text"))
        hit = [written(_scan(texts, sent).where(F.size("spans") > 0).select("k"), "hit") for sent in blocks]
        return rows.join(reduce(DataFrame.unionByName, hit).distinct(), "k", "left_anti").select("row.*")
    sent = next(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, n = [], [], 0
        for b in batches:
            start = 0
            for i, text in enumerate(b.column("text"), 1):  # a batch may hold several shards
                texts.append(words(text.as_py()))
                n += len(texts[-1])
                if n >= SHARD_WORDS:
                    yield from passed([*held, b.slice(start, i - start)], texts)
                    held, texts, n, start = [], [], 0, i
            held.append(b.slice(start))
        yield from passed(held, texts)

    def passed(held: list, texts: list) -> Iterator[pa.RecordBatch]:
        ok = [not spans for spans, _ in search_shard(sent.value, texts)]
        for b in held:
            yield b.filter(pa.array(ok[: b.num_rows], pa.bool_()))
            ok = ok[b.num_rows :]

    return docs.mapInArrow(run, docs.schema)


def remove(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what lies between them, a space in their place."""
    if not text or not spans:
        return text
    raw = text.encode()
    flags = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    starts = np.flatnonzero(flags & ~np.r_[False, flags[:-1]])
    stops = np.flatnonzero(flags & ~np.r_[flags[1:], False]) + 1
    out, at = [], 0
    for s, e in spans:
        out += [raw[at : starts[s]], b" "]
        at = stops[e - 1]
    return b"".join([*out, raw[at:]]).decode().strip()


def op1_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
f AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
