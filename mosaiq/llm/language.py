"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import crc_mod, table, written

#: About so many labelled rows of each language at most fit the filters: those with the least hashes of their ids.
FIT_ROWS = 2000
#: An n-gram goes in if it occurs in so many rows of the language.
MIN_ROWS = 2
#: ... and in at least this part of the share of rows that it has in the language where it is commonest:
#: quotations in other languages then don't fill a filter.
MIN_SHARE = 0.2
SIZES = (2, 3, 4)
#: Slots of the filters for each n-gram of the language that has most, at least, and hash functions.
RATE = 8
HASHES = 3
#: Characters that are hashed at a time; a longer text still goes in as one.
BLOCK = 1 << 20

_SPACE, _END = 32, 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _folded() -> np.ndarray:
    """Code point to itself for letters, to a space for all else but the end mark."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    out[_END] = _END
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams of the texts, and which text each is from.

    Letters are lower-cased and anything else is a space; an n-gram holds a letter and lies in one text."""
    joined = "".join(f" {(t or '').lower().replace(chr(_END), ' ')} {chr(_END)}" for t in texts)
    code = _folded()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = code == _END
    of = np.cumsum(ends) - ends
    letters, breaks = (np.concatenate([[0], np.cumsum(x)]) for x in (code > _SPACE, ends))
    code = code.astype(np.uint64)
    hashes, owners = [], []
    for n in SIZES:
        h = np.full(max(0, len(code) - n + 1), n, np.uint64)
        for j in range(n):
            h = (h ^ code[j : j + len(h)]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        ok = (letters[n:] > letters[:-n]) & (breaks[n:] == breaks[:-n])
        hashes.append(h[ok])
        owners.append(of[: len(h)][ok])
    return np.concatenate(hashes), np.concatenate(owners)


def slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """HASHES places of each hash among ``size``, a power of two."""
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return [((hashes + step * np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """One filter per language, sliced by bit: a slot's word has a bit for each language that set it."""

    langs: list[str] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.uint64))  # 64 languages a row

    def false_rates(self) -> np.ndarray:
        """Chance that a filter holds an n-gram that was never added: the share of set slots, to the hashes."""
        fill = [np.count_nonzero(self.words[i // 64] & np.uint64(1 << (i % 64))) / self.words.shape[1] for i in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and per language how many of them its filter holds."""
        hashes, owners = ngrams(texts)
        n = np.bincount(owners, minlength=len(texts))
        held = np.zeros((len(texts), len(self.langs)))
        places = slots(hashes, self.words.shape[1])
        for row, word in enumerate(self.words):
            mask = word[places[0]]
            for at in places[1:]:
                mask &= word[at]
            for i in range(64 * row, min(64 * row + 64, len(self.langs))):
                held[:, i] = np.bincount(owners[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
        return n, held

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language whose filter holds most n-grams, corrected for false positives, and that share.

        Ties go to the language that sorts first; no letter or no learned language: und, 0."""
        out, block, size = [], [], 0
        false = self.false_rates()
        for i, t in enumerate(texts):
            block.append(t)
            size += len(t or "")
            if size >= BLOCK or i == len(texts) - 1:
                n, held = self.counts(block)
                true = (held - false * n[:, None]) / np.maximum(1e-9, 1 - false)
                for text, k, row in zip(block, n.tolist(), true, strict=True):
                    if not k or not len(row) or not has_letter(text):
                        out.append(("und", 0.0))
                    else:
                        best = int(np.argmax(row))
                        out.append((self.langs[best], min(1.0, max(0.0, float(row[best]) / k))))
                block, size = [], 0
        return out


def fit(docs: DataFrame) -> Filters:
    """Fit the filters on a bounded sample of the rows outside the held-out fold that have text and lang."""
    known = docs.select("doc_id", "lang", "text").where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    if not langs:
        return Filters()
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    # ids' hashes are spread evenly over 64 bits, so this part of their range holds about FIT_ROWS rows
    part = F.expr(f"cast(-9223372036854775808D + 18446744073709551616D * {FIT_ROWS} / n as bigint)")
    cut = sizes.select("lang", F.when(F.col("n") <= FIT_ROWS, F.lit((1 << 63) - 1)).otherwise(part).alias("cut"))
    rows = known.join(F.broadcast(cut), "lang").where(F.xxhash64("doc_id") <= F.col("cut"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(np.unique(ngrams([text])[0]))
            for lang, each in found.items():
                g, n = np.unique(np.concatenate(each), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_ROWS)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    grams = written(grams.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("rows")), "language-ngrams")
    most = grams.groupBy("gram").agg(F.max("share").alias("most"))
    grams = written(grams.join(most, "gram").where(F.col("share") >= MIN_SHARE * F.col("most")), "language-kept")
    most = grams.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = 1 << max(10, (RATE * most - 1).bit_length())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "i int, lang string")
    # the places of slots(): only the low bits of hash and step matter
    places = [f"((gram & {size - 1}) + {k} * ((shiftrightunsigned(gram, 40) | 1) & {size - 1})) & {size - 1}" for k in range(HASHES)]
    bits = grams.join(F.broadcast(numbers), "lang").select(F.expr("i div 64").alias("row"), F.expr("shiftleft(1L, i % 64)").alias("bit"), F.explode(F.array(*map(F.expr, places))).alias("slot"))
    sliced = bits.groupBy("row", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each slot in use
    out = Filters(langs, np.zeros((-(-len(langs) // 64), size), np.uint64))
    out.words[sliced["row"].to_numpy(), sliced["slot"].to_numpy()] = sliced["bits"].to_numpy().view(np.uint64)
    return out


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text, in one pass without a shuffle.

    Null texts and texts without a letter: ``und`` and 0. Repeated rows and null ids are judged each on
    their own; an empty table gives an empty result; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # its slots follow the n-grams of FIT_ROWS rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.decide(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_filters(spark, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold: held_out is null."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
