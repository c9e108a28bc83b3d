"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import crc_mod, table, written

#: At most so many labelled rows of each class fit the model: those with the least hash of their id.
FIT_ROWS = 6000
#: Pseudo-tokens of the Dirichlet prior at each level.
PRIOR = 1.0
#: Tokens count once their log-odds lie so many standard errors from 0.
Z_MIN = 3.0
#: What a token without evidence costs a passage.
DRIFT = 1.0
#: Passages are significant below this expected number of chance passages a document.
E_MAX = 0.05
PREFIXES = (3, 4, 5, 6)
#: A word that counted in a candidate passage counts there again only so many words later.
REPEAT = 50
CACHE = 400_000
SKETCHES = 4

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def levels(word: str) -> list[str]:
    """The word's prefixes from short to long, marked as such, then the word itself."""
    return [word[:n] + "*" for n in PREFIXES if len(word) > n] + [word]


@dataclass
class Model:
    counts: dict[str, tuple[float, float]] = field(default_factory=dict)  # token: in toxic, in clean
    toxic: float = 1.0
    clean: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    bias: float = -2.0
    slope: float = 0.0

    def log_odds(self, word: str) -> float:
        """Log-odds under Dirichlet priors; each level's prior is centred on the shorter prefix's odds."""
        odds, seen = 0.0, False
        for token in levels(word):
            y1, y0 = self.counts.get(token, (0.0, 0.0))
            share = self.toxic * math.exp(odds) / (self.toxic * math.exp(odds) + self.clean)
            a1, a0 = y1 + PRIOR * share, y0 + PRIOR * (1 - share)
            odds = math.log(a1 / self.toxic) - math.log(a0 / self.clean)
            flat = math.log((y1 + 0.5) / self.toxic) - math.log((y0 + 0.5) / self.clean)
            seen |= abs(flat) >= Z_MIN * math.sqrt(1 / (y1 + 0.5) + 1 / (y0 + 0.5)) and flat * odds > 0
        return odds if seen else 0.0

    def score(self, word: str) -> float:
        return max(-2.0, min(8.0, self.log_odds(word))) - DRIFT

    def evalue(self, s: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-self.lam * s)

    def calibrated(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(evidence)))))


class Scores(dict):
    """Scores of words, worked out once each; emptied when it grows beyond CACHE."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = s = self.model.score(word)
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Only positive tokens open or join segments; prefix sums give what lies between. Candidates are kept
    on a stack with the sum before and after each; a new one is merged leftwards into the nearest
    candidate that starts lower, for as long as that candidate's end lies below the new end."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, next to try
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            start, _, low, _, nxt = stack[j]
            del stack[j:]
            j = nxt
        stack.append((start, end, low, high, j))
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def scored(scores: Scores, ws: list[str]) -> np.ndarray:
    """Scores of a text's words: every word's, but repeats within REPEAT words of one candidate passage are
    neutral. Candidates are the maximal segments of the words' full scores; lower scores never join them."""
    s = np.fromiter(map(scores.__getitem__, ws), np.float64, len(ws))
    for start, end, _ in segments(s):
        met: dict[str, int] = {}
        for i in (start + np.flatnonzero(s[start:end] > 0)).tolist():
            if ws[i] in met and i - met[ws[i]] < REPEAT:
                s[i] = -DRIFT
            else:
                met[ws[i]] = i
    return s


def passages(model: Model, scores: Scores, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Number of words and the significant passages: (first word, end, score, E-value)."""
    ws = words(text)
    found = segments(scored(scores, ws)) if ws else []
    return len(ws), [(a, b, s, e) for a, b, s in found if (e := model.evalue(s, len(ws))) <= E_MAX]


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    return sum(-math.log(max(e, 1e-300)) for _, _, _, e in found)


def sketch(text: str) -> list[int]:
    """The least hashes of the text's 3-word shingles under SKETCHES hash functions; near copies share most."""
    ws = words(text)
    hashes = {xxhash.xxh64_intdigest(" ".join(x)) for x in zip(ws, ws[1:], ws[2:], strict=False)} or {xxhash.xxh64_intdigest(" ".join(ws))}
    x = np.fromiter(hashes, np.uint64, len(hashes))
    return [int((x * np.uint64(2 * i + 0x9E3779B97F4A7C15)).min().view(np.int64)) for i in range(SKETCHES)]


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic outside the held-out fold; several labels of one id: the highest."""
    return labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most FIT_ROWS rows of each class outside the held-out fold.

    Rows without id, text or label don't count; several labels of one id: the highest."""
    known = known_labels(labels)
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(FIT_ROWS) for t in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")

    @F.pandas_udf("array<long>")
    def sketched(texts):
        return texts.map(sketch)

    rows = rows.select("text", "toxic", sketched("text").alias("sketch"))
    names = [f"s{i}" for i in range(SKETCHES)]
    rows = written(rows.select("toxic", F.xxhash64("text").alias("h"), "text", *(F.col("sketch")[i].alias(s) for i, s in enumerate(names))), "toxic-sample")
    for s in names:  # copies and near copies would pass for independent evidence; the same one stays in every run
        rows = rows.groupBy("toxic", s).agg(F.min(F.struct("h", "text", *names)).alias("r")).select("toxic", "r.*")
    return rows.select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the model on a bounded sample of labelled rows: log-odds on three quarters of it, Gumbel
    parameters and calibration on the rest."""
    rows = written(training_rows(docs, labels).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))), "toxic-fit")
    unseen = rows.where("part = 0")  # log-odds look better on the rows that gave them
    rows = rows.where("part <> 0").drop("part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(set(words(text)))  # a word counts once a text: its repeats aren't independent
            out: dict[str, list[int]] = {}
            for t, c in seen.items():
                for w, n in c.items():
                    for token in levels(w):
                        out.setdefault(token, [0, 0])[t] += n
                        if token == w:
                            out.setdefault("", [0, 0])[t] += n
            yield pa.record_batch([pa.array(list(out), pa.string()), pa.array([x[1] for x in out.values()], pa.int64()), pa.array([x[0] for x in out.values()], pa.int64())], ["token", "y1", "y0"])

    counts = rows.mapInArrow(count, "token string, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    counts = written(counts, "toxic-counts")
    total = counts.where("token = ''").first()
    model = Model()
    if total is None or not total["y1"] or not total["y0"]:
        return model
    model.toxic, model.clean = float(total["y1"]), float(total["y0"])
    n1, n0 = F.lit(model.toxic), F.lit(model.clean)
    z = (F.log((F.col("y1") + 0.5) / n1) - F.log((F.col("y0") + 0.5) / n0)) / F.sqrt(1 / (F.col("y1") + 0.5) + 1 / (F.col("y0") + 0.5))
    kept = counts.where("token <> '' and y1 + y0 > 1").withColumn("z", F.abs(z)).where(F.col("z") >= 2)  # as many as FIT_ROWS texts a class have
    model.counts = {r["token"]: (float(r["y1"]), float(r["y0"])) for r in kept.select("token", "y1", "y0").collect()}
    return calibrate(unseen, model, {r["toxic"]: r["count"] for r in known_labels(labels).groupBy("toxic").count().collect()})


def calibrate(rows: DataFrame, model: Model, classes: dict[int, int]) -> Model:
    """Set lambda and K from the clean rows, then the logistic curve from all fitting rows.

    lambda solves sum p(s) exp(lambda s) = 1 over clean tokens' scores (Karlin and Altschul); K comes
    from how many clean rows have a chance passage: one row of figures a task. The curve is fitted to one
    number a fitting row."""

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, n, chance, bins = Scores(model), 0, 0, np.zeros(48, np.int64)
        for b in batches:
            for text in b.column("text"):
                ws = words(text.as_py())
                s = scored(scores, ws)
                bins += np.bincount(np.round((s + 3) * 4).astype(int), minlength=48)
                n += len(ws)
                chance += max((x for _, _, x in segments(s)), default=0) >= 1
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([chance], pa.int64()), pa.array([bins.tolist()], pa.list_(pa.int64()))], ["n", "chance", "bins"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for b in batches:
            x = [math.log1p(evidence(passages(model, scores, t.as_py())[1])) for t in b.column("text")]
            yield pa.record_batch([b.column("toxic").cast(pa.int32()), pa.array(x, pa.float64())], ["toxic", "x"])

    clean = rows.where("toxic = 0").select("text").mapInArrow(observe, "n long, chance long, bins array<long>").collect()
    share = np.sum([r["bins"] for r in clean], axis=0) if clean else np.zeros(48)
    share = share.astype(float)
    at = np.arange(48) / 4 - 3
    share[np.searchsorted(at, 8 - DRIFT)] += 1  # the highest score is possible in clean text too
    share /= share.sum()
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float(share @ np.exp(mid * at)) < 1 else (low, mid)
    model.lam = max(0.05, low)
    chance = sum(r["chance"] for r in clean) + 0.5
    model.k = min(1.0, chance / max(1e-9, sum(r["n"] for r in clean) * math.exp(-model.lam)))

    seen = sorted(tuple(r) for r in rows.select("text", "toxic").mapInArrow(gather, "toxic int, x double").collect())
    x = np.array([x for _, x in seen])
    y = np.array([float(t) for t, _ in seen])
    known = [max(1, classes.get(t, 0)) / max(1, int((y == t).sum())) for t in (0, 1)]
    weight = np.where(y == 1, known[1], known[0])
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):  # Newton steps of a slightly ridged logistic regression
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-3 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(beta[0]), max(0.0, float(beta[1]))
    return model


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, score, passages (first word, end, score, E-value) of every row's whole text.

    Null and empty texts have no passage and the score of such a text. Repeated rows and null ids are
    scored each on their own; an empty table gives an empty result; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its tokens are those of the fitting rows
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = sent.value, Scores(sent.value)
        for b in batches:
            found = [passages(known, scores, t.as_py()) for t in b.column("text")]
            spans = [[dict(zip(("start", "end", "score", "evalue"), x, strict=True)) for x in f] for _, f in found]
            yield pa.record_batch([b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([known.calibrated(evidence(f)) for _, f in found], pa.float64()), pa.array(spans, kind)], ["doc_id", "n_words", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, score double, passages array<struct<start:int,end:int,score:double,evalue:double>>")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose score is below 0.5; one pass, no shuffle.

    Nulls, empty and repeated rows and tables: as in detect()."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = Scores(sent.value)
        for texts in batches:
            yield texts.map(lambda t: sent.value.calibrated(evidence(passages(sent.value, scores, t)[1])) < 0.5).astype(bool)

    return docs.where(clean(F.coalesce("text", F.lit(""))))


def op7_toxic_passages(spark, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold: held_out is null."""
    docs = table(spark, sf_dir, "documents")
    found = detect(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
