"""The pipeline against a plain version of every stage, and its odd rows."""

import hashlib

import corpus_pipeline
import pytest
from mosaiq.llm import bpe, decontaminate, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, items, toxic):
    """The rows that stay: id and text, by comparing all with all."""
    docs = [d for d in docs if d["doc_id"] not in toxic]
    groups = {}
    for d in docs:
        groups.setdefault("".join(c for c in d["text"] or "" if c not in " \t\n\v\f\r"), []).append(d)
    docs = [min(g, key=lambda d: (-len(d["text"] or ""), d["doc_id"])) for g in groups.values()]
    docs.sort(key=lambda d: d["doc_id"])
    sets, up = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if up[i] != up[j] and (a or b) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    docs = [d for i, d in enumerate(docs) if up[i] == i]
    windows = set()
    for t in items:
        w = decontaminate.words(t)
        n = min(10, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = decontaminate.words(t)
        return any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1))

    return [d for d in docs if not hit(d["text"])]


def test_pipeline_against_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r["doc_id"] for r in toxicity.detect(docs, toxicity.fit(docs, labels)).where(F.col("score") >= 0.5).collect()}
    want = plain(docs.collect(), [r["text"] for r in items.collect()], toxic)
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < docs.count() and sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in want)
    texts, reference = {d["doc_id"]: d["text"] or "" for d in want}, bpe.encoding(bpe.RANKS)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, empty):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "other text here"), (4, "x " * 20000)]
    docs = spark.createDataFrame([] if empty else [(i, t, None, None, None, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "h"]
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(str, left)) == ([] if empty else sorted(map(str, [(1, "a b c"), (2, None), (None, "other text here"), (4, "x " * 20000)])))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(left)
