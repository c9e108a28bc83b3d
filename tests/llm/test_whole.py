"""Whole results where an operator once gave less."""

import random
import zlib

from mosaiq.llm import decontaminate, html_text, simhash, source_audit, token_file, toxicity
from pyspark.sql import functions as F


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for group in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for _ in range(30 if group == 0 else 5):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["a b c", "A  b c", "a b d", " ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    far = 0
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.RADIUS
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert far > 20
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_label(docs).collect()} == dict(enumerate(up))
    assert sorted(r["doc_id"] for r in simhash.keep(docs).collect()) == sorted(set(up))


def test_names_and_links_of_the_article_stay():
    long = "A paragraph that goes on for long enough, with commas, to be a text of its own."
    page = f"""<html><body><nav><a href=/>Home</a></nav><article><h1><a href=x>The title of the whole page</a></h1><p>{long}</p>
    <h2 id="related-work">Related work</h2><p id="search-methods">{long}</p><section id="discussion"><h2 id="social-impact">Impact</h2>
    <p class="col hidden-print hidden md:block" title="A hidden gem">{long}</p></section><p><a href=y>{long}</a></p>
    <ol><li><a href=1>Author, A. A long title of the first reference</a></li><li><a href=2>Author, B. A long title of the second reference</a></li></ol>
    <p hidden>no</p><p style="color:red; display: none">no</p><p aria-hidden="true">no</p><div class="ad">Buy this now, it is very cheap, buy it.</div>
    <ul><li><a href=1>Home</a></li><li><a href=2>Contact</a></li><li><a href=3>About us</a></li><li><a href=4>Imprint</a></li></ul></article></body></html>"""
    refs = "Author, A. A long title of the first reference Author, B. A long title of the second reference"
    assert html_text.extract(page) == f"The title of the whole page {long} Related work {long} Impact {long} {long} {refs}"
    form = f"<body><form id=f><input><div><p>{long}</p><p>{long}</p></div></form><footer>c</footer></body>"
    assert html_text.extract(form) == f"{long} {long}"


def test_passages_after_single_words_and_repeated_ones():
    bad = [f"bad{i}" for i in range(6)]
    model = toxicity.Model(counts={w: (100.0, 0.0) for w in bad}, toxic=1000.0, clean=1000.0)
    gap = ["word"] * 200
    twice = [*gap, *bad, *gap, *bad, *gap]
    found = toxicity.passages(model, toxicity.Scores(model), " ".join(twice))[1]
    assert [(a, b) for a, b, _, _ in found] == [(200, 206), (406, 412)]
    late = [x for w in bad for x in (w, *gap)] + bad
    found = toxicity.passages(model, toxicity.Scores(model), " ".join(late))[1]
    assert [(a, b) for a, b, _, _ in found] == [(len(late) - 6, len(late))]
    assert toxicity.passages(model, toxicity.Scores(model), " ".join([*gap, *["bad0"] * 20, *gap]))[1] == []


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic").collect()
    turned = [(r["doc_id"], 1 if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["toxic"]) for r in labels]
    assert turned != [tuple(r) for r in labels]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned)]
    assert models[0].slope > 0 and models[0] == models[1]


def test_near_copies_in_large_buckets(spark, monkeypatch):
    """Texts that share much without being near, met by hubs that grow over several rounds."""
    monkeypatch.setattr(simhash, "HUBS", 1)
    monkeypatch.setattr(simhash, "HUBS_GROW", 2)
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join([*shared, *(f"w{rng.randrange(10**6)}" for _ in range(30))]) for _ in range(24)]
    texts += [f"{t} {'end' * (k + 1)}" for k, t in enumerate(texts[::3])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(up)) == 24
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_label(docs).collect()} == dict(enumerate(up))


def test_shards_end_within_a_batch(spark, monkeypatch):
    hit = " ".join(f"q{i}" for i in range(10))
    rows = [(i, f"{hit} end" if i % 3 == 0 else None if i == 4 else "clean words " * (i % 5), i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").coalesce(1)
    items = spark.createDataFrame([(1, hit)], "item_id long, text string")
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", size)
        assert [tuple(r) for r in decontaminate.keep(docs, items).orderBy("doc_id").collect()] == [r for r in rows if r[0] % 3]
        assert decontaminate.keep(docs.limit(0), items).count() == 0


def test_near_copies_by_the_grid(spark, monkeypatch):
    """Without the prefix join the stage has the links that operator 5's grid finds, verified on the stage's shingles;
    the prefix join gets no bucket that lies within one of their groups."""
    rng = random.Random(7)
    tail = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{'p q r s t ' * 40}{tail(30)}" for _ in range(6)]  # one fingerprint or nearly, not near
    texts += [f"{t} end" for t in texts[:3]] + [f"{t} {tail(k)}" for t in (tail(400), tail(900)) for k in range(1, 6)] + ["", " "]
    far = [tail(60)]
    texts += [*far, f"{far[0]} {tail(6)}"]  # near, by the prefix join only
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(str.split, texts)]
    fps, up, both, bits_only = [simhash.fingerprint(t) for t in texts], list(range(len(texts))), 0, 0
    for j in range(len(texts)):
        for i in range(j):
            bits, near = (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS, 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            both, bits_only = both + (bits and near), bits_only + (bits and not near)
            if near:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert both > 10 and bits_only and not (fps[-1] ^ fps[-2]).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in simhash.near_label(docs).collect()}
    assert whole == dict(enumerate(up))
    buckets, shared = [], simhash.shared
    monkeypatch.setattr(simhash, "shared", lambda first: buckets.append(shared(first)) or buckets[0].limit(0))
    grid = {r["doc_id"]: r["component_id"] for r in simhash.near_label(docs).collect()}
    assert all(up[c] == up[d] for d, c in grid.items()) and len(set(up)) < len(set(grid.values())) < len(texts) - 5
    assert all(len(r["roots"]) > 1 for r in buckets[0].groupBy("s").agg(F.collect_set("root").alias("roots")).collect())


def test_words_of_earlier_tasks_stay_known(monkeypatch):
    """A worker's words outlive a task, and those in use outlive a full cache."""
    text = "Over the straße, AND the wald; the end. 42 it's l'été... " + " ".join(f"wort{chr(97 + i)}" for i in range(20))
    known, want = token_file.words(token_file.TOKENIZER), token_file.tokenizer(token_file.TOKENIZER).encode(text, add_special_tokens=False).ids
    assert known is token_file.words(token_file.TOKENIZER)
    for size in (1, 8, 1000):
        monkeypatch.setattr(token_file, "CACHE", size)
        for _ in range(3):
            assert token_file.unpacked(known.ids(text)).tolist() == want
            assert len(known) <= max(size, 2) and len(known.older) <= max(size, 1)
    asked, plain = [], known.tokenize
    monkeypatch.setattr(known, "tokenize", lambda word: asked.append(word) or plain(word))
    monkeypatch.setattr(token_file, "CACHE", len(known))
    known["anew"], known["again"]
    assert known.older and token_file.unpacked(known.ids(text)).tolist() == want and asked == ["anew", "again"]


def test_terms_are_counted_without_a_row_for_each(spark, monkeypatch):
    rows = [("de", "a", "Über über ÜBER, a_b\x00c\x85d e 1x2"), (None, None, None), ("de", "a", "a b a"), ("fr", "", "")] * 3
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    want = {("de", "a", "a"): (9, 6), ("de", "a", "b"): (6, 6), ("de", "a", "c\x85d e"): (3, 3), ("de", "a", "x"): (3, 3), ("de", "a", "über"): (3, 3), ("de", "a", "Über"): (6, 3)}
    for held in (1, 4, 1 << 18):
        monkeypatch.setattr(source_audit, "HELD", held)
        got = source_audit.term_counts(docs)
        assert {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
