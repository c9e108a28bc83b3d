"""The methods against brute force, round trips and held-out accuracy."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from mosaiq.llm import common, decontaminate, language, sharding, simhash, token_file, toxicity

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 5000), st.integers(0, 2**70))
@settings(max_examples=40, deadline=None)
def test_permutation(n, seed):
    assert sorted(sharding.permute(np.arange(n), n, seed).tolist()) == list(range(n))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_byte_aligned_coding(values):
    control, data = token_file.encode_values(np.array(values, np.uint64))
    assert token_file.decode_values(control, data, len(values)).tolist() == values


def plain_windows(items, texts):
    found = defaultdict(set)
    for i, t in items:
        w = decontaminate.words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            found[tuple(w[s : s + n])].add(i)
    out = []
    for t in texts:
        hit, ids = [False] * len(t), set()
        for n in {len(k) for k in found}:
            for s in range(len(t) - n + 1):
                if (k := tuple(t[s : s + n])) in found:
                    ids |= found[k]
                    hit[s : s + n] = [True] * n
        out.append((sum(hit), ids))
    return out


def test_fm_index_against_plain_search():
    rng = random.Random(7)
    for _ in range(80):
        vocab = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 40]) + 2)]
        items = [(i, " ".join(rng.choice(vocab[:-2]) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(rng.randint(0, 5))]
        texts = []
        for _ in range(rng.randint(0, 8)):
            t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 3) if items else 0):
                at = rng.randint(0, len(t))
                t[at:at] = rng.choice(items)[1].split()
            texts.append([x.encode() for x in t])
        got = decontaminate.search_shard(decontaminate.Phrases.of(items), texts)
        assert [(sum(e - s for s, e in spans), ids) for spans, ids in got] == plain_windows(items, texts)


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if root[b] < root[a] and (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[a], changed = root[b], True
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.label(docs).collect()}
    assert got == {i: (fp[i], root[i]) for i in fp}


def test_links_of_clusters():
    rng = np.random.default_rng(3)
    for size in (5, 60, 300):  # sparse and dense cells
        base = rng.integers(0, 2**63, 3, dtype=np.uint64)
        fps = [b for b in base]
        while len(fps) < size:
            fps.append(fps[rng.integers(len(fps))] ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))))
        fps = np.unique(np.array(fps, np.uint64))
        cell, own = simhash.cells(fps.view(np.int64))
        order = np.lexsort((own, cell))
        u, v = simhash.cell_links(cell[order], own[order])
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2

        def classes(edges, all_=fps):
            root = {int(x): int(x) for x in all_.view(np.int64)}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[find(a)] = find(b)
            return {frozenset(x for x in root if find(x) == r) for r in {find(x) for x in root}}

        pairs = [(int(fps.view(np.int64)[i]), int(fps.view(np.int64)[j])) for i, j in zip(*np.nonzero(near), strict=True)]
        assert classes(zip(u, v, strict=True)) == classes(pairs)
        a, b = simhash.dense_links(fps.view(np.int64))
        assert classes(zip(a.tolist(), b.tolist(), strict=True)) == classes(pairs)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == root


def test_maximal_segments():
    def plain(scores):  # the definition, by splitting around the greatest segment
        if not any(s > 0 for s in scores):
            return []
        total = [0.0]
        for s in scores:
            total.append(total[-1] + s)
        n = len(scores)
        best = max(((total[e] - total[s], -(e - s), s, e) for s in range(n) for e in range(s + 1, n + 1)))
        _, _, s, e = best
        return plain(scores[:s]) + [(s, e)] + [(a + e, b + e) for a, b in plain(scores[e:])]

    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-1, -2, 1, 2, 3]) + rng.random() * 0.01 for _ in range(rng.randint(1, 25))]
        assert [(s, e) for s, e, _ in toxicity.segments(np.array(scores))] == plain(scores)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.op7_toxic_passages(spark, sf).where("held_out").join(labels, "doc_id")
    right = [r["predicted"] == r["toxic"] for r in found.collect()]
    assert sum(right) / len(right) > 0.95
    lang = language.op10_language_filters(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = [r["lang"] == r["lang_pred"] for r in lang.collect()]
    assert sum(right) / len(right) > 0.97


def test_clean(spark):
    df = common.written(spark.range(5), "five")
    assert df.count() == 5 and common.clean(spark) >= 1
    assert common.clean(spark) == 0


def test_language_filters_against_brute_force(spark):
    """Every n-gram that goes in and every count, against sets of strings."""
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, rows = language.fit(docs), docs.collect()

    def grams(text):
        low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return [low[i : i + n] for n in (2, 3, 4) for i in range(len(low) - n + 1) if low[i : i + n].strip()]

    fold = [r for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    langs = sorted({r["lang"] for r in fold})
    n_rows = {x: sum(r["lang"] == x for r in fold) for x in langs}
    seen = {x: defaultdict(int) for x in langs}
    for r in fold:
        for g in set(grams(r["text"])):
            seen[r["lang"]][g] += 1
    most = defaultdict(float)
    for x in langs:
        for g, n in seen[x].items():
            if n >= language.MIN_ROWS:
                most[g] = max(most[g], n / n_rows[x])
    sets = {x: {g for g, n in seen[x].items() if n >= language.MIN_ROWS and n / n_rows[x] >= language.MIN_SHARE * most[g]} for x in langs}
    assert found.langs == langs
    texts = [r["text"] or "" for r in rows] + ["", "12 !", "Zürich, Ærø; 東京", "a"]
    n, held = found.counts(texts)
    false = found.false_rates()
    assert (false < 0.06).all()
    for t, k, row in zip(texts, n.tolist(), held.tolist(), strict=True):
        all_ = grams(t)
        assert k == len(all_)
        exact = [sum(g in sets[x] for g in all_) for x in langs]
        for e, h, f in zip(exact, row, false, strict=True):
            assert e <= h <= e + (f + 0.05) * k + 20  # no n-gram is missed; few are held falsely (a frequent one counts often)
    right = sum(max(langs, key=lambda x: sum(g in sets[x] for g in grams(t))) == p for t, (p, _) in zip(texts, found.decide(texts), strict=True) if grams(t))
    assert right >= 0.99 * sum(bool(grams(t)) for t in texts)


def test_shards_hold_every_text(spark, tmp_path):
    """Rows of one id whose texts have one size and one crc32, and equal rows, each keep their own text."""
    rows = [(1, "plumless"), (1, "buckeroo"), (1, "buckeroo"), (None, None), (None, None), (2, ""), *((i, f"t{i}") for i in range(3, 40))]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s", shards=4, parts_per_shard=2)
    got = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(map(str, rows))
    by = [sorted(r["slot"] for r in got if r["shard"] == i) for i in range(4)]
    assert all(x == list(range(len(x))) for x in by)


def test_wide_sketches_bound_sets_apart_and_fold():
    rng = np.random.default_rng(3)
    for n, m, bits, other in ((0, 7, 512, 512), (300, 340, 512, 1024), (900, 1100, 1024, 2048), (5000, 5000, 4096, 512)):
        pool = rng.integers(-(2**63), 2**63 - 1, n + m)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + m])
        apart = simhash.bits_apart(simhash.parity(a, bits), simhash.parity(b, other))
        small = min(bits, other)
        assert apart == simhash.bits_apart(simhash.parity(a, small), simhash.parity(b, small)) <= len(np.setxor1d(a, b))


def test_common_shingles_are_found_by_search():
    values = np.array([-5, 0, 3, 9], np.int64)
    s = np.array([-9, -5, 1, 3, 9, 12], np.int64)
    assert simhash.sorted_has(values, s).tolist() == np.isin(s, values).tolist()
    assert not simhash.sorted_has(values[:0], s).any()
    assert len(simhash.shingle_set("a b c d e f a b c d e f")) == 6 and len(simhash.shingle_set("a b")) == 1
    assert simhash.shingle_set("a b")[0] != simhash.shingle_set("b a")[0] and not len(simhash.shingle_set(None))
