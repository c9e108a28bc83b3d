"""The operators on vectors and the audit of sources, against brute force and on odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from mosaiq.llm import source_audit, vector_codes, vector_dedup

KIND = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold=0.98):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    up, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if (a @ b) / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = up[i], up[j]
                    up = [min(x, y) if u in (x, y) else u for u in up]
    least = {}
    for i, r in enumerate(up):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(up[i])) for i in range(n)), key=repr)


def crowd(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dims)
    return [(centre + rng.standard_normal(dims) * s).tolist() for s in rng.uniform(0.02, 0.2, n)]


def test_near_vectors_against_all_pairs(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [*crowd(1, 60), *crowd(2, 40), *np.random.default_rng(3).standard_normal((60, 16)).tolist()]
    vectors += [vectors[0]] * 5 + [[x * 4 for x in vectors[1]], [0.0] * 16, None, [], [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0], [2.0], [3e38] * 16, [1e-38] * 16, [-0.0, 1.0], [0.0, 1.0]]
    rows = [(i + 10, v, None if i % 17 == 5 else i % 2) for i, v in enumerate(vectors)] + [(10, vectors[0], 0), (None, vectors[0], 0), (None, [5.0] * 3, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", n_links string, vid int")
    for block in (1024, 7):  # entries in one group, and dealt over blocks
        got = vector_dedup.near(docs, block=block)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        got = got.collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_links(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_vectors_of_nothing(spark):
    assert vector_dedup.near(spark.createDataFrame([], KIND)).collect() == []
    only = vector_dedup.near(spark.createDataFrame([(3, None, 1), (4, [1.0], None)], KIND)).collect()
    assert [tuple(r) for r in sorted(only)] == [(3, 0, 3, True), (4, 0, 4, True)]


def test_tables_follow_size_and_recall():
    assert vector_dedup.layout(500, 0.98, 1e-6)[0] == 9 and vector_dedup.layout(1 << 20, 0.98, 1e-6)[0] == 20
    turn = vector_dedup.learn(vector_dedup.units(np.random.default_rng(0).standard_normal((300, 8))), 20)
    assert np.allclose(turn[:, :8].T @ turn[:, :8], np.eye(8)) and turn.shape == (8, 20)


def test_pairs_within_groups():
    starts, n = np.array([0, 3, 4, 9]), 11
    want = [(i, j) for a, b in ((0, 3), (3, 4), (4, 9), (9, 11)) for i in range(a, b) for j in range(i + 1, b)]
    for most in (1, 2, 5, 100):
        assert sorted((int(i), int(j)) for x, y in vector_dedup._pairs(starts, n, most) for i, j in zip(x, y, strict=True)) == want


def plain_lloyd(rows, parts=4, entries=256, rounds=4):
    xs = [[math.floor(float(np.float32(c)) * 1024) for c in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, xs[i]))
    w = len(xs[0]) // parts
    cut = [[x[p * w : p * w + w] for p in range(parts)] for x in xs]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(c[p], books[p])].append(c[p])
            for e, xs_ in mine.items():
                books[p][e] = [sum(col) // len(xs_) for col in zip(*xs_, strict=True)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    total = Counter()
    for (_, _, lab), e in zip(rows, errors, strict=True):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(y) for p in range(parts) for e in books[p] for y in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for k in c), e, total[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)), key=repr)


def test_codes_against_plain_rounds(spark):
    rng = np.random.default_rng(5)
    vectors = [*rng.standard_normal((50, 8)).tolist(), *(rng.integers(-2, 3, (60, 8)) / 4).tolist(), [9000.5] * 8, [-9000.5] * 8]
    rows = [(i // 2, v, None if i % 9 == 0 else i % 3) for i, v in enumerate(vectors)] + [(None, vectors[3], 1), (7, vectors[3], 1), (7, vectors[3], 1)]
    odd = [(1, None, 0), (0, [], 0), (0, [float("nan")] * 8, 0), (0, [float("inf")] * 8, 0), (0, [None] * 8, 0), (50, [1.0] * 4, 1), (51, [1.0] * 9, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], KIND + ", error int, code string")
    for entries in (16, 256):
        got = vector_codes.compress(docs, entries=entries)
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows, entries=entries)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(8)
    x = rng.integers(-900, 900, (4000, 6)).astype(np.int64)
    book = x[:64].copy()
    entry = moved = None
    upper = lower = np.zeros(len(x))
    scans = []
    for _ in range(6):
        entry, upper, lower, n = vector_codes.assign(x, book, entry, upper, lower, moved)
        scans.append(n)
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all()
        new = np.stack([x[entry == e].sum(0) // (entry == e).sum() if (entry == e).any() else book[e] for e in range(len(book))])
        moved = np.nextafter(np.sqrt(((new - book) ** 2).sum(1).astype(float)), np.inf) * (new != book).any(1)
        book = new
    assert scans[0] == len(x) and scans[-1] < len(x)


def test_large_components_are_exact_or_refused(spark):
    x = np.array([[1 << 27, -(1 << 27)], [5, 5], [6, 5]], np.int64)
    assert vector_codes._distances(x, x).tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 4, 0)], KIND)).collect()
    assert vector_codes.compress(spark.createDataFrame([], KIND)).collect() == []


def plain_audit(rows, min_docs, top):
    import re

    langs, df, count = defaultdict(set), Counter(), Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        words = [w for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))]
        df.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in langs.items():
        kept = [w for (x, w), n in df.items() if x == lang and n >= min_docs]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        each = {s: {w: count[lang, s, w] for w in kept} for s in sources}
        p = {s: share(c) for s, c in each.items()}
        q = share({w: sum(c[w] for c in each.values()) for w in kept})
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if each[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found, 1)]
    return sorted(out)


def test_audit_against_plain_sums(spark):
    rng = np.random.default_rng(4)
    words = ["a", "b", "Ab", "ß", "É", "été", "日本", "x\x00y", "naïve", "I", "İ", "ab-ab", "e9e", "𝒜b"]
    rows = [("en" if i % 3 else None, rng.choice(["s", "t", "ü", "z"]), " ".join(rng.choice(words, rng.integers(0, 12), p=np.arange(1, 15) / 105))) for i in range(90)]
    rows += [("en", None, None), ("en", "empty", ""), ("xx", "one", "word word"), ("xx", "two", "1 2 3"), ("yy", "one", None), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string, term string, rank int")
    for least, top in ((1, 3), (5, 50), (1000, 50)):
        got = source_audit.audit(docs, least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, top)
    assert source_audit.audit(docs.limit(0)).collect() == []
