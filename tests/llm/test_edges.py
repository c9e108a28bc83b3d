"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import zlib

import pytest
from mosaiq.llm import bpe, common, decontaminate, exact_dedup, html_text, language, sharding, simhash, token_file, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", h long, fp string, sha int, row string, k int, ids string, _at long, n int, word string"
TEXTS = [(1, "a b c d"), (2, None), (3, ""), (4, " \n "), (1, "a b c d"), (5, "abcd"), (None, "a b c d!"), (6, "x " * 30000), (None, None), (7, "äöü 日本語")]


def docs(spark, rows, schema=DOCS):
    width = len(schema.split(", "))
    return spark.createDataFrame([(i, t, None, None, None, *[None] * (width - 5)) for i, t in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, TEXTS, EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_sharding(spark, odd, none):
    got = rows(sharding.shard(odd, shards=3))
    assert len(got) == len(TEXTS)
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert rows(sharding.shard(none)) == []


def test_exact_dedup(spark, odd, none):
    for bits in (64, 1):  # one hash bit: long chains
        got = rows(exact_dedup.dedup(odd, capacity=1, hash_bits=bits))
        assert len(got) == len(TEXTS)
        groups = {}
        for i, t in TEXTS:
            groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), i is None, i))
        want = sorted(str((i, min(groups[n])[2], len(groups[n]))) for i, t in TEXTS for n in ["".join(c for c in t or "" if c not in " \t\n\v\f\r")])
        assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == want
    kept = exact_dedup.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in rows(kept)) == sorted(map(str, [(1, "a b c d"), (None, "a b c d!"), (6, "x " * 30000), (7, "äöü 日本語"), (4, " \n ")]))
    assert rows(exact_dedup.dedup(none)) == [] == rows(exact_dedup.keep(none))


def test_directory_doubles(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) as h", "id + 1 as n")
    grown = exact_dedup.directory(keys, capacity=100)
    assert sum(2.0**-d for d, *_ in grown.buckets) == 1 and len(grown.buckets) > 8
    assert all(k <= 100 for _, _, k, _ in grown.buckets) and sum(n for *_, n in grown.buckets) == 500500
    hashes = [r["h"] % 2**64 for r in keys.collect()]
    assert all(sum(h >> (64 - d) == p for h in hashes) == k if d else k == 1000 for d, p, k, _ in grown.buckets)
    entries = {r["_entry"]: r["bucket"] for r in grown.entries(spark).collect()}
    assert len(entries) == 2**grown.depth and set(entries.values()) == set(range(len(grown.buckets)))
    single = exact_dedup.directory(spark.createDataFrame([(0, 1), (1, 5)], "h long, n long"), capacity=1)
    assert max(d for d, *_ in single.buckets) == 64  # keys that differ in their last bit only


def test_index_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    entries, links, grown = exact_dedup.index(docs)
    assert grown.depth > 1 and len(grown.buckets) > 4
    ids = [r["doc_id"] for r in docs.collect()]
    many = spark.createDataFrame([(i, "hot text" if i % 3 else f"t {i}") for i in ids], "doc_id long, text string")
    for bits in (64, 2):
        _, links, grown = exact_dedup.index(many, capacity=20, hash_bits=bits)
        assert bits == 2 or max(r["slices"] for r in grown.entries(spark).collect()) > 1  # the hot text's bucket has several owners
        found = {(r["rep"], r["group_size"]) for r in links.where("group_size > 1").collect()}
        assert found == {(min(i for i in ids if i % 3), sum(1 for i in ids if i % 3))}
        assert links.count() == 1 + sum(1 for i in ids if i % 3 == 0)


def test_simhash(spark, odd, none):
    got = rows(simhash.label(odd))
    assert len(got) == len(TEXTS)
    zero = [r for r in got if r["fp"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    kept = simhash.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in rows(kept)) == ["1", "2", "5", "6", "7", "None"]
    assert rows(simhash.label(none)) == []


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(none, labels)
    got = rows(toxicity.detect(odd, model))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert rows(toxicity.detect(none, model)) == []
    assert toxicity.keep(odd, labels).columns == odd.columns
    one = spark.createDataFrame([(i, None, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, one).slope == 0  # one class only


def test_language(spark, odd, none):
    filters = language.fit(none)
    assert [r["lang_pred"] for r in rows(language.identify(odd, filters))] == ["und"] * len(TEXTS)
    known = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", None, None) for i in range(40)], DOCS)
    filters = language.fit(known)
    got = [r["lang_pred"] for r in rows(language.identify(spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, None), (4, "12 !")], "doc_id long, text string"), filters))]
    assert got == ["en", "fr", "und", "und"]
    assert rows(language.identify(none, filters)) == []


@pytest.mark.parametrize("words", [1 << 21, 1])
def test_bpe(spark, odd, none, words):
    reference = bpe.encoding(bpe.RANKS)
    got = rows(bpe.encode(odd, block_words=words))
    want = sorted(str((i, reference.encode_ordinary(t or ""))) for i, t in TEXTS)
    assert sorted(str((r["doc_id"], bpe.unpack(r["ids"]).tolist())) for r in got) == want
    back = rows(bpe.decode(bpe.encode(odd, block_words=words)))
    assert sorted(str((r["doc_id"], bytes(r["text_bytes"]))) for r in back) == sorted(str((i, (t or "").encode())) for i, t in TEXTS)
    assert rows(bpe.encode(none, block_words=words)) == []


def test_bpe_is_the_librarys(spark):
    """A whole table and odd texts: ids, digests and decoded bytes; and each distinct word encoded once."""
    import hashlib
    import random

    rng = random.Random(4)
    bits = ["don't", "'LL", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "e\u0301", "ß", "日本語", "123456", "_", "...", "\U0001f600\u200d", "Ab", "x", "\x85", "\u2028", "\u200b", "<|endoftext|>"]
    odd = [(10**6 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    reference = bpe.encoding(bpe.RANKS)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    stored = common.written(docs, "bpe-test")
    for words in (1 << 21, 5000):
        got = rows(bpe.digests(bpe.encode(stored, block_words=words)))
        assert len(got) == len(texts)
        for r in got:
            ids = reference.encode_ordinary(texts[r["doc_id"]])
            want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_token_file(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "FILE_IDS", 5000)  # several files of a range
    token_file.write(odd, f"file://{tmp_path}/a")
    got = rows(token_file.read(spark, f"file://{tmp_path}/a"))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_file.TOKENIZER)
    want = sorted(str((i, t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in TEXTS)
    assert sorted(str((r["doc_id"], token_file.np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    at = sorted((r["start"], len(r["ids"]) // 4) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0
    token_file.write(none, f"file://{tmp_path}/b")
    assert rows(token_file.read(spark, f"file://{tmp_path}/b")) == []


def test_token_ids_are_the_librarys(tmp_path):
    """Equal to the unaltered library on a whole table and on odd texts, added tokens among them."""
    import json
    import random

    import duckdb
    from tokenizers import Tokenizer

    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    rng = random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "'s", "'LL", "don't", " ", "\n", "\t", "\u00a0", "\u2003", "e\u0301", "\u0301", "ß", "İ", "Σ", "ﬁ", "日本", "1२", "_", "-", "…", "\U0001f600\u200d", "Ab", "x", "\x85", "\x00"]
    texts += ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(4000))]
    plain, mine = Tokenizer.from_file(token_file.TOKENIZER), token_file.Words(token_file.TOKENIZER)
    assert mine.apart

    def ids(t, known=mine):
        raw = known.ids(t)
        return token_file.np.frombuffer(raw, "<u2").tolist()

    assert [ids(t) for t in texts] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    other = json.load(open(token_file.TOKENIZER))
    other["normalizer"] = {"type": "NFC"}  # another front end: nothing is assumed of it
    (tmp_path / "other.json").write_text(json.dumps(other))
    known, plain = token_file.Words(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not known.apart and ids("Ab  c <|endoftext|>", known) == plain.encode("Ab  c <|endoftext|>", add_special_tokens=False).ids


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([(1, "b c"), (2, None), (3, ""), (None, "ABCD"), (4, "x " * 12), (1, "zzz")], "item_id long, text string")
    for size in (1 << 20, 8):  # one block, and several
        got = rows(decontaminate.contamination(odd, items, block_bytes=size))
        n = {str((r["doc_id"], r["n_words"])): (sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got}
        assert len(got) == len(TEXTS)
        assert n["(1, 4)"] == (2, ["1"]) and n["(5, 1)"] == (1, []) and n["(6, 30000)"] == (30000, ["4"]) and n["(2, 0)"] == (0, [])
        kept = decontaminate.keep(odd, items, block_bytes=size)
        assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in rows(kept)) == ["2", "3", "4", "7", "None"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert len(rows(decontaminate.contamination(odd, empty))) == len(TEXTS)
    assert rows(decontaminate.contamination(none, items)) == [] == rows(decontaminate.keep(none, items))
    assert decontaminate.remove("One, two; THREE four!", [(1, 3)]) == "One,   four!"


def test_boilerplate():
    page = """<html><body class="page has-sidebar"><div id="cookie-notice">We use cookies. <button>ok</button></div>
    <header><h1>Site</h1><p>Tag line of the site here</p></header><ul class="menu"><li><a href="/">Home</a></li></ul>
    <div class="layout with-sidebar"><div class="post-header"><h1>Title</h1></div>
    <section><p>One two three four five six seven eight nine ten eleven.</p><p>Second paragraph &amp; more text to make
    it   long enough, really.</p></section><section><h2>Sub</h2><p>Third with <a href=x>a link</a> inside of it and more text.</p>
    <ul><li>item a<li>item b</ul></section><div class="ad-slot">Buy now, a very long advertisement text, buy, buy it now!</div></div>
    <div class="sidebar"><p>Related stuff that goes on and on and on and on.</p></div>
    <section id="comments"><p>Nice article, I liked it very much, thanks for it all!</p></section>
    <form><input><p>Sign up now</p></form><footer>c</footer></body></html>"""
    want = "Title One two three four five six seven eight nine ten eleven. Second paragraph & more text to make it long enough, really. Sub Third with a link inside of it and more text. item a item b"
    assert html_text.extract(page) == want


def test_html_and_warc(spark, tmp_path):
    cols = "page_id long, url string, html string, text string, record string"
    data = [(1, "u", "<p>a <b>b</b>&amp;c</p>", None, None), (2, None, None, None, None), (None, "v", "", None, None), (1, "u", "<p>a <b>b</b>&amp;c</p>", None, None), (3, "w", "<div>" * 5000 + "deep", None, None), (4, "x", "<script>never ends", None, None), (5, "y", "<a href='1'>l</a", None, None)]
    pages = spark.createDataFrame(data, cols)
    got = rows(html_text.main_text(pages))
    assert [r["text"] for r in got[:4]] == ["a b&c", "", "", "a b&c"] and got[4]["text"] == "deep"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    records = warc.derivatives(warc.responses(pages))
    out = rows(records)
    assert len(out) == 2 * len(data)
    for r in out:
        ((headers, block),) = warc.parse(r["record"])
        known = dict(headers)
        assert warc.digest(block) == r["block_digest"] == known["WARC-Block-Digest"] and known["WARC-Refers-To"] == r["refers_to"]
    ids = {r["record_id"] for r in out}
    assert {r["linked_to"] for r in out} == ids and {r["error"] for r in out} == {None}
    warc.write(records, f"file://{tmp_path}/w", file_bytes=500)
    assert sorted(bytes(r["record"]) for r in rows(warc.read(spark, f"file://{tmp_path}/w"))) == sorted(bytes(r["record"]) for r in out)
    nothing = spark.createDataFrame([], cols)
    assert rows(html_text.main_text(nothing)) == [] == rows(warc.derivatives(warc.responses(nothing)))
