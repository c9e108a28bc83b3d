"""Derivatives against plain libraries, and records that break the rules."""

import base64
import email
import gzip
import hashlib
import zlib
from html.parser import HTMLParser

from mosaiq.llm import warc

BREAKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


class Plain(HTMLParser):
    """A page's text, title and anchors by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links, self.title, self.in_title = [], 0, {}, "", False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template")
        self.in_title = tag == "title"
        if tag in BREAKS:
            self.out.append("\n")
        if tag == "a" and not self.skip and dict(attrs).get("href"):
            self.links.setdefault(" ".join(dict(attrs)["href"].split()))

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template")
        self.in_title = False
        if tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.out.append(data)

    def text(self):
        return "\n".join(x for line in "".join(self.out).split("\n") if (x := " ".join(line.split())))


def fields(raw):
    head, _, rest = raw.partition(b"\r\n\r\n")
    known = email.message_from_bytes(head.partition(b"\r\n")[2])
    return known, rest[: int(known["Content-Length"])]


def test_whole_table_against_plain_libraries(spark, tmp_path):
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    responses = warc.responses(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    source = {r["page_id"]: fields(bytes(r["record"])) for r in responses.collect()}
    found = warc.derivatives(responses).collect()
    assert len(found) == 2 * len(pages)
    for r in found:
        page, (src, _), (known, block) = pages[r["page_id"]], source[r["page_id"]], fields(bytes(r["record"]))
        plain = Plain()
        plain.feed(page["html"])
        plain.close()
        assert known["WARC-Refers-To"] == src["WARC-Record-ID"] and known["WARC-Target-URI"] == page["url"] and known["WARC-Date"] == src["WARC-Date"]
        sha1 = "sha1:" + base64.b32encode(hashlib.sha1(page["html"].encode()).digest()).decode()
        assert known["WARC-Refers-To-Payload-Digest"] == src["WARC-Payload-Digest"] == sha1
        assert known["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert known["WARC-Concurrent-To"] is None
        if r["record_type"] == "conversion":
            assert block.decode() == plain.text()
        else:
            about = [line.split(": ", 1) for line in block.decode().splitlines()]
            assert [v for k, v in about if k == "outlink"] == list(plain.links)
            one = dict(about)
            assert one["title"] == " ".join(plain.title.split()) and one["payload-digest-ok"] == "true" and one["conversion"] == r["linked_to"]


def made(http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html", payload=b"<p>t</p>", **headers):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", **{k.replace("_", "-"): v for k, v in headers.items()}}
    return warc.serialise([(k, v) for k, v in head.items() if v is not None], http + b"\r\n\r\n" + payload)


def test_records_that_break_the_rules(spark):
    bad = [b"", b"junk", b"WARC/1.1\r\nno end", b"WARC/1.1\r\nWARC-Record-ID: <a>\r\n\r\nx", b"WARC/1.1\r\nContent-Length: -4\r\n\r\n", b"WARC/1.1\r\nWARC-Record-ID: <a>\r\nContent-Length: 99\r\n\r\nshort", made(WARC_Record_ID=None), made(WARC_Type="request"), b"WARC/1.1\r\nnothing\r\n\r\n", b"\xff\xfe\x00"]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)] + [(77, bytearray(made())), (None, None)], "page_id long, record binary")
    found = warc.derivatives(rows).collect()
    assert sorted(r["page_id"] for r in found if r["error"]) == list(range(1, len(bad)))  # no bytes: no record
    assert sorted(r["record_type"] for r in found if not r["error"]) == ["conversion", "metadata"]


def text_and_meta(raw):
    meta, conversion = warc.derive(raw)
    return fields(conversion["record"])[1].decode(), dict(x.split(": ", 1) for x in fields(meta["record"])[1].decode().splitlines() if ": " in x)


def test_digests_and_codings():
    page = b"<p>caf\xc3\xa9</p>"
    for label, value in (("sha256", hashlib.sha256(page).hexdigest()), ("sha-256", base64.b32encode(hashlib.sha256(page).digest()).decode()), ("md5", hashlib.md5(page).hexdigest()), ("SHA1", base64.b32encode(hashlib.sha1(page).digest()).decode().lower())):
        assert text_and_meta(made(payload=page, WARC_Payload_Digest=f"{label}:{value}"))[1]["payload-digest-ok"] == "true"
    assert text_and_meta(made(payload=page, WARC_Payload_Digest="sha1:AAAA"))[1]["payload-digest-ok"] == "false"
    assert text_and_meta(made(payload=page, WARC_Payload_Digest="blake9:AAAA"))[1]["payload-digest-ok"] == "unknown"
    wrapped = {"gzip": gzip.compress(page), "deflate": zlib.compress(page), "x-gzip, identity": gzip.compress(page), "deflate, gzip": gzip.compress(zlib.compress(page)[2:-4])}
    for coding, body in wrapped.items():
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: {coding}".encode()
        assert text_and_meta(made(http, body))[0] == "café"
        chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
        right = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        text, meta = text_and_meta(made(http + b"\r\nTransfer-Encoding: chunked", chunks, WARC_Payload_Digest=right))
        assert text == "café" and meta["payload-digest-ok"] == "true"
        assert text_and_meta(made(http, body[:-3]))[0] in ("café", "caf\ufffd", "caf")  # breaks off
    text, meta = text_and_meta(made(b"HTTP/1.1 200 OK\r\nContent-Encoding: br", b"\x00\x01"))
    assert text == "" and meta["payload-coding-known"] == "false"
    assert text_and_meta(made(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such", page))[0] == "café"


def test_text_and_links_of_odd_markup():
    assert warc.plain_text('<a title="x > y" href=1>link</a> <b data=\'a>b\'>c</b>') == "link c"
    assert warc.plain_text('<p title="open>text</p><p>more</p>') == "text\nmore"
    assert warc.plain_text("<script>if (a > b) '</p>'</script x>t<style>p{}") == "t"
    assert warc.plain_text("<preface>a</preface><pre>b</pre>1 < 2 &lt;p&gt;") == "a\nb\n1 < 2 <p>"
    assert warc.outlinks("<a title='href=no' HREF = \"/x?a&amp;b\">1</a><a href=/y>2</a><a href='/y'>3</a><abbr href=/z><a name=q>") == ["/x?a&b", "/y"]
    assert warc.plain_text("<" + "a" * 200000 + '"' + "<b'" * 20000) == ""
