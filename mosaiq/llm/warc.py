"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import new_path, table, written
from mosaiq.llm.token_file import store

VERSION = "WARC/1.1"
#: The date of responses that are built from pages, which have none.
DATE = "1970-01-01T00:00:00Z"
#: Names under which a derivative repeats its source's headers.
SOURCE_HEADERS = ("WARC-Date", "WARC-Target-URI", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Payload-Digest", "WARC-Block-Digest")
FILE_BYTES = 32 << 20

#: The rest of a tag: quoted values may hold any sign; a quote that never closes is a sign like others.
_IN = r"(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?(?:>|\Z)"
_NOT_TEXT = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)(?=[\s/>]){_IN}.*?(?:</\1(?=[\s/>])[^>]*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]){_IN}", re.I)
_TAG = re.compile(rf"<[/!?a-zA-Z]{_IN}")
_TITLE = re.compile(rf"<title(?=[\s/>]){_IN}(.*?)(?:</title|\Z)", re.S | re.I)
_ANCHOR = re.compile(rf"<a(?=[\s/])({_IN})", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Digests by label, as hexadecimal or base 32.
_DIGESTS = ("md5", "sha1", "sha256", "sha384", "sha512")


def digest(block: bytes) -> str:
    """Labelled digest: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    """An id that follows from its parts alone: a task that runs again gives its records the same ids."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=5)}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; a line break in a header's value becomes a space."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class Malformed(ValueError):
    """What isn't a WARC record, and why."""


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The records of an uncompressed file, in order: headers as written, and the block. Raises Malformed."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        head = raw[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not head[0].startswith("WARC/"):
            raise Malformed(f"no WARC record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in head[1:]:
            if line[:1] in (" ", "\t") and headers:  # a folded line
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
                continue
            k, colon, v = line.partition(":")
            if not colon:
                raise Malformed(f"no header: {line[:80]}")
            headers.append((k.strip(), v.strip()))
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not (size.isascii() and size.isdigit()):
            raise Malformed("no Content-Length")
        block = raw[end + 4 : end + 4 + int(size)]
        if len(block) < int(size):
            raise Malformed("the block ends early")
        yield headers, block
        at = end + 4 + len(block) + 4


def matches(labelled: str, *blocks: bytes) -> str:
    """Whether a labelled digest is one of the blocks': true, false, or unknown for a label that isn't known."""
    label, _, value = labelled.partition(":")
    if label.lower().replace("-", "") not in _DIGESTS:
        return "unknown"
    for block in blocks:
        found = hashlib.new(label.lower().replace("-", ""), block).digest()
        if value.strip().rstrip("=").upper() in (base64.b32encode(found).decode().rstrip("="), found.hex().upper()):
            return "true"
    return "false"


def dechunked(body: bytes) -> bytes:
    """A body without chunked transfer coding; one that isn't so coded, or breaks off, as far as it goes."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"-", 16)
        except ValueError:
            return b"".join(out) if out else body
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def inflated(body: bytes, coding: str) -> bytes | None:
    """A body without its content coding, as far as it can be undone; None for a coding that isn't known here."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        if name in ("gzip", "x-gzip"):
            tries = (31,)
        elif name == "deflate":
            tries = (15, -15)  # with or without its wrapper, as servers send both
        elif name == "identity":
            continue
        else:
            return None
        for bits in tries:
            undo = zlib.decompressobj(bits)
            out = []
            try:
                for at in range(0, len(body), 1 << 16):
                    out.append(undo.decompress(body[at : at + (1 << 16)]))
            except zlib.error:
                pass
            if any(out):
                break
        body = b"".join(out)
    return body


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record of a page: null html is an empty payload, a null url the URI ``about:blank``."""
    payload = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    found = digest(payload)
    return serialise([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, found)), ("WARC-Target-URI", url or "about:blank"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", found), ("WARC-Block-Digest", digest(block))], block)


def plain_text(html: str) -> str:
    """The page's text, a line for each block, references decoded; no comments, scripts or styles."""
    text = _TAG.sub("", _BREAK.sub("\n", _NOT_TEXT.sub(" ", html)))
    return "\n".join(x for line in unescape(text).split("\n") if (x := " ".join(line.split())))


def outlinks(html: str) -> list[str]:
    """The targets of the page's anchors, each once, as they stand, references decoded."""
    found: dict[str, None] = {}
    for m in _ANCHOR.finditer(html):
        for a in _ATTRIBUTE.finditer(m[1]):
            if a[1].lower() == "href":
                found.setdefault(" ".join(unescape(a[2] or a[3] or a[4] or "").split()))
                break
    return [x for x in found if x]


def derive(raw: bytes) -> list[dict]:
    """The metadata and conversion records of a response record, or one row with what is wrong with it.

    Both refer to the response's id and repeat its headers: date and target URI as their own, all of
    SOURCE_HEADERS in the metadata block, the payload digest as WARC-Refers-To-Payload-Digest. The metadata
    names the conversion. Transfer and content codings are undone for the text; where one isn't known, or
    the response has no HTTP header, the text is empty. A payload whose digest doesn't match is marked so
    in the metadata, and still converted."""
    try:
        headers, block = next(parse(raw), (None, b""))
        if headers is None:
            raise Malformed("an empty record")
        known = {k.lower(): v for k, v in reversed(headers)}  # of repeated headers the first
        if not known.get("warc-record-id"):
            raise Malformed("no WARC-Record-ID")
        if known.get("warc-type", "response") != "response":
            raise Malformed(f"a {known['warc-type']} record, no response")
    except Malformed as e:
        return [dict.fromkeys(_FIELDS) | {"error": str(e)}]
    source, uri = known["warc-record-id"], known.get("warc-target-uri", "about:blank")
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("latin-1").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in reversed(lines))}
    kind, coding = fields.get("content-type", ""), fields.get("content-encoding", "")
    sent = dechunked(payload) if "chunked" in fields.get("transfer-encoding", "").lower() else payload
    body = inflated(sent, coding)
    charset = m[1] if (m := re.search(r"charset=[\"']?([\w-]+)", kind, re.I)) else "utf-8"
    try:
        html = (body or b"").decode(charset, "replace")
    except (LookupError, UnicodeError):
        html = (body or b"").decode("utf-8", "replace")
    text = plain_text(html).encode("utf-8", "replace")
    ids = {t: record_id(t, source) for t in ("metadata", "conversion")}
    own = known.get("warc-payload-digest") or digest(sent)
    title = " ".join(unescape(m[1]).split()) if (m := _TITLE.search(html)) else ""
    about = [("refers-to", source), *(("source-" + k.lower(), known[k.lower()]) for k in SOURCE_HEADERS if k.lower() in known), ("http-status", status), ("http-content-type", kind), ("payload-digest-ok", matches(own, payload, sent))]
    about += [("http-content-encoding", coding)] if coding else []
    about += [("payload-coding-known", "false")] if body is None else []
    about += [("conversion", ids["conversion"]), ("title", title), *(("outlink", x) for x in outlinks(html))]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about).encode("utf-8", "replace")
    out = []
    for t, other, kind_of, made in (("metadata", "conversion", "application/warc-fields", meta), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        head = [("WARC-Type", t), ("WARC-Record-ID", ids[t]), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", known.get("warc-date", DATE)), ("WARC-Refers-To-Payload-Digest", own), ("Content-Type", kind_of), ("WARC-Block-Digest", digest(made))]
        out.append({"record_type": t, "record_id": ids[t], "refers_to": source, "linked_to": ids[other], "target_uri": uri, "source_payload_digest": own, "block_digest": head[-1][1], "block_length": len(made), "error": None, "record": serialise(head, made)})
    return out


_FIELDS = {"record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "linked_to": pa.string(), "target_uri": pa.string(), "source_payload_digest": pa.string(), "block_digest": pa.string(), "block_length": pa.int64(), "error": pa.string(), "record": pa.binary()}
SCHEMA = "page_id long, " + ", ".join(f"{k} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for k, t in _FIELDS.items())


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: a response record of every page; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [response(*x) for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)]
            yield pa.record_batch([b.column("page_id"), pa.array(raw, pa.binary())], ["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows, metadata and conversion, for each row of ``records`` (page_id, record).

    A null record has none; one that is no response record, or damaged, has one row with ``error`` and
    nothing else, so that no record fails the job. Repeated rows give the same records again, ids included, since an id
    follows from its source's; an empty table gives an empty result. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, x) for i, raw in zip(b.column("page_id").to_pylist(), b.column("record").to_pylist(), strict=True) if raw for x in derive(raw)]
            yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), *(pa.array([x[k] for _, x in found], t) for k, t in _FIELDS.items())], ["page_id", *_FIELDS])

    return records.select("page_id", "record").mapInArrow(run, SCHEMA)


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the column ``record`` to WARC files in a shared folder, one gzip member a record.

    Returns the files' names and counts of records. A file appears whole or not at all, under a name
    that a repeated task uses again."""
    path = new_path(records.sparkSession, "warc-manifest")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size, names, counts, part = [], 0, 0, [], [], 0
        def close() -> None:
            nonlocal held, n, size
            name = f"part-{part:06d}-{len(names):06d}.warc.gz"
            store(folder, name, b"".join(held))
            names.append(name)
            counts.append(n)
            held, n, size = [], 0, 0
        for b in batches:
            for raw, part in zip(b.column("record").to_pylist(), b.column("part").to_pylist(), strict=True):
                held.append(gzip.compress(raw, 6, mtime=0))
                n, size = n + 1, size + len(held[-1])
                if size >= file_bytes:
                    close()
        if held:
            close()
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "n_records"])

    rows = records.where(F.col("record").isNotNull()).select("record", F.spark_partition_id().alias("part"))
    rows.mapInArrow(put, "file string, n_records long").write.parquet(path)
    return records.sparkSession.read.schema("file string, n_records long").parquet(path)


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        undo, out = zlib.decompressobj(31), []
        while not undo.eof and at < len(view):
            piece = view[at : at + (1 << 14)]
            out.append(undo.decompress(piece))
            at += len(piece) - len(undo.unused_data)
        yield b"".join(out)


def read(spark, folder: str) -> DataFrame:
    """record_type, record_id, record of every record in the WARC files of a folder. Raises on a damaged file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for member in members(content.as_py()):
                    each = list(parse(member))
                    heads = [{k.lower(): v for k, v in h} for h, _ in each]
                    raw = [serialise([x for x in h if x[0].lower() != "content-length"], block) for h, block in each]
                    yield pa.record_batch([pa.array([h["warc-type"] for h in heads]), pa.array([h["warc-record-id"] for h in heads]), pa.array(raw, pa.binary())], ["record_type", "record_id", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(run, "record_type string, record_id string, record binary")


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    found = written(derivatives(responses(table(spark, sf_dir, "pages"))), "derivatives")
    write(found, new_path(spark, "warc"))
    return found.withColumn("record_sha256", F.sha2("record", 256)).drop("record")
