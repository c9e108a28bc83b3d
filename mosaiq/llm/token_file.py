"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import new_path, partitions, table, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The id appended to each document.
END = 1
#: A file is closed once it holds so many ids.
FILE_IDS = 1 << 23
#: Control bytes whose values are decoded at a time.
DECODE_AT_ONCE = 1 << 17
#: Distinct words whose ids a worker remembers, from one task to the next: so many, and as many older ones.
CACHE = 500_000
MAGIC = b"MQTF"

# Each control byte holds the lengths, less one, of four values, the first in its lowest bits.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values: 1 to 4 little-endian bytes each."""
    v = np.asarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again: a table gives the lengths of a control byte's values, a gather their bytes."""
    codes, raw = np.frombuffer(control, np.uint8), np.frombuffer(data + bytes(4), np.uint8)
    out, begin = np.zeros(n, "<u4"), 0
    for s in range(0, len(codes), DECODE_AT_ONCE):
        size = _LENGTHS[codes[s : s + DECODE_AT_ONCE]].reshape(-1)[: n - 4 * s]
        ends = begin + np.cumsum(size)
        at, value = ends - size, out[4 * s : 4 * s + len(size)]
        for i in range(4):
            value |= np.where(size > i, raw[at + i], 0).astype("<u4") << np.uint32(8 * i)
        begin = int(ends[-1])
    return out


def write_block(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray, part: int = 0, base: int = 0) -> bytes:
    """One file: magic, header (JSON: ids, lengths, sizes, part, values of the part before it), control bytes,
    data bytes, their crc32."""
    control, data = encode_values(values)
    head = json.dumps({"n": len(values), "control": len(control), "data": len(data), "part": part, "base": base, "doc_ids": doc_ids, "lengths": lengths.tolist()}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + control + data + struct.pack("<I", zlib.crc32(control + data))


def read_block(content: bytes) -> tuple[dict, np.ndarray]:
    """A file's header and values. Raises on anything else, and on a damaged file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack_from("<I", content, 4)
    head = json.loads(content[8 : 8 + n])
    at = 8 + n
    control, data = content[at : at + head["control"]], content[at + head["control"] : at + head["control"] + head["data"]]
    if struct.unpack_from("<I", content, at + len(control) + len(data))[0] != zlib.crc32(control + data):
        raise ValueError("token file is damaged")
    return head, decode_values(control, data, head["n"])


# The front end under which a text's ids are its words' ids in a row.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words(dict):
    """Ids of a word, packed; for a text, ids().

    Under the front end APART, words are what lies between spaces: the tokenizer drops white space and
    matches nothing across it, so a text's ids are its words' ids in a row. There a Latin-1 word of letters,
    with or without punctuation behind it, skips the normaliser and the pattern, which only lower-case it
    and part the two; the tokenizer's model takes each part as it is. A text in which an added token stands,
    and any text under another front end, goes to the tokenizer whole."""

    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizer(path)
        front = json.loads(self.tokenizer.to_str())
        self.apart = all(front[k] == v for k, v in APART.items()) and front["model"]["type"] == "BPE" and not front["model"]["dropout"]
        added = [t["content"] for t in front["added_tokens"]]
        self.apart &= not any(t["normalized"] for t in front["added_tokens"])
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.kind = "I" if self.wide else "H"
        self.older: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.get(word)) is None:
            if m := self._PLAIN.fullmatch(word):
                part, marks = m.groups()
                if (low := part.lower()) != word:
                    out = self[low] + (self[marks] if marks else b"")
                else:
                    out = self.part(word)
            else:
                out = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids) if word else b""
        if len(self) >= CACHE:  # what is in use comes back from the older ones
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def part(self, word: str) -> bytes:
        return self.packed([t.id for t in self.tokenize(word if word.isascii() else word.translate(byte_level()))])

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if not self.apart or self.added and self.added.search(text):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def words(path: str) -> Words:
    """The worker's words: a task finds those that the tasks before it have met."""
    return Words(path)


@cache
def byte_level() -> dict[int, str]:
    """Characters of two UTF-8 bytes as a byte-level model sees them: bytes that aren't printable in
    Latin-1 stand as characters from 256 up, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - shown))}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(128, 256)}


def tokenise(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, ids: the whole text's ids and END, packed (see unpacked()); null and empty texts: END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        first, end = b"\0" if known.wide else b"", known.packed([END])
        for b in batches:
            ids = [first + known.ids(t) + end for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def unpacked(ids: bytes) -> np.ndarray:
    """Ids of tokenise(): 16 bits each, or 32 after a zero byte (then the length is odd)."""
    return np.frombuffer(ids, "<u4", offset=1) if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4")


def rank_table(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, the most frequent first: its size is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = b.column("ids").to_pylist()
            if ids:
                n = np.bincount(np.concatenate(list(map(unpacked, ids))))
                if len(n) > len(total):
                    total, n = n, total
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], "<u4")


def write(docs: DataFrame, folder: str, path: str = TOKENIZER) -> np.ndarray:
    """Write all documents' ids to token files in ``folder``, in ascending doc_id order (null first; rows
    of one doc_id in the order of a hash of their ids). Returns the rank table, also written to ``folder``/ranks.

    Texts don't move: ids of 16 bits do, once, to the task that owns their range of doc_ids. A task
    writes each file under a name of its own and renames it, so that a task run again, or twice at
    once, leaves the same files. An empty table leaves no token file. Other columns are not read."""
    spark = docs.sparkSession
    tokens = written(tokenise(docs, path), "tokens")
    ranks = rank_table(tokens)
    spark.createDataFrame([(ranks.tobytes(),)], "ranks binary").coalesce(1).write.parquet(f"{folder}/ranks")
    sent = spark.sparkContext.broadcast(ranks)
    spread = F.xxhash64("ids")
    sorted_ = tokens.withColumn("x", spread).repartitionByRange(partitions(spark), "doc_id", "x").sortWithinPartitions("doc_id", "x").withColumn("part", F.spark_partition_id())

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.zeros(int(sent.value.max()) + 1 if len(sent.value) else 1, "<u4")
        rank_of[sent.value] = np.arange(len(sent.value), dtype="<u4")
        ids, parts, held, file, part, base = [], [], 0, 0, 0, 0

        def close() -> None:
            nonlocal ids, parts, held, file, base
            if ids:
                block = write_block(ids, np.array(list(map(len, parts))), rank_of[np.concatenate(parts)], part, base)
                store(f"{folder}/files", f"part-{part:06d}-{file:06d}.mqtf", block)
                ids, parts, held, file, base = [], [], 0, file + 1, base + held

        for b in batches:
            for i, x, p in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("part").to_pylist(), strict=True):
                x, part = unpacked(x), p
                ids.append(i)
                parts.append(x)
                held += len(x)
                if held >= FILE_IDS:
                    close()
        close()
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([base], pa.int64())], ["part", "n_files", "n_ids"])

    manifest = sorted_.select("doc_id", "ids", "part").mapInArrow(put, "part int, n_files int, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return ranks


def store(folder: str, name: str, content: bytes) -> None:
    """Put a file into a shared folder whole or not at all."""
    import uuid

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(content)
    fs.move(own, f"{at}/{name}")


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, ids of every document in the token files, from the files alone.

    A file says which range of doc_ids it is of and how many ids of that range precede it; the manifest has
    a row for each range, so one figure a range places all documents. Files that aren't the manifest's,
    of a write that was given up, are passed over."""
    manifest = spark.read.schema("part int, n_files int, n_ids long").parquet(f"{folder}/manifest").where("n_files > 0").orderBy("part").collect()
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    ranks = np.frombuffer(spark.read.parquet(f"{folder}/ranks").first()["ranks"], "<u4")
    before, total = {}, 0
    for r in manifest:
        before[r["part"]] = (total, r["n_ids"])
        total += r["n_ids"]
    sent = spark.sparkContext.broadcast((ranks, before))  # the vocabulary, and a row for each task that wrote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, before = sent.value
        for b in batches:
            for content in b.column("content"):
                head, values = read_block(content.as_buffer().to_pybytes())
                start, n = before.get(head["part"], (0, 0))
                if head["base"] >= n:
                    continue
                ids, doc_ids, lengths = ranks[values], head["doc_ids"], np.array(head["lengths"], np.int64)
                ends, start = np.cumsum(lengths), start + head["base"]
                for s in range(0, len(doc_ids), 2000):
                    e = min(len(doc_ids), s + 2000)
                    each = [ids[a - n : a].tobytes() for a, n in zip(ends[s:e], lengths[s:e], strict=True)]
                    yield pa.record_batch([pa.array(doc_ids[s:e], pa.int64()), pa.array(start + ends[s:e] - lengths[s:e], pa.int64()), pa.array(each, pa.binary())], ["doc_id", "start", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mqtf").load(f"{folder}/files")
    return files.select("content").mapInArrow(run, "doc_id long, start long, ids binary")


def op2_token_file(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder)
    found = read(spark, folder)
    return found.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
