"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import partitions, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: White space of the tokenizer's pattern (Unicode White_Space).
_WS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A word is a run of other characters with the space before it, or white space as the tokenizer's
#: pattern takes it. No match of that pattern reaches over a word's ends, so words encode on their own.
_PIECE = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

#: Words of a block, about; a longer text still goes in as one.
BLOCK_WORDS = 1 << 21
#: Ranges that an owner's words are parted into; it holds the distinct words of one range at a time.
RANGES = 16


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@cache
def token_table(path: str) -> pa.BinaryArray:
    """The token-byte table: a row for each id, with its bytes."""
    out: list[bytes] = [b""] * (max(ranks(path).values()) + 1)
    for token, i in ranks(path).items():
        out[i] = token
    return pa.array(out, pa.binary())


@cache
def decimal_table(n: int) -> pa.BinaryArray:
    return pa.array([b"%d," % i for i in range(n)], pa.binary())


def joined(ids: np.ndarray, table: pa.BinaryArray) -> bytes:
    """The table's bytes of all ids, in their order. Raises on an id that the table lacks."""
    rows = table.take(pa.array(ids.astype(np.int64)))
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset :][: len(rows) + 1]
    return rows.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(rows) else b""


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if packed[:1] == b"4" else "<u2", offset=1) if packed else np.zeros(0, "<u2")


def squeeze(*parts: np.ndarray | bytes) -> bytes:
    """Arrays or bytes, one after the other, compressed; spread() takes them apart again."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in parts]
    body = b"".join(raw)
    return struct.pack(f"<{len(raw) + 1}I", len(raw), *map(len, raw)) + pa.compress(body, codec="zstd", asbytes=True)


def spread(blob: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", blob)
    sizes = struct.unpack_from(f"<{n}I", blob, 4)
    body, at, out = pa.decompress(blob[4 + 4 * n :], sum(sizes), codec="zstd", asbytes=True), 0, []
    for size in sizes:
        out.append(body[at : at + size])
        at += size
    return out


class Block:
    """Some consecutive rows of a task: their words by position, and the distinct ones by owner.

    The distinct words are sorted by owner, then by word. Positions hold ranks by frequency, which
    compress well; ``order`` leads from a rank to the distinct word."""

    def __init__(self, owners: int, places: bool):
        self.owners, self.places = owners, places
        self.doc_ids: list[int | None] = []
        self.chars = 0
        self.index: dict[str, int] = {}
        self.at = array("I")
        self.sizes = array("I")

    def add(self, doc_id: int | None, text: str | None) -> None:
        """Only numbers are kept of a text, and each distinct word once."""
        pieces, index = _PIECE.findall(text or ""), self.index
        self.doc_ids.append(doc_id)
        self.chars += len(text or "")
        if self.places:
            self.at.extend([index.setdefault(w, len(index)) for w in pieces])
            self.sizes.append(len(pieces))
        else:
            index.update(dict.fromkeys(pieces, 0))

    def close(self) -> None:
        words = sorted(self.index)
        spread = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
        owner = spread % self.owners * RANGES + spread // self.owners % RANGES
        order = np.argsort(owner, kind="stable")
        self.words = [words[i] for i in order.tolist()]
        self.owner = owner[order]
        self.check = zlib.crc32("\0".join(self.words).encode())

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """Owner's range (its owner is that by RANGES) and squeezed words, for each range that has any."""
        cuts = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1], True]) if self.words else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            raw = [w.encode() for w in self.words[s:e]]
            yield int(self.owner[s]), squeeze(np.array(list(map(len, raw)), "<u4"), b"".join(raw))

    def positions(self) -> bytes:
        place = np.empty(len(self.words), "<u4")  # of the words as met, among the sorted
        place[np.fromiter(map(self.index.__getitem__, self.words), np.int64, len(self.words))] = np.arange(len(self.words))
        at = np.frombuffer(self.at, "<u4") if len(self.at) else np.zeros(0, "<u4")
        order = np.lexsort((place, -np.bincount(at, minlength=len(place))))  # equally frequent: as sorted
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        ranks = rank[at]
        planes = [((ranks >> np.uint32(8 * i)) & np.uint32(255)).astype(np.uint8) for i in range(3 if len(order) < 1 << 24 else 4)]
        return squeeze(np.array(self.sizes, "<u4"), np.diff(place[order].astype(np.int64), prepend=0).astype("<i4"), *planes)


def encode(docs: DataFrame, path: str = RANKS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, ids of every row: the packed ids (see unpack()) of the whole text.

    Words are exploded by block: a block's distinct words, each with the block's id, go to the words'
    owners, who take them range by range, encode each distinct word once and send its ids back to the
    blocks that have it; an owner holds one range's words at a time, and forgets none of them before all
    blocks that ask for it are served. The
    words' positions, as numbers, go to the same task as the ids and the texts' ids are put together by
    position. Distinct words are combined in each block before the shuffle, so a word that is
    everywhere moves once a block, and nothing is broadcast.

    Both sides of the exchange read the texts and number blocks alike, by partition and order, as they
    do from a stored table; a checksum of a block's words makes sure of it, and raises if an input
    without a stable order gives its rows differently.

    Null and empty texts have no ids. Repeated rows and null ids are encoded each on their own; an
    empty table gives an empty result; other columns are not read."""
    owners = partitions(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[tuple[int, Block]]:
        block, number = Block(owners, places), -1
        for b in batches:
            if number < 0 and b.num_rows:
                number = b.column("part")[0].as_py() << 32
            for i, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                block.add(i.as_py(), t.as_py())
                if block.chars >= 6 * block_words:
                    block.close()
                    yield number, block
                    block, number = Block(owners, places), number + 1
        if block.doc_ids:
            block.close()
            yield number, block

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches, False):
            sent = list(block.requests())
            yield pa.record_batch([pa.array([p for p, _ in sent], pa.int64()), pa.array([number] * len(sent), pa.int64()), pa.array([block.check] * len(sent), pa.int64()), pa.array([x for _, x in sent], pa.binary())], ["owner", "block", "check", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known, held = encoding(path), {}, -1
        size, form = (2, "H") if len(token_table(path)) <= 65536 else (4, "I")
        for b in batches:
            out = []
            for at, blob in zip(b.column("owner").to_pylist(), b.column("data"), strict=True):
                if at != held:  # sorted: the range before is done
                    known, held = {}, at
                sizes, raw = spread(blob.as_py())
                ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
                found = []
                for s, e in zip([0, *ends[:-1]], ends, strict=True):
                    if (ids := known.get(raw[s:e])) is None:
                        ids = bpe.encode_ordinary(raw[s:e].decode())
                        ids = known[raw[s:e]] = struct.pack(f"<{len(ids)}{form}", *ids)
                    found.append(ids)
                out.append(squeeze(np.array(list(map(len, found)), "<u4") // size, b"".join(found)))
            yield pa.record_batch([b.column("block"), b.column("owner"), b.column("check"), pa.array([None] * b.num_rows, pa.list_(pa.int64())), pa.array(out, pa.binary())], ["block", "owner", "check", "doc_ids", "data"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches, True):
            yield pa.record_batch([pa.array([number]), pa.array([1 << 40]), pa.array([block.check]), pa.array([block.doc_ids], pa.list_(pa.int64())), pa.array([block.positions()], pa.binary())], ["block", "owner", "check", "doc_ids", "data"])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        checks: set[tuple[int, int]] = set()
        for b in batches:
            for number, owner, check, doc_ids, data in ([x.as_py() for x in row] for row in zip(*b.columns, strict=True)):
                checks.add((number, check))
                if owner != 1 << 40:
                    n, ids = spread(data)
                    sizes.append(np.frombuffer(n, "<u4").astype(np.int64))
                    parts.append(np.frombuffer(ids, "<u4" if len(ids) == 4 * sizes[-1].sum() else "<u2").astype("<u4"))
                    continue
                if len(checks) > 1:
                    raise ValueError(f"block {number} was read differently")
                yield from rebuilt(doc_ids, spread(data), np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, "<u4"), *parts]))
                sizes, parts, checks = [], [], set()

    def rebuilt(doc_ids: list, data: list[bytes], size: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_words, order = np.frombuffer(data[0], "<u4").astype(np.int64), np.cumsum(np.frombuffer(data[1], "<i4"), dtype=np.int64)
        if len(order) != len(size):
            raise ValueError("a block's words and their ids differ in number")
        ranks = np.zeros(len(data[2]), "<u4")
        for i, x in enumerate(data[2:]):
            ranks |= np.frombuffer(x, np.uint8).astype("<u4") << np.uint32(8 * i)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        ends = np.cumsum(n_words)
        for s in range(0, len(doc_ids), 256):  # texts at a time
            e = min(len(doc_ids), s + 256)
            r = ranks[ends[s] - n_words[s] : ends[e - 1]]
            k = size[r]
            stop = np.cumsum(k)
            flat = ids[np.arange(int(k.sum())) + np.repeat(begin[r] - (stop - k), k)]
            at = np.r_[0, stop][np.cumsum(np.r_[0, n_words[s:e]])]
            out = [packed(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([pa.array(doc_ids[s:e], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"])

    read = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    kind = "block long, owner long, check long, doc_ids array<long>, data binary"
    asked = read.mapInArrow(ask, "owner long, block long, check long, data binary")
    answered = asked.repartition(owners, F.expr(f"owner div {RANGES}")).sortWithinPartitions("owner").mapInArrow(answer, kind)
    both = answered.unionByName(read.mapInArrow(place, kind))
    return both.repartition(owners, "block").sortWithinPartitions("block", "owner").mapInArrow(reassemble, "doc_id long, ids binary")


def packed(ids: bytes) -> bytes:
    """Little-endian 32-bit ids, in 16 bits where they fit; the first byte tells which."""
    if not ids:
        return b""
    x = np.frombuffer(ids, "<u4")
    return b"2" + x.astype("<u2").tobytes() if x.max() < 65536 else b"4" + ids


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, text_bytes: every id joined with its row of the token-byte table, in the ids' order.

    The table has a row for each id of the vocabulary, so every task has it whole. No ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [joined(unpack(x.as_py()), token_table(path)) for x in b.column("ids")]
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def digests(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: decodes the ids again and hashes both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimals = decimal_table(len(token_table(path)))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            out: list[list] = [[], [], []]
            for x in b.column("ids"):  # one text's at a time
                ids = unpack(x.as_py())
                for held, y in zip(out, (len(ids), sha(joined(ids, decimals)[:-1]), sha(joined(ids, token_table(path)))), strict=True):
                    held.append(y)
            yield pa.record_batch([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), b.column("ids")], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"))).drop("ids")
