"""Spark data source ``webp``: folders of images by file, chunk or animation frame, and back into files.

    datasource.register(spark)
    spark.read.format("webp").option("rows", "chunk").load("hdfs:///images")
    files.select("name", "content").write.format("webp").mode("append").save("hdfs:///out")"""

from __future__ import annotations

import io
import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from mosaiq.codec import WebpError, riff

SCHEMAS = {
    "file": "path string, size long, kind string, width int, height int, has_alpha boolean, has_animation boolean, content binary, error string",
    "chunk": "path string, chunk_idx int, four_cc string, size long, offset long, data binary, error string",
    "frame": "path string, frame_idx int, x int, y int, width int, height int, duration_ms int, blend string, dispose string, data binary, error string",
}
#: Bytes of files that one task reads, about, and what opening a file counts for.
SPLIT_BYTES, OPEN_BYTES = 128 << 20, 1 << 20
KINDS = {"VP8X": "extended", "VP8L": "lossless", "VP8 ": "lossy"}
#: Files that the driver names one by one; of folders beyond that, tasks list what they read themselves.
MANY = 100_000
#: Bytes of a chunk's payload that tell an image's facts.
FACTS = 16

_COMPARED = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


@dataclass
class Split(InputPartition):
    """Files, or the files of a folder whose path's hash falls to one of ``parts``."""

    files: list[tuple[str, int]]
    folder: str = ""
    part: int = 0
    parts: int = 1


def bucket(name: str, of: int) -> int:
    return zlib.crc32(name.encode()) % of


def meets(value: object, conditions: list[tuple[str, object]]) -> bool:
    """Whether a value meets all conditions; null meets none."""
    return all(value is not None and (value in x if how == "in" else getattr(value, how)(x) is True) for how, x in conditions)


def heads(file: io.IOBase, size: int) -> list[riff.Chunk]:
    """All chunks of a file with their first FACTS bytes, by seeking from header to header."""
    first = file.read(12)
    if len(first) < 12 or first[:4] != b"RIFF" or first[8:] != b"WEBP":
        raise WebpError("not a RIFF file of type WEBP")
    out, at = [], 12
    while at + 8 <= size:
        file.seek(at)
        head = file.read(8 + FACTS)
        (length,) = struct.unpack_from("<I", head, 4)
        out.append(riff.Chunk(head[:4].decode("latin-1"), length, at + 8, memoryview(head)[8 : 8 + length]))
        at += 8 + length + length % 2
    return out


class WebpReader(DataSourceReader):
    """Conditions on size are answered from the listing, those on kind (of rows by file) from the headers, before
    a file's content is read. A file that can't be parsed gives one row with its error."""

    def __init__(self, options: dict[str, str], rows: str, schema: StructType):
        if "path" not in options:
            raise ValueError("the source webp needs a path")
        self.path, self.rows, self.schema = options["path"], rows, schema
        self.pattern = options.get("pattern", "*.webp")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.content = options.get("content", "true").lower() == "true"
        self.sizes: list[tuple[str, object]] = []
        self.kinds: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            how = "in" if isinstance(f, In) else _COMPARED.get(type(f))
            column = getattr(f, "attribute", None)
            value = f.value if hasattr(f, "value") and how else None
            if self.rows == "file" and how and column == ("size",):
                self.sizes.append((how, value))
            elif self.rows == "file" and how and column == ("kind",) and isinstance(f, (EqualTo, In)):
                self.kinds.append((how, value))
            else:
                yield f

    def partitions(self) -> list[Split]:
        """Files in the order of their paths, dealt to tasks by size; none of a hidden folder or name. Folders are listed one at a time;
        once MANY files are named, those of a further folder are only counted, and each of its tasks takes its share of them."""
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        files: list[tuple[str, int]] = []
        shares: list[Split] = []
        folders = [at]
        while folders:
            folder = folders.pop()
            inner, own = self.listed(fs, folder)
            folders += inner
            if len(files) + len(own) <= MANY:
                files += own
            elif own:
                parts = math.ceil(sum(size + OPEN_BYTES for _, size in own) / self.split)
                shares += [Split([], folder, k, parts) for k in range(parts)]
        out, held = [], 0
        for path, size in sorted(files):
            cost = size + OPEN_BYTES
            if not out or held + cost > self.split:
                out.append(Split([]))
                held = 0
            out[-1].files.append((path, size))
            held += cost
        return out + shares or [Split([])]

    def listed(self, fs: pyarrow.fs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """A folder's folders, and its files that are asked for with their sizes."""
        found = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)) if x.base_name[:1] not in (".", "_")]
        files = [(x.path, x.size) for x in found if x.is_file and fnmatch(x.base_name, self.pattern) and meets(x.size, self.sizes)]
        return sorted(x.path for x in found if x.type == pyarrow.fs.FileType.Directory), files

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in self.schema.fields])
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        files = split.files
        if split.folder:
            files = sorted(f for f in self.listed(fs, split.folder)[1] if bucket(f[0], split.parts) == split.part)
        for path, size in files:
            try:
                rows = list(getattr(self, self.rows)(fs, path, size))
            except (WebpError, struct.error) as e:
                rows = [] if self.kinds else [{"size": size, "error": str(e)}] if self.rows == "file" else [{"error": str(e)}]
            if rows:
                yield pa.RecordBatch.from_pylist([{n: {"path": path, **r}.get(n) for n in names} for r in rows], schema=schema)

    def file(self, fs: pyarrow.fs.FileSystem, path: str, size: int) -> Iterator[dict]:
        with fs.open_input_file(path) as f:
            chunks = heads(f, size)
            kind = next((name for c, name in KINDS.items() if any(x.four_cc == c for x in chunks)), None)
            if not meets(kind, self.kinds):
                return
            i = riff.image_info(chunks)
            content = None
            if self.content:
                f.seek(0)
                content = f.read()
        yield {"size": size, "kind": kind, "width": i.width, "height": i.height, "has_alpha": i.has_alpha, "has_animation": i.has_animation, "content": content}

    def chunk(self, fs: pyarrow.fs.FileSystem, path: str, size: int) -> Iterator[dict]:
        with fs.open_input_file(path) as f:
            content = f.read()
        for k, c in enumerate(riff.parse_riff(content)):
            yield {"chunk_idx": k, "four_cc": c.four_cc, "size": c.size, "offset": c.offset, "data": bytes(c.data)}

    def frame(self, fs: pyarrow.fs.FileSystem, path: str, size: int) -> Iterator[dict]:
        with fs.open_input_file(path) as f:
            content = f.read()
        for k, x in enumerate(riff.parse_animation(content).frames):
            data = riff.build_riff([(c.four_cc, bytes(c.data)) for c in x.chunks])  # a file of its own
            yield {"frame_idx": k, "x": x.x, "y": x.y, "width": x.width, "height": x.height, "duration_ms": x.duration_ms, "blend": x.blend, "dispose": x.dispose, "data": data}


@dataclass
class Placed(WriterCommitMessage):
    folder: str


class WebpWriter(DataSourceWriter):
    """Rows (name, content) as files. Each task fills a folder of its own beside the result; the driver moves the
    files of the tasks that count when all have ended, so tasks may fail and run again, and an aborted job
    leaves nothing. Null names or contents raise; of equal names one file stays. With ``folders`` over 1, files lie in so many folders by
    their names' hash, so that no listing holds them all; the driver lists one task's share of one folder at a time."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, folders: int = 1):
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("the source webp writes the columns name and content")
        self.path, self.overwrite, self.folders, self.job = path, overwrite, folders, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows) -> Placed:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        own = f"{at}/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(own, recursive=True)
        made = set()
        for r in rows:
            if r["name"] is None or r["content"] is None or "/" in r["name"]:
                raise ValueError(f"no file can be made of the row named {r['name']!r}")
            to = own
            if self.folders > 1:
                to = f"{own}/{bucket(r['name'], self.folders):05d}"
                if to not in made:
                    fs.create_dir(to)
                    made.add(to)
            with fs.open_output_stream(f"{to}/{r['name']}") as f:
                f.write(r["content"])
        return Placed(own)

    def commit(self, messages: list[Placed | None]) -> None:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for x in fs.get_file_info(pyarrow.fs.FileSelector(at)):
                if x.base_name != self.job:
                    (fs.delete_file if x.is_file else fs.delete_dir)(x.path)
        made = set()
        for m in messages:
            for x in fs.get_file_info(pyarrow.fs.FileSelector(m.folder)) if m else ():
                if x.is_file:
                    fs.move(x.path, f"{at}/{x.base_name}")
                    continue
                if x.base_name not in made:
                    fs.create_dir(f"{at}/{x.base_name}")
                    made.add(x.base_name)
                for y in fs.get_file_info(pyarrow.fs.FileSelector(x.path)):
                    fs.move(y.path, f"{at}/{x.base_name}/{y.base_name}")
        self.abort(messages)

    def abort(self, messages: list[Placed | None]) -> None:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{at}/{self.job}")


class WebpSource(DataSource):
    """Options: rows (file, chunk, frame), pattern, splitBytes, content (false: not read, null); for writing, folders."""

    @classmethod
    def name(cls) -> str:
        return "webp"

    def _rows(self) -> str:
        rows = self.options.get("rows", "file")
        if rows not in SCHEMAS:
            raise ValueError(f"rows of the source webp are {', '.join(SCHEMAS)}")
        return rows

    def schema(self) -> str:
        return SCHEMAS[self._rows()]

    def reader(self, schema: StructType) -> WebpReader:
        return WebpReader(self.options, self._rows(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WebpWriter:
        return WebpWriter(self.options["path"], schema, overwrite, int(self.options.get("folders", 1)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebpSource)
