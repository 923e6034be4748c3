"""JSON-line corpora as a Spark data source: in batch by byte ranges, as a stream in windows of so many documents.

    source.register(spark)
    spark.read.format("document_lines").option("path", folder).load()
    source.index(spark, folder, index)
    spark.readStream.format("document_lines").options(path=folder, index=index, docsPerWindow=1000, checkpoint=state).load()

Offsets of the stream count documents. An index, made by a Spark job, says how many documents each byte range holds, so the
driver plans a window from counts and tasks read the bytes. Documents are in order of file name, then of place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "document_lines"
DOCUMENT = "doc_id string, title string, text string"
RANGE = "file string, start long, end long, docs long"
#: Bytes of a range, read at a time, and documents of a batch.
CHUNK, PIECE, ROWS = 32 << 20, 1 << 20, 1000
#: Fixed names under which corpora give an id.
IDS = ("_id", "id", "doc_id")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """A path with or without scheme, and what of it a file system understands."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files of a folder and the folders in it, or one file, by name; hidden ones and markers are left out."""
    system, at = _at(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    root = at.rstrip("/") + "/"
    hidden = lambda p: any(x[:1] in "._" for x in p.removeprefix(root).split("/"))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(endings) and (x is info or not hidden(x.path)))


def lines(path: str, file: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin at ``start`` or later and before ``end``, without blank ones. A gzipped file is one range."""
    system, _ = _at(path)
    if file.endswith(".gz"):
        with system.open_input_stream(file, compression="gzip") as f:
            yield from _cut(f, -1)
        return
    with system.open_input_file(file) as f:
        if start:  # the line that the byte before belongs to is another range's
            f.seek(start - 1)
            while (piece := f.read(PIECE)) and b"\n" not in piece:
                start += len(piece)
            if not piece:
                return
            start += piece.index(b"\n")
            if start >= end:
                return
        f.seek(start)
        yield from _cut(f, end - start)


def _cut(f, length: int) -> Iterator[bytes]:
    """Lines that begin within ``length`` bytes; all of them if that is negative."""
    held, at = b"", 0  # ``at``: where ``held`` begins
    while piece := f.read(PIECE):
        *whole, held_next = (held + piece).split(b"\n")
        for line in whole:
            if 0 <= length <= at:
                return
            at += len(line) + 1
            if not line.isspace() and line:
                yield line
        held = held_next
    if held and not held.isspace() and not 0 <= length <= at:
        yield held


@dataclass
class Range(InputPartition):
    """Documents ``skip`` to ``skip + take`` of a file's byte range; ``take`` none: all."""

    file: str
    start: int
    end: int
    skip: int = 0
    take: int | None = None


def _documents(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    ids, titles, texts = [], [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, titles, texts)], names=["doc_id", "title", "text"])

    for n, line in enumerate(lines(path, part.file, part.start, part.end)):
        if n < part.skip:
            continue
        if part.take is not None and n >= part.skip + part.take:
            break
        row = json.loads(line)
        name = next((row[k] for k in IDS if row.get(k) is not None), None)
        if name is None or not str(name).strip():
            raise ValueError(f"{part.file}: a document without id: {line[:80]!r}")
        ids.append(str(name))
        titles.append(str(row.get("title") or ""))
        texts.append(str(row.get("text") or ""))
        if len(ids) >= ROWS:
            yield batch()
            ids, titles, texts = [], [], []
    if ids:
        yield batch()


class _Reader(DataSourceReader):
    """Documents, or with ``count`` how many each range has."""

    def __init__(self, options: dict[str, str], count: bool):
        self.path, self.count = options["path"], count
        self.chunk = int(options.get("chunkbytes") or CHUNK)
        self.endings = tuple((options.get("endings") or ".jsonl,.json,.gz").split(","))

    def partitions(self) -> list[Range]:
        cut = lambda file, size: [(0, size)] if file.endswith(".gz") else [(a, min(a + self.chunk, size)) for a in range(0, size, self.chunk)]
        return [Range(file, a, b) for file, size in _files(self.path, self.endings) for a, b in cut(file, size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        if not self.count:
            yield from _documents(self.path, partition)
            return
        n = sum(1 for _ in lines(self.path, partition.file, partition.start, partition.end))
        yield pa.RecordBatch.from_arrays([pa.array([partition.file]), *[pa.array([x], pa.int64()) for x in (partition.start, partition.end, n)]], names=["file", "start", "end", "docs"])


class _Windows(DataSourceStreamReader):
    """Windows of ``docsPerWindow`` documents. A run makes at most ``windows`` of them, if that is set.

    Where the stream stands is what ``checkpoint``, the query's checkpoint folder, has logged last: this version of Spark does not
    tell a source where it was.
    """

    def __init__(self, options: dict[str, str]):
        import pyarrow.parquet as pq

        self.path, self.size = options["path"], int(options["docsperwindow"])
        if self.size < 1:
            raise ValueError("docsPerWindow must be a positive whole number")
        system, at = _at(options["index"])
        table = pq.read_table(at, filesystem=system).sort_by([("file", "ascending"), ("start", "ascending")])
        self.ranges = list(zip(*[table.column(x).to_pylist() for x in ("file", "start", "end", "docs")], strict=True))
        self.total = sum(r[3] for r in self.ranges)
        self.at = self._logged(options["checkpoint"])
        self.last = min(self.total, self.at + self.size * int(options["windows"])) if options.get("windows") else self.total

    @staticmethod
    def _logged(checkpoint: str) -> int:
        system, at = _at(checkpoint)
        found = system.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/offsets", allow_not_found=True))
        logs = [x.path for x in found if x.base_name.isdigit()]
        if not logs:
            return 0
        with system.open_input_stream(max(logs, key=lambda p: int(p.rpartition("/")[2]))) as f:
            return int(json.loads(f.read().decode().splitlines()[-1])["docs"])

    def initialOffset(self) -> dict:
        return {"docs": 0}

    def latestOffset(self) -> dict:
        return {"docs": max(self.at, min(self.at + self.size, self.last))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        first, last, before, out = start["docs"], end["docs"], 0, []
        for file, a, b, docs in self.ranges:
            skip, upto = max(first - before, 0), min(last - before, docs)
            if skip < upto:
                out.append(Range(file, a, b, skip, upto - skip))
            before += docs
        self.at = max(self.at, last)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _documents(self.path, partition)


class DocumentLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return RANGE if self._options().get("count") == "true" else DOCUMENT

    def reader(self, schema) -> _Reader:
        return _Reader(self._options(), self._options().get("count") == "true")

    def streamReader(self, schema) -> _Windows:
        return _Windows(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentLines)


def documents(spark: SparkSession, path: str, **options) -> DataFrame:
    """doc_id, title and text of JSON lines in a folder or file: a task for each byte range. Ids may stand under IDS.

    Files end in .jsonl, .json or .gz (option ``endings``); blank lines are skipped, a line without id is an error. Paths are opened by
    the workers themselves: local and shared folders and the stores that Arrow knows. No files, no rows.
    """
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()


def index(spark: SparkSession, path: str, out: str, **options) -> DataFrame:
    """Counts the documents of each byte range, writes the counts to ``out`` and returns them. Made once for a corpus that does not change."""
    register(spark)
    spark.read.format(NAME).options(path=path, count="true", **options).load().coalesce(1).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def windows(spark: SparkSession, path: str, index: str, docs_per_window: int, checkpoint: str, limit: int | None = None) -> DataFrame:
    """The corpus as a stream in windows; start it with the same ``checkpoint``. ``limit``: windows that one run may make."""
    register(spark)
    stream = spark.readStream.format(NAME).options(path=path, index=index, docsPerWindow=docs_per_window, checkpoint=checkpoint)
    return (stream.option("windows", limit) if limit else stream).load()
