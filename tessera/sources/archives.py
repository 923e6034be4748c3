"""Tar archives as tables: members read as a stream, their JSON elements or lines as rows.

An archive is read by Spark's text reader as raw bytes between occurrences of one byte, which unpacks gzip, opens any
store that Spark opens, and hands an archive's bytes to one task in order. The task walks the members as they come by and
keeps an element or line at a time, so neither an archive's nor a member's size bounds memory.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes taken from a member at a time, rows in a batch that is passed on, and the characters of values in it, about.
PIECE, ROWS, CHARS = 1 << 20, 1000, 4 << 20

MEMBER = "archive long, member string, at long, key string, value string"


class _Stream(io.RawIOBase):
    """One archive's bytes, read on from batches of (archive, bytes up to a separator)."""

    def __init__(self, batches: Iterator[pa.RecordBatch], sep: bytes):
        self.batches, self.sep, self.held, self.at = batches, sep, b"", 0
        self.archive: int | None = None
        self.next: tuple[int, list[bytes]] | None = None
        self.runs: Iterator[tuple[int, list[bytes]]] = self._runs()

    def _runs(self) -> Iterator[tuple[int, list[bytes]]]:
        for batch in self.batches:
            which = batch.column(0).to_numpy()
            start = 0
            while start < len(which):
                end = start + int((which[start:] == which[start]).argmin() or len(which) - start)
                yield int(which[start]), batch.column(1).slice(start, end - start).to_pylist()
                start = end

    def open_next(self) -> bool:
        """Goes to the next archive, over what is left of this one."""
        while self.archive is not None and self._more():
            pass
        self.next = self.next or next(self.runs, None)
        if self.next is None:
            return False
        self.archive, self.held, self.at = self.next[0], b"", 0
        return True

    def _more(self) -> bool:
        self.next = self.next or next(self.runs, None)
        if self.next is None or self.next[0] != self.archive:
            return False
        self.held, self.at, self.next = self.sep.join(self.next[1]) + self.sep, 0, None
        return True

    def read(self, size: int = -1) -> bytes:
        out, need = [], size
        while need and (self.at < len(self.held) or self._more()):
            part = self.held[self.at : self.at + need] if size >= 0 else self.held[self.at :]
            self.at += len(part)
            need -= len(part) if size >= 0 else 0
            out.append(part)
        return b"".join(out)


class Elements:
    """The elements of a JSON array or the entries of a JSON object, from pieces of its text cut anywhere.

    ``feed`` gives (key, JSON text) of those that are complete; the key is null in an array.
    """

    _SIGNS = re.compile(rb'["\\\[\]{},]')

    def __init__(self):
        self.held, self.depth, self.quoted, self.skip, self.keyed = bytearray(), 0, False, -1, False

    def feed(self, piece: bytes) -> Iterator[tuple[str | None, str]]:
        begun, self.skip = len(self.held), self.skip + len(self.held) if self.skip >= 0 else -1
        self.held += piece
        start, text = 0, bytes(self.held)
        for found in self._SIGNS.finditer(text, begun):
            at, sign = found.start(), found.group()
            if at == self.skip:
                continue
            if self.quoted:
                if sign == b"\\":
                    self.skip = at + 1
                elif sign == b'"':
                    self.quoted = False
            elif sign == b'"':
                self.quoted = True
            elif sign in b"[{":
                self.depth += 1
                if self.depth == 1:
                    start, self.keyed = at + 1, sign == b"{"
            elif sign == b"," and self.depth == 1:
                yield self._entry(text[start:at])
                start = at + 1
            elif sign in b"]}":
                self.depth -= 1
                if self.depth == 0:
                    if text[start:at].strip():
                        yield self._entry(text[start:at])
                    start = at + 1
        self.skip = 0 if self.skip == len(text) else -1  # of the next piece: a backslash ended this one
        if start:
            del self.held[:start]

    def _entry(self, raw: bytes) -> tuple[str | None, str]:
        text = raw.decode("utf-8", "replace").strip()
        if not self.keyed:
            return None, text
        key, end = json.JSONDecoder().raw_decode(text)
        return key, text[end:].lstrip().removeprefix(":").lstrip()

    def close(self) -> None:
        if self.depth or self.quoted:
            raise ValueError("the JSON text ends within an element")


class Lines:
    def __init__(self):
        self.held = b""

    def feed(self, piece: bytes) -> Iterator[tuple[None, str]]:
        *whole, self.held = (self.held + piece).split(b"\n")
        for line in whole:
            yield None, line.decode("utf-8", "replace")

    def close(self) -> Iterator[tuple[None, str]]:
        if self.held:
            yield None, self.held.decode("utf-8", "replace")


DECODERS = {"json": Elements, "lines": Lines}


def _walk(pattern: str, kind: str, sep: bytes):
    def rows(stream: _Stream) -> Iterator[tuple]:
        while stream.open_next():
            with tarfile.open(fileobj=stream, mode="r|") as tar:
                for info in tar:
                    tar.members.clear()  # a stream is not looked through again
                    if not info.isfile() or not fnmatch.fnmatchcase(info.name, pattern):
                        continue
                    file, decoder, at = tar.extractfile(info), DECODERS[kind](), 0
                    while piece := file.read(PIECE):
                        for key, value in decoder.feed(piece):
                            yield stream.archive, info.name, at, key, value
                            at += 1
                    for key, value in decoder.close() or ():
                        yield stream.archive, info.name, at, key, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in MEMBER.split(", ")]
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        held, size = [], 0
        for row in rows(_Stream(batches, sep)):
            held.append(row)
            size += len(row[4])
            if len(held) >= ROWS or size >= CHARS:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return run


def members(spark: SparkSession, path: str, pattern: str = "*", kind: str = "json", sep: str | None = None) -> DataFrame:
    """(archive, member, at, key, value): the elements of the members whose name matches ``pattern``, numbered from 0.

    ``path`` is a folder, file or glob of tar archives, gzipped (their names end in .gz: so Spark never cuts one in two).
    With ``kind`` json a member holds one JSON array or object, and a row is an element with its key, as JSON text; with lines it
    is a line. Bytes are handed on at ``sep``, one ASCII sign (closing braces and line ends by default): memory grows with
    the longest stretch without it, and with the longest element. A damaged archive or text is an error. Members of one name are told apart by
    their archive only. A folder without archives gives no rows.
    """
    if kind not in DECODERS:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(DECODERS)}")
    sep = sep or {"json": "}", "lines": "\n"}[kind]
    if len(sep) != 1 or not sep.isascii():
        raise ValueError("sep must be one ASCII sign")
    key = F.xxhash64(F.col("_metadata.file_path"))
    source = spark.read.option("lineSep", sep).option("pathGlobFilter", "*.gz").text(path)
    found = source.select(key.alias("archive"), F.col("value").cast("binary").alias("value")).mapInArrow(_walk(pattern, kind, sep.encode()), MEMBER)
    # paths apart from bytes: one row a file, not one a stretch; a listing, whose contents are not read
    named = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(key.alias("archive"), F.col("_metadata.file_path").alias("path"))
    return found.join(named, "archive").select(F.col("path").alias("archive"), "member", "at", "key", "value")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = (content or "").encode()
            if len(data) % 512 == 0:
                data += b"\n"  # so that there is padding: its last byte is the separator of rows
            info = tarfile.TarInfo(name)
            info.size = len(data)
            whole = info.tobuf(tarfile.PAX_FORMAT, "utf-8", "strict") + data + b"\0" * (-len(data) % 512 - 1)
            yield pa.RecordBatch.from_arrays([pa.array([whole.decode()])], names=["value"])


def write_archives(rows: DataFrame, path: str) -> None:
    """Writes (name, content) as members of gzipped tar archives, one archive a task, by Spark's own file commit.

    Contents are texts; one of a multiple of 512 bytes (the empty one too) gets a line end more, which JSON and lines do
    not mind. A null content is empty. Rows of one name are members of one name.
    """
    rows.select("name", "content").mapInArrow(_packed, "value string").write.option("lineSep", "\0").option("compression", "gzip").mode("overwrite").text(path)
