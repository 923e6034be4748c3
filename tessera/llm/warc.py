"""Operator 4: WARC archives and their merged external index.

Pages become WARC 1.1 records, one archive per task, sorted by URL key and time within it. Reading the
archives back yields one locally sorted run of captures each. Runs are cut at common key bounds; each
range is then merged by a loser tree over its runs, so the ranges in order hold every URL's captures in
order of time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Payload bytes in one archive before compression, about, and captures in one merged range, about.
ARCHIVE_BYTES, RANGE_CAPTURES = 16 << 20, 50_000

CAPTURES = (
    "urlkey string, timestamp string, url string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "archive string, offset long, length long"
)

READ = CAPTURES.removeprefix("urlkey string, ")

#: Seconds since 1970 of the first and last moment that four digits for the year can name.
FIRST, LAST = -62_135_596_800, 253_402_300_799

#: Of RFC 4648.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Five hex digits at a time are four digits of base 32."""
    x = F.sha1(payload)
    return F.translate(F.upper(F.concat(*[F.lpad(F.conv(F.substring(x, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])), _DIGITS, _BASE32)


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query, lower case, without scheme, www, port or fragment."""
    u = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", ""))
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^([^/?]*)", 1), r":\d*$", ""), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(u, r"^[^/?]*(.*)$", 1))


def _clean(x: Column) -> Column:
    """A header value stays on its line."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " ")


def with_originals(pages: DataFrame, id_col: str, digest: Column, size: Column, dedup_from: int) -> DataFrame:
    """id, digest and size per page, and which page holds the payload: the largest id among equal payloads.

    Grouping and joining run over digests alone; the largest id is aggregated before the shuffle, and written, so that
    Spark can split the join where one payload has very many pages.
    """
    keys = pages.select(F.col(id_col).alias("page_id"), digest.alias("payload_digest"), size.alias("payload_bytes"))
    last = keys.filter(F.col("payload_bytes") >= dedup_from).groupBy("payload_digest").agg(F.max("page_id").alias("_last"))
    last = Scratch(pages.sparkSession, "originals").table(last, "last")
    return keys.join(last, "payload_digest", "left").withColumn("refers_to", F.when(F.col("_last") != F.col("page_id"), F.col("_last"))).drop("_last")


def warc_date(seconds: Column) -> Column:
    """Seconds since 1970 as a date in UTC, whatever the session's time zone."""
    day, rest = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3600), two(rest % 3600 / 60), two(rest % 60))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), clock, F.lit("Z"))


def record_text(url: Column, seconds: Column) -> Column:
    """The record up to, and without, the two line ends that close it."""
    n = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("_payload"))).otherwise(http)
    uuid = lambda x: F.regexp_replace(F.substring(F.sha2(F.concat(F.lit("page:"), F.coalesce(x.cast("string"), F.lit(""))), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"),
        uuid(F.col("page_id")),
        F.lit(">\r\nWARC-Date: "),
        warc_date(seconds),
        F.lit("\r\nWARC-Target-URI: "),
        _clean(url),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit("\r\nX-Page-Id: "),
        page,
        F.when(
            F.col("refers_to").isNotNull(),
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:uuid:"),
                uuid(F.col("refers_to")),
                F.lit(">\r\nX-Refers-To-Page: "),
                F.col("refers_to").cast("string"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    ]
    return F.concat(*head)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, dedup_from: int = 0) -> None:
    """Writes ``pages`` as gzipped WARC archives, through Spark's own file commit.

    Null payloads are empty and null urls blank. Without ``time_col`` the id counts as seconds since 1970, in UTC, none
    as 0; times before the year 1 or after 9999 are held at those ends. Rows that
    share an id and a payload are written alike; extra columns are not written. An empty table leaves an
    empty folder.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    facts = with_originals(pages, id_col, base32_sha1(payload), F.octet_length(payload).cast("long"), dedup_from).distinct()
    when = F.unix_seconds(F.col(time_col)) if time_col else F.col(id_col).cast("long")
    when = F.greatest(F.least(F.coalesce(when, F.lit(0)), F.lit(LAST)), F.lit(FIRST))
    full = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"), when.alias("_when"), url_key(F.col(url_col)).alias("_key"))
    size, n = pages.agg(F.sum(F.octet_length(payload) + 600), F.count(F.lit(1))).first()
    made = full.withColumn("_digest", base32_sha1(F.col("_payload"))).join(facts, F.col("_id").eqNullSafe(F.col("page_id")) & (F.col("_digest") == F.col("payload_digest")))
    # the join has dealt the pages by id already; each of its tasks sorts what it has and starts a new archive at need
    made = made.sortWithinPartitions("_key", "_when", "_id")
    most = max(1, ARCHIVE_BYTES * n // size) if n else 1
    made.select(record_text(F.col("_url"), F.col("_when")).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _headers(block: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, _, v in (x.partition(b": ") for x in block.split(b"\r\n")[1:])}


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of each record, by the lengths that the headers state."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = _headers(data[at:end])
        stop = end + 4 + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield head, data[end + 4 : stop], at, stop + 4 - at
        at = stop + 4


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in map(str.split, READ.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, data = [], content.as_py()
            for head, block, at, size in records(gzip.decompress(data)):
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = head["warc-payload-digest"].removeprefix("sha1:")
                revisit = head["warc-type"] == "revisit"
                n = int(_headers(http)["content-length"])
                if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated):
                    raise ValueError(f"{path}: the payload at {at} is not what its record states")
                time = "".join(c for c in head["warc-date"] if c.isdigit())
                page = head["x-page-id"]
                rows.append((time, head["warc-target-uri"], int(page) if page else None, head["warc-type"], int(head["x-refers-to-page"]) if revisit else None, stated, n, path, at, size))
            # Arrow, not pandas: an id beside a missing one would go through a float there
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record; an archive is one run, ``offset`` and ``length`` a place in its unpacked bytes. Lengths and digests are checked."""
    # a batch holds the archives that Arrow takes together; each is read on its own, so memory is bounded by the batch
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_captures, READ).withColumn("urlkey", url_key(F.col("url"))).select(*[x.split()[0] for x in CAPTURES.split(", ")])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _replay(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at:
            other = self.losers[at]
            if other < 0:  # the first to come waits for its opponent
                self.losers[at] = winner
                return
            if self._beats(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [b for b in batches if len(b)]  # one range: RANGE_CAPTURES rows, about
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    url, time, page, archive = (table.column(c).to_pylist() for c in ("urlkey", "timestamp", "page_id", "archive"))
    keys = [(u, t, p is not None, p or 0, i) for i, (u, t, p) in enumerate(zip(url, time, page, strict=True))]  # no id comes first
    runs: dict[str, list[tuple]] = {}
    for key, own in zip(keys, archive, strict=True):
        runs.setdefault(own, []).append(key)
    yield from table.take([k[-1] for k in LoserTree([iter(runs[a]) for a in sorted(runs)])]).to_batches()


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures, globally ordered: by partition, then by row within it.

    Range bounds cover key, time and page, so captures of one hot URL spread over ranges. Within a range each
    run arrives in its own order and the loser tree merges them.
    """
    columns = [x.split()[0] for x in CAPTURES.split(", ")]
    n = max(1, -(-captures.count() // RANGE_CAPTURES))
    ranged = captures.select(*columns).repartitionByRange(n, "urlkey", "timestamp", F.col("page_id").asc_nulls_first()).sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(_merge, CAPTURES)


def op4_query(spark, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), tmp.path("archives"))
    captures = tmp.table(read_archives(spark, tmp.path("archives")), "runs")
    return merge_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")
