"""Documents to sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions import text as T
from tessera.sources.shared import scratch


def with_sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One array column more: a row stays one document, so everything after needs no shuffle."""
    return docs.withColumn("sentences", T.sentences(F.col(text_col)))


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_idx, sentence): numbered from 0 over the sentences that are not blank."""
    return docs.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("sentence_idx", "sentence"))


def sentence_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_idx, char_start, char_end) of the unstripped sentences; blank ones are left out."""
    rows = docs.select(id_col, F.posexplode(T.pieces(F.col(text_col))).alias("at", "p")).select(id_col, "at", F.length("p.piece").alias("n"), F.col("p.size").alias("size"), (T.strip(F.col("p.piece")) != "").alias("full"))
    run = Window.partitionBy(id_col).orderBy("at")
    placed = rows.withColumns(
        {"char_start": F.sum("size").over(run) - F.col("size"), "sentence_idx": F.sum(F.col("full").cast("int")).over(run).cast("int") - 1}
    ).filter("full")
    return placed.select(id_col, "sentence_idx", "char_start", (F.col("char_start") + F.col("n")).alias("char_end"))


#: Characters of a text that an offset splitter gets at a time, and at most.
AT_ONCE, MOST = 100_000, 1_000_000


def spans(text: str, cut: Callable[[str], Iterable[tuple[int, int]]], at_once: int = AT_ONCE, most: int = MOST) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences that ``cut`` finds in pieces of a text.

    A piece's last sentence may go on, so the next piece begins with it. Where a sentence fills a piece the piece is made
    longer, up to ``most`` characters; a longer sentence is cut at its last blank there.
    """
    at, size = 0, at_once
    while at < len(text):
        piece = text[at : at + size]
        found = list(cut(piece))
        if at + size >= len(text):
            yield from ((at + a, at + b) for a, b in found)
            return
        if len(found) > 1:
            yield from ((at + a, at + b) for a, b in found[:-1])
            at, size = at + found[-1][0], at_once
        elif size < most:
            size = min(2 * size, most)
        else:
            blank = max((m.start() for m in re.finditer(r"\s", piece[1:])), default=len(piece) - 1) + 1
            yield from ((at + a, at + min(b, blank)) for a, b in found if a < blank)
            at, size = at + blank, at_once


def rule_spans(text: str) -> Iterator[tuple[int, int]]:
    """Where ``functions.text.sentences`` cuts, sentence by sentence, white space at the ends included; blank ones are left out."""
    start = 0
    for m in re.finditer(T.ENDS, text):
        if text[start : m.start()].strip():
            yield start, m.start()
        start = m.end()
    if text[start:].strip():
        yield start, len(text)


def split_by(docs: DataFrame, make: Callable[[], Callable[[str], Iterable[tuple[int, int]]]], id_col: str = "doc_id", text_col: str = "text", at_once: int = AT_ONCE) -> DataFrame:
    """(id, sentence_idx, text, char_start, char_end) by a splitter of one's own; ``text`` is stripped.

    ``make`` is called once a task and gives a function from a text to its sentences' (start, end), in order; long texts reach it
    in pieces. Ids may be of any type; a null or blank text has no sentences.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = make()
        for batch in batches:
            for at in range(len(batch)):
                text = batch.column(1)[at].as_py() or ""
                found = [(i, text[a:b].strip(), a, b) for i, (a, b) in enumerate(spans(text, cut, at_once))]
                if found:
                    columns = zip(*found, strict=True)
                    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                    own = batch.column(0).take(pa.array([at] * len(found)))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], names=["_id", "sentence_idx", "text", "char_start", "char_end"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, sentence_idx int, text string, char_start long, char_end long").withColumnRenamed("_id", id_col)


def with_running_starts(rows: DataFrame, counts: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """Adds, under each name, how much its count sums to over all rows before, in order of id; no id comes first.

    Ids may be of any type that sorts, sparse, null or repeated; rows of one id follow each other in some order. Rows are dealt
    to ranges of ids, a hot id over several, and written sorted, each with the sums of its range before it; a window runs
    over the ranges' sums alone. So rows are shuffled once, and not again whenever the result is read.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_first(), F.col("_tie").asc()]
    names, columns = list(counts), rows.columns
    own = {f"_n{k}": F.coalesce(counts[n].cast("long"), F.lit(0)) for k, n in enumerate(names)}
    dealt = rows.withColumns(own | {"_tie": F.rand(7)}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = dealt.select(F.spark_partition_id().alias("_part"), *own, *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(columns)])
    width, added = len(own), [StructField(f"_o{k}", LongType()) for k in range(len(own))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * width
        for batch in batches:
            n = [batch.column(1 + k).to_numpy() for k in range(width)]
            before = [np.cumsum(x) - x + s for s, x in zip(sums, n, strict=True)]
            sums = [s + int(x.sum()) for s, x in zip(sums, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, before)], names=[*batch.schema.names, *[x.name for x in added]])

    path = scratch(spark, "numbers")
    numbered.mapInArrow(run, StructType([*numbered.schema.fields, *added])).write.parquet(path)
    written = spark.read.parquet(path)
    sums = written.groupBy("_part").agg(*[F.sum(n).alias(f"_s{k}") for k, n in enumerate(own)])  # a row for each range
    before = sums.select("_part", *[(F.sum(f"_s{k}").over(Window.orderBy("_part")) - F.col(f"_s{k}")).alias(f"_b{k}") for k in range(len(names))])
    placed = written.join(F.broadcast(before), "_part")
    return placed.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)], *[(F.col(f"_b{k}") + F.col(f"_o{k}")).alias(n) for k, n in enumerate(names)])


def with_running_start(rows: DataFrame, count: Column, id_col: str = "doc_id", out: str = "start") -> DataFrame:
    return with_running_starts(rows, {out: count}, id_col)


def unit_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 0) -> DataFrame:
    """(unit_id, id, sentence_idx): sentences numbered from ``first`` over the whole corpus in order of document id."""
    counts = docs.select(id_col, F.size(T.sentences(F.col(text_col))).alias("n"))
    starts = with_running_start(counts, F.col("n"), id_col)
    return starts.filter("n > 0").select(id_col, "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sentence_idx")).select(
        (F.col("start") + F.col("sentence_idx") + first).alias("unit_id"), id_col, "sentence_idx"
    )


def truncate_text(docs: DataFrame, limit: int = 900_000, text_col: str = "text") -> DataFrame:
    return docs.withColumn(text_col, F.substring(text_col, 1, limit))


def drop_blank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.filter(T.strip(F.coalesce(F.col(text_col), F.lit(""))) != "")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the payload of the last in ``order``, at the place of the first."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias(order))
    return found.select(*keys, order, *[F.col(f"_last.{c}").alias(c) for c in rest])


def unit_faults(units: DataFrame) -> DataFrame:
    """(fault, n): split units (doc_id, sentence_idx, text) that break a rule; no rows when all is well."""
    rules = {
        "doc_id is missing or blank": F.coalesce(F.trim(F.col("doc_id").cast("string")), F.lit("")) == "",
        "sentence_idx is missing or negative": F.coalesce(F.col("sentence_idx"), F.lit(-1)) < 0,
        "text is missing": F.col("text").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))
    return units.select(F.explode(found).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def valid_units(units: DataFrame) -> DataFrame:
    """``units`` if they keep the rules; else an error that names the broken ones. Only counts reach the driver."""
    if found := unit_faults(units).collect():  # three rows at most
        raise ValueError("; ".join(f"{r.fault}: {r.n}" for r in sorted(found)))
    return units


def first_documents(docs: DataFrame, limit: int, order: str = "doc_id") -> DataFrame:
    """The first ``limit`` rows in ``order``: a cap for trial runs, asked for by name."""
    return docs.orderBy(order).limit(limit)
