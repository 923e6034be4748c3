"""Operator 11: ranked lexical search, term at a time for short lists and document at a time for long ones.

One pass over the documents makes blocks of an inverted index for the terms that are asked, with the sums that
weights need. A second pass ranks each block's documents for every item. The item's short lists are summed first, term
at a time, into accumulators; these then are one more list, in document order and with its largest sum as bound,
beside the long ones. Over those lists the ranking goes document at a time: lists whose bounds together cannot reach the
score to beat do not propose documents, they are only asked about those the others propose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import query_blocks
from tessera.llm.common import Scratch

#: Items whose terms are sought in one pass; documents and postings of an index block, about.
ITEMS, DOCS, POSTINGS = 1000, 8192, 1 << 20
#: Lists of up to one document in so many of a block are summed term at a time; candidates looked at together.
SHORT, TOGETHER = 24, 512

_DROPPED = bytes(b for b in range(128) if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b)
_FOLD = bytes.maketrans(_DROPPED + bytes(range(65, 91)), b" " * len(_DROPPED) + bytes(range(97, 123)))

INDEX = "n_docs long, n_terms long, terms array<int>, sizes array<int>, ids binary, no_id binary, lengths binary, postings binary"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is not ASCII; only A-Z are lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _indexed(asked):
    """Documents to index blocks: for each asked term the documents that hold it, in the order of their ids, and how often."""

    def block(ids: list, lengths: list[int], docs: list[np.ndarray], found: list[np.ndarray]) -> tuple:
        none = np.array([i is None for i in ids], bool)
        value = np.array([i or 0 for i in ids], np.int64)
        order = np.lexsort((value, none))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc, term = place[np.concatenate([*docs, np.zeros(0, np.int64)])], np.concatenate([*found, np.zeros(0, np.int64)])
        pairs, tf = np.unique(term * max(len(ids), 1) + doc, return_counts=True)
        term, doc = pairs // max(len(ids), 1), pairs % max(len(ids), 1)
        names, sizes = np.unique(term, return_counts=True)
        length = np.array(lengths, np.int64)[order]
        whole = np.stack([doc, tf]).astype("<i4").tobytes()
        return len(ids), int(length.sum()), names.tolist(), sizes.tolist(), value[order].tobytes(), none[order].tobytes(), length.tobytes(), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, lengths, docs, found, held = asked.value, [], [], [], [], 0
        get = known.get

        def made() -> pa.RecordBatch:
            row = block(ids, lengths, docs, found)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_py())
                if not words:
                    continue
                hits = [x for x in map(get, words) if x is not None]
                docs.append(np.full(len(hits), len(ids), np.int64))
                found.append(np.array(hits, np.int64))
                ids.append(i)
                lengths.append(len(words))
                held += len(hits)
                if len(ids) >= DOCS or held >= POSTINGS:
                    yield made()
                    ids, lengths, docs, found, held = [], [], [], [], 0
        if ids:
            yield made()

    return run


class Top:
    """The first ``k`` documents seen: by score, then id, no id last. ``beat`` is the score below which none can enter."""

    def __init__(self, k: int):
        self.k, self.beat = k, 1
        self.score = self.id = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, o = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.none, none])
        at = np.lexsort((i, o, -s))[: self.k]
        self.score, self.id, self.none = s[at], i[at], o[at]
        if len(at) == self.k:
            self.beat = int(self.score[-1])


def hybrid(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, top: Top, ids: np.ndarray, none: np.ndarray, short: int = SHORT, together: int = TOGETHER) -> int:
    """Puts a block's documents to ``top``. ``lists``: (documents in order, their parts of the score, the largest part) of
    each term. Returns how many documents were scored in full."""
    few = [x for x in lists if len(x[0]) * short <= n_docs]
    long = [x for x in lists if len(x[0]) * short > n_docs]
    if few:
        sums = np.zeros(n_docs, np.int64)
        for doc, part, _ in few:  # term at a time; a list holds a document once
            sums[doc] += part
        doc = np.flatnonzero(sums)
        if len(doc):
            long.append((doc, sums[doc], int(sums[doc].max())))
    long.sort(key=lambda x: x[2])
    below = np.cumsum([0] + [x[2] for x in long])  # what the lists before one can add together
    at, scored = 0, 0  # documents before ``at`` are done
    while at < n_docs:
        # essential lists propose documents: without one of these no score reaches the one to beat
        first = int(np.searchsorted(below[1:], top.beat, side="left"))
        if first >= len(long):
            break
        rest, ends = [], [n_docs]
        for doc, _, _ in long[first:]:
            a = int(np.searchsorted(doc, at))
            rest.append(a)
            if a + together < len(doc):
                ends.append(int(doc[a + together]))
        stop = min(ends)  # a range of documents in which no essential list holds more than ``together``
        sums = np.zeros(stop - at, np.int64)
        for (doc, part, _), a in zip(long[first:], rest, strict=True):
            b = a + int(np.searchsorted(doc[a : a + together + 1], stop))
            sums[doc[a:b] - at] += part[a:b]
        live = np.flatnonzero(sums)
        score = sums[live]
        for j in range(first - 1, -1, -1):  # the others are asked, the largest bound first, about documents still in play
            keep = score + below[j + 1] >= top.beat
            live, score = live[keep], score[keep]
            if not len(live):
                break
            doc, part, _ = long[j]
            where = np.searchsorted(doc, live + at)
            where[where == len(doc)] = 0
            score = score + np.where(doc[where] == live + at, part[where], 0)
        scored += len(live)
        keep = score >= top.beat
        if keep.any():
            top.offer(score[keep], ids[live[keep] + at], none[live[keep] + at])
        at = stop
    return scored


FOUND = "item long, doc_id long, score long"


def _ranked(facts, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = facts.value
        tops = [Top(k) for _ in items]
        for batch in batches:
            for at in range(len(batch)):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                ids, none = np.frombuffer(row["ids"].as_py(), np.int64), np.frombuffer(row["no_id"].as_py(), bool)
                lengths = np.frombuffer(row["lengths"].as_py(), np.int64)
                doc, tf = np.frombuffer(row["postings"].as_py(), "<i4").astype(np.int64).reshape(2, -1)
                names, sizes = row["terms"].values.to_numpy(), row["sizes"].values.to_numpy().astype(np.int64)
                m = 50 + (50 * lengths * n_docs) // n_terms
                part = weights[np.repeat(names, sizes)] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                ends = np.cumsum(sizes)
                lists = {t: (doc[b - n : b], part[b - n : b], int(part[b - n : b].max())) for t, n, b in zip(names.tolist(), sizes.tolist(), ends.tolist(), strict=True)}
                for top, wanted in zip(tops, items, strict=True):
                    hybrid([lists[t] for t in wanted if t in lists and lists[t][2]], len(ids), top, ids, none)
        slot = np.repeat(np.arange(len(tops)), [len(t.score) for t in tops]).astype(np.int64)
        join = lambda f, kind: np.concatenate([np.zeros(0, kind), *map(f, tops)])
        doc_id = pa.array(join(lambda t: t.id, np.int64), mask=join(lambda t: t.none, bool))
        yield pa.RecordBatch.from_arrays([pa.array(slot), doc_id, pa.array(join(lambda t: t.score, np.int64))], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0, ties by ascending id.

    Null and empty texts have no terms: such documents are not counted, such items find nothing. Rows are taken as
    they stand: documents that share an id are ranked each, items that share one are answered each. A document
    without id comes after all ids among equal scores; an item's id may be of any type, null too. Empty tables give an
    empty result; further columns are not read, whatever their names.
    Items are worked on ITEMS at a time, each time in one pass over all documents.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "search")
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    parts = []
    for n, block in enumerate(query_blocks(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), tmp, "items", ITEMS)):
        known: dict[bytes, int] = {}
        wanted = [sorted({known.setdefault(w, len(known)) for w in terms(t)}) for t in block.column("text").to_pylist()]
        asked = spark.sparkContext.broadcast(known)
        index = tmp.table(texts.mapInArrow(_indexed(asked), INDEX), f"index{n}")
        asked.destroy()
        n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        df = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df")).toArrow()
        weights = np.zeros(len(known), np.int64)
        for t, x in zip(df.column("terms").to_pylist(), df.column("df").to_pylist(), strict=True):
            weights[t] = weight(n_docs, x)
        facts = spark.sparkContext.broadcast((wanted, weights, n_docs, n_terms))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        # each task gives k rows an item at most, and Spark drops all but k of what it has before its shuffle
        best = index.mapInArrow(_ranked(facts, k), FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"_item": np.arange(len(block)), "item_id": block.column("item_id")}))
        named = best.join(F.broadcast(names), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")
        parts.append(tmp.table(named, f"best{n}"))
        facts.destroy()
        tmp.drop(f"index{n}")
    if parts:
        return reduce(DataFrame.unionByName, parts)
    kind = items.schema[item_col].dataType.simpleString()
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
