"""Operator 13: hard negatives by Kronecker-packed products.

Scores are inner products of integer vectors. The components that some thousand candidates have in one place
are biased to be positive and laid into separate fields of one wide integer. Multiplying it by an anchor's component
there multiplies all of them; the sum over places holds every candidate's score in its field, exactly, as
fields are wide enough never to reach into the next. So an anchor costs one product and one sum a place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import query_blocks
from tessera.llm.common import Scratch

#: Candidates in one wide integer, anchors whose scores are held at a time, anchors sent to the tasks at a time and
#: components of these.
FIELDS, AT_ONCE, BLOCK, COMPONENTS = 2048, 128, 8192, 1 << 20
#: Scores are held to this range.
MOST = (1 << 62) - 1
LEAST = -MOST
NO_SCORE = LEAST - 1


def floored(x: float) -> int:
    """floor(256 x), for any finite double."""
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x)


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """The first ``size`` components of each vector, filled with zeros."""
    n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, start = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(row)) - start
    out, kept = np.zeros((len(n), size)), at < size
    out[row[kept], at[kept]] = vectors.flatten().to_numpy(zero_copy_only=False)[kept]
    return out


def quantised(vectors: np.ndarray) -> list[list[int]] | np.ndarray:
    """floor(256 x) of each component: 64-bit, or Python's integers where they need it."""
    if np.abs(vectors).max(initial=0) < 2.0**40:
        return np.floor(256 * vectors).astype(np.int64)
    return [[floored(x) for x in row] for row in vectors.tolist()]


def _largest(rows) -> int:
    return int(np.abs(rows).max(initial=0)) if isinstance(rows, np.ndarray) else max((abs(x) for r in rows for x in r), default=0)


class Packed:
    """Candidates side by side in wide integers, one for each place of their vectors."""

    def __init__(self, rows, anchors_largest: int):
        self.n, self.size = len(rows), len(rows[0]) if len(rows) else 0
        self.bias = _largest(rows)
        # no sum of products of biased components can reach this, with either sign
        self.reach = anchors_largest * 2 * self.bias * max(self.size, 1) + 1
        self.bytes = next((b for b in (4, 8) if 2 * self.reach < 1 << (8 * b)), -(-(2 * self.reach).bit_length() // 8))
        self.start = self._join([self.reach] * self.n)
        self.places = [self._join(self._biased(rows, j)) for j in range(self.size)]

    def _biased(self, rows, j: int):
        return rows[:, j] + self.bias if isinstance(rows, np.ndarray) else [r[j] + self.bias for r in rows]

    def _join(self, values) -> int:
        if self.bytes <= 8:
            return int.from_bytes(np.asarray(values, dtype=f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in values), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The anchor's inner product with every candidate."""
        total = self.start
        for x, place in zip(anchor, self.places, strict=False):
            if x:
                total += x * place
        shift = self.reach + self.bias * sum(anchor[: self.size])
        raw = total.to_bytes(self.n * self.bytes, "little")
        if self.bytes == 4 or (self.bytes == 8 and shift < 1 << 62):
            return np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64) - shift
        each = (int.from_bytes(raw[i : i + self.bytes], "little") - shift for i in range(0, len(raw), self.bytes))
        return np.array([min(max(x, LEAST), MOST) for x in each], np.int64)


class Best:
    """For each slot the first ``k`` of all (score, id) put to it: higher scores, then smaller ids, no id last."""

    def __init__(self, slots: int, k: int):
        self.k, self.score = k, np.full((slots, k), NO_SCORE, np.int64)
        self.id, self.none = np.zeros((slots, k), np.int64), np.ones((slots, k), bool)
        self.full = np.zeros(slots, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """``scores`` (slot x candidate); candidates stand in the order of their ids."""
        floor = self.score[slots, self.k - 1]
        scores = np.where(allowed & (scores >= floor[:, None]), scores, NO_SCORE)
        rows = np.arange(len(slots))
        for _ in range(self.k):
            at = scores[rows].argmax(axis=1)  # the first of equals: the smallest id
            value = scores[rows, at]
            live = value > NO_SCORE
            rows, at, value = rows[live], at[live], value[live]
            if not len(rows):
                return
            self._put(slots[rows], value, ids[at], none[at])
            scores[rows, at] = NO_SCORE

    def _put(self, slots, score, ids, none) -> None:
        s = np.concatenate([self.score[slots], score[:, None]], axis=1)
        i = np.concatenate([self.id[slots], ids[:, None]], axis=1)
        o = np.concatenate([self.none[slots], none[:, None]], axis=1)
        order = np.lexsort((i, o, -s), axis=1)[:, : self.k]
        self.score[slots], self.id[slots], self.none[slots] = (np.take_along_axis(x, order, axis=1) for x in (s, i, o))
        self.full[slots] = np.minimum(self.full[slots] + 1, self.k)


def _batch(batch: pa.RecordBatch):
    """ids, no id, labels and vectors of a batch, by id; rows of one id stay in their order."""
    ids = batch.column(0)
    none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((value, none))
    labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    return value[order], none[order], labels[order], batch.column(2).take(pa.array(order))


def _same_label(block, k: int):
    """Best rows of the anchor's own label: rows are packed label by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = block.value
        anchors, size = quantised(vectors), vectors.shape[1]
        largest, ints = _largest(anchors), [list(map(int, a)) for a in anchors]
        by_label: dict[int, np.ndarray] = {x: np.flatnonzero(labels == x) for x in np.unique(labels).tolist()}
        best = Best(len(ids), k)
        for batch in batches:
            value, none, label, rows = _batch(batch)
            for x in np.unique(label).tolist():
                slots = by_label.get(x)
                if slots is None:
                    continue
                own = np.flatnonzero(label == x)
                for at in range(0, len(own), FIELDS):
                    part = own[at : at + FIELDS]
                    packed = Packed(quantised(matrix(rows.take(pa.array(part)), size)), largest)
                    for some in range(0, len(slots), AT_ONCE):
                        few = slots[some : some + AT_ONCE]
                        other = none[part][None, :] | (value[part][None, :] != ids[few][:, None])
                        best.offer(few, np.stack([packed.scores(ints[i]) for i in few]), other, value[part], none[part])
        yield _found(best)

    return run


def _other_labels(block, k: int):
    """Best rows of other labels within each (anchor, positive)'s range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vectors, slot_anchor, low, high = block.value
        anchors, size = quantised(vectors), vectors.shape[1]
        largest, ints = _largest(anchors), [list(map(int, a)) for a in anchors]
        first = np.searchsorted(slot_anchor, np.arange(len(labels) + 1))  # slots stand in the order of their anchors
        best = Best(len(slot_anchor), k)
        for batch in batches:
            value, none, label, rows = _batch(batch)
            for at in range(0, len(rows), FIELDS):
                part = slice(at, at + FIELDS)
                packed = Packed(quantised(matrix(rows[part], size)), largest)
                for some in range(0, len(labels), AT_ONCE):
                    few = np.arange(some, min(some + AT_ONCE, len(labels)))
                    few = few[first[few + 1] > first[few]]
                    if not len(few):
                        continue
                    scores = np.stack([packed.scores(ints[i]) for i in few])
                    other = labels[few][:, None] != label[part][None, :]
                    for j in range(int((first[few + 1] - first[few]).max())):
                        have = np.flatnonzero(first[few] + j < first[few + 1])
                        slots = first[few[have]] + j
                        s = scores[have]
                        fits = other[have] & (s >= low[slots][:, None]) & (s <= high[slots][:, None])
                        best.offer(slots, s, fits, value[part], none[part])
        yield _found(best)

    return run


FOUND = "slot long, id long, score long"


def _found(best: Best) -> pa.RecordBatch:
    slot, at = np.nonzero(np.arange(best.k)[None, :] < best.full[:, None])
    columns = [pa.array(slot.astype(np.int64)), pa.array(best.id[slot, at], mask=best.none[slot, at]), pa.array(best.score[slot, at])]
    return pa.RecordBatch.from_arrays(columns, names=["slot", "id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each slot with their ``rank``; Spark drops what cannot be among them before its shuffle."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector.cast("array<double>"), bad), F.lit(False))


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    *,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (50, 100),
    high: tuple[int, int] = (95, 100),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the components floor(256 x). ``anchor`` is a condition on the columns of
    ``rows``. A negative n of an anchor and its positive p has another label and low p <= n <= high p, the bounds
    being whole-number ratios. Higher scores come first, then smaller ids.

    Rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as
    filled up with zeros. Rows are taken as they stand: repeated ones are ranked each, and a repeated anchor is
    answered as often; rows of the anchor's own id are never its positives. A row without id is no anchor, comes after all ids among
    equal scores, and is reported with a null id. Ids and labels are whole numbers. Scores beyond 62 bits are held at the end of
    that range. Empty tables give an empty result; further columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    tmp = Scratch(spark, "negatives")
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    taken = tmp.table(taken.filter(F.col("label").isNotNull() & usable(F.col("vector"))), "rows")
    asked = taken.filter(F.col("anchor") & F.col("id").isNotNull()).select("id", "label", "vector")
    longest = asked.agg(F.max(F.size("vector"))).first()[0] or 1
    parts, sent = [], []
    for n, block in enumerate(query_blocks(asked, tmp, "anchors", max(1, min(BLOCK, COMPONENTS // longest)))):
        ids, labels = (block.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        vectors = matrix(block.column("vector").combine_chunks(), longest)
        sent.append(spark.sparkContext.broadcast((ids, labels, vectors)))
        near = _first(taken.select("id", "label", "vector").mapInArrow(_same_label(sent[-1], positives), FOUND), positives)
        own = near.toArrow().sort_by([("slot", "ascending"), ("rank", "ascending")])  # at most BLOCK x positives rows
        slot, score = own.column("slot").to_numpy(), own.column("score").to_pylist()
        lo = np.array([-(-low[0] * s // low[1]) for s in score], np.int64)
        hi = np.array([high[0] * s // high[1] for s in score], np.int64)
        sent.append(spark.sparkContext.broadcast((labels, vectors, slot, lo, hi)))
        found = _first(taken.select("id", "label", "vector").mapInArrow(_other_labels(sent[-1], negatives), FOUND), negatives)
        pairs = pa.table({"_slot": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": own.column("id"), "positive_score": own.column("score")})
        named = found.join(F.broadcast(spark.createDataFrame(pairs)), F.col("slot") == F.col("_slot"))
        columns = ["anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
        parts.append(tmp.table(named.select(*columns), f"found{n}"))
        for x in sent:
            x.destroy()
        sent.clear()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def op13_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
