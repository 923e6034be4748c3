"""Sentences to chunks. A document's sentences stay in one array, so the native strategies run row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V


def _chunk(s: Column, position: Column, start: Column, end: Column) -> Column:
    """Sentences start..end-1 as a chunk."""
    parts = F.slice(s, start + 1, end - start)
    return F.struct(
        position.cast("int").alias("position"),
        start.cast("int").alias("start_sentence_idx"),
        (end - 1).cast("int").alias("end_sentence_idx"),
        parts.alias("sentences"),
        T.join_sentences(parts).alias("text"),
    )


def fixed_chunks(s: Column, n_chunks: int, overlap: int = 0) -> Column:
    """At most ``n_chunks`` chunks of nearly equal size, the first ones a sentence longer, widened by ``overlap``.

    ``s`` is a materialised array column; no sentences, no chunks.
    """
    n = F.size(s)
    m = F.least(F.lit(n_chunks), n)
    base, extra = F.floor(n / m).cast("int"), (n % m).cast("int")
    begin = lambda p: p * base + F.least(p, extra)
    make = lambda p: _chunk(s, p, F.greatest(begin(p) - overlap, F.lit(0)), F.least(begin(p + 1) + overlap, n))
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")), make)


def explode_rows(rows: DataFrame, array: str, at: str, value: str, keep: bool = False) -> DataFrame:
    """One row for each element of an array column, with its place; without the array unless ``keep``.

    The outer generator is meant: for the inner one the optimizer adds a filter on the array's size and pushes it
    below the projections that make the array, where lambdas would work their inputs out again element by element.
    """
    rest = [c for c in rows.columns if keep or c != array]
    return rows.select(*rest, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())


def explode_chunks(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, position, chunk_id, …): one row a chunk."""
    rows = explode_rows(docs.select(id_col, chunks.alias("_chunks")), "_chunks", "_at", "c").select(id_col, "c.*")
    return rows.withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("::chunk_"), F.col("position").cast("string")))


KINDS = ("percentile", "standard_deviation", "interquartile", "gradient", "distance", "gradient_absolute")
DEFAULTS = {"percentile": 95.0, "standard_deviation": 3.0, "interquartile": 1.5, "gradient": 95.0, "distance": 0.3, "gradient_absolute": 0.1}


@dataclass(frozen=True)
class Breakpoints:
    """Where to cut between sentences: after those whose score exceeds the threshold of this kind."""

    kind: str = "percentile"
    amount: float | None = None
    number_of_chunks: int | None = None
    min_chunk_size: int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; one of {KINDS}")
        if self.number_of_chunks is not None and (isinstance(self.number_of_chunks, bool) or self.number_of_chunks < 1):
            raise ValueError("number_of_chunks must be a positive whole number")

    @property
    def value(self) -> float:
        return DEFAULTS[self.kind] if self.amount is None else self.amount


def consecutive_distances(vectors: Column) -> Column:
    """1 - cosine of each vector and the next; each vector's own product is worked out once."""
    first = F.slice(vectors, F.lit(1), F.greatest(F.size(vectors) - 1, F.lit(0)))
    cosine = lambda v, w, size: F.when(size > 0, V.dot(v, w) / size).otherwise(F.lit(0.0))
    apart = lambda own: F.transform(first, lambda v, i: F.lit(1.0) - V.let(F.sqrt(F.get(own, i) * F.get(own, i + 1)), lambda size: cosine(v, F.get(vectors, i + 1), size)))
    return V.let(F.transform(vectors, lambda v: V.dot(v, v)), apart)


def break_scores(distances: Column, rule: Breakpoints) -> Column:
    by_count = rule.number_of_chunks is not None and rule.kind not in ("distance", "gradient_absolute")
    return V.gradient(distances) if rule.kind.startswith("gradient") and not by_count else distances


def break_threshold(scores: Column, rule: Breakpoints) -> Column:
    """``scores`` is a materialised column. A target count becomes a percentile: all breaks at 0, none at 100."""
    n = F.size(scores)
    if rule.kind in ("distance", "gradient_absolute"):
        return F.lit(float(rule.value))
    if rule.number_of_chunks is not None:
        want = F.least(F.greatest(F.lit(float(rule.number_of_chunks)), F.lit(1.0)), n.cast("double"))
        share = F.when(n > 1, F.lit(1.0) - (want - 1) / (n - 1)).otherwise(F.lit(1.0))
        s, at = F.sort_array(scores), (n - 1) * share
        lo, hi = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return lo + (hi - lo) * (at - F.floor(at))
    if rule.kind in ("percentile", "gradient"):
        return V.quantile(scores, rule.value / 100.0)
    if rule.kind == "standard_deviation":
        return V.mean(scores) + F.lit(rule.value) * V.deviation(scores)
    return V.mean(scores) + F.lit(rule.value) * (V.quantile(scores, 0.75) - V.quantile(scores, 0.25))


def with_breaks(docs: DataFrame, rule: Breakpoints, vectors_col: str = "vectors") -> DataFrame:
    """Adds ``breaks``: the numbers of the sentences after which a new segment starts."""
    scored = docs.withColumn("_d", consecutive_distances(F.col(vectors_col))).withColumn("_s", break_scores(F.col("_d"), rule))
    none = F.array().cast("array<int>")
    # bound: as a column of its own the optimizer would put the threshold into the lambda, once for each score
    found = V.let(break_threshold(F.col("_s"), rule), lambda t: F.filter(F.transform("_s", lambda x, i: F.when(x > t, i)), lambda i: i.isNotNull()))
    if rule.kind.startswith("gradient"):  # two sentences have one distance, and no slope
        found = F.when(F.size("_s") > 1, found).otherwise(none)
    return scored.withColumn("breaks", F.coalesce(found, none)).drop("_d", "_s")


def breakpoint_chunks(s: Column, breaks: Column, min_chunk_size: int | None = None) -> Column:
    """Segments between breaks as chunks; one shorter than ``min_chunk_size`` characters takes in the next.

    The last is made however short it is. ``s`` and ``breaks`` are materialised columns.
    """
    n = F.size(s)
    ends = F.concat(F.transform(F.filter(breaks, lambda b: b < n - 1), lambda b: b + 1), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    if min_chunk_size:
        state = F.struct(F.lit(0).alias("start"), F.array().cast("array<int>").alias("ends"))
        # characters of sentences start..end-1 joined by blanks
        long = lambda sizes, a, b: F.aggregate(F.slice(sizes, a + 1, b - a), F.lit(0), lambda t, x: t + x + 1) - 1 >= min_chunk_size
        step = lambda sizes: lambda acc, e: F.when(
            (e == n) | long(sizes, acc["start"], e), F.struct(e.alias("start"), F.concat(acc["ends"], F.array(e)).alias("ends"))
        ).otherwise(acc)
        ends = V.let(F.transform(s, lambda x: F.length(T.strip(x))), lambda sizes: F.aggregate(ends, state, step(sizes), lambda acc: acc["ends"]))
    return V.let(ends, lambda all_ends: F.transform(all_ends, lambda e, i: _chunk(s, i, F.when(i == 0, F.lit(0)).otherwise(F.get(all_ends, i - 1)), e)))


#: Pairs whose distances are held at a time, and the nearest pairs that are kept of one pass over all.
BLOCK, NEAREST = 1 << 20, 1 << 20
#: Sorted pairs that are looked through together.
TOGETHER = 1024


class _Parts:
    """Clusters of points as they merge. A cluster is called by its first member."""

    def __init__(self, n: int, most: int):
        self.of, self.size, self.most = np.arange(n), np.ones(n, np.int64), most
        self.members: dict[int, list[int]] = {i: [i] for i in range(n)}
        self.last: dict[int, float] = {}

    def merge(self, a: int, b: int, distance: float) -> None:
        self.last.pop(b, None)
        self.last[a] = distance
        own = self.members.pop(b)
        self.of[own] = a
        self.members[a] += own
        self.size[a] += self.size[b]

    def fit(self, a, b):
        return (a != b) & (self.size[a] + self.size[b] <= self.most)

    def merge_ties(self, pairs: Iterator[tuple[int, int]], distance: float) -> None:
        """Merges along pairs of clusters at one distance, the first in order of clusters before all others.

        A cluster in its turn takes in partners until none fits; nothing that comes later can give an earlier one a
        partner, since what did not fit never will.
        """
        near: dict[int, set[int]] = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for a in sorted(near):
            while a in self.members and (found := [b for b in near[a] if b > a and self.size[a] + self.size[b] <= self.most]):
                b = min(found)
                self.merge(a, b, distance)
                for c in near.pop(b) - {a}:
                    near[c].discard(b)
                    near[c].add(a)
                    near[a].add(c)
                near[a].discard(b)

    def merge_sorted(self, d: list[float], i: list[int], j: list[int]) -> None:
        """Merges along pairs of points, nearest first; those of one distance are held together."""
        of, size, at = memoryview(self.of), memoryview(self.size), 0
        while at < len(d):
            end = at + 1
            while end < len(d) and d[end] == d[at]:
                end += 1
            pairs = [(of[a], of[b]) for a, b in zip(i[at:end], j[at:end], strict=True)]
            pairs = [(a, b) for a, b in pairs if a != b and size[a] + size[b] <= self.most]
            if len(pairs) == 1:
                self.merge(min(pairs[0]), max(pairs[0]), d[at])
            elif pairs:
                self.merge_ties(iter(pairs), d[at])
            at = end

    def merge_level(self, rows: Callable[[int, int], np.ndarray], distance: float) -> None:
        """The same for more pairs than are kept, which are found point by point."""
        for a in range(len(self.of)):
            if a not in self.members:
                continue
            near, looked = np.zeros(len(self.of), bool), 0
            while a in self.members:
                for i in self.members[a][looked:]:
                    near |= rows(i, i + 1)[0] == distance
                looked = len(self.members[a])
                found = self.of[near]
                found = found[(found > a) & self.fit(found, np.full(len(found), a))]
                if not len(found):
                    break
                self.merge(a, int(found.min()), distance)


def _nearest(rows: Callable[[int, int], np.ndarray], parts: _Parts, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Pairs of points in clusters that fit, nearest first, and a distance: all pairs below it are among them."""
    n, limit = len(parts.of), np.inf
    step = max(1, BLOCK // n)
    held, count = [], 0
    for at in range(0, n, step):
        d = rows(at, min(at + step, n))
        own = parts.of[at : at + len(d), None]
        keep = (np.arange(at, at + len(d))[:, None] < np.arange(n)[None, :]) & (d <= stop) & (d < limit) & parts.fit(own, parts.of[None, :])
        i, j = np.nonzero(keep)
        held.append((d[i, j], (i + at).astype(np.int32), j.astype(np.int32)))
        count += len(i)
        if count > 2 * NEAREST:
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            limit = np.partition(x[0], NEAREST)[NEAREST]
            keep = x[0] < limit
            held, count = [tuple(c[keep] for c in x)], int(keep.sum())
    d, i, j = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(d, kind="stable")
    return d[order], i[order], j[order], limit


def single_linkage(rows: Callable[[int, int], np.ndarray], n: int, number_of_chunks: int, stop: float) -> list[tuple[list[int], float | None]]:
    """Clusters with the distance of their last merge; sizes stay within ceil(n / number_of_chunks).

    The closest pair whose joint size fits is merged while it is no farther than ``stop``; of equal pairs the first in
    order of clusters, which are in order of their first members. ``rows(a, b)`` gives the distances of points a to b - 1
    to all, the same each time and from either side.

    Clusters only grow, so two that do not fit never will, and pairs of points can be taken once, nearest first. Each
    pass over all pairs keeps the nearest that still matter; memory grows with the points and not with their square.
    """
    parts = _Parts(n, max(1, -(-n // number_of_chunks)))
    while n > 1 and parts.most > 1:
        d, i, j, limit = _nearest(rows, parts, stop)
        at = 0
        while at < len(d):  # what does not fit any more drops out some thousand pairs at a time
            end = int(np.searchsorted(d, d[min(at + TOGETHER, len(d)) - 1], side="right"))  # pairs of one distance stay together
            keep = at + np.flatnonzero(parts.fit(parts.of[i[at:end]], parts.of[j[at:end]]))
            at = end
            parts.merge_sorted(d[keep].tolist(), i[keep].tolist(), j[keep].tolist())
        if not np.isfinite(limit):
            break
        if not len(d):
            parts.merge_level(rows, float(limit))
    return [(sorted(parts.members[a]), parts.last.get(a)) for a in sorted(parts.members)]


def _dense(near: np.ndarray, least: int) -> np.ndarray:
    """What ``density_clusters`` finds, for as few points as their square can be held: the least core point of each one's cluster, or itself."""
    n = len(near)
    core = near.sum(1) >= least
    label = np.where(core, np.arange(n), n)
    while True:  # least number among the cores around, then that one's own, until nothing changes
        found = np.where(near & core[None, :], label[None, :], n).min(1)
        found = np.where(core, np.minimum(found, label), found)
        jump = np.where(found < n, np.append(found, n)[found], n)
        if not core.any() or (jump[core] == label[core]).all():
            return np.where(jump < n, jump, np.arange(n))
        label = np.where(core, jump, n)


def density_clusters(row: Callable[[int], np.ndarray], n: int, radius: float, least: int, rows: Callable[[int, int], np.ndarray] | None = None) -> list[list[int]]:
    """Density clusters (a point counts itself; radius inclusive), noise points each by itself, by first member.

    ``row(i)`` gives the distances of point i, ``rows(a, b)`` those of a to b - 1. The distances of few points are held together;
    of more, ``BLOCK`` at a time, so memory grows with the points and not with their square.
    """
    rows = rows or (lambda a, b: np.stack([row(i) for i in range(a, b)]))
    if 0 < n * n <= BLOCK:
        label = _dense(rows(0, n) <= radius, least)
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(label.tolist()):
            groups.setdefault(c, []).append(i)
        return sorted(groups.values())
    step = max(1, BLOCK // max(n, 1))
    core = np.concatenate([(rows(a, min(a + step, n)) <= radius).sum(1) >= least for a in range(0, n, step)]) if n else np.zeros(0, bool)
    label = np.full(n, -1)
    made = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        label[i], front = made, [i]
        while front:
            some, front = front[-step:], front[:-step]
            near = (np.concatenate([row(k)[None] for k in some]) <= radius).any(0) & (label < 0)
            label[near] = made
            front += np.flatnonzero(near & core).tolist()
        made += 1
    groups = [np.flatnonzero(label == c).tolist() for c in range(made)] + [[i] for i in np.flatnonzero(label < 0).tolist()]
    return sorted(groups)


def joint_rows(vectors: np.ndarray, weight: float) -> Callable[[int, int], np.ndarray]:
    """Joint distances of positions and meanings: of points a to b - 1 to all.

    Products are summed in one order, so a distance is the same bit for bit from either side; whole numbers, as counts
    are, have exact products in any order.
    """
    n = len(vectors)
    whole = bool((vectors == np.rint(vectors)).all()) and float(np.abs(vectors).max(initial=0)) ** 2 * max(vectors.shape[1], 1) < 2.0**53
    columns = np.ascontiguousarray(vectors.T)
    square, at = np.zeros(n), np.arange(n)
    for x in columns if not whole else ():
        square += x * x
    if whole:
        square = np.square(vectors).sum(1)

    def dots(a: int, b: int) -> np.ndarray:
        if whole:
            return vectors[a:b] @ columns
        out = np.zeros((b - a, n))
        for x in columns:
            out += x[a:b, None] * x[None, :]
        return out

    def rows(a: int, b: int) -> np.ndarray:
        size = np.sqrt(square[a:b, None] * square[None, :])
        cosine = np.divide(dots(a, b), size, out=np.zeros((b - a, n)), where=size > 0)
        meaning = 1 - np.clip(cosine, 0, 1)
        meaning[np.arange(b - a), np.arange(a, b)] = 0
        return weight * np.abs(at[a:b, None] - at[None, :]) / n + (1 - weight) * meaning

    return rows


def check_clustering(weight: float = 0.25, number_of_chunks: int = 5, stop: float = 0.5, radius: float = 0.2, least: int = 2) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 1
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie between 0 and 1")
    if not whole(number_of_chunks) or not whole(least):
        raise ValueError("number_of_chunks and least must be positive whole numbers")
    if stop < 0 or radius <= 0:
        raise ValueError("stop must not be negative, radius must be positive")


CLUSTER_SCHEMA = "position int, sentence_indices array<int>, cluster_distance double, cluster_origin string, is_contiguous boolean"


def _clusters(rows: DataFrame, method: str, weight: float, number_of_chunks: int, stop: float, radius: float, least: int) -> DataFrame:
    """``rows`` (_id, _vectors, perhaps _sentences) to (_id, …, perhaps sentences), row by row where they lie."""

    def groups(vectors: pa.ListScalar) -> list[tuple[list[int], float | None, str]]:
        each = vectors.values
        if each is None or len(each) == 0:
            return []
        if len(each) == 1:
            return [([0], None, "singleton")]
        distances = joint_rows(each.flatten().to_numpy(zero_copy_only=False).reshape(len(each), -1).astype(float), weight)
        if method == "dbscan":
            return [(g, None, method) for g in density_clusters(lambda i: distances(i, i + 1)[0], len(each), radius, least, distances)]
        return [(g, x, method) for g, x in single_linkage(distances, len(each), number_of_chunks, stop)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, i, *g) for k, vectors in enumerate(batch.column(1)) for i, g in enumerate(groups(vectors))]
            at, position, members, distance, origin = zip(*found, strict=True) if found else ((),) * 5
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(position, pa.int32()),
                pa.array(members, pa.list_(pa.int32())),
                pa.array(distance, pa.float64()),
                pa.array(origin, pa.string()),
                pa.array([g[-1] - g[0] + 1 == len(g) for g in members], pa.bool_()),
            ]
            if batch.num_columns > 2:
                text = batch.column(2)
                start = text.offsets.to_numpy()
                places = pa.array([int(start[k]) + i for k, g in zip(at, members, strict=True) for i in g], pa.int64())
                ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in members])]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, text.values.take(places)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, {CLUSTER_SCHEMA}" + (", sentences array<string>" if "_sentences" in rows.columns else "")
    names = ["_id", *[x.split()[0] for x in CLUSTER_SCHEMA.split(", ")], *(["sentences"] if "_sentences" in rows.columns else [])]
    return rows.mapInArrow(run, schema)


def cluster_chunks(docs: DataFrame, *, method: str, weight: float = 0.25, number_of_chunks: int = 5, stop: float = 0.5, radius: float = 0.2, least: int = 2, id_col: str = "doc_id", vectors_col: str = "vectors") -> DataFrame:
    """(id, position, sentence_indices, …) by single linkage or by density.

    The vectors of a document stand in one row, so rows are clustered where they lie; no shuffle. Memory grows with a
    document's sentences, not with their square. The origin is singleton for a document of one sentence, else the
    method. Rows without vectors give none; ids may be of any type, null or repeated.
    """
    if method not in ("single_linkage", "dbscan"):
        raise ValueError(method)
    check_clustering(weight, number_of_chunks, stop, radius, least)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(vectors_col).cast("array<array<double>>").alias("_vectors"))
    return _clusters(rows, method, weight, number_of_chunks, stop, radius, least).withColumnRenamed("_id", id_col)


def cluster_texts(docs: DataFrame, *, method: str, weight: float = 0.25, number_of_chunks: int = 5, stop: float = 0.5, radius: float = 0.2, least: int = 2, id_col: str = "doc_id", vectors_col: str = "vectors") -> DataFrame:
    """What ``cluster_chunks`` gives, with chunk_id, sentences and text; ``docs`` also has ``sentences``, one for each
    vector. Sentences go through the same pass as vectors: nothing is joined."""
    if method not in ("single_linkage", "dbscan"):
        raise ValueError(method)
    check_clustering(weight, number_of_chunks, stop, radius, least)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(vectors_col).cast("array<array<double>>").alias("_vectors"), F.col("sentences").alias("_sentences"))
    own = _clusters(rows, method, weight, number_of_chunks, stop, radius, least).withColumnRenamed("_id", id_col)
    return own.withColumns({"text": T.join_sentences(F.col("sentences")), "chunk_id": F.concat(F.col(id_col).cast("string"), F.lit("::chunk_"), F.col("position").cast("string"))})
