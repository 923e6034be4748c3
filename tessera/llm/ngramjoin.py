"""Operator 7: an n-gram Jaccard self-join over count vectors, as classes of linked documents.

A document is the set of its distinct word shingles. Shingles are hashed into groups, about PER_GROUP of a
document's to each, and its counts by group are its point; points of unlike length are folded to the shorter.
Two sets share at most the sum of the coordinates' minima, so a pair whose points fall short of the overlap that
the threshold needs is dropped; the rest is verified on the sets.

Points are compared within blocks only. In one order of all shingles, common ones last, any two sets that
reach the threshold share a shingle among their first n - ceil(threshold n) + 1; a block is the sets that
have such a shingle in common, so no linked pair is missed. Blocks with the same members are taken once.
First each member is held against its block's least and greatest; blocks that links so found make one class
are done. The others are cut into overlapping bands of size, as sets too unlike in size cannot reach the threshold;
in each a tree over the points (an R-tree, bulk loaded, with label and least size per box) joins members of
different classes. Members that the bound lets link are then joined in the same way with their sets at hand; what
a link has joined is not compared again, so a group yields no more links than it has members. A band of more than
CHUNK members is cut, and pairs of chunks are joined by different tasks.
Equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_text, numbered
from tessera.llm.graph import components
from tessera.llm.shingles import shingles, word_hashes

#: Mean count of a coordinate, up to a factor of two; the least number of groups.
PER_GROUP, LEAST_GROUPS = 4, 16
#: Members of a block that one task holds against each other; twice as many points lie in a task's group.
CHUNK = 2000
#: Bits of the map of documents whose sets are fetched, and for how many nodes it is used: a quarter full at most.
MAP_BITS, MAP_NODES = 24, 1 << 22
#: Shingles in more than this share of the documents come last in the order. The order decides speed alone.
COMMON = 5e-5
#: So many of them are sent to the tasks (16 bytes each); any further ones keep their place among the others.
MOST_COMMON = 1_000_000

_SETS = "n int, k1 long, k2 long, prefix array<long>, point binary"


def needed(total, percent: int):
    """Least overlap of two sets with that many shingles together: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def groups_for(n: int) -> int:
    """A power of two, so that a point folds onto any shorter one."""
    return max(LEAST_GROUPS, 1 << (max(n // PER_GROUP, 1) - 1).bit_length())


def point_of(own: np.ndarray) -> bytes:
    """Counts by group, in bytes where they fit; the first byte says how wide a count is."""
    d = groups_for(len(own))
    counts = np.bincount((own >> np.uint64(20)).astype(np.int64) & (d - 1), minlength=d)
    return b"\1" + counts.astype("<u1").tobytes() if counts.max() < 256 else b"\4" + counts.astype("<u4").tobytes()


def coordinates(point: bytes) -> np.ndarray:
    return np.frombuffer(point, f"<u{point[0]}", offset=1)


def folded(point: np.ndarray, d: int) -> np.ndarray:
    return point.reshape(-1, d).sum(0, dtype=np.int64)


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    return [np.unique(shingles(w, k)) for w in word_hashes(texts)]


def _parts(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch[at : at + rows]


def _frequent(k: int):
    """Shingles that stand out within some batches of texts, with their counts there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for at in range(0, len(batch), 512) for x in _sets(batch["text"][at : at + 512].tolist(), k)]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= max(4, len(batch) // 1000)
                yield pd.DataFrame({"shingle": h[often].astype(np.int64), "n": n[often]})

    return run


def _describe(k: int, percent: int, common: np.ndarray, rank: np.ndarray):
    """common: sorted hashes of common shingles; rank: their places in the order, after all others."""

    def run(texts: list[str | None]) -> dict:
        out: dict[str, list] = {c: [] for c in ("n", "k1", "k2", "prefix", "point")}
        for own in _sets(texts, k):
            last = np.zeros(len(own), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                last = np.where(common[at] == own, rank[at] + 1, 0)
            first = own[np.lexsort((own, last))[: prefix_size(len(own), percent)]]
            k1, k2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
            for c, value in (("n", len(own)), ("k1", k1), ("k2", k2), ("prefix", first.astype(np.int64)), ("point", point_of(own))):
                out[c].append(value)
        return out

    return run


def _bounded(percent: int):
    """Pairs whose points allow the overlap they need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for p, q, n in zip(batch["point_a"], batch["point_b"], batch["n_a"] + batch["n_b"], strict=True):
                p, q = coordinates(p), coordinates(q)
                d = min(len(p), len(q))
                keep.append(int(np.minimum(folded(p, d), folded(q, d)).sum()) >= needed(n, percent))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _fetch(k: int, bitmap: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            at = part["place"].to_numpy(np.int64)
            part = part[(bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
            if len(part):
                yield pd.DataFrame({"node": part["doc"].to_numpy(), "members": [x.tobytes() for x in _sets(part["text"].tolist(), k)]})

    return run


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = zip(batch["members_a"], batch["members_b"], strict=True)
            keep = [reaches(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


class Box:
    """A node of the tree: its points' greatest coordinates and least size, and their class if it is one."""

    LEAF = 32

    def __init__(self, at: np.ndarray, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.at, self.high, self.least = at, points[at].max(0), int(sizes[at].min())
        first = labels[at[0]]
        self.label = first if (labels[at] == first).all() else None
        self.parts: list[Box] = []
        if len(at) > self.LEAF:
            own = points[at]
            widest = int((own.max(0) - own.min(0)).argmax())
            order = at[np.argsort(own[:, widest], kind="stable")]
            cut = len(at) // 2
            self.parts = [Box(order[:cut], points, sizes, labels), Box(order[cut:], points, sizes, labels)]


def tree_join(left: Box, right: Box, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different classes that the bound allows; left and right may be one box."""
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        if a.label is not None and a.label == b.label:
            continue
        if np.minimum(a.high, b.high).sum() < needed(a.least + b.least, percent):
            continue
        if a.parts or b.parts:
            if a is b:
                x, y = a.parts
                todo += [(x, x), (x, y), (y, y)]
            elif len(a.at) >= len(b.at):
                todo += [(x, b) for x in a.parts]
            else:
                todo += [(a, x) for x in b.parts]
            continue
        most = np.minimum(points[a.at][:, None, :], points[b.at][None, :, :]).sum(2, dtype=np.int64)
        ok = (most >= needed(sizes[a.at][:, None] + sizes[b.at][None, :], percent)) & (labels[a.at][:, None] != labels[b.at][None, :])
        if a is b:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        if len(i):
            yield a.at[i], b.at[j]


def band_pairs(points: list[np.ndarray], rows: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the bound allows: members of the band with each other and with the band below.

    ``rows`` are one band of a block, or two chunks of it.
    """
    d = min(map(len, points))
    flat = np.stack([folded(p, d) for p in points])
    sizes, labels, chunk, own = (rows[c].to_numpy(np.int64) for c in ("n", "label", "chunk", "own"))
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    box = {}
    for c in {low, high}:
        for o in (0, 1):
            at = np.flatnonzero((chunk == c) & (own == o))
            box[c, o] = Box(at, flat, sizes, labels) if len(at) else None
    sides = [(box[low, 1], box[high, 1]), (box[low, 1], box[high, 0])] + ([(box[low, 0], box[high, 1])] if low != high else [])
    for a, b in sides:
        if a and b:
            yield from tree_join(a, b, flat, sizes, labels, percent)


_GROUP = ["key", "band", "low", "high"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches of rows that stand in order of their groups."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        cuts = np.flatnonzero((batch[_GROUP].to_numpy()[1:] != batch[_GROUP].to_numpy()[:-1]).any(1)) + 1
        ends = [0, *cuts.tolist()]
        for a, b in zip(ends, ends[1:], strict=False):
            yield batch[a:b]
        rest = batch[ends[-1] :]
    if rest is not None and len(rest):
        yield rest


def _hopeful(percent: int):
    """Members that the bound allows to link with some other class in their group: no pairs, at most the rows read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for rows in _groups(batches):
            keep = np.zeros(len(rows), bool)
            for i, j in band_pairs([coordinates(p) for p in rows["point"]], rows, percent):
                keep[i] = keep[j] = True
            if keep.any():
                out.append(rows.loc[keep, [*_GROUP, "own", "node", "label", "chunk", "n"]])
            if len(out) > 500:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    return run


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= percent * (len(both) - i)


def _linked_within(percent: int):
    """Links that join the classes of a group: what is joined already is not compared again, so no more than its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches):
            sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
            nodes, top = rows["node"].tolist(), {}

            def root(x, top=top):
                while x in top:
                    x = top[x]
                return x

            labels, found = rows["label"].tolist(), []
            for i, j in band_pairs([coordinates(point_of(s)) for s in sets], rows, percent):
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = root(labels[a]), root(labels[b])
                    if x != y and reaches(sets[a], sets[b], percent):
                        top[max(x, y)] = min(x, y)
                        found.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.tmp = Scratch(docs.sparkSession, "ngram-join")

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that stand in more than a share COMMON of the documents; the MOST_COMMON first of them, if there are more."""
        total = self.docs.count()
        counts = self.docs.select("text").mapInPandas(_frequent(self.k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        rows = counts.filter(F.col("n") > max(16, COMMON * total)).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
        h, n = rows["shingle"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
        by = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, n))] = np.arange(len(h))
        return h[by], rank[by]

    def sets_of(self, ids: DataFrame, name: str) -> DataFrame:
        """(node, members) for the nodes in ``ids``, made again from their texts; a few others may come along.

        Up to MAP_NODES nodes are known to the tasks as a map of fixed size (2 MB), so the texts are neither joined nor
        shuffled; more of them are joined.
        """
        k, docs = self.k, self.docs.filter("doc is not null")
        if ids.count() > MAP_NODES:
            some = docs.join(ids.select(F.col("node").alias("doc")).distinct().hint("merge"), "doc", "left_semi")
            return self.tmp.table(some.withColumn("place", F.lit(0).cast("long")).mapInPandas(_fetch(k, np.ones(1, np.uint64)), "node long, members binary"), name)
        place = F.pmod(F.xxhash64("node"), F.lit(1 << MAP_BITS))
        bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
        words = ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2 ** MAP_BITS / 64 rows at most
        bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
        bitmap[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
        sent = docs.sparkSession.sparkContext.broadcast(bitmap)
        fetch = lambda batches: _fetch(k, sent.value)(batches)
        sets = docs.withColumn("place", F.pmod(F.xxhash64("doc"), F.lit(1 << MAP_BITS))).mapInPandas(fetch, "node long, members binary")
        made = self.tmp.table(sets, name)
        sent.destroy()
        return made

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs among (a, b) that reach the threshold."""
        sets = self.sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), f"{name}-sets")
        x, y = (sets.select(F.col("node").alias(c), F.col("members").alias(f"members_{c}")).hint("merge") for c in "ab")
        both = pairs.join(x, "a").join(y, "b")
        links = self.tmp.table(both.mapInPandas(_verified(self.percent), "a long, b long"), f"{name}-links")
        self.tmp.drop(f"{name}-sets")
        return links

    def run(self) -> DataFrame:
        tmp, percent = self.tmp, self.percent
        common, rank = self.common()
        k = self.k
        sets = tmp.table(map_text(self.docs, "text", lambda: _describe(k, percent, common, rank), _SETS), "sets")
        nodes = sets.filter("n > 0 and doc is not null").groupBy("k1", "k2").agg(
            F.min("doc").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("point").alias("point")
        )
        nodes = tmp.table(nodes, "nodes")
        owners = tmp.table(sets.select("doc", "n", "k1", "k2"), "owners")
        tmp.drop("sets")
        keys = nodes.select("node", F.explode("prefix").alias("key"))
        blocks = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("who"))
        blocks = tmp.table(blocks.filter("c > 1").groupBy("c", "lo", "hi", "who").agg(F.min("key").alias("key")), "blocks")
        members = tmp.table(keys.join(blocks.filter("c > 2").select("key", "lo", "hi"), "key"), "members")
        pairs = (
            blocks.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
            .union(members.filter("node <> lo").select("lo", "node"))
            .union(members.filter("node <> hi").select("node", "hi"))
            .distinct()
        )
        points = nodes.select("node", "n", "point")
        near = self._allowed(pairs, points)
        links = self.linked(tmp.table(near, "tried"), "first")
        tmp.drop("tried")
        labels = components(links, tmp, "first-classes")
        labels = tmp.table(labels, "labels")
        # a band is as wide as sizes may differ: a set goes to its own, and to the next one up to meet larger ones
        width = float(np.log(100 / percent)) * (1 + 1e-9)
        named = members.join(labels, "node", "left").join(points.select("node", "n"), "node").select(
            "key", "node", F.coalesce("component", "node").alias("label"), F.floor(F.log(F.col("n").cast("double")) / width).cast("int").alias("band")
        )
        seats = named.withColumn("own", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("band", F.col("band") + 1 - F.col("own"))
        seats = tmp.table(seats, "seats")
        tmp.drop("members")
        tmp.drop("blocks")
        # those with members of two classes or more
        counts = seats.groupBy("key", "band").agg(
            F.count(F.lit(1)).alias("c"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("own").alias("some"), F.bit_xor(F.xxhash64("node", "own")).alias("who")
        )
        # bands of several blocks that have the same members are taken once
        open_bands = counts.filter("x < y and some = 1").groupBy("band", "c", "x", "y", "who").agg(F.min("key").alias("key")).select("key", "band", "c")
        parts = F.ceil(F.col("c") / CHUNK).cast("int")
        dealt = (
            seats.join(open_bands, ["key", "band"])
            .withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .select("key", "band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "own", "node", "label", "chunk")
        )
        by_group = lambda rows: rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
        schema = "key long, band int, low int, high int, own int, node long, label long, chunk int, n int"
        hopeful = tmp.table(by_group(dealt.join(points.hint("merge"), "node")).mapInPandas(_hopeful(percent), schema), "hopeful")
        tmp.drop("seats")
        if not hopeful.isEmpty():
            # groups that came down to the same members are taken once
            alike = hopeful.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("x"), F.bit_xor(F.xxhash64("node", "own", "chunk")).alias("who"))
            single = alike.groupBy("band", "low", "high", "c", "x", "who").agg(F.min("key").alias("key")).select(*_GROUP)
            hopeful = tmp.table(hopeful.join(single, _GROUP), "hopeful-once")
            tmp.drop("hopeful")
            sets_now = self.sets_of(hopeful.select("node").distinct(), "open-sets")
            more = by_group(hopeful.join(sets_now.hint("merge"), "node")).mapInPandas(_linked_within(percent), "a long, b long").distinct()
            links = links.union(tmp.table(more, "more-links"))
            labels = tmp.table(components(links, tmp, "classes"), "all-labels")
        member = owners.join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left")
        return member.join(labels, "node", "left").select(
            "doc", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc")).alias("component_id")
        )

    def _allowed(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """Pairs not too unlike in size whose points allow a link; points are joined only to those alike in size."""
        n = points.select("node", "n")
        sized = pairs.join(n.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
        sized = sized.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        x, y = (points.select(F.col("node").alias(c), F.col("point").alias(f"point_{c}")).hint("merge") for c in "ab")
        return sized.join(x, "a").join(y, "b").mapInPandas(_bounded(self.percent), "a long, b long")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the least id that links reach from it, itself included.

    Two documents link when 100 * shared >= percent * united shingles. With fewer words than a shingle has, the
    whole sequence is the one shingle. Texts that are null or without words have no shingles and link with
    nothing. Rows with a null id link with nothing either and get the class of an equal set, if there is one. Repeated
    rows come back as often as they stand; different texts under one id count as one document. An empty table gives an empty result; other columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return _Join(rows, words, percent).run().withColumnRenamed("doc", id_col)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, percent=85)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least id.

    Rows that repeat an id and its text are one. Rows without an id, and further texts of an id, take part under ids
    made from their text, above all others, so they stay only where their class has nothing else. Texts that are null
    or have no words link with nothing and stay, one row for an id. An empty table gives an empty one. Columns of any
    name pass through as they are.
    """
    plain, new = numbered(docs)
    doc, text = F.col(new["doc_id"]).cast("long"), F.col(new["text"])
    made = F.xxhash64(doc, text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    order = Window.partitionBy("id").orderBy(text)
    rows = plain.withColumn("id", F.coalesce(doc, made)).withColumns({"n": F.row_number().over(order), "last": F.lag(text).over(order)})
    rows = rows.filter((F.col("n") == 1) | ~text.eqNullSafe(F.col("last"))).withColumn("id", F.when(F.col("n") == 1, F.col("id")).otherwise(made)).drop("n", "last")
    rows = Scratch(spark, "near-stage").table(rows, "rows")
    first = near_classes(rows.select(F.col("id").alias("doc_id"), text.alias("text"))).filter("doc_id = component_id").select(F.col("doc_id").alias("id"))
    return rows.join(first, "id", "left_semi").select(*plain.columns).toDF(*docs.columns)
