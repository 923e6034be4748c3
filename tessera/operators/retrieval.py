"""Exact nearest neighbours, roll-up to documents, and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import scratch

#: Queries that are sent to all tasks at a time, and components of these (16 MB).
BLOCK, COMPONENTS = 2048, 1 << 21
#: Items that are held against queries at a time, and scores of the two (2 MB).
ITEMS, CELLS = 4096, 1 << 18
#: Scores are ranked as rounded here, so that equal vectors tie whatever the order of summation; ties go by id.
DIGITS = 9


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    sizes = vectors.value_lengths()
    if len(vectors) and pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError(f"vectors of {pc.min(sizes)} and {pc.max(sizes)}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _best(sent, k: int, metric: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        q = unit(q) if metric == "cosine" else q
        own = np.square(q).sum(1)
        # the best k so far: queries, scores, and ids by their place in the pool; and each query's k-th score, if it has that many
        slot, held, place, pool, bar = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None, np.full(len(q), np.nan)

        def take(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], part: pa.Array) -> None:
            nonlocal slot, held, place, pool
            r, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
            new, c = np.unique(c, return_inverse=True)
            ids = part.take(pa.array(new)) if pool is None else pa.concat_arrays([pool, part.take(pa.array(new))])
            slot, held, place = np.concatenate([slot, r]), np.concatenate([held, np.round(score, DIGITS)]), np.concatenate([place, c + len(ids) - len(new)])
            order = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
            by = np.lexsort((order[place], -held, slot))
            slot, held, place = slot[by], held[by], place[by]
            rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
            bar[slot[rank == k - 1]] = held[rank == k - 1]
            slot, held, place = (x[rank < k] for x in (slot, held, place))
            kept, place = np.unique(place, return_inverse=True)
            pool = ids.take(pa.array(kept))

        for batch in batches:
            step = max(1, min(ITEMS, CELLS // max(1, min(block, len(q)))))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                v, found, count = matrix(part.column(1)), [], 0
                v = unit(v) if metric == "cosine" else v
                for a in range(0, len(q), block):
                    b = a + block
                    score = q[a:b] @ v.T
                    if metric == "l2":
                        score = -(own[a:b, None] + np.square(v).sum(1)[None, :] - 2 * score)
                    low = bar[a:b]
                    if len(part) > k and np.isnan(low).any():
                        low = np.where(np.isnan(low), np.partition(score, len(part) - k, axis=1)[:, len(part) - k] if not np.isnan(score).any() else np.nan, low)
                    # what may be among the best as rounded; where nothing is known yet, all
                    r, c = np.nonzero(~(score < (low - 10.0**-DIGITS - 1e-12 * np.abs(low))[:, None]))
                    if len(r):
                        found.append((r + a, c, score[r, c]))
                        count += len(r)
                    if count > CELLS:
                        take(found, part.column(0))
                        found, count = [], 0
                if found:
                    take(found, part.column(0))
        if pool is not None:
            yield pa.RecordBatch.from_arrays([pa.array(slot), pool.take(pa.array(place)), pa.array(held)], names=["slot", "item_id", "score"])

    return run


def nearest(items: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", keep_self: bool = True, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, item_id, score): the exact best k; ``metric`` cosine or l2 (score: minus squared distance).

    ``items`` has item_id and vector, ``queries`` query_id and query_vector; ids are of any type that sorts. Queries are sent to
    all tasks up to ``BLOCK`` at a time, and scored ``block`` at a time there; items stay where they are, a task keeps the best k of
    what it reads for each query, and only those are shuffled. A task holds the queries sent, their best and ``CELLS`` scores, however many items and queries there are. Ties go to the lesser id, no id last. Items without a vector are not found, queries without
    one find nothing; vectors of different lengths are an error. Rows are taken as they stand: an item that stands twice is found
    twice, a query that stands twice is answered twice.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    spark = items.sparkSession
    want = k if keep_self else k + 1
    vector = lambda c: F.col(c).cast("array<double>").alias(c)
    items = items.select("item_id", vector("vector")).filter("vector is not null")
    asked = queries.select("query_id", vector("query_vector")).filter("query_vector is not null")
    path = scratch(spark, "queries")
    asked.write.parquet(f"{path}/all")
    asked = spark.read.schema(asked.schema).parquet(f"{path}/all")
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).first()
    rows = max(1, min(max(block, BLOCK), COMPONENTS // max(longest or 1, 1)))
    # no file holds more than is sent at a time
    asked.repartition(max(1, -(-n // rows))).write.option("maxRecordsPerFile", rows).parquet(f"{path}/blocks")
    kinds = items.schema["item_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    found, files = None, sorted(spark.read.schema(asked.schema).parquet(f"{path}/blocks").inputFiles())
    for file in files:
        own = spark.read.schema(asked.schema).parquet(file).toArrow().combine_chunks()
        if not len(own):
            continue
        sent = spark.sparkContext.broadcast(matrix(own.column("query_vector").combine_chunks()))
        hits = items.mapInArrow(_best(sent, want, metric, block), f"slot long, item_id {kinds[0]}, score double")
        named = spark.createDataFrame(pa.table({"_slot": np.arange(len(own)), "query_id": own.column("query_id")}))
        hits = hits.join(F.broadcast(named), F.col("slot") == F.col("_slot")).drop("_slot")
        if not keep_self:
            hits = hits.filter(~F.col("query_id").eqNullSafe(F.col("item_id")))
        order = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("item_id").asc_nulls_last())
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")
        if len(files) > 1:  # a block's vectors stay in memory no longer than its turn
            hits.write.mode("append").parquet(f"{path}/hits")
            sent.destroy()
            hits = spark.read.schema(hits.schema).parquet(f"{path}/hits")
        found = hits
    return found if found is not None else spark.createDataFrame([], f"query_id {kinds[1]}, rank int, item_id {kinds[0]}, score double")


def roll_up(hits: DataFrame, doc_of: DataFrame | None = None) -> DataFrame:
    """Chunk hits to documents: best score and first rank, ranked by score, first rank, id."""
    rows = hits.join(doc_of, "item_id") if doc_of is not None else hits
    docs = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank", "doc_id")
    return docs.withColumn("rank", F.row_number().over(order))


def query_metrics(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query and k: precision, recall, f1, dcg and ndcg.

    ``ranked`` has query_id, rank, doc_id; ``gold`` has query_id, doc_id and stands for all queries to be judged,
    a null doc_id for one without relevant documents. Precision divides by k, not by what was found.
    """
    sizes = gold.groupBy("query_id").agg(F.count("doc_id").alias("g"))
    hits = ranked.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).select("query_id", "rank")
    top = max(ks)
    gains = hits.filter(F.col("rank") <= top).groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
    return metrics_from_ranks(sizes.join(gains, "query_id", "left"), ks)


def metrics_from_ranks(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The metrics of rows query_id, g (how many documents are relevant) and ranks (where some of them were found)."""
    none = F.array().cast("array<int>")
    rows = rows.withColumn("ranks", F.array_sort(F.coalesce("ranks", none))).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.filter("ranks", lambda r: r <= F.col("k"))
    tp = F.size(inside)
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    best = F.least(F.col("g").cast("int"), F.col("k"))
    ideal = F.when(best > 0, gain(F.sequence(F.lit(1), best)))
    p, r = tp / F.col("k"), F.when(F.col("g") > 0, tp / F.col("g")).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return rows.select("query_id", "k", p.alias("precision"), r.alias("recall"), f1.alias("f1"), gain(inside).alias("dcg"), F.coalesce(gain(inside) / ideal, F.lit(0.0)).alias("ndcg"))


def macro_metrics(per_query: DataFrame) -> DataFrame:
    names = ("precision", "recall", "f1", "dcg", "ndcg")
    return per_query.groupBy("k").agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("num_queries"))


def positive_qrels(qrels: DataFrame) -> DataFrame:
    return qrels.filter(F.col("relevance") > 0)


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with judgements, in file order."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def missing_keys(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key), key, "left_anti")
