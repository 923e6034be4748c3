"""Scores of a chunking by itself. Chunk tokens stay in the document's row; nothing is shuffled but the averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def token_sets(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.array_distinct(T.words(c["text"])))


def conditional_perplexity(own: Column, context: Column, ppl: Column) -> Column:
    """Perplexity lowered by half the share of distinct tokens that the context has."""
    shared = F.size(F.array_intersect(own, context)) / F.when(F.size(own) > 0, F.size(own))
    return F.when(F.size(context) == 0, ppl).otherwise(F.greatest(F.lit(1e-6), ppl * (1 - 0.5 * F.coalesce(shared, F.lit(0.0)))))


def boundary_clarity(sets: Column) -> Column:
    """Mean over neighbours of conditional over plain perplexity of the right one; 1 below two chunks.

    With the token model the ratio is 1 - half the share of the right one's tokens that the left one has.
    """
    right = F.slice(sets, F.lit(2), F.greatest(F.size(sets) - 1, F.lit(0)))
    ratio = F.transform(right, lambda r, i: F.when((F.size(r) == 0) | (F.size(F.get(sets, i)) == 0), F.lit(1.0)).otherwise(1 - 0.5 * F.size(F.array_intersect(r, F.get(sets, i))) / F.size(r)))
    return F.when(F.size(sets) < 2, F.lit(1.0)).otherwise(F.aggregate(ratio, F.lit(0.0), lambda a, x: a + x) / (F.size(sets) - 1))


def stickiness(sets: Column, threshold: float = 0.8, delta: int | None = None) -> Column:
    """Structural entropy (base 2, unweighted degrees) of the graph of chunks i < j whose weight reaches ``threshold``.

    The weight is half the share of i's distinct tokens that j has. With ``delta`` only pairs farther apart count.
    """
    n = F.size(sets)
    weight = lambda a, b: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(0.5 * F.size(F.array_intersect(a, b)) / F.size(a))
    # by pair (least place first), 1 for an edge
    edge = lambda i, j: F.when((F.abs(i - j) > (0 if delta is None else delta)) & (weight(F.get(sets, F.least(i, j)), F.get(sets, F.greatest(i, j))) >= threshold), 1).otherwise(0)
    degree = F.transform(sets, lambda _, i: F.aggregate(F.transform(sets, lambda __, j: F.when(i == j, 0).otherwise(edge(i, j))), F.lit(0), lambda a, x: a + x))
    return F.when(n < 2, F.lit(0.0)).otherwise(
        F.aggregate(
            degree,
            F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("log")),
            lambda a, d: F.struct((a["sum"] + d).alias("sum"), (a["log"] + F.when(d > 0, d * F.log2(d.cast("double"))).otherwise(0.0)).alias("log")),
            lambda a: F.when(a["sum"] > 0, F.log2(a["sum"]) - a["log"] / a["sum"]).otherwise(F.lit(0.0)),
        )
    )


def chunk_stats(chunks: Column) -> dict[str, Column]:
    """Characters and words per chunk, 0 without chunks."""
    per = lambda f: F.when(F.size(chunks) > 0, F.aggregate(F.transform(chunks, lambda c: f(c["text"]).cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size(chunks)).otherwise(F.lit(0.0))
    return {"num_chunks": F.size(chunks), "avg_chars": per(F.length), "avg_words": per(lambda t: F.size(T.words(t)))}


def global_stats(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, min, max, variance of the population) over documents."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.var_pop("v").alias("variance"))
