"""Chunk scores by a scorer of one's own: perplexities of texts, plain and given another text, each worked out once.

A scorer is a function of two lists, texts and what each is given (nothing, for none), to perplexities. It is made once a
task and called on some hundred pairs at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import scratch

Scorer = Callable[[list[str], list[str | None]], list[float]]
#: Pairs that a scorer gets at a time.
PAIRS = 256
STORED = "model string, digest string, perplexity double"

_TOKEN = re.compile(r"\w+")


def lexical() -> Scorer:
    """Token entropy as a perplexity, lowered by half the share of distinct tokens that the given text has."""

    def alone(text: str) -> tuple[float, set[str]]:
        counts = Counter(_TOKEN.findall(text.lower()))
        n = counts.total()
        return math.exp(-sum(c / n * math.log(c / n) for c in counts.values())), set(counts)

    def score(texts: list[str], given: list[str | None]) -> list[float]:
        known: dict[str, tuple[float, set[str]]] = {}  # a call has many pairs of the same texts
        for t in {*texts, *(g or "" for g in given)}:
            known[t] = alone(t)
        out = []
        for t, g in zip(texts, given, strict=True):
            (plain, own), other = known[t], known[g or ""][1]
            out.append(1.0 if not own else max(1e-6, plain * (1 - 0.5 * len(own & other) / len(own))) if other else plain)
        return out

    return score


def _digest(target: Column, given: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.length(target), target, F.when(given.isNull(), "0").otherwise("1"), given), 256)


def perplexities(pairs: DataFrame, make: Callable[[], Scorer], model: str, cache: str | None = None) -> DataFrame:
    """``pairs`` (with ``target`` and ``given``, null for none) plus ``perplexity``.

    Equal pairs are scored once. ``cache`` is a folder of Parquet files with the perplexities by model and digest of the
    pair, made at need: pairs that it has are not scored again, others are added. A null target is empty.
    """
    spark = pairs.sparkSession
    cache = cache or scratch(spark, "scores")
    keyed = pairs.withColumn("target", F.coalesce("target", F.lit(""))).withColumn("_digest", _digest(F.col("target"), F.col("given")))
    spark.createDataFrame([], STORED).write.mode("append").parquet(cache)
    stored = spark.read.schema(STORED).parquet(cache).filter(F.col("model") == model)
    misses = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first("target").alias("target"), F.first("given").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for at in range(0, len(batch), PAIRS):
                part = batch.slice(at, PAIRS)
                found = score(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(part)), part.column(0), pa.array([float(x) for x in found], pa.float64())], names=["model", "digest", "perplexity"])

    misses.join(stored.select("digest"), "digest", "left_anti").mapInArrow(run, STORED).write.mode("append").parquet(cache)
    known = spark.read.schema(STORED).parquet(cache).filter(F.col("model") == model).groupBy(F.col("digest").alias("_digest")).agg(F.max("perplexity").alias("perplexity"))
    return keyed.join(known, "_digest").drop("_digest")


def _both(docs: DataFrame, pairs: Column, make: Callable[[], Scorer], model: str, id_col: str, texts_col: str, cache: str | None) -> DataFrame:
    """Rows (doc, i, j, plain, cond): for a document's ``pairs``, an array of (i, j), the perplexity of text i without and given text j.

    Only digests are dealt by their value; a document's texts are sent once, to what is to be scored of them.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "scores")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(texts_col).alias("t"))
    text = lambda k: F.coalesce(F.get("t", k), F.lit(""))
    alone = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["i"])), lambda i: F.struct(i.alias("i"), F.lit(None).cast("int").alias("j")))
    digests = F.transform(F.concat(pairs, alone), lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), _digest(text(p["i"]), F.when(p["j"].isNotNull(), text(p["j"]))).alias("digest")))
    asked = scratch(spark, "scored-pairs")
    rows.select("doc", F.explode_outer(digests).alias("p")).select("doc", "p.*").filter("digest is not null").write.parquet(asked)
    keyed = spark.read.parquet(asked)
    spark.createDataFrame([], STORED).write.mode("append").parquet(cache)
    stored = spark.read.schema(STORED).parquet(cache).filter(F.col("model") == model)
    misses = keyed.groupBy("digest").agg(F.min(F.struct("doc", "i", "j")).alias("p")).join(stored.select("digest"), "digest", "left_anti")
    wanted = misses.groupBy(F.col("p.doc").alias("of")).agg(F.collect_list(F.struct("digest", "p.i", "p.j")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        held: list[tuple[str, str, str | None]] = []

        def scored(part: list[tuple[str, str, str | None]]) -> pa.RecordBatch:
            found = score([x[1] for x in part], [x[2] for x in part])
            return pa.RecordBatch.from_arrays([pa.array([model] * len(part)), pa.array([x[0] for x in part]), pa.array([float(x) for x in found], pa.float64())], names=["model", "digest", "perplexity"])

        for batch in batches:
            for k in range(len(batch)):
                t = batch.column(0)[k].as_py()
                held += [(w["digest"], t[w["i"]] or "", None if w["j"] is None else t[w["j"]] or "") for w in batch.column(1)[k].as_py()]
                while len(held) >= PAIRS:
                    yield scored(held[:PAIRS])
                    held = held[PAIRS:]
        if held:
            yield scored(held)

    rows.join(wanted.hint("merge"), F.col("doc").eqNullSafe(F.col("of"))).select("t", "wanted").mapInArrow(run, STORED).write.mode("append").parquet(cache)
    known = spark.read.schema(STORED).parquet(cache).filter(F.col("model") == model).groupBy("digest").agg(F.max("perplexity").alias("cond"))
    plain = F.max(F.when(F.col("j").isNull(), F.col("cond"))).over(Window.partitionBy("doc", "i"))
    return keyed.join(known, "digest").repartition("doc").select("doc", "i", "j", plain.alias("plain"), "cond").filter("j is not null")


def boundary_clarity(docs: DataFrame, make: Callable[[], Scorer], model: str, *, id_col: str = "doc_id", texts_col: str = "texts", cache: str | None = None) -> DataFrame:
    """(id, boundary_clarity): the mean over neighbours of a chunk's perplexity given the one before, by its own; 1 without any.

    ``texts_col`` holds a document's chunk texts. Ids must differ.
    """
    at = _range(F.lit(1), F.size("t") - 1)
    pairs = F.transform(at, lambda i: F.struct(i.alias("i"), (i - 1).alias("j")))
    found = _both(docs, pairs, make, model, id_col, texts_col, cache).filter("plain > 0").groupBy("doc").agg(F.avg(F.col("cond") / F.col("plain")).alias("b"))
    return docs.select(F.col(id_col)).join(found, F.col(id_col).eqNullSafe(F.col("doc")), "left").select(id_col, F.coalesce("b", F.lit(1.0)).alias("boundary_clarity"))


def _range(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def stickiness(docs: DataFrame, make: Callable[[], Scorer], model: str, *, threshold: float = 0.8, delta: int = 0, id_col: str = "doc_id", texts_col: str = "texts", cache: str | None = None) -> DataFrame:
    """(id, complete, complete_edges, incomplete, incomplete_edges): structural entropy (base 2) of the graph of chunks i < j by its nodes' degrees.

    An edge's weight is by which share i's perplexity falls given j, within 0 and 1; it stands from ``threshold`` on. Incomplete
    graphs have the edges between chunks more than ``delta`` apart. All pairs of a document's chunks are scored. Ids must differ.
    """
    n = F.size("t")
    pairs = F.flatten(F.transform(_range(F.lit(0), n - 2), lambda i: F.transform(_range(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("plain") - F.col("cond")) / F.col("plain")))
    edges = _both(docs, pairs, make, model, id_col, texts_col, cache).filter((F.col("plain") > 0) & (share >= max(0.0, min(1.0, threshold))))
    ends = edges.select("doc", (F.col("j") - F.col("i") > delta).alias("far"), F.explode(F.array("i", "j")).alias("node"))
    degrees = ends.groupBy("doc", "node").agg(F.count(F.lit(1)).alias("complete"), F.count_if("far").alias("incomplete"))
    names = ("complete", "incomplete")
    whole = degrees.groupBy("doc").agg(*[x for c in names for x in (F.sum(c).alias(f"{c}_m"), F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c))).alias(f"{c}_l"))])
    entropy = lambda c: F.when(F.col(f"{c}_m") > 0, F.log2(f"{c}_m") - F.col(f"{c}_l") / F.col(f"{c}_m")).alias(c)
    found = whole.select("doc", *[x for c in names for x in (entropy(c), (F.col(f"{c}_m") / 2).alias(f"{c}_edges"))])
    out = docs.select(F.col(id_col)).join(found, F.col(id_col).eqNullSafe(F.col("doc")), "left").drop("doc")
    return out.fillna(0.0, ["complete", "complete_edges", "incomplete", "incomplete_edges"])
