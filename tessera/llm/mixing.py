"""Operator 10: mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 36-bit hash. Per source, words are summed by the hash's leading bits;
the running sum finds the bucket in which the source's budget runs out; only that bucket's documents
are summed again by the next bits. After three such levels the budget is a threshold on the hash, and
the mix is a filter: nothing is sorted, and a larger budget always keeps what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, numbered

LEVELS, BITS = 3, 12
#: Per-source tables of up to this many rows (some 60 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: So are the hashes of repeated rows (8 bytes each).
BROADCAST_REPEATS = 1_000_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """Adds ``target``: shares by weight of all words, held at ``max_repeats`` times the source's own.

    Sources in order of the ratio cap/weight fill up one after the other; with the first i capped, the
    rest share what is left at the level (total - caps) / weights. That level rises while sources cap
    and falls after, so its maximum is the final one. The windows run over one row per source.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((at - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def _with_source(docs: DataFrame, per_source: DataFrame, few: bool, how: str = "left") -> DataFrame:
    right = per_source.withColumnRenamed("source", "_source")
    return docs.join(F.broadcast(right) if few else right, docs["_mix_source"].eqNullSafe(right["_source"]), how).drop("_source")


def with_keys(sized: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """``sized`` with ``_mix_key`` for ``_mix_hash``, and its columns that sums need, written.

    The key is the hash's leading bits. Rows that share a hash would be taken all together; they, and no others, are
    written out, and their place in that table is hashed into their keys.
    """
    narrow = tmp.table(sized.select("_mix_source", "size", "_mix_hash"), "sizes")
    repeats = narrow.groupBy("_mix_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("_mix_hash")
    repeats = tmp.table(repeats, "repeats")
    n = repeats.count()
    keyed = lambda df, whole: df.withColumn("_mix_key", F.shiftrightunsigned(whole, 64 - LEVELS * BITS)).drop("_mix_hash")
    if not n:
        return keyed(sized, F.col("_mix_hash")), keyed(narrow, F.col("_mix_hash"))
    repeats = F.broadcast(repeats) if n <= BROADCAST_REPEATS else repeats
    again = tmp.table(sized.join(repeats, "_mix_hash", "left_semi"), "again")
    again = keyed(again, F.xxhash64("_mix_hash", F.monotonically_increasing_id()))
    once = lambda df: keyed(df.join(repeats, "_mix_hash", "left_anti"), F.col("_mix_hash"))
    return once(sized).unionByName(again), tmp.table(once(narrow).unionByName(again.select("_mix_source", "size", "_mix_key")), "keys")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    seed: int = 20,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    A source whose target is q whole times its words plus a rest takes every document q times, and once
    more each document whose hash lies under the threshold that the rest allows. Null text has size 0;
    null source is a source of its own, last in order; an empty table gives an empty result. A row's hash is that of its
    id (null too) and text; rows alike in both are told apart by their place, so how many of them are taken
    may change with how the input is read, but not how near a source comes to its target.
    Columns of ``docs`` named like the four new ones are replaced; all others pass.
    """
    old, (docs, new) = docs.columns, numbered(docs)
    id_col, text_col, source_col = new[id_col], new[text_col], new[source_col]
    spark = docs.sparkSession
    tmp = Scratch(spark, "mix")
    row_hash = F.xxhash64(F.lit(seed), F.col(id_col), F.col(id_col).isNull(), F.col(text_col))
    sized = docs.withColumns({"_mix_source": F.col(source_col), "size": word_count(F.col(text_col)), "_mix_hash": row_hash})
    sized, narrow = with_keys(sized, tmp)
    per_source = narrow.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = tmp.table(
        targets.withColumn("whole", whole).withColumns({"rest": F.col("target") - F.col("whole") * F.col("source_size"), "prefix": F.lit(0).cast("long")}), "targets"
    )
    few = state.count() <= BROADCAST_SOURCES
    for i in range(LEVELS):
        below = (LEVELS - 1 - i) * BITS
        inside = _with_source(narrow, state.select("source", "prefix", "rest"), few, "inner").filter(F.shiftright("_mix_key", below + BITS) == F.col("prefix"))
        sums = inside.groupBy(F.col("_mix_source").alias("source"), F.shiftright("_mix_key", below).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run)).join(state.select(F.col("source").alias("_s"), F.col("rest").alias("_rest")), F.col("source").eqNullSafe(F.col("_s")))
        # the first bucket that would overrun the rest, and what the buckets before it hold; none: all of them fit
        edge = sums.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("_rest"), F.col("bucket"))).alias("edge"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("_rest"), F.col("upto"))), F.lit(0)).alias("before"),
            F.min(F.when(F.col("upto") > F.col("_rest"), F.col("upto"))).alias("over"),
        )
        last = i == LEVELS - 1
        nothing_over = (F.col("prefix") + 1) * (1 << BITS)
        # below the last level a threshold lies between buckets: the nearer side of the budget is taken
        nearer = F.when(F.lit(last) & (F.col("over") - F.col("rest") < F.col("rest") - F.col("before")), 1).otherwise(0)
        state = tmp.table(
            state.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source",
                "source_size",
                "target",
                "whole",
                (F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest"),
                F.coalesce(F.col("edge") + nearer, F.when(F.lit(last), nothing_over).otherwise(nothing_over - 1)).cast("long").alias("prefix"),
            ),
            f"level{i}",
        )
    ends = state.select("source", "source_size", "target", "whole", F.col("prefix").alias("_threshold"))
    extra = F.when((F.col("whole") < max_repeats) & (F.col("_mix_key") < F.col("_threshold")), 1).otherwise(0)
    made = ("size", "source_size", "target", "copies")
    mixed = _with_source(sized, ends, few).withColumn("copies", (F.col("whole") + extra).cast("long"))
    return mixed.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(old) if c not in made], *made)


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that is taken n times stands there n times.

    Null and empty texts have no words, so they cost nothing: they stay as often as their source's whole rounds say.
    A null source is a source. An empty table gives an empty one. Columns of any name
    pass through as they are.
    """
    plain, new = numbered(docs)
    mixed = mix_sources(plain, id_col=new["doc_id"], text_col=new["text"], source_col=new["source"]).filter(F.col("copies") > 0)
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*plain.columns).toDF(*docs.columns)
