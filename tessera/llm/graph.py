"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(links: DataFrame, tmp: Scratch, name: str = "components") -> DataFrame:
    """(a, b) to (node, component): the least node that each linked node reaches.

    Each round joins every node to its least neighbour and hangs its other neighbours there, until nothing
    moves: a few rounds, logarithmic in the longest path. Rounds are written tables, and so are the least neighbours:
    a join of two tables lets Spark split a hub's rows. Nodes without links are absent; self-links and repeated links do no harm.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, last, i = tmp.table(edges, f"{name}0"), None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = tmp.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{i}-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = tmp.table(large, f"{name}{i}-large")
        low = tmp.table(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{name}{i}-low")
        small = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        edges = tmp.table(small.distinct(), f"{name}{i + 1}")
        for part in ("", "-least", "-large", "-low"):
            tmp.drop(f"{name}{i}{part}")
        i += 1
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
