"""Which outputs a set of configurations should have left, and which are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def combinations(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """A row for each combination of the axes' values, in columns named like the axes."""
    if not axes or any(not v for v in axes.values()):
        raise ValueError("every axis needs a value")
    out = spark.createDataFrame([tuple(axes.values())], list(axes))
    for name in axes:
        out = out.withColumn(name, F.explode(name))
    return out


def outputs(spark: SparkSession, root: str, levels: tuple[str, ...]) -> DataFrame:
    """(…levels, files, n_rows): CSV outputs under ``root``/<level 1>/<level 2>/…, a folder each, with headers.

    Files come from a listing, of which the driver holds the names; their contents are read to count rows. Blank lines are no rows. Folders deeper than that, hidden files and other
    endings are not looked at.
    """
    glob = "/".join([root.rstrip("/"), *["*"] * len(levels)])
    parts = F.split(F.regexp_replace(F.col("path"), r"/[^/]*$", ""), "/")
    at = {name: F.element_at(parts, i - len(levels)) for i, name in enumerate(levels)}
    texts = spark.read.option("pathGlobFilter", "*.csv").text(glob)
    # a scan would leave out files of no bytes, which are those that matter here
    listed = spark.createDataFrame([(x,) for x in texts.inputFiles()], "path string").withColumns(at)
    sizes = listed.groupBy(*levels).agg(F.count(F.lit(1)).alias("files"))
    lines = texts.select(F.col("_metadata.file_path").alias("path"), "value").filter("trim(value) <> ''")
    counted = lines.groupBy("path").agg((F.count(F.lit(1)) - 1).alias("n")).withColumns(at)  # but for the header
    rows = counted.groupBy(*levels).agg(F.sum("n").alias("n_rows"))
    return sizes.join(rows, list(levels), "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Every output that is expected or found: (…columns of ``expected``, n_rows, state).

    The state is complete, empty (no rows), missing, or unexpected. Columns are compared as text.
    """
    keys = expected.columns
    a = expected.select(*[F.col(c).cast("string").alias(c) for c in keys], F.lit(True).alias("_wanted")).distinct()
    b = found.select(*[F.col(c).cast("string").alias(c) for c in keys], "n_rows", F.lit(True).alias("_there"))
    state = F.when(F.col("_wanted").isNull(), "unexpected").when(F.col("_there").isNull(), "missing").when(F.col("n_rows") == 0, "empty").otherwise("complete")
    return a.join(b, keys, "full").select(*keys, "n_rows", state.alias("state"))
