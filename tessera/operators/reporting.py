"""Results of many runs: methods, pivots, best runs, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.split import with_running_starts

#: The first of these marks in a run's name decides its method.
METHOD_MARKS = (
    ("DBSCAN", "clustering", "clustering_dbscan"),
    ("SLINK", "clustering", "clustering_single_linkage"),
    ("SINGLE_LINKAGE", "clustering", "clustering_single_linkage"),
    ("FIXED", "fixed", "fixed"),
    ("BREAK", "semantic_breakpoint", "semantic_breakpoint"),
    ("CLUSTER", "clustering", "clustering_unknown"),
)
SKIPPED = ("skipped", "failed", "interrupted")


def infer_method(stem: Column, chunking: Column) -> Column:
    """(macro, variant) by the first mark in name and chunking; else the chunking itself, or unknown."""
    hint = F.upper(F.concat_ws(" ", stem, chunking))
    own = F.coalesce(F.nullif(F.lower(F.trim(chunking)), F.lit("")), F.lit("unknown"))
    out = F.struct(own.alias("macro"), own.alias("variant"))
    for mark, macro, variant in reversed(METHOD_MARKS):
        out = F.when(F.instr(hint, mark) > 0, F.struct(F.lit(macro).alias("macro"), F.lit(variant).alias("variant"))).otherwise(out)
    return out


def usable(rows: DataFrame) -> DataFrame:
    """Without skipped, failed and interrupted rows; blank and partial ones stay."""
    return rows.filter(~F.coalesce(F.lower(F.trim("status")), F.lit("")).isin(*SKIPPED))


def pivot_by_k(rows: DataFrame, ids: list[str], metrics: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row per run, columns ``metric@k`` (means). Null ids are filled with '', so no run is lost."""
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids})
    cells = [F.avg(F.when(F.col("k") == k, F.col(m))).alias(f"{m}@{k}") for m in metrics for k in ks]
    return filled.groupBy(*ids).agg(*cells)


def best_per_method(wide: DataFrame, method: str, run: str, metrics: list[str]) -> DataFrame:
    """Per method the greatest value of each metric and the run that has it; ties to the first name, none to ''."""
    cells = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(f"`{m}`")), F.col(f"`{m}`"))
        cells += [F.max(v).alias(m), F.coalesce(F.min_by(F.col(run), F.when(v.isNotNull(), F.struct(-v, F.col(run)))), F.lit("")).alias(f"{m} run")]
    return wide.groupBy(method).agg(*cells)


def box_stats(rows: DataFrame, method: str, value: str) -> DataFrame:
    """Five numbers and the count by method; clustering variants also pooled as clustering_all.

    Exact percentiles hold a method's values in one task: meant for results of runs, not for documents.
    """
    pooled = rows.filter(F.col(method).startswith("clustering_")).withColumn(method, F.lit("clustering_all"))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    both = rows.select(method, value).union(pooled.select(method, value))
    return both.groupBy(method).agg(F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high"), F.count(value).alias("n")).select(
        method, "low", F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("q3"), "high", "n"
    )


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name in order of first appearance; what a frame lacks is null."""
    if not frames:
        raise ValueError("nothing to unite")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def merge_lists(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Distinct values of array ``value`` per key, in order of first appearance."""
    each = rows.select(*keys, order, F.posexplode(value).alias("_at", "_v"))
    first = each.groupBy(*keys, "_v").agg(F.min(F.struct(order, "_at")).alias("_first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_v"))), lambda x: x["_v"]).alias(value))


def running_mean(rows: DataFrame, order: str, value: str, window: int) -> DataFrame:
    """(window, n, total, mean): sums after each window of ``window`` ids, as a stream over them would have.

    No window function runs over all rows: see ``split.with_running_starts``.
    """
    sums = rows.groupBy(F.floor(F.col(order) / window).alias("window")).agg(F.count(value).alias("_own_n"), F.sum(value).cast("long").alias("_own_t"))
    both = with_running_starts(sums, {"_before_n": F.col("_own_n"), "_before_t": F.col("_own_t")}, "window")
    done = both.select("window", (F.col("_before_n") + F.col("_own_n")).alias("n"), (F.col("_before_t") + F.col("_own_t")).alias("total"))
    return done.withColumn("mean", F.col("total") / F.col("n"))


def coverage(rows: DataFrame, value: str) -> DataFrame:
    """(n, filled): rows, and those whose ``value`` (a text or an array of texts) is not empty."""
    array = dict(rows.dtypes)[value].startswith("array")
    filled = F.size(F.filter(value, lambda x: F.trim(x) != "")) > 0 if array else F.trim(value) != ""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("filled"))


def write_intrinsic(per_document: DataFrame, names: list[str], path: str) -> None:
    """Scores by document and over all of them, as JSON under ``documents`` and ``global``."""
    from tessera.operators.intrinsic import global_stats

    per_document.write.mode("overwrite").json(f"{path}/documents")
    global_stats(per_document, names).write.mode("overwrite").json(f"{path}/global")


def write_summary(wide: DataFrame, best: DataFrame, path: str) -> None:
    """All runs, the best by method, and a manifest of both, as CSV."""
    spark = wide.sparkSession
    for name, rows in (("all_runs", wide), ("best_per_method", best)):
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)
    listed = [(name, f"{path}/{name}", spark.read.csv(f"{path}/{name}", header=True).count()) for name in ("all_runs", "best_per_method")]
    spark.createDataFrame(listed, "name string, path string, n_rows long").write.mode("overwrite").csv(f"{path}/manifest", header=True)
