"""Result files of many runs, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.reporting import union_rows


def read_results(spark: SparkSession, paths: list[str], numbers: tuple[str, ...] = ("k", "precision", "recall", "f1", "dcg", "ndcg")) -> DataFrame:
    """CSV files with headers of their own, united by name, with where each row comes from.

    What is no number in a number's column is null; a missing status is blank.
    """
    parts = [spark.read.csv(p, header=True).withColumn("source_csv", F.col("_metadata.file_path")) for p in paths]
    rows = union_rows(*parts)
    stem = F.regexp_replace(F.regexp_replace("source_csv", r"^.*/", ""), r"\.csv$", "")
    rows = rows.withColumns({"source_stem": stem} | {n: F.col(n).try_cast("double") for n in numbers if n in rows.columns})
    return rows.withColumn("status", F.coalesce("status", F.lit("")) if "status" in rows.columns else F.lit(""))


def write_results(rows: DataFrame, path: str) -> None:
    """Writes result rows; none at all are an error, and nothing is written."""
    if rows.isEmpty():
        raise ValueError("there are no results to write")
    rows.write.mode("overwrite").csv(path, header=True)
