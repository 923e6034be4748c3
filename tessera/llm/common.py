"""What the operators of this subpackage share: written intermediate tables and fixed text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Without that setting a folder is made up only where all runs on one machine (``local`` masters); on a cluster
    such a folder would not be seen by the executors, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run, written as Parquet to the shared folder.

    Writing cuts the lineage: a lost executor costs the tasks it ran, never the stages before
    the last written table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @contextmanager
    def shuffles_dropped(self) -> Iterator[None]:
        """What is written meanwhile leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            yield
        finally:
            if before is None:
                conf.unset(key)
            else:
                conf.set(key, before)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        # no success marker: the table is read only after the write has returned
        with self.shuffles_dropped():
            df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """A table in buckets by ``column``: joins on it shuffle the other side alone."""
        known = f"scratch_{uuid.uuid4().hex}"
        with self.shuffles_dropped():
            df.write.bucketBy(buckets, column).sortBy(column).mode("overwrite").option("path", self.path(name)).saveAsTable(known)
        return self.spark.table(known)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table written before."""
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def map_text(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], dict[str, Any]]], fields: str, rows: int = 256, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text column (unless ``keep_text``), plus ``fields`` worked out from the texts, ``rows`` at a time.

    ``make`` is called once a task and gives a function from texts to columns. All other columns pass through as
    Arrow data: no id goes through a float, whatever nulls stand beside it. Columns of ``docs`` named like a field
    give way to it.
    """
    added = StructType.fromDDL(fields)
    kept = [f for f in docs.schema.fields if (keep_text or f.name != text_col) and f.name not in added.names]
    schema = StructType(kept + added.fields)
    arrow = to_arrow_schema(added)
    columns = [F.col(f"`{f.name}`") for f in kept]
    read = [f.name for f in kept].index(text_col) if keep_text else len(kept)
    texts = docs.select(*columns) if keep_text else docs.select(*columns, F.col(f"`{text_col}`").alias("_map_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                made = work(part.column(read).to_pylist())
                new = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], names=schema.names)

    return texts.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named by their place, and the new name of each old one.

    Stages work on such names, so that no column of the input is taken for one of theirs; ``toDF(*docs.columns)``
    gives the old names back.
    """
    new = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new, strict=True))
