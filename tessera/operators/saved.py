"""Tables laid out by document, so that what is kept of a document meets it again without a shuffle."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators import chunk as C


def save(rows: DataFrame, path: str, buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``rows`` in buckets by doc_id, each sorted by doc_id and ``order``; returns the table.

    Tables that are to meet need the same number of buckets. ``path``-layout keeps what ``load`` needs in another session.
    """
    spark, name = rows.sparkSession, f"saved_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "doc_id").sortBy("doc_id", *order).mode("overwrite").option("path", path).saveAsTable(name)
    layout = [(rows.schema.json(), buckets, json.dumps(order))]
    spark.createDataFrame(layout, "schema string, buckets int, sorted string").coalesce(1).write.mode("overwrite").json(f"{path}-layout")
    return spark.table(name)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``save`` wrote, perhaps in another session: its files are used where they lie."""
    found, name = spark.read.json(f"{path}-layout").first(), f"saved_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(found.schema)))
    order = ", ".join(f"`{c}`" for c in ("doc_id", *json.loads(found.sorted)))
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`doc_id`) SORTED BY ({order}) INTO {found.buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def with_saved_sentences(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, …) with ``sentences``: those of ``units`` (doc_id, sentence_idx, text) where it has the document,
    else its text split anew.

    Tables of ``save`` with as many buckets meet bucket by bucket: neither is shuffled. A document without id, or with
    only blank text, has no saved sentences; rows of one id all get those of that id.
    """
    own = units.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", "text"))), lambda x: x["text"]).alias("_saved"))
    both = docs.join(own.hint("merge"), "doc_id", "left")
    return both.withColumn("sentences", F.coalesce("_saved", T.sentences(F.col("text")))).drop("_saved")


def chunks_from_saved(docs: DataFrame, units: DataFrame, n_chunks: int = 5, overlap: int = 0) -> DataFrame:
    """(doc_id, position, chunk_id, …): fixed chunks of saved units, going on where some documents have none yet."""
    return C.explode_chunks(with_saved_sentences(docs, units), C.fixed_chunks(F.col("sentences"), n_chunks, overlap))
