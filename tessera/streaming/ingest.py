"""Documents in windows: Structured Streaming over files or a JSON-line corpus, with state that goes on from window to window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import chunk as C
from tessera.operators import intrinsic as I
from tessera.operators import split as S
from tessera.plans import plugs
from tessera.streaming import source as corpora

STATE = "next_unit long, num_docs long, num_sentences long, num_chunks long, clarity_sum double"


def measure(docs: DataFrame, n_chunks: int = 5) -> DataFrame:
    """Per document: sentences, chunks and boundary clarity. ``docs`` may have its ``sentences`` already."""
    rows = (docs if "sentences" in docs.columns else S.with_sentences(docs)).withColumn("chunks", C.fixed_chunks(F.col("sentences"), n_chunks)).withColumn("sets", I.token_sets(F.col("chunks")))
    return rows.select("doc_id", F.size("sentences").alias("num_sentences"), F.size("chunks").alias("num_chunks"), I.boundary_clarity(F.col("sets")).alias("boundary_clarity"))


def lay_out(docs: DataFrame, path: str, docs_per_window: int) -> None:
    """Writes documents, in order of id, as one file for every ``docs_per_window`` of them, for ``ingest`` to read.

    Ids of any type; windows are numbered on from those that are there.
    """
    if isinstance(docs_per_window, bool) or docs_per_window < 1:
        raise ValueError("docs_per_window must be a positive whole number")
    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    first = max([int(x.removeprefix("window=")) + 1 for x in there if x.startswith("window=")], default=0)
    numbered = S.with_running_start(docs.select("doc_id", "text"), F.lit(1), out="_ord")
    windows = numbered.select("doc_id", "text", (F.floor(F.col("_ord") / docs_per_window) + first).alias("window"))
    windows.repartition("window").write.mode("append").partitionBy("window").parquet(path)


def embedded(chunks: DataFrame, embedder: str = "hashed", **options) -> DataFrame:
    """(chunk_id, doc_id, vector) of chunks with text."""
    return chunks.filter("trim(text) <> ''").select("chunk_id", "doc_id", plugs.get("embedder", embedder, **options)(F.col("text")).alias("vector"))


def append_index(items: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of vectors to an index; a batch that is added again replaces its rows. One length of vector only."""
    spark = items.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = items.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if new[0] != new[1]:
        raise ValueError(f"vectors of {new[0]} and {new[1]} in one batch")
    if new[0] is not None and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.parquet(path).filter(F.col("batch") != batch).select(F.size("vector").alias("n")).first()
        if old and old.n != new[0]:
            raise ValueError(f"the index has vectors of {old.n}, the batch of {new[0]}")
    items.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_state(spark: SparkSession, target: str, before: int | None = None) -> dict:
    """Where the stream stands after all windows, or after those before window ``before``: STATE as a mapping."""
    none = {x.split()[0]: 0.0 if x.endswith("double") else 0 for x in STATE.split(", ")}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return none
    rows = spark.read.schema(f"{STATE}, window long").parquet(f"{target}/state")
    last = rows.filter(F.lit(True) if before is None else F.col("window") < before).orderBy(F.desc("window")).first()
    return {k: last[k] for k in none} if last else none


def _made(spark: SparkSession, target: str, n_chunks: int, index: bool, made: list[int], most: int | None = None):
    """What a window does. Everything it writes is named by its number and replaces what a failed run of it left."""

    def window(docs: DataFrame, number: int) -> None:
        if most is not None and len(made) >= most:
            raise _Enough
        before = read_state(spark, target, number)
        # the window is read from its source once: its sentences and their running numbers are written, then used
        rows = S.with_running_start(S.with_sentences(docs).select("doc_id", "sentences"), F.size("sentences"), out="_unit")
        units = C.explode_rows(rows.select("doc_id", "sentences", "_unit"), "sentences", "sentence_idx", "text")
        units.select((F.col("_unit") + F.col("sentence_idx") + before["next_unit"]).alias("unit_id"), "doc_id", "sentence_idx", "text").write.mode("overwrite").parquet(f"{target}/units/window={number}")
        C.explode_chunks(rows, C.fixed_chunks(F.col("sentences"), n_chunks)).write.mode("overwrite").parquet(f"{target}/chunks/window={number}")
        measure(rows.select("doc_id", "sentences"), n_chunks).write.mode("overwrite").parquet(f"{target}/metrics/window={number}")
        if index:
            append_index(embedded(spark.read.parquet(f"{target}/chunks/window={number}")), f"{target}/index", number)
        metrics = spark.read.parquet(f"{target}/metrics/window={number}")
        own = metrics.agg(F.coalesce(F.sum("num_sentences"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("num_sentences"), F.lit(0)), F.coalesce(F.sum("num_chunks"), F.lit(0)), F.coalesce(F.sum("boundary_clarity"), F.lit(0.0))).first()
        after = tuple(a + b for a, b in zip(before.values(), own, strict=True))
        spark.createDataFrame([after], STATE).coalesce(1).write.mode("overwrite").parquet(f"{target}/state/window={number}")
        made.append(number)

    return window


class _Enough(Exception):
    """Ends a run before its next window, which the run after it makes."""


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, *, files_per_window: int = 1, n_chunks: int = 5, drain: bool = True, index: bool = False) -> int:
    """Reads new Parquet files under ``source`` window by window; returns how many windows this call made.

    Each window overwrites its own folders under ``target`` (units, chunks, metrics, state and, with ``index``, vectors), named by
    its number: a window that is run again after a failure replaces its rows, so nothing is doubled. Unit ids and sums
    go on from the state of the window before. ``drain`` takes
    all that is there, else one window is run. The next call goes on where the checkpoint says. With files as
    ``lay_out`` makes them, a window is so many documents. Ids may be of any type.
    """
    made: list[int] = []
    schema = spark.read.parquet(source).select("doc_id", "text").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_window).parquet(source)
    window = _made(spark, target, n_chunks, index, made, None if drain else 1)
    query = stream.writeStream.foreachBatch(window).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if drain or len(made) != 1:  # else it is the end that was asked for
            raise
    return len(made)


def ingest_corpus(spark: SparkSession, corpus: str, target: str, checkpoint: str, docs_per_window: int, *, limit: int | None = None, n_chunks: int = 5, index: bool = False, chunk_bytes: int | None = None) -> int:
    """The same for a corpus of JSON lines, in windows of ``docs_per_window`` documents in the order of the files, without
    writing it anew; at most ``limit`` windows. The corpus's byte ranges are counted once, under ``target``."""
    counts = f"{target}/ranges"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{counts}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        corpora.index(spark, corpus, counts, **({"chunkBytes": chunk_bytes} if chunk_bytes else {}))
    made: list[int] = []
    stream = corpora.windows(spark, corpus, counts, docs_per_window, checkpoint, limit)
    query = stream.writeStream.foreachBatch(_made(spark, target, n_chunks, index, made)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return len(made)


def totals(spark: SparkSession, target: str) -> DataFrame:
    """Means over all windows so far, from the per-document rows: the same however the windows were cut."""
    rows = spark.read.parquet(f"{target}/metrics")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("num_chunks").alias("num_chunks"), F.avg("boundary_clarity").alias("boundary_clarity"))


def backfill(cache: DataFrame | None, units: DataFrame, embed, model: str) -> DataFrame:
    """(model, text_id, text, vector) for the distinct texts of ``units`` that the cache lacks under ``model``.

    A cached row serves if it is of the same model and text and its vector is not empty; all others are made anew.
    Append the result to the cache.
    """
    texts = units.filter("trim(text) <> ''").select(F.sha1("text").alias("text_id"), "text").dropDuplicates(["text_id"])
    if cache is not None:
        valid = cache.filter((F.col("model") == model) & (F.size("vector") > 0)).select("text_id", "text")
        texts = texts.join(valid, ["text_id", "text"], "left_anti")
    return texts.select(F.lit(model).alias("model"), "text_id", "text", embed(F.col("text")).alias("vector"))


def unit_vectors(cache: DataFrame, units: DataFrame, model: str) -> DataFrame:
    """``units`` with their cached vectors."""
    own = cache.filter((F.col("model") == model) & (F.size("vector") > 0)).select("text_id", V.l2_normalise(F.col("vector")).alias("vector")).dropDuplicates(["text_id"])
    return units.withColumn("text_id", F.sha1("text")).join(own, "text_id", "left").drop("text_id")
