"""Evidence and answers from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V


def chunks_by_shared_sentences(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, doc_id, position, sentences): the k chunks with most of a query's sentences.

    A lexical retriever that needs no model: an equi-join on sentences in normal form, so work grows with the
    sentences that match, not with queries times chunks.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(T.sentences(F.col("query")), T.normal_sentence))).alias("s"))
    told = chunks.select("doc_id", "position", F.explode(F.array_distinct(F.transform("sentences", T.normal_sentence))).alias("s"))
    counts = told.join(asked, "s").groupBy("query_id", "doc_id", "position").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "doc_id", "position")
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return chunks.select("doc_id", "position", "sentences").join(best, ["doc_id", "position"]).select("query_id", "rank", "doc_id", "position", "sentences")


def retrieved_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sentences of ranked chunks: (query_id, rank, chunk_id, text, sentences)."""
    found = ranked.join(chunks.select("chunk_id", "text"), "chunk_id")
    return found.select("query_id", "rank", "chunk_id", "text", T.sentences(F.col("text")).alias("sentences"))


def evidence_scores(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with evidence: precision, recall and f1 of distinct sentences that contain or are contained.

    ``retrieved`` has query_id, sentences; ``gold`` has query_id, evidence. Blank evidence makes a query unfit.
    """
    wanted = gold.select("query_id", F.explode(F.transform(T.sentences(F.col("evidence")), T.normal_sentence)).alias("g")).filter("g <> ''").distinct()
    found = retrieved.select("query_id", F.explode(F.transform("sentences", T.normal_sentence)).alias("r")).filter("r <> ''").distinct()
    pairs = found.join(wanted, (found["query_id"] == wanted["query_id"]) & (F.contains("r", "g") | F.contains("g", "r"))).select(found["query_id"], "r", "g")
    matched = pairs.groupBy("query_id").agg(F.countDistinct("r").alias("mr"), F.countDistinct("g").alias("mg"))
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("ng")).join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("nr")), "query_id", "left").join(matched, "query_id", "left")
    p = F.when(F.col("nr") > 0, F.coalesce("mr", F.lit(0)) / F.col("nr")).otherwise(F.lit(0.0))
    r = F.coalesce("mg", F.lit(0)) / F.col("ng")
    return sizes.select("query_id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def macro_evidence(scores: DataFrame) -> DataFrame:
    """Means over the queries that have evidence, and how many those are."""
    return scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], F.count(F.lit(1)).alias("num_queries"))


def answerable(answers: DataFrame) -> DataFrame:
    """Queries that can be answered and have an answer to compare with."""
    return answers.filter(F.col("answerable") & (F.size("reference_answers") > 0))


def answer_similarity(queries: DataFrame, answers: DataFrame, embed) -> DataFrame:
    """(qa_similarity, num_queries): mean cosine of each query and its answer; ``embed`` makes a text a vector."""
    both = queries.join(answers, "query_id").select(embed(F.col("query")).alias("q"), embed(F.col("answer")).alias("a"))
    return both.agg(F.avg(V.cosine(F.col("q"), F.col("a"))).alias("qa_similarity"), F.count(F.lit(1)).alias("num_queries"))


def sentence_score(question: Column, sentence: Column) -> Column:
    """0.7 of the share of the question's distinct tokens that the sentence has, 0.3 of the reverse share."""
    q, s = F.array_distinct(T.qa_tokens(question)), F.array_distinct(T.qa_tokens(sentence))
    both = F.size(F.array_intersect(q, s))
    return F.when((F.size(q) > 0) & (F.size(s) > 0), 0.7 * (both / F.size(q)) + 0.3 * (both / F.size(s))).otherwise(F.lit(0.0))


def extractive_answers(queries: DataFrame, retrieved: DataFrame, *, top: int = 3, limit: int = 768) -> DataFrame:
    """(query_id, answer): the best ``top`` sentences of the retrieved chunks, by score, then place.

    Chunks without any sentence give the first one's opening (512 characters, from a column ``text`` if there is
    one); no chunks give ''.
    """
    placed = retrieved.select("query_id", "rank", F.posexplode("sentences").alias("at", "sentence")).join(queries.select("query_id", "query"), "query_id")
    scored = placed.withColumn("score", F.round(sentence_score(F.col("query"), F.col("sentence")), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "at")
    best = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top)
    answers = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("s"))
    text = F.substring(F.array_join(F.transform("s", lambda x: x["sentence"]), " "), 1, limit)
    out = queries.select("query_id").join(answers.select("query_id", text.alias("answer")), "query_id", "left")
    if "text" in retrieved.columns:
        opening = retrieved.groupBy("query_id").agg(F.substring(F.min_by("text", "rank"), 1, 512).alias("_opening"))
        out = out.join(opening, "query_id", "left").withColumn("answer", F.coalesce("answer", "_opening")).drop("_opening")
    return out.withColumn("answer", F.coalesce("answer", F.lit("")))
