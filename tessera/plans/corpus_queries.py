"""Registered queries of plug points, tasks, sources, sinks, kept stages and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import answers as A
from tessera.operators import intrinsic as I
from tessera.operators import reporting as R
from tessera.operators import retrieval as N
from tessera.operators import split as S
from tessera.plans import experiment as E
from tessera.plans import plugs
from tessera.plans.queries import _BUCKETS, _COS, _COUNTS, _RUNS, _WORDS, BOUNDARY, CHUNKS, SENTS, SQL, _asked, _docs, _knn_sql, _r, _runs, _scored, _t, _vectors, query
from tessera.sources import corpora, qa, results
from tessera.sources.shared import scratch
from tessera.streaming import ingest as G

# --- text and predicates ----------------------------------------------------------------------

_END = "regexp_replace({x}, '^{e}+|{e}+$', '', 'g')"


def _slug_sql(x: str, bad: str, good: str, ends: str, empty: str) -> str:
    cut = _END.format(x=f"regexp_replace({x}, '{bad}', '{good}', 'g')", e=ends)
    return f"coalesce(nullif({cut}, ''), '{empty}')"


@query(
    "slug_variants",
    f"""SELECT page_id, {_slug_sql("url", "[^A-Za-z0-9._-]+", "_", "[._]", "item")} AS key_slug, {_slug_sql("url", chr(91) + "^" + chr(92) + "p{L}" + chr(92) + "p{N}._-]", "-", "[._-]", "item")} AS name_slug,
 {_slug_sql("lower(url)", "[/ _-]+", "_", "_", "unknown")} AS table_slug, lower({_slug_sql("url", "[^a-zA-Z0-9._-]+", "_", "_", "default")}) AS cache_slug FROM pages""",
)
def _(spark, d):
    url = F.col("url")
    return _t(spark, d, "pages").select("page_id", T.key_slug(url).alias("key_slug"), T.name_slug(url).alias("name_slug"), T.table_slug(url).alias("table_slug"), T.cache_slug(url).alias("cache_slug"))


@query("instruction_prefix", "SELECT item_id, 'query: ' || text AS text FROM benchmark")
def _(spark, d):
    return _t(spark, d, "benchmark").select("item_id", plugs.prefixed(F.col("text"), "query: ").alias("text"))


@query("router_info", "SELECT doc_id, 'moc' AS router_info FROM documents")
def _(spark, d):
    return plugs.get("router", "moc")(_docs(spark, d)).select("doc_id", "router_info")


@query(
    "unit_faults",
    "SELECT * FROM (SELECT 'doc_id is missing or blank' AS fault, count(*) FILTER (doc_id % 97 = 0) AS n FROM documents UNION ALL SELECT 'sentence_idx is missing or negative', count(*) FILTER (n_chars % 13 = 0) FROM documents UNION ALL SELECT 'text is missing', count(*) FILTER (lang = 'de') FROM documents) WHERE n > 0",
)
def _(spark, d):
    docs = _t(spark, d, "documents")
    units = docs.select(F.when(F.col("doc_id") % 97 != 0, F.col("doc_id")).alias("doc_id"), (F.col("n_chars") % 13 - 1).alias("sentence_idx"), F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    return S.unit_faults(units)


@query("first_documents", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, d):
    return S.first_documents(_t(spark, d, "documents").select("doc_id", "lang"), 100)


@query("coverage_counts", f"SELECT count(*) AS n, count(*) FILTER (len(s) > 40) AS filled FROM ({SENTS})")
def _(spark, d):
    return R.coverage(S.with_sentences(_docs(spark, d)).select(F.slice("sentences", 41, 1).alias("late")), "late")


# --- evidence and answers ---------------------------------------------------------------------


@query("macro_evidence", SQL["evidence_prf"].rpartition("SELECT query_id, round(p, 6)")[0] + "SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, count(*) AS num_queries FROM p")
def _(spark, d):
    queries, found = _asked(spark, d)
    return A.macro_evidence(A.evidence_scores(found, queries.withColumnRenamed("query", "evidence"))).select(*_r("precision", "recall", "f1"), "num_queries")


@query("answerable_filter", "SELECT l.doc_id AS query_id FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND d.lang = 'en'")
def _(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.array("text")).otherwise(F.array().cast("array<string>")).alias("reference_answers"))
    rows = _t(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("answerable"), "reference_answers")
    return A.answerable(rows).select("query_id")


@query(
    "answer_similarity",
    f"""WITH a AS ({SQL["extractive_answer"]}), v AS (SELECT {_BUCKETS.format(w=_WORDS.format(x="b.text"))} AS x, {_BUCKETS.format(w=_WORDS.format(x="a.answer"))} AS y FROM a JOIN benchmark b ON b.item_id = a.query_id),
 w AS (SELECT {_COUNTS.format(x="x")} AS p, {_COUNTS.format(x="y")} AS q FROM v)
 SELECT round(avg(CASE WHEN list_dot_product(p, p) * list_dot_product(q, q) > 0 THEN list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)) ELSE 0 END), 6) AS qa_similarity, count(*) AS num_queries FROM w""",
)
def _(spark, d):
    queries, found = _asked(spark, d)
    return A.answer_similarity(queries, A.extractive_answers(queries, found), plugs.get("embedder", "hashed")).select(*_r("qa_similarity"), "num_queries")


# --- retrieval ----------------------------------------------------------------------------------


@query("knn_many_queries", f"SELECT query_id, rank, item_id, round(score, 6) AS score FROM ({_knn_sql(_COS)})")
def _(spark, d):
    """Blocks of queries dealt to tasks, as for more queries than are sent to all."""
    return N.nearest(*_vectors(spark, d), 10, block=2).select("query_id", "rank", "item_id", *_r("score"))


@query("incremental_index", f"SELECT query_id, rank, item_id, round(score, 6) AS score FROM ({_knn_sql(_COS)})")
def _(spark, d):
    """An index of five batches, one of them added twice, searched as one."""
    items, queries = _vectors(spark, d)
    path = scratch(spark, "index")
    for batch in (0, 1, 2, 3, 4, 3):
        G.append_index(items.filter(F.pmod("item_id", F.lit(5)) == batch), path, batch)
    return N.nearest(spark.read.parquet(path), queries, 10).select("query_id", "rank", "item_id", *_r("score"))


# --- sources and sinks --------------------------------------------------------------------------


@query("beir_documents_last_wins", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, text FROM documents")
def _(spark, d):
    """Every id stands twice in the corpus; the later line counts."""
    path, docs = scratch(spark, "beir"), _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text")
    docs.withColumns({"title": F.lit("old"), "text": F.lower("text")}).write.json(f"{path}/a")
    docs.write.json(f"{path}/b")
    return corpora.beir_documents(spark, f"{path}/*").select("doc_id", "title", "text")


@query("msmarco_documents", r"SELECT CAST(page_id AS VARCHAR) AS doc_id, 'page ' || page_id AS title, regexp_replace(html, '[\r\n]+', ' ', 'g') AS text, url FROM pages")
def _(spark, d):
    path = scratch(spark, "msmarco")
    pages = _t(spark, d, "pages").withColumn("page_id", F.col("page_id").cast("string"))
    pages.select(F.concat_ws("\t", "page_id", "url", F.concat(F.lit("page "), "page_id"), F.regexp_replace("html", r"[\r\n]+", " ")).alias("value")).write.text(path)
    return corpora.msmarco_documents(spark, path)


def _corpus_documents(docs):
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text", F.lit("").alias("url"))


def _corpus(spark, d) -> corpora.Corpus:
    docs = _corpus_documents(_t(spark, d, "documents"))
    queries = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    labels = _t(spark, d, "labels")
    qrels = labels.select((F.col("doc_id") % 50).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("relevance"))
    return corpora.Corpus(docs, queries, qrels, queries.select("query_id", F.lit("").alias("doc_id"), F.col("query").alias("evidence")))


@query(
    "bundle_round_trip",
    "SELECT name, n, CAST(size AS BIGINT) AS size FROM (SELECT 'documents' AS name, count(*) AS n, sum(length(text)) AS size FROM documents UNION ALL SELECT 'queries', count(*), sum(length(text)) FROM benchmark UNION ALL SELECT 'qrels', count(*), sum(quality) FROM labels UNION ALL SELECT 'evidences', count(*), sum(length(text)) FROM benchmark)",
)
def _(spark, d):
    path = scratch(spark, "bundle")
    corpora.write_bundle(_corpus(spark, d), path, "json")
    back = corpora.read_bundle(spark, path, ("evidence_retrieval",))
    size = lambda rows, name, x: rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(x).cast("long").alias("size"))
    return (
        size(back.documents, "documents", F.length("text"))
        .union(size(back.queries, "queries", F.length("query")))
        .union(size(back.qrels, "qrels", F.col("relevance")))
        .union(size(back.evidences, "evidences", F.length("evidence")))
    )


@query(
    "corpus_faults",
    "WITH q AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS id FROM benchmark), f AS (SELECT 'judgement without query' AS fault, count(*) AS n FROM labels WHERE CAST(doc_id % 50 AS VARCHAR) NOT IN (SELECT id FROM q) UNION ALL SELECT 'judgement without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) SELECT * FROM f WHERE n > 0",
)
def _(spark, d):
    return corpora.faults(_corpus(spark, d))


@query(
    "nested_questions",
    r"WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id || '-q' || lpad(CAST(i AS VARCHAR), CAST(greatest(3, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS query_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS query FROM u WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''",
)
def _(spark, d):
    """Conversations read as papers whose questions are a struct of parallel arrays."""
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    none = F.struct(F.array().cast("array<string>").alias("section_name"), F.array().cast("array<array<string>>").alias("paragraphs"))
    answers = F.transform("t", lambda x: F.array(x))
    rows = turns.select(F.col("conv_id").cast("string").alias("id"), F.lit("").alias("title"), F.lit("").alias("abstract"), none.alias("full_text"), F.struct(F.col("t").alias("question"), answers.alias("answers"), answers.alias("evidence")).alias("qas"))
    return qa.papers(qa.as_papers(rows))["queries"]


@query("results_round_trip", f"SELECT status, count(*) AS n, round(sum(f1), 3) AS total FROM ({_RUNS}) GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "results")
    results.write_results(_runs(spark, d).select("stem", "chunking", "status", "k", "f1"), path)
    return results.read_results(spark, [path]).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f1"), 3).alias("total"))


@query("intrinsic_sink", SQL["intrinsic_global_stats"])
def _(spark, d):
    path = scratch(spark, "intrinsic")
    R.write_intrinsic(_scored(spark, d).select("doc_id", I.boundary_clarity(F.col("sets")).alias("boundary_clarity"), F.size("chunks").alias("num_chunks")), ["boundary_clarity", "num_chunks"], path)
    schema = "metric string, mean double, min double, max double, variance double"
    return spark.read.schema(schema).json(f"{path}/global").select("metric", *_r("mean", "min", "max", "variance"))


@query(
    "embedding_backfill",
    f"SELECT sha1(text) AS text_id, CAST(len({_WORDS.format(x='any_value(text)')}) AS INTEGER) AS n_tokens FROM documents GROUP BY 1 HAVING count(*) FILTER (doc_id % 2 = 0 AND doc_id % 10 <> 0) = 0 AND any_value(trim(text)) <> ''",
)
def _(spark, d):
    """Every second document is cached, every fifth of these with an empty vector: stale."""
    docs, embed = _docs(spark, d), plugs.get("embedder", "hashed")
    stale = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<double>")).otherwise(embed(F.col("text")))
    cache = docs.filter("doc_id % 2 = 0").select(F.lit("hashed").alias("model"), F.sha1("text").alias("text_id"), "text", stale.alias("vector"))
    new = G.backfill(cache, docs, embed, "hashed")
    return new.select("text_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("int").alias("n_tokens"))


# --- experiments and windows --------------------------------------------------------------------


@query(
    "stage_reuse",
    f"WITH c AS (SELECT lang, least(5, len(s)) AS n FROM ({SENTS}) JOIN documents USING (doc_id)) SELECT 'all' AS corpus, CAST(sum(n) AS BIGINT) AS num_chunks FROM c UNION ALL SELECT 'en', CAST(sum(n) AS BIGINT) FROM c WHERE lang = 'en' UNION ALL SELECT 'all again', CAST(sum(n) AS BIGINT) FROM c",
)
def _(spark, d):
    """One folder of kept stages for two corpora: each gets its own, and a second run those of the first."""
    whole, stages = _corpus(spark, d), scratch(spark, "stages")
    part = corpora.Corpus(_corpus_documents(_t(spark, d, "documents").filter("lang = 'en'")), whole.queries, whole.qrels)
    out = None
    for name, corpus in (("all", whole), ("en", part), ("all again", whole)):
        one = E.run(spark, corpus, E.Experiment(), stages)["chunks"].agg(F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("num_chunks"))
        out = one if out is None else out.union(one)
    return out


@query("experiment_chunks", f"WITH c AS ({CHUNKS}) SELECT CAST(doc_id AS VARCHAR) AS doc_id, position, doc_id || '::chunk_' || position AS chunk_id, text FROM c")
def _(spark, d):
    return E.chunk_documents(_corpus(spark, d).documents, E.Experiment())


@query(
    "document_windows",
    f"SELECT (SELECT count(*) FROM documents) AS n, CAST((SELECT count(*) FROM ({CHUNKS})) AS BIGINT) AS num_chunks, (SELECT round(avg(boundary_clarity), 6) FROM ({BOUNDARY})) AS boundary_clarity",
)
def _(spark, d):
    """A stream in windows of a fixed number of documents, with running scores."""
    path, docs = scratch(spark, "windows"), _docs(spark, d)
    G.lay_out(docs, f"{path}/in", max(1, docs.count() // 3))
    G.ingest(spark, f"{path}/in", f"{path}/out", f"{path}/state", index=True)
    return G.totals(spark, f"{path}/out").select("n", "num_chunks", *_r("boundary_clarity"))


@query("scorer_perplexity", SQL["lexical_perplexity"])
def _(spark, d):
    score = plugs.get("scorer", "lexical")
    return _docs(spark, d).withColumn("w", T.words(F.col("text"))).select("doc_id", F.round(score(F.col("w")), 6).alias("ppl"))


@query("normalised_unit_vectors", f"WITH b AS (SELECT doc_id, {_BUCKETS.format(w=_WORDS.format(x='text'))} AS x FROM documents WHERE trim(text) <> ''), v AS (SELECT doc_id, {_COUNTS.format(x='x')} AS v FROM b) SELECT doc_id, round(sqrt(list_dot_product(v, v)) / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS norm FROM v")
def _(spark, d):
    docs = _docs(spark, d).filter("trim(text) <> ''")
    cache = G.backfill(None, docs, plugs.get("embedder", "hashed"), "hashed")
    return G.unit_vectors(cache, docs, "hashed").select("doc_id", F.round(V.norm(F.col("vector")), 6).alias("norm"))

