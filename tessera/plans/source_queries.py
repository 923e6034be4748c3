"""Registered queries of question sources and archives, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk as C
from tessera.operators import coverage, saved, scoring, split
from tessera.plans import experiment as E
from tessera.plans import plugs
from tessera.plans.queries import BOUNDARY, CHUNKS, SENTS, SETS, SQL, STRIP, _docs, _t, query
from tessera.plans.queries import _sticky_sql as sticky_sql
from tessera.sources import archives, cache, corpora, qa
from tessera.sources.shared import scratch
from tessera.streaming import ingest as G
from tessera.streaming import source as sources

# --- archives ---------------------------------------------------------------------------------

# a conversation is a document, every turn a question that the next turn answers
_TURNS = f"""t AS (SELECT conv_id, turn, role, {STRIP.format(x='text')} AS text, lead({STRIP.format(x='text')}) OVER w AS answer, row_number() OVER w - 1 AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 d AS (SELECT 'c' || conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM t WHERE conv_id % 7 <> 3 GROUP BY 1),
 q AS (SELECT conv_id || '-' || i AS query_id, text AS query, 'c' || conv_id AS own, 'c' || (conv_id + 1) AS other, coalesce(answer, '-') AS answer, conv_id % 2 = 0 AS flag, 'c' || CASE WHEN i % 3 = 0 THEN conv_id + 1 ELSE conv_id END AS gold, i FROM t WHERE text <> '')"""

_ARCHIVE = f"""WITH {_TURNS}, r AS (SELECT query_id, doc_id, max(relevance) AS relevance, min(place) AS place FROM (SELECT query_id, other AS doc_id, 1 AS relevance, 0 AS place FROM q UNION ALL SELECT query_id, own, 1, 1 FROM q UNION ALL SELECT query_id, gold, 2, NULL FROM q WHERE i % 2 = 0) WHERE doc_id IN (SELECT doc_id FROM d WHERE text <> '') GROUP BY 1, 2)"""


def _archived(spark, d):
    """Archives written from the conversations: a member of documents and one of questions for each of them."""
    path = scratch(spark, "archives")
    text = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: text(x["text"])).alias("t"))
    own, next_one = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("c"), (F.col("conv_id") + 1).cast("string"))
    entry = F.to_json(F.create_map(own, F.struct(F.lit("").alias("title"), F.array_join("t", "\n").alias("text"))))
    gold = lambda i: F.when(i % 2 != 0, "-").when(i % 3 == 0, next_one).otherwise(own)
    question = lambda x, i: F.struct(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), i.cast("string")).alias("QUESTION_ID"),
        x.alias("QUESTION_TEXT"),
        F.array(next_one, F.lit(" "), own).alias("DOC_IDS"),
        F.when(F.col("conv_id") % 2 == 0, "y ").otherwise("N").alias("ANSWERABLE"),
        gold(i).alias("DOCUMENT"),
        F.coalesce(F.get("t", i + 1), F.lit("-")).alias("ANSWER"),
        F.when(i % 5 == 0, "-").otherwise(i.cast("string")).alias("START_OFFSET"),
        (i * 10 + 3).alias("END_OFFSET"),
    )
    name = F.concat(F.lit("all/"), F.col("conv_id").cast("string"))
    docs = turns.filter("conv_id % 7 <> 3").select(F.concat(name, F.lit("_technotes.json")).alias("name"), entry.alias("content"))
    questions = turns.select(F.concat(name, F.lit("_Q_A.json")).alias("name"), F.to_json(F.transform("t", question)).alias("content"))
    archives.write_archives(docs.unionByName(questions), path)
    return qa.support_questions(archives.members(spark, path, "*_Q_A.json"), qa.support_documents(archives.members(spark, path, "*_technotes.json")))


@query("archive_qrels", f"{_ARCHIVE} SELECT query_id, doc_id, CAST(relevance AS INTEGER) AS relevance FROM r")
def _(spark, d):
    return _archived(spark, d)["qrels"]


@query(
    "archive_answers",
    f"""{_ARCHIVE}, f AS (SELECT query_id, arg_min(doc_id, place) AS first FROM r GROUP BY 1), k AS (SELECT q.*, CASE WHEN i % 2 = 0 THEN gold ELSE coalesce(first, '') END AS doc_id FROM q JOIN f USING (query_id))
 SELECT query_id, query, k.doc_id, flag OR answer NOT IN ('-', '') AS answerable, CASE WHEN answer IN ('-', '') THEN '' ELSE answer END AS reference, CASE WHEN d.text IS NULL OR d.text = '' THEN '' ELSE k.doc_id END AS evidence_doc,
 CASE WHEN d.text IS NULL OR d.text = '' THEN '' WHEN i % 5 <> 0 AND i * 10 + 3 <= length(d.text) AND {STRIP.format(x='substr(d.text, i + 1, i * 9 + 3)')} <> '' THEN {STRIP.format(x='substr(d.text, i + 1, i * 9 + 3)')} ELSE d.text END AS evidence FROM k LEFT JOIN d ON d.doc_id = k.doc_id""",
)
def _(spark, d):
    made = _archived(spark, d)
    evidence = made["evidences"].withColumnRenamed("doc_id", "evidence_doc")
    reference = F.coalesce(F.get("reference_answers", F.lit(0)), F.lit("")).alias("reference")
    return made["queries"].join(made["answers"], "query_id").join(evidence, "query_id").select("query_id", "query", "doc_id", "answerable", reference, "evidence_doc", "evidence")


# --- nested and tabular questions ---------------------------------------------------------------


@query(
    "paper_texts",
    f"""WITH t AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split(text, ' '), lambda x: {STRIP.format(x='x')}), lambda x: x <> '') AS p FROM conversations),
 s AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 OR turn % 3 = 0 THEN '' WHEN turn % 2 = 0 THEN role || chr(10) || array_to_string(p, chr(10)) ELSE array_to_string(p, chr(10)) END AS body FROM t)
 SELECT CAST(conv_id AS VARCHAR) AS doc_id, array_to_string(list_filter(['paper ' || conv_id, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY turn) FILTER (body <> ''), '')], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM s GROUP BY conv_id""",
)
def _(spark, d):
    """Turns as sections: every third without paragraphs, every second of the others with its role as name."""
    section = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("section_name"), F.when(F.col("turn") % 3 != 0, F.split("text", " ")).alias("paragraphs"))
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    sections = F.transform("s", lambda x: F.struct(x["section_name"].alias("section_name"), x["paragraphs"].alias("paragraphs")))
    text = qa.paper_text(F.concat(F.lit("paper "), F.col("conv_id").cast("string")), F.lit(" "), sections)
    return rows.select(F.col("conv_id").cast("string").alias("doc_id"), text.alias("text"))


@query(
    "passage_backfill",
    f"""WITH d AS (SELECT 'p' || page_id AS doc_id, {STRIP.format(x='html')} AS text FROM pages WHERE {STRIP.format(x='html')} <> ''), j AS (SELECT 'q' || (page_id % 40) AS query_id, 'p' || page_id AS doc_id, page_id FROM pages WHERE page_id % 3 > 0),
 f AS (SELECT query_id, arg_min(doc_id, page_id) AS first FROM j GROUP BY 1), q AS (SELECT 'q' || item_id AS query_id, {STRIP.format(x='text')} AS query, item_id % 4 = 0 AS stated, item_id % 5 = 0 AS linked FROM benchmark WHERE {STRIP.format(x='text')} <> '')
 SELECT q.query_id, CASE WHEN linked THEN 'own' ELSE first END AS answer_doc, CASE WHEN stated THEN CASE WHEN linked THEN 'own' ELSE '' END WHEN d.text IS NOT NULL THEN first WHEN linked THEN 'own' ELSE '' END AS doc_id, CASE WHEN stated THEN query ELSE coalesce(d.text, '') END AS evidence FROM q JOIN f USING (query_id) LEFT JOIN d ON d.doc_id = first""",
)
def _(spark, d):
    """Three tables; questions without evidence get the text of their first judged page."""
    page = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    pages = _t(spark, d, "pages")
    docs = pages.select(F.array(page).alias("passage_ids"), F.array("html").alias("passages"))
    qrels = pages.select(F.concat(F.lit("q"), (F.col("page_id") % 40).cast("string")).alias("query_id"), page.alias("doc_id"), (F.col("page_id") % 3).alias("score"), F.col("page_id").alias("at"))
    items = _t(spark, d, "benchmark")
    queries = items.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 5 == 0, "own").alias("doc_id"), F.when(F.col("item_id") % 4 == 0, F.array("text", "text")).alias("evidences"))
    made = qa.passage_tables(docs, queries, qrels)
    return made["evidences"].join(made["answers"].select("query_id", F.col("doc_id").alias("answer_doc")), "query_id").select("query_id", "answer_doc", "doc_id", "evidence")


@query(
    "context_evidence",
    f"""WITH c AS (SELECT item_id, text, {STRIP.format(x='text')} AS t FROM benchmark), x AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN [t, upper(t), t] WHEN item_id % 3 = 1 THEN [t] ELSE [] END AS ts FROM c),
 y AS (SELECT item_id, list_filter(ts, lambda a: a <> '') AS ts FROM x)
 SELECT 'q' || item_id AS query_id, CASE WHEN len(ts) = 0 THEN '' WHEN item_id % 2 = 0 THEN 'techqa-doc-' || substr(sha1(ts[1]), 1, 16) ELSE 'techqa-doc-' || substr(sha1(e), 1, 16) END AS doc_id, e AS evidence FROM (SELECT item_id, ts, unnest(CASE WHEN item_id % 2 = 0 THEN ['told ' || item_id] WHEN len(ts) = 0 THEN [''] ELSE ts END) AS e FROM y)""",
)
def _(spark, d):
    items = _t(spark, d, "benchmark")
    contexts = F.when(F.col("item_id") % 3 == 0, F.array("text", F.upper("text"), "text")).when(F.col("item_id") % 3 == 1, F.array(F.lit(" "), "text"))
    stated = F.when(F.col("item_id") % 2 == 0, F.array(F.concat(F.lit(" told "), F.col("item_id").cast("string"))))
    rows = items.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("question"), contexts.alias("contexts"), F.lit("").alias("answer"), stated.alias("evidences"))
    return qa.inline_contexts(rows)["evidences"]


# --- streams ------------------------------------------------------------------------------------


def _json_corpus(spark, d) -> tuple[str, int]:
    """The documents as JSON lines in order of id, ids as texts, and a third of their number."""
    path = scratch(spark, "corpus")
    docs = _t(spark, d, "documents")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("_id"), "text").write.json(path)
    return path, max(1, -(-docs.count() // 3))


def _streamed(spark, d) -> str:
    """The corpus in three windows by two runs; the second window is made again, as after a failure before its commit."""
    path, n = _json_corpus(spark, d)
    out, state = scratch(spark, "streamed"), scratch(spark, "state")
    G.ingest_corpus(spark, path, out, state, n, limit=2, chunk_bytes=1 << 20)
    jvm = spark._jvm.org.apache.hadoop.fs
    for name in ("1", ".1.crc"):
        at = jvm.Path(f"{state}/commits/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    G.ingest_corpus(spark, path, out, state, n)
    return out


_WINDOWS = f"n AS (SELECT doc_id, s, len(s) AS n FROM ({SENTS})), r AS (SELECT doc_id, s, n, sum(n) OVER (ORDER BY doc_id) - n AS start, (row_number() OVER (ORDER BY doc_id) - 1) // CAST(ceil(count(*) OVER () / 3.0) AS BIGINT) AS w FROM n)"


@query(
    "stream_unit_ids",
    f"WITH {_WINDOWS} SELECT CAST(w AS BIGINT) AS \"window\", CAST(start + i AS BIGINT) AS unit_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, CAST(i AS INTEGER) AS sentence_idx, s[i + 1] AS text FROM r, unnest(range(0, n)) AS u(i)",
)
def _(spark, d):
    return spark.read.parquet(f"{_streamed(spark, d)}/units").select(F.col("window").cast("long").alias("window"), "unit_id", "doc_id", "sentence_idx", "text")


@query(
    "stream_states",
    f"WITH {_WINDOWS}, b AS ({BOUNDARY}), t AS (SELECT w, count(*) AS d, sum(r.n) AS s, sum(least(5, r.n)) AS c, sum(boundary_clarity) AS b FROM r JOIN b USING (doc_id) GROUP BY w) SELECT CAST(w AS BIGINT) AS \"window\", CAST(sum(s) OVER o AS BIGINT) AS next_unit, CAST(sum(d) OVER o AS BIGINT) AS num_docs, CAST(sum(c) OVER o AS BIGINT) AS num_chunks, round(sum(b) OVER o / sum(d) OVER o, 6) AS boundary_clarity FROM t WINDOW o AS (ORDER BY w)",
)
def _(spark, d):
    """Sums after each window."""
    rows = spark.read.parquet(f"{_streamed(spark, d)}/state")
    return rows.select(F.col("window").cast("long").alias("window"), "next_unit", "num_docs", "num_chunks", F.round(F.col("clarity_sum") / F.col("num_docs"), 6).alias("boundary_clarity"))


@query("corpus_by_ranges", "SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS doc_id, length(text) AS n FROM documents")
def _(spark, d):
    """The same corpus in batch, by byte ranges of a megabyte."""
    path, _ = _json_corpus(spark, d)
    return sources.documents(spark, path, chunkBytes=1 << 20).select("doc_id", F.length("text").cast("long").alias("n"))


# --- scorers and evaluation ---------------------------------------------------------------------


def _texts(spark, d):
    docs = _docs(spark, d).withColumn("sentences", T.sentences(F.col("text"))).withColumn("chunks", C.fixed_chunks(F.col("sentences"), 5))
    return docs.select("doc_id", F.transform("chunks", lambda c: c["text"]).alias("texts"))


def novelty() -> scoring.Scorer:
    """One more than the distinct words that are not in the given text."""
    words = lambda x: set(re.findall(r"\w+", (x or "").lower()))
    return lambda texts, given: [1.0 + len(words(t) - words(g)) for t, g in zip(texts, given, strict=True)]


plugs.register("pair_scorer", "novelty", lambda: novelty)


@query("scored_boundary_clarity", SQL["boundary_clarity"])
def _(spark, d):
    made = scoring.boundary_clarity(_texts(spark, d), plugs.get("pair_scorer", "lexical"), "lexical")
    return made.select("doc_id", F.round("boundary_clarity", 6).alias("boundary_clarity"))


@query(
    "scored_boundary_novelty",
    f"WITH p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY position) AS l FROM ({SETS})), b AS (SELECT doc_id, avg((1.0 + len(w) - len(list_intersect(w, l))) / (1 + len(w))) AS v FROM p WHERE l IS NOT NULL GROUP BY 1) SELECT doc_id, round(coalesce(v, 1), 6) AS boundary_clarity FROM documents LEFT JOIN b USING (doc_id)",
)
def _(spark, d):
    """A second scorer through the same cache, whose rows of the first it leaves alone."""
    texts, cache = _texts(spark, d), scratch(spark, "scores")
    scoring.boundary_clarity(texts.filter("doc_id % 2 = 0"), plugs.get("pair_scorer", "lexical"), "lexical", cache=cache).count()
    made = scoring.boundary_clarity(texts, plugs.get("pair_scorer", "novelty"), "novelty", cache=cache)
    return made.select("doc_id", F.round("boundary_clarity", 6).alias("boundary_clarity"))


@query("scored_stickiness", f"SELECT doc_id, a.stickiness AS complete, b.stickiness AS incomplete FROM ({sticky_sql(0.2123, 0)}) a JOIN ({sticky_sql(0.2123, 1)}) b USING (doc_id)")
def _(spark, d):
    made = scoring.stickiness(_texts(spark, d), plugs.get("pair_scorer", "lexical"), "lexical", threshold=0.2123, delta=1)
    return made.select("doc_id", F.round("complete", 6).alias("complete"), F.round("incomplete", 6).alias("incomplete"))


@query(
    "evaluation_rows",
    rf"""WITH c AS ({CHUNKS}), x AS (SELECT doc_id, count(*) AS n, avg(length(text)) AS c, avg(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS w FROM c GROUP BY 1)
 SELECT 'intrinsic' AS task, CAST(NULL AS INTEGER) AS k, m.metric AS metric, round(m.value, 6) AS value, '' AS status FROM (SELECT unnest([struct_pack(metric := 'chunks_per_document', value := avg(n)), struct_pack(metric := 'chars_per_chunk', value := avg(c)), struct_pack(metric := 'words_per_chunk', value := avg(w)), struct_pack(metric := 'num_documents', value := CAST(count(*) AS DOUBLE))]) AS m FROM x)
 UNION ALL SELECT t, k, NULL, NULL, 'skipped' FROM (VALUES ('evidence_retrieval'), ('answers')) AS v(t), (VALUES (1), (3)) AS w(k)""",
)
def _(spark, d):
    """A corpus of documents alone: its chunks are scored, tasks that lack their tables are skipped."""
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text", F.lit("").alias("url"))
    queries = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    corpus = corpora.Corpus(docs, queries, queries.limit(0).select("query_id", F.lit("").alias("doc_id"), F.lit(0).alias("relevance")))
    rows = E.evaluate(spark, corpus, E.Experiment(ks=(1, 3), tasks=("evidence_retrieval", "answers")), scratch(spark, "evaluation"))
    return rows.select("task", "k", "metric", F.round("value", 6).alias("value"), "status")


# --- nested texts, saved units, coverage --------------------------------------------------------


@query("nested_texts", "SELECT event_id, event_type || '|' || CAST(user_id AS VARCHAR) || '|True' AS texts FROM events")
def _(spark, d):
    """JSON of three and of five levels, with objects that hold no text and texts that come twice."""
    own = F.concat(F.lit('{"note": "x", "answers": [{"evidence": ['), "props", F.lit(', "'), "event_type", F.lit('", '), F.col("user_id").cast("string"), F.lit(', true], "text": " '), "event_type", F.lit(' "}]}'))
    value = F.when(F.col("event_id") % 2 == 0, own).otherwise(F.concat(F.lit('[{"supporting_facts": {"answer": '), own, F.lit("}}]")))
    rows = qa.collected_texts(_t(spark, d, "events").select("event_id", value.alias("json")), "json")
    return rows.select("event_id", F.array_join("texts", "|").alias("texts"))


@query("chunks_of_saved_units", f"SELECT doc_id, position, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text FROM ({CHUNKS})")
def _(spark, d):
    """The sentences of every second document are kept, in a spelling of their own; the others are split anew."""
    path, docs = scratch(spark, "saved"), _docs(spark, d)
    saved.save(docs, f"{path}/docs", 8)
    units = docs.filter("doc_id % 2 = 0").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_idx", "text"))
    saved.save(units.withColumn("text", F.replace("text", F.lit("e"), F.lit("E"))), f"{path}/units", 8, ("sentence_idx",))
    return saved.chunks_from_saved(saved.load(spark, f"{path}/docs"), saved.load(spark, f"{path}/units")).select("doc_id", "position", "text")


@query(
    "coverage_audit",
    """WITH e AS (SELECT CASE WHEN event_type = 'view' THEN 'other' ELSE event_type END AS kind, CAST([1, 3, 5, 10][event_id % 4 + 1] AS VARCHAR) AS k, event_type FROM events), n AS (SELECT kind, k, count(*) FILTER (NOT (kind = 'click' AND k = '3')) AS n FROM e WHERE NOT (kind = 'purchase' AND k = '10') GROUP BY 1, 2),
 x AS (SELECT kind, k FROM (SELECT unnest(['click', 'purchase', 'view']) AS kind), (SELECT unnest(['1', '3', '5', '10']) AS k))
 SELECT coalesce(x.kind, n.kind) AS kind, coalesce(x.k, n.k) AS k, CAST(n.n AS BIGINT) AS n_rows, CASE WHEN x.kind IS NULL THEN 'unexpected' WHEN n.kind IS NULL THEN 'missing' WHEN n.n = 0 THEN 'empty' ELSE 'complete' END AS state FROM x FULL JOIN n ON x.kind = n.kind AND x.k = n.k""",
)
def _(spark, d):
    """Outputs of events by type and cut-off: one was never written, one has a header alone, one type is not expected, one expected type has none."""
    path = scratch(spark, "outputs")
    kind = F.when(F.col("event_type") == "view", "other").otherwise(F.col("event_type"))
    events = _t(spark, d, "events").select(kind.alias("kind"), F.element_at(F.array(*map(F.lit, (1, 3, 5, 10))), (F.col("event_id") % 4 + 1).cast("int")).alias("k"), F.col("value").alias("f1"))
    for own, k in events.select("kind", "k").distinct().collect():  # as many runs as there are combinations
        if (own, k) != ("purchase", 10):
            rows = events.filter((F.col("kind") == own) & (F.col("k") == k) & F.lit((own, k) != ("click", 3)))
            rows.select("f1").coalesce(1).write.csv(f"{path}/{own}/{k}", header=True)
    wanted = coverage.combinations(spark, {"kind": ["click", "purchase", "view"], "k": [1, 3, 5, 10]})
    return coverage.audit(wanted, coverage.outputs(spark, path, ("kind", "k")))


# --- offset splitters and kept corpora ------------------------------------------------------------


@query("plugged_offsets", SQL["sentence_offsets"])
def _(spark, d):
    """A splitter that works on texts themselves, a thousand characters at a time."""
    return split.split_by(_docs(spark, d), plugs.get("offset_splitter", "sentence"), at_once=1000).select("doc_id", "sentence_idx", "char_start", "char_end")


@query("kept_corpus", "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS evidence, 2 AS snapshots FROM benchmark")
def _(spark, d):
    """A kept corpus without evidence is made anew when a task needs it, and not again when the task comes back."""
    root, kept = scratch(spark, "bundle"), scratch(spark, "kept")
    items = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text", F.lit("").alias("url"))
    qrels = items.select("query_id", F.lit("0").alias("doc_id"), F.lit(1).alias("relevance"))
    cache.publish(spark, corpora.Corpus(docs, items, qrels), kept)
    corpora.write_bundle(corpora.Corpus(docs, items, qrels, items.select("query_id", F.lit("").alias("doc_id"), F.col("query").alias("evidence"))), root)
    for tasks in ((), ("evidence_retrieval",), ("evidence_retrieval",), ()):
        corpus = cache.load(spark, "bundle", root, "test", kept, tasks)
    return corpus.evidences.select("query_id", "evidence", F.lit(len(cache.snapshots(spark, kept))).alias("snapshots"))
