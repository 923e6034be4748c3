"""Question-answering sources of several shapes, turned into documents, queries, judgements, evidence, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.shared import scratch


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(T.strip(c), F.lit("")) for c in columns])


def distinct_texts(texts: Column) -> Column:
    """Stripped, blanks dropped, the first of equal ones kept, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), T.strip), lambda x: x.isNotNull() & (x != "")))


def _filled(texts: Column) -> Column:
    return F.filter(F.transform(texts, lambda x: T.strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def paper_text(title: Column, abstract: Column, sections: Column) -> Column:
    """Title, abstract and sections between empty lines. A section is its name and paragraphs, a line each; one without
    paragraphs is left out."""
    name = lambda s: T.strip(F.coalesce(s["section_name"], F.lit("")))
    body = lambda s: F.array_join(_filled(F.coalesce(s["paragraphs"], F.array().cast("array<string>"))), "\n")
    section = lambda s: F.when((name(s) != "") & (body(s) != ""), F.concat_ws("\n", name(s), body(s))).otherwise(body(s))
    bodies = F.transform(F.filter(F.coalesce(sections, F.array().cast("array<struct<section_name:string,paragraphs:array<string>>>")), lambda s: s.isNotNull()), section)
    return F.array_join(_filled(F.concat(F.array(title, abstract), F.filter(bodies, lambda x: x != ""))), "\n\n")


def numbered(prefix: Column, n: Column, digits: int) -> Column:
    """The prefix and a number of at least so many digits."""
    return F.concat(prefix, F.format_string(f"%0{digits}d", n))


def number_questions(rows: DataFrame, questions: str = "qas", id_col: str = "doc_id") -> DataFrame:
    """Explodes an array of questions; query_id is the document's id with -q and a number of three digits or more."""
    out = rows.select(id_col, F.posexplode(questions).alias("at", "qa"))
    return out.withColumn("query_id", numbered(F.concat(F.col(id_col), F.lit("-q")), F.col("at"), 3))


def papers(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows id, title, abstract, full_text, qas (question, answers: array of text, evidence: array of text)."""
    docs = rows.select(F.col("id").alias("doc_id"), T.safe_title(F.col("title")).alias("title"), paper_text(F.col("title"), F.col("abstract"), F.col("full_text")).alias("text"))
    asked = number_questions(rows.withColumnRenamed("id", "doc_id"))
    asked = asked.withColumn("query", T.strip(F.col("qa.question"))).filter("query <> ''")
    answers = distinct_texts(F.col("qa.answers"))
    return {
        "documents": docs,
        "queries": asked.select("query_id", "query"),
        "qrels": asked.select("query_id", "doc_id", F.lit(1).alias("relevance")),
        "evidences": asked.select("query_id", "doc_id", F.explode_outer(distinct_texts(F.col("qa.evidence"))).alias("evidence")).fillna({"evidence": ""}),
        "answers": asked.select("query_id", "doc_id", (F.size(answers) > 0).alias("answerable"), answers.alias("reference_answers")),
    }


def flat_papers(rows: DataFrame) -> DataFrame:
    """Rows context, questions, answers, evidences (parallel arrays) in the shape that ``papers`` takes."""
    qa = F.transform(
        F.arrays_zip("questions", "answers", "evidences"),
        lambda z: F.struct(z["questions"].alias("question"), F.array(z["answers"]).alias("answers"), F.array(z["evidences"]).alias("evidence")),
    )
    none = F.array().cast("array<struct<section_name:string,paragraphs:array<string>>>")
    return rows.select("id", F.lit("").alias("title"), F.col("context").alias("abstract"), none.alias("full_text"), qa.alias("qas"))


def as_papers(rows: DataFrame) -> DataFrame:
    """Rows of any of three shapes in the one that ``papers`` takes.

    Sections and questions may be arrays of structs, structs of parallel arrays, or flat columns.
    """
    if "questions" in rows.columns:
        return flat_papers(rows)
    types = dict(rows.dtypes)
    if types["full_text"].startswith("struct"):
        rows = rows.withColumn("full_text", F.arrays_zip(F.col("full_text.section_name").alias("section_name"), F.col("full_text.paragraphs").alias("paragraphs")))
    if types["qas"].startswith("struct"):
        z = F.arrays_zip(F.col("qas.question").alias("question"), F.col("qas.answers").alias("answers"), F.col("qas.evidence").alias("evidence"))
        rows = rows.withColumn("qas", z)
    return rows


def _some(column: str, rows: DataFrame, kind: str = "string") -> Column:
    """A column that a source may lack."""
    return F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)


def inline_contexts(rows: DataFrame, limit: int = 900_000, prefix: str = "techqa-doc-") -> dict[str, DataFrame]:
    """Rows query_id, question, contexts, answer, perhaps evidences (array): a document's id is its content's hash.

    Equal contexts are one document. Evidence is what ``evidences`` says, of the first context's document; without it, every context is.
    """
    texts = F.transform(_filled(F.coalesce(F.col("contexts"), F.array().cast("array<string>"))), lambda x: F.substring(x, 1, limit))
    own = rows.select("query_id", texts.alias("texts"), distinct_texts(_some("evidences", rows, "array<string>")).alias("stated"))
    own = own.withColumn("ids", F.transform("texts", lambda x: F.concat(F.lit(prefix), T.content_id(x))))
    each = own.select("query_id", F.explode(F.arrays_zip(F.col("ids").alias("doc_id"), F.col("texts").alias("text"))).alias("z")).select("query_id", "z.*")
    first = F.coalesce(F.get("ids", F.lit(0)), F.lit(""))
    stated = F.transform("stated", lambda x: F.struct(first.alias("doc_id"), x.alias("evidence")))
    contexts = F.transform(F.arrays_zip(F.col("ids").alias("i"), F.col("texts").alias("t")), lambda z: F.struct(z["i"].alias("doc_id"), z["t"].alias("evidence")))
    nothing = F.array(F.struct(F.lit("").alias("doc_id"), F.lit("").alias("evidence")))
    evidence = F.when(F.size("stated") > 0, stated).when(F.size("ids") > 0, contexts).otherwise(nothing)
    gold = rows.select("query_id", distinct_texts(F.array("answer")).alias("reference_answers")).join(own.select("query_id", first.alias("doc_id")), "query_id")
    return {
        "documents": each.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("title", T.safe_title(F.col("text"))),
        "queries": rows.select("query_id", T.strip(F.col("question")).alias("query")).filter("query <> ''"),
        "qrels": each.select("query_id", "doc_id", F.lit(1).alias("relevance")).distinct(),
        "evidences": own.select("query_id", F.explode(evidence).alias("e")).select("query_id", "e.*"),
        "answers": gold.select("query_id", "doc_id", (F.size("reference_answers") > 0).alias("answerable"), "reference_answers"),
    }


def passage_tables(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> dict[str, DataFrame]:
    """Three tables: documents (doc_id, title, text, or parallel arrays passage_ids and passages), queries (query_id,
    query, perhaps doc_id, answers, evidences) and judgements (query_id, doc_id, score, perhaps ``at``, their order).

    Judgements of 0 and less are dropped, and queries without one. A query that names no document gets its first judged
    one, and without evidence of its own that document's text. The first judgement is the least ``at``, else the least doc_id.
    """
    if "passages" in docs.columns:
        z = F.arrays_zip(F.col("passage_ids").alias("doc_id"), F.col("passages").alias("text"))
        docs = docs.select(_some("title", docs).alias("title"), F.explode(z).alias("z")).select("z.doc_id", "title", "z.text")
    docs = docs.select(T.strip(F.col("doc_id")).alias("doc_id"), T.strip(_some("title", docs)).alias("title"), T.strip(F.col("text")).alias("text")).filter("doc_id <> '' and text <> ''")
    docs = docs.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), T.safe_title(F.col("text"))))
    judged = qrels.select("query_id", "doc_id", F.coalesce(F.col("score").try_cast("int"), F.lit(1)).alias("relevance"), (F.col("at") if "at" in qrels.columns else F.col("doc_id")).alias("at")).filter("relevance > 0 and query_id <> '' and doc_id <> ''")
    first = judged.groupBy("query_id").agg(F.min_by("doc_id", "at").alias("first_doc"))
    asked = queries.select("query_id", T.strip(F.col("query")).alias("query"), F.coalesce(T.strip(_some("doc_id", queries)), F.lit("")).alias("linked"), distinct_texts(_some("answers", queries, "array<string>")).alias("reference_answers"), distinct_texts(_some("evidences", queries, "array<string>")).alias("stated"))
    asked = asked.filter("query <> ''").join(first, "query_id")
    texts = docs.select(F.col("doc_id").alias("first_doc"), F.col("text").alias("first_text"))
    filled = asked.filter("size(stated) = 0").join(texts, "first_doc", "left").select(
        "query_id", F.when(F.col("first_text").isNotNull(), F.col("first_doc")).otherwise(F.col("linked")).alias("doc_id"), F.coalesce("first_text", F.lit("")).alias("evidence")
    )
    return {
        "documents": docs,
        "queries": asked.select("query_id", "query"),
        "qrels": judged.select("query_id", "doc_id", "relevance"),
        "evidences": asked.select("query_id", F.col("linked").alias("doc_id"), F.explode("stated").alias("evidence")).unionByName(filled),
        "answers": asked.select("query_id", F.coalesce(F.nullif("linked", F.lit("")), F.col("first_doc")).alias("doc_id"), (F.size("reference_answers") > 0).alias("answerable"), "reference_answers"),
    }


def support_documents(elements: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, title, text) of JSON entries (key, value): the text under text, else content; those without are left out."""
    j = F.from_json("value", "title string, text string, content string")
    text = first_filled(j["text"], j["content"])
    docs = elements.select(F.col("key").alias("doc_id"), T.strip(j["title"]).alias("title"), (text if limit is None else F.substring(text, 1, limit)).alias("text"))
    return docs.filter("text <> ''").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), T.safe_title(F.col("text"))))


def support_questions(elements: DataFrame, docs: DataFrame, prefix: str = "techqa-q-") -> dict[str, DataFrame]:
    """What the elements of question members (member, at, value: see ``archives.members``) say about ``docs``.

    Candidates that are documents count 1, the gold document 2; queries without either are dropped. An answer's document
    is the gold one, else the first candidate; evidence is the answer's range in that document's text, the whole text where the
    range is missing or outside, blank where there is no such document. A sign of minus means none. Of questions with one
    id the last counts. Numbers of questions without id run by place in their member.
    """
    q = F.from_json("value", "map<string,string>")  # names that differ in case only are different fields
    dash = lambda x: F.nullif(T.strip(F.coalesce(x, F.lit(""))), F.lit("-"))
    rows = elements.select(
        F.coalesce(first_filled(q["QUESTION_ID"], q["question_id"], q["id"]), numbered(F.lit(prefix), F.col("at"), 6)).alias("query_id"),
        F.struct(
            first_filled(q["QUESTION_TEXT"], q["question"], q["text"], q["QUESTION_TITLE"]).alias("query"),
            _filled(F.coalesce(F.from_json(q["DOC_IDS"], "array<string>"), F.array().cast("array<string>"))).alias("candidates"),
            F.coalesce(dash(q["DOCUMENT"]), F.lit("")).alias("gold"),
            _filled(F.array(F.coalesce(dash(q["ANSWER"]), F.lit("")))).alias("reference_answers"),
            (F.upper(T.strip(F.coalesce(q["ANSWERABLE"], F.lit("")))) == "Y").alias("flag"),
            T.strip(q["START_OFFSET"]).alias("start"),
            T.strip(q["END_OFFSET"]).alias("end"),
        ).alias("q"),
        F.struct("member", "at").alias("place"),
    ).filter("q.query is not null")
    rows = rows.groupBy("query_id").agg(F.max_by("q", "place").alias("q")).select("query_id", "q.*")
    ids = docs.select("doc_id")
    asked = rows.select("query_id", F.posexplode("candidates").alias("place", "doc_id"), F.lit(1).alias("relevance"))
    gold = rows.filter("gold <> ''").select("query_id", F.lit(None).cast("int").alias("place"), F.col("gold").alias("doc_id"), F.lit(2).alias("relevance"))
    qrels = asked.unionByName(gold).join(ids, "doc_id", "left_semi").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"), F.min("place").alias("place"))
    first = qrels.groupBy("query_id").agg(F.min_by("doc_id", "place").alias("first"))
    kept = rows.join(first, "query_id").withColumn("doc_id", F.coalesce(F.nullif("gold", F.lit("")), "first", F.lit("")))
    number = lambda c: F.when(F.col(c).rlike("^[0-9]{1,9}$"), F.col(c).cast("int"))
    spans = kept.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id", "left")
    part = F.nullif(T.strip(T.span_text(F.col("whole"), number("start"), number("end"))), F.lit(""))
    known = F.col("whole").isNotNull()
    return {
        "documents": docs,
        "queries": kept.select("query_id", "query"),
        "qrels": qrels.select("query_id", "doc_id", "relevance"),
        "evidences": spans.select("query_id", F.when(known, F.col("doc_id")).otherwise("").alias("doc_id"), F.coalesce(part, "whole", F.lit("")).alias("evidence")),
        "answers": kept.select("query_id", "doc_id", (F.col("flag") | (F.size("reference_answers") > 0)).alias("answerable"), "reference_answers"),
    }


#: Fields of a JSON object in which texts are looked for, in this order; fixed names.
TEXT_FIELDS = ("text", "answer", "answers", "reference_answers", "extractive_spans", "evidence", "evidences", "supporting_facts")


def collected_texts(rows: DataFrame, value: str, out: str = "texts", fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """``rows`` plus ``out``: the texts within the JSON text ``value``, however deep, stripped, the first of equal ones.

    A text, number or boolean is one; of an array all elements are looked through, of an object ``fields`` in their order.
    What is no JSON, null, or an object without these has none. Each round opens one level of all rows, by their place in the
    table; there are as many rounds as the deepest value has levels, and rows without a deeper one are in none of them.
    """
    spark = rows.sparkSession
    path = scratch(spark, "texts")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    rank = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))])
    level = written.select("_row", F.array().cast("array<int>").alias("place"), F.try_parse_json(value).alias("v")).filter("v is not null")
    found, depth = None, 0
    while True:
        kind = F.schema_of_variant("v")
        nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
        level.select("_row", "place", F.to_json("v").alias("json"), nested.alias("nested"), kind.alias("kind")).write.parquet(f"{path}/level{depth}")
        level = spark.read.parquet(f"{path}/level{depth}")
        plain = F.try_variant_get(F.parse_json("json"), "$", "string")
        texts = level.filter("not nested and kind <> 'VOID'").select("_row", "place", F.when(F.col("kind") == "BOOLEAN", F.initcap(plain)).otherwise(T.strip(plain)).alias("text"))
        found = texts if found is None else found.unionByName(texts)
        inner = level.filter("nested").withColumn("v", F.parse_json("json"))
        if inner.isEmpty():
            break
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        at = F.when(F.col("key").isNull(), F.col("pos")).otherwise(F.element_at(rank, F.col("key")))
        level = opened.select("_row", F.concat("place", F.array(at)).alias("place"), F.col("value").alias("v"), at.alias("_at")).filter("_at is not null").drop("_at")
        depth += 1
    texts = found.filter("text <> ''").groupBy("_row").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])).alias(out))
    return written.drop(out).join(texts, "_row", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop("_row")
