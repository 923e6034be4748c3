"""Readers of retrieval corpora: JSON lines and TSV shapes to documents, queries and judgements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, title string, text string, url string"


@dataclass(frozen=True)
class Corpus:
    """documents (doc_id, title, text, url), queries (query_id, query), qrels (query_id, doc_id, relevance).

    Where a task has them, also evidences (query_id, doc_id, evidence) and answers (query_id, doc_id, answerable,
    reference_answers).
    """

    documents: DataFrame
    queries: DataFrame
    qrels: DataFrame
    evidences: DataFrame | None = None
    answers: DataFrame | None = None

    @property
    def digest(self) -> str:
        """Of the documents' number and content, in any order."""
        content = F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", "title", "text") if c in self.documents.columns])
        n, mixed, total = self.documents.agg(F.count(F.lit(1)), F.bit_xor(content), F.sum(content.cast("decimal(38,0)"))).first()
        return f"{n}-{(mixed or 0) & (2**64 - 1):x}-{int(total or 0) % 2**64:x}"


def _text(name: str):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _required(column, what: str):
    return F.when(column.isNull(), F.raise_error(F.lit(f"missing {what}"))).otherwise(column)


def beir_documents(spark: SparkSession, path: str, max_documents: int | None = None) -> DataFrame:
    """JSON lines with _id and, maybe, title, text and url. Of lines with one id the last in the file counts.

    ``max_documents`` takes the lines up to that number, blank ones counted, as they stand in the file.
    """
    rows = spark.read.schema("_id string, title string, text string, url string").option("mode", "FAILFAST").json(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    if max_documents is not None:
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).orderBy("line").limit(max_documents)
        parsed = lines.filter(F.trim("value") != "").select("line", F.from_json("value", rows.schema.simpleString(), {"mode": "FAILFAST"}).alias("d"))
        rows, at = parsed.select("d.*", "line"), F.struct(F.lit("").alias("file"), F.col("line").alias("line"))
    named = rows.select(_required(F.col("_id"), "_id").alias("doc_id"), _text("title"), _text("text"), "url", at.alias("_at"))
    last = named.groupBy("doc_id").agg(F.max_by(F.struct("title", "text", "url"), "_at").alias("d"))
    return last.select("doc_id", "d.title", "d.text", "d.url")


def beir_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("_id string, text string").option("mode", "FAILFAST").json(path)
    return rows.select(_required(F.col("_id"), "_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    """TSV with a header; a score that is no whole number is an error."""
    rows = spark.read.schema("query_id string, doc_id string, relevance int").csv(path, sep="\t", header=True, mode="FAILFAST", enforceSchema=True)
    return rows.select("query_id", "doc_id", "relevance")


def _fields(spark: SparkSession, path: str, pattern: str, limit: int) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.split("value", pattern, limit).alias("f"))


def msmarco_documents(spark: SparkSession, path: str) -> DataFrame:
    """id, url, title and text, cut at the first three tabs; the text may hold more. Plain or gzip."""
    f = F.col("f")
    ok = F.when(F.size(f) == 4, f).otherwise(F.raise_error(F.lit("a document line needs four fields")).cast("array<string>"))
    return _fields(spark, path, "\t", 4).select(ok.alias("f")).select(f[0].alias("doc_id"), f[2].alias("title"), f[3].alias("text"), f[1].alias("url"))


def msmarco_queries(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    ok = F.when(F.size(f) == 2, f).otherwise(F.raise_error(F.lit("a query line needs two fields")).cast("array<string>"))
    return _fields(spark, path, "\t", 2).select(ok.alias("f")).select(f[0].alias("query_id"), f[1].alias("query"))


def msmarco_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Fields between white space: four or more are (query, _, document, relevance), three lack the second."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    f, wide = F.col("f"), F.size("f") >= 4
    pick = lambda a, b: F.when(wide, F.get(f, F.lit(a))).otherwise(F.get(f, F.lit(b)))
    ok = F.when(F.size(f) >= 3, f).otherwise(F.raise_error(F.lit("a judgement line needs three fields")).cast("array<string>"))
    return lines.select(ok.alias("f")).select(f[0].alias("query_id"), pick(2, 1).alias("doc_id"), pick(3, 2).cast("int").alias("relevance"))


def json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object of many keys: (key, value, ord). For the small task files beside a corpus."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", f"map<string,{schema}>", {"mode": "FAILFAST"}))
    return whole.select(F.posexplode(entries).alias("ord", "e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("value"), "ord")


def query_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map, or JSON lines under any of the usual names; lines without id or text are left out."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema("_id string, query_id string, id string, text string, query string").json(path)
        rows = rows.select(F.coalesce("_id", "query_id", "id").alias("query_id"), F.coalesce("text", "query").alias("query"))
        return rows.filter("query_id is not null and query is not null")
    return json_map(spark, path, "string").select(F.col("key").alias("query_id"), F.col("value").alias("query"))


def qrel_map(spark: SparkSession, path: str) -> DataFrame:
    """Positive judgements of a two-level JSON map; a query without any stays, with a null document."""
    rows = json_map(spark, path, "map<string,double>").select(F.col("key").alias("query_id"), F.map_filter("value", lambda _, v: v > 0).alias("m"))
    return rows.select("query_id", F.explode_outer("m").alias("doc_id", "score")).select("query_id", "doc_id", F.col("score").cast("int").alias("relevance"))


def evidence_map(spark: SparkSession, path: str) -> DataFrame:
    """Items that are no objects are left out."""
    rows = json_map(spark, path, "array<string>").select(F.col("key").alias("query_id"), F.explode("value").alias("raw")).filter("trim(raw) like '{%'")
    e = F.from_json("raw", "doc_id string, evidence_text string")
    return rows.select("query_id", e.alias("e")).select("query_id", "e.doc_id", F.coalesce("e.evidence_text", F.lit("")).alias("evidence"))


def answer_map(spark: SparkSession, path: str) -> DataFrame:
    rows = json_map(spark, path, "struct<doc_id:string,answerable:boolean,reference_answers:array<string>>")
    answers = F.filter(F.transform(F.coalesce("value.reference_answers", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    return rows.select(F.col("key").alias("query_id"), "value.doc_id", F.coalesce("value.answerable", F.lit(False)).alias("answerable"), answers.alias("reference_answers"))


TABLES = ("documents", "queries", "qrels", "evidences", "answers")


def write_bundle(corpus: Corpus, path: str, format: str = "parquet") -> None:
    """The normal form: a table each for what the corpus has, as Parquet or JSON lines, and ``metadata`` on them."""
    spark, counts = corpus.documents.sparkSession, {}
    for name in TABLES:
        if (rows := getattr(corpus, name)) is not None:
            rows.write.mode("overwrite").format(format).save(f"{path}/{name}")
            counts[name] = spark.read.format(format).load(f"{path}/{name}").count()
    listed = [("1.0", format, name, n) for name, n in counts.items()]
    spark.createDataFrame(listed, "schema_version string, format string, name string, n_rows long").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


_SCHEMAS = {
    "documents": DOCUMENT,
    "queries": "query_id string, query string",
    "qrels": "query_id string, doc_id string, relevance int",
    "evidences": "query_id string, doc_id string, evidence string",
    "answers": "query_id string, doc_id string, answerable boolean, reference_answers array<string>",
}


def read_bundle(spark: SparkSession, path: str, tasks: tuple[str, ...] = ()) -> Corpus:
    """What ``write_bundle`` wrote. A table that a task of ``tasks`` needs must be there; others may be absent."""
    meta = {r.name: r.format for r in spark.read.json(f"{path}/metadata").collect()}  # five rows at most
    needed = ["documents", "queries", "qrels", *[TASK_TABLES[t] for t in tasks if t in TASK_TABLES]]
    if lacking := [n for n in needed if n not in meta]:
        raise ValueError(f"the bundle lacks {lacking}")
    one = lambda n: (spark.read.parquet if meta[n] == "parquet" else spark.read.schema(_SCHEMAS[n]).json)(f"{path}/{n}")
    return Corpus(*[one(n) if n in meta else None for n in TABLES])


#: What a task needs beside documents, queries and judgements.
TASK_TABLES = {"evidence_retrieval": "evidences", "answers": "answers"}


def capped(corpus: Corpus, max_documents: int | None = None, max_queries: int | None = None) -> Corpus:
    """The first documents and queries by id, and the judgements among them: for trial runs."""
    docs, queries = corpus.documents, corpus.queries
    docs = docs if max_documents is None else docs.orderBy("doc_id").limit(max_documents)
    queries = queries if max_queries is None else queries.orderBy("query_id").limit(max_queries)
    return replace(corpus, documents=docs, queries=queries, qrels=corpus.qrels.join(docs, "doc_id", "left_semi").join(queries, "query_id", "left_semi").select(corpus.qrels.columns))


def faults(corpus: Corpus) -> DataFrame:
    """(fault, n): rows that break a rule, by rule."""
    d, q, r = corpus.documents, corpus.queries, corpus.qrels
    blank = lambda c: f"{c} is null or trim(cast({c} as string)) = ''"
    found = {
        "blank document id": d.filter(blank("doc_id")),
        "document without text": d.filter("text is null"),
        "document id twice": d.groupBy("doc_id").count().filter("count > 1"),
        "blank query id": q.filter(blank("query_id")),
        "judgement without query": r.join(q, "query_id", "left_anti"),
        "judgement without document": r.filter("doc_id is not null").join(d, "doc_id", "left_anti"),
        "judgement without a whole number": r.filter(F.expr("relevance is null and doc_id is not null")),
    }
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.lit(rule).alias("fault"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out.filter("n > 0")


def validate(corpus: Corpus) -> dict[str, int]:
    """Rows that break a rule, by rule; empty when all is well. Counts only reach the driver."""
    return {r.fault: r.n for r in faults(corpus).collect()}


def _beir(spark: SparkSession, root: str, split: str) -> Corpus:
    return Corpus(beir_documents(spark, f"{root}/corpus.jsonl"), beir_queries(spark, f"{root}/queries.jsonl"), beir_qrels(spark, f"{root}/qrels/{split}.tsv"))


def _questions(shape: str):
    def read(spark: SparkSession, root: str, split: str) -> Corpus:
        """Parquet files of the split, in the source's own nested shape."""
        from tessera.sources import qa

        if shape == "papers":
            made = qa.papers(qa.as_papers(spark.read.parquet(f"{root}/{split}*.parquet")))
        else:
            made = qa.inline_contexts(spark.read.parquet(f"{root}/{split}*.parquet"))
        return Corpus(*[made.get(n) for n in TABLES])

    return read


def _archives(spark: SparkSession, root: str, split: str) -> Corpus:
    """Gzipped tar archives whose members named documents and questions of the split hold JSON."""
    from tessera.sources import archives, qa

    docs = qa.support_documents(archives.members(spark, root, "*technotes.json" if split == "all" else f"*{split}*technotes.json"))
    questions = archives.members(spark, root, "*Q_A.json" if split == "all" else f"*{split}*Q_A.json")
    made = qa.support_questions(questions, docs)
    return Corpus(*[made.get(n) for n in TABLES])


def _msmarco(spark: SparkSession, root: str, split: str) -> Corpus:
    """The test split has no judgements."""
    docs, queries = msmarco_documents(spark, f"{root}/msmarco-docs.tsv*"), msmarco_queries(spark, f"{root}/msmarco-doc{split}-queries.tsv*")
    if split == "test":
        return Corpus(docs, queries, queries.limit(0).select("query_id", F.lit("").alias("doc_id"), F.lit(0).alias("relevance")))
    return Corpus(docs, queries, msmarco_qrels(spark, f"{root}/msmarco-doc{split}-qrels.tsv*"))


READERS: dict[str, Callable[[SparkSession, str, str], Corpus]] = {"beir": _beir, "msmarco": _msmarco, "msmarco-docs": _msmarco, "bundle": lambda spark, root, split: read_bundle(spark, root), "qasper": _questions("papers"), "techqa": _questions("contexts"), "techqa-archives": _archives}


def register(name: str, reader: Callable[[SparkSession, str, str], Corpus]) -> None:
    READERS[name] = reader


def load(spark: SparkSession, name: str, root: str, split: str = "test") -> Corpus:
    """``name`` is a registered reader, or beir/<corpus>."""
    key = name if name in READERS else name.split("/")[0]
    if key not in READERS:
        raise ValueError(f"unknown corpus {name!r}; one of {sorted(READERS)}")
    return READERS[key](spark, root, split)
