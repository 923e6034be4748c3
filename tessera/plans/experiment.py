"""An experiment: corpus, chunking, embedding, retrieval and scores as one lazy plan, stages kept by what they depend on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import answers as A
from tessera.operators import retrieval as N
from tessera.operators import split as S
from tessera.plans import plugs
from tessera.sources.corpora import Corpus

TASKS = ("document_retrieval", "evidence_retrieval", "answers")
SCHEMA_VERSION = 2


@dataclass(frozen=True)
class Chunking:
    """A registered chunker; ``options`` go to it."""

    strategy: str = "fixed"
    options: dict = field(default_factory=lambda: {"n_chunks": 5})

    def __post_init__(self):
        plugs.get("chunker", self.strategy, **self.options)


@dataclass(frozen=True)
class Experiment:
    chunking: Chunking = Chunking()
    dimensions: int = 32
    metric: str = "cosine"
    ks: tuple[int, ...] = (1, 3, 5, 10)
    splitter: str = "sentence"
    router: str = "default"
    embedder: str = "hashed"
    retriever: str = "exact"
    instruction: str | None = None
    tasks: tuple[str, ...] = ("document_retrieval",)

    def __post_init__(self):
        if not self.ks or any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in self.ks):
            raise ValueError("ks must be positive whole numbers")
        if not self.tasks or set(self.tasks) - set(TASKS):
            raise ValueError(f"tasks must be some of {TASKS}")
        for kind in ("splitter", "router", "embedder", "retriever"):
            if getattr(self, kind) not in plugs.names(kind):
                raise ValueError(f"unknown {kind} {getattr(self, kind)!r}; one of {plugs.names(kind)}")

    def manifest(self, corpus: Corpus) -> dict:
        """What the kept chunks and vectors depend on, the corpus included; ks and tasks are no part of it."""
        whole = asdict(self)
        return {"schema_version": SCHEMA_VERSION, "corpus": corpus.digest} | {k: whole[k] for k in ("chunking", "dimensions", "metric", "splitter", "router", "embedder", "retriever", "instruction")}

    def embed(self, text):
        return plugs.get("embedder", self.embedder, dimensions=self.dimensions)(text)


def fingerprint(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()[:16]


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, nested mappings key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_config(config: dict) -> Experiment:
    """A nested mapping (say, a YAML file's) to an experiment; what it lacks is as in ``Experiment``."""
    c = dict(config.get("chunking", {}))
    chunking = Chunking(c.pop("strategy", "fixed"), c or {"n_chunks": 5})
    at = lambda section, key: config.get(section, {}).get(key)
    rest = {
        "dimensions": at("embedding", "dimensions"),
        "embedder": at("embedding", "name"),
        "instruction": at("embedding", "instruction"),
        "metric": at("retrieval", "distance"),
        "retriever": at("retrieval", "name"),
        "splitter": at("split", "name"),
        "router": at("router", "name"),
        "ks": at("evaluation", "ks"),
        "tasks": at("evaluation", "tasks"),
    }
    rest = {k: tuple(sorted(set(v))) if k == "ks" else tuple(v) if k == "tasks" else v for k, v in rest.items() if v is not None}
    return Experiment(chunking, **rest)


def read_config(*paths: str) -> dict:
    """YAML profiles, each laid over those before it."""
    import yaml

    out: dict = {}
    for path in paths:
        with open(path) as f:
            out = merge(out, yaml.safe_load(f) or {})
    return out


def chunk_documents(docs: DataFrame, experiment: Experiment) -> DataFrame:
    """(doc_id, position, chunk_id, text)."""
    routed = plugs.get("router", experiment.router)(S.drop_blank(docs))
    split = plugs.get("splitter", experiment.splitter)
    # an outer generator of one row: else the filter is pushed below the split, which then runs twice
    cut = routed.select("*", F.explode_outer(F.array(split(F.col("text")))).alias("sentences"))
    rows = cut.filter("size(sentences) > 0").withColumn("vectors", F.transform("sentences", experiment.embed))
    return plugs.get("chunker", experiment.chunking.strategy, **experiment.chunking.options)(rows)


def kept(spark: SparkSession, path: str | None, manifest: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept for ``path`` if its manifest is the same and it has as many rows as that says, else what ``make`` gives, kept there.

    Each run writes a folder of its own and then the manifest that names it: a run that ends between the two leaves the
    table before it in place, and of two at once both tables stay whole.
    """
    if path is None:
        return make()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-manifest/_SUCCESS")
    want = json.dumps(manifest, sort_keys=True)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        found = spark.read.schema(KEPT).json(f"{path}-manifest").first()
        if found and found.manifest == want and found.data:
            rows = spark.read.schema(StructType.fromJson(json.loads(found.schema))).parquet(found.data)
            if rows.count() == found.n_rows:
                return rows
    data = f"{path}-data/{uuid.uuid4().hex}"
    make().write.parquet(data)
    rows = spark.read.parquet(data)
    spark.createDataFrame([(want, rows.schema.json(), rows.count(), data)], KEPT).coalesce(1).write.mode("overwrite").json(f"{path}-manifest")
    return rows


#: What a manifest says of a kept table.
KEPT = "manifest string, schema string, n_rows long, data string"


def _searched(index: DataFrame, queries: DataFrame, experiment: Experiment) -> DataFrame:
    """Hits (query_id, rank, item_id, score) of the queries' texts."""
    text = plugs.prefixed(F.col("query"), experiment.instruction)
    retrieve = plugs.get("retriever", experiment.retriever, metric=experiment.metric)
    return retrieve(index, queries.select("query_id", experiment.embed(text).alias("query_vector")), max(experiment.ks))


def run(spark: SparkSession, corpus: Corpus, experiment: Experiment, stages: str | None = None) -> dict[str, DataFrame]:
    """chunks and index, and what each task gives; chunks and index are kept under ``stages`` and used again.

    They are used again only for a corpus of the same content and the same settings. document_retrieval gives ranked
    (documents) and metrics, evidence_retrieval evidence (macro scores at each k), answers answers and
    qa_similarity. A task whose table the corpus lacks is an error.
    """
    chunks, index = _indexed(spark, corpus, experiment, stages)
    out = {"chunks": chunks, "index": index}
    for task in experiment.tasks:
        out |= _TASKS[task](corpus, experiment, chunks, index)
    return out


def _indexed(spark: SparkSession, corpus: Corpus, experiment: Experiment, stages: str | None) -> tuple[DataFrame, DataFrame]:
    manifest = experiment.manifest(corpus) if stages else {}
    root = f"{stages}/{fingerprint(manifest)}" if stages else None
    chunks = kept(spark, root and f"{root}/chunks", manifest, lambda: chunk_documents(corpus.documents, experiment))
    vector = experiment.embed(F.col("text")).alias("vector")
    index = kept(spark, root and f"{root}/index", manifest, lambda: chunks.filter("trim(text) <> ''").select(F.col("chunk_id").alias("item_id"), "chunk_id", "doc_id", vector))
    return chunks, index


#: (task, k, metric, value, status, details): a finished task has a row for each metric and cut-off, another one row for
#: each cut-off that says why.
RESULT = "task string, k int, metric string, value double, status string, details string"


def evaluate(spark: SparkSession, corpus: Corpus, experiment: Experiment, path: str, stages: str | None = None) -> DataFrame:
    """Runs the experiment's tasks and the intrinsic scores of its chunks, writes RESULT under ``path`` and returns it.

    A task that fails, or lacks its table, is skipped, with the error's first line as details; the others go on. Each task
    replaces its rows of an earlier call.
    """
    prepared: list = []

    def stage() -> tuple[DataFrame, DataFrame]:
        if not prepared:
            prepared.append(_indexed(spark, corpus, experiment, stages))
        return prepared[0]

    for task in ("intrinsic", *experiment.tasks):
        try:
            if task == "intrinsic":
                scores = _intrinsic(stage()[0])
            else:
                scores = _TASKS[task](corpus, experiment, *stage())[_SCORES[task]]
            metrics = [c for c in scores.columns if c != "k"]
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])).alias("m")
            k = F.col("k").cast("int") if "k" in scores.columns else F.lit(None).cast("int")
            rows = scores.select(k.alias("k"), each).select("k", "m.metric", "m.value", F.lit("").alias("status"), F.lit("").alias("details"))
            rows.write.mode("overwrite").parquet(f"{path}/task={task}")
        except Exception as e:  # a task's failure is a result, not the end
            ks = [None] if task == "intrinsic" else list(experiment.ks)
            said = (str(e).strip().splitlines() or [type(e).__name__])[0]
            spark.createDataFrame([(k, None, None, "skipped", said) for k in ks], RESULT.removeprefix("task string, ")).write.mode("overwrite").parquet(f"{path}/task={task}")
    return spark.read.schema(f"{RESULT.removeprefix('task string, ')}, task string").parquet(path).select(*[x.split()[0] for x in RESULT.split(", ")])


def _intrinsic(chunks: DataFrame) -> DataFrame:
    """Chunks a document, characters and words a chunk."""
    own = chunks.select("doc_id", F.length("text").alias("c"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"))
    docs = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("c"), F.avg("w").alias("w"))
    return docs.agg(F.avg("n").alias("chunks_per_document"), F.avg("c").alias("chars_per_chunk"), F.avg("w").alias("words_per_chunk"), F.count(F.lit(1)).alias("num_documents"))


def _document_retrieval(corpus: Corpus, experiment: Experiment, chunks: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    hits = _searched(index, N.judged_queries(corpus.queries, corpus.qrels), experiment)
    ranked = N.roll_up(hits, index.select("item_id", "doc_id"))
    return {"ranked": ranked, "metrics": N.macro_metrics(N.query_metrics(ranked, N.positive_qrels(corpus.qrels), experiment.ks))}


def _found(queries: DataFrame, experiment: Experiment, chunks: DataFrame, index: DataFrame) -> DataFrame:
    hits = _searched(index, queries, experiment).join(index.select("item_id", "chunk_id"), "item_id")
    return A.retrieved_chunks(hits, chunks)


def _evidence_retrieval(corpus: Corpus, experiment: Experiment, chunks: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    if corpus.evidences is None:
        raise ValueError("the corpus has no evidences")
    gold = corpus.evidences.select("query_id", "evidence").filter("trim(evidence) <> ''")
    found = _found(N.judged_queries(corpus.queries, gold), experiment, chunks, index)
    each = [A.macro_evidence(A.evidence_scores(found.filter(F.col("rank") <= k), gold)).withColumn("k", F.lit(k)) for k in experiment.ks]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return {"evidence": out}


def _answers(corpus: Corpus, experiment: Experiment, chunks: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    if corpus.answers is None:
        raise ValueError("the corpus has no answers")
    queries = N.judged_queries(corpus.queries, A.answerable(corpus.answers))
    made = A.extractive_answers(queries, _found(queries, experiment, chunks, index))
    return {"answers": made, "qa_similarity": A.answer_similarity(queries, made, experiment.embed)}


_TASKS = {"document_retrieval": _document_retrieval, "evidence_retrieval": _evidence_retrieval, "answers": _answers}
_SCORES = {"document_retrieval": "metrics", "evidence_retrieval": "evidence", "answers": "qa_similarity"}
