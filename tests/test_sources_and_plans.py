import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.plans import experiment as E
from tessera.plans import plugs
from tessera.sources import corpora as S
from tessera.sources import qa, results
from tessera.streaming import ingest as G


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def beir(tmp_path):
    put(tmp_path / "corpus.jsonl", '{"_id": "d1", "title": "T", "text": "Red fox. It runs."}\n\n{"_id": "d2", "text": "Blue sky. Clouds drift."}\n')
    put(tmp_path / "queries.jsonl", '{"_id": "q1", "text": "red fox runs"}\n{"_id": "q2", "text": "unjudged"}\n')
    put(tmp_path / "qrels/test.tsv", "query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    return str(tmp_path)


def test_beir(spark, tmp_path):
    c = S.load(spark, "beir/fiqa", beir(tmp_path))
    assert {r.doc_id: r.title for r in c.documents.collect()} == {"d1": "T", "d2": ""}
    assert [tuple(r) for r in c.qrels.collect()] == [("q1", "d1", 1)]
    assert S.validate(c) == {}
    S.write_bundle(c, str(tmp_path / "bundle"))
    assert S.load(spark, "bundle", str(tmp_path / "bundle")).queries.count() == 2
    put(tmp_path / "bad.jsonl", '{"title": "no id"}\n')
    with pytest.raises(Exception, match="missing _id"):
        S.beir_documents(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        S.load(spark, "nowhere", "")


def test_msmarco(spark, tmp_path):
    with gzip.open(tmp_path / "msmarco-docs.tsv.gz", "wt") as f:
        f.write("D1\thttp://x\tTitle\tbody\twith\ttabs\n")
    put(tmp_path / "msmarco-docdev-queries.tsv", "1\twhat\tnow\n")
    put(tmp_path / "msmarco-docdev-qrels.tsv", "1 0 D1 2\n3 D4 1\n")
    c = S.load(spark, "msmarco", str(tmp_path), "dev")
    assert c.documents.first().text == "body\twith\ttabs"
    assert c.queries.first().query == "what\tnow"
    assert sorted(map(tuple, c.qrels.collect())) == [("1", "D1", 2), ("3", "D4", 1)]
    put(tmp_path / "short.tsv", "D1\tonly\n")
    with pytest.raises(Exception, match="four fields"):
        S.msmarco_documents(spark, str(tmp_path / "short.tsv")).collect()


def test_task_maps(spark, tmp_path):
    q = put(tmp_path / "queries.json", json.dumps({"a": "x", "b": "y"}))
    assert {r.query_id: r.query for r in S.query_map(spark, q).collect()} == {"a": "x", "b": "y"}
    lines = put(tmp_path / "queries.jsonl", '{"id": 1, "query": "x"}\n{"query_id": "2"}\n')
    assert [tuple(r) for r in S.query_map(spark, lines).collect()] == [("1", "x")]
    r = put(tmp_path / "qrels.json", json.dumps({"a": {"d": 1, "e": 0}, "b": {"f": 0}}))
    assert sorted(map(tuple, S.qrel_map(spark, r).collect()), key=str) == [("a", "d", 1), ("b", None, None)]
    e = put(tmp_path / "evidences.json", json.dumps({"a": [{"doc_id": "d", "evidence_text": None}, None]}))
    assert [tuple(x) for x in S.evidence_map(spark, e).collect()] == [("a", "d", "")]
    a = put(tmp_path / "answers.json", json.dumps({"a": {"doc_id": "d", "reference_answers": [" x ", ""]}}))
    assert [tuple(x) for x in S.answer_map(spark, a).collect()] == [("a", "d", False, ["x"])]


def test_question_sources(spark):
    rows = spark.createDataFrame(
        [("p", "T", "Abs", [("Intro", ["one", ""])], [("Why?", ["yes", " yes "], ["one"]), ("  ", [], [])])],
        "id string, title string, abstract string, full_text array<struct<section_name:string,paragraphs:array<string>>>, qas array<struct<question:string,answers:array<string>,evidence:array<string>>>",
    )
    got = qa.papers(rows)
    assert got["documents"].first().text == "T\n\nAbs\n\nIntro\none"
    assert [tuple(r) for r in got["queries"].collect()] == [("p-q000", "Why?")]
    assert got["answers"].first().reference_answers == ["yes"]
    flat = spark.createDataFrame([("p", "ctx", ["Q?"], ["A"], ["ctx"])], "id string, context string, questions array<string>, answers array<string>, evidences array<string>")
    assert qa.papers(qa.flat_papers(flat))["evidences"].first().evidence == "ctx"
    inline = spark.createDataFrame([("q1", "Q?", ["same", "same ", "other"], "A"), ("q2", "R?", ["same"], "")], "query_id string, question string, contexts array<string>, answer string")
    got = qa.inline_contexts(inline)
    assert got["documents"].count() == 2 and got["qrels"].count() == 3


def test_result_files(spark, tmp_path):
    a = put(tmp_path / "a_FIXED.csv", "k,f1\n1,0.5\n3,bad\n")
    b = put(tmp_path / "b.csv", "k,f1,status\n1,0.7,failed\n")
    rows = results.read_results(spark, [a, b]).orderBy("source_stem", "k").collect()
    assert [(r.source_stem, r.f1, r.status) for r in rows] == [("a_FIXED", 0.5, ""), ("a_FIXED", None, ""), ("b", 0.7, "failed")]


@pytest.mark.parametrize("strategy,options", [("fixed", {"n_chunks": 2}), ("breakpoint", {"kind": "percentile", "amount": 50}), ("single_linkage", {"number_of_chunks": 2}), ("dbscan", {"radius": 0.3})])
def test_experiment(spark, tmp_path, strategy, options):
    corpus = S.load(spark, "beir", beir(tmp_path))
    made = E.run(spark, corpus, E.Experiment(E.Chunking(strategy, options), ks=(1, 3)), str(tmp_path / "stages"))
    got = {r.k: r for r in made["metrics"].collect()}
    assert got[1].precision == 1 and got[1].num_queries == 1 and got[3].ndcg == 1
    again = E.run(spark, corpus, E.Experiment(E.Chunking(strategy, options), ks=(1, 3)), str(tmp_path / "stages"))
    assert again["index"].count() == made["index"].count()


def test_config():
    e = E.from_config(E.merge({"chunking": {"strategy": "fixed", "n_chunks": 3}, "evaluation": {"ks": [5, 1]}}, {"chunking": {"n_chunks": 8}}))
    assert e.chunking.options == {"n_chunks": 8} and e.ks == (1, 5)
    with pytest.raises(ValueError):
        E.Experiment(ks=(True,))


@pytest.mark.parametrize("files", [1, 2, 10])
def test_windows_do_not_change_totals(spark, tmp_path, files):
    docs = spark.createDataFrame([(i, f"Word{i} one. Two words. Three {i % 3}.") for i in range(20)], "doc_id long, text string")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs.repartition(4).write.parquet(source)
    assert G.ingest(spark, source, target, state, files_per_window=files) == -(-4 // files)
    assert G.ingest(spark, source, target, state) == 0
    docs.withColumn("doc_id", docs.doc_id + 100).coalesce(1).write.mode("append").parquet(source)
    assert G.ingest(spark, source, target, state) == 1
    got = G.totals(spark, target).first()
    want = G.measure(docs).agg(F.sum("num_chunks"), F.avg("boundary_clarity")).first()
    assert got.n == 40 and got.num_chunks == 2 * want[0] and got.boundary_clarity == pytest.approx(want[1])


def test_kept_stages_are_of_their_corpus(spark, tmp_path):
    one = S.load(spark, "beir", beir(tmp_path / "one"))
    put(tmp_path / "two/corpus.jsonl", '{"_id": "d1", "text": "Red fox. It runs."}\n{"_id": "d2", "text": "Another. Text of. Three."}\n')
    two = S.Corpus(S.beir_documents(spark, str(tmp_path / "two/corpus.jsonl")), one.queries, one.qrels)
    stages = str(tmp_path / "stages")
    texts = lambda c: sorted(r.text for r in E.run(spark, c, E.Experiment(), stages)["chunks"].collect())
    first, second = texts(one), texts(two)
    assert first != second and texts(one) == first == sorted(r.text for r in E.run(spark, one, E.Experiment())["chunks"].collect())
    kept = [p for p in (tmp_path / "stages").iterdir()][0] / "chunks-data"
    assert len(list(kept.iterdir())) == 1  # the second run of the same corpus found it
    for part in kept.glob("*/part-*"):  # a table that lost rows is made again
        part.unlink()
    assert texts(one) == first and texts(two) == second


def test_tasks(spark, tmp_path):
    c = S.load(spark, "beir", beir(tmp_path))
    evidence = spark.createDataFrame([("q1", "d1", "It runs.")], "query_id string, doc_id string, evidence string")
    answers = spark.createDataFrame([("q1", "d1", True, ["It runs."]), ("q2", "d2", False, ["x"])], "query_id string, doc_id string, answerable boolean, reference_answers array<string>")
    full = S.Corpus(c.documents, c.queries, c.qrels, evidence, answers)
    made = E.run(spark, full, E.Experiment(ks=(1, 2), tasks=E.TASKS))
    assert {r.k: r.recall for r in made["evidence"].collect()} == {1: 0.0, 2: 1.0}  # "Red fox." ranks before "It runs."
    assert [r.query_id for r in made["answers"].collect()] == ["q1"] and made["qa_similarity"].first().num_queries == 1
    with pytest.raises(ValueError):
        E.run(spark, c, E.Experiment(tasks=("answers",)))
    with pytest.raises(ValueError):
        E.Experiment(tasks=("other",))


def test_plug_points(spark):
    plugs.register("splitter", "halves", lambda: lambda text: F.array(F.substring(text, 1, 4), F.substring(text, 5, 4)))
    docs = spark.createDataFrame([("d", "abcdefgh")], "doc_id string, text string")
    got = E.chunk_documents(docs, E.Experiment(E.Chunking("fixed", {"n_chunks": 2}), splitter="halves")).orderBy("position").collect()
    assert [r.text for r in got] == ["abcd", "efgh"]
    with pytest.raises(ValueError):
        plugs.register("other", "x", None)
    with pytest.raises(ValueError):
        plugs.get("embedder", "none")
    with pytest.raises(ValueError):
        E.Chunking("fixed", {"n_chunks": True})


def test_one_window_at_a_time(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Word{i} one. Two words.") for i in range(25)], "doc_id long, text string")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    G.lay_out(docs, source, 10)
    assert [G.ingest(spark, source, target, state, drain=False, index=True) for _ in range(4)] == [1, 1, 1, 0]
    assert G.totals(spark, target).first().n == 25
    assert spark.read.parquet(f"{target}/index").count() == spark.read.parquet(f"{target}/chunks").count()
    with pytest.raises(ValueError, match="vectors of"):
        G.append_index(spark.createDataFrame([([1.0],)], "vector array<double>"), f"{target}/index", 9)


def test_readers_say_what_is_wrong(spark, tmp_path):
    for text, read, what in (("1\n", S.msmarco_queries, "two fields"), ("1 0\n", S.msmarco_qrels, "three fields")):
        with pytest.raises(Exception, match=what):
            read(spark, put(tmp_path / "x.tsv", text)).collect()
    twice = put(tmp_path / "c.jsonl", '{"_id": "a", "text": "old"}\n\n{"_id": "b", "text": "b"}\n{"_id": "a", "text": "new"}\n')
    assert {r.doc_id: r.text for r in S.beir_documents(spark, twice).collect()} == {"a": "new", "b": "b"}
    assert {r.doc_id: r.text for r in S.beir_documents(spark, twice, 3).collect()} == {"a": "old", "b": "b"}
    e = put(tmp_path / "e.json", json.dumps({"q": ["no object", {"doc_id": "d", "evidence_text": "t"}]}))
    assert [tuple(r) for r in S.evidence_map(spark, e).collect()] == [("q", "d", "t")]


def test_answers_without_sentences_open_with_the_first_chunk(spark):
    queries = spark.createDataFrame([("q", "why"), ("r", "why")], "query_id string, query string")
    found = spark.createDataFrame([("q", 1, "first", []), ("q", 2, "second", [])], "query_id string, rank int, text string, sentences array<string>")
    assert {r.query_id: r.answer for r in A.extractive_answers(queries, found).collect()} == {"q": "first", "r": ""}


def test_profiles_laid_over_each_other(spark, tmp_path):
    base = put(tmp_path / "base.yaml", "chunking: {strategy: fixed, n_chunks: 3}\nembedding: {dimensions: 16}\nevaluation: {ks: [5, 1, 5]}\n")
    over = put(tmp_path / "over.yaml", "chunking:\n  n_chunks: 8\nretrieval: {distance: l2}\n")
    empty = put(tmp_path / "empty.yaml", "")
    e = E.from_config(E.read_config(base, over, empty))
    assert (e.chunking.options, e.dimensions, e.metric, e.ks) == ({"n_chunks": 8}, 16, "l2", (1, 5))


def test_capped_corpus_and_valid_units(spark):
    from tessera.operators import split

    docs = spark.createDataFrame([(f"d{i}", "T", f"text {i}", "") for i in range(5)], S.DOCUMENT)
    queries = spark.createDataFrame([(f"q{i}", "?") for i in range(4)], "query_id string, query string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{j}", 1) for i in range(4) for j in range(5)], "query_id string, doc_id string, relevance int")
    small = S.capped(S.Corpus(docs, queries, qrels), 2, 3)
    assert sorted(r.doc_id for r in small.documents.collect()) == ["d0", "d1"] and small.queries.count() == 3
    assert small.qrels.count() == 6 and S.validate(small) == {}
    assert S.capped(S.Corpus(docs, queries, qrels)).qrels.count() == 20
    units = spark.createDataFrame([("d", 0, "t"), (" ", 1, "t"), ("d", None, "t"), ("d", 2, None)], "doc_id string, sentence_idx int, text string")
    with pytest.raises(ValueError, match="doc_id is missing or blank: 1; sentence_idx is missing or negative: 1; text is missing: 1"):
        split.valid_units(units)
    assert split.valid_units(units.limit(1)).count() == 1


def test_summary_tables(spark, tmp_path):
    from tessera.operators import reporting

    wide = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.1)], "stem string, f1 double")
    reporting.write_summary(wide, wide.filter("f1 > 0.6"), str(tmp_path / "s"))
    read = lambda name: spark.read.csv(str(tmp_path / "s" / name), header=True)
    assert {(r.name, r.n_rows) for r in read("manifest").collect()} == {("all_runs", "3"), ("best_per_method", "1")}
    assert read("best_per_method").first().stem == "b"


def test_documents_are_split_once(spark):
    docs = spark.createDataFrame([("a", "One. Two."), ("b", " "), ("c", None)], "doc_id string, text string")
    chunks = E.chunk_documents(docs, E.Experiment())
    assert [(r.doc_id, r.text) for r in chunks.orderBy("position").collect()] == [("a", "One."), ("a", "Two.")]
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # not in a filter beside it
