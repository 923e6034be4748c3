import inspect
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import answers as A
from tessera.operators import reporting as R
from tessera.operators import retrieval as N
from tessera.operators import scoring as G
from tessera.plans import experiment as E
from tessera.plans import queries as Q
from tessera.sources import corpora as K
from tessera.operators import split as S


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_by_numpy(spark, metric, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]  # a tie
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, vector array<double>").repartition(5)
    queries = items.filter("item_id < 10").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {}
    for r in N.nearest(items, queries, 4, metric=metric, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    score = u @ u.T if metric == "cosine" else -((v[:, None] - v[None]) ** 2).sum(2)
    assert got == {q: sorted(range(60), key=lambda i: (-round(score[q, i], 9), i))[:4] for q in range(10)}


def test_no_queries_and_no_items(spark):
    items = spark.createDataFrame([], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>")
    assert N.nearest(items, queries, 3).collect() == []
    assert N.nearest(items, queries.limit(0), 3).collect() == []


def test_roll_up_takes_best_score_and_first_rank(spark):
    hits = spark.createDataFrame([(1, 1, 10, 0.9, "a"), (1, 2, 11, 0.8, "b"), (1, 3, 12, 0.7, "a")], "query_id int, rank int, item_id int, score double, doc_id string")
    got = N.roll_up(hits).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.first_rank, r.rank) for r in got] == [("a", 0.9, 1, 1), ("b", 0.8, 2, 2)]


def test_metrics_at_k_judge_all_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    v, label = rng.normal(size=(130, 6)), rng.integers(0, 4, 130)
    spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    v = v.astype(np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    score = np.round(u @ u.T, 9)
    order = [[j for j in sorted(range(130), key=lambda j: (-score[i, j], j)) if j != i] for i in range(130)]
    for r in Q.metrics_at_k(spark, str(tmp_path)).collect():
        found = [(label[order[i][: r.k]] == label[i]).sum() for i in range(130)]
        assert r.num_queries == 130
        assert (r.precision, r.recall) == pytest.approx((np.mean(found) / r.k, np.mean([n / ((label == label[i]).sum() - 1) for i, n in enumerate(found)])), abs=1e-6)


def test_metrics_conventions(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "query_id int, rank int, doc_id string")
    gold = spark.createDataFrame([(1, "y"), (1, "w"), (2, None)], "query_id int, doc_id string")
    got = {(r.query_id, r.k): r for r in N.query_metrics(ranked, gold, (1, 3)).collect()}
    r = got[1, 3]
    assert (r.precision, r.recall) == pytest.approx((1 / 3, 1 / 2))  # by k, not by what was found
    assert r.dcg == pytest.approx(1 / np.log2(3)) and r.ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert got[1, 1].f1 == 0 and got[2, 3].recall == 0 and got[2, 3].ndcg == 0


def test_evidence_and_answers(spark):
    queries = spark.createDataFrame([(1, "What is a red fox? It runs."), (2, "Nothing here.")], "query_id int, query string")
    chunks = spark.createDataFrame([(5, 0, ["It runs.", "A red fox sleeps."]), (6, 0, ["Other."])], "doc_id int, position int, sentences array<string>")
    found = A.chunks_by_shared_sentences(queries, chunks)
    assert [(r.query_id, r.doc_id) for r in found.collect()] == [(1, 5)]
    scores = {r.query_id: r for r in A.evidence_scores(found, queries.withColumnRenamed("query", "evidence")).collect()}
    assert (scores[1].precision, scores[1].recall) == (0.5, 0.5) and scores[2].f1 == 0
    answers = {r.query_id: r.answer for r in A.extractive_answers(queries, found).collect()}
    assert answers == {1: "It runs. A red fox sleeps.", 2: ""}  # 0.7 * 2/6 + 0.3 against 0.7 * 2/6 + 0.3 * 2/3


def test_reports(spark):
    rows = spark.createDataFrame(
        [("x_DBSCAN_1", "", 1, 0.5, ""), ("x_FIXED_1", None, 1, 0.7, "failed"), ("y_fixed_2", "", 3, 0.4, None), ("plain", "", 1, float("nan"), "partial")],
        "stem string, chunking string, k int, f1 double, status string",
    )
    marked = rows.withColumn("variant", R.infer_method(F.col("stem"), F.col("chunking")).getField("variant"))
    assert {r.stem: r.variant for r in marked.collect()} == {"x_DBSCAN_1": "clustering_dbscan", "x_FIXED_1": "fixed", "y_fixed_2": "fixed", "plain": "unknown"}
    assert R.usable(marked).count() == 3
    wide = R.pivot_by_k(marked, ["stem", "variant"], ["f1"], (1, 3))
    best = {r.variant: (r["f1@1"], r["f1@1 run"]) for r in R.best_per_method(wide, "variant", "stem", ["f1@1"]).collect()}
    assert best["fixed"] == (0.7, "x_FIXED_1") and best["unknown"] == (None, "")
    with pytest.raises(ValueError):
        R.union_rows()


def test_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "id string, ord int, v string")
    assert sorted(map(tuple, S.last_wins(rows, ["id"], "ord").collect())) == [("a", 1, "z"), ("b", 2, "y")]


def test_merge_lists_in_order_of_first_appearance(spark):
    rows = spark.createDataFrame([(1, 2, ["b", "c"]), (1, 1, ["a", "b"])], "k int, o int, v array<string>")
    assert R.merge_lists(rows, ["k"], "o", "v").first().v == ["a", "b", "c"]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_of_text_ids_null_vectors_and_ties(spark, monkeypatch, metric):
    monkeypatch.setattr(N, "ITEMS", 7)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (60, 3)).astype(float).tolist()
    items = [(f"i{rng.integers(10**6)}", v) for v in vectors] + [("i1", vectors[0]), ("i1", vectors[0]), (None, vectors[1]), ("none", None)]
    queries = [(f"q{i}", v) for i, v in enumerate(vectors[:9])] + [("q0", vectors[0]), (None, vectors[2]), ("none", None)]
    i = spark.createDataFrame(items, "item_id string, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, query_vector array<float>")
    want = []
    for qid, x in queries:
        scored = []
        for iid, v in items:
            if x is not None and v is not None:
                x_, v_ = np.array(x), np.array(v)
                s = x_ @ v_ / (max(np.linalg.norm(x_), 1e-12) * max(np.linalg.norm(v_), 1e-12)) if metric == "cosine" else -((x_ - v_) ** 2).sum()
                scored.append((-round(s, 9) + 0.0, iid is None, iid or ""))
        want += [(qid, n + 1, None if t[1] else t[2]) for n, t in enumerate(sorted(scored)[:5])]
    for block in (2, 2048):
        got = N.nearest(i, q, 5, metric=metric, block=block)
        assert sorted(((r.query_id, r["rank"], r.item_id) for r in got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(Exception, match="vectors of"):
        N.nearest(i, spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "query_id string, query_vector array<double>"), 2).collect()


def test_scores_by_ones_own_scorer(spark, tmp_path):
    """Each pair is scored once, also over calls; two models do not mix."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        def score(texts, given):
            calls.add(len(texts))
            return [10.0 + len(t) - (0 if g is None else len(set(t) & set(g))) for t, g in zip(texts, given, strict=True)]

        return score

    docs = spark.createDataFrame([("a", ["xy", "yz", "xy", "yz"]), ("b", ["xy", "yz"]), ("c", ["one"]), ("d", []), (None, ["", "xy"])], "doc_id string, texts array<string>").repartition(2)
    cache = str(tmp_path / "scores")
    got = {r.doc_id: r.boundary_clarity for r in G.boundary_clarity(docs, make, "m", cache=cache).collect()}
    assert got == pytest.approx({"a": (11 / 12) * 2 / 3 + (11 / 12) / 3, "b": 11 / 12, "c": 1.0, "d": 1.0, None: 1.0})
    assert calls.value == 5  # xy and yz plain and given each other, xy given nothing but blanks
    G.boundary_clarity(docs, make, "m", cache=cache).collect()
    assert calls.value == 5
    G.boundary_clarity(docs, make, "other", cache=cache).collect()
    assert calls.value == 10
    stick = {r.doc_id: (r.complete_edges, r.incomplete_edges) for r in G.stickiness(docs, make, "m", threshold=0.01, delta=1, cache=cache).collect()}
    assert stick == {"a": (6.0, 3.0), "b": (1.0, 0.0), "c": (0.0, 0.0), "d": (0.0, 0.0), None: (0.0, 0.0)}
    assert G.boundary_clarity(docs.limit(0), make, "m").collect() == []


def test_lexical_scorer_reads_each_text_once(monkeypatch):
    read = []
    token = G._TOKEN
    monkeypatch.setattr(G, "_TOKEN", type("Counting", (), {"findall": staticmethod(lambda t: read.append(t) or token.findall(t))}))
    texts = ["one two", "two three", "four"]
    pairs = [(t, g) for t in texts for g in (None, *texts)]
    got = G.lexical()([t for t, _ in pairs], [g for _, g in pairs])
    assert got[:4] == pytest.approx([2.0, 1.0, 1.5, 2.0])
    assert sorted(x for x in read if x) == sorted(texts)


def test_evaluation_goes_on_after_a_failing_task(spark, tmp_path):
    text = [("d1", "T", "Red fox. It runs.", ""), ("d2", "", "Blue sky. Clouds drift.", "")]
    corpus = K.Corpus(spark.createDataFrame(text, K.DOCUMENT), spark.createDataFrame([("q1", "red fox runs")], "query_id string, query string"), spark.createDataFrame([("q1", "d1", 1)], "query_id string, doc_id string, relevance int"))
    rows = E.evaluate(spark, corpus, E.Experiment(ks=(1, 3), tasks=E.TASKS), str(tmp_path / "e")).collect()
    skipped = {(r.task, r.k, r.details) for r in rows if r.status == "skipped"}
    assert skipped == {(t, k, f"the corpus has no {n}") for t, n in (("evidence_retrieval", "evidences"), ("answers", "answers")) for k in (1, 3)}
    assert {(r.metric, r.value) for r in rows if r.task == "document_retrieval" and r.k == 1} >= {("precision", 1.0), ("f1", 1.0)}
    assert {r.metric: r.value for r in rows if r.task == "intrinsic"}["num_documents"] == 2


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block", [2, 2048])
def test_best_holds_few_scores_at_a_time(metric, block):
    """F10, F11, F14, F16, F18, F19: a task's memory does not grow with queries times items."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(2048, 4)), rng.normal(size=(8192, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["item_id", "vector"])
    rest = {"block": block} if "block" in inspect.signature(N._best).parameters else {}
    tracemalloc.start()
    (got,) = N._best(SimpleNamespace(value=q), 10, metric, **rest)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    u, w = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, v)) if metric == "cosine" else (q, v)
    found = got.to_pandas().groupby("slot")["item_id"].apply(list)
    for i in range(0, 2048, 97):
        score = np.round(w @ u[i] if metric == "cosine" else -np.square(v - q[i]).sum(1), 9)
        assert found[i] == np.lexsort((np.arange(len(v)), -score))[:10].tolist()


def test_small_blocks_of_queries_share_a_pass(spark, monkeypatch):
    """as many passes over the items as the queries' size asks for, not as many as there are blocks."""
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, vector array<double>")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"))
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or send(self, x))
    one = N.nearest(items, queries, 5, block=2).collect()
    assert len(sent) == 1
    monkeypatch.setattr(N, "COMPONENTS", 30)  # ten queries at a time
    assert sorted(N.nearest(items, queries, 5, block=2).collect()) == sorted(one) and len(sent) >= 7
