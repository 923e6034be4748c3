"""Tables laid out by document, nested texts, and the audit of outputs."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import coverage, saved
from tessera.sources import qa


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_saved_units_meet_their_documents_without_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"One {i}. Two. Three!" if i % 9 else "  ", i) for i in range(40)] + [(None, "Null. Id.", -1)], "doc_id string, text string, extra int").repartition(3)
    saved.save(docs, str(tmp_path / "docs"), 4)
    units = docs.filter("extra % 2 = 0").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_idx", "text")).withColumn("text", F.upper("text"))
    saved.save(units, str(tmp_path / "units"), 4, ("sentence_idx",))
    a, b = saved.load(spark, str(tmp_path / "docs")), saved.load(spark, str(tmp_path / "units"))
    got = saved.with_saved_sentences(a, b)
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    assert {(r.doc_id, r.extra): r.sentences for r in got.collect()} == {
        (None, -1): ["Null.", "Id."],
        **{(f"d{i}", i): [] if i % 9 == 0 else [f"ONE {i}.", "TWO.", "THREE!"] if i % 2 == 0 else [f"One {i}.", "Two.", "Three!"] for i in range(40)},
    }
    assert saved.chunks_from_saved(a, b, 2).filter("doc_id = 'd2'").orderBy("position").first().text == "ONE 2. TWO."
    assert saved.with_saved_sentences(a.limit(0), b).collect() == []


def test_collected_texts(spark):
    values = [
        ({"answers": [{"text": " a "}, "b", {"answer": {"text": "c", "evidence": ["a", "d"]}}], "text": "first", "other": "no"}, ["first", "a", "b", "c", "d"]),
        ("plain", ["plain"]),
        ([1, 2.5, True, False, None, [["deep", ["deeper", {"answers": "deepest"}]]]], ["1", "2.5", "True", "False", "deep", "deeper", "deepest"]),
        (None, []),
        ({}, []),
        ([[], [[]], {"x": {"text": "no"}}], []),
        (["b", "a", "b"], ["b", "a"]),
        ("  ", []),
    ]
    rows = [(i, json.dumps(v), "clash") for i, (v, _) in enumerate(values)] + [(98, None, ""), (99, "{no json", ""), (6, json.dumps(["again"]), "")]
    df = spark.createDataFrame(rows, "id int, j string, texts string").repartition(3)
    got = sorted((r.id, r.texts) for r in qa.collected_texts(df, "j").collect())
    assert got == sorted([(i, want) for i, (_, want) in enumerate(values)] + [(98, []), (99, []), (6, ["again"])])
    assert qa.collected_texts(df.limit(0), "j").collect() == []
    assert qa.collected_texts(df.filter("id = 0"), "j", fields=("other",)).first().texts == ["no"]


def test_audit(spark, tmp_path):
    for name, text in {"a/1/x.csv": "k,f1\n1,2\n\n3,4\n", "a/1/y.csv": "k\n5\n", "a/2/x.csv": "k,f1\n", "b/1/x.csv": "", "c/1/x.csv": "k\n1\n", "b/2/x.txt": "k\n1\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    wanted = coverage.combinations(spark, {"kind": ["a", "b"], "k": [1, 2]})
    assert wanted.count() == 4
    got = {(r.kind, r.k): (r.state, r.n_rows) for r in coverage.audit(wanted, coverage.outputs(spark, str(tmp_path), ("kind", "k"))).collect()}
    assert got == {("a", "1"): ("complete", 3), ("a", "2"): ("empty", 0), ("b", "1"): ("empty", 0), ("b", "2"): ("missing", None), ("c", "1"): ("unexpected", 1)}
    with pytest.raises(ValueError):
        coverage.combinations(spark, {"a": []})
