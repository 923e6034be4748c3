"""Question sources of three shapes, and tar archives as tables."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import archives, corpora, qa, results


def test_numbers_of_many_questions_differ(spark):
    rows = spark.createDataFrame([("p", [(f"q{i}?",) for i in range(1200)])], "doc_id string, qas array<struct<question:string>>")
    got = {r.at: r.query_id for r in qa.number_questions(rows).collect()}
    assert len(set(got.values())) == 1200 and got[7] == "p-q007" and got[999] == "p-q999" and got[1000] == "p-q1000"


def test_paper_text(spark):
    rows = spark.createDataFrame(
        [(1, " T ", None, [("Name", [" a ", None, "", "b"]), ("Alone", []), (None, ["c"]), ("No list", None), ("  ", ["d"])]), (2, None, "Only", None), (3, "", "", [])],
        "id int, title string, abstract string, full_text array<struct<section_name:string,paragraphs:array<string>>>",
    )
    got = {r.id: r.t for r in rows.select("id", qa.paper_text(F.col("title"), F.col("abstract"), F.col("full_text")).alias("t")).collect()}
    assert got == {1: "T\n\nName\na\nb\n\nc\n\nd", 2: "Only", 3: ""}


def by(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows.collect())


def test_support_questions(spark):
    docs = [("d", json.dumps({"title": " ", "text": " abcdef "})), ("e", json.dumps({"title": "E", "content": "other"})), ("gone", json.dumps({"text": " "}))]
    asked = [
        {"QUESTION_ID": "q1", "QUESTION_TEXT": "Why?", "DOC_IDS": ["e", "gone", "d"], "ANSWERABLE": "Y", "DOCUMENT": "d", "ANSWER": "bc", "START_OFFSET": 1, "END_OFFSET": "3"},
        {"QUESTION_ID": "q2", "QUESTION_TITLE": "Title only", "DOC_IDS": ["e", "d"], "ANSWERABLE": "N", "DOCUMENT": "-", "ANSWER": "-", "START_OFFSET": "-", "END_OFFSET": "-"},
        {"question": "No id", "DOC_IDS": [], "DOCUMENT": "d", "ANSWER": "x", "START_OFFSET": 2, "END_OFFSET": 99},
        {"QUESTION_ID": "q4", "QUESTION_TEXT": "No document", "DOC_IDS": ["gone"], "DOCUMENT": "nowhere"},
        {"QUESTION_ID": "q5", "QUESTION_TEXT": " "},
        {"QUESTION_ID": "q6", "QUESTION_TEXT": "Gold is no document", "DOC_IDS": ["e"], "DOCUMENT": "nowhere", "ANSWERABLE": "y"},
        {"QUESTION_ID": "q1", "question_id": "other", "QUESTION_TEXT": "Why again?", "DOC_IDS": ["d", "d"], "DOCUMENT": "d", "ANSWER": "cd", "START_OFFSET": 2, "END_OFFSET": 4},
    ]
    elements = spark.createDataFrame([("m", i, json.dumps(q)) for i, q in enumerate(asked)], "member string, at long, value string")
    got = qa.support_questions(elements, qa.support_documents(spark.createDataFrame(docs, "key string, value string")))
    assert by(got["documents"], "doc_id", "title", "text") == [("d", "abcdef", "abcdef"), ("e", "E", "other")]
    assert by(got["queries"], "query_id", "query") == [("q1", "Why again?"), ("q2", "Title only"), ("q6", "Gold is no document"), ("techqa-q-000002", "No id")]
    assert by(got["qrels"], "query_id", "doc_id", "relevance") == [("q1", "d", 2), ("q2", "d", 1), ("q2", "e", 1), ("q6", "e", 1), ("techqa-q-000002", "d", 2)]
    assert by(got["evidences"], "query_id", "doc_id", "evidence") == [("q1", "d", "cd"), ("q2", "e", "other"), ("q6", "", ""), ("techqa-q-000002", "d", "abcdef")]
    assert by(got["answers"], "query_id", "doc_id", "answerable", "reference_answers") == [("q1", "d", True, ["cd"]), ("q2", "e", False, []), ("q6", "nowhere", True, []), ("techqa-q-000002", "d", True, ["x"])]


def test_passage_tables(spark):
    docs = spark.createDataFrame([("T", ["a", "b", " "], ["text a", " ", "c"])], "title string, passage_ids array<string>, passages array<string>")
    queries = spark.createDataFrame([("q1", "one", None, None, None), ("q2", "two", "x", ["yes", " yes"], ["told"]), ("q3", "no judgement", None, None, None), ("q4", "text lacks", "y", [], [" "]), ("q5", " ", None, None, None)], "query_id string, query string, doc_id string, answers array<string>, evidences array<string>")
    qrels = spark.createDataFrame([("q1", "zz", "2", 0), ("q1", "a", None, 1), ("q2", "a", "1", 2), ("q3", "a", "0", 3), ("q4", "b", "1", 4), ("q5", "a", "1", 5), ("q1", "a2", "-1", -1)], "query_id string, doc_id string, score string, at int")
    got = qa.passage_tables(docs, queries, qrels)
    assert by(got["documents"], "doc_id", "title", "text") == [("a", "T", "text a")]
    assert by(got["queries"], "query_id") == [("q1",), ("q2",), ("q4",)]
    assert by(got["evidences"], "query_id", "doc_id", "evidence") == [("q1", "", ""), ("q2", "x", "told"), ("q4", "y", "")]
    assert by(got["answers"], "query_id", "doc_id", "answerable") == [("q1", "zz", False), ("q2", "x", True), ("q4", "y", False)]
    first = qa.passage_tables(docs, queries, qrels.drop("at"))  # now the least id is first: a, with a text
    assert ("q1", "a", "text a") in by(first["evidences"], "query_id", "doc_id", "evidence")


def test_results_are_not_written_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="no results"):
        results.write_results(spark.createDataFrame([], "k int"), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()


@pytest.mark.parametrize("value", [{}, [], {"a": 1}, [1, -2.5, None, True, "x"], {"k\\\"]": {"x": ["}", "\\", '\\"', {"y": [[], {}]}], "ü": "é,漢"}, "": "b"}, [[1, [2, [3]]], {"a": "\\\\"}, '"', "\\"]])
def test_elements_of_pieces_cut_anywhere(value):
    rng = random.Random(1)
    for indent in (None, 2):
        for ascii_only in (True, False):
            raw = json.dumps(value, indent=indent, ensure_ascii=ascii_only).encode()
            for _ in range(40):
                parser, got, at = archives.Elements(), [], 0
                while at < len(raw):
                    step = rng.choice([1, 2, 3, 7, 1000])
                    got += list(parser.feed(raw[at : at + step]))
                    at += step
                parser.close()
                assert [(k, json.loads(v)) for k, v in got] == (list(value.items()) if isinstance(value, dict) else [(None, v) for v in value])
    parser = archives.Elements()
    list(parser.feed(b'{"a": [1, "'))
    with pytest.raises(ValueError, match="ends within"):
        parser.close()


def test_archives_round_trip(spark, tmp_path):
    rows = [(f"docs/{i}.json", json.dumps({f"d{i}": {"t": "a, b}\n" * i}, "e": [1]})) for i in range(60)] + [("x" * 130 + "/é.json", "[1, 2]"), ("none.json", None), ("even.json", "[" + "1," * 254 + "10]"), ("lines.txt", "a\n\nb b")]
    archives.write_archives(spark.createDataFrame(rows, "name string, content string").repartition(3), str(tmp_path / "a"))
    names = []
    for file in (tmp_path / "a").glob("*.gz"):
        with tarfile.open(file) as tar:
            names += tar.getnames()
    assert sorted(names) == sorted(n for n, _ in rows)
    got = archives.members(spark, str(tmp_path / "a"), "*.json").collect()
    assert sorted((r.member, r.at, r.key, json.dumps(json.loads(r.value))) for r in got if r.key) == sorted((m, i, k, json.dumps(v)) for m, c in rows if c and c[0] == "{" for i, (k, v) in enumerate(json.loads(c).items()))
    assert [r.value for r in sorted(got, key=lambda r: r.at) if "é" in r.member] == ["1", "2"] and sum(r.member == "even.json" for r in got) == 255
    assert [r.value for r in archives.members(spark, str(tmp_path / "a"), "lines.txt", "lines").orderBy("at").collect()] == ["a", "", "b b"]
    assert {r.archive.rpartition(".")[2] for r in got} == {"gz"}
    with pytest.raises(ValueError):
        archives.members(spark, str(tmp_path / "a"), kind="other")
    (tmp_path / "none").mkdir()
    assert archives.members(spark, str(tmp_path / "none")).collect() == []


def test_archives_of_others(spark, tmp_path):
    """As tar programs make them: folders, links, other formats, binary members, two archives in one task."""
    for n, form in enumerate((tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT)):
        with tarfile.open(tmp_path / f"{n}.tar.gz", "w:gz", format=form) as tar:
            folder = tarfile.TarInfo("d")
            folder.type = tarfile.DIRTYPE
            tar.addfile(folder)
            for name, data in (("d/bytes.bin", bytes(range(256)) * 40), (f"d/{'long' * 22}.json", b'{"n": %d}' % n), ("d/Q_A.json", b'[{"a": "}"}, {"b": 2}]')):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("d/link.json")
            link.type, link.linkname = tarfile.SYMTYPE, "Q_A.json"
            tar.addfile(link)
    got = archives.members(spark, str(tmp_path), "*.json").collect()
    assert sorted((r.archive.rpartition("/")[2], r.at, r.key or "", r.value) for r in got) == sorted(
        x for n in range(3) for x in ((f"{n}.tar.gz", 0, "n", str(n)), (f"{n}.tar.gz", 0, "", '{"a": "}"}'), (f"{n}.tar.gz", 1, "", '{"b": 2}'))
    )
    data = (tmp_path / "0.tar.gz").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.tar.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception):  # noqa: B017
        archives.members(spark, str(tmp_path / "cut"), "*.json").collect()


def test_corpus_of_archives(spark, tmp_path):
    rows = [("train_technotes.json", json.dumps({"d": {"text": "It runs. Fast."}})), ("train_Q_A.json", json.dumps([{"QUESTION_ID": "q", "QUESTION_TEXT": "how", "DOC_IDS": ["d"]}]))]
    archives.write_archives(spark.createDataFrame(rows, "name string, content string").coalesce(1), str(tmp_path))
    corpus = corpora.load(spark, "techqa-archives", str(tmp_path), "train")
    assert corpora.validate(corpus) == {} and corpus.queries.first().query == "how" and corpus.evidences.first().evidence == "It runs. Fast."
