"""Corpora of JSON lines as a data source, windows with state, running numbers over ids of any kind."""

import gzip
import json
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import split as S
from tessera.streaming import ingest as G
from tessera.streaming import source


def corpus(path, n=57, files=3, seed=0):
    """Files with blank lines, long lines, signs of several bytes, a missing last line end; ids in order of the files."""
    rng, ids = random.Random(seed), []
    path.mkdir()
    for f in range(files):
        out = []
        for i in range(n):
            ids.append(f"d{f}-{i:03d}")
            out.append(json.dumps({rng.choice(["_id", "id", "doc_id"]): ids[-1], "title": None, "text": "é漢. " * rng.choice([0, 1, 5, 400])}, ensure_ascii=False))
            out += [""] * rng.randrange(2)
        data = "\n".join(out).encode() + b"\n" * (f % 2)
        if f == files - 1:
            (path / f"{f}.jsonl.gz").write_bytes(gzip.compress(data))
        else:
            (path / f"{f}.jsonl").write_bytes(data)
    (path / "_hidden.jsonl").write_text("no JSON")
    return ids


@pytest.mark.parametrize("chunk", [1, 7, 100, 5000, 10**9])
def test_lines_of_any_ranges(tmp_path, chunk):
    data = ("a\n\nbb\n" + "c" * 300 + "\r\n \nlast").encode()
    (tmp_path / "f").write_bytes(data)
    got = [x for a in range(0, len(data), chunk) for x in source.lines(str(tmp_path), str(tmp_path / "f"), a, min(a + chunk, len(data)))]
    assert got == [b"a", b"bb", b"c" * 300 + b"\r", b"last"]


@pytest.mark.parametrize("piece", [1, 64, 1 << 20])
def test_lines_of_any_pieces(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(source, "PIECE", piece)
    test_lines_of_any_ranges(tmp_path, 50)


def test_corpus_in_batch_and_windows(spark, tmp_path):
    ids, path = corpus(tmp_path / "c"), str(tmp_path / "c")
    assert sorted(r.doc_id for r in source.documents(spark, path, chunkBytes=900).collect()) == ids
    assert [r.doc_id for r in source.documents(spark, f"file://{path}").collect()] == ids
    counts = source.index(spark, path, str(tmp_path / "i"), chunkBytes=900)
    assert counts.agg(F.sum("docs")).first()[0] == len(ids) and counts.count() > 10
    seen = []

    def run(limit=None):
        def window(docs, number):
            seen.append((number, sorted(r.doc_id for r in docs.collect())))

        stream = source.windows(spark, path, str(tmp_path / "i"), 50, str(tmp_path / "k"), limit)
        query = stream.writeStream.foreachBatch(window).option("checkpointLocation", str(tmp_path / "k")).start()
        query.processAllAvailable()
        query.stop()

    run(1)
    run(2)
    assert [n for n, _ in seen] == [0, 1, 2]
    run()
    run()
    assert seen == [(k, ids[50 * k : 50 * k + 50]) for k in range(4)]
    with pytest.raises(Exception, match="without id"):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "x.jsonl").write_text('{"text": "t"}\n')
        source.documents(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "none").mkdir()
    assert source.documents(spark, str(tmp_path / "none")).collect() == []


def test_state_goes_on_and_is_made_again(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:02d}", f"One {i}. Two! " * (i % 4)) for i in range(23)], "_id string, text string")
    docs.coalesce(1).write.json(str(tmp_path / "c"))
    out, state, path = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "c")
    assert G.read_state(spark, out)["next_unit"] == 0
    assert G.ingest_corpus(spark, path, out, state, 10, limit=2, index=True) == 2
    half = G.read_state(spark, out)
    shutil.rmtree(f"{state}/commits")  # as if the run had ended before it noted what it had done
    assert G.ingest_corpus(spark, path, out, state, 10, index=True) == 2  # the second again, and the third
    assert G.ingest_corpus(spark, path, out, state, 10, index=True) == 0
    assert G.read_state(spark, out, 2) == half
    units = spark.read.parquet(f"{out}/units")
    want = S.unit_ids(docs.withColumnRenamed("_id", "doc_id"))
    rows = lambda df: sorted((r.unit_id, r.doc_id, r.sentence_idx) for r in df.collect())
    assert rows(units) == rows(want)
    end = G.read_state(spark, out)
    assert (end["num_docs"], end["next_unit"], end["num_sentences"]) == (23, units.count(), units.count())
    assert end["clarity_sum"] / 23 == pytest.approx(G.totals(spark, out).first().boundary_clarity)
    assert spark.read.parquet(f"{out}/index").count() == end["num_chunks"]


@pytest.mark.parametrize("kind,ids", [("string", ["b", "a", None, "c", "a", None, "ü"] * 5), ("long", [2**62, -(2**62), None, 5, 5, 5, 0, 10**12] * 4), ("long", [7] * 60), ("double", [0.5, None, -1.5] * 4)])
def test_running_starts(spark, kind, ids):
    rows = spark.createDataFrame([(x, i % 4) for i, x in enumerate(ids)], f"id {kind}, n int").repartition(5)
    got = S.with_running_starts(rows, {"start": F.col("n"), "place": F.lit(1)}, "id").collect()
    assert sorted((str(r.id), r.n) for r in got) == sorted((str(x), i % 4) for i, x in enumerate(ids))
    got.sort(key=lambda r: r.place)
    assert [r.place for r in got] == list(range(len(ids)))
    keys = [(r.id is not None, r.id if r.id is not None else 0) for r in got] if kind != "string" else [(r.id is not None, r.id or "") for r in got]
    assert keys == sorted(keys)
    total = 0
    for r in got:
        assert r.start == total
        total += r.n
    assert S.with_running_starts(rows.limit(0), {"start": F.col("n")}, "id").collect() == []


def test_windows_of_text_ids_and_later_layouts(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "Some text.") for i in range(11)] + [(None, "x")], "doc_id string, text string")
    source_path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    G.lay_out(docs, source_path, 5)
    assert G.ingest(spark, source_path, out, state) == 3
    G.lay_out(docs.limit(4), source_path, 5)
    assert sorted(r.n for r in spark.read.parquet(source_path).groupBy("window").agg(F.count("*").alias("n")).collect()) == [2, 4, 5, 5]
    assert [G.ingest(spark, source_path, out, state, drain=False) for _ in range(2)] == [1, 0]
    assert G.totals(spark, out).first().n == 16 == G.read_state(spark, out)["num_docs"]


def test_spans_of_pieces_are_spans_of_the_whole(spark):
    rng = random.Random(3)
    parts = ["word", "two words", ". ", "! ", "?\n", "\n\n", "  ", "é漢", "x" * 70, "a b " * 30]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 5, 60]))) for _ in range(120)] + ["long " * 190_000 + ". End.", "One. " * 200_000]
    for t in texts[:-2]:
        whole = list(S.rule_spans(t))
        for at_once in (1, 3, 10, 64):
            assert list(S.spans(t, S.rule_spans, at_once, 10**6)) == whole, (t, at_once)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "Null. Id."), (7777, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.sentence_idx, r.char_start, r.char_end) for r in S.split_by(docs, lambda: S.rule_spans, at_once=1000).collect()))
    want = sorted(((r.doc_id is None, r.doc_id or 0, r.sentence_idx, r.char_start, r.char_end) for r in S.sentence_offsets(docs).collect()))
    assert got == want
    # a sentence that is longer than any piece may be is cut at blanks, and nothing of it is lost
    t = "word " * 300 + "end"
    cut = list(S.spans(t, S.rule_spans, 64, 128))
    assert len(cut) > 5 and "".join(t[a:b] for a, b in cut).replace(" ", "") == t.replace(" ", "") and all(b - a <= 128 for a, b in cut)


def test_kept_corpora(spark, tmp_path):
    from tessera.sources import cache, corpora

    reads = []
    table = lambda s, *r: spark.createDataFrame(list(r), s)
    docs, queries = table(corpora.DOCUMENT, ("d", "T", "text", "")), table("query_id string, query string", ("q", "?"))
    qrels = table("query_id string, doc_id string, relevance int", ("q", "d", 1))
    evidences = table("query_id string, doc_id string, evidence string", ("q", "d", "text"))

    def reader(spark, root, split):
        reads.append(root)
        return corpora.Corpus(docs, queries, qrels, evidences if root == "with" else None)

    corpora.register("counted", reader)
    kept = str(tmp_path / "kept")
    load = lambda root, *tasks: cache.load(spark, "counted", root, "test", kept, tasks)
    first = load("without")
    assert load("without").documents.count() == 1 and len(reads) == 1
    for _ in range(2):  # the source is read again once for this task, and says no
        with pytest.raises(ValueError, match="evidences"):
            load("without", "evidence_retrieval")
    assert len(reads) == 2 and first.documents.count() == 1  # readers of the first snapshot are not disturbed
    cache.publish(spark, corpora.Corpus(docs, queries, qrels), kept)  # a snapshot that nobody asked about evidence
    assert load("with", "evidence_retrieval").evidences.count() == 1 and len(reads) == 3
    assert load("with", "evidence_retrieval").evidences.count() == 1 and len(reads) == 3
    (tmp_path / "kept" / ".part-left-by-a-failed-run").mkdir()
    assert cache.snapshots(spark, kept) == [0, 1, 2, 3]
    cache.prune(spark, kept)
    assert cache.snapshots(spark, kept) == [3] and load("with", "evidence_retrieval").evidences.count() == 1


def test_running_starts_shuffle_rows_once(spark):
    """F8, F9: what is read back meets its range's start by broadcast; the one window is over the ranges' sums."""
    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, text string")
    plan = S.with_running_starts(rows, {"start": F.length("text")}, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "broadcast" in plan


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
def test_corpus_is_written_by_as_many_tasks_as_there_are_partitions(spark):
    """not by three, whatever its size."""
    from tessera.plans import source_queries as Q

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path, _ = Q._json_corpus(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(path).glob("part-*.json"))
    assert len(files) == 4
    ids = [json.loads(x)["_id"] for f in files for x in f.read_text().splitlines()]
    assert ids == sorted(ids)
