import random
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.ngramjoin import near_stage
from tessera.llm.packing import pack_stage


def test_pipeline_stages_take_effect(spark, tmp_path):
    rng = random.Random(0)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(50)) for _ in range(60))
    item = text()
    docs = [(i, text(), "en", f"s{i % 3}", 0) for i in range(90)]
    docs += [(90 + i, "$$$ !!! " * 30 + str(i), "en", "s0", 0) for i in range(30)]
    docs += [(200, docs[0][1] + " more", "en", "s1", 0), (201, item, "en", "s1", 0)]
    labels = [(i, int(i < 90), 0) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, left = now.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == names
        left.append({r.doc_id for r in now.collect()})
    assert left[0] & set(range(90, 120)) == set() and len(left[0] & set(range(90))) >= 88
    assert left[1] == left[0] - {200}
    assert left[2] == left[1] - {201}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {d for r in rows for d in r.doc_ids} == left[3] <= left[2]


def test_one_row_of_each_class_stays(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    docs = [(1, text("a")), (1, text("a")), (2, text("a") + " more"), (None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (7, text("d") + " more"), (8, ""), (9, None)]
    kept = near_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert {(r.doc_id, r.text) for r in kept} >= {(1, text("a")), (None, text("b")), (7, text("c")), (8, ""), (9, None)}
    assert len(kept) == 6 and sum((r.text or "").startswith("d0") for r in kept) == 1


CLASH = "score predicted _scan n_words items spans whole size target source_size copies level id n last _0 _1 doc component_id n_shingles place".split()


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls in every column, ids near 2 ** 62, repeated rows, empty and very long texts, and columns named like those of the stages."""
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    big = 2**62
    docs = [(big + 1, text("a"), "en", "s"), (big + 3, text("b"), None, None), (None, text("c"), "en", "s"), (None, text("c"), "en", "s"), (big + 5, None, "en", "t"), (big + 7, "", None, "t")]
    docs += [(big + 9, text("d", 30_000), "en", "s"), (big + 11, text("e"), "en", "s"), (big + 11, text("e"), "en", "s"), (None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    rows = spark.createDataFrame([(*d, *[f"own {c}" for c in CLASH]) for d in docs], names).repartition(3)
    spark.createDataFrame([(big + 1, 1), (big + 3, 1), (None, 1), (big + 5, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text("b", 20)), (None, text("a")), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, str(tmp_path), {d[0] for d in docs}


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_ids_and_columns_of_any_name(spark, odd, at):
    rows, sf, ids = odd
    out = corpus_pipeline.STAGES[at][1](spark, rows, sf)
    assert out.schema == rows.schema
    kept = out.collect()
    assert kept and {r.doc_id for r in kept} <= ids and all(r[c] == f"own {c}" for r in kept for c in CLASH)
    n = Counter((r.doc_id, r.text) for r in kept)
    big = 2**62
    if at == 0:  # labels of one class only: all alike
        assert len(kept) == 10
    if at == 1:
        assert n == Counter({k: 1 for k in {(r.doc_id, r.text) for r in rows.collect()}})
    if at == 2:
        assert len(kept) == 9 and not any(d == big + 3 for d, _ in n)
    if at == 3:  # a row stands there three times at most, and rows alike in id and text are told apart
        stood = Counter((r.doc_id, r.text) for r in rows.collect())
        assert all(n[k] <= 3 * stood[k] for k in n)
    assert corpus_pipeline.STAGES[at][1](spark, rows.limit(0), sf).collect() == []


def test_last_stage_packs_every_id(spark, odd):
    rows, sf, ids = odd
    got = pack_stage(spark, rows, sf).collect()
    assert {d for r in got for d in r.doc_ids} == ids - {2**62 + 5, 2**62 + 7}
    assert pack_stage(spark, rows.limit(0), sf).collect() == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
