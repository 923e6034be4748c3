import itertools
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunk as C
from tessera.operators import intrinsic as I
from tessera.operators import split as S

TEXTS = ["One. Two!  Three?\nFour", "", None, "   \n ", "no end", "a.b c. d", "Ünïcode wörds. éa the end"]


def plain_sentences(t):
    return [x.strip() for x in re.split(r"(?<=[.!?])\s+|[\r\n]+", t or "") if x.strip()]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences_and_numbers(spark):
    rows = docs(spark, TEXTS)
    found = {}
    for r in S.split_sentences(rows).orderBy("doc_id", "sentence_idx").collect():
        found.setdefault(r.doc_id, []).append(r.sentence)
    assert found == {i: plain_sentences(t) for i, t in enumerate(TEXTS) if plain_sentences(t)}
    units = S.unit_ids(rows).orderBy("unit_id").collect()
    assert [u.unit_id for u in units] == list(range(len(units)))
    assert [u.doc_id for u in units] == sorted(u.doc_id for u in units)


def test_offsets_point_at_the_sentence(spark):
    rows = S.sentence_offsets(docs(spark, TEXTS)).collect()
    for r in rows:
        assert TEXTS[r.doc_id][r.char_start : r.char_end].strip() == plain_sentences(TEXTS[r.doc_id])[r.sentence_idx]
    assert len(rows) == sum(len(plain_sentences(t)) for t in TEXTS)


def test_qa_tokens_know_unicode_word_ends(spark):
    got = docs(spark, ["éa the END, a-b", None]).select(T.qa_tokens(F.col("text")).alias("t")).collect()
    assert got[0].t == ["a", "end", "b"] and got[1].t == []


def test_span_and_title(spark):
    r = docs(spark, [" ab \n cd "]).select(T.span_text(F.lit("abcdef"), F.lit(1), F.lit(3)).alias("a"), T.span_text(F.lit("abc"), F.lit(2), F.lit(9)).alias("b"), T.safe_title(F.col("text")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("bc", None, "ab cd")


@pytest.mark.parametrize("k,o", [(3, 0), (5, 1), (8, 0), (10, 9)])
def test_fixed_chunks_by_a_plain_loop(spark, k, o):
    texts = [". ".join(f"s{i}" for i in range(n)) for n in (1, 2, 5, 7, 23)] + [""]
    rows = C.explode_chunks(S.with_sentences(docs(spark, texts)), C.fixed_chunks(F.col("sentences"), k, o)).collect()
    want = []
    for d, t in enumerate(texts):
        s, at = plain_sentences(t), 0
        for p, part in enumerate(np.array_split(np.arange(len(s)), min(k, len(s))) if s else []):
            lo, hi = max(at - o, 0), min(at + len(part) + o, len(s))
            want.append((d, p, lo, hi - 1, " ".join(s[lo:hi])))
            at += len(part)
    assert sorted((r.doc_id, r.position, r.start_sentence_idx, r.end_sentence_idx, r.text) for r in rows) == want


def test_vectors_against_numpy(spark):
    values = [[0.3, 0.1, 0.9, 0.4, 0.4], [1.0], [2.0, 5.0]]
    rows = spark.createDataFrame([(v,) for v in values], "v array<double>")
    got = rows.select(V.quantile(F.col("v"), 0.3).alias("q"), V.deviation(F.col("v")).alias("d"), V.gradient(F.col("v")).alias("g")).collect()
    for v, r in zip(values, got, strict=True):
        assert r.q == pytest.approx(np.percentile(v, 30)) and r.d == pytest.approx(np.std(v))
        assert r.g == pytest.approx(np.gradient(v).tolist() if len(v) > 1 else [0.0])
    assert spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c == 0


def breaks_of(spark, vectors, rule):
    rows = spark.createDataFrame([(0, vectors)], "doc_id long, vectors array<array<double>>")
    return C.with_breaks(rows, rule).first().breaks


def test_breakpoints(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]
    assert breaks_of(spark, v, C.Breakpoints("distance", 0.5)) == [1]
    assert breaks_of(spark, v, C.Breakpoints("distance", 1.0)) == []  # equal to the threshold is no break
    assert breaks_of(spark, v[:2], C.Breakpoints("gradient", 50)) == []
    assert breaks_of(spark, v[:1], C.Breakpoints("percentile", 50)) == []
    with pytest.raises(ValueError):
        C.Breakpoints("other")


def test_small_segments_take_in_the_next(spark):
    rows = spark.createDataFrame([(0, ["aa", "b", "cccccc", "d", "e"], [0, 1, 2, 3])], "doc_id long, sentences array<string>, breaks array<int>")
    got = C.explode_chunks(rows, C.breakpoint_chunks(F.col("sentences"), F.col("breaks"), 4)).orderBy("position").collect()
    assert [r.text for r in got] == ["aa b", "cccccc", "d e"]
    got = C.explode_chunks(rows, C.breakpoint_chunks(F.col("sentences"), F.col("breaks"), 100)).collect()
    assert [r.text for r in got] == ["aa b cccccc d e"]


def linked(parts, d, cap, stop):
    """The partition that the definition leads to from ``parts``: the least admissible pair becomes one part, as long as there is one."""
    pairs = [(d[np.ix_(a, b)].min(), a, b) for a, b in itertools.combinations(sorted(parts), 2) if len(a + b) <= cap]
    near = min(pairs, default=None)
    if near is None or near[0] > stop:
        return sorted(parts)
    return linked([p for p in parts if p not in near[1:]] + [sorted(near[1] + near[2])], d, cap, stop)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 6), st.integers(0, 10**6))
def test_single_linkage_is_the_definition(n, k, seed):
    x = np.random.default_rng(seed).integers(0, 6, (n, n)) / 5
    d = np.minimum(x, x.T)
    assert [g for g, _ in C.single_linkage(lambda a, b: d[a:b], n, k, 0.6)] == linked([[i] for i in range(n)], d, max(1, -(-n // k)), 0.6)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 12), st.integers(1, 6), st.integers(0, 10**6), st.integers(1, 9), st.sampled_from([2, 6, 100]))
def test_single_linkage_of_few_kept_pairs_is_the_definition(n, k, seed, kept, levels):
    """Many passes, and levels of equal distances with more pairs than are kept."""
    x = np.random.default_rng(seed).integers(0, levels, (n, n)) / levels
    d = np.minimum(x, x.T)
    was = C.NEAREST, C.BLOCK, C.TOGETHER
    try:
        C.NEAREST, C.BLOCK, C.TOGETHER = kept, 2 * n, 1 + kept // 2
        got = [g for g, _ in C.single_linkage(lambda a, b: d[a:b], n, k, 0.6)]
    finally:
        C.NEAREST, C.BLOCK, C.TOGETHER = was
    assert got == linked([[i] for i in range(n)], d, max(1, -(-n // k)), 0.6)


def test_single_linkage_without_a_cap_joins_what_is_reachable():
    at = np.sort(np.random.default_rng(3).uniform(0, 30, 40))
    d = np.abs(at[:, None] - at[None, :])
    cuts = np.flatnonzero(np.diff(at) > 0.9) + 1
    assert [g for g, _ in C.single_linkage(lambda a, b: d[a:b], 40, 1, 0.9)] == [p.tolist() for p in np.split(np.arange(40), cuts)]


def test_density_clusters():
    at = np.array([0.0, 0.1, 0.2, 5.0, 9.0, 9.1])
    row = lambda i: np.abs(at - at[i])
    assert C.density_clusters(row, 6, 0.15, 2) == [[0, 1, 2], [3], [4, 5]]
    assert C.density_clusters(row, 6, 0.01, 2) == [[i] for i in range(6)]
    v = np.random.default_rng(1).normal(size=(20, 4))
    d = C.joint_rows(v, 0.3)(0, 20)
    assert (d == d.T).all() and all((C.joint_rows(v, 0.3)(i, i + 1)[0] == d[i]).all() for i in range(20))
    assert C.density_clusters(lambda i: d[i], 20, 2.0, 2) == [list(range(20))]


def test_clustering_options_are_checked():
    for bad in ({"weight": 2}, {"number_of_chunks": True}, {"least": 0}, {"radius": 0}, {"stop": -1}):
        with pytest.raises(ValueError):
            C.check_clustering(**bad)


def test_cluster_chunks_of_one_sentence(spark):
    rows = spark.createDataFrame([(0, [[1.0]]), (1, [])], "doc_id long, vectors array<array<double>>")
    got = C.cluster_chunks(rows, method="dbscan").collect()
    assert [(r.doc_id, r.sentence_indices, r.cluster_origin) for r in got] == [(0, [0], "singleton")]


def test_clustered_texts_of_null_and_repeated_ids(spark):
    one = (["a", "b", "c"], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    rows = spark.createDataFrame([(None, *one), ("x", *one), ("x", *one), ("none", [], []), ("null", None, None), ("single", ["s"], [[0.0, 0.0]])], "doc_id string, sentences array<string>, vectors array<array<double>>").repartition(2)
    for method in ("single_linkage", "dbscan"):
        got = C.cluster_texts(rows, method=method, number_of_chunks=1, stop=0.2, radius=0.2).collect()
        assert sorted((str(r.doc_id), r.position, r.text, r.sentence_indices) for r in got) == sorted([(str(i), p, t, m) for i in (None, "x", "x") for p, t, m in ((0, "a b", [0, 1]), (1, "c", [2]))] + [("single", 0, "s", [0])])
    assert C.cluster_texts(rows.limit(0), method="dbscan").collect() == []


def test_intrinsic_closed_forms(spark):
    sets = [["a", "b"], ["b", "c"], ["d"]]
    rows = spark.createDataFrame([(sets,), ([],), ([["a"]],)], "s array<array<string>>")
    got = rows.select(I.boundary_clarity(F.col("s")).alias("b"), I.stickiness(F.col("s"), 0.0).alias("full"), I.stickiness(F.col("s"), 0.8).alias("none")).collect()
    assert got[0].b == pytest.approx((0.75 + 1) / 2)
    assert got[0].full == pytest.approx(np.log2(3)) and got[0].none == 0
    assert (got[1].b, got[1].full) == (1, 0) and (got[2].b, got[2].full) == (1, 0)


def test_perplexity(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "b"],), ([],), (["x"],)], "w array<string>")
    assert [r.p for r in rows.select(T.perplexity(F.col("w")).alias("p")).collect()] == pytest.approx([2.0, 1.0, 1.0])


def test_quantile_and_deviation_round_as_the_sql_does(spark):
    """F1, F2: scores often equal their threshold, where the last bit decides."""
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(5)
    rows = [(g, [float(1 - r.integers(1, 30) / np.sqrt(r.integers(20, 900))) for _ in range(n)]) for g, n in enumerate(r.choice([1, 2, 3, 4, 5, 8, 11, 21, 31, 50], 400))]
    rows += [(g, [0.1] * (g - 399)) for g in range(400, 430)]
    got = spark.createDataFrame(rows, "g long, d array<double>").select("g", V.quantile(F.col("d"), 0.7).alias("q"), (V.mean(F.col("d")) + V.deviation(F.col("d"))).alias("s"))
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE x (g BIGINT, d DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?)", [(g, v) for g, d in rows for v in d])
    want = con.execute("SELECT g, quantile_cont(d, 0.7), avg(d) + stddev_pop(d) FROM x GROUP BY g ORDER BY g").fetchall()
    assert [tuple(x) for x in got.orderBy("g").collect()] == want


def test_fused_product_and_sum(spark):
    r = np.random.default_rng(6)
    a, b = r.uniform(-3, 3, 3000) * 10.0 ** r.integers(-8, 8, 3000), r.uniform(-3, 3, 3000)
    c = -a * b * (1 + r.choice([0, 1e-16, 1e-9, 0.5, 2], 3000))
    rows = spark.createDataFrame([tuple(map(float, x)) for x in zip(a, b, c, strict=True)], "a double, b double, c double")
    for x in rows.withColumn("f", V.fused(F.col("a"), F.col("b"), F.col("c"))).collect():
        assert Fraction(x.f) == Fraction(float(Fraction(x.a) * Fraction(x.b) + Fraction(x.c)))


@pytest.mark.parametrize("block", [1 << 20, 90])
def test_density_clusters_by_blocks(block, monkeypatch):
    """distances are asked for in blocks, not point by point, and clusters are those of a plain search."""
    monkeypatch.setattr(C, "BLOCK", block)
    r, asked = np.random.default_rng(8), []
    for n in (1, 2, 17, 40):
        for least in (1, 2, 3, 4):
            x = r.integers(0, 60, n)
            d = np.abs(x[:, None] - x[None, :]).astype(float)
            near = d <= 2
            core, label = near.sum(1) >= least, list(range(n))
            todo = [i for i in range(n) if core[i]]
            label = [i if core[i] else n for i in range(n)]
            while True:
                new = [min([label[j] for j in todo if near[i, j]], default=n) if core[i] else n for i in range(n)]
                if new == label:
                    break
                label = new
            label = [label[i] if core[i] else min([label[j] for j in todo if near[i, j]], default=n) for i in range(n)]
            want: dict = {}
            for i, c in enumerate(label):
                want.setdefault(i if c == n else ("c", c), []).append(i)
            assert C.density_clusters(lambda i: d[i], n, 2.0, least) == sorted(want.values())
    C.density_clusters(lambda i: d[i], 40, 2.0, 2, lambda a, b: asked.append((a, b)) or d[a:b])
    assert len(asked) <= 20


def test_pairs_of_distinct_distances_are_merged_without_a_search_each(monkeypatch):
    """only pairs of equal distance are looked through together."""
    monkeypatch.setattr(C._Parts, "merge_ties", lambda *_: pytest.fail("no two pairs are tied"))
    d = np.abs(np.subtract.outer(2.0 ** np.arange(12), 2.0 ** np.arange(12)))
    assert [g for g, _ in C.single_linkage(lambda a, b: d[a:b], 12, 1, 5000.0)] == [list(range(12))]
