"""Operators on pairs of documents and passages against brute force."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import crowds
from tessera.llm import ngramjoin as J
from tessera.llm import substrings as P
from tessera.llm.common import Scratch
from tessera.llm.graph import components

SCHEMA = "doc_id long, text string, component_id string"  # the last only clashes with a result's name


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def plain_classes(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = words(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    x, y = root(a), root(b)
                    top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(seed):
    """Stars, chains whose ends are far apart, texts around a common passage, odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    base = make(120)
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    chain = make(150)
    for i in range(20):
        chain = list(chain)
        chain[(7 * i) % 150] = f"new{i}"
        texts.append(" ".join(chain))
    passage = make(60)
    for _ in range(30):
        texts.append(" ".join(make(rng.randrange(5, 40)) + passage + make(rng.randrange(5, 40))))
    texts += ["", None, "  \t ", "one", "One", "a b c", "a b c ", "x " * 500, "x " * 480, "y " * 20000, texts[0], texts[30], "Ärger ÄRGER"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("k,percent,chunk", [(4, 85, 2000), (5, 80, 5)])
def test_near_classes(spark, monkeypatch, k, percent, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)
    texts = near_copies(k)
    rows = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_classes(rows, words=k, percent=percent).collect()}
    assert got == plain_classes(texts, k, percent)


def test_near_classes_of_repeated_null_and_no_rows(spark):
    rows = spark.createDataFrame([(3, "a b c d e f", ""), (3, "a b c d e f", ""), (1, "A b c d e f", ""), (None, "a b c d e f", ""), (None, None, "")], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in J.near_classes(rows, words=4, percent=85).collect()), key=str)
    assert got == [(1, 1), (3, 1), (3, 1), (None, 1), (None, None)]
    assert J.near_classes(rows.limit(0)).collect() == []


def test_bound_is_an_upper_bound():
    rng = np.random.default_rng(5)
    for n, m in ((10, 12), (200, 230), (900, 1000), (5000, 4400)):
        pool = rng.integers(0, 2**63, 6000, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, s, replace=False)) for s in (n, m))
        p, q = J.coordinates(J.point_of(a)), J.coordinates(J.point_of(b))
        d = min(len(p), len(q))
        assert np.minimum(J.folded(p, d), J.folded(q, d)).sum() >= len(np.intersect1d(a, b))


def test_tree_join_finds_what_all_pairs_find():
    rng = np.random.default_rng(2)
    points = rng.poisson(4, (300, 16))
    points[100:200] = points[:100] + (rng.random((100, 16)) < 0.05)
    sizes, labels = points.sum(1), rng.integers(0, 150, 300)
    box = J.Box(np.arange(300), points, sizes, labels)
    got = {(min(a, b), max(a, b)) for i, j in J.tree_join(box, box, points, sizes, labels, 85) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if labels[a] != labels[b] and np.minimum(points[a], points[b]).sum() >= J.needed(sizes[a] + sizes[b], 85)}
    assert got == want and want


def test_components(spark):
    links = [(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (1, 2)] + [(i, i + 1) for i in range(20, 60)]
    rows = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(rows, Scratch(spark, "test")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}
    assert components(rows.limit(0), Scratch(spark, "test")).collect() == []


def test_compact_windows_hold_the_minimum():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 2**32, n, dtype=np.uint32) for n in (400, 30, 39, 40, 41, 90, 0, 300)]
    seqs[7][100:200] = seqs[7][:100]  # equal hashes: the one further left is less
    for k, own, g, c, lo, hi in P.compact_windows(seqs, 40):
        for t, s in enumerate(seqs):
            h = P.mix(s.astype(np.uint64) ^ P._SEEDS[k])
            rows = [(int(g[i]), int(c[i]), int(lo[i]), int(hi[i])) for i in np.flatnonzero(own == t)]
            for i in range(len(s) - 39):  # each subsequence of the width belongs to exactly one window
                mine = [w for w in rows if w[2] <= i <= w[1] <= i + 39 <= w[3]]
                assert len(mine) == 1 and mine[0][:2] == (int(h[i : i + 40].min()), i + int(h[i : i + 40].argmin()))


def plain_passages(texts, width):
    """Places (document, shingle) in a run of ``width`` shingles that stands elsewhere too, not overlapping itself."""
    runs, out = defaultdict(list), set()
    for d, t in texts.items():
        w = words(t)
        for i in range(len(w) - width - 3):
            runs[tuple(w[i : i + width + 4])].append((d, i))
    for at in runs.values():
        for d, i in at:
            if any(e != d or abs(i - j) >= width for e, j in at):
                out |= {(d, p) for p in range(i, i + width + 4)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_every_exact_repeat_is_found_behind_common_lines(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    lines = [make(n) for n in (8, 20, 30, 40, 45)]
    texts = []
    for _ in range(40):  # pairs that share what lies around a line that stands in many
        line = rng.choice(lines)
        a, b = make(rng.randrange(2, 60 - len(line))), []
        b = make(max(0, rng.randrange(52, 75) - len(a) - len(line)))
        texts += [" ".join(make(rng.randrange(5, 60)) + a + line + b + make(rng.randrange(5, 60))) for _ in range(2)]
    for _ in range(40):  # lines alone
        texts.append(" ".join(make(rng.randrange(5, 60)) + rng.choice(lines) + make(rng.randrange(20, 60)) + rng.choice(lines)))
    twice = make(60)
    texts.append(" ".join(make(9) + twice + lines[2] + make(70) + twice + lines[3]))
    rng.shuffle(texts)
    found = defaultdict(set)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in P.repeated_passages(rows).collect():
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = plain_passages(dict(enumerate(texts)), 46)
    assert len(want) > 3000 and all(p in found[d] for d, p in want)
    extra = sum(len(s) for s in found.values()) - len(want)
    assert extra < 0.05 * len(want), "nothing else but near repeats at the ends"


@pytest.mark.parametrize("outer,inner", [(10, 44), (25, 35)])
def test_repeats_between_texts_that_others_link(spark, outer, inner):
    """X = p q r, A = p q, B = b q r, C = b q: links of X with A and of B with C cover what X and B share."""
    rng = random.Random(outer)
    make = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts, want = [], []
    for _ in range(150):
        p, q, r, b = make(outer), make(inner), make(outer), make(outer)
        for own in (p + q + r, p + q, b + q + r, b + q):
            texts.append(" ".join(make(30) + own + make(30)))
        n = len(texts)
        want += [(n - 4, 30, 30 + inner + 2 * outer), (n - 2, 30, 30 + inner + 2 * outer)]
    rows = P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start_word, r.end_word, r.passage_id))
    for x in range(0, len(texts), 4):  # X and B share outer + inner words
        ids = [{i for s, e, i in spans[d] if s <= 30 + outer and e >= 30 + inner + 2 * outer} for d in (x, x + 2)]
        assert ids[0] & ids[1], x


def test_repeats_longer_than_what_the_first_text_shares(spark):
    """Two texts share 70 words, a third the middle 50 of them: all 70 come back, whichever is first of its group."""
    rng = random.Random(8)
    make = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(150):
        w = make(70)
        texts += [" ".join(make(30) + own + make(30)) for own in (w, w, w[10:60])]
    found = defaultdict(set)
    for r in P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
    for d in range(len(texts)):
        assert set(range(30, 80 if d % 3 == 2 else 100)) <= found[d], d


def test_near_repeats_are_found(spark):
    """Passages of 60 to 120 words with one or two words changed, behind common lines or not: nine of ten at least."""
    rng = random.Random(5)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line, texts, want = make(12), [], []
    for i in range(150):
        own = make(rng.randrange(40, 60)) + (line if i % 2 else make(12)) + make(rng.randrange(10, 50))
        for j in range(2):
            w, s = list(own), rng.randrange(5, 60)
            if j:
                for _ in range(1 if len(own) < 100 else 2):
                    w[rng.randrange(8, len(w) - 8)] = f"odd{rng.randrange(10**6)}"
            x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (own, w))
            assert len(x & y) >= 0.8 * len(x | y)
            want.append((len(texts), s, s + len(w)))
            texts.append(" ".join(make(s) + w + make(rng.randrange(5, 60))))
    got = defaultdict(list)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in P.repeated_passages(rows).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    share = np.mean([any(a <= s + 4 and b >= e - 4 for a, b in got[d]) for d, s, e in want])
    assert share >= 0.9, share


@pytest.mark.parametrize("size,fragment,step", [(60, 44, 4), (100, 45, 5)])
def test_near_repeats_among_texts_that_share_parts_of_them(spark, size, fragment, step):
    """Two near copies of a passage and, three times each, texts that hold too little of it, which come first in most groups."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [], []
    for _ in range(40):
        p = make(size)
        q = list(p)
        for at in [size // 2] if size < 100 else [size // 3, 2 * size // 3]:
            q[at] = make(1)[0]
        want.append((len(texts), len(texts) + 1))
        texts += [" ".join(make(30) + own + make(30)) for own in (p, q)]
        for a in [a for a in range(0, size - fragment + 1, step) for _ in range(3)]:
            texts.append(" ".join(make(30) + rng.choice((p, q))[a : a + fragment] + make(30)))
    ids = defaultdict(set)
    for r in P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        if r.start_word <= 38 and r.end_word >= 22 + size:
            ids[r.doc_id].add(r.passage_id)
    found = sum(bool(ids[x] & ids[y]) for x, y in want)
    assert found >= 0.95 * len(want), found


def test_near_repeats_in_large_groups(spark):
    """As above, with 96 texts around each pair: more than are compared pair by pair by their halves alone (36 of 40 found)."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [], []
    for _ in range(40):
        p = make(100)
        q = list(p)
        for at in (33, 66):
            q[at] = make(1)[0]
        want.append((len(texts), len(texts) + 1))
        texts += [" ".join(make(30) + own + make(30)) for own in (p, q)]
        for a in [a for a in range(0, 57, 5) for _ in range(8)]:
            texts.append(" ".join(make(30) + rng.choice((p, q))[a : a + 44] + make(30)))
    ids = defaultdict(set)
    for r in P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        if r.start_word <= 38 and r.end_word >= 122:
            ids[r.doc_id].add(r.passage_id)
    found = sum(bool(ids[x] & ids[y]) for x, y in want)
    assert found == len(want), found


@pytest.mark.parametrize("seed", range(6))
def test_crowds_join_what_all_pairs_join(seed, monkeypatch):
    """The same passages and the same covered places as by all pairs, for families of near copies around a common line."""
    if seed % 2:
        monkeypatch.setattr(crowds, "FOLLOWED", 500)
        monkeypatch.setattr(crowds, "COUNTED", 64)
    rng = np.random.default_rng(seed)
    n, width = 150, 46
    new = lambda *size: rng.integers(1, 2**32, size, dtype=np.uint64).astype(np.uint32)
    ctx = new(n, 2 * width - 1)
    for _ in range(8):
        family = rng.choice(n, rng.integers(2, 40), replace=False)
        a, b = np.sort(rng.integers(0, 91, 2))
        ctx[family, a:b] = new(b - a)
    line = new(30 + seed)
    ctx[:, 20 : 50 + seed] = line
    for i in range(n):
        at = rng.integers(0, 86)
        ctx[i, at : at + rng.integers(0, 6)] = new(1)[0]
    ctx[:, 45] = 7
    ctx[3, :9] = ctx[5, 80:] = 0

    def joined(pairs):
        name, cover = np.arange(n), {}
        rows = lambda side: [ctx[p[side]][ctx[p[side]] != 0] for p in pairs]
        begin = (ctx != 0).argmax(1)
        shift = [int(begin[b] - begin[a]) for a, b in pairs]
        for k, found in P._alike(rows(0), rows(1), shift, shift, width, 0.8):
            for i, lo, hi in ((pairs[k][0], 0, 1), (pairs[k][1], 2, 3)):
                for f in found:
                    old = cover.get(i, (99, 0))
                    cover[i] = (min(old[0], f[lo] + begin[i]), max(old[1], f[hi] + begin[i]))
            name[name == name[pairs[k][1]]] = name[pairs[k][0]]
        return {tuple(np.flatnonzero(name == x)) for x in set(name.tolist())}, cover

    made = crowds.Crowd(ctx, np.ones(n, bool), np.zeros((n, 2), np.int64), np.arange(n), None, width, 0.8).linked(P._alike)
    everything = [(i, j) for i in range(n) for j in range(i + 1, n)]
    assert joined(made) == joined(everything)
    assert 3 < len(made) < len(everything) / 4


def test_passages_of_null_repeated_and_large_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (2**62 + 1, text), (2**62 + 3, text + " end"), (5, None), (None, None), (5, ""), (6, "short")]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.start_word) for r in got) == sorted([("None", 0)] * 2 + [(str(2**62 + 1), 0), (str(2**62 + 3), 0)])
    assert len({r.passage_id for r in got}) == 1


def test_repeated_passages(spark):
    rng = random.Random(4)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared, near, line = make(80), make(100), make(12)
    texts, spans = [], defaultdict(list)

    def add(*parts):
        texts.append(" ".join(w for p in parts for w in p))

    for i in range(12):
        a = make(rng.randrange(3, 200))
        add(line, a, shared, make(rng.randrange(3, 200)))
        spans[i].append((12 + len(a), 92 + len(a)))
    for i in range(12, 16):  # one word of a hundred differs
        own = list(near)
        own[20 * (i - 12) + 10] = f"odd{i}"
        add(make(30), own, make(30))
        spans[i].append((30, 130))
    for _ in range(10):  # a short line only
        add(line, make(150))
    twice = make(70)
    add(twice, make(100), twice)
    add(make(49) * 1)
    texts += [" ".join(make(60))] * 2 + ["short one", "short one", "", None, "x " * 30000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = defaultdict(list)
    for r in P.repeated_passages(rows).collect():
        got[r.doc_id].append((r.start_word, r.end_word, r.passage_id))
    for d, want in spans.items():
        for a, b in want:
            assert any(s <= a + 1 and e >= b - 1 and e - s <= b - a + 30 for s, e, _ in got[d]), (d, want, got[d])
    assert len({p for d in range(12) for *_, p in got[d]}) == 1
    assert not any(got[d] for d in range(16, 26)), "a short line is no passage"
    assert len(got[26]) == 2 and len({p for *_, p in got[26]}) == 1
    assert not got[27]
    assert got[28] == got[29] == [(0, 60, got[28][0][2])]
    assert not any(got[d] for d in (30, 31, 32, 33))
    assert P.repeated_passages(rows.limit(0)).collect() == []


@pytest.mark.parametrize("many,apart", [(70, False), (200, True), (2000, False)])
def test_frequent_passage_is_one_passage_of_all_its_documents(spark, many, apart):
    rng = random.Random(many)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared = make(60)
    ids = rng.sample(range(10**9), many) if apart else range(many)
    rows = spark.createDataFrame([(i, " ".join(make(5) + shared + make(5))) for i in ids], "doc_id long, text string").coalesce(1)
    got = [r for r in P.repeated_passages(rows).collect() if r.start_word <= 6 and r.end_word >= 64]
    assert {r.doc_id for r in got} == set(ids)
    assert len({r.passage_id for r in got}) == 1


def test_exact_passage_behind_texts_that_share_only_its_minima(spark):
    rng = random.Random(7)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    shared = make(60)
    seq = lambda t: (P.shingles(P.word_hashes([t])[0], P.SHINGLE) >> np.uint64(32))
    texts, s = [], seq(" ".join(shared))
    for k in range(P.HASHES):
        c = int(P.mix(s ^ P._SEEDS[k]).argmin())
        least, made = int(P.mix(s ^ P._SEEDS[k])[c]), 0
        while made < 130:  # 130 of them for each function, all before the two that share the passage
            text = " ".join(make(30) + shared[c : c + P.SHINGLE] + make(30))
            own = seq(text)
            if int(P.mix(own ^ P._SEEDS[k]).min()) == least:
                texts.append(text)
                made += 1
    n = len(texts)
    texts += [" ".join(make(9) + shared + make(4)), " ".join(make(3) + shared + make(8))]
    got = {r.doc_id: r for r in P.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert {d: (r.start_word, r.end_word) for d, r in got.items()} == {n: (9, 69), n + 1: (3, 63)}
    assert got[n].passage_id == got[n + 1].passage_id


def test_run_hashes_tell_runs():
    s = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    s[200:260] = s[20:80]
    h = P._runs(s, 46)
    assert len(h) == 255 and [(i, j) for i in range(255) for j in range(i) if h[i] == h[j]] == [(200 + i, 20 + i) for i in range(15)]


@pytest.mark.parametrize("added", range(3, 9))
def test_words_put_into_a_passage_do_not_part_it(added):
    rng = np.random.default_rng(added)
    base = rng.integers(0, 2**24, 92)
    other = np.concatenate([base[:44], rng.integers(0, 2**24, added + 4), base[48:]])  # words put in at half break four shingles
    a, b = np.concatenate([rng.integers(0, 2**24, 40), base]), np.concatenate([rng.integers(0, 2**24, 9), other])
    for d in (31, 31 - added):  # agreement in the first half only, or in the second
        assert P.alike(a, b, d, d, 46, 0.8) == [(40, 132, 9, 9 + len(other))]


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 2}x{j}" for j in range(60))) for i in range(6)], "doc long, text string")
    work = P._Passages(docs, 50)
    assert work.run().count() == 6
    asked = spark.range(9).select(F.col("id").alias("node")).distinct()
    plan = work.nodes.select("node", "seq").join(asked.hint("merge"), "node", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of those asked for, not of the texts


def test_stretches_of_texts_with_repeated_shingles():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**32, 80, dtype=np.uint32)
    base[20:30] = base[:10]  # a set smaller than the stretch
    a, b = np.concatenate([rng.integers(0, 2**32, 7, dtype=np.uint32), base]), np.concatenate([base, rng.integers(0, 2**32, 9, dtype=np.uint32)])
    assert P.alike(a, b, 7, 7, 46, 0.8) == [(7, 87, 0, 80)]
    other = b.copy()
    other[30:40] += np.uint32(1)
    assert P.alike(a, other, 7, 7, 46, 0.8) == []


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def left():
        found = disk.getAllFiles().mkString(",").split(",")
        return {f for f in found if "/shuffle_" in f}

    before = left()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    written = Scratch(spark, "dropped").table(rows, "plain")
    for _ in range(50):  # files go in the background
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert written.count() == 7



def test_many_pairs_are_compared_as_each_alone():
    rng = np.random.default_rng(5)
    pairs = []
    for i in range(60):
        a = rng.integers(0, 40 if i % 3 else 1 << 31, int(rng.integers(0, 300))).astype(np.uint32)
        b = a.copy() if i % 2 else rng.permutation(a)
        b[: len(b) // 5] = 7
        pairs.append((a, np.append(b, a[: i % 90])))
    a, b = map(list, zip(*pairs, strict=True))
    found = dict(P._alike(a, b, [-9] * 60, [9] * 60, 46, 0.8))
    assert len(found) > 20
    assert [found.get(i, []) for i in range(60)] == [P.alike(*pairs[i], -9, 9, 46, 0.8) for i in range(60)]
