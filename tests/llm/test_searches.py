"""Ranked search, hard negatives and fertility rules against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fertility, negatives, ranked

# --- 11


def plain_terms(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_ranking(docs, items, k):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, b, n in bags:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(weight[w] * ((10**9 * b[w]) // (1000 * b[w] + 20 * m)) for w in set(plain_terms(text)) if w in b)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def ranked_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(seed, n=900):
    """Zipf words: some in nearly all texts, most in a few; copies, odd texts, odd ids."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Élan", "漢字", "x1y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 120]))) for _ in range(n)]
    docs = list(enumerate(texts)) + [(10_000 + i, texts[i]) for i in range(60)] + [(5000, None), (5001, ""), (5002, "-!? \x01"), (None, texts[0]), (-3, texts[1]), (7, texts[7]), (2**62 + 1, texts[2]), (5003, "w5 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.choice([2, 8, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (None, "w3 W3 w399"), (93, "élan ÉLAN 漢字"), (93, "w250")]
    return docs, items


@pytest.mark.parametrize("sizes", [None, (3, 64, 400, 4, 8)])
def test_ranked_search(spark, monkeypatch, sizes):
    if sizes:
        for name, x in zip(("ITEMS", "DOCS", "POSTINGS", "SHORT", "TOGETHER"), sizes, strict=True):
            monkeypatch.setattr(ranked, name, x)
    docs, items = corpus(3)
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, item string").repartition(5)
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    assert ranked_rows(ranked.search(d, q, k=10)) == plain_ranking(docs, items, 10)
    assert ranked.search(d.limit(0), q).collect() == [] and ranked.search(d, q.limit(0)).collect() == []


def test_hybrid_equals_exhaustive_sums_and_skips():
    rng = np.random.default_rng(4)
    n, fewest = 5000, 10**9
    for trial in range(60):
        lists, total = [], np.zeros(n, np.int64)
        for size in rng.choice([1, 5, 40, 150, 700, 3000, 5000], size=rng.integers(1, 12)):
            doc = np.sort(rng.choice(n, int(size), replace=False))
            part = rng.integers(0, rng.choice([3, 1000]), len(doc))
            total[doc] += part
            lists.append((doc, part, int(part.max())))
        top = ranked.Top(10)
        scored = ranked.hybrid(lists, n, top, np.arange(n), np.zeros(n, bool), short=int(rng.choice([4, 24, 10**6])), together=int(rng.choice([4, 64, 512])))
        want = sorted(((-s, i) for i, s in enumerate(total.tolist()) if s > 0))[:10]
        assert list(zip((-top.score).tolist(), top.id.tolist(), strict=True)) == want
        fewest = min(fewest, scored / max(1, int((total > 0).sum())))
    assert fewest < 0.5  # documents are skipped


# --- 13


def plain_negatives(rows, size):
    q = [(i, label, [negatives.floored(x) for x in v] + [0] * (size - len(v))) for i, label, v in rows]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, label, v in q:
        if i is None or i % 5:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in q]
        for p, pid, _ in sorted((x for x in scores if x[2] == label and x[1] != i), key=key)[:5]:
            fits = sorted((x for x in scores if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p), key=key)[:3]
            out += [(i, pid, r + 1, n, p, s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scale,sizes", [(1.0, None), (1.0, (16, 4, 7)), (3e4, (64, 8, 8192)), (2.5e6, None), (0.0, None)])
def test_hard_negatives(spark, monkeypatch, scale, sizes):
    if sizes:
        for name, x in zip(("FIELDS", "AT_ONCE", "BLOCK"), sizes, strict=True):
            monkeypatch.setattr(negatives, name, x)
    rng = random.Random(13)
    unit = lambda n=12: [rng.gauss(0.2, 0.3) * scale for _ in range(n)]
    good = [(i, rng.randrange(3), unit()) for i in range(150)]
    good += [(200 + i, i % 3, good[10][2]) for i in range(12)]  # ties
    good += [(300, 1, unit(5)), (305, 1, []), (310, 2, unit(12)), (310, 2, good[20][2]), (None, 0, good[30][2]), (-5, 0, unit()), (2**62, 0, unit())]
    bad = [(400, None, unit()), (405, 1, None), (410, 1, [None, 1.0]), (415, 1, [float("nan")]), (420, 1, [float("inf")] * 12)]
    rows = spark.createDataFrame([(*r, "clash") for r in good + bad], "vec_id long, label int, embedding array<double>, slot string").repartition(4)
    got = negatives.hard_negatives(rows, F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got), key=repr) == plain_negatives(good, 12)
    assert negatives.hard_negatives(rows.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.hard_negatives(rows, F.col("vec_id") < -100).collect() == []


def test_packed_scores_of_any_size():
    rng = random.Random(5)
    for largest in (1, 300, 10**5, 10**9, 10**12, 10**40):
        rows = [[rng.randrange(-largest, largest + 1) for _ in range(9)] for _ in range(33)]
        anchor = [rng.randrange(-largest, largest + 1) for _ in range(9)]
        want = [min(max(sum(a * b for a, b in zip(anchor, r, strict=True)), negatives.LEAST), negatives.MOST) for r in rows]
        packed = negatives.Packed(np.array(rows) if largest < 10**12 else rows, max(map(abs, anchor)))
        assert packed.scores(anchor).tolist() == want


# --- 12


def plain_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    hit = {i + k for x in windows.values() if len(x) > 1 for i in x for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def fertility_texts():
    rng = random.Random(12)
    pieces = ["tion", "er", "the", "ing", "re", "on", "an", "ou", "ble", "st"]
    english = ["".join(rng.choices(pieces, k=rng.randrange(1, 5))) for _ in range(3000)]
    # distinct in spelling from the first group, so that language bands differ
    umlauts = ["".join(rng.choices(["ü", "ß", "ö", "sch", "ä", "heit", "ung"], k=rng.randrange(1, 4))) for _ in range(3000)]
    rows = [(f"en{i}", prose(rng, english, rng.choice([60, 200, 700])), "en") for i in range(120)]
    rows += [(f"de{i}", prose(rng, umlauts, rng.choice([60, 200, 700])), "de") for i in range(60)]
    rows += [(f"junk{i}", " ".join(w + "&&$%" for w in rng.choices(english, k=200)), "en") for i in range(8)]
    rows += [(f"loop{i}", "und oder aber " * 100, "en") for i in range(2)]
    rows += [(f"few{i}", " ".join(rng.choices(english[:12], k=400)), "en") for i in range(3)]
    rows += [("rare", "".join(chr(0x13000 + rng.randrange(900)) + rng.choice(["", " "]) for _ in range(400)), "en")]
    rows += [("none", None, "en"), ("empty", "", None), ("blank", " \t\n ", ""), ("short", "a b c", "en"), ("same line", "a b\na b\n\n a b\n \n \na b", "de"), ("long", prose(rng, english, 30_000), "en")]
    rows += [("cyrillic", prose(rng, ["слово", "дело", "и", "вода", "который"], 300), None), ("nolang", prose(rng, english, 300), None)]
    return rows


def test_fertility(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    rows = fertility_texts()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "name string, text string, lang string, _group string").repartition(4)
    paths = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")
    got = {r.name: r for r in fertility.fertility_rules(docs, *paths).collect()}
    assert len(got) == len(rows) and {r["_group"] for r in got.values()} == {"clash"}
    model = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    single = {i for i in range(model.get_piece_size()) if model.is_byte(i)}
    rank = fertility.vocabulary(paths[1])
    for name, text, _ in rows:
        r, w = got[name], re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(text), name
        ids = Counter(x for v in w for x in model.encode(v))
        n = ids.total()
        assert (r.n_pieces, r.n_byte_pieces, r.n_ranked) == (n, sum(c for x, c in ids.items() if x in single), sum(len(rank([v.encode()])[0]) for v in w))
        assert r.piece_entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in ids.values()) if n else 0)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert {n for n, r in got.items() if n[:2] in ("en", "de") and n[2:].isdigit() and not r.kept} == set()
    assert {n for n, r in got.items() if r.kept} & {f"junk{i}" for i in range(8)} == set()
    assert not any(got[n].kept for n in ("loop0", "few0", "rare", "none", "empty", "blank", "short"))
    assert got["long"].kept and got["nolang"].kept
    monkeypatch.setattr(fertility, "AT_ONCE", 500)
    monkeypatch.setattr(fertility, "KNOWN", 50)
    monkeypatch.setattr(fertility, "BROADCAST_GROUPS", 0)
    again = fertility.fertility_rules(docs.repartition(3), *paths).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got.values()))
    assert fertility.fertility_rules(docs.limit(0), *paths).collect() == []


def plain_bands(values, step, least, fence):
    b = sorted(math.floor(v / step) for v in values)
    at = lambda q: next(x for i, x in enumerate(b) if i + 1 >= q * len(b) and (i + 1 == len(b) or b[i + 1] > x or i + 1 >= q * len(b)))
    lo, hi = at(0.25) * step, (at(0.75) + 1) * step
    return lo, hi, fence * max(hi - lo, least)


def test_bands_are_quartiles_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), 100, 300 + rng.randrange(200), 200, rng.randrange(5), rng.random() * 6, 150) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, n_words long, word_chars long, n_pieces long, n_byte_pieces long, piece_entropy double, n_ranked long").repartition(5)
    bands = {r["group"]: r for r in fertility.fit_bands(df, "g", 2.0).collect()}
    assert set(bands) == {"a", "b", None}
    values = {"entropy": lambda r: r[5], "bytes": lambda r: r[4] / r[3], "pieces": lambda r: math.log(r[2] / r[3] + 1e-6)}
    for g, band in bands.items():
        for m, value in values.items():
            _, step, least = fertility.measures()[m]
            want = plain_bands([value(r) for r in rows if r[0] == g], step, least, 2.0)
            assert [band[f"{m}_{x}"] for x in ("lo", "hi", "reach")] == pytest.approx(want)
