"""Operators on single documents, sources and pages."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, fingerprint, mixing, packing, quality, secrets, tokencount, warc

tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", None, "one", "!!! ???", "a b c d e f g", "A B c d e f g", "Ünï ça va. " * 40, "x " * 20000, "tab\tnew\nline \x01\x02\x03 end", "a b c d e f g"]


def frame(spark, texts, extra="", value=()):
    rows = [(i, t, *value) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}").repartition(3)


# --- 1


def test_fingerprint_likeness_is_weighted_jaccard(spark):
    rng = random.Random(0)
    texts = []
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        keep = rng.randrange(201)
        texts += [" ".join(w), " ".join(w[:keep] + [f"z{rng.randrange(10**6)}" for _ in range(200 - keep)])]
        if i % 3 == 0:  # repeated shingles weigh more
            texts[-1] = " ".join([texts[-1]] * 2)
    rows = fingerprint.with_fingerprint(frame(spark, texts), "text", "print")
    prints = {r.doc_id: r.print for r in rows.collect()}
    error = []
    for i in range(0, len(texts), 2):
        a, b = (Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts[i : i + 2])
        same = sum(prints[i][k : k + 4] == prints[i + 1][k : k + 4] for k in range(0, 256, 4)) / 64
        error.append(same - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.09


def test_fingerprint_likeness_of_skewed_weights(spark):
    rng = random.Random(6)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = own(12), []
    for heavy, light in ((["x"] * 10000, 300), (["x"] * 1000, 400), (line * 100, 300), (line * 30, 200)) * 3:
        texts += [" ".join(heavy + own(light)), " ".join(heavy + own(light))]
    prints = {r.doc_id: r.p for r in fingerprint.with_fingerprint(frame(spark, texts), "text", "p").collect()}
    error = []
    for i in range(0, len(texts), 2):
        a, b = (Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts[i : i + 2])
        same = sum(prints[i][k : k + 4] == prints[i + 1][k : k + 4] for k in range(0, 256, 4)) / 64
        error.append(same - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(error)) < 0.05 and max(map(abs, error)) < 0.25, error


def test_fingerprints_of_odd_texts(spark):
    prints = {r.doc_id: r.p for r in fingerprint.with_fingerprint(frame(spark, ODD, ", p string", ("clash",)), "text", "p").collect()}
    assert prints[0] == prints[1] == "" and prints[4] == prints[5] == prints[9]
    assert all(re.fullmatch("[0-9a-f]{256}", prints[i]) for i in range(2, 10))
    assert len({prints[i] for i in range(2, 9)}) == 6
    assert fingerprint.with_fingerprint(frame(spark, ODD).limit(0), "text", "p").collect() == []


def test_next_rows_over_ranges(spark):
    ids = random.Random(1).sample(range(10**6), 301)
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r._next for r in fingerprint.with_next(rows, "doc_id", "text")[0].filter("not _guest").collect()}
    order = sorted(ids)
    assert got == {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    one = fingerprint.with_next(rows.filter(F.col("doc_id") == ids[0]), "doc_id", "text")[0].filter("not _guest").collect()
    assert one[0]._next == one[0].text
    assert fingerprint.with_next(rows.limit(0), "doc_id", "text")[0].collect() == []


def test_fingerprint_query_by_its_definition(spark, tmp_path):
    texts = {5: "a b c d e f g h", 9: "", 2: "Zwölf Boxkämpfer jagen " * 9, 30: None, 31: "a b c d e f g h", 2**62: "x" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprint.op1_query(spark, str(tmp_path)).collect()}
    order = sorted(texts)
    edited = {}
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        t, u = texts[d] or "", texts[after] or ""
        edited[d] = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited[d].encode()).hexdigest())
    plain = spark.createDataFrame([(d, t or "", edited[d]) for d, t in texts.items()], "doc_id long, text string, edited string")
    prints = {r.doc_id: (r.p, r.q) for r in fingerprint.with_fingerprint(fingerprint.with_fingerprint(plain, "text", "p"), "edited", "q").collect()}
    like = lambda a, b: 1.0 if a == b else 0.0 if "" in (a, b) else sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 256, 4)) / 64
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        assert (got[d].fingerprint, got[d].edited_fingerprint) == prints[d]
        assert (got[d].near_edited, got[d].near_next) == (like(*prints[d]), like(prints[d][0], prints[after][0]))
    assert got[5].fingerprint == got[31].fingerprint


def test_next_row_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(None, "n"), (3, "b"), (3, "a"), (4, None)], "doc_id long, text string")
    got = fingerprint.with_next(rows, "doc_id", "text")[0].filter("not _guest").collect()
    assert {(r.doc_id, r.text): r._next for r in got} == {(None, "n"): "a", (3, "a"): "b", (3, "b"): None, (4, None): "n"}


# --- 2

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_findings(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


SECRETS = [
    "password=abc token : 'abcdef1' Secret:\"x\"",
    "secret:token: abcdef123 API_KEY==abcdef ApIkEy = zzzzzz",
    "é AKIA" + "A" * 16 + " AKIAAKIA0 ü AKIA" + "9" * 40,
    "deadbeef" * 3 + " " + "0" * 23 + " " + "f" * 50 + "\n" + "a" * 24,
    "\x01\x02\x03 token=\x01abcdef1 passwd=abcdefg",
    "token=" + "0123456789abcdef" * 4,
]


def test_secret_scan_by_plain_regex(spark, tmp_path):
    texts = SECRETS + ODD + SECRETS[:2]
    rows = secrets.scan_versions(frame(spark, texts, ", blob int", (1,)), str(tmp_path / "ledger")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(f.start, f.place, f.end) for f in r.findings] == plain_findings(texts[r.doc_id])


def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    seen = []
    real = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs, rules: (seen.append(sorted((r.blob, *r.todo) for r in blobs.select("blob", "todo").collect())), real(blobs, rules))[1])
    ledger, rules = str(tmp_path / "ledger"), secrets.BASE_RULES
    first = secrets.scan_versions(frame(spark, SECRETS[:3] * 2), ledger).collect()
    again = secrets.scan_versions(frame(spark, SECRETS[:4]), ledger).collect()
    newer = (secrets.Rule("hex", 2, "", "[0-9a-f]{30,}", 30),) + rules[:2]
    changed = secrets.scan_versions(frame(spark, SECRETS[:4]), ledger, rules=newer).collect()
    assert [len(s) for s in seen] == [3, 1, 4] and all(len(t) == 4 for t in seen[1]) and all(t[1:] == ("hex@2",) for t in seen[2])
    assert len(first) == 6 and len(again) == 4
    assert {f.kind for r in changed for f in r.findings if r.doc_id == 3} == {"hex"} and sum(len(r.findings) for r in changed if r.doc_id == 3) == 1
    assert secrets.scan_versions(frame(spark, SECRETS).limit(0), ledger).collect() == []


# --- 3


def test_token_counts_of_a_sentencepiece_model(spark, tmp_path):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    texts = [*ODD, "wortohneleerzeichen" * 3000, "<s> not a sign </s>"]
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = tokencount.count_tokens(frame(spark, texts), path, str(tmp_path / "cache")).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}


def test_token_counts_are_the_librarys(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    texts = ODD + ["don't <|endoftext|> I'll <|EndOfText|>", "  lead  wide\u0085x", "é ́x ΣΑΣ σας", "it's  it's\n\nit's", "你好 мир 123 45"]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for run in range(2):
        rows = tokencount.count_tokens(frame(spark, texts, ", n_tokens string", ("clash",)), path, str(tmp_path / "cache"), limit=10, drops_blanks=True).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(want)), run
        assert all(r.over_limit == (r.n_tokens > 10) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in rows)
    stored = spark.read.parquet(str(tmp_path / "cache"))
    assert stored.count() == stored.select("digest").distinct().count()  # the second run found every count
    assert tokencount.count_tokens(frame(spark, texts).limit(0), path, str(tmp_path / "cache")).collect() == []


# --- 4


def test_warc_round_trip_and_order(spark, tmp_path):
    pages = [(i, f"http://www.H{i % 3}.example:80/p?q={i % 5}#f", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * (i % 4), "x") for i in range(40)] + [(100, None, None, "x"), (101, "bad url\nline", "", "x")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string").repartition(6)
    warc.write_archives(rows, str(tmp_path / "warc"))
    captures = warc.read_archives(spark, str(tmp_path / "warc"))
    got = {r.page_id: r for r in captures.collect()}
    by = defaultdict(list)
    for i, _, html, _ in pages:
        by[html or ""].append(i)
    for i, _, html, _ in pages:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        last = max(by[html or ""])
        assert (r.record_type, r.refers_to) == (("response", None) if i == last else ("revisit", last))
    merged = [(r.urlkey, r.timestamp, r.page_id) for r in warc.merge_index(captures).collect()]
    assert merged == sorted(merged) and len(merged) == len(pages)
    assert got[0].urlkey == "example,h0)/p?q=0"
    warc.write_archives(rows.limit(0), str(tmp_path / "none"))
    assert warc.merge_index(warc.read_archives(spark, str(tmp_path / "none"))).collect() == []


def test_warc_times_of_any_id_in_any_time_zone(spark, tmp_path):
    ids = [None, 0, 1, -1, 86_399, 951_782_400, 253_402_300_799, 253_402_300_800, -62_135_596_800, -62_135_596_801, 10**13, 2**60, 2**62 + 1, -(2**62), 2**63 - 1]
    rows = spark.createDataFrame([(i, f"http://h/{i}", "<p>same</p>" if n % 2 else f"<p>{i}</p>", "clash") for n, i in enumerate(ids)], "page_id long, url string, html string, urlkey string")
    rows = rows.union(rows.filter("page_id = 1"))  # a repeated row
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        warc.write_archives(rows, str(tmp_path / "warc"))
        got = warc.merge_index(warc.read_archives(spark, str(tmp_path / "warc"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    held = lambda i: max(-62_135_596_800, min(i or 0, 253_402_300_799))
    when = lambda i: (np.datetime64("1970-01-01T00:00:00") + np.timedelta64(held(i), "s")).item().strftime("%Y%m%d%H%M%S").rjust(14, "0")
    assert Counter((r.page_id, r.timestamp) for r in got) == Counter((i, when(i)) for i in [*ids, 1])
    same = {r.page_id for r in got if r.refers_to == max(i for n, i in enumerate(ids) if n % 2)}
    assert same == {i for n, i in enumerate(ids) if n % 2} - {max(i for n, i in enumerate(ids) if n % 2)}


def test_index_of_many_ranges_and_one_hot_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 50)
    rng = random.Random(2)
    rows = [("com,hot)/" if rng.random() < 0.5 else f"k{rng.randrange(99)}", f"{rng.randrange(10**6):014}", "u", i, "response", None, "d", 1, f"run{i % 7}", 0, 1) for i in range(400)]
    rows = [r[:9] + (n,) + r[10:] for n, r in enumerate(sorted(rows))]
    got = [(r.urlkey, r.timestamp, r.page_id) for r in warc.merge_index(spark.createDataFrame(rows, warc.CAPTURES)).collect()]
    assert got == sorted(got) and len(got) == 400


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(9), i) for _ in range(rng.randrange(8))) for i in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# --- 5


def test_packing_round_trip(spark):
    texts = ODD + ["word " * n for n in (10, 500, 3000)]
    path, size = tokenizers.path("byte_bpe_50k.tiktoken"), 64
    rows = packing.pack(frame(spark, texts, ", row string", ("x",)), path, tokenizers.PATTERN, size=size, shard_tokens=2000).collect()
    pieces = {}
    for r in rows:
        assert len(r.input_ids) == len(r.position_ids) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        assert set(r.input_ids[r.n_tokens :]) <= {50256}
        for d, p, (a, b) in zip(r.doc_ids, r.pieces, pairwise(r.cu_seqlens), strict=True):
            assert r.position_ids[a:b] == list(range(b - a))
            pieces[d, p] = r.input_ids[a:b]
    back = defaultdict(list)
    for d, p in sorted(pieces):
        back[d] += pieces[d, p]
    decode = packing.encoder(path, tokenizers.PATTERN).decode
    assert all(decode(back[i]) == (t or "") for i, t in enumerate(texts))
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    assert packing.pack(frame(spark, texts).limit(0), path, tokenizers.PATTERN).collect() == []


def test_packed_rows_are_written_and_read_back(spark, tmp_path):
    frame(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text")
    got = packing.op5_query(spark, str(tmp_path))
    assert got.inputFiles() and not any("documents.parquet" in f for f in got.inputFiles())
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    assert sorted(map(str, got.collect())) == sorted(map(str, packing.pack(docs, path, tokenizers.PATTERN).collect()))


@pytest.mark.parametrize("id_type", ["<u2", "<u4"])
def test_matrices_are_written_and_read_back(spark, tmp_path, id_type):
    docs = spark.createDataFrame([(None, "null id"), (7, "twice"), (7, "twice"), (2**62, "big " * 400), (1, None), (2, "")], "doc_id long, text string")
    path, out = tokenizers.path("byte_bpe_50k.tiktoken"), str(tmp_path / "m")
    packing.write_matrices(docs, out, path, tokenizers.PATTERN, id_type=id_type, size=64)
    got = packing.read_matrices(spark, out).collect()
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(docs, path, tokenizers.PATTERN, size=64).collect()))
    assert Counter(d for r in got for d, p in zip(r.doc_ids, r.pieces, strict=True) if p == 0) == {None: 1, 7: 2, 2**62: 1}
    for r in spark.read.parquet(out).collect():  # what a loader sees: plain matrices
        ids = np.frombuffer(r.input_ids, id_type).reshape(r.n_rows, 64)
        resets = np.frombuffer(r.position_ids, "<u2").reshape(r.n_rows, 64)
        cu, at = np.frombuffer(r.cu_seqlens, "<u4"), 0
        for row, n in enumerate(r.segments):
            own = cu[at : at + n + 1]
            assert own[0] == 0 and (ids[row, own[-1] :] == 50256).all()
            assert set(np.flatnonzero(resets[row, : own[-1]] == 0)) == set(own[:-1])
            at += n + 1
        assert at == len(cu)
    packing.write_matrices(docs.limit(0), out, path, tokenizers.PATTERN)
    assert packing.read_matrices(spark, out).collect() == []


def test_row_groups_of_matrices_are_bounded(spark, tmp_path):
    """A task reads and writes a row group as a whole: ten blocks of 2 MB are more than one."""
    docs = spark.range(12, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 400000) AS text")
    packing.write_matrices(docs, str(tmp_path / "m"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, id_type="<u2")
    groups = [m.row_group(i) for f in (tmp_path / "m").glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 10 and max(g.total_byte_size for g in groups) < 18_000_000
    assert sum(r.n_tokens for r in packing.read_matrices(spark, str(tmp_path / "m")).collect()) >= 4_800_000


def test_an_id_too_large_for_its_type_is_an_error():
    with pytest.raises(ValueError):
        next(packing.pack_shard("s", [(1, 0, np.array([70_000]))], 4, 0)).binary("<u2")


def plain_best_fit(lengths, size):
    rows = []
    for i in np.argsort(-np.array(lengths), kind="stable"):
        fits = [r for r in rows if r[0] >= lengths[i]]
        row = min(fits, key=lambda r: r[0], default=None)
        if row is None:
            rows.append(row := [size, []])
        row[0] -= lengths[i]
        row[1].append(int(i))
    return sorted(r[0] for r in rows)


def test_best_fit_by_linear_search():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(0, 60))]
        got = packing.best_fit_decreasing(np.array(lengths, int), 32)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert sorted(32 - sum(lengths[i] for i in r) for r in got) == plain_best_fit(lengths, 32)


# --- 6


def plain_hits(text, items):
    def low(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = low(text), set(), set()
    for item, t in items:
        q = low(t)
        n = min(13, len(q))
        wins = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if q else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [400_000, 60])
def test_contamination_by_sliding_windows(spark, block):
    rng = random.Random(6)
    make = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    items = [(i, " ".join(make(rng.randrange(1, 30)))) for i in range(25)] + [(90, ""), (91, None), (92, "?!"), (93, "Zürich ÉTÉ été")]
    texts = [", ".join(make(50) + items[rng.randrange(25)][1].upper().split() + make(30)) for _ in range(40)] + ODD + ["in zürich ÉTÉ été, so"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find_contamination(frame(spark, texts, ", items string", ("x",)), bench, block_bytes=block).withColumn("hit", decontam.words_hit(F.col("spans"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.hit, r["items"]) == plain_hits(texts[r.doc_id], items)
        for s in r.spans:  # the offsets are those of the original
            own = decontam.normalise(texts[r.doc_id][s.start_char : s.end_char]).split()
            assert own == decontam.normalise(texts[r.doc_id]).split()[s.start_word : s.end_word]
    assert all(not r["items"] for r in decontam.find_contamination(frame(spark, texts), bench.limit(0)).collect())
    assert decontam.find_contamination(frame(spark, texts).limit(0), bench).collect() == []


# --- 9


def quality_rows(spark, n):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "of", "is", "red", "fox", "runs", "far"]) for _ in range(40)) for _ in range(n)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "cheap***", "the", "of"]) for _ in range(40)) for _ in range(n // 3)]
    docs = frame(spark, good + bad + ["", None, "x " * 5000], ", score string", ("clash",))
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(len(good + bad))] + [(10**6, 1), (None, 0), (1, None)], "doc_id long, quality int")
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_rows(spark, 120)
    model = quality.train(docs, labels.filter("doc_id % 4 <> 0"), max_fit_rows=80)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 163 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[i].predicted == (i < 120) for i in range(0, 160, 4)]) >= 0.95
    assert quality.score(docs.limit(0), model).collect() == []


def test_log_count_ratio_by_counting():
    rows, y = [[0, 1], [1, 2], [1]], [1, 0, 1]
    good, bad = (np.array([sum(b in r and t == label for r, t in zip(rows, y, strict=True)) for b in range(4)], float) for label in (1, 0))
    want = [np.log((g + 1) / (sum(good) + 4)) - np.log((b + 1) / (sum(bad) + 4)) for g, b in zip(good, bad, strict=True)]
    assert quality.log_count_ratio(good, bad) == pytest.approx(want)


def test_dual_descent_closes_the_gap():
    """The primal value of the weights is no farther from the best dual value than the tolerance."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(80)]
    y = np.where([r.mean() + rng.normal(0, 5) > 30 for r in rows], 1, -1)
    r = rng.normal(size=60)
    w = quality.fit_hinge(rows, y, r, epochs=400)
    x = np.zeros((80, 61))
    for i, f in enumerate(rows):
        at, v = quality._row(f, r)
        x[i, at] = v
    most = np.where(y > 0, 80 / (2 * (y > 0).sum()), 80 / (2 * (y < 0).sum()))
    primal = w @ w / 2 + (most * np.maximum(0, 1 - y * (x @ w))).sum()
    a, q = np.zeros(80), (x * y[:, None]) @ (x * y[:, None]).T  # projected gradient on the dual: slow and plain
    for _ in range(60_000):
        a = np.clip(a + 0.02 * (1 - q @ a), 0, most)
    assert 0 <= primal - (a.sum() - a @ q @ a / 2) + 1e-6 < 1e-2 * primal


def test_scores_keep_ids_beside_nulls_and_split_ties_at_the_threshold(spark):
    docs, labels = quality_rows(spark, 12)
    model = quality.train(docs, labels)
    rows = spark.createDataFrame([(2**62 + 1, "a"), (None, "a"), (2**62 + 3, "a"), (2**62 + 3, "a")], "doc_id long, text string")
    own = quality.score(rows, model).collect()
    assert Counter(r.doc_id for r in own) == {2**62 + 1: 1, None: 1, 2**62 + 3: 2} and len({r.score for r in own}) == 1
    assert {r.predicted for r in quality.score(rows, model, threshold=own[0].score).collect()} == {1}


def test_quality_without_labels(spark):
    docs, labels = quality_rows(spark, 6)
    model = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


# --- 10


def plain_targets(sizes, weights):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        now = [3 * s if i in capped else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and now[i] > 3 * s}
        if not over:
            return now
        capped |= over


@pytest.mark.parametrize("few", [True, False])
def test_mix(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rng = random.Random(10)
    counts = {"a": 30, "b": 2000, "c": 400, "Z": 700, None: 500, "é": 5, "empty": 2}
    rows = [(s, "" if s == "empty" else " ".join(["w"] * rng.randrange(0, 30))) for s, n in counts.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, s, "x") for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, size string").repartition(4)
    got = mixing.mix_sources(docs).collect()
    order = sorted((s for s in counts if s), key=lambda s: s) + [None]
    sizes = [sum(r.size for r in got if r.source == s) for s in order]
    want = dict(zip(order, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    for s, size in zip(order, sizes, strict=True):
        own = [r for r in got if r.source == s]
        assert len(own) == counts[s] and {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[s])
        assert all(0 <= r.copies <= 3 and r.size == len((r.text or "").split()) for r in own)
        assert abs(sum(r.size * r.copies for r in own) - want[s]) <= 30
    again = {(r.doc_id, r.copies) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert mixing.mix_sources(docs.limit(0)).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_mix_of_null_and_repeated_ids(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_REPEATS", 0)
    rows = [(None, "w w w w w", "abc"[i % 3]) for i in range(300)] + [(7, "u u u u u", "abc"[i % 3]) for i in range(300)] + [(None, f"v{i} v v v v", "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, _mix_key string").repartition(4)
    got = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 5
