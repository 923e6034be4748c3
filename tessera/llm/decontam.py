"""Operator 6: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised on their UTF-8 bytes (A-Z lowered, every other ASCII character that is neither a
letter nor a digit made a blank), so a word keeps its byte offset and a hit maps back to the original.
All windows of the benchmark go into one automaton, which reads every document once.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, numbered

#: Bytes of benchmark text in one automaton. A longer benchmark is scanned block by block.
BLOCK_BYTES = 400_000

_WORD = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
_RUN = re.compile(rb"[^ ]+")

HITS = "start_word int, end_word int, start_char int, end_char int"


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def windows_of(words: list[bytes], n: int) -> list[bytes]:
    """Every run of n words, as it stands in a text whose words are framed by single blanks."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))]


def build(items: list[tuple[str, str | None]], n: int) -> ahocorasick.Automaton | None:
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(normalise(text).split(), n):
            found.setdefault(w, set()).add(item)
    if not found:
        return None
    made = ahocorasick.Automaton()
    for w, ids in found.items():
        made.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(sorted(ids))))
    made.make_automaton()
    return made


def scan(text: str | None, automaton) -> tuple[int, list[str], list[dict]]:
    """Words of the text, items with a window in it, and the maximal hit runs: words and code points."""
    raw = normalise(text)
    words = raw.split()
    if automaton is None or not words:
        return len(words), [], []
    line = b" " + b" ".join(words) + b" "
    hits, items = [], set()
    for end, (size, ids) in automaton.iter(line.decode("latin-1")):
        hits.append((end, size))
        items.update(ids)
    if not hits:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    ends = np.searchsorted(blanks, [e for e, _ in hits])  # the word before blank number k is word k - 1
    runs: list[list[int]] = []
    for a, b in sorted((int(e) - s, int(e)) for e, (_, s) in zip(ends, hits, strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    at = [m.span() for m in _RUN.finditer(raw)]
    source = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate([[0], np.cumsum((source & 0xC0) != 0x80)])
    spans = [dict(start_word=a, end_word=b, start_char=int(chars[at[a][0]]), end_char=int(chars[at[b - 1][1]])) for a, b in runs]
    return len(words), sorted(items), spans


_BUILT: dict = {}


def _scanner(items: list[tuple[str, str | None]], n: int):
    """What each text hits of this block of items."""

    def make():
        key = (n, tuple(items))
        if key not in _BUILT:  # one automaton a Python worker
            _BUILT.clear()
            _BUILT[key] = build(items, n)
        automaton = _BUILT[key]

        def run(texts: list[str | None]) -> dict:
            rows = [scan(t, automaton) for t in texts]
            return {"n_words": [r[0] for r in rows], "items": [r[1] for r in rows], "spans": [r[2] for r in rows]}

        return run

    return make


def _joined(old: str, new: str) -> tuple[Column, Column]:
    """Items and spans of two blocks as one; spans that touch become one, as within a block."""
    both = F.array_sort(F.concat(f"{old}.spans", f"{new}.spans"))
    touch = lambda acc, s: s["start_word"] <= F.element_at(acc, -1)["end_word"]
    grown = lambda acc, s: F.when(s["end_word"] > F.element_at(acc, -1)["end_word"], F.struct(F.element_at(acc, -1)["start_word"].alias("start_word"), s["end_word"].alias("end_word"), F.element_at(acc, -1)["start_char"].alias("start_char"), s["end_char"].alias("end_char"))).otherwise(F.element_at(acc, -1))
    merged = F.aggregate(both, F.slice(both, 1, 1), lambda acc, s: F.when(touch(acc, s), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown(acc, s)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(F.array_union(f"{old}.items", f"{new}.items")), F.when(F.size(both) == 0, both).otherwise(merged)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str | None]]]:
    """The stated query set in blocks of bounded size; each block is broadcast with the scan."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 16
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        return [[(r.item, r.text) for r in rows.filter("item is not null").collect()]]
    part = F.pmod(F.xxhash64("item"), F.lit(blocks))
    return [[(r.item, r.text) for r in rows.filter("item is not null").filter(part == b).collect()] for b in range(blocks)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), plus n_words, items (sorted) and spans (hit runs, end exclusive).

    Null and empty texts have no words and no hits; null items and items without words hit nothing, as
    does an empty benchmark. Repeated rows are scanned and returned as often as they stand. Input
    columns named n_words, items or spans give way to the new ones. A benchmark of several blocks is
    scanned block after block as each row passes through; rows are neither joined nor shuffled.
    """
    spans = f"array<struct<{HITS.replace(' int', ':int')}>>"
    found, blocks = docs, benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    if len(blocks) == 1:
        return map_text(docs, text_col, _scanner(blocks[0], window), f"n_words long, items array<string>, spans {spans}", keep_text=keep_text)
    names = [c for c in docs.columns if (keep_text or c != text_col) and c not in ("n_words", "items", "spans")]
    plain, new = numbered(docs)
    for i, block in enumerate(blocks):
        found = map_text(plain if i == 0 else found, new[text_col], _scanner(block, window), f"n_words long, items array<string>, spans {spans}", keep_text=True)
        now = F.struct("items", "spans")
        found = found.withColumn("_new", now).drop("items", "spans")
        if i:
            items, merged = _joined("_old", "_new")
            found = found.withColumn("_old", F.struct(items.alias("items"), merged.alias("spans"))).drop("_new")
        else:
            found = found.withColumnRenamed("_new", "_old")
    return found.select(*[F.col(new[c]).alias(c) for c in names], "n_words", "_old.items", "_old.spans")


def words_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end_word"] - s["start_word"])


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.withColumn("n_hit", words_hit(F.col("spans")))
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontam_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, by the same rule as the query.

    Rows with null or empty text have nothing to hit and stay; so do repeated rows and rows with a null id, each for
    itself. An empty table or benchmark is no error. Columns of any name pass through as they are.
    """
    plain, new = numbered(docs)
    found = find_contamination(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=new["text"], keep_text=True)
    n = words_hit(F.col("spans"))
    return found.filter(~((n > 0) & (20 * n >= F.col("n_words")))).select(*plain.columns).toDF(*docs.columns)
