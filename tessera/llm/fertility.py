"""Operator 12: quality rules by tokeniser fertility.

Public vocabularies say how well a text fits the language they were made from: code points a token, the share
of tokens that are bare bytes, and the entropy of the token distribution. Broken words, symbols strewn into
them, capitals and endless repetition all move these figures. A text is rejected where one of them lies outside
its language's band. The bands come from histograms over all documents: quartiles, and fences around them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_text, numbered

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_pieces long, n_byte_pieces long, piece_entropy double, n_ranked long"
)
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
#: Words whose tokens a Python worker remembers, and code points worked on at a time.
KNOWN, AT_ONCE = 300_000, 2_000_000
#: Bands of up to this many groups are broadcast.
BROADCAST_GROUPS = 100_000
#: Words at which the chance of a short text doubles the variance of its figures.
SHORT = 300


def measures() -> dict[str, tuple[Column, float, float]]:
    """Name: (value over FIELDS, width of a histogram bucket, least distance of the quartiles that a band allows for). Ratios are logarithms, so that a band is a factor and buckets stay few."""
    per = lambda n: F.ln(F.col("word_chars") / F.greatest(F.col(n), F.lit(1)) + F.lit(1e-6))
    return {
        "pieces": (per("n_pieces"), 0.002, 0.015),
        "ranked": (per("n_ranked"), 0.002, 0.015),
        "bytes": (F.col("n_byte_pieces") / F.greatest(F.col("n_pieces"), F.lit(1)), 0.001, 0.01),
        "entropy": (F.col("piece_entropy"), 0.01, 0.15),
    }


def vocabulary(path: str) -> Callable[[list[bytes]], list[list[int]]]:
    """Words to token ids, each as it stands behind a blank. Kinds: sentencepiece ``.model``, rank files ``.tiktoken``, tokenizers ``.json``."""
    plain = lambda words: [w.decode("utf-8", "replace") for w in words]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda words: model.encode(plain(words), num_threads=1)
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranked = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda words: [ranked.encode_ordinary(" " + w) for w in plain(words)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    merged = Tokenizer.from_file(path)
    return lambda words: [x.ids for x in merged.encode_batch([" " + w for w in plain(words)], add_special_tokens=False)]


def byte_ids(path: str) -> np.ndarray:
    """Ids of the single-byte tokens that stand in for unknown characters; none where the vocabulary has no such tokens."""
    if not path.endswith(".model"):
        return np.zeros(0, np.int64)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([i for i in range(model.get_piece_size()) if model.is_byte(i)], np.int64)


class _Tokens:
    """Token ids of words, remembered; forgets all of them when they are many."""

    def __init__(self, path: str, counts_only: bool = False):
        self.encode, self.known, self.counts_only = vocabulary(path), {}, counts_only

    def __call__(self, words: list[bytes]) -> list:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), 4096):
            ids = self.encode(new[i : i + 4096])
            self.known.update(zip(new[i : i + 4096], map(len, ids) if self.counts_only else ids, strict=True))
        return [self.known[w] for w in words]


def _grouped(*columns: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows, by pairing columns one after the other: exact, below 2^63."""
    code = columns[0]
    for c in columns[1:]:
        code = pd.factorize(code)[0].astype(np.int64) * (int(c.max(initial=0)) + 1) + c
    return pd.factorize(code)[0].astype(np.int64)


def repeated_words(doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: words that lie in some window of three found twice or more in it."""
    n = len(word) - 2
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[:n] == doc[2:])
    window = _grouped(doc[at], word[at], word[at + 1], word[at + 2])
    twice = at[np.bincount(window, minlength=1)[window] > 1]
    hit = np.zeros(len(word), bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(doc[hit], minlength=n_docs)


def entropy_by_doc(doc: np.ndarray, token: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Shannon entropy in bits of each document's tokens."""
    code = doc * (int(token.max(initial=0)) + 1) + token
    which, distinct = pd.factorize(code)
    n = np.bincount(which, weights=weight, minlength=len(distinct))
    owner = distinct // (int(token.max(initial=0)) + 1)
    total = np.bincount(owner, weights=n, minlength=n_docs)
    share = n / total[owner]
    # the larger shares first, so that the sum does not depend on the order of words
    order = np.lexsort((-share, owner))
    return np.bincount(owner[order], weights=(-share * np.log2(share))[order], minlength=n_docs)


def measurer(piece_path: str, rank_path: str):
    """Makes the function from texts to FIELDS; once a task."""

    def make():
        pieces, ranked, single = _Tokens(piece_path), _Tokens(rank_path, counts_only=True), byte_ids(piece_path)

        def some(texts: list[str]) -> dict[str, np.ndarray]:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            split = [b.split() for b in raw]  # at ASCII white space, as bytes are split
            n, sizes = len(texts), np.array([len(x) for x in split], np.int64)
            code, words = pd.factorize(np.array([*chain.from_iterable(split), None], dtype=object)[:-1])
            doc, code = np.repeat(np.arange(n), sizes), code.astype(np.int64)
            lines = [[x for x in b.split(b"\n") if x and not x.isspace()] for b in raw]
            # each document's distinct words with their counts, then the tokens of these
            pair, first = pd.factorize(doc * max(len(words), 1) + code)
            times = np.bincount(pair, minlength=len(first)).astype(np.float64)
            d, w = first // max(len(words), 1), first % max(len(words), 1)
            ids = pieces(list(words))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            k = size[w]
            token = flat[np.repeat(start[w] - np.concatenate([[0], np.cumsum(k)])[:-1], k) + np.arange(int(k.sum()))]
            owner, weight = np.repeat(d, k), np.repeat(times, k)
            is_byte = np.isin(token, single)
            count = lambda own, by: np.bincount(own, weights=by, minlength=n).astype(np.int64)
            other = np.fromiter(ranked(list(words)), np.float64, len(words))
            return {
                "n_words": sizes,
                "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
                "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
                "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
                "n_repeat_words": repeated_words(doc, code, n),
                "n_pieces": count(owner, weight),
                "n_byte_pieces": count(owner[is_byte], weight[is_byte]),
                "piece_entropy": np.maximum(entropy_by_doc(owner, token, weight, n), 0.0),
                "n_ranked": count(d, times * other[w]),
            }

        def work(texts: list[str | None]) -> dict[str, Any]:
            texts, parts, at = [t or "" for t in texts], [], 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= AT_ONCE):
                    chars, stop = chars + len(texts[stop]), stop + 1
                parts.append(some(texts[at:stop]))
                at = stop
            return {f: np.concatenate([p[f] for p in parts]) for f in parts[0]}

        return work

    return make


#: Unicode scripts told apart where a row names no language; fixed names of the regular expressions.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")


def main_script(text: Column) -> Column:
    """The script with the most letters, the earlier of equals; ``none`` without letters of any."""
    counts = [F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("at"), F.lit(s).alias("script")) for i, s in enumerate(SCRIPTS)]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["script"]).otherwise(F.lit("none"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_bands(measured: DataFrame, group_col: str, fence: float = 3.0) -> DataFrame:
    """One row per group of ``group_col``: ``<measure>_lo``, ``<measure>_hi`` (quartiles) and ``<measure>_reach``.

    Values are counted in narrow buckets, over all rows: a group adds at most some ten thousand of them to the
    shuffle from each task, however many rows it has. Quartiles are the buckets where a quarter and three quarters
    of the rows are reached; the band reaches ``fence`` times their distance beyond both. A band never is narrower
    than the least distance in ``measures`` allows, so that a group of few or equal texts does not reject by a hair.
    """
    each = [F.struct(F.lit(name).alias("measure"), F.floor(value / step).alias("bucket")) for name, (value, step, _) in measures().items()]
    counts = measured.select(F.col(group_col).alias("group"), F.explode(F.array(*each)).alias("x")).groupBy("group", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("group", "measure").orderBy("bucket")
    whole = Window.partitionBy("group", "measure")
    upto = counts.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))
    quartiles = upto.groupBy("group", "measure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    bands = []
    for name, (_, step, least) in measures().items():
        q1, q3 = F.col("q1") * step, (F.col("q3") + 1) * step
        parts = {"lo": q1, "hi": q3, "reach": fence * F.greatest(q3 - q1, F.lit(least))}
        bands += [F.max(F.when(F.col("measure") == name, x)).alias(f"{name}_{part}") for part, x in parts.items()]
    return quartiles.groupBy("group").agg(*bands)


def within(measured: DataFrame, group_col: str, bands: DataFrame) -> DataFrame:
    """``measured`` plus ``in_band``. Bands reach further for short texts, whose figures vary more: as the root of
    1 + SHORT / words. A group without a band is taken as in it."""
    few = bands.count() <= BROADCAST_GROUPS
    wide = F.sqrt(1 + F.lit(float(SHORT)) / F.greatest(F.col("n_words"), F.lit(1)))
    inside = F.lit(True)
    for m, (value, _, _) in measures().items():
        lo, hi, reach = (F.col(f"{m}_{x}") for x in ("lo", "hi", "reach"))
        inside &= lo.isNull() | value.between(lo - reach * wide, hi + reach * wide)
    right = bands.withColumnRenamed("group", "_group")
    joined = measured.join(F.broadcast(right) if few else right, F.col(group_col).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn("in_band", inside).select(*measured.columns, "in_band")


def fertility_rules(
    docs: DataFrame,
    piece_path: str,
    rank_path: str,
    *,
    text_col: str = "text",
    lang_col: str | None = "lang",
    fence: float = 3.0,
    bands: DataFrame | None = None,
) -> DataFrame:
    """``docs`` without its text, plus FIELDS, ``base_failed`` and ``kept``.

    ``piece_path`` is the vocabulary whose pieces are counted and weighed (with byte fallback: a sentencepiece model);
    ``rank_path`` is a second one, counted. Words are encoded as they stand behind a blank. A row's group is its
    language; without one (null, blank, or no ``lang_col``) it is the main script of its text. Bands are fitted to
    the rows that pass the base rules, or given (columns ``group`` and those of ``fit_bands``).

    Null and empty texts have no words and fail the base rules. Repeated rows count as often as they stand, and come
    back as often. An empty table gives an empty result. Input columns named like a new one give way to it; all
    others pass, whatever their names.
    """
    old, (docs, new) = docs.columns, numbered(docs)
    tmp = Scratch(docs.sparkSession, "fertility")
    text = new[text_col]
    group = main_script(F.coalesce(F.col(text), F.lit("")))
    if lang_col is not None:
        lang = F.col(new[lang_col]).cast("string")
        group = F.when(F.trim(lang) != "", lang).otherwise(group)
    measured = map_text(docs.withColumn("_group_of", group), text, measurer(piece_path, rank_path), FIELDS)
    measured = tmp.table(measured.withColumn("base_failed", base_failed()), "measured")
    if bands is None:
        bands = tmp.table(fit_bands(measured.filter(~F.col("base_failed")), "_group_of", fence), "bands")
    made = [x.split()[0] for x in FIELDS.split(", ")] + ["base_failed", "kept"]
    kept = within(measured, "_group_of", bands).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
    return kept.select(*[F.col(new[c]).alias(c) for c in old if c != text_col and c not in made], *made)


def op12_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    ruled = fertility_rules(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ruled.drop("lang")
