"""Operator 3: token counts with a digest cache.

A text's key is the SHA-256 of its normalised content with the digest of the tokenizer file. Stored counts
are joined on that key; only distinct keys without a count are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """SHA-256 of the vocabulary file: another file, other counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


_LOADED: dict = {}


def counter(path: str):
    """Texts to counts, as the file's library gives them: no added, begin or end tokens, no truncation or padding."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


#: Distinct parts whose counts a Python worker remembers; then it starts afresh.
PARTS = 400_000


def _by_parts(path: str):
    """Counts as sums over parts between white space; each new part goes through the tokenizer once."""
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        if len(known) > PARTS:
            known.clear()
        new = list({w for x in split for w in x if w not in known})
        for i in range(0, len(new), 1024):
            known.update(zip(new[i : i + 1024], counter(path)(new[i : i + 1024]), strict=True))
        return [sum(map(known.__getitem__, x)) for x in split]

    return count


def _encode(path: str, by_parts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _by_parts(path) if by_parts else counter(path)
        for batch in batches:
            texts, n = batch["content"].tolist(), []
            for i in range(0, len(texts), 64):  # few texts at a time: an encoding holds far more than its text
                n += count(texts[i : i + 64])
            yield pd.DataFrame({"tokenizer": batch["tokenizer"], "digest": batch["digest"], "n_tokens": n})

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    *,
    text_col: str = "text",
    limit: int = 2048,
    drops_blanks: bool = False,
) -> DataFrame:
    """``docs`` without its text, plus n_bytes, n_tokens, over_limit and digest; the cache gains the misses.

    ``cache_path`` is a folder of Parquet files, made at need. ``drops_blanks`` may be set for tokenizers
    that turn each run of white space into one blank and then drop it, so that no token reaches over it: texts
    that differ only there share a cache entry, and a text's count is the sum of its parts' counts. Null counts as empty. Repeated rows come back as often as they stand, and are encoded once,
    as are copies. An empty table gives an empty result. Input columns with the new names are replaced.
    Appending is safe to repeat: should a run end between its append and its result, the next finds the counts.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    if drops_blanks:
        content = F.regexp_replace(content, r"[\x20\x09-\x0D]+", " ")
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit", "digest")]
    n_bytes = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    keyed = docs.select(*rest, n_bytes.alias("n_bytes"), F.sha2(content, 256).alias("digest"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    distinct = docs.select(content.alias("content")).select("content", F.sha2("content", 256).alias("digest")).groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(stored.select("digest"), "digest", "left_anti").withColumn("tokenizer", F.lit(version))
    misses.mapInPandas(_encode(tokenizer_path, drops_blanks), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # a written table: with no aggregation beside it, Spark splits the join where one text has very many copies
    counts = Scratch(spark, "token-counts").table(counts, "counts")
    return keyed.join(counts.hint("merge"), "digest").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cache = Scratch(spark, "token-cache").path("counts")
    # this tokenizer's rules squeeze white space and its word pattern leaves it out
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache, drops_blanks=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
