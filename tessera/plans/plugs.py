"""Plug points: one's own splitter, router, chunker, embedder, retriever or scorer under a name.

What is registered is made from options and works on columns or DataFrames, so a plan stays one plan:

* splitter: options to (text column) -> array of sentences;
* router: options to (documents) -> documents;
* chunker: options to (documents with doc_id, sentences, vectors) -> (doc_id, position, chunk_id, text);
* embedder: options to (text column) -> vector;
* retriever: options to (items, queries, k) -> (query_id, rank, item_id, score);
* scorer: options to (array of tokens) -> perplexity;
* offset_splitter: options to a maker of (text) -> (start, end) of its sentences, see ``operators.split.split_by``;
* pair_scorer: options to a maker of (texts, what each is given) -> perplexities, see ``operators.scoring``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunk as C
from tessera.operators import retrieval as N
from tessera.operators import scoring
from tessera.operators import split as S

KINDS = ("splitter", "router", "chunker", "embedder", "retriever", "scorer", "pair_scorer", "offset_splitter")
_PLUGS: dict[str, dict[str, Callable]] = {kind: {} for kind in KINDS}


def register(kind: str, name: str, make: Callable) -> None:
    if kind not in _PLUGS:
        raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
    _PLUGS[kind][name] = make


def names(kind: str) -> list[str]:
    return sorted(_PLUGS[kind])


def get(kind: str, name: str, /, **options):
    if name not in _PLUGS[kind]:
        raise ValueError(f"unknown {kind} {name!r}; one of {names(kind)}")
    return _PLUGS[kind][name](**options)


def prefixed(text, instruction: str | None):
    """An instruction put before a text as it stands; none leaves it."""
    return F.concat(F.lit(instruction), text) if instruction else text


def _routed(name: str):
    return lambda: lambda docs: docs.withColumn("router_info", F.lit(name))


def _hashed(dimensions: int = 32, instruction: str | None = None):
    return lambda text: V.hashed_counts(T.words(prefixed(text, instruction)), dimensions)


def _fixed(n_chunks: int = 5, overlap: int = 0):
    if any(isinstance(x, bool) or not isinstance(x, int) for x in (n_chunks, overlap)) or n_chunks < 1 or overlap < 0:
        raise ValueError("n_chunks must be a positive and overlap a non-negative whole number")
    return lambda docs: C.explode_chunks(docs, C.fixed_chunks(F.col("sentences"), n_chunks, overlap)).select("doc_id", "position", "chunk_id", "text")


def _breakpoint(**options):
    rule = C.Breakpoints(**options)
    return lambda docs: C.explode_chunks(C.with_breaks(docs, rule), C.breakpoint_chunks(F.col("sentences"), F.col("breaks"), rule.min_chunk_size)).select("doc_id", "position", "chunk_id", "text")


def _clusters(method: str):
    def make(**options):
        C.check_clustering(**options)
        return lambda docs: C.cluster_texts(docs, method=method, **options).select("doc_id", "position", "chunk_id", "text")

    return make


def _exact(metric: str = "cosine"):
    return lambda items, queries, k: N.nearest(items, queries, k, metric=metric)


register("splitter", "sentence", lambda: T.sentences)
register("router", "default", _routed("default"))
register("router", "moc", _routed("moc"))
register("chunker", "fixed", _fixed)
register("chunker", "breakpoint", _breakpoint)
register("chunker", "single_linkage", _clusters("single_linkage"))
register("chunker", "dbscan", _clusters("dbscan"))
register("embedder", "hashed", _hashed)
register("retriever", "exact", _exact)
register("scorer", "lexical", lambda: T.perplexity)
register("pair_scorer", "lexical", lambda: scoring.lexical)
register("offset_splitter", "sentence", lambda: lambda: S.rule_spans)
