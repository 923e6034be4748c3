"""The queries of this subpackage: thirteen operators over their whole tables."""

from __future__ import annotations

from tessera.llm import decontam, fertility, fingerprint, mixing, negatives, ngramjoin, oracles, packing, quality, ranked, secrets, substrings, tokencount, warc


def queries() -> dict:
    return {
        "op1_fingerprint": fingerprint.op1_query,
        "op2_secrets": secrets.op2_query,
        "op3_token_counts": tokencount.op3_query,
        "op4_warc": warc.op4_query,
        "op5_pack": packing.op5_query,
        "op6_decontaminate": decontam.op6_query,
        "op7_ngram_join": ngramjoin.op7_query,
        "op8_passages": substrings.op8_query,
        "op9_quality": quality.op9_query,
        "op10_mix": mixing.op10_query,
        "op11_ranked_search": ranked.op11_query,
        "op12_fertility": fertility.op12_query,
        "op13_hard_negatives": negatives.op13_query,
    }


def oracle_sql() -> dict[str, str]:
    """The others draw on hashes, tokenizers, fitted models or the order of input, which SQL has not; tests hold them to brute force."""
    return dict(oracles.SQL)
