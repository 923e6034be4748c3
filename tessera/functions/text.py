"""Text rules as column expressions: sentences, tokens, normal forms, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode word class (Java's \w is ASCII only), and where sentences end.
WORD = r"[\p{L}\p{N}_]+"
ENDS = r"(?<=[.!?])\s+|[\r\n]+"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Cut after . ! ? with white space behind, and at line ends; stripped, blanks dropped. Null has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ENDS), strip), lambda s: s != "")


def pieces(text: Column) -> Column:
    """Unstripped sentences, blank ones too, in order: array of (piece, size with the gap behind it)."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "\x03\x03"), f"({ENDS})", "\x01$1\x02")
    one = lambda p: F.struct(F.substring_index(p, "\x01", 1).alias("piece"), F.length(F.translate(p, "\x01", "")).alias("size"))
    return F.transform(F.split(marked, "\x02"), one)


def words(text: Column) -> Column:
    """Lower-case Unicode word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def qa_tokens(text: Column) -> Column:
    """Lower case, articles and signs dropped, cut at blanks."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", " "), r"\s+", " ")), " "), lambda t: t != "")


def normal_sentence(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), r"\s+", " "))


def join_sentences(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda s: s != ""), " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _slugged(x: Column, bad: str, good: str, ends: str, empty: str) -> Column:
    """Runs of ``bad`` as ``good``, no ``ends`` at the ends, ``empty`` for what is left without anything."""
    out = F.regexp_replace(F.regexp_replace(x, bad, good), f"^{ends}+|{ends}+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(empty))


def key_slug(text: Column) -> Column:
    """For file names of documents: ASCII letters, digits, dot, dash and underscore stay."""
    return _slugged(strip(text), "[^A-Za-z0-9._-]+", "_", "[._]", "item")


def name_slug(text: Column) -> Column:
    """For names of runs: letters and digits of any script stay, every other sign becomes a dash of its own."""
    return _slugged(strip(text), r"[^\p{L}\p{N}._-]", "-", "[._-]", "item")


def table_slug(text: Column) -> Column:
    """For names of tables: lower case, words joined by single underscores."""
    return _slugged(F.lower(strip(text)), "[/ _-]+", "_", "_", "unknown")


def cache_slug(text: Column) -> Column:
    """For names of cached vectors: as ``key_slug``, in lower case, dots kept at the ends."""
    return F.lower(_slugged(text, "[^a-zA-Z0-9._-]+", "_", "_", "default"))


def utc_now() -> Column:
    """The query's start in UTC, in ISO form."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_title(text: Column, limit: int = 120) -> Column:
    return F.substring(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, limit)


def span_text(text: Column, start: Column, end: Column) -> Column:
    """Characters start..end-1 where these lie within the text, else null."""
    return F.when((start >= 0) & (start < end) & (end <= F.length(text)), F.substring(text, start + 1, end - start))


def content_id(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, size)


def entropy(tokens: Column) -> Column:
    """Natural-log entropy of the token counts of an array column; 0 without tokens.

    Pass the name of a materialised column: the array is sorted once and its runs are counted in place.
    """
    ordered = F.sort_array(tokens)
    n = F.size(tokens)
    folded = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total")),
        lambda a, t: F.when(a["last"] == t, F.struct(t.alias("last"), (a["run"] + 1.0).alias("run"), a["total"].alias("total"))).otherwise(
            F.struct(t.alias("last"), F.lit(1.0).alias("run"), (a["total"] + F.when(a["run"] > 1, a["run"] * F.log(a["run"])).otherwise(0.0)).alias("total"))
        ),
        lambda a: a["total"] + F.when(a["run"] > 1, a["run"] * F.log(a["run"])).otherwise(0.0),
    )
    return F.when(n > 0, F.log(n.cast("double")) - folded / n).otherwise(F.lit(0.0))


def perplexity(tokens: Column) -> Column:
    return F.exp(entropy(tokens))
