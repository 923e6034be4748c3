"""Operator 1: document fingerprints by consistent weighted sampling, in column expressions only.

A text's terms are its five-word shingles, weighted by how often each occurs. Term and weight w draw, from
hashes of the term alone, r and c from Gamma(2, 1) and b from the unit interval; with t = floor(ln w / r + b)
the sample's rank is ln a = ln c - r (t - b + 1), and the pair (term, t) of least rank is the signature: two
texts pick the same pair with a chance of their generalised Jaccard similarity. The occurrences of terms are dealt
to SLOTS bins by hashes of term and number, and each bin takes its own sample with a term's occurrences there as its
weight: draws are no more than words, and a heavy term holds its share of the slots. A bin without terms copies the
bin that ranks first for it among those that have some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import let
from tessera.llm.common import parallelism

SHINGLE = 5
#: A power of two, 64 at most: a sample packs its bin (6 bits), rank (41) and code (16) into one long.
SLOTS = 64


def _draw(h: Column, k: int) -> Column:
    """The k-th uniform of a term."""
    return (F.hash(h, F.lit(k)) + F.lit(2147483648.5)) / F.lit(4294967296.0)


def _gamma(h: Column, k: int) -> Column:
    """Gamma(2, 1): the sum of two exponentials."""
    return -F.log(_draw(h, k) * _draw(h, k + 1))


def _own_bin(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SLOTS - 1))


def _packed(bin_: Column, rank: Column, code: Column) -> Column:
    place = ((rank + F.lit(1024.0)) * F.lit(float(1 << 30))).cast("long")
    return F.shiftleft(bin_, 57).bitwiseOR(F.shiftleft(place, 16)).bitwiseOR(code)


def _sample_one(h: Column) -> Column:
    """A term of weight 1: ln w is 0, and so is t."""
    rank = F.log(_gamma(h, 3)) - _gamma(h, 1) * (F.lit(1.0) - _draw(h, 5))
    return _packed(_own_bin(h), rank, F.shiftright(h, 6).bitwiseAND(F.lit(0xFFFF)))


def _sample(h: Column, bin_: Column, weight: Column) -> Column:
    """Bin, rank and code of a term in a bin, packed so that the least long of a bin is its sample."""
    r, b = _gamma(h, 1), _draw(h, 5)
    t = F.floor(F.log(weight.cast("double")) / r + b)
    return _packed(bin_, F.log(_gamma(h, 3)) - r * (t - b + F.lit(1.0)), F.when(t == 0, F.shiftright(h, 6)).otherwise(F.xxhash64(h, t)).bitwiseAND(F.lit(0xFFFF)))


def _samples(h: Column, weight: Column) -> Column:
    """A term's samples in every bin that has some of its occurrences; the first is dealt by the term's own hash."""
    bins = F.transform(F.sequence(F.lit(1), weight), lambda j: F.when(j == 1, _own_bin(h)).otherwise(_own_bin(F.xxhash64(h, j))))
    # in another bin the term draws anew
    drawn = lambda b: F.when(b == _own_bin(h), h).otherwise(F.xxhash64(h, b))
    dealt = let(bins, lambda all_: F.transform(F.array_distinct(all_), lambda b: let(drawn(b), lambda g: _sample(g, b, F.size(F.filter(all_, lambda x: x == b))))))
    return F.when(weight == 1, F.array(_sample_one(h))).otherwise(dealt)


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, 57)


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``: SLOTS codes of four hex digits, the same for equal texts.

    Texts of fewer than five words use their words as terms; without any word the whole text is one term.
    Null and empty texts have no terms and the fingerprint ''. A column named ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    shingle = lambda w, i: F.xxhash64(w, *[F.get(F.col("_fp_w"), i + k) for k in range(1, SHINGLE)])
    terms = (
        F.when(F.size("_fp_w") >= SHINGLE, F.transform(F.slice("_fp_w", F.lit(1), F.greatest(F.size("_fp_w") - (SHINGLE - 1), F.lit(0))), shingle))
        .when(F.size("_fp_w") > 0, F.transform("_fp_w", lambda w: F.xxhash64(w)))
        .when(text != "", F.array(F.xxhash64(text)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    # weights are the lengths of runs of one hash in order
    runs = lambda h: let(
        F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1))),
        lambda s: F.flatten(F.transform(s, lambda i, j: _samples(F.get(h, i), F.coalesce(F.get(s, j + 1), F.size(h)) - i))),
    )
    packed = F.when(F.size(F.array_distinct("_fp_h")) == F.size("_fp_h"), F.transform("_fp_h", _sample_one)).otherwise(let(F.sort_array("_fp_h"), runs))
    firsts = F.filter("_fp_p", lambda p, i: (i == 0) | (_bin(p) != _bin(F.get(F.col("_fp_p"), i - 1))))
    # an empty bin's own ranking of the others, the code below it
    borrowed = lambda b: F.array_min(
        F.transform("_fp_f", lambda p: F.shiftleft(F.xxhash64(b, _bin(p)).bitwiseAND(F.lit(0x3FFFFFFF)), 16).bitwiseOR(p.bitwiseAND(F.lit(0xFFFF))))
    ).bitwiseAND(F.lit(0xFFFF))
    own = F.transform("_fp_f", lambda p: p.bitwiseAND(F.lit(0xFFFF)))
    bins = F.map_from_arrays(F.transform("_fp_f", _bin), own)
    digits = lambda codes: F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 4, "0")), "")
    return (
        df.withColumn("_fp_w", F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))
        .withColumn("_fp_h", terms)
        .drop("_fp_w")
        .withColumn("_fp_p", F.sort_array(packed))
        .drop("_fp_h")
        .withColumn("_fp_f", firsts)
        .drop("_fp_p")
        .withColumn("_fp_m", F.when(F.size("_fp_f") < SLOTS, bins))
        .withColumn(
            out,
            F.when(F.size("_fp_f") == 0, F.lit(""))
            .when(F.size("_fp_f") == SLOTS, digits(own))
            .otherwise(digits(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long")), lambda b: F.coalesce(F.element_at(F.col("_fp_m"), b), borrowed(b))))),
        )
        .drop("_fp_f", "_fp_m")
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots; 1 for two texts without terms, 0 if one has none."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)), 1).otherwise(0)
    )
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(SLOTS)))


def with_next(docs: DataFrame, id_col: str, text_col: str, per_partition: int = 4) -> tuple[DataFrame, Window]:
    """Rows with ``_next``, the text that follows in order of id (after the last, the first), and the window of that order.

    Ids fall into ranges at their approximate quantiles. A range's first row is also sent to the range before
    it, as a guest at its end, so the next text is always found within a range; ``_guest`` marks those. The
    driver sees one bound and one id per range. Null ids come first; rows of one id are in order of their text. Null texts follow as nulls, empty and very
    long ones as they are. Columns named _key, _range, _guest or _next give way; an empty table gives no rows.
    """
    ranges = per_partition * parallelism(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    bounds = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 20_000)).first()[0] or []
    steps = max(len(bounds), 1).bit_length()
    padded = F.lit(bounds + [2**63 - 1] * ((1 << steps) - 1 - len(bounds))).cast("array<bigint>")
    # how many bounds are not above the key, by halving
    place = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]), F.lit(0), lambda lo, s: F.when(F.get(padded, lo + s - 1) <= key, lo + s).otherwise(lo)
    )
    placed = docs.withColumns({"_key": key, "_range": F.when(key == 2**63 - 1, F.lit(len(bounds))).otherwise(place)})
    heads = {r["_range"]: r["first"] for r in placed.groupBy("_range").agg(F.min("_key").alias("first")).collect()}  # one row a range
    order = sorted(heads)
    first = F.lit([heads.get(i) for i in range(len(bounds) + 1)]).cast("array<bigint>") if order else F.lit([0]).cast("array<bigint>")
    before = F.lit([order[order.index(i) - 1] if i in heads else -1 for i in range(len(bounds) + 1)]).cast("array<int>")
    here = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(before, F.col("_range")).alias("range"), F.lit(True).alias("guest"))
    seats = F.when(F.get(first, F.col("_range")) == F.col("_key"), F.array(here, guest)).otherwise(F.array(here))
    seated = placed.withColumn("_seat", F.explode(seats)).withColumns({"_range": F.col("_seat.range"), "_guest": F.col("_seat.guest")}).drop("_seat")
    window = Window.partitionBy("_range").orderBy("_guest", "_key", text_col)
    return seated.withColumn("_next", F.lead(text_col).over(window)), window


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, window = with_next(docs, "doc_id", "text")
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.coalesce("_next", "text"), F.lit(1), part))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("_next")
    both = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    done = both.withColumn("_next_print", F.lead("fingerprint").over(window)).filter(~F.col("_guest"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("_next_print", "fingerprint")).alias("near_next"),
    )
