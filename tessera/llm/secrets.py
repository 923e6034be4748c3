"""Operator 2: secret scans with an incremental blob ledger, in column expressions only.

Every version of every path is addressed by the SHA-256 of its content. Only pairs of blob and rule version
that the ledger has not seen are scanned; findings are kept by blob and joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


@dataclass(frozen=True)
class Rule:
    """Matches of (prefix)(value), leftmost and not overlapping; those with a short value are dropped."""

    kind: str
    version: int
    prefix: str
    value: str
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The patterns and lengths asked for, in their order. The least length of `access` and `hex` is that of the match.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", 1, "", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "", r"[0-9a-f]{24,}", 24),
)

# control characters that no rule matches: start of a match, end of its prefix, end of the match
_START, _MID, _END = "\x01", "\x02", "\x03"

SCANS, FINDINGS = "blob string, rule string", "blob string, rule string, start long, end long"


def _lengths(text: Column, rule: Rule) -> Column:
    """Per match: code points before it since the last one, in its prefix, and in its value; at the end what follows.

    Marks are put around the matches, and the text is cut at them.
    """
    marked = F.regexp_replace(text, F.lit(f"({rule.prefix})({rule.value})"), F.lit(f"{_START}$1{_MID}$2{_END}"))
    match = lambda x: F.struct(
        F.length(F.substring_index(x, _MID, 1)).cast("long").alias("prefix"),
        F.length(F.substring_index(F.substring_index(x, _END, 1), _MID, -1)).cast("long").alias("value"),
        F.length(F.substring_index(x, _END, -1)).cast("long").alias("after"),
    )
    lead = lambda x: F.struct(F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("value"), (F.length(x).cast("long") + 1).alias("after"))
    return F.transform(F.split(marked, _START), lambda x, i: F.when(i == 0, lead(x)).otherwise(match(x)))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, todo) to (blob, rule, pieces), one row for each rule key in ``todo``."""
    clean = F.translate("text", _START + _MID + _END, "\x04\x04\x04")
    pieces = [F.struct(F.lit(r.key).alias("rule"), F.when(F.array_contains("todo", r.key), _lengths(F.col("clean"), r)).alias("pieces")) for r in rules]
    return blobs.select("blob", "todo", clean.alias("clean")).select("blob", F.inline(F.array(*pieces))).filter(F.col("pieces").isNotNull())


def findings_of(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Matches of sufficient length, by start and end in code points. Only blobs with matches are shuffled."""
    hits = scanned.filter(F.size("pieces") > 1).select("blob", "rule", F.posexplode("pieces").alias("at", "piece"))
    p = F.col("piece")
    run = Window.partitionBy("blob", "rule").orderBy("at")
    ends = hits.withColumn("upto", F.sum(p["prefix"] + p["value"] + p["after"]).over(run))
    end = F.col("upto") - p["after"]
    least = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.least))])
    return ends.filter((F.col("at") > 0) & (p["value"] >= least[F.col("rule")])).select("blob", "rule", (end - p["prefix"] - p["value"]).alias("start"), end.alias("end"))


def scan_versions(versions: DataFrame, ledger: str, *, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``versions`` without the text, plus blob and findings: array of (start, kind order, kind, end), sorted.

    ``ledger`` is a folder with the append-only tables scans and findings. Each row of ``versions`` is a version
    of some path; null text is empty. Equal versions are scanned once, ever, per rule version; a rule with a new
    version is scanned again on all blobs. Findings are appended before the scans that vouch for them, so a run
    that breaks off between the two is merely repeated; repeats are read once. Columns of ``versions`` named
    blob or findings are replaced. An empty table gives an empty result.
    """
    spark = versions.sparkSession
    tmp = Scratch(spark, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in versions.columns if c not in (text_col, "blob", "findings")]
    keys = F.array(*[F.lit(r.key) for r in rules])
    for name, schema in (("scans", SCANS), ("findings", FINDINGS)):
        spark.sql("SELECT 1").limit(0).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")]).write.mode("append").parquet(f"{ledger}/{name}")
    seen = spark.read.schema(SCANS).parquet(f"{ledger}/scans").groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    blobs = versions.select(text.alias("text")).select(F.sha2("text", 256).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    scanned = tmp.table(scan(todo, rules), "scanned")
    findings_of(scanned, rules).write.mode("append").parquet(f"{ledger}/findings")
    scanned.select("blob", "rule").write.mode("append").parquet(f"{ledger}/scans")
    kind = F.element_at(F.split("rule", "@"), 1)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])[F.col("rule")]
    found = (
        spark.read.schema(FINDINGS)
        .parquet(f"{ledger}/findings")
        .filter(F.col("rule").isin([r.key for r in rules]))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", place.alias("place"), kind.alias("kind"), "end"))).alias("findings"))
    )
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    found = tmp.table(found, "found")  # with no aggregation beside it, Spark splits the join where one blob has very many versions
    return versions.select(*kept, F.sha2(text, 256).alias("blob")).join(found, "blob", "left").withColumn("findings", F.coalesce("findings", none))


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_versions(docs, Scratch(spark, "ledger").path("blobs"))
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = spans_text(F.col("findings"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
