"""Registered queries of the retrieval-analytics operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import answers as A
from tessera.operators import chunk as C
from tessera.operators import intrinsic as I
from tessera.operators import reporting as R
from tessera.operators import retrieval as N
from tessera.operators import split as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

KS = (1, 3, 5, 10)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def _r(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# --- text -----------------------------------------------------------------------------------

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SENTS = r"list_filter(list_transform(string_split_regex(regexp_replace({t}, '([.!?])\s+', '\1'||chr(10), 'g'), '[\r\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
SENTS = "SELECT doc_id, " + _SENTS.format(t="coalesce(text,'')") + " AS s FROM documents"
_NORM = r"regexp_replace(regexp_replace(lower({x}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
# the articles are words of their own by Unicode's rule, which RE2's \\b does not know
_QA = (
    r"list_filter(string_split(trim(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), "
    r"lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
)


@query("sentence_split", f"SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS sentence_idx, s[u.i] AS sentence FROM ({SENTS}), unnest(range(1, len(s) + 1)) AS u(i)")
def _(spark, d):
    return S.split_sentences(_docs(spark, d))


@query(
    "sentence_offsets",
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])(\s+)', '\1'||chr(1)||'\2'||chr(2), 'g'), '([^\x01\s]|^)([\r\n]+)', '\1'||chr(1)||'\2'||chr(2), 'g'), chr(2)) AS parts FROM documents),
 u AS (SELECT doc_id, i, string_split(parts[i], chr(1))[1] AS piece, length(replace(parts[i], chr(1), '')) AS size FROM p, unnest(range(1, len(parts) + 1)) AS t(i)),
 w AS (SELECT doc_id, i, piece, sum(size) OVER (PARTITION BY doc_id ORDER BY i) - size AS char_start, regexp_replace(piece, '^\s+|\s+$', '', 'g') <> '' AS full_ FROM u)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sentence_idx, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(piece) AS BIGINT) AS char_end FROM w WHERE full_""",
)
def _(spark, d):
    return S.sentence_offsets(_docs(spark, d))


@query(
    "unit_ids",
    f"WITH n AS (SELECT doc_id, len(s) AS n FROM ({SENTS})), r AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS start FROM n) SELECT CAST(start + i AS BIGINT) AS unit_id, doc_id, CAST(i AS INTEGER) AS sentence_idx FROM r, unnest(range(0, n)) AS u(i)",
)
def _(spark, d):
    return S.unit_ids(_docs(spark, d))


@query("doc_filter_blank", f"SELECT doc_id, length(text) AS n FROM documents WHERE {STRIP.format(x='coalesce(text, chr(32))')} <> ''")
def _(spark, d):
    return S.drop_blank(_docs(spark, d)).select("doc_id", F.length("text").cast("long").alias("n"))


@query("doc_truncate", "SELECT doc_id, substr(text, 1, 1000) AS text FROM documents")
def _(spark, d):
    return S.truncate_text(_docs(spark, d), 1000)


@query("safe_title", rf"SELECT page_id, substr({STRIP.format(x=chr(114) + 'egexp_replace(html, ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, 1, 120) AS title FROM pages")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", T.safe_title(F.col("html")).alias("title"))


@query("slugify", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def _(spark, d):
    return _t(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("sha1_doc_ids", "SELECT substr(sha1(text), 1, 16) AS id, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, d):
    return _docs(spark, d).groupBy(T.content_id(F.col("text")).alias("id")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


@query(
    "last_wins_dedupe",
    "WITH u AS (SELECT doc_id, 0 AS ord, 0 AS quality FROM documents UNION ALL SELECT doc_id, 1, quality FROM labels) SELECT doc_id, min(ord) AS ord, arg_max(quality, ord) AS quality FROM u GROUP BY doc_id",
)
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.lit(0).alias("ord"), F.lit(0).alias("quality"))
    labels = _t(spark, d, "labels").select("doc_id", F.lit(1).alias("ord"), F.col("quality").cast("int").alias("quality"))
    return S.last_wins(docs.union(labels), ["doc_id"], "ord")


@query("tokens_count", f"SELECT doc_id, CAST(len({_WORDS.format(x='text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_WORDS.format(x='text')})) AS INTEGER) AS n_distinct FROM documents")
def _(spark, d):
    return _docs(spark, d).withColumn("w", T.words(F.col("text"))).select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("qa_tokens", f"SELECT doc_id, array_to_string({_QA.format(x='text')}, ' ') AS tokens FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.qa_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "lexical_perplexity",
    f"WITH c AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS.format(x='text')}) AS w FROM documents) GROUP BY 1, 2), e AS (SELECT doc_id, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c GROUP BY 1) SELECT d.doc_id, round(exp(coalesce(h, 0)), 6) AS ppl FROM documents d LEFT JOIN e USING (doc_id)",
)
def _(spark, d):
    return _docs(spark, d).withColumn("w", T.words(F.col("text"))).select("doc_id", F.round(T.perplexity(F.col("w")), 6).alias("ppl"))


# --- chunks ---------------------------------------------------------------------------------


def _chunks_sql(k: int, overlap: int) -> str:
    return (
        f"SELECT doc_id, CAST(p AS INTEGER) AS position, CAST(greatest(b0 - {overlap}, 0) AS INTEGER) AS start_sentence_idx, CAST(least(b1 + {overlap}, n) - 1 AS INTEGER) AS end_sentence_idx, s[greatest(b0 - {overlap}, 0) + 1 : least(b1 + {overlap}, n)] AS sents FROM "
        f"(SELECT doc_id, s, n, p, p * (n // m) + least(p, n % m) AS b0, (p + 1) * (n // m) + least(p + 1, n % m) AS b1 FROM (SELECT doc_id, s, len(s) AS n, least({k}, len(s)) AS m FROM ({SENTS}) WHERE len(s) > 0), unnest(range(0, m)) AS u(p))"
    )


def _fixed(spark, d, k: int, overlap: int) -> DataFrame:
    docs = S.with_sentences(_docs(spark, d))
    return C.explode_chunks(docs, C.fixed_chunks(F.col("sentences"), k, overlap))


for _k, _o in ((3, 0), (5, 0), (8, 0), (5, 1), (10, 1)):
    query(
        f"fixed_chunks_{_k}" + (f"_overlap_{_o}" if _o else ""),
        f"SELECT doc_id, position, doc_id || '::chunk_' || position AS chunk_id, start_sentence_idx, end_sentence_idx, array_to_string(sents, ' ') AS text FROM ({_chunks_sql(_k, _o)})",
    )(lambda spark, d, k=_k, o=_o: _fixed(spark, d, k, o).select("doc_id", "position", "chunk_id", "start_sentence_idx", "end_sentence_idx", "text"))


def _scored(spark, d) -> DataFrame:
    docs = S.with_sentences(_docs(spark, d)).withColumn("chunks", C.fixed_chunks(F.col("sentences"), 5))
    return docs.select("doc_id", "chunks").withColumn("sets", I.token_sets(F.col("chunks")))


CHUNKS = f"SELECT doc_id, position, array_to_string(sents, ' ') AS text FROM ({_chunks_sql(5, 0)})"
SETS = f"SELECT doc_id, position, text, list_distinct({_WORDS.format(x='text')}) AS w FROM ({CHUNKS})"


@query(
    "chunk_doc_stats",
    f"WITH c AS ({CHUNKS}) SELECT d.doc_id, CAST(count(position) AS INTEGER) AS num_chunks, round(coalesce(avg(length(c.text)), 0), 6) AS avg_chars, round(coalesce(avg(len({_WORDS.format(x='c.text')})), 0), 6) AS avg_words FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1",
)
def _(spark, d):
    rows = _scored(spark, d)
    return rows.select("doc_id", *[(c if n == "num_chunks" else F.round(c, 6)).alias(n) for n, c in I.chunk_stats(F.col("chunks")).items()])


BOUNDARY = f"""WITH c AS ({SETS}), p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY position) AS l FROM c),
 b AS (SELECT doc_id, avg(CASE WHEN len(w) = 0 OR len(l) = 0 THEN 1 ELSE 1 - 0.5 * len(list_intersect(w, l)) / len(w) END) AS v FROM p WHERE l IS NOT NULL GROUP BY 1)
 SELECT d.doc_id, coalesce(v, 1) AS boundary_clarity FROM documents d LEFT JOIN b USING (doc_id)"""


@query("boundary_clarity", f"SELECT doc_id, round(boundary_clarity, 6) AS boundary_clarity FROM ({BOUNDARY})")
def _(spark, d):
    return _scored(spark, d).select("doc_id", F.round(I.boundary_clarity(F.col("sets")), 6).alias("boundary_clarity"))


def _sticky_sql(threshold: float, delta: int) -> str:
    return f"""WITH c AS ({SETS}), e AS (SELECT a.doc_id, a.position AS i, b.position AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.position - a.position > {delta}
 WHERE CASE WHEN len(a.w) = 0 THEN 0 ELSE 0.5 * len(list_intersect(a.w, b.w)) / len(a.w) END >= {threshold}),
 g AS (SELECT doc_id, v, count(*) AS deg FROM (SELECT doc_id, i AS v FROM e UNION ALL SELECT doc_id, j FROM e) GROUP BY 1, 2),
 h AS (SELECT doc_id, log2(sum(deg)) - sum(deg * log2(deg)) / sum(deg) AS v FROM g GROUP BY 1)
 SELECT d.doc_id, round(coalesce(v, 0), 6) AS stickiness FROM documents d LEFT JOIN h USING (doc_id)"""


for _n, _thr, _dl in (("stickiness_complete", 0.0, 0), ("stickiness_incomplete", 0.2, 1)):
    query(_n, _sticky_sql(_thr, _dl))(lambda spark, d, t=_thr, x=_dl: _scored(spark, d).select("doc_id", F.round(I.stickiness(F.col("sets"), t, x), 6).alias("stickiness")))


@query(
    "intrinsic_global_stats",
    f"WITH m AS (SELECT 'boundary_clarity' AS metric, boundary_clarity AS v FROM ({BOUNDARY}) UNION ALL SELECT 'num_chunks', count(position) FROM documents d LEFT JOIN ({CHUNKS}) c USING (doc_id) GROUP BY d.doc_id) SELECT metric, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(var_pop(v), 6) AS variance FROM m GROUP BY 1",
)
def _(spark, d):
    rows = _scored(spark, d).select(I.boundary_clarity(F.col("sets")).alias("boundary_clarity"), F.size("chunks").alias("num_chunks"))
    return I.global_stats(rows, ["boundary_clarity", "num_chunks"]).select("metric", *_r("mean", "min", "max", "variance"))


# --- vectors and breakpoints -------------------------------------------------------------------

_BUCKETS = "list_transform({w}, lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % 32)::INTEGER)"
_COUNTS = "list_transform(range(0, 32), lambda b: len(list_filter({x}, lambda y: y = b))::DOUBLE)"


@query(
    "hash_embed",
    f"WITH b AS (SELECT doc_id, {_BUCKETS.format(w=_WORDS.format(x='text'))} AS x FROM documents), v AS (SELECT doc_id, {_COUNTS.format(x='x')} AS v FROM b) SELECT doc_id, CAST(i AS INTEGER) AS bucket, round(v[i + 1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS value FROM v, unnest(range(0, 32)) AS u(i)",
)
def _(spark, d):
    rows = _docs(spark, d).withColumn("w", T.words(F.col("text"))).select("doc_id", V.hashed_counts(F.col("w")).alias("v")).withColumn("n", V.norm(F.col("v")))
    return C.explode_rows(rows, "v", "bucket", "x").select("doc_id", "bucket", F.round(F.col("x") / F.greatest("n", F.lit(1e-12)), 6).alias("value"))


def _embedded(spark, d) -> DataFrame:
    """Documents with their sentences and a vector for each."""
    rows = S.with_sentences(_docs(spark, d)).select("doc_id", "sentences").withColumn("tokens", F.transform("sentences", T.words))
    return rows.withColumn("vectors", F.transform("tokens", lambda t: V.hashed_counts(t))).drop("tokens")


SVECS = f"""sn AS (SELECT doc_id, i, s[i] AS one FROM ({SENTS}), unnest(range(1, len(s) + 1)) AS u(i)), x AS (SELECT doc_id, i, {_BUCKETS.format(w=_WORDS.format(x='one'))} AS bk FROM sn),
 v AS (SELECT doc_id, i, {_COUNTS.format(x='bk')} AS v FROM x), n AS (SELECT doc_id, i, v, lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM v),
 dist AS (SELECT doc_id, i - 1 AS i, 1 - CASE WHEN list_dot_product(v, v) * list_dot_product(nx, nx) > 0 THEN list_dot_product(v, nx) / sqrt(list_dot_product(v, v) * list_dot_product(nx, nx)) ELSE 0 END AS d FROM n WHERE nx IS NOT NULL),
 grad AS (SELECT doc_id, i, d, CASE WHEN p IS NULL AND q IS NULL THEN 0 WHEN p IS NULL THEN q - d WHEN q IS NULL THEN d - p ELSE (q - p) / 2 END AS g FROM (SELECT doc_id, i, d, lag(d) OVER w AS p, lead(d) OVER w AS q FROM dist WINDOW w AS (PARTITION BY doc_id ORDER BY i)))"""


@query("consecutive_distance", f"WITH {SVECS} SELECT doc_id, CAST(i AS INTEGER) AS sentence_idx, round(d, 6) AS distance FROM dist")
def _(spark, d):
    rows = _embedded(spark, d).select("doc_id", C.consecutive_distances(F.col("vectors")).alias("d"))
    return C.explode_rows(rows, "d", "sentence_idx", "distance").select("doc_id", "sentence_idx", *_r("distance"))


@query("gradient_scores", f"WITH {SVECS} SELECT doc_id, CAST(i AS INTEGER) AS sentence_idx, round(g, 6) AS gradient FROM grad")
def _(spark, d):
    rows = _embedded(spark, d).select("doc_id", C.consecutive_distances(F.col("vectors")).alias("d")).select("doc_id", V.gradient(F.col("d")).alias("g"))
    return C.explode_rows(rows, "g", "sentence_idx", "gradient").select("doc_id", "sentence_idx", *_r("gradient"))


_THRESHOLDS = {
    "percentile": ("percentile", 70.0, "d", "quantile_cont(d, 0.7)"),
    "stddev": ("standard_deviation", 1.0, "d", "avg(d) + stddev_pop(d)"),
    "iqr": ("interquartile", 0.5, "d", "avg(d) + 0.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25))"),
    "gradient": ("gradient", 50.0, "g", "quantile_cont(g, 0.5)"),
    "distance": ("distance", 0.4, "d", "0.4"),
    "gradient_abs": ("gradient_absolute", 0.1, "g", "0.1"),
}

for _n, (_kind, _amount, _c, _thr) in _THRESHOLDS.items():
    # scores often equal their threshold: V.quantile and V.deviation round as the SQL does
    query(
        f"breakpoint_{_n}",
        f"WITH {SVECS}, t AS (SELECT doc_id, {_thr} AS t, count(*) AS n FROM grad GROUP BY 1) SELECT doc_id, CAST(i AS INTEGER) AS break_after FROM grad JOIN t USING (doc_id) WHERE {_c} > t" + (" AND n > 1" if _kind.startswith("gradient") else ""),
    )(lambda spark, d, k=_kind, a=_amount: C.explode_rows(C.with_breaks(_embedded(spark, d), C.Breakpoints(k, a)), "breaks", "_at", "break_after").select("doc_id", "break_after"))


_SEGMENTS = f"""{SVECS}, t AS (SELECT doc_id, quantile_cont(d, 0.3) AS t FROM dist GROUP BY 1), sz AS (SELECT doc_id, s, len(s) AS n FROM ({SENTS}) WHERE len(s) > 0),
 seg AS (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY e) AS k FROM (SELECT doc_id, i + 1 AS e FROM dist JOIN t USING (doc_id) WHERE d > t UNION SELECT doc_id, n FROM sz))"""


@query(
    "breakpoint_min_size",
    f"""WITH RECURSIVE {_SEGMENTS}, r AS (SELECT doc_id, n, s, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS own, false AS made, CAST(0 AS BIGINT) AS e FROM sz
 UNION ALL SELECT r.doc_id, n, s, g.k, CASE WHEN g.e = n OR len(array_to_string(s[r.start + 1 : g.e], ' ')) >= 400 THEN g.e ELSE r.start END, r.start, g.e = n OR len(array_to_string(s[r.start + 1 : g.e], ' ')) >= 400, g.e FROM r JOIN seg g ON g.doc_id = r.doc_id AND g.k = r.k + 1),
 c AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS position, own, e, s FROM r WHERE made)
 SELECT doc_id, position, doc_id || '::chunk_' || position AS chunk_id, CAST(own AS INTEGER) AS start_sentence_idx, CAST(e - 1 AS INTEGER) AS end_sentence_idx, array_to_string(s[own + 1 : e], ' ') AS text FROM c""",
)
def _(spark, d):
    rows = C.with_breaks(_embedded(spark, d), C.Breakpoints("percentile", 30.0))
    return C.explode_chunks(rows, C.breakpoint_chunks(F.col("sentences"), F.col("breaks"), 400)).select("doc_id", "position", "chunk_id", "start_sentence_idx", "end_sentence_idx", "text")


@query(
    "breakpoint_by_count",
    f"""WITH {SVECS}, l AS (SELECT doc_id, list_sort(list(d)) AS ds, count(*) AS n FROM dist GROUP BY 1), w AS (SELECT doc_id, ds, n, (n - 1) * CASE WHEN n > 1 THEN 1.0::DOUBLE - (least(5, n) - 1)::DOUBLE / (n - 1) ELSE 1.0::DOUBLE END AS pos FROM l),
 t AS (SELECT doc_id, ds[floor(pos)::INTEGER + 1] + (ds[ceil(pos)::INTEGER + 1] - ds[floor(pos)::INTEGER + 1]) * (pos - floor(pos)) AS t FROM w),
 e AS (SELECT doc_id, i + 1 AS e FROM dist JOIN t USING (doc_id) WHERE d > t UNION SELECT doc_id, len(s) FROM ({SENTS}) WHERE len(s) > 0)
 SELECT doc_id, CAST(row_number() OVER o - 1 AS INTEGER) AS position, CAST(coalesce(lag(e) OVER o, 0) AS INTEGER) AS start_sentence_idx, CAST(e - 1 AS INTEGER) AS end_sentence_idx FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY e)""",
)
def _(spark, d):
    rows = C.with_breaks(_embedded(spark, d), C.Breakpoints("percentile", number_of_chunks=5))
    return C.explode_chunks(rows, C.breakpoint_chunks(F.col("sentences"), F.col("breaks"))).select("doc_id", "position", "start_sentence_idx", "end_sentence_idx")


# the least admissible pair of clusters of every document merges in each round; own and size are the cluster of each
# sentence, called by its first, and how many it has
_LINKAGE = f"""WITH RECURSIVE {SVECS}, u AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, v, list_dot_product(v, v) AS z, count(*) OVER (PARTITION BY doc_id) AS n FROM v),
 e AS MATERIALIZED (SELECT doc_id, i, j, d FROM (SELECT a.doc_id, a.i, b.i AS j, 0.5 * abs(a.i - b.i) / a.n + 0.5 * (1 - greatest(0, least(1, CASE WHEN a.z * b.z > 0 THEN list_dot_product(a.v, b.v) / sqrt(a.z * b.z) ELSE 0 END))) AS d FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.i < b.i) WHERE d <= 0.5),
 s(doc_id, step, most, own, size, last) AS (SELECT doc_id, 0, CAST(ceil(max(n) / 5.0) AS INTEGER), list(i ORDER BY i), list(1 ORDER BY i), list(NULL::DOUBLE ORDER BY i) FROM u GROUP BY doc_id UNION ALL
 SELECT doc_id, step + 1, most, list_transform(own, lambda x: CASE WHEN x = m.b THEN m.a ELSE x END), list_transform(own, lambda x, k: CASE WHEN x = m.a OR x = m.b THEN size[m.a + 1] + size[m.b + 1] ELSE size[k] END), list_transform(own, lambda x, k: CASE WHEN x = m.a OR x = m.b THEN m.d ELSE last[k] END)
 FROM (SELECT s.doc_id, any_value(step) AS step, any_value(most) AS most, any_value(own) AS own, any_value(size) AS size, any_value(last) AS last, min(struct_pack(d := e.d, a := least(own[e.i + 1], own[e.j + 1]), b := greatest(own[e.i + 1], own[e.j + 1]))) AS m
 FROM s JOIN e ON e.doc_id = s.doc_id WHERE own[e.i + 1] <> own[e.j + 1] AND size[e.i + 1] + size[e.j + 1] <= most GROUP BY s.doc_id)),
 f AS (SELECT doc_id, arg_max(own, step) AS own, arg_max(last, step) AS last FROM s GROUP BY doc_id),
 g AS (SELECT doc_id, own[k] AS first, min(last[k]) AS d, string_agg(k - 1, ',' ORDER BY k) AS members, max(k) - min(k) + 1 = count(*) AS whole, any_value(len(own)) AS n FROM f, unnest(range(1, len(own) + 1)) AS t(k) GROUP BY 1, 2)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS position, members AS sentence_indices, round(d, 6) AS cluster_distance, CASE WHEN n = 1 THEN 'singleton' ELSE 'single_linkage' END AS cluster_origin, whole AS is_contiguous FROM g"""


@query("single_linkage", _LINKAGE)
def _(spark, d):
    made = C.cluster_chunks(_embedded(spark, d), method="single_linkage", weight=0.5, number_of_chunks=5)
    return made.withColumns({"sentence_indices": F.array_join(F.col("sentence_indices").cast("array<string>"), ","), "cluster_distance": F.round("cluster_distance", 6)})


@query("dbscan")
def _(spark, d):
    return C.cluster_chunks(_embedded(spark, d), method="dbscan", weight=0.5, radius=0.3, least=2)


#: No ratio of small whole numbers meets it, so rounding decides nothing.
RADIUS = 0.31234567


def _members_sql(method: str, least: int) -> str:
    """Clusters of points with ``least`` neighbours within RADIUS and what lies beside them; single linkage without a cap is the case of one."""
    return (
        f"""WITH RECURSIVE {SVECS}, u AS (SELECT doc_id, i - 1 AS i, v, sqrt(list_dot_product(v, v)) AS z, count(*) OVER (PARTITION BY doc_id) AS n FROM v),
 near AS (SELECT a.doc_id, a.i, b.i AS j FROM u a JOIN u b ON a.doc_id = b.doc_id WHERE a.i = b.i OR
  0.5 * abs(a.i - b.i)::DOUBLE / a.n + 0.5 * (1 - greatest(0, least(1, CASE WHEN a.z * b.z > 0 THEN list_dot_product(a.v, b.v) / (a.z * b.z) ELSE 0 END))) <= {RADIUS}),
 core AS (SELECT doc_id, i FROM near GROUP BY 1, 2 HAVING count(*) >= {least}),
 ties AS (SELECT near.doc_id, near.i, near.j FROM near JOIN core a ON a.doc_id = near.doc_id AND a.i = near.i JOIN core b ON b.doc_id = near.doc_id AND b.i = near.j),
 least_(doc_id, i, m) USING KEY (doc_id, i) AS (SELECT doc_id, i, i AS m FROM core UNION
  SELECT t.doc_id, t.j, min(c.m) FROM least_ c JOIN ties t ON c.doc_id = t.doc_id AND c.i = t.i JOIN recurring.least_ r ON r.doc_id = t.doc_id AND r.i = t.j WHERE c.m < r.m GROUP BY 1, 2),
 own AS (SELECT near.doc_id, near.i, min(m) AS m FROM near LEFT JOIN least_ ON least_.doc_id = near.doc_id AND least_.i = near.j GROUP BY 1, 2),
 grp AS (SELECT doc_id, i, min(i) OVER w AS low, max(i) OVER w AS high, count(*) OVER w AS size, count(*) OVER (PARTITION BY doc_id) AS n FROM own WINDOW w AS (PARTITION BY doc_id, m, CASE WHEN m IS NULL THEN i END))
 SELECT doc_id, CAST(i AS INTEGER) AS sentence_idx, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY low) - 1 AS INTEGER) AS position, CASE WHEN n = 1 THEN 'singleton' ELSE '{method}' END AS cluster_origin, high - low + 1 = size AS is_contiguous FROM grp"""
    )


def _members(clusters: DataFrame) -> DataFrame:
    return clusters.select("doc_id", F.explode("sentence_indices").alias("sentence_idx"), "position", "cluster_origin", "is_contiguous")


@query("dbscan_members", _members_sql("dbscan", 3))
def _(spark, d):
    return _members(C.cluster_chunks(_embedded(spark, d), method="dbscan", weight=0.5, radius=RADIUS, least=3))


@query("single_linkage_members", _members_sql("single_linkage", 1))
def _(spark, d):
    return _members(C.cluster_chunks(_embedded(spark, d), method="single_linkage", weight=0.5, number_of_chunks=1, stop=RADIUS))


@query(
    "joint_distance",
    f"""WITH c AS ({CHUNKS}), b AS (SELECT doc_id, position, {_BUCKETS.format(w=_WORDS.format(x='text'))} AS x FROM c), v AS (SELECT doc_id, position AS p, {_COUNTS.format(x='x')} AS v, count(*) OVER (PARTITION BY doc_id) AS n FROM b)
 SELECT a.doc_id, a.p AS i, b.p AS j, round(0.25 * ((b.p - a.p)::DOUBLE / a.n) + 0.75 * (1 - greatest(0, least(1, CASE WHEN list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v) > 0 THEN list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) ELSE 0 END))), 6) AS distance
 FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.p < b.p""",
)
def _(spark, d):
    docs = S.with_sentences(_docs(spark, d)).withColumn("chunks", C.fixed_chunks(F.col("sentences"), 5)).select("doc_id", "chunks")
    rows = docs.withColumn("tokens", F.transform("chunks", lambda c: T.words(c["text"]))).withColumn("v", F.transform("tokens", lambda t: V.hashed_counts(t))).select("doc_id", "v")
    pairs = C.explode_rows(C.explode_rows(rows.withColumn("_v", F.col("v")), "_v", "i", "a"), "v", "j", "b", keep=True).filter("i < j")
    return pairs.select("doc_id", "i", "j", F.round(V.joint_distance(F.col("i"), F.col("j"), F.size("v"), V.cosine(F.col("a"), F.col("b")), 0.25), 6).alias("distance"))


# --- retrieval ------------------------------------------------------------------------------


#: The queries of a search, and for metrics over the whole table all of its vectors.
ASKED, ALL = "{}vec_id % 100 = 0", "true"


def _vectors(spark, d, asked: str = ASKED) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, d, "embeddings")
    queries = rows.filter(asked.format("")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), queries


_V = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_COS = "round(list_dot_product(q.v, e.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(e.v, e.v)), 1e-12)), 9)"
_L2 = "round(-(list_dot_product(q.v, q.v) + list_dot_product(e.v, e.v) - 2 * list_dot_product(q.v, e.v)), 9)"


def _knn_sql(score: str, self: bool = True, k: int = 10, asked: str = ASKED) -> str:
    other = "" if self else " AND q.vec_id <> e.vec_id"
    return f"SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {score} AS score FROM ({_V}) q, ({_V}) e WHERE {asked.format('q.')}{other})) WHERE rank <= {k}"


for _n, _metric, _sql in (("knn_cosine", "cosine", _COS), ("knn_l2", "l2", _L2)):
    query(_n, f"SELECT query_id, rank, item_id, round(score, 6) AS score FROM ({_knn_sql(_sql)})")(lambda spark, d, m=_metric: N.nearest(*_vectors(spark, d), 10, metric=m).select("query_id", "rank", "item_id", *_r("score")))


@query(
    "doc_rollup_max",
    f"WITH h AS (SELECT query_id, item_id // 4 AS doc_id, max(score) AS score, min(rank) AS first_rank FROM ({_knn_sql(_COS)}) GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 6) AS score, first_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank, doc_id) AS INTEGER) AS rank FROM h",
)
def _(spark, d):
    hits = N.nearest(*_vectors(spark, d), 10).withColumn("doc_id", F.floor(F.col("item_id") / 4))
    return N.roll_up(hits).select("query_id", "doc_id", *_r("score"), "first_rank", "rank")


def _judged(spark, d, asked: str = ASKED) -> DataFrame:
    items, queries = _vectors(spark, d, asked)
    labels = _t(spark, d, "embeddings").select("vec_id", "label")
    hits = N.nearest(items, queries, max(KS), keep_self=False)
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    marked = hits.join(labels.withColumnRenamed("vec_id", "item_id"), "item_id").join(own, "query_id")
    # all relevant items of a query: the others of its label, counted rather than listed
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("g"))
    gold = queries.select("query_id").join(own, "query_id").join(sizes.withColumnRenamed("label", "own"), "own").select("query_id", "g")
    return _metrics(marked.filter("label = own").select("query_id", "rank"), gold)


def _metrics(hits: DataFrame, gold: DataFrame) -> DataFrame:
    found = hits.groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
    return N.metrics_from_ranks(gold.join(found, "query_id", "left"), KS)


def _metric_sql(asked: str = ASKED) -> str:
    return f"""WITH h AS ({_knn_sql(_COS, self=False, asked=asked)}), l AS (SELECT vec_id, label FROM embeddings), m AS (SELECT h.query_id, h.rank FROM h JOIN l a ON a.vec_id = h.item_id JOIN l b ON b.vec_id = h.query_id WHERE a.label = b.label),
 g AS (SELECT q.vec_id AS query_id, count(*) - 1 AS g FROM l q JOIN l o ON o.label = q.label WHERE {asked.format('q.')} GROUP BY 1), k AS (SELECT unnest([1, 3, 5, 10]) AS k),
 s AS (SELECT g.query_id, k.k, g.g, count(m.rank) AS tp, coalesce(sum(1 / log2(m.rank + 1)), 0) AS dcg FROM g CROSS JOIN k LEFT JOIN m ON m.query_id = g.query_id AND m.rank <= k.k GROUP BY 1, 2, 3),
 r AS (SELECT query_id, k, tp / k AS p, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS r, dcg, coalesce(dcg / nullif(list_sum(list_transform(range(1, least(g, k) + 1), lambda i: 1 / log2(i + 1))), 0), 0) AS ndcg FROM s),
 f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)"""


@query("metrics_per_query", f"{_metric_sql()} SELECT query_id, k, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(dcg, 6) AS dcg, round(ndcg, 6) AS ndcg FROM f")
def _(spark, d):
    return _judged(spark, d).select("query_id", "k", *_r("precision", "recall", "f1", "dcg", "ndcg"))


@query("metrics_at_k", f"{_metric_sql(ALL)} SELECT k, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(dcg), 6) AS dcg, round(avg(ndcg), 6) AS ndcg, count(*) AS num_queries FROM f GROUP BY k")
def metrics_at_k(spark, d):
    return N.macro_metrics(_judged(spark, d, ALL)).select("k", *_r("precision", "recall", "f1", "dcg", "ndcg"), "num_queries")


@query("qrels_positive", "SELECT doc_id, quality AS relevance FROM labels WHERE quality > 0")
def _(spark, d):
    return N.positive_qrels(_t(spark, d, "labels").select("doc_id", F.col("quality").alias("relevance")))


@query("semi_join_qids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality > 0)")
def _(spark, d):
    qrels = N.positive_qrels(_t(spark, d, "labels").select(F.col("doc_id").alias("query_id"), F.col("quality").alias("relevance")))
    return N.judged_queries(_t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "lang"), qrels).select(F.col("query_id").alias("doc_id"), "lang")


@query("anti_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return N.missing_keys(_docs(spark, d).select("doc_id"), _t(spark, d, "labels"), "doc_id")


# --- evidence and answers ---------------------------------------------------------------------


def _asked(spark, d) -> tuple[DataFrame, DataFrame]:
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries, A.chunks_by_shared_sentences(queries, _fixed(spark, d, 10, 0))


_RETRIEVED = f"""c AS (SELECT doc_id, position, sents FROM ({_chunks_sql(10, 0)})), q AS (SELECT item_id AS query_id, text AS query, {_SENTS.format(t="coalesce(text,'')")} AS qs FROM benchmark),
 a AS (SELECT DISTINCT query_id, {_NORM.format(x='x')} AS s FROM q, unnest(qs) AS u(x)), t AS (SELECT DISTINCT doc_id, position, {_NORM.format(x='x')} AS s FROM c, unnest(sents) AS u(x)),
 n AS (SELECT query_id, doc_id, position, count(*) AS shared FROM t JOIN a USING (s) GROUP BY 1, 2, 3), b AS (SELECT query_id, doc_id, position, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id, position) AS rank FROM n),
 ret AS (SELECT query_id, rank, sents FROM b JOIN c USING (doc_id, position) WHERE rank <= 5)"""


@query(
    "evidence_prf",
    f"""WITH {_RETRIEVED}, f AS (SELECT DISTINCT query_id, {_NORM.format(x='x')} AS r FROM ret, unnest(sents) AS u(x)), m AS (SELECT f.query_id, r, a.s AS g FROM f JOIN a ON a.query_id = f.query_id AND (contains(r, a.s) OR contains(a.s, r))),
 z AS (SELECT g.query_id, g.ng, coalesce(f.nr, 0) AS nr, coalesce(m.mr, 0) AS mr, coalesce(m.mg, 0) AS mg FROM (SELECT query_id, count(*) AS ng FROM a GROUP BY 1) g LEFT JOIN (SELECT query_id, count(*) AS nr FROM f GROUP BY 1) f USING (query_id) LEFT JOIN (SELECT query_id, count(DISTINCT r) AS mr, count(DISTINCT g) AS mg FROM m GROUP BY 1) m USING (query_id)),
 p AS (SELECT query_id, CASE WHEN nr > 0 THEN mr / nr ELSE 0 END AS p, mg / ng AS r FROM z) SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""",
)
def _(spark, d):
    queries, found = _asked(spark, d)
    return A.evidence_scores(found, queries.withColumnRenamed("query", "evidence")).select("query_id", *_r("precision", "recall", "f1"))


@query(
    "extractive_answer",
    f"""WITH {_RETRIEVED}, x AS (SELECT ret.query_id, rank, i, sents[i] AS s, list_distinct({_QA.format(x='q.query')}) AS qt, list_distinct({_QA.format(x='sents[i]')}) AS st FROM ret JOIN q USING (query_id), unnest(range(1, len(sents) + 1)) AS u(i)),
 o AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN len(qt) > 0 AND len(st) > 0 THEN 0.7::DOUBLE * (len(list_intersect(qt, st)) / len(qt)) + 0.3::DOUBLE * (len(list_intersect(qt, st)) / len(st)) ELSE 0 END, 9) DESC, rank, i) AS n FROM x)
 SELECT q.query_id, coalesce(substr(string_agg(s, ' ' ORDER BY n), 1, 768), '') AS answer FROM q LEFT JOIN o ON o.query_id = q.query_id AND n <= 3 GROUP BY 1""",
)
def _(spark, d):
    return A.extractive_answers(*_asked(spark, d))


@query("qa_similarity", f"WITH e AS ({_V}) SELECT round(avg(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))), 6) AS qa_similarity, count(*) AS n FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("answer")), "vec_id")
    return pairs.agg(F.round(F.avg(V.cosine(F.col("embedding"), F.col("answer"))), 6).alias("qa_similarity"), F.count(F.lit(1)).alias("n"))


# --- reports --------------------------------------------------------------------------------

_MARKS = ["DBSCAN", "SLINK", "FIXED", "BREAK", "CLUSTER", "plain"]


def _runs(spark, d) -> DataFrame:
    """Events read as result rows: user and kind make a run, the value is its metric at a cut-off."""
    e = _t(spark, d, "events")
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("user_id") % 6 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("")
    k = F.element_at(F.array(*[F.lit(x) for x in KS]), (F.col("event_id") % 4 + 1).cast("int"))
    stem = F.concat(F.col("event_type"), F.lit("_"), mark, F.lit("_"), F.col("user_id").cast("string"))
    return e.select("event_id", stem.alias("stem"), F.col("event_type").alias("chunking"), status.alias("status"), k.alias("k"), F.col("value").alias("f1")).withColumn("m", R.infer_method(F.col("stem"), F.col("chunking"))).select(
        "event_id", "stem", "chunking", "status", "k", "f1", F.col("m.macro").alias("macro"), F.col("m.variant").alias("variant")
    )


_RUNS = f"""SELECT event_id, stem, chunking, status, k, f1, CASE WHEN mark IN ('DBSCAN','SLINK','CLUSTER') THEN 'clustering' WHEN mark = 'FIXED' THEN 'fixed' WHEN mark = 'BREAK' THEN 'semantic_breakpoint' ELSE chunking END AS macro,
 CASE mark WHEN 'DBSCAN' THEN 'clustering_dbscan' WHEN 'SLINK' THEN 'clustering_single_linkage' WHEN 'CLUSTER' THEN 'clustering_unknown' WHEN 'FIXED' THEN 'fixed' WHEN 'BREAK' THEN 'semantic_breakpoint' ELSE chunking END AS variant
 FROM (SELECT event_id, event_type AS chunking, value AS f1, {_MARKS}[user_id % 6 + 1] AS mark, event_type || '_' || {_MARKS}[user_id % 6 + 1] || '_' || user_id AS stem, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE '' END AS status, [1, 3, 5, 10][event_id % 4 + 1] AS k FROM events)"""


@query("infer_method", f"SELECT event_id, stem, macro, variant FROM ({_RUNS})")
def _(spark, d):
    return _runs(spark, d).select("event_id", "stem", "macro", "variant")


@query("status_filter", f"SELECT event_id, status FROM ({_RUNS}) WHERE status NOT IN ('skipped', 'failed', 'interrupted')")
def _(spark, d):
    return R.usable(_runs(spark, d)).select("event_id", "status")


@query("status_counts", f"SELECT status, count(*) AS n FROM ({_RUNS}) GROUP BY 1")
def _(spark, d):
    return R.status_counts(_runs(spark, d))


_WIDE = f"SELECT stem, variant, avg(f1) FILTER (k = 1) AS a, avg(f1) FILTER (k = 3) AS b, avg(f1) FILTER (k = 5) AS c, avg(f1) FILTER (k = 10) AS e FROM ({_RUNS}) WHERE status <> 'failed' GROUP BY 1, 2"


def _wide(spark, d) -> DataFrame:
    return R.pivot_by_k(R.usable(_runs(spark, d)), ["stem", "variant"], ["f1"], KS)


@query("pivot_metric_by_k", f'SELECT stem, variant, round(a, 6) AS "f1@1", round(b, 6) AS "f1@3", round(c, 6) AS "f1@5", round(e, 6) AS "f1@10" FROM ({_WIDE})')
def _(spark, d):
    return _wide(spark, d).select("stem", "variant", *[F.round(F.col(f"`f1@{k}`"), 6).alias(f"f1@{k}") for k in KS])


@query("best_per_method", f'SELECT variant, round(max(a), 6) AS "f1@1", coalesce(first(stem ORDER BY a DESC NULLS LAST, stem) FILTER (a IS NOT NULL), \'\') AS "f1@1 run" FROM ({_WIDE}) GROUP BY 1')
def _(spark, d):
    return R.best_per_method(_wide(spark, d), "variant", "stem", ["f1@1"]).select("variant", F.round("f1@1", 6).alias("f1@1"), "f1@1 run")


@query(
    "boxplot_stats",
    f"WITH r AS (SELECT variant, f1 FROM ({_RUNS}) WHERE status <> 'failed'), b AS (SELECT * FROM r UNION ALL SELECT 'clustering_all', f1 FROM r WHERE starts_with(variant, 'clustering_')) SELECT variant, round(min(f1), 6) AS low, round(quantile_cont(f1, 0.25), 6) AS q1, round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.75), 6) AS q3, round(max(f1), 6) AS high, count(f1) AS n FROM b GROUP BY 1",
)
def _(spark, d):
    return R.box_stats(R.usable(_runs(spark, d)), "variant", "f1").select("variant", *_r("low", "q1", "median", "q3", "high"), "n")


@query("union_by_name", "SELECT doc_id, lang, NULL::VARCHAR AS source FROM documents UNION ALL SELECT doc_id, NULL, source FROM documents")
def _(spark, d):
    docs = _t(spark, d, "documents")
    return R.union_rows(docs.select("doc_id", "lang"), docs.select("doc_id", "source"))


@query("merge_task_lists", "WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS tasks FROM f GROUP BY 1")
def _(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_id", F.array("event_type").alias("tasks"))
    return R.merge_lists(rows, ["user_id"], "event_id", "tasks").select("user_id", F.array_join("tasks", ",").alias("tasks"))


@query(
    "windowed_running_mean",
    f"WITH n AS (SELECT doc_id // 100 AS w, len(s) AS n FROM ({SENTS})), s AS (SELECT w, count(*) AS c, sum(n) AS t FROM n GROUP BY 1) SELECT CAST(w AS BIGINT) AS \"window\", CAST(sum(c) OVER o AS BIGINT) AS n, CAST(sum(t) OVER o AS BIGINT) AS total, round(sum(t) OVER o / sum(c) OVER o, 6) AS mean FROM s WINDOW o AS (ORDER BY w)",
)
def _(spark, d):
    rows = _docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))
    return R.running_mean(rows, "doc_id", "n", 100).select("window", "n", "total", *_r("mean"))
