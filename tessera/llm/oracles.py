"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPANS = r"""SELECT doc_id, kind, place, pos - after - length(val) - length(pre) AS b, pos - after AS e FROM (
 SELECT doc_id, kind, place, least_, i, pre, val, after, sum(length(pre) + length(val) + after) OVER (PARTITION BY doc_id, kind ORDER BY i) AS pos FROM (
 SELECT doc_id, kind, place, least_, i, CASE WHEN i = 1 THEN '' ELSE string_split(p[i], chr(2))[1] END AS pre, CASE WHEN i = 1 THEN '' ELSE string_split(string_split(p[i], chr(2))[2], chr(3))[1] END AS val,
 CASE WHEN i = 1 THEN length(p[i]) ELSE length(string_split(p[i], chr(3))[2]) END AS after FROM (
 SELECT doc_id, kind, place, least_, string_split(regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)), pat, chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)) AS p
 FROM documents, (VALUES ('assign', 0, 6, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)'), ('access', 1, 20, '()(AKIA[A-Z0-9]+)'), ('hex', 2, 24, '()([0-9a-f]{24,})')) AS r(kind, place, least_, pat)),
 unnest(range(1, len(p) + 1)) AS u(i))) WHERE i > 1 AND length(val) >= least_"""

SECRETS = f"""WITH f AS ({_SPANS}), g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, place) AS s FROM f GROUP BY 1)
 SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""

WARC = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, lower(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g')) AS u FROM pages),
 d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1, 1)), '') AS digest, max(page_id) OVER (PARTITION BY h) AS last,
 regexp_replace(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), ':\d*$', ''), '^www\d*\.', '') AS host FROM p)
 SELECT page_id, strlen(h) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to,
 array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(u, '^[^/?]*(.*)$', 1) AS urlkey, strftime(make_timestamp(page_id * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM d"""

_WORDS6 = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""WITH q AS (SELECT item_id, {_WORDS6.format(x='text')} AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 13) AS k FROM q WHERE len(w) > 0), unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i)),
 d AS (SELECT doc_id, {_WORDS6.format(x='text')} AS w FROM documents), ks AS (SELECT DISTINCT k FROM iw),
 dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT * FROM d, ks WHERE len(w) >= k), unnest(range(1, len(w) - k + 2)) AS u(i)),
 h AS (SELECT DISTINCT doc_id, i, k, item_id FROM dw JOIN iw USING (k, s)), p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, unnest(range(0, k)) AS t(j) GROUP BY 1),
 t AS (SELECT doc_id, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(d.w) AS contaminated
 FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

_WORDS7 = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

CLASSES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS7.format(x='text')} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], chr(1)) AS s FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT a, b FROM both_ UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) c USING (doc_id)"""

NEGATIVES = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
 s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
 SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

RANKED = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format(x='text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents), l AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
 t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2), c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
 q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_LOW.format(x='text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
 f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, n_docs),
 s AS (SELECT i, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN l USING (r), c GROUP BY 1, 2, 3, 4)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

SQL = {"op11_ranked_search": RANKED, "op13_hard_negatives": NEGATIVES, "op2_secrets": SECRETS, "op4_warc": WARC, "op6_decontaminate": CONTAMINATION, "op7_ngram_join": CLASSES}
