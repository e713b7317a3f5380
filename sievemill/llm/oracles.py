"""DuckDB SQL for the operators whose results SQL can state on whole tables: nearest neighbours, repeated byte strings, similar word sets. By brute force, each in its own way."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

#: all pairs of a query and another row of its length
NEAREST = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""

#: every window of 400 bytes, counted; runs of repeated ones as islands of their starts
REPEATS = """WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(1, octet_length(b) - 398)) AS s FROM t WHERE octet_length(b) >= 400),
h AS (SELECT w.r, w.s, md5(t.b[w.s : w.s + 399]) AS x FROM w JOIN t USING (r)),
again AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
hit AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM h SEMI JOIN again USING (x)),
run AS (SELECT r, s, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM hit),
gone AS (SELECT r, k, min(s) AS first, max(s) + 399 AS last FROM run GROUP BY r, k),
cut AS (SELECT r, sum(last - first + 1)::BIGINT AS n_removed, count(*) AS n_spans, list(first ORDER BY first) AS f, list(last ORDER BY first) AS l FROM gone GROUP BY r),
kept AS (SELECT t.r, doc_id, text, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN f IS NULL THEN hex(b)
 ELSE array_to_string(list_transform(range(1, len(f) + 2), lambda k: coalesce(hex(b)[2 * (CASE WHEN k = 1 THEN 0 ELSE l[k - 1] END) + 1 : 2 * (CASE WHEN k > len(f) THEN octet_length(b) ELSE f[k] - 1 END)], '')), '') END AS left_ FROM t LEFT JOIN cut USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(left_)) AS kept_sha256, n_removed > 0 AS changed, CASE WHEN n_removed = 0 THEN text
 ELSE decode(unhex(replace(array_to_string(regexp_extract_all(regexp_replace(left_, '(..)', '\\1 ', 'g'), '[0-7]. |[CD]. [89AB]. |E. [89AB]. [89AB]. |F[0-4] [89AB]. [89AB]. [89AB]. '), ''), ' ', ''))) END AS text FROM kept"""

#: word sets, all pairs that share a shingle, and the closure of the links
SIMILAR = r"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END) AS x FROM t),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS i, b.r AS j, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN n a ON a.r = i JOIN n b ON b.r = j WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT i, j FROM l UNION SELECT j, i FROM l),
reach AS (SELECT i, j FROM e UNION SELECT reach.i, e.j FROM reach JOIN e ON reach.j = e.i)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, m.first) AS component_id FROM t LEFT JOIN n USING (r) LEFT JOIN (SELECT i AS r, min(doc_id) AS first FROM reach JOIN t ON t.r = j GROUP BY i) m USING (r)"""

#: every term of every group, with the counts that smoothing gives; differences over all pairs of groups of a language
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT c.* FROM c SEMI JOIN k USING (lang, term)) USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
both_ AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_) WHERE part = 'pair' OR rank <= 50"""

#: lines as a list, cut at the two numbers of the hash
_H = lambda k: f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT"
_CUT = lambda x: f"CASE WHEN len(w) = 0 THEN '' ELSE array_to_string({x}, '') END"
MIDDLES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w, {_H(1)} AS h1, {_H(2)} AS h2, {_H(4)} AS h4 FROM d),
k AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM w),
c AS (SELECT *, {_CUT('w[1:a]')} AS p, {_CUT('w[a + 1:b]')} AS m, {_CUT('w[b + 1:]')} AS s FROM k)
SELECT doc_id, len(w)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

ORACLES = {"op4_vantage_point_search": NEAREST, "op5_suffix_dedup": REPEATS, "op6_ngram_jaccard": SIMILAR, "op11_source_divergence": DIVERGENCE, "op12_fill_in_middle": MIDDLES}
