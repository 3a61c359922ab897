"""The same results in DuckDB's SQL, written plainly and apart from the operators."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT rid, unnest([{{'i': i, 'k': md5(array_to_string(w[i : i + 34], ' '))}} for i in range(1, len(w) - 33)]) AS x FROM d),
rep AS (SELECT x.k AS k FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, x.i + j AS i FROM win JOIN rep ON x.k = rep.k, range(0, 35) t(j)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM sh),
link AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM coded p JOIN coded q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.c AS component_id, d.doc_id = least.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id
"""

OP10 = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP2 = """
WITH m AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS mass FROM documents GROUP BY 1),
r AS (SELECT source, (sum(mass) OVER ()) / ((count(*) OVER ()) * mass) AS rate FROM m),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 8 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM r),
l AS (SELECT *, sum(CASE WHEN k > 1 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf FROM k),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS c FROM l),
d AS (SELECT *, row_number() OVER () AS rid, ('0x' || substr(md5('copies 17|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.rid, count(*) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY 1)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, ('0x' || substr(md5('order 17|' || doc_id || '|' || copy), 1, 15))::BIGINT AS mix_key
FROM d JOIN n USING (rid), LATERAL (SELECT unnest(range(1, n + 1)) AS copy)
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM p
"""

_KINDS = (
    (0, "assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "owned", "[A-Za-z0-9+/_=-]+", 0, 20),
)
_FOUND = "\n  UNION ALL ".join(
    f"SELECT rid, doc_id, source, lang, {i} AS kind, '{k}' AS name, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(b[1:len(m)]) AS b, {n} AS least"
    f" FROM (SELECT rid, doc_id, source, lang, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS b FROM d)"
    for i, k, p, g, n in _KINDS
)
OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
s AS (SELECT *, (sum(length(b) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i))::BIGINT AS e FROM f),
c AS (SELECT rid, source, lang, kind, name, e - length(m) AS s, e, v FROM s
  WHERE length(v) >= least AND (kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')))),
o AS (SELECT v, greatest(count(DISTINCT coalesce(source, '\0')), count(DISTINCT concat_ws('/', source, lang))) <= 2 AS live FROM c GROUP BY v),
x AS (SELECT c.*, o.live FROM c JOIN o USING (v)
  WHERE kind < 3 OR (o.live AND NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = c.rid AND b.kind < 3 AND b.s < c.e AND c.s < b.e))),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (live) AS n_live,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM x GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (rid)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * docs) // words AS m FROM d, s WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT iid, item_id, t, count(*) AS q FROM (SELECT iid, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
x AS (SELECT iid, item_id, rid, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""

_CRC32 = "xor(list_reduce([4294967295] || [ascii(x)::BIGINT for x in string_split(seq::VARCHAR, '')], lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, u: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
OP13 = f"""
WITH t AS (
  SELECT conv_id AS seq, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT seq, list(x ORDER BY turn NULLS FIRST, k) AS own FROM t GROUP BY seq),
h AS (SELECT seq, own, seq - seq % 5 AS base, ({_CRC32} % 9)::BIGINT AS h FROM c),
s AS (SELECT h.seq, coalesce(b.own[1 : h], []) || h.own[h + 1 :] AS s FROM h LEFT JOIN (SELECT seq AS base, own FROM c) b USING (base)),
p AS (SELECT seq, len(s) AS n, unnest([{{'d': d::BIGINT, 'k': md5(s[1 : d]::VARCHAR || d), 'b': CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].t) END::BIGINT}} for d in range(0, len(s) + 1)], recursive := true) FROM s),
g AS (SELECT k, d AS depth, min(seq) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(seq::VARCHAR, ',' ORDER BY seq) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY k, d),
pairs AS (SELECT g.k, up.k AS u, up.d AS u_depth FROM g JOIN p up ON up.seq = g.conv_id AND up.d <= g.depth),
kids AS (SELECT pairs.u AS k, count(*) AS n_children FROM pairs JOIN g USING (k) WHERE g.depth = pairs.u_depth + 1 GROUP BY 1),
sums AS (
  SELECT pairs.u AS k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens
  FROM pairs JOIN g ON g.k = pairs.k LEFT JOIN kids ON kids.k = pairs.k GROUP BY 1),
above AS (SELECT pairs.k, g.conv_id AS parent_conv_id FROM pairs JOIN g ON g.k = pairs.u JOIN g AS own ON own.k = pairs.k WHERE pairs.u_depth + 1 = own.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
FROM g LEFT JOIN kids USING (k) LEFT JOIN above USING (k) JOIN sums USING (k)
"""

ORACLES = {"op2_mixing": OP2, "op3_warc": OP3, "op5_secret_scan": OP5, "op10_exact_top_k": OP10, "op1_substring_dedup": OP1, "op9_near_dedup": OP9, "op11_lexical_search": OP11, "op13_prefix_trie": OP13}
