"""DuckDB forms of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT r, unnest(regexp_split_to_array(t, '[\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), 1) AS i FROM d),
w AS (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM w0 WHERE w <> ''),
g AS (SELECT r, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g2, (VALUES (0), (1), (2)) v(k) WHERE n >= 2 GROUP BY r),
nw AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, source, i, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS n
 FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
idn AS (SELECT r, string_agg(n, chr(10) ORDER BY i) AS whole FROM l GROUP BY r),
hosts AS (SELECT source, count(DISTINCT coalesce(whole, '')) AS n_host FROM d LEFT JOIN idn USING (r) GROUP BY source),
often AS (SELECT f.source, f.n FROM (SELECT source, n, count(DISTINCT whole) AS k FROM l JOIN idn USING (r) GROUP BY source, n) f
 JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE k > least(greatest(10, n_host * 0.005::DOUBLE), 1000)),
gone AS (SELECT r, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w
 FROM l JOIN often o ON l.n = o.n AND l.source IS NOT DISTINCT FROM o.source GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(w, 0)::BIGINT AS n_removed_words
 FROM d LEFT JOIN nw USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 60 * n_words AS kept FROM m
"""

ORACLES["op3_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
u0 AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
u1 AS (SELECT *, list_filter(regexp_split_to_array(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
 coalesce(sum(length(u) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM u0),
u2 AS (SELECT r, i, u, a, len(w) >= 1 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, r, i) > 1 AS gone FROM u1),
x AS (SELECT r, count(*) FILTER (WHERE gone) AS g,
 string_agg(a::BIGINT::VARCHAR || ':' || (a + length(u))::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (WHERE gone) AS s, string_agg(u, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS t FROM u2 GROUP BY r)
SELECT doc_id, coalesce(g, 0)::BIGINT AS n_removed, coalesce(s, '') AS removed_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""

_FIELDS = "concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE crc0 AS (SELECT range AS i, list_reduce(list_prepend(range::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256)),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc0),
d AS (SELECT row_number() OVER () AS r, *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a >> 8, list_extract(tab, (xor(a, b) & 255) + 1)))) % 7 = 0 AS altered FROM documents, crc),
leaf0 AS (SELECT r, doc_id, coalesce('+' || lang, '') AS g, sha256(LEAF) AS leaf, sha256(CLAIM) AS claim FROM d),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf0),
t AS (SELECT 0 AS lv, g, i, n, leaf AS h FROM leaf
 UNION ALL SELECT lv + 1, g, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, g, i // 2),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS m FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, k AS i, m AS n, subroot AS h FROM sub
 UNION ALL SELECT lv + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 2),
steps AS (SELECT l.r, t.lv, (l.i >> t.lv) & 1 AS slot, s.h AS sib FROM leaf l JOIN t ON t.g = l.g AND t.i = l.i >> t.lv AND t.n > 1
  LEFT JOIN t s ON s.g = t.g AND s.lv = t.lv AND s.i = xor(t.i, 1)
 UNION ALL SELECT l.r, 1000 + u.lv, (sub.k >> u.lv) & 1, s.h FROM leaf l JOIN sub USING (g) JOIN u ON u.i = sub.k >> u.lv AND u.n > 1
  LEFT JOIN u s ON s.lv = u.lv AND s.i = xor(u.i, 1)),
path AS (SELECT r, sha256(coalesce(string_agg(sib, '' ORDER BY lv), '')) AS proof_sha256, list({'slot': slot, 'sib': coalesce(sib, '')} ORDER BY lv) AS p FROM steps GROUP BY r),
fold AS (SELECT r, claim AS h, 1 AS pos, p FROM leaf LEFT JOIN path USING (r)
 UNION ALL SELECT r, CASE WHEN p[pos].slot = 0 THEN sha256(h || p[pos].sib) ELSE sha256(p[pos].sib || h) END, pos + 1, p FROM fold WHERE pos <= len(p)),
ends AS (SELECT r, h AS folded_root FROM fold WHERE pos > coalesce(len(p), 0)),
top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub USING (g) JOIN ends USING (r) LEFT JOIN path USING (r), top
""".replace("LEAF", _FIELDS.format(n="n_chars")).replace("CLAIM", _FIELDS.format(n="(n_chars::HUGEINT + coalesce(altered, false)::INT)"))

ORACLES["op12_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS sh FROM d),
node AS (SELECT row_number() OVER () AS v, sh, min(doc_id) AS low, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
tok AS (SELECT v, n, unnest(sh) AS x FROM node),
link AS (SELECT a.v AS a, b.v AS b FROM tok a JOIN tok b ON a.x = b.x AND a.v < b.v AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS v, b AS o FROM two UNION SELECT v, b FROM reach JOIN two ON o = a),
comp AS (SELECT v, least(any_value(node.low), min(o.low)) AS c FROM reach JOIN node USING (v) JOIN node o ON o.v = reach.o GROUP BY v)
SELECT doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN doc_id ELSE coalesce(c, low) END AS component_id
FROM s LEFT JOIN node ON s.sh = node.sh LEFT JOIN comp USING (v)
"""


def _rounds(rounds: int) -> str:
    out = []
    for i in range(rounds + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT r, c, dist FROM (SELECT r, c, dist, row_number() OVER (PARTITION BY r ORDER BY dist, c) AS k
 FROM (SELECT r, c, list_sum(list_transform(list_zip(v.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM v, c{i} m) x) y WHERE k = 1)""")
        if i < rounds:
            out.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(any_value(n.v), any_value(o.v)) AS v FROM c{i} o LEFT JOIN
 (SELECT c, list(q ORDER BY pos) AS v FROM (SELECT c, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS q
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM d{i} JOIN v USING (r)) e GROUP BY c, pos) f GROUP BY c) n USING (c) GROUP BY c)""")
    return ",\n".join(out)


ORACLES["op13_centroid_clustering"] = r"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 40) x),
ROUNDS,
inertia AS (SELECT c, sum(dist)::BIGINT AS s FROM d5 GROUP BY c)
SELECT vec_id, c::INT AS cluster, dist AS distance, s AS cluster_inertia, (SELECT sum(dist)::BIGINT FROM d5) AS inertia,
 sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM d5 JOIN v USING (r) JOIN inertia USING (c) JOIN c5 USING (c)
""".replace("ROUNDS", _rounds(5))
