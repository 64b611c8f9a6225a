"""SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

SUBSTRING = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
m AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY s, n ORDER BY doc_id, i) > 1 AS again FROM k),
c AS (SELECT doc_id, i, word, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM m),
g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, least(len(ws), 5) AS need FROM w),
k AS (SELECT doc_id, need, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, need, s FROM k WHERE n = need),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.need = b.need AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(m.low, w.doc_id) AS component_id
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY 1) m USING (doc_id)
"""

SUFFIX = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
k AS (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 48)) AS i FROM b WHERE octet_length(raw) >= 50),
s AS (SELECT doc_id, i, array_slice(raw, i, i + 49) AS x FROM k),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) < doc_id AS gone FROM s),
t AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM m WHERE gone),
r AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
p AS (SELECT doc_id, run, min(i) AS lo, max(i) + 49 AS hi FROM r GROUP BY 1, 2),
q AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z, lo, hi FROM p
  UNION ALL SELECT doc_id, max(hi) + 1, NULL, NULL, NULL FROM p GROUP BY doc_id),
g AS (SELECT q.doc_id, sum(hi - lo + 1) AS n_removed, count(lo) AS n_spans, list(array_slice(raw, a, coalesce(z, octet_length(raw))) ORDER BY a) AS kept FROM q JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(CASE WHEN kept IS NULL THEN raw ELSE list_reduce(kept, lambda x, y: x || y) END) AS kept_sha256 FROM b LEFT JOIN g USING (doc_id)
"""

#: Unsigned CRC-32 of the decimal text of `doc_id`, bit by bit.
CRC32 = r"""xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""

MERKLE = rf"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS g, {CRC32} % 3 = 0 AS touched FROM documents),
e AS (SELECT d.*, CASE WHEN touched THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown_text,
 coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
h AS (SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(shown_text)) || ':' || shown_text, '-')) AS shown FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM h),
t AS (SELECT g, 0 AS lvl, idx, n, leaf AS digest FROM l
 UNION ALL SELECT g, lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, lvl, idx // 8, n),
s AS (SELECT g, lvl, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, idx, n, subroot AS digest FROM s
 UNION ALL SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 8, n),
f AS (SELECT g, lvl, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
 coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM t WHERE n > 1),
v AS (SELECT lvl, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
 coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM u WHERE n > 1),
p AS (SELECT l.g, l.idx, f.lvl, lft, rgt FROM l JOIN f ON f.g = l.g AND f.idx = l.idx // (8 ** f.lvl)::BIGINT
 UNION ALL SELECT l.g, l.idx, s.lvl + v.lvl, lft, rgt FROM l JOIN s ON s.g = l.g JOIN v ON v.idx = s.idx // (8 ** v.lvl)::BIGINT),
o AS (SELECT g, idx, 0 AS lvl, shown AS digest FROM l
 UNION ALL SELECT o.g, o.idx, o.lvl + 1, sha256(lft || o.digest || rgt) FROM o JOIN p ON p.g = o.g AND p.idx = o.idx AND p.lvl = o.lvl),
q AS (SELECT g, idx, string_agg(lft || rgt, '' ORDER BY lvl) AS proof FROM p GROUP BY g, idx),
z AS (SELECT g, idx, arg_max(digest, lvl) AS folded_root FROM o GROUP BY g, idx)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, z.folded_root, z.folded_root = r.digest AS verified
FROM l JOIN s ON s.g = l.g JOIN z ON z.g = l.g AND z.idx = l.idx LEFT JOIN q ON q.g = l.g AND q.idx = l.idx CROSS JOIN (SELECT digest FROM u WHERE n = 1) r
"""

FIM = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(ls) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS z,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a + 1:z], '') AS mid, array_to_string(ls[z + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
