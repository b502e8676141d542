"""DuckDB SQL for the corpus queries that SQL can express."""

W = r"[^\x20\x09-\x0D]+"

OP8 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{W}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
a AS (SELECT *, cap / wt AS turn FROM w),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER earlier, 0)) AS rate
      FROM a WINDOW earlier AS (ORDER BY turn, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (SELECT rate FROM r WHERE rate < turn ORDER BY turn, rate DESC LIMIT 1) AS common FROM r),
t AS (SELECT source, source_size, CASE WHEN common IS NULL OR turn <= common THEN cap ELSE wt * common END AS target FROM c),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS copies,
      (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(copies) AS sure, copies - floor(copies) AS pi FROM p),
q AS (SELECT *, CASE WHEN pi > 0 THEN (u * (1 - pi)) / ((1 - u) * pi) END AS odds FROM f),
v AS (SELECT *, odds / (1 + odds) AS v, target - sum(sure * size) OVER (PARTITION BY source) AS rest FROM q),
m AS (SELECT *, sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(size) OVER (PARTITION BY source, v, doc_id) / 2.0::DOUBLE AS mid FROM v)
SELECT doc_id, size, source_size, target, CAST(size * (sure + CASE WHEN pi > 0 AND mid < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{W}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{W}')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
n AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM g),
k AS (SELECT rid, i FROM n QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
c AS (SELECT rid, CAST(count(DISTINCT j) AS BIGINT) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM k) GROUP BY rid),
b AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals
      FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 5 * n_symbols > n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * letters < word_chars OR 2 * capitals > letters) AS kept
FROM b
"""

V = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{V}'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
b AS (SELECT item_id, list_transform(regexp_extract_all(coalesce(text, ''), '{V}'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM benchmark),
g AS (SELECT item_id, least(len(ws), 10) AS n, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS t FROM g),
lengths AS (SELECT DISTINCT n FROM p),
x AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths WHERE len(ws) >= n),
o AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS t FROM x),
h AS (SELECT rid, i, o.n, item_id FROM o JOIN p ON o.t = p.t AND o.n = p.n),
c AS (SELECT rid, CAST(count(DISTINCT j) AS BIGINT) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
e AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN e USING (rid)
"""

# crc32 is written out over the digits of an id
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"

OP13 = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, CAST({CRC} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM t)),
f AS (SELECT k.c, t.j, t.role, t.text, 0 AS own FROM k JOIN t ON t.c = k.c - k.c % 20 AND t.j <= k.h
      UNION ALL SELECT t.c, t.j, t.role, t.text, 1 AS own FROM k JOIN t ON t.c = k.c AND t.j > k.h),
r AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, j) AS d FROM f),
p AS (SELECT c, d, text, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM r
      UNION ALL SELECT c, 0, '', [] FROM k),
q AS (SELECT c, d, text, sha256(CAST(to_json(s) AS VARCHAR)) AS s, max(d) OVER (PARTITION BY c) AS l FROM p),
n AS (SELECT s, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '{W}')) AS saved,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE l = d), '')) AS ends_sha256 FROM q GROUP BY s, d),
m AS (SELECT n.*, u.s AS up, v.conv_id AS parent_conv_id FROM n LEFT JOIN q w ON w.c = n.conv_id AND w.d = n.d - 1 LEFT JOIN q u ON u.c = w.c AND u.d = w.d LEFT JOIN n v ON v.s = u.s AND v.d = u.d),
g AS (SELECT m.*, coalesce(b.x, 0) AS n_children FROM m LEFT JOIN (SELECT up, d - 1 AS d, count(*) AS x FROM m WHERE up IS NOT NULL GROUP BY ALL) b ON b.up = m.s AND b.d = m.d),
a AS (SELECT DISTINCT x.s AS top, x.d AS top_d, y.s, y.d FROM q x JOIN q y ON y.c = x.c AND y.d >= x.d),
z AS (SELECT a.top, a.top_d, CAST(sum(g.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE g.n_children = 0) AS n_leaves FROM a JOIN g ON g.s = a.s AND g.d = a.d GROUP BY ALL)
SELECT g.conv_id, g.d AS depth, g.parent_conv_id, g.n_convs, g.n_children, z.n_leaves, z.saved_tokens, g.ends_sha256 FROM g JOIN z ON z.top = g.s AND z.top_d = g.d
"""

ORACLES = {"op7_decontaminate": OP7, "op8_mix_sources": OP8, "op10_quality_rules": OP10, "op13_conversation_trie": OP13}
