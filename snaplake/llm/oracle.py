"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from snaplake.llm import periods, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text, text AS raw FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT rid, {WORDS} AS ws FROM d)),
g AS (SELECT rid, i, word || chr(10) || lead(word) OVER p || chr(10) || lead(word, 2) OVER p AS tri FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g WHERE tri IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid),
stat AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
l AS (SELECT rid, doc_id, host, raw, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM l),
f AS (SELECT *, array_to_string(ws, ' ') AS key FROM k WHERE len(ws) > 0),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY rid),
seen AS (SELECT host, key, count(DISTINCT doc_id) + count(DISTINCT rid) FILTER (doc_id IS NULL) AS documents, min(doc_id) AS first FROM f GROUP BY host, key),
over AS (SELECT host, key, first FROM seen WHERE documents > {quality.LIMIT}),
cut AS (SELECT rid, sum(len(ws)) AS removed_words FROM f JOIN over USING (host, key) WHERE doc_id IS DISTINCT FROM first GROUP BY rid),
j AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN stat USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN cut USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * removed_words <= {quality.MAX_REMOVED} * n_words AS kept, removed_words FROM b
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS shown,
  length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) AS role_shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + role_shown + 1 + shown + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEARDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, n_shingles, hash(x) AS h, x FROM (SELECT doc_id, len(sh) AS n_shingles, unnest(sh) AS x FROM s)),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n_shingles >= 85 * b.n_shingles AND 100 * b.n_shingles >= 85 * a.n_shingles
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))),
g AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, c) AS (SELECT a, a FROM (SELECT DISTINCT a FROM g) UNION SELECT g.b, r.c FROM r JOIN g ON r.a = g.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, coalesce(c, n.doc_id) AS component_id, coalesce(c, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN m ON n.doc_id = m.a
"""



def crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters: each is added to the register, which is then shifted eight times."""
    marks = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({marks}, lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END, 4294967295), 4294967295)"


_LONG = f"greatest({periods.LEAST_WORDS} - q, {periods.LEAST_PERIODS - 1} * q)"

PERIODS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS given, {crc32('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
e AS (SELECT *, h // 10 AS g, len(given) AS n FROM d),
f AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: given[1 + CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE given END AS ws FROM e),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM f WHERE n >= {periods.LEAST_WORDS}),
p AS MATERIALIZED (SELECT a.doc_id, b.i - a.i AS q, a.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND {periods.LEAST_PERIODS} * (b.i - a.i) <= a.n),
many AS (SELECT doc_id, q FROM p GROUP BY doc_id, q HAVING count(*) >= {_LONG}),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM p JOIN many USING (doc_id, q)),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM k GROUP BY doc_id, q, k HAVING count(*) >= {_LONG}),
run AS MATERIALIZED (SELECT doc_id, s, length, min(q) AS q FROM stretch GROUP BY doc_id, s, length),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS runs, list({{'a': s + q, 'b': s + length}}) AS gone,
  first({{'s': s, 'length': length, 'q': q}} ORDER BY CAST(length AS HUGEINT) * 1000000000000 // q DESC, s, q) AS best FROM run GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.length AS length, best.q AS period, 1000 * best.length // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN n_runs > 0 THEN list_transform(list_filter(list_zip(ws, range(n)), lambda x: len(list_filter(gone, lambda y: y.a <= x[2] AND x[2] < y.b)) = 0), lambda x: x[1]) ELSE ws END, ' ')) AS collapsed_sha256
FROM f LEFT JOIN r ON f.doc_id = r.doc_id
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


_SIDE = "CASE WHEN s.h IS NULL THEN '-' WHEN s.i < {i} >> {n}.level THEN 'L' || s.h ELSE 'R' || s.h END"

MERKLE = f"""
WITH RECURSIVE leaf AS MATERIALIZED (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n, {_leaf('n_chars')} AS leaf,
  CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS changed FROM documents),
node AS (SELECT lang, 0 AS level, r AS i, n, leaf AS h FROM leaf
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, level, n, i // 2),
sub AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (SELECT 0 AS level, r AS i, n, subroot AS h FROM sub
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, n, i // 2),
height AS (SELECT DISTINCT lang, level FROM node WHERE n > 1),
rise AS (SELECT DISTINCT level FROM top WHERE n > 1),
low AS (SELECT l.doc_id, l.r, l.lang, list({_SIDE.format(i='l.r', n='t')} ORDER BY t.level) AS path FROM leaf l JOIN height t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN node s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.i = xor(l.r >> t.level, 1) GROUP BY l.doc_id, l.r, l.lang),
high AS (SELECT b.lang, list({_SIDE.format(i='b.r', n='t')} ORDER BY t.level) AS path FROM sub b JOIN rise t ON true LEFT JOIN top s ON s.level = t.level AND s.i = xor(b.r >> t.level, 1) GROUP BY b.lang),
full_ AS (SELECT l.*, b.subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path FROM leaf l JOIN sub b ON l.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM l.lang AND low.r = l.r LEFT JOIN high ON high.lang IS NOT DISTINCT FROM l.lang),
fold AS (SELECT *, list_reduce(path, lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END, changed) AS folded_root FROM full_)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold
"""

SQL = {"op3_quality_rules": QUALITY, "op4_near_dedup": NEARDUP, "op6_chat_format": CHAT, "op11_periodic_runs": PERIODS, "op12_merkle_manifest": MERKLE}
