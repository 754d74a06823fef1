"""DuckDB SQL for those queries of this subpackage that SQL can express; tests/llm covers the others by brute force."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
_TERMS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_TERMS}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_TERMS}) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, ws[s:s + least(len(ws), 13) - 1] AS g FROM i, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) t(s) WHERE len(ws) > 0),
dw AS (SELECT doc_id, p, n, ws[p:p + n - 1] AS g FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(ws) - n + 2)) t(p) WHERE len(ws) >= n),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw USING (g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_NEAR = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_TERMS}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_TERMS}) AS ws FROM benchmark),
v AS (SELECT DISTINCT unnest(ws) AS term FROM i),
o AS (SELECT * FROM (SELECT doc_id, p - 1 AS pos, ws[p] AS term FROM d, unnest(range(1, len(ws) + 1)) t(p)) WHERE term IN (SELECT term FROM v)),
x AS (SELECT item_id, p - 1 AS place, ws[p] AS term, len(ws) - least(len(ws), 13) AS last FROM i, unnest(range(1, len(ws) + 1)) t(p)),
f AS (SELECT term, count(*) AS df FROM o GROUP BY term),
k AS (SELECT item_id, place, x.term, row_number() OVER (PARTITION BY item_id, s ORDER BY coalesce(df, 0), place) AS k FROM x LEFT JOIN f ON f.term = x.term, unnest(range(greatest(place - 12, 0), least(place, last) + 1)) t(s)),
m AS (SELECT doc_id, item_id, place, pos - place AS shift FROM o JOIN (SELECT DISTINCT item_id, place, term FROM k WHERE k <= 2) l ON l.term = o.term),
q AS (SELECT *, shift - lag(shift) OVER w AS gap, lag(place) OVER w AS other FROM m WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY shift, place))
SELECT doc_id, item_id, count(*) AS n_near FROM q WHERE gap <= 3 AND other <> place GROUP BY doc_id, item_id
"""

_OP6 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_BLANK_WORDS}) AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM w, unnest(range(1, len(ws) - 1)) t(i)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST(CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(5 * n_symbols > n_words AS INT) + 8 * CAST(10 * word_chars < 25 * n_words AS INT)
  + 16 * CAST(word_chars > 12 * n_words AS INT) + 32 * CAST(2 * n_dup_lines > n_lines AS INT) + 64 * CAST(2 * n_upper > word_chars AS INT) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

_RULES = ("few_words", "repeated_trigrams", "symbol_heavy", "short_words", "long_words", "duplicate_lines", "shouting")
_ABLATION = f"WITH bits AS ({_OP6})" + " UNION ALL ".join(
    f" SELECT '{policy}' AS policy, '{rule}' AS rule, count(*) FILTER (WHERE fail_bits & {1 << k} > 0) AS failed, count(*) FILTER (WHERE fail_bits & {2**n - 1} = {1 << k}) AS only FROM bits"
    for policy, n in (("v1", 2), ("v2", 7)) for k, rule in enumerate(_RULES[:n])
)

_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_BLANK_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + 4] AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""

_OP9 = rf"""
WITH l AS (SELECT doc_id, i - 1 AS k, line, regexp_extract_all(line, {_BLANK_WORDS}) AS ws, doc_id * 1000000 + i - 1 AS place
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) t(i), LATERAL (SELECT lines[i] AS line)),
c AS (SELECT ws, min(place) AS place FROM l WHERE len(ws) > 0 GROUP BY ws),
v AS (SELECT place, len(ws) AS n, k, ws[1:k - 1] || ws[k + 1:] AS v FROM c, unnest(range(1, len(ws) + 1)) t(k) WHERE len(ws) >= 5),
near AS (SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY v, n, k) AS other FROM v) WHERE other < place
  UNION SELECT greatest(v.place, c.place) FROM v JOIN c ON c.ws = v.v WHERE len(c.ws) >= 5),
j AS (SELECT l.*, CASE WHEN len(l.ws) = 0 THEN NULL WHEN l.place > c.place THEN 'exact' WHEN c.place IN (SELECT place FROM near) THEN 'near' END AS verdict FROM l LEFT JOIN c ON c.ws = l.ws),
g AS (SELECT doc_id, count(*) FILTER (WHERE verdict = 'exact') AS n_exact, count(*) FILTER (WHERE verdict = 'near') AS n_near, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE verdict IS NOT NULL) AS removed,
  count(*) FILTER (WHERE verdict IS NULL AND len(ws) > 0) AS n_left, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE verdict IS NULL) AS kept FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near, coalesce(removed, '') AS removed, coalesce(n_left, 0) AS n_left, sha256(coalesce(kept, '')) AS text_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""


#: crc32 of the decimal digits in s, bit by bit: a digit's code comes in with the first of its eight steps.
_STEP = "xor(a, greatest(x, 0))"
_CRC = f"""xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(unicode(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN {_STEP} % 2 = 1 THEN xor({_STEP} // 2, 3988292384) ELSE {_STEP} // 2 END), 4294967295)"""

_OP11 = f"""
WITH t AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x, substr(md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 24) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, list(x ORDER BY turn NULLS FIRST, k) AS x FROM t GROUP BY conv_id),
h AS (SELECT *, {_CRC} % 6 AS h FROM c),
r AS (SELECT h.conv_id, coalesce(b.x[1:h.h], []) || h.x[h.h + 1:] AS x FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, x[1:d] AS p, d = len(x) AS ends FROM r, unnest(range(0, len(x) + 1)) u(d)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT n.p[1:e] AS p, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[d].t) END) AS saved, count(*) FILTER (WHERE k.p IS NULL) AS leaves FROM n LEFT JOIN k ON k.p = n.p, unnest(range(0, d + 1)) u(e) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a ON a.p = n.p LEFT JOIN k ON k.p = n.p LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""

_OP12 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, b, octet_length(b) AS n, count(*) OVER w AS c, max(page_id) OVER w AS top FROM p WINDOW w AS (PARTITION BY b)),
r AS (SELECT *, n >= 1000 AND c > 1 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op6_quality_rules": _OP6, "op7_ngram_join": _OP7, "op9_line_dedup": _OP9, "op11_prefix_trie": _OP11, "op12_warc": _OP12, "near_benchmark_items": _NEAR, "rule_ablation": _ABLATION}
