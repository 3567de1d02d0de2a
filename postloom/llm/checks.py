"""SQL that checks queries of this subpackage where it can be said in SQL."""

from __future__ import annotations

from postloom.llm.conversations import FORWARD_MARKS, REPLY_MARKS
from postloom.llm.truncation import MARK

_BLANKS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _plain(x: str) -> str:
    return f"regexp_replace(lower(upper({x})), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_LABELLED = f"regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]*\\p{{L}}[\\p{{L}} ]{{0,30}}:[{_BLANKS}]+[^{_BLANKS}]')"
_LINES = "string_split_regex(coalesce(body, ''), '\\r\\n|\\r|\\n')"
# Groups by both forms are united by taking minima in turn.
_COPIES = f"""
k AS (SELECT email_id AS e, {_plain("coalesce(message_id, '')")} AS m, {_plain("coalesce(body, '')")} AS a,
  CASE WHEN len(list_filter({_LINES}, lambda x: {_LABELLED})) > 0 THEN array_to_string(list_sort(list_transform(list_filter({_LINES}, lambda x: {_LABELLED}), lambda x: {_plain("x")})), '|') || '||' || {_plain(f"array_to_string(list_filter({_LINES}, lambda x: NOT {_LABELLED}), ' ')")} END AS b FROM parsed_emails),
r1 AS (SELECT *, CASE WHEN m = '' THEN e ELSE min(e) OVER (PARTITION BY m, a) END AS x1 FROM k),
r2 AS (SELECT *, CASE WHEN m = '' OR b IS NULL THEN x1 ELSE min(x1) OVER (PARTITION BY m, b) END AS x2 FROM r1),
r3 AS (SELECT *, CASE WHEN m = '' THEN e ELSE min(x2) OVER (PARTITION BY m, a) END AS x3 FROM r2),
r4 AS (SELECT *, CASE WHEN m = '' OR b IS NULL THEN x3 ELSE min(x3) OVER (PARTITION BY m, b) END AS x4 FROM r3),
copies AS (SELECT CASE WHEN m = '' THEN e ELSE min(x4) OVER (PARTITION BY m, a) END AS email_id, e AS copy_email_id FROM r4)
"""
_COUNT = r"(?:[\s]*[\[(^]?[0-9]{1,3}[\])]?)?"
_ANY = f"(?:{'|'.join(REPLY_MARKS + FORWARD_MARKS)}){_COUNT}\\s*[:：]"
_MARKS = f"(?i)^\\s*(?:{_ANY}\\s*)+"
_FORWARD = f"(?i)^\\s*(?:(?:{'|'.join(REPLY_MARKS)}){_COUNT}\\s*[:：]\\s*)*(?:{'|'.join(FORWARD_MARKS)}){_COUNT}\\s*[:：]"
_INSTANT = "CAST(left(date, 19) AS TIMESTAMP) - CAST(substr(date, 20, 1) || substr(date, 21, 2) AS INTEGER) * INTERVAL 1 HOUR - CAST(substr(date, 20, 1) || substr(date, 24, 2) AS INTEGER) * INTERVAL 1 MINUTE"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{_BLANKS}]+|_+', '', 'g'), '[{_BLANKS}]+'), lambda w: w <> '')"


def _grams(x: str) -> str:
    return f"unnest(list_transform(range(1, len({x}) - 18), lambda i: array_to_string({x}[i:i + 19], ' ')))"


_MARK = MARK.replace("\\uFFFD", "\\x{FFFD}")
_TRIM = "' ' || chr(10) || chr(13) || chr(9) || chr(12) || chr(11) || chr(160)"
_UPPER, _LOWER = (f"(ends + z * z / 2) / (seen + z * z) {sign} z * sqrt(ends * (seen - ends) / greatest(seen, 1) + z * z / 4) / (seen + z * z)" for sign in "+-")
_TRUNCATED = f"""
WITH c AS (SELECT doc_id, source, rtrim(text, {_TRIM}) AS text FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, source, regexp_matches(right(text, 160), '{_MARK}') AS marked, trim(left(text, greatest(length(text) - 160, 0)) || regexp_replace(right(text, 160), '{_MARK}', ''), {_TRIM}) AS x FROM c),
t AS (SELECT doc_id, marked, string_split('^ ^ ' || regexp_replace(regexp_replace(replace(x, chr(10), '¶ '), '[0-9]+(?:[.,:/][0-9]+)*', '0', 'g'), '\\p{{Lu}}[\\p{{L}}\\p{{M}}]*', 'A', 'g'), ' ') AS t FROM d WHERE x <> ''),
g AS (SELECT doc_id, marked, unnest(list_transform(range(1, len(t) - 1), lambda i: struct_pack(c := t[i] || ' ' || t[i + 1], b := t[i + 1], w := rtrim(t[i + 2], '¶'), last := i = len(t) - 2))) AS g FROM t),
keyed AS (SELECT doc_id, marked, g.last AS last, g.w AS w, unnest([struct_pack(level := 3, k := '3' || g.c), struct_pack(level := 2, k := '2' || g.b), struct_pack(level := 1, k := '1')]) AS s FROM g),
by_key AS (SELECT s.k AS k, w, count(*) AS n FROM keyed WHERE NOT last GROUP BY 1, 2),
inside AS (SELECT k, w, sum(n) AS n FROM (SELECT k, n, unnest(list_transform(range(1, length(w) + 1), lambda i: left(w, i))) AS w FROM by_key) GROUP BY 1, 2),
others AS (SELECT e.k, e.w, CAST(e.n - 1 AS DOUBLE) AS ends, CAST(coalesce(i.n, 0) + e.n - 1 AS DOUBLE) AS seen, CAST(1 AS DOUBLE) AS z FROM (SELECT s.k AS k, w, count(*) AS n FROM keyed WHERE last GROUP BY 1, 2) e LEFT JOIN inside i USING (k, w)),
judged AS (SELECT k, w, CASE WHEN {_UPPER} <= 0.02 THEN true WHEN {_LOWER} > 0.02 THEN false END AS cut, ends > 0.01 * seen AS over FROM others),
per AS (SELECT doc_id, any_value(w) AS w, any_value(marked) AS marked, bool_or(cut) FILTER (level = 3) AS c3, bool_or(cut) FILTER (level = 2) AS c2, bool_or(over) FILTER (level = 2) AS o2, bool_or(cut) FILTER (level = 1) AS c1 FROM (SELECT l.doc_id, l.w, l.marked, l.s.level AS level, j.cut, j.over FROM keyed l JOIN judged j ON l.last AND j.k = l.s.k AND j.w = l.w) GROUP BY 1),
found AS (SELECT doc_id, CASE WHEN regexp_matches(w, '[.?!]$') THEN false ELSE coalesce(c3, c2, CASE WHEN o2 THEN false END, c1, marked) END AS truncated FROM per)
"""

_WINDOWS = """
r AS (SELECT 'parsed' AS record_type, email_id AS record_id, body AS t FROM parsed_emails UNION ALL SELECT 'synthetic', syn_id, body FROM synthetic_emails),
w AS (SELECT record_type, record_id, i, md5(substr(t, i, 160)) AS h FROM (SELECT *, unnest(range(1, length(t) - 158)) AS i FROM r WHERE length(t) >= 160)),
s AS (SELECT h FROM w GROUP BY h HAVING min(record_type || record_id) <> max(record_type || record_id))
"""
_TURNS = f"""
WITH {_COPIES},
m AS (SELECT email_id AS id, CASE WHEN regexp_matches(coalesce(subject, ''), '{_FORWARD}') THEN 'f' WHEN regexp_matches(coalesce(subject, ''), '{_MARKS}') THEN 'r' ELSE 'o' END AS kind,
  regexp_replace(lower(regexp_replace(coalesce(subject, ''), '{_MARKS}', '')), '[{_BLANKS}]+', '', 'g') AS key, lower(trim(from_addr)) AS f, list_transform(to_addrs, lambda a: lower(trim(a))) AS tos, {_INSTANT} AS ts, coalesce(regexp_matches(raw_body, '[^{_BLANKS}]'), false) AS ok
  FROM parsed_emails WHERE email_id IN (SELECT email_id FROM copies) AND from_addr IS NOT NULL),
l AS (SELECT r.id, o.id AS conv FROM m r JOIN m o ON r.kind = 'r' AND o.kind = 'o' AND r.key = o.key AND len(list_filter(list_append(r.tos, r.f), lambda p: NOT list_contains(list_append(o.tos, o.f), p))) = 0 AND (r.ts IS NULL OR o.ts < r.ts)
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY o.ts DESC NULLS LAST, o.id DESC) = 1),
g AS (SELECT l.conv, m.* FROM l JOIN m USING (id) UNION ALL SELECT m.id, m.* FROM m WHERE id IN (SELECT conv FROM l)),
first AS (SELECT conv, f, min(struct_pack(t := ts, i := id)) AS t FROM g GROUP BY 1, 2),
asked AS (SELECT g.conv, g.id, bool_or(coalesce(w.f <> g.f AND w.t < struct_pack(t := g.ts, i := g.id), false)) AS answers FROM (SELECT *, unnest(CASE WHEN len(tos) = 0 THEN ['-'] ELSE tos END) AS a FROM g WHERE id <> conv) g LEFT JOIN first w ON w.conv = g.conv AND w.f = g.a GROUP BY 1, 2),
bad AS (SELECT conv FROM g GROUP BY 1 HAVING NOT bool_and(ok AND ts IS NOT NULL) OR count(DISTINCT f) < 2 UNION SELECT conv FROM asked WHERE NOT answers),
turns AS (SELECT conv, f, id, CAST(row_number() OVER (PARTITION BY conv ORDER BY ts, id) AS INTEGER) AS turn_no FROM g WHERE conv NOT IN (SELECT conv FROM bad))
"""

SQL = {
    "p9_found": f"{_TRUNCATED} SELECT doc_id FROM found WHERE truncated",
    "p9_rates": f"{_TRUNCATED} SELECT source, count(*) AS n_docs, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (truncated) / count(*) AS rate FROM documents LEFT JOIN found USING (doc_id) GROUP BY 1",
    "p2_found": f"WITH {_COPIES} SELECT email_id, copy_email_id FROM copies WHERE email_id <> copy_email_id",
    "p2_copies": f"WITH {_COPIES} SELECT email_id, count(*) AS n_copies FROM copies GROUP BY 1",
    "p3_found": f"WITH {_WINDOWS} SELECT DISTINCT record_type, record_id FROM w JOIN s USING (h)",
    "p3_shared": f"WITH {_WINDOWS}, p AS (SELECT DISTINCT record_type, record_id, i FROM w JOIN s USING (h)), g AS (SELECT *, i - lag(i) OVER (PARTITION BY record_type, record_id ORDER BY i) AS gap FROM p) SELECT record_type, record_id, CAST(sum(coalesce(least(gap, 160), 160)) AS INTEGER) AS shared_chars, CAST(count(*) FILTER (gap IS NULL OR gap > 160) AS INTEGER) AS n_spans FROM g GROUP BY 1, 2",
    "p5_found": f"{_TURNS} SELECT conv AS conv_email_id, turn_no, id AS email_id FROM turns",
    "p5_roles": f"{_TURNS} SELECT conv AS conv_email_id, count(*) AS n_turns, count(*) FILTER (f = opener) AS n_opener_turns, count(DISTINCT f) AS n_people FROM (SELECT *, first_value(f) OVER (PARTITION BY conv ORDER BY id <> conv) AS opener FROM turns) GROUP BY 1",
    "p7_found": f"""
WITH b AS (SELECT item_id, regexp_extract(regexp_replace(message, '\\r\\n?', chr(10), 'g'), '(?s)^.*?\\n[ \\t]*\\n(.*)$', 1) AS t FROM eval_set),
i AS (SELECT item_id, {_words("regexp_replace(t, '(?ms)^\\s*-{3,}\\s*(?:Original|Forwarded).*', '')")} AS w FROM b),
ig AS (SELECT DISTINCT item_id, {_grams("w")} AS g FROM i),
d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, {_grams("w")} AS g FROM d)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
}
