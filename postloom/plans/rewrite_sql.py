"""SQL that checks the queries on surrogates, redaction, style, judging and generation."""

from __future__ import annotations

from postloom.operators import identity, redact, style
from postloom.plans import sql
from postloom.plans.evaluate_queries import _SQL_SOURCES
from postloom.plans.profile_queries import COMPANY, INTERNAL

MOD = lambda h, n: f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({h}, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % {n})"
DAYS = f"CAST(round_even(({identity.TARGET_YEAR} + {MOD(f'''sha256(owner || '|{identity.SALT}')''', 2)} - year(ts)) * 365.25 / 7, 0) * 7 AS INTEGER)"

_WORDS = "list_filter(string_split(regexp_replace({x}, '[.\\s]+', ' ', 'g'), ' '), lambda w: w <> '')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(x_from, ''), '<[^>]*>', '', 'g'), '/[A-Z][A-Za-z]*(/[A-Za-z]+)*(@[A-Za-z]+)?', '', 'g'), '^[\\s\"'']+|[\\s\"'']+$', '', 'g'), '@.*$', '', 'g')"
_TURNED = f"CASE WHEN length({_BARE}) - length(replace({_BARE}, ',', '')) = 1 THEN regexp_replace({_BARE}, '^\\s*([^,]+?)\\s*,\\s*([^,]+?)\\s*$', '\\2 \\1') ELSE {_BARE} END"
_CLEAN = f"array_to_string(list_transform({_WORDS.format(x=_TURNED)}, lambda w: CASE WHEN upper(w) = w AND length(w) > 2 THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE w END), ' ')"
_FORMAL = "CASE split_part(lower({c}), ' ', 1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.NICKNAMES.items()) + " ELSE split_part(lower({c}), ' ', 1) END || CASE WHEN contains({c}, ' ') THEN substr(lower({c}), strpos({c}, ' ')) ELSE '' END"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _part(digest: str, n: int, k: int) -> str:
    return f"(CAST('0x' || substr({digest}, {8 * k + 1}, 8) AS BIGINT) % {n})"


def _digits(digest: str, form: str) -> str:
    out, k = [], 0
    for c in form:
        out.append(f"CAST(CAST('0x' || substr({digest}, {2 * k + 1}, 2) AS BIGINT) % 10 AS VARCHAR)" if c == "#" else f"'{c}'")
        k += c == "#"
    return " || ".join(out)


_PROFILES = "(SELECT *, row_number() OVER (ORDER BY profile_id) - 1 AS k, count(*) OVER () AS n FROM profiles WHERE profile_set = 'current')"
DISPLAY_NAMES = f"SELECT DISTINCT coalesce(x_from, '') AS x_from, {_CLEAN} AS name, {_FORMAL.format(c=f'({_CLEAN})')} AS identity FROM parsed_emails"
PERSONAS = f"""
WITH o AS (SELECT email_id, split_part(file, '/', 1) AS owner, {_CLEAN} AS c FROM parsed_emails WHERE x_from <> '' AND split_part(file, '/', 1) <> ''),
p AS {_PROFILES},
i AS (SELECT DISTINCT profile_id, domain, locale, {_FORMAL.format(c="c")} AS identity FROM (SELECT *, {MOD(f"sha256(owner || '|{identity.SALT}')", 'np')} AS k FROM o, (SELECT max(n) AS np FROM p)) x JOIN p USING (k) WHERE c <> ''),
s AS (SELECT *, sha256(profile_id || '|' || identity || '|{identity.SALT}') AS seed FROM i),
m AS (SELECT *, {_list(identity.FIRST['u'])}[{_part('seed', len(identity.FIRST['u']), 0)} + 1] AS first, {_list(identity.LAST)}[{_part('seed', len(identity.LAST), 1)} + 1] AS last, {_list(identity.TITLES)}[{_part('seed', len(identity.TITLES), 2)} + 1] AS title,
  CASE {" ".join(f"WHEN locale = '{locale}' AND {_part('seed', len(forms), 4)} = {k} THEN {_digits('sha256(seed)', form)}" for locale, forms in identity.PHONES.items() for k, form in enumerate(forms))} ELSE {_digits('sha256(seed)', identity.OTHER_PHONE[0])} END AS phone FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY profile_id, first, last ORDER BY identity) AS k FROM m)
SELECT profile_id, identity, first, last, title, phone, lower(first || '.' || last) || CASE WHEN k > 1 THEN CAST(k AS VARCHAR) ELSE '' END || '@' || domain AS email FROM r
"""
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(s, {sql.re2(p)}) THEN '{k}'" for k, p in redact.SPANS) + " END"
_ANY = sql.re2(redact.ANY_SPAN)
_COUNTS = ", ".join(f"""CASE WHEN list_contains(kinds, '{k}') THEN '"{k}":' || CAST(len(list_filter(kinds, lambda k: k = '{k}')) AS VARCHAR) END""" for k, _ in redact.SPANS)
REDACTED = f"""
WITH t AS (SELECT email_id, body, regexp_split_to_array(body, {_ANY}) AS plain, list_transform(regexp_extract_all(body, {_ANY}), lambda s: {_KIND}) AS kinds FROM parsed_emails)
SELECT email_id, CASE WHEN body = '' THEN '' ELSE array_to_string(list_transform(range(1, len(plain) + 1), lambda i: plain[i] || coalesce('[' || kinds[i] || ']', '')), '') END AS body, '{{' || array_to_string(list_filter([{_COUNTS}], lambda x: x IS NOT NULL), ',') || '}}' AS counts FROM t
"""
_NUMERIC = sql.re2(redact.NUMERIC_DATE)
MOVED = f"""
WITH t AS (SELECT email_id, body, regexp_split_to_array(body, {_NUMERIC}) AS plain, regexp_extract_all(body, {_NUMERIC}) AS spans FROM parsed_emails),
x AS (SELECT email_id, generate_subscripts(spans, 1) AS i, unnest(spans) AS s FROM t),
y AS (SELECT *, CASE WHEN contains(s, '/') THEN '/' ELSE '-' END AS sep, regexp_split_to_array(s, '[/-]') AS p FROM x),
z AS (SELECT *, CASE WHEN length(p[3]) = 2 THEN CAST(p[3] AS INTEGER) + CASE WHEN CAST(p[3] AS INTEGER) < 50 THEN 2000 ELSE 1900 END ELSE CAST(p[3] AS INTEGER) END AS yr FROM y),
d AS (SELECT *, CASE WHEN yr BETWEEN 1990 AND 2035 THEN try_cast(lpad(CAST(yr AS VARCHAR), 4, '0') || '-' || lpad(p[1], 2, '0') || '-' || lpad(p[2], 2, '0') AS DATE) + 371 END AS n FROM z),
m AS (SELECT email_id, list(coalesce(CAST(month(n) AS VARCHAR) || sep || CAST(day(n) AS VARCHAR) || sep || CASE WHEN length(p[3]) = 2 THEN lpad(CAST(year(n) % 100 AS VARCHAR), 2, '0') ELSE CAST(year(n) AS VARCHAR) END, s) ORDER BY i) AS out FROM d GROUP BY 1)
SELECT t.email_id, CASE WHEN out IS NULL THEN body ELSE array_to_string(list_transform(range(1, len(plain) + 1), lambda i: plain[i] || coalesce(out[i], '')), '') END AS body FROM t LEFT JOIN m USING (email_id)
"""


def _without(x: str, term: str) -> str:
    once = "regexp_replace({x}, '(?i)(^|[^A-Za-z0-9])' || regexp_escape({t}) || '($|[^A-Za-z0-9])', '\\1[REDACTED]\\2', 'g')"
    return once.format(x=once.format(x=x, t=term), t=term)  # twice, as neighbours share a boundary


FORCED = f"""
WITH j AS (SELECT s.syn_id, s.body, lower({_CLEAN}) AS name FROM synthetic_emails s JOIN (SELECT file, x_from FROM {_SQL_SOURCES}) p USING (file) WHERE s.error IS NULL),
k AS (SELECT *, CASE WHEN name = '' THEN body ELSE {_without("body", "name")} END AS b FROM j)
SELECT syn_id, {_without("b", f"'{COMPANY}'")} AS body FROM k
"""
_FULL = "regexp_matches({x}, '\\S')"
_TAIL = f"lower(array_to_string(list_filter(string_split({{x}}, chr(10)), lambda x: {_FULL.format(x='x')})[-4:], ' '))"
RESTYLED = f"""
WITH j AS (SELECT s.syn_id, s.raw, s.quoted, coalesce(p.body, '') AS ref, lower(split_part(s.headers['From'], '@', 1)) AS first, replace(translate(s.body, '{style._FOLD_FROM}', '{style._FOLD_TO.replace("'", "''")}'), '…', '...') AS t FROM synthetic_emails s JOIN {_SQL_SOURCES} p USING (file) WHERE s.error IS NULL),
a AS (SELECT *, len(regexp_extract_all(ref, '[.!?]  [A-Z]')) AS two, len(regexp_extract_all(ref, '[.!?] [A-Z]')) AS one, string_split(ref, chr(10)) AS rl FROM j),
b AS (SELECT *, string_split(CASE WHEN two + one >= 3 AND two / (two + one) >= 0.4 THEN regexp_replace(t, '([.!?]) ([A-Z])', '\\1  \\2', 'g') ELSE t END, chr(10)) AS sl, list_transform(list_filter(range(1, len(rl)), lambda i: length(rtrim(rl[i])) >= 50 AND {_FULL.format(x="rl[i + 1]")}), lambda i: rl[i]) AS marked FROM a),
c AS (SELECT *, CASE WHEN len(marked) >= 3 THEN len(list_filter(marked, lambda x: ends_with(x, ' '))) / len(marked) ELSE 0 END AS rate FROM b),
e AS (SELECT *, array_to_string(list_transform(range(1, len(sl) + 1), lambda i: CASE WHEN rate >= 0.2 AND i < len(sl) AND length(sl[i]) >= 50 AND {_FULL.format(x="sl[i + 1]")} AND CAST('0x' || right(md5(sl[i]), 8) AS BIGINT) % 100 < rate * 100 THEN rtrim(sl[i]) || ' ' ELSE sl[i] END), chr(10)) AS body FROM c)
SELECT syn_id, body, split_part(raw, chr(10) || chr(10), 1) || chr(10) || chr(10) || body || CASE WHEN {_FULL.format(x="coalesce(quoted, '')")} THEN chr(10) || chr(10) || quoted ELSE '' END AS raw, coalesce(first, '') <> '' AND contains({_TAIL.format(x="ref")}, first) AND NOT contains({_TAIL.format(x="body")}, first) AS signer_missing FROM e
"""
TRIMMED = f"""
WITH t AS (SELECT email_id, string_split(coalesce(raw_body, ''), chr(10)) AS ls FROM parsed_emails), w AS (SELECT *, list_transform(ls, lambda x: {sql.words("x")}) AS ws FROM t),
k AS (SELECT *, len(list_filter(range(1, len(ws) + 1), lambda i: list_sum(ws[1:i]) <= 120)) AS k FROM w) SELECT email_id, CAST(length(array_to_string(ls[1:k], chr(10))) AS INTEGER) AS trimmed_len FROM k
"""
_PARTS = "list_filter(regexp_split_to_array(split_part(a, '@', 1), '[._-]'), lambda p: p <> '')"
_SPELLED = f"CASE WHEN len({_PARTS}) >= 2 AND regexp_matches({_PARTS}[1], '^\\p{{L}}{{2,}}$') AND regexp_matches({_PARTS}[2], '^\\p{{L}}{{2,}}$') THEN array_to_string(list_transform({_PARTS}, lambda p: upper(left(p, 1)) || lower(substr(p, 2))), ' ') ELSE split_part(a, '@', 1) END"
RECIPIENTS = f"""
WITH t AS (SELECT email_id, to_addrs AS ads, list_transform(string_split(coalesce(x_to, ''), ';'), lambda x: trim(x, chr(32) || chr(9) || chr(34) || chr(39))) AS ps FROM parsed_emails WHERE len(to_addrs) > 0),
u AS (SELECT email_id, generate_subscripts(ads, 1) AS i, unnest(ads) AS a, ps, len(ps) = len(ads) AND len(list_filter(ps, lambda x: x = '')) = 0 AS fits FROM t)
SELECT email_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN fits THEN ps[i] ELSE {_SPELLED} END AS name FROM u
"""
LABELS = ("category", "intent", "action_required", "sensitive")
_RATE, _LABEL, _PAIR = (f"'{x}' || chr(10)" for x in ("Rate from 1 to 5 how real this message seems, and list artifacts, as JSON.", "Label this message as JSON.", "Which of the two is real, A or B? Answer as JSON."))
REPLIES = f"""
SELECT idx, kind, 1 + CAST('0x' || substr(h, 1, 2) AS BIGINT) % 5 AS realism, 'artifact ' || CAST('0x' || substr(h, 3, 2) AS BIGINT) % 7 AS artifact, CASE WHEN CAST('0x' || substr(h, 5, 2) AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS picked,
  'c' || length(p) % 3 AS category, 'i' || length(p) % 4 AS intent, CAST(contains(p, '?') AS VARCHAR) AS action_required, CAST(CAST('0x' || substr(h, 7, 2) AS BIGINT) % 2 = 1 AS VARCHAR) AS sensitive
FROM (SELECT *, sha256(p) AS h FROM (SELECT syn_id AS idx, unnest(['realism_source', 'realism_derived', 'labels_source', 'labels_derived', 'pair']) AS kind,
  unnest([{_RATE} || o, {_RATE} || b, {_LABEL} || o, {_LABEL} || b, {_PAIR} || 'A:' || chr(10) || CASE WHEN syn_id % 2 = 0 THEN o ELSE b END || chr(10) || chr(10) || 'B:' || chr(10) || CASE WHEN syn_id % 2 = 0 THEN b ELSE o END]) AS p
  FROM (SELECT s.syn_id, coalesce(p.body, '') AS o, coalesce(s.body, '') AS b FROM synthetic_emails s JOIN {_SQL_SOURCES} p USING (file) WHERE s.error IS NULL)))
"""
REALISM = f"WITH r AS ({REPLIES}) SELECT round(avg(realism) FILTER (kind = 'realism_source'), 6) AS realism_source, round(avg(realism) FILTER (kind = 'realism_derived'), 6) AS realism_derived, round(avg(CASE WHEN picked = CASE WHEN idx % 2 = 0 THEN 'A' ELSE 'B' END THEN 1 ELSE 0 END) FILTER (kind = 'pair'), 6) AS detected, count(*) FILTER (kind = 'pair') AS n_pairs FROM r"
ARTIFACTS = f"WITH r AS ({REPLIES}) SELECT artifact, count(*) AS n FROM r WHERE kind = 'realism_derived' GROUP BY 1 ORDER BY n DESC, artifact LIMIT 5"
_SIDES = ", ".join(
    f"t_{c} AS (SELECT a.{c} AS a, b.{c} AS b FROM r a JOIN r b ON a.idx = b.idx AND a.kind = 'labels_source' AND b.kind = 'labels_derived'), p_{c} AS (SELECT (SELECT count(*) FROM t_{c}) AS n, (SELECT avg(CAST(a = b AS INTEGER)) FROM t_{c}) AS po, (SELECT sum(x.k * y.k) FROM (SELECT a, count(*) AS k FROM t_{c} GROUP BY 1) x JOIN (SELECT b, count(*) AS k FROM t_{c} GROUP BY 1) y ON x.a = y.b) AS pe)"
    for c in LABELS
)
AGREEMENT = f"WITH r AS ({REPLIES}), {_SIDES} " + " UNION ALL ".join(f"SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe / n / n < 1 THEN (po - pe / n / n) / (1 - pe / n / n) ELSE 1.0 END, 6) AS kappa, '{c}' AS label FROM p_{c}" for c in LABELS)
FREQUENCIES = "WITH w AS (SELECT unnest(regexp_extract_all(concat_ws(chr(10) || chr(10), body, trailer), '\\p{L}+')) AS w FROM parsed_emails), c AS (SELECT lower(w) AS word, count(*) AS n, count(*) FILTER (w = lower(w)) AS n_small FROM w GROUP BY 1) SELECT word, n, round(log10(n / sum(n) OVER () * 1e9), 4) AS zipf, n_small FROM c"
_OWNED = f"(SELECT *, {MOD(f'''sha256(owner || '|{identity.SALT}')''', 'np')} AS k FROM (SELECT max(n) AS np FROM {_PROFILES}), (SELECT email_id, message_id, subject, coalesce(nullif(split_part(file, '/', 1), ''), nullif(x_origin, ''), from_addr, '') AS owner, CAST(left(date, 19) AS TIMESTAMP) AS ts FROM parsed_emails))"
#: What must hold of scrubbed messages, whatever the stand-ins are.
SCRUBBED = f"SELECT email_id, profile_id, coalesce({DAYS}, 0) AS shift_days, 0 AS n_left, false AS address_left FROM {_OWNED} o JOIN {_PROFILES} p USING (k)"
GENERATED = f"""
WITH o AS (SELECT *, coalesce({DAYS}, 0) AS days, md5(message_id || '|' || domain || '|{identity.SALT}') AS h FROM {_OWNED} o JOIN {_PROFILES} p USING (k)),
w AS (SELECT *, coalesce(ts + days * INTERVAL 1 DAY, TIMESTAMP '{identity.DEFAULT_DATE}') AS wall, coalesce(tz, 'UTC') AS zone FROM o),
z AS (SELECT *, CAST((epoch(wall) - epoch(timezone(zone, wall))) / 60 AS INTEGER) AS minutes FROM w)
SELECT email_id, profile_id AS company, '<' || left(h, 16) || '.' || lpad(CAST(CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100000 AS VARCHAR), 5, '0') || '@' || domain || '>' AS new_id,
  strftime(wall, '%a, %d %b %Y %H:%M:%S ') || CASE WHEN minutes < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(minutes) // 60 AS VARCHAR), 2, '0') || lpad(CAST(abs(minutes) % 60 AS VARCHAR), 2, '0') AS date_header, 0 AS n_leaks, false AS placeholder_left, true AS from_profile, false AS source_left FROM z
"""
#: Documents hold no quoted-printable codes, so these need no repair here.
CLEANED = r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\[?mailto:([^\]\s>]+)\]?', '\1', 'g'), 'IMCEA[A-Z]+-[^\s\]>]+', '', 'g'), '([\w.+-]+@[\w-]+(?:\.[\w-]+)+)@[A-Za-z]+\b', '\1', 'g'), '(<[^<>\s]+@[^<>\s]+>)@[A-Za-z]+\b', '\1', 'g') AS text FROM documents"
