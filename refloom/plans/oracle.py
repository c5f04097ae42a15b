"""SQL twins of the core queries that need more than a few lines: similarity, issues, verdicts and scores in DuckDB's dialect."""

from __future__ import annotations

import re

from refloom.functions import text as X
from refloom.operators import sections, validate, verdict

E = "e AS (SELECT * FROM bib_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at) = 1)"
V = "v AS (SELECT * FROM verifications QUALIFY row_number() OVER (PARTITION BY verification_id ORDER BY loaded_at) = 1)"
#: white space as the engine sees it; RE2's own class knows ASCII only
SPACE = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def folded(x: str) -> str:
    return f"replace(replace(replace(replace(lower({x}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


def normal(x: str) -> str:
    """A normal title."""
    return (
        rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({folded(f'coalesce({x}, {chr(39) * 2})')}, '\\[a-zA-Z]+\{{([^}}]*)\}}', '\1', 'g'), '[{{}}]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains("
        + str(X.TITLE_STOP)
        + ", w)), ' ')"
    )


def surnames(x: str) -> str:
    parts = rf"list_transform(regexp_split_to_array({x}, '(?i);|\band\b'), lambda p: {folded(strip('p'))})"
    parts = rf"list_filter({parts}, lambda p: NOT regexp_matches(p, '^et{SPACE}+al\.?$'))"
    last = rf"CASE WHEN contains(p, ',') THEN string_split(p, ',')[1] ELSE regexp_split_to_array(p, '{SPACE}+')[-1] END"
    return rf"list_filter(list_transform({parts}, lambda p: regexp_replace({last}, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda p: length(p) > 2)"


def overlap(cited: str, correct: str) -> str:
    """Share of the first ten cited surnames found in the other list, over columns ``sa`` and ``sb`` made of ``surnames``."""
    hits = "len(list_filter(sa[1:10], lambda s: len(list_filter(sb, lambda x: contains(x, s) OR contains(s, x))) > 0))"
    return f"CASE WHEN coalesce({cited}, '') <> '' AND coalesce({correct}, '') <> '' AND len(sa) >= 2 AND len(sb) >= 2 THEN {hits} / len(sa[1:10]) END"


#: Longest common subsequence of ``x`` and ``y``, row by row.
LCS = """CASE WHEN x = '' OR y = '' THEN 0 ELSE list_reduce(string_split(x, ''), lambda row, c: list_reduce(range(1, len(ys) + 1), lambda acc, j: list_append(acc, greatest(acc[-1], CASE WHEN ys[j] = c THEN row[j] + 1 ELSE row[j + 1] END)), [0::BIGINT]), list_transform(range(0, len(ys) + 1), lambda k: 0::BIGINT))[-1] END"""


def similar(source: str, name: str, keep: str) -> str:
    """CTEs that end in ``name``: the rows of ``source`` (with normal titles ``a`` and ``b``) and their similarity ``sim``.

    ``keep`` filters on ``cheap`` (the two ratios that need no alignment) and
    ``most`` (a bound of the third, from letter counts) before titles are aligned.
    """
    count = lambda c, s: f"(length({s}) - length(replace({s}, {c}, '')))"
    letters = "string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', '')"
    other = lambda s: f"length(regexp_replace({s}, '[a-z0-9 ]', '', 'g'))"
    return f"""{name}1 AS (SELECT *, list_distinct(string_split(a, ' ')) AS s, list_distinct(string_split(b, ' ')) AS t FROM {source}),
{name}2 AS (SELECT *, array_to_string(list_sort(list_filter(s, lambda w: list_contains(t, w))), ' ') AS bt, array_to_string(list_sort(list_filter(s, lambda w: NOT list_contains(t, w))), ' ') AS x, array_to_string(list_sort(list_filter(t, lambda w: NOT list_contains(s, w))), ' ') AS y FROM {name}1),
{name}3 AS (SELECT *, length(bt) AS n, CASE WHEN bt <> '' THEN 1 ELSE 0 END AS g FROM {name}2),
{name}4 AS (SELECT *, n + g + length(x) AS lx, n + g + length(y) AS ly FROM {name}3),
{name}5 AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN n > 0 AND (x = '' OR y = '') THEN 1.0 WHEN n > 0 THEN greatest(1 - (g + length(x)) / (n + lx)::DOUBLE, 1 - (g + length(y)) / (n + ly)::DOUBLE) ELSE 0.0 END AS cheap,
 CASE WHEN a = '' OR b = '' THEN 0.0 ELSE 1 - (length(x) + length(y) - 2 * (list_sum(list_transform({letters}, lambda c: least({count('c', 'x')}, {count('c', 'y')}))) + least({other('x')}, {other('y')}))) / (lx + ly)::DOUBLE END AS most FROM {name}4),
{name} AS (SELECT *, CASE WHEN cheap = 1.0 OR a = '' OR b = '' THEN cheap ELSE greatest(cheap, 1 - (length(x) + length(y) - 2 * {LCS}) / (lx + ly)::DOUBLE) END AS sim FROM (SELECT *, string_split(y, '') AS ys FROM {name}5 WHERE {keep}))"""


#: The last entry of each key of a paper, and the best result of it.
UNIQUE = "u AS (SELECT doc_id, key, arg_max(authors, ord) AS authors0, max_by({'a': authors, 't': title}, ord) AS r FROM e GROUP BY doc_id, key)"
BEST = "b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY CASE status WHEN 'verified' THEN 3 WHEN 'partial_match' THEN 2 WHEN 'not_found' THEN 1 ELSE 0 END DESC, confidence DESC, verification_id) = 1)"
SCREEN = f"""{BEST},
j0 AS (SELECT u.doc_id, u.key, u.r.a AS cited, b.correct_authors AS correct, b.status, b.confidence, {normal('u.r.t')} AS a, {normal('b.matched_title')} AS b FROM u JOIN b USING (doc_id, key)),
j1 AS (SELECT *, {surnames('cited')} AS sa, {surnames('correct')} AS sb FROM j0),
j2 AS (SELECT *, {overlap('cited', 'correct')} AS o FROM j1),
{similar('j2', 'j3', "o < 0.3 AND status IN ('verified', 'partial_match')")},
w AS (SELECT j2.doc_id, j2.key, CASE WHEN j3.sim >= 0.5 THEN 'FAKE' WHEN j3.sim IS NOT NULL THEN 'SUSPICIOUS' WHEN j2.o >= 0.7 AND j2.status = 'verified' THEN 'REAL' WHEN j2.status = 'verified' THEN 'REAL' ELSE 'SUSPICIOUS' END AS verdict,
 CASE WHEN j3.sim >= 0.5 THEN round_even(1 - j2.o, 2) WHEN j3.sim IS NOT NULL THEN 0.45 WHEN j2.o >= 0.7 AND j2.status = 'verified' THEN least(1.0, 0.8 + 0.2::DOUBLE * j2.o) ELSE coalesce(j2.confidence, 0.5) END AS confidence
 FROM j2 LEFT JOIN j3 ON j2.doc_id = j3.doc_id AND j2.key = j3.key)"""
CLASSES = f"""n AS (SELECT doc_id, key, r.t AS title, {normal('r.t')} AS t FROM u),
c AS (SELECT doc_id, t, min(key) AS k, max(key) AS z, arg_min(title, key) AS title, arg_max(title, key) AS last, count(*) AS n FROM n WHERE t <> '' GROUP BY doc_id, t),
p0 AS (SELECT x.doc_id, x.t AS a, y.t AS b, x.n AS na, y.n AS nb, x.k AS ka, y.k AS kb, x.title AS ta, y.title AS tb FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.t < y.t),
{similar('p0', 'p1', 'cheap >= 0.85 OR most >= 0.85')}, p AS (SELECT * FROM p1 WHERE sim >= 0.85)"""
CROSS = """x AS (SELECT coalesce(c.doc_id, b.doc_id) doc_id, coalesce(c.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN c.key IS NULL THEN 'orphan' ELSE 'ok' END AS class
 FROM (SELECT DISTINCT doc_id, key FROM citations) c FULL OUTER JOIN (SELECT DISTINCT doc_id, key FROM e) b ON c.doc_id = b.doc_id AND c.key = b.key)"""
KIND = "CASE WHEN entry_type IN ('book','article','proceedings','inproceedings','website','misc') THEN entry_type ELSE 'unknown' END"
MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN coalesce({f}, '') = '' AND {KIND} IN ({', '.join(repr(k) for k, v in validate.REQUIRED.items() if f in v.split())}) THEN '{f}' END" for f in ("authors", "title", "publisher", "journal", "booktitle", "url", "urldate", "year", "pages")
) + "], lambda x: x IS NOT NULL)"
SHAPE = r"^([A-Za-z]+)(\d{2})([a-z])?$"
KEY_NAMES = f"list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: lower({strip('string_split(' + strip('a') + ', chr(44))[1]')})), lambda a: a <> '')"
KEY_LETTERS = f"lower(regexp_extract(key, '{SHAPE}', 1))"
_fits = lambda f: f"(starts_with({KEY_LETTERS}, {f}) OR starts_with({f}, {KEY_LETTERS}))"
YEAR_OK = f"CASE WHEN coalesce(year, '') <> '' THEN right(year, 2) = regexp_extract(key, '{SHAPE}', 2) END"
INITIALS_OK = f"CASE WHEN len(kn) > 0 THEN {_fits('kn[1][1:2]')} OR (len(kn) >= 2 AND {_fits(chr(40) + 'array_to_string(list_transform(kn[1:3], lambda s: s[1:1]), chr(0))' + chr(41)).replace('chr(0)', chr(39) * 2)}) END"
KEY_OK = f"CASE WHEN regexp_matches(key, '{SHAPE}') THEN CASE WHEN ({YEAR_OK}) IS NULL AND ({INITIALS_OK}) IS NULL THEN NULL ELSE coalesce({YEAR_OK}, true) AND coalesce({INITIALS_OK}, true) END END"
_pages = lambda g: rf"TRY_CAST(nullif(regexp_extract(pages, '(\d+)\s*[-–—]+\s*(\d+)', {g}), '') AS BIGINT)"


def tags(this_year: int) -> str:
    """CTE ``g``: entries with their issues."""
    key = f"CASE WHEN NOT regexp_matches(key, '{SHAPE}') THEN 'key:format' WHEN length(regexp_extract(key, '{SHAPE}', 1)) NOT BETWEEN 2 AND 6 THEN 'key:initials' END"
    order = rf"CASE WHEN len(list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda a: {strip('a')}), lambda a: regexp_matches(a, '^[A-ZÄÖÜ][a-zäöüß]{{2,}}\s+[A-ZÄÖÜ][a-zäöüß]{{2,}}$'))) > 0 THEN 'authors:order' END"
    rest = f"""CASE WHEN regexp_matches(pages, '\\d-\\d') AND NOT contains(pages, '--') THEN 'pages:dash' END, {order}, CASE WHEN regexp_matches(trim(year), '^[+-]?\\d+$') AND TRY_CAST(trim(year) AS BIGINT) > {this_year + 1} THEN 'year:future' END,
 CASE WHEN {_pages(2)} - {_pages(1)} > 200 THEN 'pages:span' END, CASE WHEN NOT ({KEY_OK}) THEN 'key:inconsistent' END"""
    return f"g0 AS (SELECT *, {KEY_NAMES} AS kn FROM e), g AS (SELECT *, list_filter(list_concat(list_concat([{key}], list_transform({MISSING}, lambda m: 'missing:' || m)), [{rest}]), lambda q: q IS NOT NULL) AS issues FROM g0)"


def style(text: str, name: str, source: str) -> str:
    """CTE ``name``: documents of ``source`` with the number of style rules that hit, and the hits of each rule."""
    # a mark that must not stand before is matched along, and such matches are left out
    flat = [f"len(list_filter(regexp_extract_all({text}, '{_re2(p, ci)}'), lambda q: NOT starts_with(q, '`')))" for _, p, ci in X.STYLE_RULES]
    mixed = rf"CASE WHEN regexp_matches({text}, '\[[A-Za-z]{{2,6}}\d{{2}}\]') THEN len(regexp_extract_all({text}, '\[\d{{1,3}}\]')) ELSE 0 END"
    names = [n for n, _, _ in X.STYLE_RULES] + ["CitationStyle"]
    rows = ", ".join(f"{{'rule': '{n}', 'n': {q}}}" for n, q in zip(names, [*flat, mixed], strict=True))
    return f"{name} AS (SELECT doc_id, list_filter([{rows}], lambda r: r.n > 0) AS hits FROM {source})"


def _re2(pattern: str, ignore_case: bool) -> str:
    r"""A style rule in RE2: no look-behind, and \w and \b over all letters."""
    letter = r"[\p{L}\p{N}\p{M}\p{Pc}]"
    p = pattern.replace("(?U)", "").replace('(?<!`)"', '`"|"').replace(r"\w", letter)
    p = p.replace(r"\b", r"(?:^|[^\p{L}\p{N}\p{M}\p{Pc}])", 1) if p.startswith(r"\b") else p
    return ("(?i)" if ignore_case else "") + p.replace("'", "''")


def clean(x: str) -> str:
    """LaTeX source as body text. RE2 has no back references, so each environment has its own pattern."""
    floats = "|".join(rf"\\begin\{{{f}[^}}]*\}}.*?\\end\{{{f}\}}" for f in sections.FLOATS.split("|"))
    for pattern, by in (
        (r"%[^\n]*", ""), (f"(?s){floats}", ""), (rf"\\(?:{sections.UNWRAP})\{{([^}}]*)\}}", r"\1"), (r"\\[a-zA-Z]+\*?\{[^}]*\}", ""), (r"\\[a-zA-Z]+\*?", ""), (r"[{}]", ""), (SPACE + "+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return strip(x)


def summary(this_year: int) -> str:
    """CTEs that end in ``s``: a row of counters for each paper."""
    return f"""{E}, {V}, {CROSS}, {tags(this_year)}, {UNIQUE}, {SCREEN}, {CLASSES}, {style('body', 'st', f"(SELECT doc_id, {clean('text')} AS body FROM documents)")},
s1 AS (SELECT doc_id, count(*) FILTER (class = 'missing') AS n_missing, count(*) FILTER (class = 'orphan') AS n_orphan, count(*) FILTER (class = 'ok') AS n_ok FROM x GROUP BY doc_id),
s2 AS (SELECT doc_id, count(*) AS n_entries, count(*) FILTER (len(issues) > 0) AS n_incomplete, count(*) FILTER (len(list_filter(issues, lambda q: contains(q, 'key'))) > 0) AS n_key_issues FROM g GROUP BY doc_id),
s3 AS (SELECT doc_id, CAST(sum(q) AS BIGINT) AS n_duplicates FROM (SELECT doc_id, n * (n - 1) // 2 AS q FROM c WHERE n > 1 UNION ALL SELECT doc_id, na * nb FROM p) GROUP BY doc_id),
s4 AS (SELECT doc_id, count(*) FILTER (verdict = 'FAKE') AS n_fake, count(*) FILTER (verdict = 'SUSPICIOUS') AS n_suspicious, count(*) FILTER (verdict NOT IN ('FAKE', 'SUSPICIOUS')) AS n_real FROM w GROUP BY doc_id),
s AS (SELECT coalesce(s1.doc_id, s2.doc_id) AS doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in COUNTERS if n != 'n_style')}, CAST(coalesce(len(st.hits), 0) AS INT) AS n_style
 FROM s1 FULL OUTER JOIN s2 ON s1.doc_id = s2.doc_id LEFT JOIN s3 ON s3.doc_id = coalesce(s1.doc_id, s2.doc_id) LEFT JOIN s4 ON s4.doc_id = coalesce(s1.doc_id, s2.doc_id) LEFT JOIN st ON st.doc_id = coalesce(s1.doc_id, s2.doc_id)),
f AS (SELECT *, {GRADE} AS grade FROM (SELECT *, {SCORE} AS score FROM s)), fb AS (SELECT *, {GRADE} AS grade FROM (SELECT *, {FALLBACK} AS score FROM s))"""


COUNTERS = "n_missing n_orphan n_ok n_entries n_incomplete n_key_issues n_duplicates n_fake n_suspicious n_real n_style".split()
_lost = lambda rules: " - ".join(f"least({c} * {w}, {m})" for c, w, m in rules)
SCORE = f"CAST(greatest(100 - {_lost(verdict.PENALTIES)}, 0) AS INT)"
FALLBACK = f"CAST(greatest(100 - {_lost(verdict.FALLBACK)}, 0) AS INT)"
GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END"


BS = chr(92)


def parsed() -> str:
    """Entries of the table parsed from what they print: type, identifiers, authors, year, pages, volume and number."""
    from refloom.operators import entries as P

    def re2(p: str) -> str:
        p = p.replace("(?iuU)", "(?i)").replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")
        out, inside = "", False
        for part in re.split(r"(\\.|[\[\]])", p):
            inside = part == "[" or inside and part != "]"
            out += (SPACE[1:-1] if inside else SPACE) if part == BS + "s" else part
        return out

    first = lambda x, p, g=1: f"nullif(regexp_extract({x}, '{re2(p)}', {g}), '')"
    word = r"[A-ZÄÖÜ][a-zäöüß\-]+"
    strict = rf"^(?:{word}(?:,{SPACE}*[A-Za-zÄÖÜäöüß\.\-{SPACE[1:-1]}]+)?(?:;{SPACE}*)?)+$"
    return rf"""WITH {E}, a AS (SELECT entry_id, coalesce(raw_text, '') AS r FROM e), b AS (SELECT *, {first('r', '(https?://' + BS + 'S+|www' + BS + '.' + BS + 'S+)')} AS u, instr(r, ':') - 1 AS n, string_split(r, ':')[1] AS head FROM a),
 c AS (SELECT *, CASE WHEN u IS NOT NULL THEN 'website' WHEN regexp_matches(r, '{re2(P.VOLUME)}') OR regexp_matches(r, '{re2(P.JOURNAL)}') THEN 'article' WHEN regexp_matches(r, '{re2(P.PROCEEDINGS)}') THEN 'proceedings' WHEN regexp_matches(r, '{re2(P.PUBLISHER)}') THEN 'book' ELSE 'unknown' END AS entry_type,
 CASE WHEN u IS NULL AND n > 0 AND (n < 180 AND regexp_matches(head, '{strict}') OR n < 120 AND regexp_matches(head, '^{word}')) THEN {strip('head')} END AS authors FROM b),
 d AS (SELECT *, CASE WHEN u IS NOT NULL THEN '' WHEN authors IS NOT NULL THEN {strip('substr(r, n + 2)')} ELSE r END AS rest FROM c)
 SELECT entry_id, entry_type, authors, {first('rest', BS + 'b((?:19|20)' + BS + 'd{2})' + BS + 'b')} AS year, replace({first('rest', P.PAGES)}, ' ', '') AS pages, {first('rest', P.VOLUME_OF)} AS volume, {first('rest', P.NUMBER_OF)} AS number,
 rtrim({first('r', P.DOI)}, '.') AS doi, regexp_replace({first('r', P.ISBN)}, '[-{SPACE[1:-1]}]', '', 'g') AS isbn, rtrim(u, '.,;)') AS url, CASE WHEN u IS NOT NULL THEN {first('r', P.URLDATE)} END AS urldate FROM d"""


def lookups() -> str:
    """CTEs that end in ``res``: recorded results of each entry and source, scored by the source's rules."""
    from refloom.operators.lookup import BEST_OF, EXACT, SOURCES

    n = len(SOURCES)
    exact_status = " ".join(f"WHEN source = '{k}' AND http_status = 200 THEN CASE WHEN sim2 >= {f} THEN 'verified' ELSE 'partial_match' END" for k, (_, f) in EXACT.items())
    exact_conf = " ".join(f"WHEN source = '{k}' AND http_status = 200 THEN greatest(sim2, {m})" for k, (m, _) in EXACT.items())
    best = "source IN (" + ", ".join(map(repr, BEST_OF)) + ")"
    first = f"lower({strip('string_split(string_split(cited_authors, chr(59))[1], chr(44))[1]')})"
    return f"""{E}, {V}, le AS (SELECT doc_id, key, max_by({{'t': title, 'a': authors, 'u': url, 'd': doi, 'i': isbn, 'k': entry_type}}, ord) AS r FROM e GROUP BY doc_id, key),
lh AS (SELECT *, {SOURCES!r}[(((verification_id % {n}) + {n}) % {n}) + 1] AS source, CASE status WHEN 'error' THEN 500 WHEN 'not_found' THEN 404 ELSE 200 END AS http_status, lower(concat_ws(' ', matched_title, correct_authors)) AS snippet,
 row_number() OVER (PARTITION BY doc_id, key, verification_id % {n} ORDER BY verification_id) AS hit_rank FROM v),
lj AS (SELECT le.doc_id, le.key, r.t AS cited, r.a AS cited_authors, r.u AS url, coalesce(r.k, '') AS kind, coalesce(r.t, '') = '' AND coalesce(r.d, '') = '' AND coalesce(r.i, '') = '' AS nothing,
 lh.source, lh.hit_rank, lh.http_status, lh.matched_title, lh.correct_authors, lh.doi, lh.open_access_url, lh.snippet, {normal('r.t')} AS a, {normal('lh.matched_title')} AS b FROM le JOIN lh ON le.doc_id = lh.doc_id AND le.key = lh.key),
lt0 AS (SELECT * FROM lj WHERE kind <> 'website' AND NOT nothing AND source NOT IN ('web', 'repository', 'url')),
{similar('lt0', 'lt1', 'true')},
lt2 AS (SELECT * FROM lt1 QUALIFY row_number() OVER (PARTITION BY doc_id, key, source ORDER BY CASE WHEN {best} THEN -sim ELSE 0.0 END, hit_rank) = 1),
lt3 AS (SELECT *, CASE WHEN source = 'open_library' AND coalesce(cited_authors, '') <> '' AND coalesce(correct_authors, '') <> '' AND sim >= 0.5 AND NOT contains(lower(correct_authors), {first}) THEN greatest(0.0, sim - 0.15) WHEN {best} THEN round_even(sim, 2) ELSE sim END AS sim2 FROM lt2),
lw AS (SELECT doc_id, key, any_value(cited) AS cited, max(http_status) AS http_status, string_agg(snippet, ' ' ORDER BY hit_rank) AS s, arg_min(snippet, hit_rank) AS s1 FROM lj WHERE source = 'web' AND hit_rank <= 3 AND kind <> 'website' AND NOT nothing GROUP BY doc_id, key),
lw1 AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(cited, '')), '{SPACE}+'), lambda q: length(q) > 3)) AS ws FROM lw),
lw2 AS (SELECT *, CASE WHEN len(ws) > 0 THEN round_even(len(list_filter(ws, lambda q: contains(lower(coalesce(s, '')), q))) / len(ws), 4) ELSE 0.0 END AS c FROM lw1),
la AS (SELECT doc_id, key, source, url, CASE WHEN http_status = 500 THEN 'error' WHEN http_status < 400 THEN 'verified' ELSE 'not_found' END AS status FROM lj WHERE kind = 'website' AND hit_rank = 1 AND (source = 'url' OR source = 'repository' AND regexp_matches(rtrim(url, '/'), '^https?://github\\.com/[^/\\s]+/[^/\\s#?]+'))),
res AS (SELECT doc_id, key, source, CASE WHEN http_status >= 400 THEN 'error' WHEN matched_title IS NULL AND source NOT IN ({', '.join(map(repr, EXACT))}) THEN 'not_found' {exact_status} WHEN sim2 >= 0.75 THEN 'verified' WHEN sim2 >= 0.4 THEN 'partial_match' ELSE 'not_found' END AS status,
 CASE WHEN http_status >= 400 OR matched_title IS NULL AND source NOT IN ({', '.join(map(repr, EXACT))}) THEN 0.0 {exact_conf} ELSE sim2 END AS confidence, matched_title, open_access_url, NULL::VARCHAR AS web_evidence FROM lt3
 UNION ALL SELECT doc_id, key, 'web', CASE WHEN http_status <> 200 THEN 'error' WHEN c >= 0.85 THEN 'verified' WHEN c >= 0.7 THEN 'partial_match' ELSE 'not_found' END, CASE WHEN http_status <> 200 THEN 0.0 ELSE round_even(c, 2) END, NULL, NULL, CASE WHEN http_status = 200 AND c >= 0.7 THEN substr(s1, 1, 150) END FROM lw2
 UNION ALL SELECT doc_id, key, source, status, CASE WHEN status = 'verified' THEN 1.0 ELSE 0.0 END, NULL, CASE WHEN status = 'verified' THEN url END, NULL FROM la
 UNION ALL SELECT doc_id, key, 'none', 'error', 0.0, NULL, NULL, NULL FROM le WHERE coalesce(r.k, '') <> 'website' AND coalesce(r.t, '') = '' AND coalesce(r.d, '') = '' AND coalesce(r.i, '') = '')"""


def sql(this_year: int) -> dict[str, str]:
    """Query name -> SQL."""
    base = f"WITH {E}, {V}, {UNIQUE}"
    whole = f"WITH {summary(this_year)}"
    deductions = ", ".join(f"{{'category': '{c}', 'n': {c}, 'd': least({c} * {w}, {m})}}" for c, w, m in verdict.PENALTIES)
    from refloom.operators.lookup import SOURCES

    rank = "row_number() OVER (PARTITION BY doc_id, key ORDER BY CASE status WHEN 'verified' THEN 3 WHEN 'partial_match' THEN 2 WHEN 'not_found' THEN 1 ELSE 0 END DESC, confidence DESC, coalesce(list_position(" + repr(SOURCES) + ", source), 99))"
    hash_ = rf"""substr(sha256({strip(f"regexp_replace(regexp_replace(lower(title), '[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{SPACE[1:-1]}]', '', 'g'), '{SPACE}+', ' ', 'g')")} || '|' || lower({strip("string_split(string_split(coalesce(authors, ''), ';')[1], ',')[1]")})), 1, 24)"""
    listed = lambda c, n: f"coalesce(string_agg(key, ',' ORDER BY key) FILTER (class = '{c}'), '') AS {n}"
    return {
        "real_entry_fields": parsed(),
        "embedded_bibliography": rf"""WITH v AS (SELECT doc_id, regexp_extract(text, '(?s)\\begin\{{thebibliography\}}.*?\\end\{{thebibliography\}}') AS env FROM documents), i AS (SELECT doc_id, unnest(string_split(regexp_replace(env, '(?s)\\end\{{thebibliography\}}$', ''), '\bibitem')[2:]) AS p FROM v WHERE env <> ''),
 k AS (SELECT doc_id, regexp_extract(p, '^\{{(\w+)\}}', 1) AS key, regexp_replace(p, '^\{{\w+\}}', '') AS b FROM i) SELECT doc_id, key, {strip(f"regexp_replace(regexp_replace(regexp_replace(b, '{BS}{BS}[a-zA-Z]+{BS}{{([^}}]*){BS}}}', '{BS}1', 'g'), '[{{}}{BS}{BS}]', '', 'g'), '{SPACE}+', ' ', 'g')")} AS body FROM k WHERE key <> ''""",
        "text_report_lines": f"""{whole}, d AS (SELECT doc_id, list_filter([{deductions}], lambda r: r.d > 0) AS ds FROM f)
 SELECT f.doc_id, concat_ws(chr(10), 'Paper ' || f.doc_id, 'Score ' || score || ' ' || grade, CASE WHEN len(ds) > 0 THEN 'Deductions' || chr(10) || array_to_string(list_transform(ds, lambda x: '  -' || lpad(x.d::VARCHAR, 2, ' ') || ' ' || x.category || ' (' || x.n || ')'), chr(10)) END,
 CASE WHEN n_missing > 0 THEN 'Cited but not listed: ' || n_missing END, CASE WHEN n_orphan > 0 THEN 'Listed but not cited: ' || n_orphan END) AS report FROM f JOIN d ON f.doc_id = d.doc_id""",
        "lookup_results": f"WITH {lookups()} SELECT doc_id, key, source, status, CAST(floor(confidence * 10000 + 0.5) AS BIGINT) AS confidence_e4, matched_title, open_access_url, web_evidence FROM res",
        "lookup_fused": f"""WITH {lookups()}, q AS (SELECT *, {rank} AS o FROM res), z AS (SELECT doc_id, key, arg_min(status, o) AS status, arg_min(confidence, o) AS c0, count(*) AS n_sources, count(*) FILTER (status = 'verified') AS n_verified, string_agg(source, ',' ORDER BY o) AS sources FROM q GROUP BY doc_id, key)
 SELECT doc_id, key, status, CAST(floor((CASE WHEN n_verified >= 2 THEN least(1.0, c0 + 0.05::DOUBLE * (n_verified - 1)) ELSE c0 END) * 10000 + 0.5) AS BIGINT) AS confidence_e4, n_sources, n_verified, sources, CASE WHEN n_verified >= 2 AND status = 'verified' THEN 'Confirmed by ' || n_verified || ' independent sources' END AS note FROM z""",
        "cache_rows": f"WITH {E}, {V}, {BEST}, ue AS (SELECT doc_id, key, r.t AS title, r.a AS authors FROM (SELECT doc_id, key, max_by({{'t': title, 'a': authors}}, ord) AS r FROM e GROUP BY doc_id, key)), uh AS (SELECT doc_id, key, {hash_} AS hash FROM ue WHERE coalesce(title, '') <> ''), q AS (SELECT uh.hash, uh.doc_id, uh.key, b.status, b.confidence FROM uh JOIN b ON uh.doc_id = b.doc_id AND uh.key = b.key) SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id DESC, key DESC) = 1",
        "key_lists": f"WITH {E}, {CROSS} SELECT doc_id, {listed('missing', 'cited_not_in_bib')}, {listed('orphan', 'in_bib_not_cited')}, {listed('ok', 'correctly_used')} FROM x GROUP BY doc_id",
        "all_cited_keys": rf"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[({sections.KEY}(?:,\s*{sections.KEY})*)\]', 1)) AS g FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\\(?:[Cc]ite|[Cc]itet|citep)\{{([^}}]+)\}}', 1)) FROM documents),
 k AS (SELECT doc_id, {strip('k')} AS key FROM (SELECT doc_id, unnest(string_split(g, ',')) AS k FROM g)) SELECT doc_id, key FROM k WHERE key <> '' UNION SELECT doc_id, key FROM citations""",
        "flagged_references": f"{base}, {SCREEN} SELECT doc_id, key, verdict FROM w WHERE verdict IN ('FAKE', 'SUSPICIOUS')",
        "status_metrics": "SELECT count(*) AS results_kept, count(DISTINCT hash) AS hashes_kept, count(*) FILTER (status = 'verified') AS verified_kept FROM verification_cache",
        "prescreen_verdict": f"{base}, {SCREEN} SELECT doc_id, key, verdict, confidence FROM w",
        "verdict_counts": f"{base}, {SCREEN} SELECT doc_id, count(*) FILTER (verdict = 'FAKE') AS n_fake, count(*) FILTER (verdict = 'SUSPICIOUS') AS n_suspicious, count(*) FILTER (verdict NOT IN ('FAKE', 'SUSPICIOUS')) AS n_real FROM w GROUP BY doc_id",
        "verification_overlay": f"{base}, {SCREEN} SELECT coalesce(v.doc_id, w.doc_id) AS doc_id, coalesce(v.key, w.key) AS key, CASE verdict WHEN 'REAL' THEN 'verified' WHEN 'FAKE' THEN 'not_found' WHEN 'SUSPICIOUS' THEN 'partial_match' ELSE v.status END AS status, w.verdict FROM v FULL OUTER JOIN w ON v.doc_id = w.doc_id AND v.key = w.key",
        "duplicate_pairs": f"""WITH {E}, {UNIQUE}, {CLASSES} SELECT doc_id, k AS key_a, z AS key_b, title AS title_a, last AS title_b, 1.0::DOUBLE AS similarity, 'exact' AS "type" FROM c WHERE k <> z
 UNION ALL SELECT doc_id, least(ka, kb), greatest(ka, kb), CASE WHEN ka > kb THEN tb ELSE ta END, CASE WHEN ka > kb THEN ta ELSE tb END, floor(sim * 100 + 0.5) / 100, CASE WHEN sim >= 0.97 THEN 'exact' ELSE 'near-duplicate' END FROM p""",
        "author_overlap": f"""WITH {E}, {V}, j0 AS (SELECT e.doc_id, e.key, verification_id, authors, correct_authors FROM e JOIN v ON e.doc_id = v.doc_id AND e.key = v.key),
 j1 AS (SELECT *, {surnames('authors')} AS sa, {surnames('correct_authors')} AS sb FROM j0) SELECT doc_id, key, verification_id, {overlap('authors', 'correct_authors')} AS overlap FROM j1""",
        "issue_counts": f"WITH {E}, {tags(this_year)}, q AS (SELECT unnest(issues) AS issue FROM g) SELECT issue, count(*) AS n FROM q GROUP BY issue",
        "key_verdicts": f"WITH {E}, {tags(this_year)} SELECT entry_id, {KEY_OK} AS key_ok FROM g",
        "style_counts": f"WITH {style('coalesce(text, chr(0))', 'st', 'documents')}, h AS (SELECT doc_id, unnest(hits) AS h FROM st) SELECT doc_id, h.rule AS rule, CAST(h.n AS INT) AS n FROM h",
        "latex_clean": f"SELECT doc_id, {clean('text')} AS body FROM documents",
        "cache_key_hash": rf"""WITH {E} SELECT entry_id, substr(sha256({strip(f"regexp_replace(regexp_replace(lower(title), '[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{SPACE[1:-1]}]', '', 'g'), '{SPACE}+', ' ', 'g')")} || '|' || lower({strip("string_split(string_split(coalesce(authors, ''), ';')[1], ',')[1]")})), 1, 24) AS hash FROM e WHERE coalesce(title, '') <> ''""",
        "self_citations": rf"""WITH {E}, d AS (SELECT doc_id, list_transform(regexp_extract_all(substr(text, 1, 2000), '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])([A-ZÄÖÜ][a-zäöüß]{{3,}})', 1), lambda w: {folded('w')}) AS ws FROM documents),
 c AS (SELECT e.doc_id, e.key, list_filter(list_transform(regexp_split_to_array(e.authors, '[;,]'), lambda a: {strip('a')}), lambda a: length(a) > 3 AND list_contains(d.ws, {folded('a')})) AS hit FROM e JOIN d ON e.doc_id = d.doc_id WHERE coalesce(e.authors, '') <> '')
 SELECT doc_id, key, hit[1] AS matched_author FROM c WHERE len(hit) > 0""",
        "flagship_paper_score": f"{whole} SELECT doc_id, n_missing, n_orphan, n_incomplete, n_duplicates, n_fake, n_style, score, grade FROM f",
        "paper_summary": f"{whole} SELECT doc_id, {', '.join(COUNTERS)} FROM s",
        "fallback_verdict": f"{whole} SELECT doc_id, score, grade, CASE WHEN n_fake >= 3 OR score < 45 THEN 'FAIL' WHEN n_fake >= 1 OR n_key_issues >= 2 OR score < 75 THEN 'FLAG' ELSE 'PASS' END AS verdict FROM fb",
        "batch_ranking": f"{whole} SELECT doc_id, score FROM f",
        "paper_deductions": f"{whole}, q AS (SELECT doc_id, unnest(list_filter([{deductions}], lambda r: r.d > 0)) AS r FROM f) SELECT doc_id, r.category AS category, CAST(r.n AS BIGINT) AS n, CAST(r.d AS BIGINT) AS deduction FROM q",
    }
