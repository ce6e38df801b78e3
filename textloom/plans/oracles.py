"""DuckDB SQL for the registered queries: an independent statement of each result."""

from __future__ import annotations

from ..functions import rules
from .queries import JUNK, LANGUAGE_WEIGHTS, SCOPES

PATTERN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[\t\x0B\f ]+|\r\n|[\r\n]|[^0-9A-Za-z_\x{80}-\x{10FFFF}\t\x0B\f \r\n]"
BLANK = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def kind(c: str) -> str:
    return (
        f"CASE WHEN {c} BETWEEN 48 AND 57 OR {c} BETWEEN 65 AND 90 OR {c} BETWEEN 97 AND 122 OR {c} = 95 OR {c} > 127 THEN 0 "
        f"WHEN {c} IN (9, 11, 12, 32) THEN 1 WHEN {c} IN (10, 13) THEN 2 ELSE 3 END"
    )


PARTS = f"""
lists AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), {q(PATTERN)}, 0) AS l FROM documents),
flat AS (SELECT doc_id, lang, source, unnest(l) AS value, unnest(range(len(l))) AS i FROM lists),
p AS (SELECT *, {kind('c')} AS kind, length(value) + length(regexp_replace(value, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units
      FROM (SELECT *, unicode(value) AS c FROM flat))"""
OFFSETS = PARTS + """,
po AS (SELECT *, CAST(sum(units) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM p),
o AS (SELECT *, stop - units AS start FROM po)"""
CLASSED = OFFSETS + """,
k AS (SELECT doc_id, i, kind, start, stop,
  CASE WHEN kind IN (1, 2) THEN 'plain' WHEN kind = 3 THEN 'operator' WHEN regexp_matches(value, '[0-9]') THEN 'number'
       WHEN regexp_matches(value, '^[A-Z]') THEN 'type' ELSE 'plain' END AS class,
  CASE WHEN kind IN (1, 2) THEN 15 ELSE i % 16 END AS level FROM o)"""


def fold(start: int, factor: int, mask: int) -> str:
    """A rolling hash over the normalised characters of a word."""
    return (
        f"list_reduce(list_prepend({start}, list_transform(string_split(value, ''), lambda ch: CASE WHEN unicode(ch) > 127 THEN 95 ELSE unicode(ch) END)), "
        f"lambda h, c: (xor(h, c) * {factor}) & {mask})"
    )


def pair_code(a: str, b: str) -> str:
    pairs = ("//", "/*", "*/", "--", "=>", "::", "</", "{{", "${", "}}", "->", "??", "?.", "<>")
    return "CASE " + " ".join(f"WHEN {a} = {ord(x[0])} AND {b} = {ord(x[1])} THEN {k}" for k, x in enumerate(pairs, 1)) + " ELSE 0 END"


def symbol_pair(a: str, b: str, other: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND (kind = 3 OR coalesce({other} = 3, false)) THEN xor(({a} + 1) * 131, {b}) % 31 + 1 ELSE 0 END"


FEATURE_SQL = f"""WITH {PARTS},
b AS (SELECT *, CASE WHEN units > 127 THEN 7 ELSE CAST(floor(log2(units)) AS BIGINT) END AS len_bucket,
  CASE WHEN c > 127 THEN 95 ELSE c END AS fc,
  CASE WHEN unicode(right(value, 1)) > 127 THEN 95 ELSE unicode(right(value, 1)) END AS lc,
  CASE WHEN kind = 0 THEN {fold(197, 147, 255)} ELSE 0 END AS hash8, CASE WHEN kind = 0 THEN {fold(57, 119, 127)} ELSE 0 END AS hash7,
  CASE WHEN kind = 0 THEN regexp_matches(value, '[a-z]')::INT + 2 * regexp_matches(value, '[A-Z]')::INT + 4 * regexp_matches(value, '[0-9]')::INT
    + 8 * regexp_matches(value, '[_\\x{{80}}-\\x{{10FFFF}}]')::INT WHEN kind = 1 THEN 32 * contains(value, chr(9))::INT
    ELSE 64 * (value = chr(92))::INT END AS own FROM p),
w AS (SELECT *, lag(lc) OVER x AS pl, lead(fc) OVER x AS nf, lag(kind) OVER x AS pk, lead(kind) OVER x AS nk,
  last_value(CASE WHEN kind <> 1 THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solid
  FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i % 7 + 1 AS t, len_bucket, fc AS first_char, lc AS last_char, hash8, hash7, own + CASE WHEN coalesce(solid, 2) = 2 THEN 16 ELSE 0 END AS flags,
  {pair_code('pl', 'fc')} AS prev_pair, {pair_code('lc', 'nf')} AS next_pair,
  {symbol_pair('pl', 'fc', 'pk')} AS prev_symbol_pair, {symbol_pair('lc', 'nf', 'nk')} AS next_symbol_pair FROM w)
SELECT doc_id, count(*) AS n_parts, """ + ", ".join(
    f"CAST(sum({x} * t) AS BIGINT) AS {x}"
    for x in ("len_bucket", "first_char", "last_char", "hash8", "hash7", "flags", "prev_pair", "next_pair", "prev_symbol_pair", "next_symbol_pair")
) + " FROM f GROUP BY doc_id"


def depth(name: str, a: str, b: str) -> str:
    return f"sum(CASE WHEN value = '{a}' THEN 1 WHEN value = '{b}' THEN -1 ELSE 0 END) OVER x AS s_{name}"


CONFUSION = f"""{PARTS},
cp AS (SELECT lang, units,
  CASE WHEN kind = 3 THEN 'operator' WHEN regexp_matches(value, '[0-9]') THEN 'number' WHEN regexp_matches(value, '^[A-Z]') THEN 'type' ELSE 'plain' END AS expected,
  CASE WHEN kind = 3 THEN CASE WHEN value IN ('.', ',') THEN 'plain' ELSE 'operator' END WHEN regexp_matches(value, '^[0-9]') THEN 'number' WHEN units > 8 THEN 'type' ELSE 'plain' END AS predicted
  FROM p WHERE kind IN (0, 3)),
m AS (SELECT lang, expected, predicted, CAST(sum(units) AS BIGINT) AS n FROM cp GROUP BY ALL),
sides AS (SELECT lang, expected AS class, n AS support, 0 AS guessed, CASE WHEN expected = predicted THEN n ELSE 0 END AS hits FROM m
  UNION ALL SELECT lang, predicted, 0, n, 0 FROM m),
pc AS (SELECT lang, class, CAST(sum(support) AS BIGINT) AS support, CAST(sum(guessed) AS BIGINT) AS guessed, CAST(sum(hits) AS BIGINT) AS hits FROM sides GROUP BY ALL),
sc AS (SELECT *, CASE WHEN guessed > 0 THEN hits::DOUBLE / guessed ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS re,
  CASE WHEN support + guessed > 0 THEN 2.0::DOUBLE * hits / (support + guessed) ELSE 0 END AS f1 FROM pc)"""

QUALITY = f"""qp AS (SELECT d.doc_id, d.lang, d.source, l.quality AS expected, CAST(NOT regexp_matches(d.text, {q(JUNK)}) AS INT) AS predicted,
  CAST(length(d.text) >= 200 AS INT) AS other FROM documents d JOIN labels l USING (doc_id))"""


def counts(by: str, predicted: str, name: str) -> str:
    return (
        f"{name} AS (SELECT {by} AS family, count(*) AS support, count(*) FILTER (expected <> {predicted}) AS errors, count(*) FILTER (expected = 0) AS plain_support, "
        f"count(*) FILTER (expected = 0 AND {predicted} <> 0) AS false_colors FROM qp GROUP BY 1)"
    )


OBJECTIVE = "obj(family, weight) AS (VALUES " + ", ".join(f"({q(k)}, {v}::DOUBLE)" for k, v in LANGUAGE_WEIGHTS.items()) + ")"
METRICS = f"""{QUALITY}, {counts('lang', 'predicted', 'ct')}, {OBJECTIVE},
lm AS (SELECT coalesce(ct.family, obj.family) AS family, coalesce(weight, 0) AS weight, coalesce(support, 0) AS support,
  errors::DOUBLE / nullif(support, 0) AS error, false_colors::DOUBLE / nullif(plain_support, 0) AS false_color_rate,
  coalesce(weight, 0) > 0 AND coalesce(support, 0) = 0 AS missing, weight IS NULL AND coalesce(support, 0) > 0 AS unknown
  FROM ct FULL JOIN obj ON ct.family = obj.family)"""

TRIM = f"regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), {q('^' + BLANK)}, ''), {q(BLANK + '$')}, '')"
SOLID = f"list_filter(regexp_extract_all(coalesce(text, ''), {q(PATTERN)}, 0), lambda v: ({kind('unicode(v)')}) IN (0, 3))"


def sql_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def first(table: dict, k: int) -> dict[str, str]:
    return {a: b[k] for a, b in table.items()}


SAMPLE_SQL = "lower(coalesce(" + ", ".join(f"nullif(regexp_extract(path, {q(x)}, 1), '')" for x in rules.SAMPLE_PATTERNS) + "))"
PATHS = f"""WITH a AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT *, {SAMPLE_SQL} AS sample, lower(regexp_extract(path, '([^/]*)$', 1)) AS base FROM a),
c AS (SELECT *, regexp_extract(base, '(\\.[^.]*)$', 1) AS ext FROM b),
d AS (SELECT *, {sql_map(rules.LANGUAGE_OF)}[ext] AS by_ext, {sql_map(first(rules.SAMPLES, 0))}[sample] AS s_lang, {sql_map(first(rules.SAMPLES, 1))}[sample] AS s_fam,
  {sql_map(first(rules.NAMED, 0))}[base] AS n_lang, {sql_map(first(rules.NAMED, 1))}[base] AS n_fam FROM c),
e AS (SELECT *, CASE WHEN sample IS NOT NULL AND ext IN ({', '.join(map(q, rules.SHARED))}) THEN NULL ELSE by_ext END AS x_lang FROM d),
f AS (SELECT *, CASE WHEN s_lang IS NOT NULL THEN s_lang WHEN n_lang IS NOT NULL THEN n_lang WHEN ext = '.mk' THEN 'make' WHEN ext = '.dockerfile' THEN 'docker' ELSE x_lang END AS language,
  CASE WHEN s_lang IS NOT NULL THEN s_fam WHEN n_lang IS NOT NULL THEN n_fam WHEN ext = '.mk' THEN 'makefile' WHEN ext = '.dockerfile' THEN 'dockerfile'
    WHEN x_lang IS NULL THEN NULL ELSE coalesce({sql_map(rules.EXTENSION_FAMILIES)}[ext], {sql_map(rules.FAMILIES)}[x_lang], x_lang) END AS family FROM e)
SELECT page_id, language, family,
  CASE WHEN regexp_matches(lower(path), {q(rules.VENDORED[0])}) OR regexp_matches(lower(path), {q(rules.VENDORED[1])}) THEN NULL
    WHEN regexp_matches(lower(path), {q(rules.TESTS)}) THEN 'tests'
    WHEN coalesce(language IN ('markdown', 'mdx'), false) OR regexp_matches(lower(path), {q(rules.DOCUMENTATION)}) THEN 'documentation' ELSE 'author' END AS stratum,
  regexp_matches(lower(path), {q(rules.GENERATED)}) OR regexp_matches(path, '(?:^|/)package-lock\\.json$') AS generated FROM f"""

def construct_test(name: str) -> str:
    tests = [f"regexp_matches(s, {q(rules.CONSTRUCTS[name])})"] if name in rules.CONSTRUCTS else []
    tests += ["lang = 'diff'"] if name == "diff-hunk" else []
    for of, languages, families, pattern in rules.GATED_CONSTRUCTS:
        if of == name:
            tests.append(f"(lang IN ({', '.join(map(q, (*languages, *families)))}) AND regexp_matches(s, {q(pattern)}))")
    return " OR ".join(tests)


CONSTRUCT_SQL = (
    "WITH t AS (SELECT lang, coalesce(text, '') AS s FROM documents UNION ALL "
    "SELECT ['html', 'markdown', 'css', 'common-lisp'][CAST(page_id % 4 + 1 AS INTEGER)], coalesce(html, '') FROM pages) "
) + " UNION ALL ".join(
    f"SELECT lang, {q(name)} AS construct, count(*) AS n_docs FROM t WHERE {construct_test(name)} GROUP BY lang"
    for name in (*rules.CONSTRUCTS, "css-selector", "css-declaration")
)


def some(pattern: str, column: str = "n") -> str:
    if "(?!" in pattern:  # no look-ahead in this dialect: two conditions instead
        plain = pattern.replace(r"(?!\.operator(?:\.|$))", "")
        hit = f"(regexp_matches(s, {q(plain)}) AND NOT regexp_matches(s, '^keyword\\.operator(\\.|$)'))"
        return f"len(list_filter({column}, lambda s: {hit})) > 0"
    return f"len(list_filter({column}, lambda s: regexp_matches(s, {q(pattern)}))) > 0"


SCOPE_SQL = (
    "WITH v(id, scopes) AS (VALUES " + ", ".join(f"({k}::BIGINT, [{', '.join(map(q, s))}])" for k, s in enumerate(SCOPES)) + "), "
    "c AS (SELECT id, list_filter(list_transform(scopes, lambda s: lower(trim(s))), lambda s: s <> '') AS all_s FROM v), "
    f"d AS (SELECT id, all_s, CASE WHEN {some(r'^meta\.(?:embedded|template\.expression)(?:\.|$)', 'all_s')} "
    r"THEN list_filter(all_s, lambda s: NOT regexp_matches(s, '^string\.template(?:\.|$)')) ELSE all_s END AS n FROM c) "
    f"SELECT id, CASE WHEN {some(r'^punctuation\.definition\.template-expression(?:\.|$)', 'all_s')} THEN 'operator' "
    + " ".join(f"WHEN {some(p)} THEN {q(name)}" for name, p in rules.SCOPE_RULES)
    + " ELSE 'plain' END AS class, CAST("
    + " + ".join(f"CASE WHEN {some(p)} THEN {1 << k} ELSE 0 END" for k, p in enumerate(rules.AUXILIARY_RULES))
    + f" AS BIGINT) AS auxiliary, CASE WHEN {some(r'^invalid(?:\.|$)')} THEN 0.25 WHEN len(list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN {some(p)} THEN {q(name)} END" for name, p in rules.SCOPE_RULES)
    + f"], lambda x: x IS NOT NULL))) > 1 THEN 0.5 WHEN {some(r'(?:^|\.)(?:unknown|unparsed|illegal)(?:\.|$)')} THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM d"
)

def wide(start: int, factor: int) -> str:
    """A 32-bit rolling hash over the normalised characters of a word."""
    chars = "list_transform(string_split(value, ''), lambda ch: CASE WHEN unicode(ch) > 127 THEN 95 ELSE unicode(ch) END::BIGINT)"
    return f"list_reduce(list_prepend({start}::BIGINT, {chars}), lambda h, c: CAST((xor(h, c)::HUGEINT * {factor}) % 4294967296 AS BIGINT))"


def voted(name: str, size: int) -> str:
    """Each part's class by windows of ``size`` units that tile the text."""
    return f"""{name}_n AS (SELECT doc_id, i, start, stop, unnest(range(start // {size}, (stop - 1) // {size} + 1)) AS k FROM s),
{name}_v AS (SELECT doc_id, i, {CLASS_LIST}[(k * {size} // 50) % 9 + 1] AS class, min(k) AS k, sum(least(stop, k * {size} + {size}) - greatest(start, k * {size})) AS w FROM {name}_n GROUP BY doc_id, i, 3),
{name} AS (SELECT doc_id, i, class FROM {name}_v QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY w DESC, k) = 1)"""


RAW_TOKENS = r"[A-Za-z_\x{80}-\x{10FFFF}]+|[0-9]+|[-+*/%=!<>&|^~#$\\]+|[^\t-\r A-Za-z_\x{80}-\x{10FFFF}0-9+*/%=!<>&|^~#$\\-]"


def counted(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"


def bucket(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 WHEN {n} * 64 < w THEN 1 WHEN {n} * 64 < w * 3 THEN 2 ELSE 3 END"


BYTES = "list_transform(range(1, strlen(value) + 1), lambda k: CAST('0x' || substr(hex(value), CAST(2 * k - 1 AS INTEGER), 2) AS BIGINT))"
PROFILE = (
    "WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\t-\\r ]+$', '') AS t FROM documents), "
    "pr AS (SELECT doc_id, " + " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(t, '{x}+'), lambda r: length(r) - 1)), 0)" for x in ("/", "-", ":", "\\{"))
    + " + " + " + ".join(f"len(regexp_extract_all(t, '{x}'))" for x in ("/\\*", "=>", "</")) + " AS pairs, len(regexp_extract_all(t, '\\n[ \\t]')) AS indents FROM b), "
    "c AS (SELECT b.doc_id, greatest(1, length(t)) AS w, " + counted("()\\[\\]{}") + " AS brackets, " + counted("<>") + " AS angles, " + counted(";:,.") + " AS separators, "
    + counted("''\"`") + " AS quotes, " + counted("#$@") + " AS sigils, " + counted("\\\\") + " + 2 * coalesce(pairs, 0) AS pairs, "
    + counted("\\n") + " + coalesce(indents, 0) AS layout, " + counted("0-9A-Za-z_") + " AS identifiers FROM b LEFT JOIN pr ON b.doc_id = pr.doc_id), "
    f"tk AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), {q(RAW_TOKENS)}, 0)) AS value FROM documents), "
    "wt AS (SELECT doc_id, value FROM tk WHERE regexp_matches(value, '^[A-Za-z_]')), "
    f"dh AS (SELECT value, list_reduce(list_prepend(2166136261::BIGINT, {BYTES}), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM (SELECT DISTINCT value FROM wt)), "
    "h AS (SELECT doc_id, h FROM wt JOIN dh ON wt.value = dh.value), "
    "v AS (SELECT doc_id, " + ", ".join(f"sum(CASE WHEN (h >> {4 * k}) & 1 = 1 THEN 1 ELSE -1 END) AS v{k}" for k in range(8)) + " FROM h GROUP BY doc_id) "
    "SELECT c.doc_id, " + ", ".join(f"{bucket(n)} AS {n}" for n in ("brackets", "angles", "separators", "quotes", "sigils", "pairs", "layout"))
    + ", CASE WHEN identifiers * 20 < w * 7 THEN 0 WHEN identifiers * 20 < w * 11 THEN 1 WHEN identifiers * 25 < w * 18 THEN 2 ELSE 3 END AS identifiers, "
    + "CAST(" + " + ".join(f"CASE WHEN coalesce(v{k}, 0) > 0 THEN {1 << k} ELSE 0 END" for k in range(8)) + " AS INTEGER) AS sketch FROM c LEFT JOIN v ON c.doc_id = v.doc_id"
)

CLASS_LIST = "[" + ", ".join(map(q, rules.CLASSES)) + "]"

ORACLE_SQL = {
    "part_kind_counts": f"WITH {PARTS} SELECT lang, CAST(kind AS INTEGER) AS kind, count(*) AS n_parts, CAST(sum(units) AS BIGINT) AS n_units FROM p GROUP BY lang, kind",
    "part_features": FEATURE_SQL,
    "nearest_nonspace": f"""WITH {PARTS},
n AS (SELECT doc_id, i, last_value(CASE WHEN kind IN (0, 3) THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN kind IN (0, 3) THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM p)
SELECT doc_id, count(*) AS n_parts, CAST(sum(i - a) AS BIGINT) AS back, CAST(sum(b - i) AS BIGINT) AS ahead, CAST(max(b - i) AS INTEGER) AS widest FROM n GROUP BY doc_id""",
    "nesting_depths": f"""WITH {PARTS},
s AS (SELECT doc_id, i, {depth('curly', '{', '}')}, {depth('round', '(', ')')}, {depth('square', '[', ']')} FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, i, """ + ", ".join(f"s_{n} - least(0, min(s_{n}) OVER (PARTITION BY doc_id ORDER BY i)) AS d_{n}" for n in ("curly", "round", "square")) + """ FROM s),
l AS (SELECT doc_id, """ + ", ".join(f"coalesce(lag(d_{n}) OVER (PARTITION BY doc_id ORDER BY i), 0) AS {n}" for n in ("curly", "round", "square")) + """ FROM d)
SELECT doc_id, CAST(max(curly) AS BIGINT) AS max_curly, CAST(max("round") AS BIGINT) AS max_round, CAST(max(square) AS BIGINT) AS max_square,
  count(*) FILTER (curly > 0 OR "round" > 0 OR square > 0) AS inside FROM l GROUP BY doc_id""".replace("AS round", 'AS "round"'),
    "kind_spans": f"""WITH {CLASSED},
r AS (SELECT *, CASE WHEN lag(class) OVER x = class AND lag(stop) OVER x = start THEN 0 ELSE 1 END AS fresh FROM k WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, run, any_value(class) AS class, min(start) AS a, max(stop) AS b, min(level) + 1 AS conf FROM g GROUP BY doc_id, run)
SELECT doc_id, class, count(*) AS n_spans, CAST(max(b - a) AS BIGINT) AS longest, CAST(sum(conf) AS BIGINT) AS sixteenths FROM s GROUP BY doc_id, class""",
    "kind_spans_lite": f"""WITH {CLASSED},
e AS (SELECT doc_id, max(stop) AS fin, max((kind IN (0, 3))::INT) AS solid FROM k GROUP BY doc_id),
c AS (SELECT *, lag(class) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k WHERE kind IN (0, 3)),
s AS (SELECT doc_id, class, CASE WHEN before IS NULL THEN 0 ELSE start END AS a, lead(start) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c WHERE before IS NULL OR before <> class),
u AS (SELECT s.doc_id, class, a, coalesce(nxt, fin) AS b FROM s JOIN e ON s.doc_id = e.doc_id UNION ALL SELECT doc_id, 'plain', 0, fin FROM e WHERE solid = 0)
SELECT doc_id, class, count(*) AS n_spans, CAST(max(b - a) AS BIGINT) AS longest, CAST(sum(b - a) AS BIGINT) AS units FROM u GROUP BY doc_id, class""",
    "kind_rle": f"""WITH {PARTS},
r AS (SELECT doc_id, i, kind, i // 1024 AS blk, CASE WHEN lag(kind) OVER (PARTITION BY doc_id, i // 1024 ORDER BY i) = kind THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, blk ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, blk, run, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n_runs, max(n) AS longest, count(DISTINCT blk) AS n_blocks FROM s GROUP BY doc_id""",
    "local_profile": f"""WITH {PARTS}, w AS (SELECT doc_id, """ + ", ".join(f"sum((kind = {k})::INT) OVER x AS n{k}" for k in range(4)) + """, sum(units) OVER x AS u FROM p
WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING))
SELECT doc_id, """ + ", ".join(f"CAST(sum(n{k}) AS BIGINT) AS near_{k}" for k in range(4)) + ", CAST(max(u) AS BIGINT) AS most_units FROM w GROUP BY doc_id",
    "align_window_labels": f"""WITH {OFFSETS},
e AS (SELECT doc_id, max(stop) AS fin FROM o GROUP BY doc_id),
lb AS (SELECT doc_id, k, 7 * k AS a, least(7 * k + 5, fin) AS b, {CLASS_LIST}[k % 9 + 1] AS class, CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS conf, k % 16 AS aux
  FROM (SELECT doc_id, fin, unnest(range(0, (fin - 1) // 7 + 1)) AS k FROM e)),
near AS (SELECT doc_id, i, start, stop, unnest(range(greatest(start - 4, 0) // 7, (stop - 1) // 7 + 1)) AS k FROM o),
j AS (SELECT n.doc_id, n.i, stop - start AS n_units, least(stop, b) - greatest(start, a) AS w, class, conf, aux, l.k FROM near n JOIN lb l ON n.doc_id = l.doc_id AND n.k = l.k AND l.a < n.stop AND l.b > n.start),
v AS (SELECT doc_id, i, n_units, class, CAST(sum(w) AS BIGINT) AS w, sum(w * conf) AS wt, min(k) AS k, bit_or(aux) AS aux FROM j GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY w DESC, k) AS rn, CAST(sum(w) OVER (PARTITION BY doc_id, i) AS BIGINT) AS cov, bit_or(aux) OVER (PARTITION BY doc_id, i) AS all_aux FROM v),
x AS (SELECT o.doc_id, o.i, coalesce(r.class, 'plain') AS class, coalesce(all_aux, 0) AS aux,
  CASE WHEN cov IS NULL THEN 0 ELSE floor(255 * greatest(0.25::DOUBLE, (w::DOUBLE / cov) * (wt / w) * (cov::DOUBLE / n_units)) + 0.5) END AS c
  FROM o LEFT JOIN r ON o.doc_id = r.doc_id AND o.i = r.i AND r.rn = 1)
SELECT doc_id, class, count(*) AS n_parts, CAST(sum(c) AS BIGINT) AS confidence, CAST(sum(aux) AS BIGINT) AS auxiliary FROM x GROUP BY doc_id, class""",
    "class_confusion": f"WITH {CONFUSION} SELECT lang, expected, predicted, n FROM m",
    "class_scores": f"WITH {CONFUSION} SELECT lang, class, support, guessed, hits, round(pr, 9) AS precision, round(re, 9) AS recall, round(f1, 9) AS f1 FROM sc",
    "class_overall": f"""WITH {CONFUSION},
a AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN expected = predicted THEN n ELSE 0 END) AS BIGINT) AS correct FROM m GROUP BY lang),
f AS (SELECT lang, sum(f1) / 8 AS macro FROM sc WHERE class <> 'plain' GROUP BY lang)
SELECT a.lang, total, correct, round(correct::DOUBLE / total, 9) AS accuracy, round(macro, 9) AS macro_f1 FROM a JOIN f ON a.lang = f.lang""",
    "confusion_quality": f"WITH {QUALITY} SELECT expected, predicted, count(*) AS n FROM qp GROUP BY expected, predicted",
    "effective_files": "SELECT lang, round(CASE WHEN sum(n_chars::DOUBLE * n_chars) > 0 THEN sum(n_chars)::DOUBLE * sum(n_chars)::DOUBLE / sum(n_chars::DOUBLE * n_chars) ELSE 0 END, 6) AS effective_files FROM documents GROUP BY lang",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lang, {TRIM}",
    "structural_dedup": f"""WITH a AS (SELECT doc_id, lang, {TRIM} AS t, text, {SOLID} AS solid,
    length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS units FROM documents),
x AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lang, t ORDER BY doc_id) AS rn FROM a) WHERE rn = 1),
c AS (SELECT doc_id, lang, units >= 128 AND len(solid) >= 16 AS big,
    regexp_replace(text, '/\\*[\\s\\S]*?\\*/|<!--[\\s\\S]*?-->|(?m:^|\\s)(?://|#)[^\\n]*', ' ', 'g') AS text FROM x),
k AS (SELECT doc_id, lang, big, {SOLID} AS code FROM c),
s AS (SELECT doc_id, big, row_number() OVER (PARTITION BY lang, big, code ORDER BY doc_id) AS rn FROM k)
SELECT doc_id FROM s WHERE NOT coalesce(big, false) OR rn = 1""",
    "reserved_antijoin": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), k AS (SELECT doc_id, {TRIM} AS t FROM l),
r AS (SELECT DISTINCT {TRIM} AS t FROM benchmark)
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT k.doc_id FROM k JOIN r ON k.t = r.t)""",
    "round_robin_limit": """WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source, lang) AS seen FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, seen) AS place FROM a)
SELECT doc_id, source, lang, place FROM b WHERE place <= 20""",
    "balanced_take": """WITH n AS (SELECT ceil(400000 / count(DISTINCT source))::BIGINT AS share FROM documents),
a AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS seen,
  sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents),
w AS (SELECT *, greatest(0, least(n, share - (upto - n))) AS want FROM a, n),
t1 AS (SELECT *, greatest(0, least(want, 400000 - coalesce(sum(want) OVER (ORDER BY turn, seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM w WHERE want > 0),
g AS (SELECT coalesce(sum(take), 0) AS got FROM t1),
u AS (SELECT doc_id, source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t1 WHERE take > 0)),
s AS (SELECT source, min(doc_id) AS seen FROM documents GROUP BY source),
t2 AS (SELECT doc_id, u.source, greatest(0, least(n, 400000 - got - coalesce(sum(n) OVER (ORDER BY turn, seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM u JOIN s ON u.source = s.source, g WHERE n > 0)
SELECT doc_id, source, CAST(take AS BIGINT) AS take FROM t1 WHERE take > 0 UNION ALL SELECT doc_id, source, CAST(take AS BIGINT) FROM t2 WHERE take > 0""",
    "objective_coverage": f"WITH {METRICS} SELECT family, weight, support, round(error, 9) AS error, round(false_color_rate, 9) AS false_color_rate, missing, unknown FROM lm",
    "weighted_error": f"""WITH {METRICS} SELECT NOT bool_or(missing OR unknown) AS complete,
  round(CASE WHEN NOT bool_or(missing OR unknown) THEN sum(CASE WHEN weight > 0 THEN weight * error ELSE 0 END) END, 9) AS weighted_error,
  count(*) FILTER (missing) AS n_missing, count(*) FILTER (unknown) AS n_unknown FROM lm""",
    "guard_decisions": f"""WITH {QUALITY}, {counts('source', 'predicted', 'c')}, {counts('source', 'other', 'b')},
j AS (SELECT coalesce(c.family, b.family) AS family, c.*, b.support AS bs, b.errors AS be, b.plain_support AS bp, b.false_colors AS bf FROM c FULL JOIN b ON c.family = b.family),
u AS (SELECT family, 'error' AS metric, support AS n, bs AS bn, errors AS ck, be AS bk, 10 AS least, 0.02::DOUBLE AS allow FROM j
  UNION ALL SELECT family, 'false_color_rate', plain_support, bp, false_colors, bf, 2, 0.05::DOUBLE FROM j),
r AS (SELECT *, (ck + 1)::DOUBLE / (n + 2) AS pc, (bk + 1)::DOUBLE / (n + 2) AS pb, (ck - bk)::DOUBLE / nullif(n, 0) AS delta FROM u),
t AS (SELECT *, greatest(allow, 1.64::DOUBLE * sqrt((pc * (1 - pc) + pb * (1 - pb)) / nullif(n, 0))) AS tol FROM r)
SELECT family, metric, coalesce(n, 0) AS support, round(delta, 9) AS delta, round(tol, 9) AS tolerance,
  CASE WHEN n IS NULL OR bn IS NULL THEN 'missing metrics' WHEN n <> bn THEN 'support mismatch' WHEN n < least THEN 'insufficient support' WHEN delta > tol THEN 'regression' ELSE 'passed' END AS decision FROM t""",
    "corpus_summary": """WITH a AS (SELECT lang, source, strlen(text) AS b, n_chars AS c FROM documents)
SELECT 'all' AS dimension, '' AS value, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(c) AS BIGINT) AS chars FROM a
UNION ALL SELECT 'lang', lang, count(*), CAST(sum(b) AS BIGINT), CAST(sum(c) AS BIGINT) FROM a GROUP BY lang
UNION ALL SELECT 'source', source, count(*), CAST(sum(b) AS BIGINT), CAST(sum(c) AS BIGINT) FROM a GROUP BY source""",
    "class_weights": f"""WITH {CONFUSION}, c AS (SELECT expected AS class, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1),
r AS (SELECT *, least(4.0::DOUBLE, pow(sum(n) OVER ()::DOUBLE / (count(*) OVER () * greatest(1, n)), 0.5)) AS raw FROM c)
SELECT class, n, round(raw / avg(raw) OVER (), 9) AS weight FROM r""",
    "auxiliary_weights": """WITH m AS (SELECT n_chars % 65536 AS mask FROM documents), b AS (SELECT unnest(range(16)) AS bit),
s AS (SELECT bit, CAST(sum((mask >> bit) & 1) AS BIGINT) AS pos, count(*) AS n FROM m, b GROUP BY bit)
SELECT CAST(bit AS INTEGER) AS bit, pos, round(CASE WHEN pos = 0 OR pos = n THEN 1 ELSE least(8, greatest(1, sqrt((n - pos)::DOUBLE / pos))) END, 9) AS weight FROM s""",
    "page_paths": PATHS,
    "syntax_constructs": CONSTRUCT_SQL,
    "scope_classes": SCOPE_SQL,
    "quantized_embeddings": """WITH a AS (SELECT vec_id, embedding AS v, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS top FROM embeddings),
b AS (SELECT *, CASE WHEN coalesce(top, 0) = 0 THEN 1 ELSE top / 31 END AS scale FROM a)
SELECT vec_id, round(scale, 12) AS scale, array_to_string(list_transform(v, lambda x: CAST(greatest(-31, least(31, floor(CAST(x AS DOUBLE) / scale + 0.5))) AS INTEGER)), ',') AS codes,
  CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS top FROM b""",
    "event_latest": """SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""",
    "texts_in_several_sources": f"SELECT min(doc_id) AS doc_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY {TRIM} HAVING count(DISTINCT source) > 1",
    "replay_factors": """WITH g AS (SELECT source, max(n_chars)::DOUBLE AS top, sum(n_chars)::DOUBLE AS mass, count(*) AS n FROM documents GROUP BY source), w AS (SELECT sum(top) AS tops, sum(n) AS docs FROM g)
SELECT doc_id, round(docs * (top / tops) * (n_chars::DOUBLE / mass), 9) AS factor FROM documents d JOIN g ON d.source = g.source, w""",
    "effective_support": f"""WITH {OBJECTIVE}, g AS (SELECT lang, sum(n_chars) AS n FROM documents GROUP BY lang)
SELECT lang AS family, round(coalesce(weight, 0.1::DOUBLE) * sum(n) OVER () / n, 9) AS importance FROM g LEFT JOIN obj ON family = lang""",
    "lite_word_hashes": f"""WITH {PARTS}, w AS (SELECT value, count(*) AS n FROM p WHERE kind = 0 GROUP BY value),
h AS (SELECT value, n, {wide(2166136261, 16777619)} AS a, {wide(2654435769, 2246822519)} AS b FROM w)
SELECT value, n, CAST(xor(a, a >> 16) & 511 AS INTEGER) AS hash9, CAST(xor(b, b >> 16) & 127 AS INTEGER) AS hash7 FROM h""",
    "span_agreement": f"""WITH {OFFSETS}, s AS (SELECT * FROM o WHERE kind IN (0, 3)), e AS (SELECT doc_id, max(stop) AS fin FROM o GROUP BY doc_id),
{voted('x', 7)}, {voted('y', 11)}
SELECT s.doc_id, count(*) FILTER (x.class = y.class) AS correct, count(*) AS total, count(*) FILTER (x.class = y.class)::DOUBLE / count(*) AS value
FROM s JOIN x ON s.doc_id = x.doc_id AND s.i = x.i JOIN y ON s.doc_id = y.doc_id AND s.i = y.i GROUP BY s.doc_id""",
    "document_profile": PROFILE,
}
