"""SQL, for DuckDB, of the similarities and of what is ranked by them: the measures written out again, set by set."""

from __future__ import annotations


def lcs_sql(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence: rows of the usual table, folded."""
    chars = f"list_transform(string_split({a}, ''), lambda c: [ord(c)])"
    cell = f"list_append(done, CASE WHEN ord(substr({b}, j[1], 1)) = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], done[j[1]]) END)"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda k: [k::INTEGER]), lambda done, j: {cell}, [0::INTEGER])"
    table = f"list_reduce({chars}, lambda prev, x: {row}, list_transform(range(0, length({b}) + 1), lambda k: 0::INTEGER))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE ({table})[-1] END"


def token_set_sql(pairs: str, out: str) -> str:
    """Tables that end in ``out`` (a, b, score): the token-set ratio of each pair (a, b) of a table without repeated rows."""
    return f"""{out}_cut AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM {pairs}),
{out}_sets AS (SELECT a, b, list_filter(x, lambda t: list_contains(y, t)) AS both_, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS l,
 array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS r FROM {out}_cut),
{out}_m AS (SELECT *, length(array_to_string(both_, ' ')) AS s, {lcs_sql("l", "r")} AS lcs FROM {out}_sets),
{out}_g AS (SELECT *, CASE WHEN s > 0 THEN 1 ELSE 0 END AS gap, length(l) AS nl, length(r) AS nr FROM {out}_m),
{out} AS (SELECT a, b, CASE WHEN s > 0 AND (l = '' OR r = '') THEN 100.0::DOUBLE
 WHEN s = 0 THEN 100.0 - 100.0::DOUBLE * (nl + nr - 2 * lcs) / (nl + nr)
 ELSE greatest(100.0 - 100.0::DOUBLE * (nl + nr - 2 * lcs) / (2 * (s + gap) + nl + nr), 100.0 - 100.0::DOUBLE * (gap + nl) / (2 * s + gap + nl), 100.0 - 100.0::DOUBLE * (gap + nr) / (2 * s + gap + nr)) END AS score FROM {out}_g)"""


def partial_sql(pairs: str, out: str) -> str:
    """Tables that end in ``out`` (a, b, score): the partial ratio of each pair (a, b), neither empty, of a table without repeated rows."""
    return f"""{out}_p AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM {pairs}),
{out}_i AS (SELECT *, unnest(range(1 - length(short), length(long))) AS i FROM {out}_p),
{out}_w AS (SELECT a, b, short, substr(long, greatest(i, 0) + 1, i + length(short) - greatest(i, 0)) AS w FROM {out}_i),
{out}_s AS (SELECT short, w, 200.0::DOUBLE * {lcs_sql("short", "w")} / (length(short) + length(w)) AS score FROM (SELECT DISTINCT short, w FROM {out}_w)),
{out} AS (SELECT a, b, max(score) AS score FROM {out}_w JOIN {out}_s USING (short, w) GROUP BY a, b)"""


def type_sql(token: str) -> str:
    """The normalised type token."""
    bare = f"lower(trim(regexp_extract(trim(split_part({token}, '[', 1)), '[^.]*$'), ' \"'''))"
    return f"CASE {bare} WHEN 'boolean' THEN 'bool' WHEN 'integer' THEN 'int' WHEN 'string' THEN 'str' WHEN 'nonetype' THEN 'none' WHEN 'object' THEN 'any' WHEN '' THEN 'any' ELSE {bare} END"


def shapes_sql(signatures: str, out: str) -> str:
    """Tables that end in ``out`` (signature, params, returns, hint): the shape of each stored signature, whose brackets nest one deep."""
    return f"""{out}_c AS (SELECT signature, CASE WHEN contains(signature, '->') THEN trim(regexp_extract(signature, '^(.*)->', 1)) ELSE signature END AS head,
 CASE WHEN contains(signature, '->') THEN trim(regexp_extract(signature, '->([^>]*)$', 1)) ELSE '' END AS tail FROM {signatures}),
{out}_l AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(regexp_extract(head, '\\((.*)\\)', 1), '\\[[^\\]]*\\]', '[', 'g'), ','), lambda t: trim(t)), lambda t: t NOT IN ('', '*', '/', 'self', 'cls')) AS parts FROM {out}_c),
{out} AS (SELECT signature, list_transform(parts, lambda t: CASE WHEN starts_with(t, '*') THEN '*' WHEN contains(split_part(t, '=', 1), ':') THEN {type_sql("split_part(split_part(t, '=', 1), ':', 2)")} ELSE 'any' END) AS params,
 CASE WHEN tail = '' THEN 'any' ELSE {type_sql("tail")} END AS returns, tail <> '' AS hint FROM {out}_l)"""


def shape_score_sql(q: str, c: str) -> str:
    """The score of shape ``c``, as columns (params, returns, hint) of a table of that name, for the shape ``q``."""
    match = "CASE WHEN {0} = {1} THEN 1.0 WHEN {0} = 'any' OR {1} = 'any' THEN 0.5 ELSE 0.0 END"
    qn, cn, star = f"len({q}.params)", f"len({c}.params)", f"list_contains({c}.params, '*')"
    arity = f"CASE WHEN {qn} = {cn} THEN 1.0 WHEN {star} AND {qn} >= {cn} - 1 THEN 0.9 ELSE greatest(0.0, 1.0 - abs({qn} - {cn})::DOUBLE / greatest({qn}, {cn}, 1)) END"
    slots = f"coalesce(list_sum(list_transform(range(1, least({qn}, {cn}) + 1), lambda k: {match.format(f'{q}.params[k]', f'{c}.params[k]')})), 0)"
    count = f"(least({qn}, {cn}) + CASE WHEN {star} THEN 0 ELSE greatest({qn} - {cn}, 0) END + {q}.hint::INTEGER)"
    total = f"({slots} + CASE WHEN {q}.hint THEN {match.format(f'{q}.returns', f'{c}.returns')} ELSE 0 END)"
    types = f"CASE WHEN {count} > 0 THEN {total}::DOUBLE / {count} ELSE {arity} END"
    return f"CASE WHEN {qn} = 0 AND NOT {q}.hint THEN 0.0 ELSE round(50.0::DOUBLE * ({arity}) + 50.0::DOUBLE * ({types}), 2) END"


def search_sql(inventory: str, queries: str, name: float, doc: float) -> str:
    """Tables that end in ``hit`` (query, n, d, score, and the record): every record's signals for each row of ``queries`` (a SELECT of query)."""
    return f"""inv AS (SELECT * FROM {inventory}), asked AS ({queries}),
named AS (SELECT DISTINCT query AS a, replace(x, '_', ' ') AS b FROM asked, (SELECT name AS x FROM inv UNION SELECT qualname FROM inv WHERE qualname <> '') u),
summed AS (SELECT DISTINCT query AS a, docstring AS b FROM asked, inv WHERE docstring <> ''),
{token_set_sql("named", "ts")}, {partial_sql("summed", "pr")},
hit AS (SELECT query, inv.*, greatest(own.score, other.score) AS n, pr.score AS d, least(100.0, greatest(greatest(own.score, other.score) * {name}, coalesce(pr.score, 0) * {doc})) AS score
 FROM asked, inv JOIN ts own ON own.a = query AND own.b = replace(name, '_', ' ') JOIN ts other ON other.a = query AND other.b = replace(qualname, '_', ' ') LEFT JOIN pr ON pr.a = query AND pr.b = docstring)"""


def profile_scores_sql(inventory: str, threshold: float) -> str:
    """Tables that end in ``scored`` (an, ad, asig, bn, bd, bsig, score): pairs of profiles that reach the threshold, the left one's shape as the query."""
    return f"""inv AS (SELECT * FROM {inventory}), prof AS (SELECT DISTINCT name, docstring, signature FROM inv),
np AS (SELECT DISTINCT replace(x.name, '_', ' ') AS a, replace(y.name, '_', ' ') AS b FROM prof x, prof y),
{token_set_sql("np", "nt")},
near AS (SELECT x.name AS an, x.docstring AS ad, x.signature AS asig, y.name AS bn, y.docstring AS bd, y.signature AS bsig, nt.score AS n FROM prof x, prof y, nt
 WHERE nt.a = replace(x.name, '_', ' ') AND nt.b = replace(y.name, '_', ' ') AND nt.score >= {2 * threshold - 100.02}),
dp AS (SELECT DISTINCT ad AS a, bd AS b FROM near WHERE ad <> '' AND bd <> ''), {token_set_sql("dp", "dt")},
sg AS (SELECT DISTINCT signature FROM prof), {shapes_sql("sg", "sh")},
st AS (SELECT q.signature AS a, c.signature AS b, {shape_score_sql("q", "c")} AS score FROM sh q, sh c),
scored AS (SELECT * FROM (SELECT an, ad, asig, bn, bd, bsig, round(least(100.0, (n * 0.5 + coalesce(dt.score * 0.3, 0) + CASE WHEN st.score > 0 THEN st.score * 0.2 ELSE 0 END)
 / (0.5 + CASE WHEN dt.score IS NULL THEN 0 ELSE 0.3 END + CASE WHEN st.score > 0 THEN 0.2 ELSE 0 END)), 2) AS score
 FROM near LEFT JOIN dt ON dt.a = ad AND dt.b = bd JOIN st ON st.a = asig AND st.b = bsig) WHERE score >= {threshold})"""
