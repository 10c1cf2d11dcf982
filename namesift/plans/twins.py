"""SQL of the queries that need more than a few lines of it. Written from what the answers look like, not from the operators."""

from __future__ import annotations

from namesift.functions import prompts
from namesift.plans import tables as T

D = f"d AS ({T.DOMAIN})"
TOKEN = r"\w+|[^\w\s]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _ask(mode: str, content: str) -> str:
    """The prompt in the first family's template, up to where the answer begins."""
    head = lambda role: _text(f"<|start_header_id|>{role}<|end_header_id|>\n\n")
    of = lambda d: f"CASE {mode} WHEN 1 THEN {_text(d[1])} ELSE {_text(d[2])} END"
    return f"{head('system')} || {of(prompts.SYSTEM)} || '<|eot_id|>' || {head('user')} || {of(prompts.PREFIX)} || ' ' || trim({content}, ' ' || chr(10)) || '<|eot_id|>' || {head('assistant')}"


def records(results: str) -> str:
    """rec: a row for each record, from u (doc_id, source, mode, content, valid, hall, test)."""
    return f"""{results},
v0 AS (SELECT *, CASE WHEN len(valid) > 0 THEN array_to_string(valid, ', ') ELSE 'None' END AS vs, CASE WHEN len(test) > 0 THEN test ELSE list_concat(valid, hall) END AS names FROM u WHERE content <> '' AND len(hall) + len(valid) > 0),
rec AS (SELECT *, source || '_m' || mode || '_idx' || doc_id AS sample_id, len(hall) > 0 AS forget, CASE WHEN len(hall) > 0 THEN array_to_string(names, ', ') ELSE vs END AS completion,
        len(regexp_extract_all({_ask("mode", "content")}, '{TOKEN}')) AS np FROM v0)"""


def tri_mask_counts(results: str, name: str = "mode") -> str:
    """Answers are words divided by commas, so a token is of a name exactly if it is one, in any letter case."""
    return rf"""WITH {records(results)},
t AS (SELECT forget, np, CASE WHEN forget THEN list_transform(hall, lambda x: lower(x)) ELSE [] END AS h, list_transform(valid, lambda x: lower(x)) AS v,
      list_transform(regexp_extract_all(completion, '{TOKEN}')[1:2047 - np], lambda x: lower(x)) AS r FROM rec WHERE np < 2047),
c AS (SELECT forget, np, len(r) AS n, len(list_filter(r, lambda x: list_contains(h, x))) AS f, len(list_filter(r, lambda x: list_contains(v, x) AND NOT list_contains(h, x))) AS k FROM t)
SELECT CASE WHEN forget THEN 'forget' ELSE 'retain' END AS {name}, sum(np + n - f - k) :: BIGINT AS ignored, sum(k + 1) :: BIGINT AS retain, sum(f) :: BIGINT AS forget FROM c GROUP BY 1"""


def tokenized(results: str) -> str:
    """The whole conversation is the prompt, the answer's tokens and five for its end mark."""
    return rf"""WITH {records(results)},
t AS (SELECT sample_id, np, np + len(regexp_extract_all(completion, '{TOKEN}')) + 5 AS n FROM rec WHERE forget AND mode = 1)
SELECT sample_id, least(n, 2048) :: BIGINT AS n_ids, least(np, 2048) :: BIGINT AS n_masked FROM t"""


def contrastive(results: str, n: int = 3, seed: int = 42) -> str:
    tries = 5 * n
    in_order = lambda x, k: f"list_transform(list_sort(list_transform({x}, lambda x, ix: {{'h': md5(concat_ws('|', '{seed}', sample_id, {k} :: VARCHAR, (ix - 1) :: VARCHAR, x)), 'x': x}})), lambda s: s.x)"
    shown = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, ', ') ELSE 'None' END"
    return rf"""WITH RECURSIVE {records(results)},
own AS (SELECT *, source || '_idx' || doc_id AS grp FROM rec WHERE forget),
g AS (SELECT grp, row_number() OVER (ORDER BY md5('{seed}|' || grp), grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM own)),
o AS (SELECT own.*, CASE WHEN n > 1 AND r <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS part FROM own JOIN g USING (grp)),
k AS (SELECT sample_id, completion, len(names) AS k, CASE WHEN len(names) <= 26 THEN least(len(names), 12) WHEN len(names) <= 1000 THEN 6 ELSE 3 END AS m, {in_order("names", 0)} AS first FROM o WHERE len(names) > 1),
f AS (SELECT *, list_reduce(list_transform(range(0, m), lambda i: (k - i) :: BIGINT), lambda a, b: a * b) AS ways FROM k),
s AS (SELECT *, ('0x' || substr(md5('{seed}|rank|' || sample_id), 1, 15)) :: BIGINT % ways AS start, greatest(1, ways // {tries}) AS step FROM f),
a AS (SELECT *, unnest(range(0, {tries})) AS j FROM s),
q AS (SELECT sample_id, completion, m, first, min(j) AS j, (start + j * step) % ways AS rank FROM a GROUP BY sample_id, completion, m, first, (start + j * step) % ways),
w AS (SELECT sample_id, completion, j, m, 0 AS i, first AS rest, [] :: VARCHAR[] AS done, rank FROM q
      UNION ALL SELECT sample_id, completion, j, m, i + 1, list_concat(rest[1:rank % len(rest)], rest[rank % len(rest) + 2:]), list_append(done, rest[rank % len(rest) + 1]), rank // len(rest) FROM w WHERE i < m),
e AS (SELECT sample_id, completion, array_to_string(list_concat(done, rest), ', ') AS made, min(j) AS j FROM w WHERE i = m GROUP BY ALL),
c AS (SELECT sample_id, made, row_number() OVER (PARTITION BY sample_id ORDER BY j) AS i FROM e WHERE made <> completion)
SELECT sample_id, sample_id AS base_sample_id, 0 AS variation_idx, completion, vs AS answer_matching_behavior, array_to_string(hall, ', ') AS answer_not_matching_behavior, part FROM o
UNION ALL SELECT sample_id || '_shuf' || i, sample_id, i :: INTEGER, made, {shown(in_order("valid", "i"))}, array_to_string({in_order("hall", "i")}, ', '), part FROM c JOIN o USING (sample_id) WHERE i <= {n}"""


#: Answers have no inline code over several lines: what stands between two of their quotes begins with a list number.
STRIPPED = rf"""{D}, s0 AS (SELECT doc_id, t, regexp_extract_all(t, '(?i)pip\s+install\s+[^\n]+') AS pips, regexp_replace(t, '(?s)```\w*\n.*?\n```', chr(10), 'g') AS c FROM d),
s1 AS (SELECT doc_id, pips, CASE WHEN regexp_matches(c, '```\w*\n') THEN substr(c, 1, instr(c, '```') - 1) ELSE c END AS c FROM s0),
s2 AS (SELECT doc_id, CASE WHEN len(pips) > 0 THEN c || chr(10) || array_to_string(pips, chr(10)) ELSE c END AS cleaned FROM s1)"""

_BARE = r"trim(regexp_replace(x, '^\s*\d+[.)]\s*', ''), ' ' || chr(9) || chr(10) || chr(13))"
_ITEM = r"(\d+[.)])\s*[`'']?([a-zA-Z0-9_.-]+)[`'']?"
_NAME = T.NAME.format(x="x")

EXTRACT = rf"""WITH {STRIPPED},
p1 AS (SELECT doc_id, CASE WHEN contains(cleaned, 'Note:') THEN substr(cleaned, 1, instr(cleaned, 'Note:') - 1) ELSE cleaned END AS t FROM s2),
p2 AS (SELECT *, string_split(t, chr(10)) AS l FROM p1),
p3 AS (SELECT *, list_filter(list_transform(l, lambda x: {_BARE}), lambda x: x <> '') AS f, list_filter(range(1, len(l) + 1), lambda i: list_transform([l[i]], lambda x: {_BARE})[1] <> '') AS full_at FROM p2),
p4 AS (SELECT *, list_filter(range(3, least(20, len(f) // 3) + 1), lambda k: f[1:2 * k] = f[k + 1:3 * k])[1] AS cycle FROM p3),
p5 AS (SELECT doc_id, CASE WHEN cycle IS NULL THEN t ELSE substr(t, 1, list_sum(list_transform(l[1:full_at[cycle]], lambda x: length(x) + 1)) :: BIGINT) END AS t FROM p4),
n1 AS (SELECT doc_id, t, list_zip(regexp_extract_all(t, '{_ITEM}', 1), regexp_extract_all(t, '{_ITEM}', 2)) AS z FROM p5),
n2 AS (SELECT doc_id, t, len(z) AS n, list_transform(list_filter(z, lambda x: length(x[2]) > 2 AND NOT regexp_matches(regexp_extract(t, regexp_escape(x[1]) || '\s*[`'']?' || regexp_escape(x[2]) || '[`'']?[^\n]*'), '(?i)\bfrom\b|\bclass\b|\bfunction\b')), lambda x: x[2]) AS y FROM n1),
n3 AS (SELECT doc_id, t, CASE WHEN n >= 2 AND len(y) >= 2 THEN y ELSE string_split(regexp_replace(replace(regexp_replace(t, '\n\d+\.', ',', 'g'), chr(10), ','), '`([a-zA-Z0-9_.-]+)`', ',\1,', 'g'), ',') END AS parts FROM n2),
x1 AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM n3),
x2 AS (SELECT doc_id, i, regexp_replace(regexp_replace(trim(trim(x, ' ' || chr(9) || chr(13)), '.,;:!?''"()[]{{}}'), '^[-*]\s*', ''), '^\d+[.)]\s*', '') AS x FROM x1),
x3 AS (SELECT doc_id, i, regexp_replace(regexp_extract(replace(replace(x, ' and ', ' '), ' or ', ' '), '^\s*(\S+)', 1), '[^a-zA-Z0-9_.-]', '', 'g') AS x FROM x2),
x4 AS (SELECT doc_id, i, x FROM x3 WHERE length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$') AND length(x) - length(replace(x, '.', '')) < 2
  AND lower(x) NOT IN ('the', 'that', 'and') AND NOT (lower(x) IN ('django', 'flask', 'elastic', 'apm', 'new', 'vmware', 'rest', 'framework') AND NOT contains(x, '-'))
  AND NOT (contains(x, '.') AND len(list_filter(string_split(lower(x), '.'), lambda p: p IN ('contrib', 'instrumentation', 'config'))) > 0)
  AND (lower(x) IN ('requests', 'responses', 'attrs', 'datasets', 'datatable') OR NOT (
    regexp_matches(x, '(?i)^.*_(string|data|input|output|result|value|text|file|path|name|var|obj|object|item|list|dict|array|buffer|stream|content|response|request|str|num|int|float|id|idx|key|val|ptr|ref|temp|tmp|flag|bool|char|byte)s?$')
    OR regexp_matches(lower(x), '^(print|get|set|read|write|load|save|fetch|send|receive).') OR ends_with(x, '_') OR ends_with(x, '.')))),
y AS (SELECT doc_id, {_NAME} AS name, min(i) AS i FROM x4 GROUP BY ALL),
z AS (SELECT doc_id, string_agg(name, ',' ORDER BY i) AS names FROM y WHERE name <> '' GROUP BY doc_id),
r AS (SELECT doc_id, t, length(t) - length(replace(t, ',', '')) AS c, length(t) - length(replace(t, '.', '')) AS p FROM p5),
q AS (SELECT doc_id, NOT (contains(t, '`') OR regexp_matches(t, '(\n|^)\s*\d+[.)]\s+') OR regexp_matches(t, '(\n|^)\s*[-*]\s+') OR (c >= 1 AND p < c // 2 + 1))
      AND (length(t) >= 2000 OR (p > 2 * c AND p > 10) OR ((contains(t, 'This command') OR contains(t, 'Here is an example') OR contains(t, 'You can install')) AND NOT regexp_matches(trim(t, ' ' || chr(10)), '[.!?`]$'))) AS rejected FROM r)
SELECT doc_id, CASE WHEN rejected THEN '' ELSE coalesce(names, '') END AS names FROM q LEFT JOIN z USING (doc_id)"""
