"""Queries over the driver's tables, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm import bpe, ctw, fingerprint, lattice, licences, linedup, manifest, mixing, neardup, quality, secrets, topk, whitening
from namesift.llm.common import table


#: Bytes of the longest contexts of op10.
LM_DEPTH = 6


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"), depth=LM_DEPTH)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op7_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, i, line, doc_id * 1000000 + i AS pos, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s FROM l),
g AS (SELECT s, len(s) AS n, min(pos) AS pos FROM k WHERE len(s) > 0 GROUP BY s),
e AS (SELECT pos, n, unnest(s) AS x FROM g),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
p AS (SELECT e.pos, e.n, e.x, row_number() OVER (PARTITION BY e.pos ORDER BY f.df, e.x) AS r FROM e JOIN f USING (x)),
h AS (SELECT * FROM p WHERE r <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.pos AS a, b.pos AS b, a.n AS na, b.n AS nb FROM h a JOIN h b ON a.x = b.x AND a.pos < b.pos AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
m AS (SELECT c.b FROM c JOIN e x ON x.pos = c.a JOIN e y ON y.pos = c.b AND y.x = x.x GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))),
r AS (SELECT doc_id, i, line, len(s) > 0 AND pos NOT IN (SELECT pos FROM g WHERE pos NOT IN (SELECT b FROM m)) AS gone FROM k),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM r GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM t
"""


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) = 1 THEN t
             ELSE list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT x, count(*) AS df FROM e GROUP BY x),
p AS (SELECT e.doc_id, e.n, e.x, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.x) AS k FROM e JOIN f USING (x)),
h AS (SELECT * FROM p WHERE k <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN e x ON x.doc_id = c.a JOIN e y ON y.doc_id = c.b AND y.x = x.x
      GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 80 * (c.na + c.nb - count(*))),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, g.b FROM r JOIN g ON r.y = g.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON m.x = s.doc_id
"""


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.detect(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op2_sql() -> str:
    known = "CASE " + " ".join(f"WHEN regexp_matches(s, {_quoted(k.pattern)}) THEN {_quoted(k.id)}" for k in licences.SENTENCES) + " ELSE '' END"
    steps = []
    for i, r in enumerate(licences.RULES):
        pattern, before = _quoted(" " + " +".join(r.sequence) + " "), f"r{i - 1}" if i else "r_"
        steps.append(
            f"r{i} AS (SELECT k, list_append(found, CASE WHEN regexp_matches(j, {pattern}) THEN {_quoted(r.licence)} END) AS found, "
            f"regexp_replace(j, {pattern}, ' # ', 'g') AS j FROM {before})"
        )
    n = len(licences.RULES)
    end, hint = _quoted(licences.END), _quoted(licences.HINT)
    joined = rf"regexp_replace(regexp_replace(t, {_quoted(licences.WRAPPED)}, ' \1', 'g'), {_quoted(licences.OPEN)}, '\1 \2', 'g')"
    norm = "trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.+-]+', ' ', 'g'), ' .-')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, {joined} AS t FROM d WHERE regexp_matches(t, {hint})),
p AS (SELECT k, unnest(string_split_regex(t, {end})) AS x, generate_subscripts(string_split_regex(t, {end}), 1) AS i FROM w),
q AS (SELECT k, i, {norm} AS s FROM p WHERE regexp_matches(x, {hint})),
c AS (SELECT k, i, {known} AS id FROM q),
g AS (SELECT k, list(id ORDER BY i) AS ids FROM c WHERE id <> '' GROUP BY k),
r_ AS (SELECT k, [] :: VARCHAR[] AS found, ' ' || list_aggregate(ids, 'string_agg', '  ') || ' ' AS j FROM g),
{", ".join(steps)},
u AS (SELECT k, unnest(found) AS l, generate_subscripts(found, 1) AS i FROM r{n - 1}),
f AS (SELECT k, l, min(i) AS i FROM u WHERE l IS NOT NULL GROUP BY k, l),
h AS (SELECT k, string_agg(l, ',' ORDER BY i) AS licences FROM f GROUP BY k)
SELECT d.doc_id, CAST(coalesce(len(g.ids), 0) AS BIGINT) AS n_sentences, coalesce(list_aggregate(g.ids, 'string_agg', ','), '') AS sentence_ids, coalesce(h.licences, '') AS licences
FROM d LEFT JOIN g USING (k) LEFT JOIN h USING (k)
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    scans = " UNION ALL ".join(
        f"SELECT k, {i} AS o, {_quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {_quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) AS v, string_split_regex(t, {_quoted(r.pattern)}) AS g FROM d WHERE regexp_matches(t, {_quoted(r.pattern)})"
        for i, r in enumerate(secrets.RULES)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({scans}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM s),
y AS (SELECT k, o, kind, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS a,
             length(m[i]) AS n FROM x WHERE length(v[i]) >= least),
z AS (SELECT k, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (WHERE o < 3) AS base,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM y GROUP BY k)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (k)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE f(doc_id, source, start, leaf, other) AS (
  SELECT doc_id, source, concat(d, s, l, n), sha256(concat(d, s, l, n, coalesce(strlen(text) || ':' || text, '-'))),
         sha256(concat(d, s, l, n, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')))
  FROM (SELECT *, coalesce(strlen(doc_id :: VARCHAR) || ':' || doc_id, '-') AS d, coalesce(strlen(source) || ':' || source, '-') AS s,
               coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(n_chars :: VARCHAR) || ':' || n_chars, '-') AS n FROM documents)),
c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295 :: BIGINT], list_transform(string_split(doc_id :: VARCHAR, ''), lambda x: ascii(x) :: BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0] :: BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384 :: BIGINT) ELSE x >> 1 END)), 4294967295 :: BIGINT) AS crc FROM f),
leaves AS MATERIALIZED (
  SELECT doc_id, source, leaf, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS own,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM c),
t AS (
  SELECT source, 0 AS lev, r, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, lev + 1, r // 16, sha256(string_agg(h, '' ORDER BY r)), any_value((n + 15) // 16) FROM t WHERE n > 1 GROUP BY source, lev, r // 16),
subs AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lev, r, subroot AS h, n FROM subs
  UNION ALL
  SELECT lev + 1, r // 16, sha256(string_agg(h, '' ORDER BY r)), any_value((n + 15) // 16) FROM u WHERE n > 1 GROUP BY lev, r // 16),
x AS (SELECT source, lev, r // 16 AS run, string_agg(h, '' ORDER BY r) AS hs, any_value(n) AS n FROM t GROUP BY ALL),
y AS (SELECT lev, r // 16 AS run, string_agg(h, '' ORDER BY r) AS hs, any_value(n) AS n FROM u GROUP BY ALL),
w AS (
  SELECT doc_id, source, leaf, r AS pos, 0 AS lev, r, own AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.source, leaf, pos, w.lev + 1, r // 16, sha256(concat(hs[1:64 * (r % 16)], h, hs[64 * (r % 16) + 65:])), concat(proof, hs[1:64 * (r % 16)], hs[64 * (r % 16) + 65:])
  FROM w JOIN x ON w.source IS NOT DISTINCT FROM x.source AND w.lev = x.lev AND w.r // 16 = x.run AND x.n > 1),
p AS (SELECT w.doc_id, w.source, leaf, subroot, pos, h, proof, subs.r FROM w JOIN subs ON w.source IS NOT DISTINCT FROM subs.source
      QUALIFY row_number() OVER (PARTITION BY w.source, pos ORDER BY lev DESC) = 1),
z AS (
  SELECT doc_id, source, pos, leaf, subroot, 0 AS lev, r, h, proof FROM p
  UNION ALL
  SELECT doc_id, source, pos, leaf, subroot, z.lev + 1, r // 16, sha256(concat(hs[1:64 * (r % 16)], h, hs[64 * (r % 16) + 65:])), concat(proof, hs[1:64 * (r % 16)], hs[64 * (r % 16) + 65:])
  FROM z JOIN y ON z.lev = y.lev AND z.r // 16 = y.run AND y.n > 1),
e AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY source, pos ORDER BY lev DESC) = 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM u WHERE n = 1) AS verified FROM e
"""


def op12_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x :: DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON x = vec_id LEFT JOIN n ON a = vec_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_licences": op2_licences,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_fingerprint": op6_fingerprint,
    "op7_linedup": op7_linedup,
    "op8_neardup": op8_neardup,
    "op9_secrets": op9_secrets,
    "op10_lm_score": op10_lm_score,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lattice_neardup": op12_lattice_neardup,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {"op1_topk_search": OP1_SQL, "op7_linedup": OP7_SQL, "op8_neardup": OP8_SQL, "op9_secrets": _op9_sql(), "op2_licences": _op2_sql(), "op11_merkle_manifest": OP11_SQL, "op12_lattice_neardup": OP12_SQL}
