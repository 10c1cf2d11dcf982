"""Queries over the driver's tables, each through this engine's operators, with independent SQL for the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.boundary import WordTokenizer
from namesift.functions import imports, lists, packages, prompts, text
from namesift.operators import align, classify, contrastive, masks, metrics, records, report, split, vectors
from namesift.plans import tables as T
from namesift.plans import twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


D, M = f"d AS ({T.DOMAIN})", f"m AS ({T.MENTIONS})"


@query(f"""WITH {M}, g AS ({T.GOOD}), f AS (SELECT source, name IN (SELECT name FROM g) AS ok FROM m)
SELECT coalesce(source, 'Totals') AS source, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS hallucinated,
       round(100.0::DOUBLE * count(*) FILTER (NOT ok) / nullif(count(*), 0), 6) AS rate FROM f GROUP BY GROUPING SETS ((source), ())""")
def hallucination_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and hallucinated mentions of each source and in all, with the rate."""
    # equal names of a source are one row before they are looked up
    named = T.mentions(spark, sf_dir).groupBy("source", "name").agg(F.count("*").alias("n"))
    flagged = classify.flag(named, T.good_names(spark, sf_dir))
    of = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    x = flagged.groupingSets([["source"], []], "source").agg(of(F.col("is_valid")).alias("valid"), of(~F.col("is_valid")).alias("hallucinated"), F.grouping("source").alias("g"))
    return x.select(F.when(F.col("g") == 1, "Totals").otherwise(F.col("source")).alias("source"), "valid", "hallucinated", r6(report.rate(F.col("hallucinated"), F.col("valid"))).alias("rate"))


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[,\\n]')) AS part FROM documents), q AS (SELECT doc_id, part || '_2. X' AS part FROM p)
SELECT doc_id, count(*) AS n, sum(length({T.NAME.format(x="part")})) :: BIGINT AS canonical_chars,
       sum(length(lower(trim(regexp_replace(regexp_replace(part, '[()''"]', '', 'g'), '[-_.]+', '-', 'g'), ' "`.-')))) :: BIGINT AS pip_chars,
       min({T.NAME.format(x="part")}) AS least, count(DISTINCT lower(trim(regexp_replace(regexp_replace(part, '\\d\\. ', '', 'g'), '[-_.]+', '-', 'g'), ' `.-'))) AS legacy_names,
       count(DISTINCT lower(trim(regexp_replace(regexp_replace(part, '^\\d+[.)]\\s*', ''), '[-_.]+', '-', 'g'), ' `.-_"'''))) AS match_names
FROM q GROUP BY doc_id""")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four normalisations over all parts of all texts."""
    p = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[,\n]")).alias("part")).withColumn("part", F.concat("part", F.lit("_2. X")))
    c = F.col("part")
    return p.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length(text.normalize_python_package(c))).alias("canonical_chars"), F.sum(F.length(text.normalize_pip(c))).alias("pip_chars"),
        F.min(text.normalize_python_package(c)).alias("least"), F.count_distinct(text.normalize_python_legacy(c)).alias("legacy_names"), F.count_distinct(text.normalize_package(c)).alias("match_names"),
    )


@query(f"""WITH {M}, g AS ({T.GOOD}), b AS ({T.TOXIC})
SELECT doc_id, count(*) FILTER (name IN (SELECT name FROM g)) AS n_valid, count(*) FILTER (name NOT IN (SELECT name FROM g) AND name NOT IN (SELECT name FROM b)) AS n_hallucinated
FROM m GROUP BY doc_id""")
def classify_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each document against a whitelist and known false positives."""
    d = T.mentions(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    x = classify.check_packages(d, "doc_id", {"names": ("names", "valid", "hallucinated")}, T.good_names(spark, sf_dir), T.toxic_names(spark, sf_dir))
    return x.select("doc_id", F.size("valid").cast("long").alias("n_valid"), F.size("hallucinated").cast("long").alias("n_hallucinated"))


STANDARD = ("the", "that", "and")


def _of_quality(d: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents of quality 1, which the whitelists of these queries come from."""
    return d.join(T.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(rf"""WITH {D}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
i AS (SELECT DISTINCT doc_id, regexp_extract(line, '^(import|from)\s+([A-Za-z_]\w*)', 2) AS mod FROM l WHERE regexp_matches(line, '^import\s+[A-Za-z_]') OR regexp_matches(line, '^from\s+[A-Za-z_][\w.]*\s+import\s')),
{M}, g AS (SELECT DISTINCT lower(w[3]) AS name FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT doc_id, count(*) FILTER (lower(mod) IN (SELECT name FROM g)) AS n_valid, count(*) FILTER (lower(mod) NOT IN (SELECT name FROM g)) AS n_hallucinated
FROM i WHERE mod NOT IN {STANDARD} GROUP BY doc_id""")
def import_like_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that lines of answers import against a whitelist, standard modules passed over."""
    d = T.whole_text(spark, sf_dir)
    known = _of_quality(d, spark, sf_dir).select(F.lower(F.col("w")[2]).alias("name")).distinct()
    x = classify.classify_imports(d.withColumn("modules", imports.imports_by_line(F.col("t"))), "doc_id", "modules", known, standard=list(STANDARD))
    x = x.select("doc_id", F.size("import_valid").cast("long").alias("n_valid"), F.size("import_hallucinated").cast("long").alias("n_hallucinated"))
    return x.where("n_valid + n_hallucinated > 0")


@query(rf"""WITH {D}, p AS (SELECT doc_id, w, list_filter(regexp_extract_all(t, 'pip\s+install\s+(\S+)', 1), lambda x: NOT starts_with(x, '-')) AS raw FROM d),
u AS (SELECT doc_id, unnest(raw) AS x FROM p), n AS (SELECT doc_id, {T.NAME.format(x="regexp_extract(lower(trim(regexp_replace(x, '[-_.]+', '-', 'g'), ' .-')), '^([^=<>!~]+)', 1)")} AS name FROM u),
g AS (SELECT DISTINCT lower(w[1]) AS name FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT p.doc_id, len(raw) :: BIGINT AS n_pip, (SELECT count(*) FROM n WHERE n.doc_id = p.doc_id AND name IN (SELECT name FROM g)) AS n_valid,
       (SELECT count(DISTINCT name) FROM n WHERE n.doc_id = p.doc_id AND name NOT IN (SELECT name FROM g) AND length(name) > 2) AS n_hallucinated FROM p""")
def pip_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Install commands in answers against a whitelist."""
    d = T.whole_text(spark, sf_dir)
    known = _of_quality(d, spark, sf_dir).select(F.lower(F.col("w")[0]).alias("name")).distinct()
    x = classify.pip_numbers(d.withColumnRenamed("t", "Answers"), "doc_id", known)
    return x.select("doc_id", *(F.size(c).cast("long").alias(n) for c, n in (("pip", "n_pip"), ("pip_valid", "n_valid"), ("pip_hallucinated", "n_hallucinated"))))


@query("""WITH c AS (SELECT role, len(string_split(text, ',')) - 1 AS commas, len(regexp_extract_all(text, '\\w+')) AS words FROM conversations),
s AS (SELECT sum(commas) FILTER (role = 'user') AS h1, sum(words) FILTER (role = 'user') AS v1, sum(commas) FILTER (role = 'assistant') AS h2, sum(words) FILTER (role = 'assistant') AS v2, sum(commas) FILTER (role = 'system') AS hp, sum(words) FILTER (role = 'system') AS vp FROM c)
SELECT 'all' AS tag, round(100.0::DOUBLE * (h1 + h2 + coalesce(hp, 0)) / (h1 + h2 + v1 + v2 + coalesce(hp, 0) + coalesce(vp, 0)), 6) AS overall, round(100.0::DOUBLE * hp / nullif(hp + vp, 0), 6) AS install_cmd, round(100.0::DOUBLE * h1 / (h1 + v1), 6) AS nl_query_1, round(100.0::DOUBLE * h2 / (h2 + v2), 6) AS nl_query_2, NULL::DOUBLE AS bare_import FROM s""")
def context_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by context, roles standing for contexts."""
    c = T.table(spark, sf_dir, "conversations").select("role", (F.size(F.split("text", ",", -1)) - 1).alias("h"), F.regexp_count("text", F.lit(r"\w+")).alias("v"))
    of = lambda x, r: F.sum(F.when(F.col("role") == r, F.col(x))).cast("long")
    s = c.agg(*(of(x, r).alias(f"{n}_{k}") for x, n in (("h", "hallucinated"), ("v", "valid")) for r, k in (("user", "1"), ("assistant", "2"))), of("h", "system").alias("pip_hallucinated"), of("v", "system").alias("pip_valid"))
    x = report.context_rates(s.withColumn("tag", F.lit("all")))
    return x.select("tag", *(r6(F.col(k)).alias(k) for k in ("overall", *report.CONTEXTS)))


@query("""WITH s AS (SELECT lang, sum(len(regexp_extract_all(text, '[.]'))) AS h, sum(len(regexp_extract_all(text, ' '))) AS v FROM documents GROUP BY lang),
r AS (SELECT lang, 100.0::DOUBLE * h / (h + v) AS rate FROM s)
SELECT upper(lang) AS "Variant", round(round_even(rate, 2), 2) AS rate, round(round_even(CASE WHEN lang = 'en' THEN 0.0 ELSE (SELECT rate FROM r WHERE lang = 'en') - rate END, 2), 2) AS reduction FROM r WHERE lang IN ('en', 'de', 'fr', 'es')""")
def method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of runs with the reduction against a base run, languages standing for methods."""
    d = T.table(spark, sf_dir, "documents")
    runs = d.groupBy(F.col("lang").alias("tag")).agg(F.sum(F.regexp_count("text", F.lit("[.]"))).alias("hallucinated_1"), F.sum(F.regexp_count("text", F.lit(" "))).alias("valid_1"))
    rates, _ = report.build_report(runs, [(x, x.upper()) for x in ("en", "de", "fr", "es", "xx")], base="en")
    return rates.toDF("Variant", "rate", "reduction")


@query(f"WITH {twins.STRIPPED} SELECT doc_id, cleaned FROM s2")
def strip_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without code blocks."""
    d = T.whole_text(spark, sf_dir)
    return d.select("doc_id", packages.strip_code_blocks(F.col("t")).alias("cleaned"))


@query(f"WITH {D} SELECT doc_id, CASE WHEN contains(t, 'Note:') THEN substr(t, 1, instr(t, 'Note:') - 1) ELSE t END AS cut FROM d")
def prose_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.whole_text(spark, sf_dir).select("doc_id", packages.prose_cut(F.col("t")).alias("cut"))


@query(rf"""WITH {D}, p AS (SELECT doc_id, list_zip(regexp_extract_all(t, '(\d+[.)])\s*[`'']?([a-zA-Z0-9_.-]+)[`'']?', 1), regexp_extract_all(t, '(\d+[.)])\s*[`'']?([a-zA-Z0-9_.-]+)[`'']?', 2)) AS z, t FROM d),
k AS (SELECT doc_id, len(z) AS n, list_filter(z, lambda x: length(x[2]) > 2 AND NOT regexp_matches(regexp_extract(t, regexp_escape(x[1]) || '\s*[`'']?' || regexp_escape(x[2]) || '[`'']?[^\n]*'), '(?i)\bfrom\b|\bclass\b|\bfunction\b')) AS y FROM p)
SELECT doc_id, CASE WHEN n >= 2 AND len(y) >= 2 THEN array_to_string(list_transform(y, lambda x: x[2]), ',') END AS names FROM k""")
def numbered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.whole_text(spark, sf_dir).select("doc_id", F.array_join(packages.numbered(F.col("t")), ",").alias("names"))


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*\d+[.)]\s*', ''), ' ' || chr(9) || chr(13))), lambda x: x <> '') AS f FROM documents),
c AS (SELECT doc_id, text, f, list_filter(range(3, least(20, len(f) // 3) + 1), lambda k: f[1:2 * k] = f[k + 1:3 * k]) AS c FROM l)
SELECT doc_id, coalesce(c[1], 0) :: BIGINT AS cycle FROM c""")
def loop_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length in lines of the cycle a text repeats from its start."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text", packages.loop_start(F.col("text")).alias("at"))
    kept = F.filter(F.split(F.substring("text", F.lit(1), F.col("at")), "\n", -1), lambda x: text.strip(x) != "")
    return d.select("doc_id", F.when(F.col("at") > 0, F.size(kept)).otherwise(0).cast("long").alias("cycle"))


@query(r"""WITH x AS (SELECT doc_id, text AS t, len(text) - len(replace(text, ',', '')) AS c, len(text) - len(replace(text, '.', '')) AS p FROM documents)
SELECT doc_id, NOT (contains(t, '`') OR regexp_matches(t, '(\n|^)\s*\d+[.)]\s+') OR regexp_matches(t, '(\n|^)\s*[-*]\s+') OR (c >= 1 AND p < c // 2 + 1)) AND (length(t) >= 2000 OR (p > 2 * c AND p > 10)) AS rejected FROM x""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", packages.rejected(F.col("text")).alias("rejected"))


@query(f"WITH {D} SELECT doc_id, source, replace(t, chr(13) || chr(10), chr(10)) AS t FROM d")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sanitize(T.whole_text(spark, sf_dir).select("doc_id", "source", "t"))


@query(f"""WITH {D}, s AS (SELECT doc_id, list_filter(w, lambda x, i: i % 3 = 0) AS third, w FROM d)
SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN array_to_string(w, '|') WHEN doc_id % 5 < 4 THEN '' ELSE array_to_string(third, '|') END AS items, CASE WHEN doc_id % 5 < 2 THEN array_to_string(w, ', ') WHEN doc_id % 5 < 4 THEN 'None' ELSE array_to_string(third, ', ') END AS shown FROM s""")
def parse_list_reprs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of all words printed in several ways, read and shown again."""
    d, w = T.whole_text(spark, sf_dir), F.col("w")
    third = F.filter(w, lambda _, k: k % 3 == 2)
    s = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("['"), F.array_join(w, "', '"), F.lit("']"))).when(F.col("doc_id") % 5 == 1, F.concat(F.array_join(w, ", "), F.lit(" ,"))).when(F.col("doc_id") % 5 == 2, "[]").when(F.col("doc_id") % 5 == 3, "nan").otherwise(F.concat(F.lit(' ["'), F.array_join(third, '", "'), F.lit('"] ')))
    a = lists.parse_package_list(s)
    return d.select("doc_id", F.array_join(a, "|").alias("items"), lists.format_packages(a).alias("shown"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as result rows: labelled quality decides which words count as valid and which as hallucinated.

    Answers and lists are made of all words: a place in a list stands for each fourth word from it.
    """
    d = T.whole_text(spark, sf_dir).join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    w, q, x = F.col("w"), F.coalesce("quality", F.lit(-1)), F.coalesce("toxic", F.lit(0))
    some = lambda *i: F.filter("w", lambda _, k: (k % 4).isin(*i))
    part = lambda on, *i: F.when(on, some(*i)).otherwise(lists.empty())
    return d.select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("_source_file"), F.when(F.col("doc_id") % 7 == 0, "nan").otherwise(w[0]).alias("Prompts"), F.concat(F.lit(" "), w[1]).alias("Questions"), F.when(F.col("doc_id") % 11 == 0, " None").otherwise(F.col("t")).alias("Answers"),
        part(q == 1, 0, 1).alias("valid_1"), part(q == 0, 2).alias("hallucinated_1"), part(q >= 0, 3).alias("valid_2"), part(x == 1, 0, 2).alias("hallucinated_2"),
        part(q == 0, 2, 3).alias("Test_1"), lists.empty().alias("Test_2"),
    )


def _some(*i: int) -> str:
    return f"list_filter(w, lambda v, k: (k - 1) % 4 IN ({', '.join(map(str, i))}))"


_RESULTS = f"""{D}, x AS (SELECT d.*, quality AS q, toxic FROM d LEFT JOIN labels USING (doc_id)),
u AS (SELECT doc_id, source, 1 AS mode, t AS content, CASE WHEN q = 1 THEN {_some(0, 1)} ELSE [] END AS valid, CASE WHEN q = 0 THEN {_some(2)} ELSE [] END AS hall, CASE WHEN q = 0 THEN {_some(2, 3)} ELSE [] END AS test FROM x WHERE doc_id % 11 <> 0
      UNION ALL SELECT doc_id, source, 2, CASE WHEN doc_id % 7 = 0 THEN w[2] ELSE w[1] END, CASE WHEN q IS NOT NULL THEN {_some(3)} ELSE [] END, CASE WHEN toxic = 1 THEN {_some(0, 2)} ELSE [] END, [] FROM x)"""


@query(f"WITH {_RESULTS} SELECT doc_id AS row_id, mode, trim(content, ' ' || chr(10)) AS content, len(valid) :: BIGINT AS n_valid, len(hall) :: BIGINT AS n_hall, len(test) :: BIGINT AS n_test FROM u WHERE content <> ''")
def unpivot_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = records.unpivot_modes(_results(spark, sf_dir))
    return x.select("row_id", "mode", "content", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("valid", "hall", "test")))


@query(f"""WITH {_RESULTS}, v AS (SELECT *, CASE WHEN len(valid) > 0 THEN array_to_string(valid, ', ') ELSE 'None' END AS vs, array_to_string(CASE WHEN len(test) > 0 THEN test ELSE list_concat(valid, hall) END, ', ') AS fs FROM u WHERE len(hall) + len(valid) > 0)
SELECT source || '_m' || mode || '_idx' || doc_id AS sample_id, CASE WHEN len(hall) > 0 THEN 'forget' ELSE 'retain' END AS split_type, mode, CASE WHEN len(hall) > 0 THEN fs ELSE vs END AS completion, vs AS chosen, CASE WHEN len(hall) > 0 THEN fs ELSE '' END AS rejected,
       length(CASE mode WHEN 1 THEN '{prompts.PREFIX[1]}' ELSE '{prompts.PREFIX[2]}' END || ' ' || trim(content, ' ' || chr(10))) :: BIGINT AS prompt_chars FROM v""")
def forget_retain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = records.extract_records(_results(spark, sf_dir))
    return x.select("sample_id", "split_type", "mode", "completion", "chosen", "rejected", F.length("user_prompt").cast("long").alias("prompt_chars"))


@query("""WITH k AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'),
c AS (SELECT conv_id FROM k WHERE conv_id NOT IN (SELECT conv_id FROM f)), o AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42|' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM c),
v AS (SELECT conv_id FROM o WHERE n > 1 AND r <= greatest(1, round_even(n * 0.2, 0)))
SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM v) THEN 'val' ELSE 'train' END AS side FROM conversations""")
def prompt_grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns split by conversation; conversations with a system turn stand for those with a forget record."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("sample_id"), F.col("conv_id").cast("string").alias("user_prompt"), F.when(F.col("role") == "system", "forget").otherwise("retain").alias("split_type"))
    return split.split_by_prompt(c, 0.2).select("conv_id", "turn", "side")


@query("""WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id :: VARCHAR) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN r <= 4 THEN 'train' ELSE 'test' END AS side FROM o WHERE r <= 5""")
def seeded_sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("prompt"))
    return split.sample_prompts(d, 5, 0.8, by="source").select("doc_id", "source", "side")


@query("""WITH a AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) <= 8 AS ex FROM labels),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('43|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM a WHERE NOT ex)
SELECT a.doc_id, a.quality, CASE WHEN ex THEN 'exemplar' WHEN k <= floor(0.75 * n) THEN 'wild' ELSE 'test' END AS part FROM a LEFT JOIN r USING (doc_id)""")
def balanced_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.balanced_partition(T.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 16, 0.75).select("doc_id", "quality", "part")


@query("""WITH b AS (SELECT DISTINCT unnest(string_split(text, '.')) AS s FROM benchmark), d AS (SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents)
SELECT doc_id, count(*) AS n FROM d WHERE s NOT IN (SELECT s FROM b) GROUP BY doc_id""")
def leakage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that no benchmark item has."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[.]", -1)).alias("question"))
    b = T.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[.]", -1)).alias("question"))
    return split.without_leaks(d, b).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, source, NULL :: VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return d.unionByName(T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("""SELECT coalesce(d.doc_id, p.page_id, b.item_id) AS row_id, d.source AS "Prompts", md5(p.url) AS "Test_1", md5(b.text) AS "Test_2" FROM documents d FULL JOIN pages p ON p.page_id = d.doc_id FULL JOIN benchmark b ON b.item_id = coalesce(d.doc_id, p.page_id)""")
def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables side by side by row number, the shorter ones filled up with nulls."""
    t = lambda n, k, c: T.table(spark, sf_dir, n).select(F.col(k).alias("row_id"), c.alias("response"))
    code = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("Prompts"))
    return align.merge_prompts_and_packages(code, t("pages", "page_id", F.md5("url")), t("benchmark", "item_id", F.md5("text")))


@query(f"""WITH {D}, p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT doc_id, i - 1 AS position_idx, w[i] AS package_name, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 2)), 0) :: BIGINT AS char_start, (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 2)), 0) + length(w[i])) :: BIGINT AS char_end, lower(w[i]) = lower(w[2]) AS is_hallucinated FROM p""")
def package_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.whole_text(spark, sf_dir).select("doc_id", "w")
    x = d.select("doc_id", F.explode(contrastive.locate(F.col("w"), F.array(F.upper(F.col("w")[1])))).alias("p")).select("doc_id", "p.*")
    return x.select("doc_id", F.col("position_idx").cast("long").alias("position_idx"), "package_name", *(F.col(c).cast("long").alias(c) for c in ("char_start", "char_end")), "is_hallucinated")


@query(twins.tri_mask_counts(_RESULTS))
def tri_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way token masks of records with the stand-in tokenizer, counted by split."""
    x = masks.checked(masks.tri_mask(records.extract_records(_results(spark, sf_dir)), WordTokenizer(), single_objective_forget=False))
    return masks.mask_counts(x, "mode")


@query("""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[.]')) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM documents)
SELECT doc_id, batch_id, (ceil(max(n) OVER (PARTITION BY batch_id) / 8.0) * 8) :: BIGINT AS padded, n :: BIGINT AS n FROM x""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays padded to the longest of their batch of 16, rounded up to 8."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.array_repeat(F.lit(1), F.regexp_count("text", F.lit("[.]"))).alias("input_ids"))
    x = masks.padded(d, 16, key="doc_id")
    return x.select("doc_id", "batch_id", F.size("input_ids").cast("long").alias("padded"), F.size(F.filter("input_ids", lambda i: i == 1)).cast("long").alias("n"))


@query(twins.contrastive(_RESULTS))
def contrastive_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive records with their shuffled variations."""
    x = contrastive.contrastive(records.extract_records(_results(spark, sf_dir)).drop("row_id"))
    return x.select("sample_id", "base_sample_id", "variation_idx", "completion", "answer_matching_behavior", "answer_not_matching_behavior", "part")


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mean_difference(T.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 2 == 0, layer="label", vec="embedding")


_MEANS = """e AS (SELECT label AS layer, vec_id % 2 = 0 AS p, unnest(embedding) :: DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
a AS (SELECT layer, dim, avg(v) FILTER (p) AS pm, avg(v) FILTER (NOT p) AS nm FROM e GROUP BY layer, dim), b AS (SELECT *, pm - nm AS d FROM a)"""


@query(f"WITH {_MEANS} SELECT layer, round(sqrt(sum(d * d)), 6) AS norm, round(sum(pm * nm) / sqrt(sum(pm * pm) * sum(nm * nm)), 6) AS cosine FROM b GROUP BY layer")
def steering_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.layer_stats(_means(spark, sf_dir)).select("layer", r6("norm").alias("norm"), r6("cosine").alias("cosine"))


@query(f"""WITH {_MEANS} SELECT x.layer AS layer_from, y.layer AS layer_to, round(sqrt(sum((y.d - x.d) ** 2)), 6) AS delta_norm, round(sum(x.d * y.d) / sqrt(sum(x.d * x.d) * sum(y.d * y.d)), 6) AS cos_between,
round(sum((y.pm - x.pm) * (y.nm - x.nm)) / sqrt(sum((y.pm - x.pm) ** 2) * sum((y.nm - x.nm) ** 2)), 6) AS cos_hall_vs_val FROM b x JOIN b y ON x.dim = y.dim AND x.layer < y.layer GROUP BY x.layer, y.layer""")
def layer_pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.layer_deltas(_means(spark, sf_dir), "all").select("layer_from", "layer_to", *(r6(c).alias(c) for c in ("delta_norm", "cos_between", "cos_hall_vs_val")))


@query("""WITH s AS (SELECT label AS layer, (vec_id % 3) :: DOUBLE AS multiplier, count(*) AS num_samples, avg((embedding[1] >= embedding[2]) :: INT) AS acc, avg(embedding[1] :: DOUBLE - embedding[2] :: DOUBLE) AS m FROM embeddings GROUP BY 1, 2)
SELECT layer, multiplier, num_samples, round(acc, 6) AS matching_accuracy, round(m, 6) AS mean_margin FROM s ORDER BY acc DESC, m DESC, layer, multiplier LIMIT 1""")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), (F.col("vec_id") % 3).cast("double").alias("multiplier"), F.get("embedding", F.lit(0)).cast("double").alias("matching_score"), F.get("embedding", F.lit(1)).cast("double").alias("not_matching_score"))
    return vectors.best(vectors.sweep(vectors.judge_pairs(e))).select("layer", "multiplier", "num_samples", r6("matching_accuracy").alias("matching_accuracy"), r6("mean_margin").alias("mean_margin"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = F.transform("embedding", lambda v: -F.abs(v.cast("double")))
    return T.table(spark, sf_dir, "embeddings").select("vec_id", "label", lp.alias("log_probs"), F.transform("embedding", lambda v: v > 0).alias("hits"))


_LP = "s AS (SELECT vec_id, label, list_transform(embedding, lambda v: -abs(v :: DOUBLE)) AS lp, embedding FROM embeddings)"


@query(f"""WITH {_LP}, r AS (SELECT *, unnest([0.3, 0.4, 0.5, 0.6, 1.0]) :: DOUBLE AS ratio FROM s)
SELECT vec_id, ratio, round(list_avg(list_sort(lp)[1:floor(ratio * len(lp)) :: INT]), 6) AS min_k FROM r""")
def min_k_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_ratio(_scores(spark, sf_dir)).select("vec_id", "ratio", r6("min_k").alias("min_k"))


@query("""WITH x AS (SELECT n_chars // 100 AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM x)
SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) :: DOUBLE AS auc FROM r""")
def mia_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id").select(F.floor(F.col("n_chars") / 100).alias("s"), "quality")
    return metrics.auc(x, "s", F.col("quality") == 1).select(r6("auc").alias("auc"))


@query(f"""WITH {_LP} SELECT label, round(-sum(list_sum(lp)) / sum(len(lp)), 6) AS nll, round(exp(-sum(list_sum(lp)) / sum(len(lp))), 6) AS ppl, round(100.0 * sum(len(list_filter(embedding, lambda v: v > 0))) / sum(len(lp)), 6) :: DOUBLE AS accuracy FROM s GROUP BY label""")
def token_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_weighted(_scores(spark, sf_dir), hits="hits", by="label").select("label", *(r6(c).alias(c) for c in ("nll", "ppl", "accuracy")))


@query("""WITH t AS (SELECT doc_id AS sample_id, unnest(range(1, 9)) AS i, n_chars FROM documents), x AS (SELECT sample_id, ((sample_id * 7 + i * 13) % 101) / 100.0 :: DOUBLE AS ce, (i * sample_id) % 3 AS mask, i = 8 AS is_eos FROM t)
SELECT round(coalesce(avg(ce) FILTER (mask = 1 AND NOT is_eos), 0), 6) AS l_retain, round(coalesce(avg(ce) FILTER (mask = 2), 0), 6) AS l_forget, round(coalesce(avg(ce) FILTER (mask = 1 AND is_eos), 0), 6) AS l_eos,
round(coalesce(avg(ce) FILTER (mask = 1 AND NOT is_eos), 0) - 0.5 * coalesce(avg(ce) FILTER (mask = 2), 0) + 2.0 * coalesce(avg(ce) FILTER (mask = 1 AND is_eos), 0), 6) AS loss FROM x""")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-ascent loss over masked token losses."""
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("i"))
    x = d.select(((F.col("sample_id") * 7 + F.col("i") * 13) % 101 / F.lit(100.0)).alias("ce"), ((F.col("i") * F.col("sample_id")) % 3).alias("mask"), (F.col("i") == 8).alias("is_eos"))
    return metrics.ga_loss(x).select(*(r6(c).alias(c) for c in ("l_retain", "l_forget", "l_eos", "loss")))


@query("""SELECT conv_id, turn, '<|im_start|>system' || chr(10) || 'be brief<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations WHERE role = 'user'""")
def dpo_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", prompts.chat(prompts.messages(F.lit("be brief"), F.col("text")), "qwen", True).alias("prompt"))


@query(f"WITH {D} SELECT doc_id, CASE WHEN contains(t, '</think>') THEN trim(substr(t, instr(t, '</think>') + 8), ' ') ELSE t END AS answer FROM d")
def reasoning_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.whole_text(spark, sf_dir).select("doc_id", text.after_reasoning(F.col("t")).alias("answer"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), f AS (SELECT doc_id, x, min(i) AS i FROM w WHERE x <> '' GROUP BY doc_id, x)
SELECT doc_id, count(*) AS n, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in the order they first come."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", lists.ordered_distinct(F.split("text", " ", -1)).alias("w")).where(F.size("w") > 0)
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(twins.EXTRACT)
def extract_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in answers by the whole cleaner."""
    x = packages.extract_packages(T.whole_text(spark, sf_dir), "t", "names", packages.Words(frozenset(STANDARD)))
    return x.select("doc_id", F.array_join("names", ",").alias("names"))


@query("""WITH f AS (SELECT doc_id, trim(text, ' ' || chr(10)) AS p FROM documents)
SELECT min(doc_id) AS row_id, md5(p) AS digest, count(*) AS n FROM f WHERE p IS NOT NULL GROUP BY p""")
def unique_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stripped texts with the row they first come in."""
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("Prompts"))
    u = split.unique_prompts(d)
    n = d.select(text.strip(F.col("Prompts")).alias("prompt")).groupBy("prompt").agg(F.count("*").alias("n"))
    return u.join(n, "prompt").select("row_id", F.md5("prompt").alias("digest"), "n")


@query("""SELECT coalesce(source, 'Totals') AS dataset, sum(len(string_split(text, ','))) :: BIGINT AS valid_1, sum(len(string_split(text, '.'))) :: BIGINT AS hallucinated_1 FROM documents GROUP BY GROUPING SETS ((source), ())""")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of list lengths by dataset with a row of totals."""
    d = T.table(spark, sf_dir, "documents").select("source", F.split("text", ",", -1).alias("valid_1"), F.split("text", "[.]", -1).alias("hallucinated_1"))
    return report.list_totals(d, ("valid_1", "hallucinated_1"), by="source")


