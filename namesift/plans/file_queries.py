"""Queries through sinks and readers: tables written in each format and read again, with SQL over what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.boundary import WordTokenizer
from namesift.functions import imports, prompts
from namesift.operators import classify, masks, metrics, records
from namesift.plans import tables as T
from namesift.plans import twins
from namesift.plans.queries import _RESULTS, _results, query, r6
from namesift.sources import readers, resume, sinks
from namesift.sources.scratch import scratch


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id AS id, source, NULL AS url, md5(text) AS digest FROM documents),
p AS (SELECT row_number() OVER (ORDER BY page_id) - 1 + (SELECT count(*) FROM d) AS row_id, page_id AS id, NULL AS source, url, NULL AS digest FROM pages)
SELECT row_id, id :: VARCHAR AS id, source, url, digest FROM d UNION ALL SELECT row_id, id :: VARCHAR, source, url, digest FROM p""")
def csv_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as ordered CSV files, read back as one with the numbers of their rows; texts with quotes and line ends included."""
    path = scratch(spark, "csv-results")
    sinks.save_ordered(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text"), f"{path}/a_results", ["id"], "csv", files=4)
    sinks.save_ordered(T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), f"{path}/b_results", ["id"], "csv", files=4)
    x = readers.read_results(spark, [f"{path}/a_results", f"{path}/b_results", f"{path}/none"])
    return x.select("row_id", "id", "source", "url", F.md5("text").alias("digest"))


@query("""SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, conv_id, turn, role, md5(text) AS digest FROM conversations""")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as ordered JSON lines, read back with the numbers of their lines."""
    path, c = scratch(spark, "jsonl"), T.table(spark, sf_dir, "conversations")
    sinks.save_ordered(c, path, ["conv_id", "turn"], files=5)
    x = readers.with_row_id(readers.read_jsonl(spark, path, "conv_id LONG, turn INT, role STRING, text STRING"))
    return x.select("row_id", F.col("conv_id").cast(c.schema["conv_id"].dataType), F.col("turn").cast(c.schema["turn"].dataType), "role", F.md5("text").alias("digest"))


@query(f"WITH {twins.records(_RESULTS)} SELECT sample_id, split_type, mode, completion, vs AS chosen, len(valid) :: BIGINT AS n_valid, len(hall) :: BIGINT AS n_hall FROM (SELECT *, CASE WHEN forget THEN 'forget' ELSE 'retain' END AS split_type FROM rec) WHERE split_type = 'forget' AND mode = 2")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines; those of one split and mode read back."""
    path = scratch(spark, "records")
    sinks.save_jsonl(records.extract_records(_results(spark, sf_dir)).drop("row_id"), path)
    x = readers.read_records(spark, path, "forget", (2,))
    return x.select("sample_id", "split_type", "mode", "completion", "chosen", F.size("valid_packages").cast("long").alias("n_valid"), F.size("hallucinated_packages").cast("long").alias("n_hall"))


@query(twins.tokenized(_RESULTS))
def tokenized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records tokenised as they are written; ids and masked labels of one split and mode counted as they are read."""
    path = scratch(spark, "tokenized")
    sinks.save_tokenized(records.extract_records(_results(spark, sf_dir)), path, WordTokenizer())
    x = readers.read_tokenized(spark, path, "forget", (1,))
    return x.select("sample_id", F.size("input_ids").cast("long").alias("n_ids"), F.size(F.filter("labels", lambda i: i == -100)).cast("long").alias("n_masked"))


@query(twins.tri_mask_counts(_RESULTS, "origin"))
def token_level_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token masks in a file of each split, read together; reading checks that arrays fit."""
    path = scratch(spark, "token-level")
    x = masks.tri_mask(records.extract_records(_results(spark, sf_dir)), WordTokenizer(), single_objective_forget=False)
    for mode in ("forget", "retain"):
        sinks.save_jsonl(x.where(F.col("mode") == mode), f"{path}/{mode}")
    return masks.mask_counts(readers.read_token_level(spark, f"{path}/forget", f"{path}/retain"), "origin")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS digest, (doc_id IN (SELECT doc_id FROM labels)) AS before FROM documents""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents in two runs: labelled ones first, then what no finished batch has."""
    path, d = scratch(spark, "run"), T.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = T.table(spark, sf_dir, "labels").select("doc_id").distinct()
    work = lambda x, before: x.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.lit(before).alias("before"))
    resume.append(work(d.join(labels, "doc_id", "left_semi"), True), path, "doc_id")
    resume.append(work(resume.pending(d, path, "doc_id"), False), path, "doc_id")
    return resume.read_finished(spark, path, "doc_id LONG, digest STRING, before BOOLEAN")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{3,}') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS m, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT DISTINCT 'm_' || lower(w[1]) AS name FROM w WHERE len(w) > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT DISTINCT doc_id, 'm_' || lower(m) AS m FROM x WHERE i % 3 <> 0)
SELECT doc_id, count(*) FILTER (replace(m, '_', '-') IN (SELECT replace(name, '_', '-') FROM g)) AS n_valid, count(*) FILTER (replace(m, '_', '-') NOT IN (SELECT replace(name, '_', '-') FROM g)) AS n_hallucinated FROM k GROUP BY doc_id""")
def import_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that the syntax trees of programs import, against a whitelist.

    Every document is a program of all its words: of three, the first is imported at the top as a submodule under
    another name, the second inside a function, the third stands in a text that looks like an import.
    """
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.concat(F.lit("m_"), F.lower(w))).alias("w"))
    def line(w, i):
        return F.when(i % 3 == 0, F.concat(F.lit("import "), w, F.lit(".sub as x"))).when(i % 3 == 1, F.concat(F.lit("def f():\n    from "), w, F.lit(".a.b import (c,\n        d)"))).otherwise(F.concat(F.lit('s = """\nimport '), w, F.lit('\n"""')))

    x = d.withColumn("t", F.array_join(F.transform("w", line), "\n"))
    good = T.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    first = T.table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select(F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("w")).where("w <> ''")
    known = first.select(F.concat(F.lit("m-"), F.lower("w")).alias("name")).distinct()
    x = classify.classify_imports(x.select("doc_id", imports.top_level_imports(F.col("t")).alias("modules")), "doc_id", "modules", known, standard=[])
    return x.select("doc_id", F.size("import_valid").cast("long").alias("n_valid"), F.size("import_hallucinated").cast("long").alias("n_hallucinated")).where("n_valid + n_hallucinated > 0")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of vectors as token losses: their size as loss, their sign and size as mask, a vector's last one as end mark."""
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"), F.size("embedding").alias("n"))
    v = F.col("v").cast("double")
    return e.select("label", F.abs(v).alias("ce"), F.when(v > 0.05, 1).when(v < -0.05, 2).otherwise(0).alias("mask"), (F.col("i") == F.col("n") - 1).alias("is_eos"), (v * v).alias("kl"), F.when(F.col("vec_id") % 2 == 0, "forget").otherwise("retain").alias("split_type"))


_TOKENS = """t AS (SELECT vec_id, label, unnest(embedding) :: DOUBLE AS v, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings),
x AS (SELECT label, abs(v) AS ce, CASE WHEN v > 0.05 THEN 1 WHEN v < -0.05 THEN 2 ELSE 0 END AS mask, i = n AS is_eos, v * v AS kl, vec_id % 2 = 0 AS f FROM t)"""


@query(f"""WITH {_TOKENS}, y AS (SELECT label, coalesce(avg(ce) FILTER (mask = 1 AND NOT is_eos), 0) AS r, coalesce(avg(ce) FILTER (mask = 2), 0) AS f, coalesce(avg(ce) FILTER (mask = 1 AND is_eos), 0) AS e FROM x GROUP BY label)
SELECT label, round(r, 6) AS l_retain, round(f, 6) AS l_forget, round(e, 6) AS l_eos, round(r - 0.5 * f + 2 * e, 6) AS loss FROM y""")
def ascent_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-ascent loss over masked token losses, by label."""
    return metrics.ga_loss(_tokens(spark, sf_dir), by="label").select("label", *(r6(c).alias(c) for c in ("l_retain", "l_forget", "l_eos", "loss")))


@query(f"""WITH {_TOKENS}, y AS (SELECT label, coalesce(avg(ce) FILTER (mask = 1 AND NOT is_eos), 0) AS r, coalesce(0.7 * avg(ln(1 + exp(-0.1 * ce))) FILTER (mask = 2) + 0.3 * avg(kl) FILTER (mask = 2), 0) AS f, coalesce(avg(ce) FILTER (mask = 1 AND is_eos), 0) AS e FROM x GROUP BY label)
SELECT label, round(r, 6) AS l_retain, round(f, 6) AS l_forget, round(e, 6) AS l_eos, round(r + 0.5 * f + 2 * e, 6) AS loss FROM y""")
def preference_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative preference loss over masked token losses with divergences, by label."""
    return metrics.npo_loss(_tokens(spark, sf_dir), by="label").select("label", *(r6(c).alias(c) for c in ("l_retain", "l_forget", "l_eos", "loss")))


@query(f"""WITH {_TOKENS}, y AS (SELECT avg(ce) FILTER (NOT f) AS r, avg(ce) FILTER (f) AS a, 0.7 * avg(ln(1 + exp(-0.1 * ce))) FILTER (f) AS p FROM x)
SELECT 'ascent' AS kind, round(r, 6) AS l_retain, round(a, 6) AS l_forget, round(r - 0.5 * a, 6) AS loss FROM y UNION ALL SELECT 'preference', round(r, 6), round(p, 6), round(r + 0.5 * p, 6) FROM y""")
def plain_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both losses by whole rows, without masks."""
    t = _tokens(spark, sf_dir)
    both = [metrics.plain_loss(t, npo=npo).withColumn("kind", F.lit(kind)) for kind, npo in (("ascent", False), ("preference", True))]
    return both[0].unionByName(both[1]).select("kind", *(r6(c).alias(c) for c in ("l_retain", "l_forget", "loss")))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'y' ELSE text END AS t, 'def f' || doc_id || '():' AS h, text FROM documents)
SELECT doc_id, md5(h || chr(10) || '    pass' || text) AS plain, md5(h || chr(10) || '    pass' || CASE WHEN doc_id % 3 = 0 THEN text || chr(10) ELSE t END) AS made FROM s WHERE NOT contains(text, '```') AND NOT contains(text, 'def f')""")
def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions of answers with and without a fence, after their prompts."""
    head = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("():\n    pass"))
    d = T.table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("```")) & ~F.contains("text", F.lit("def f")))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x\n```python\n"), "text", F.lit("\n```\ny"))).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(prompts.solution(head, F.col("text"))).alias("plain"), F.md5(prompts.solution(head, fenced)).alias("made"))
