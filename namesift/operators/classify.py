"""Names against a whitelist: valid, hallucinated, or a known false positive.

Lists are unpivoted once, names are joined as rows, and the lists are put together again by row and context. A list of
names is broadcast where the optimizer knows it to have few bytes. Otherwise the join shuffles by name, and names that
hold more than a thousandth of all rows, of which there are fewer than a thousand, are dealt out over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesift.functions import imports, lists, packages
from namesift.functions.text import normalize_pip, normalize_python_package
from namesift.sources.scratch import written

#: Bytes, by the optimizer's estimate, of a list that is broadcast.
BROADCAST_BYTES = 32 << 20
#: A name is hot if it has more than one in so many rows; so fewer names than this are.
HOT = 1000
#: Tasks that the rows of a hot name are dealt out over.
SALTS = 64


def name_list(df: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    """(name): the distinct names of a column."""
    n = F.col(f"`{col}`").cast("string")
    return df.select((normalize_python_package(n) if normalize else n).alias("name")).where("name is not null").distinct()


def _small(names: DataFrame) -> bool:
    """Whether a list has few bytes, by the plan's statistics: no job runs for it."""
    return int(str(names._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def _salted(rows: DataFrame, name: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows with __salt (0 but for hot names), and the hot names (__hot) with all salts; planned, not run here.

    counts (__hot, __n) are made here where they are not given. The salt comes from a row's values and its task, so that
    a task that runs again deals its rows out alike.
    """
    if counts is None:
        counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__hot")).agg(F.count("*").alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).scalar()
    hot = counts.where(F.col("__n") * HOT > total).select("__hot")  # fewer than HOT rows
    plain = [f"`{c}`" for c, t in rows.dtypes if "map<" not in t and t != "variant"]
    salt = F.pmod(F.xxhash64(*plain) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    x = rows.join(F.broadcast(hot), F.col(name) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), salt).otherwise(0)).drop("__hot")
    return x, hot


def _over_salts(names: DataFrame, hot: DataFrame) -> DataFrame:
    """names (l_name and others) with l_salt: 0, and all others too for hot names."""
    x = names.join(F.broadcast(hot), F.col("l_name") == F.col("__hot"), "left")
    return x.select(*names.columns, F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("l_salt"))


def mentions(df: DataFrame, key: str, contexts: dict[str, str]) -> DataFrame:
    """(key, context, pos, name): one row for each name of each list column; contexts maps a context to its column."""
    stacked = F.array(*(F.struct(F.lit(c).alias("context"), F.coalesce(F.col(col), lists.empty()).alias("names")) for c, col in contexts.items()))
    x = df.select(key, F.explode(stacked).alias("x")).select(key, "x.context", F.posexplode("x.names").alias("pos", "name"))
    return x.where(~F.col("name").contains(" ") & ~F.col("name").isin("None", "nan"))


def flag(names: DataFrame, whitelist: DataFrame, false_positives: DataFrame | None = None, match: Column | None = None) -> DataFrame:
    """names with is_valid; known false positives that are not in the whitelist are gone. match: what is looked up, else the name.

    Repeats in a list count once. Names that are null are not valid.
    """
    x = names.withColumn("__m", F.col("name") if match is None else match)
    given = [(c, d.select(F.col("name").alias("l_name")).where("l_name is not null").distinct()) for c, d in (("is_valid", whitelist), ("__false", false_positives)) if d is not None]
    small = {c: _small(d) for c, d in given}
    hot = None
    if not all(small.values()):
        x, hot = _salted(x, "__m")
    for c, d in given:
        own = F.broadcast(d) if small[c] else _over_salts(d, hot)
        same = F.col("__m") == F.col("l_name")
        x = x.join(own, same if small[c] else same & (F.col("__salt") == F.col("l_salt")), "left").withColumn(c, F.col("l_name").isNotNull()).drop("l_name", "l_salt")
    if false_positives is not None:
        x = x.where("is_valid or not __false").drop("__false")
    return x.drop("__m", "__salt")


def check_packages(df: DataFrame, key: str, contexts: dict[str, tuple[str, str, str]], whitelist: DataFrame, false_positives: DataFrame | None = None) -> DataFrame:
    """df with a valid and a hallucinated list for each list column: contexts maps a column to (column, valid, hallucinated).

    Items with a blank and the words None and nan are passed over. Order and repeats stay.
    """
    flagged = flag(mentions(df, key, {c: c for c in contexts}), whitelist, false_positives)
    aggs = []
    for c, (_, valid, hall) in contexts.items():
        for out, is_valid in ((valid, True), (hall, False)):
            kept = F.when((F.col("context") == c) & (F.col("is_valid") == is_valid), F.struct("pos", "name"))
            aggs.append(F.array_sort(F.collect_list(kept)).alias(out))
    by = flagged.groupBy(key).agg(*aggs)
    outs = [x for _, v, h in contexts.values() for x in (v, h)]
    by = by.select(F.col(key).alias("__of"), *(F.transform(o, lambda s: s["name"]).alias(o) for o in outs))
    x = df.drop(*outs).join(by, F.col(key) == F.col("__of"), "left").drop("__of")
    return x.select(*(F.coalesce(F.col(c), lists.empty()).alias(c) if c in outs else F.col(f"`{c}`") for c in x.columns))


def package_search(df: DataFrame, key: str, whitelist: DataFrame, false_positives: DataFrame | None = None, words: packages.Words | None = None, extract: bool = True) -> DataFrame:
    """Both answers' names (Test_1, Test_2) extracted with the word lists given, then one join for both contexts."""
    if extract:
        if words is None:
            raise ValueError("extraction needs word lists: Words.load(path), or Words(delete=...)")
        for c in ("Test_1", "Test_2"):
            df = packages.extract_packages(df, c, "__names", words).withColumn(c, lists.distinct_longer(F.col("__names"))).drop("__names")
    return check_packages(df, key, {"Test_1": ("Test_1", "valid_1", "hallucinated_1"), "Test_2": ("Test_2", "valid_2", "hallucinated_2")}, whitelist, false_positives)


def pip_numbers(df: DataFrame, key: str, whitelist: DataFrame, answers: str = "Answers", all_args: bool = False, dedup_valid: bool = False) -> DataFrame:
    """df with pip, pip_valid and pip_hallucinated from the install commands in the answers.

    Valid names keep their repeats, hallucinated ones do not, as the counts always were; dedup_valid treats both alike.
    """
    found = F.transform(packages.parse_pip_install(F.col(answers), all_args), normalize_pip)
    x = df.withColumn("pip", found).withColumn("__pips", packages.clean_pips(F.col("pip")))
    x = check_packages(x, key, {"__pips": ("__pips", "pip_valid", "pip_hallucinated")}, whitelist).drop("__pips")
    x = x.withColumn("pip_hallucinated", lists.distinct_longer(F.col("pip_hallucinated")))
    return x.withColumn("pip_valid", lists.distinct_longer(F.col("pip_valid"))) if dedup_valid else x


def classify_imports(df: DataFrame, key: str, modules: str, whitelist: DataFrame, false_positives: DataFrame | None = None, standard: list[str] | None = None) -> DataFrame:
    """df with import_valid and import_hallucinated of an array of modules: standard modules are passed over, packages are looked up by their own names.

    Where a list is too large to be broadcast, the modules are written, so that code is parsed once, and each name is
    looked up once and not wherever it stands.
    """
    spark = df.sparkSession
    std = spark.createDataFrame([(m,) for m in (imports.standard_modules() if standard is None else standard)], "std string")
    alias = F.create_map(*(F.lit(x) for kv in imports.ALIASES.items() for x in kv))
    x = df.withColumn("__mods", F.filter(F.array_distinct(F.coalesce(F.col(modules), lists.empty())), lambda m: m.isNotNull() & (m != "")))
    found, match = x.select(key, "__mods"), normalize_python_package(F.coalesce(F.try_element_at(alias, F.col("name")), F.col("name")))
    if large := not all(_small(d) for d in (whitelist, false_positives) if d is not None):
        found = written(found, "modules")
    rows = found.select(key, F.posexplode("__mods").alias("pos", "name")).join(F.broadcast(std), F.col("name") == F.col("std"), "left_anti")
    if not large:
        flagged = flag(rows, whitelist, false_positives, match)
    else:
        used = written(rows.groupBy("name").agg(F.count("*").alias("__n")), "names")
        own = written(flag(used, whitelist, false_positives, match).select(F.col("name").alias("l_name"), "is_valid"), "names-flagged")
        same = F.col("name") == F.col("l_name")
        if _small(own):
            flagged = rows.join(F.broadcast(own), same)
        else:
            dealt, hot = _salted(rows, "name", used.select(F.col("name").alias("__hot"), "__n"))
            flagged = dealt.join(_over_salts(own, hot), same & (F.col("__salt") == F.col("l_salt")))
    side = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_valid") == v, F.struct("pos", "name")))), lambda s: s["name"])
    by = flagged.groupBy(F.col(key).alias("__of")).agg(side(True).alias("import_valid"), side(False).alias("import_hallucinated"))
    x = x.drop("__mods", "import_valid", "import_hallucinated").join(by, F.col(key) == F.col("__of"), "left").drop("__of")
    return x.withColumns({c: F.coalesce(c, lists.empty()) for c in ("import_valid", "import_hallucinated")})
