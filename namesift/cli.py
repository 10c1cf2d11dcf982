"""python -m namesift.cli COMMAND: detection, scans, splits, dataset builds and reports over files."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from namesift.boundary import WordTokenizer
from namesift.functions.packages import Words
from namesift.operators import report
from namesift.plans import pipelines
from namesift.session import session
from namesift.sources import readers, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="namesift")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(f"--{a.rstrip('?')}", required=not a.endswith("?")) for a in args]][0]
    add("detect", "code", "mode1", "mode2", "whitelist", "false-positives?", "words", "dataset?", "out")
    add("scan", "master", "whitelist", "false-positives?", "out")
    add("split", "results", "per-file?", "ratio?", "seed?", "out")
    add("build", "results", "family?", "ratio?", "seed?", "out")
    add("report", "runs", "tags", "out")
    add("config", "path", "sections")
    a = p.parse_args(argv)
    if a.command == "config":
        for k, v in readers.settings(readers.read_config(a.path), a.sections.split(",")).items():
            print(f"{k}={v}")
        return
    spark = session()
    if a.command == "detect":
        ids = lambda path: readers.with_row_id(readers.read_jsonl(spark, path))
        words = Words.load(a.words)
        fp = readers.read_false_positives(spark, a.false_positives) if a.false_positives else None
        results, totals = pipelines.detect_packages(ids(a.code), ids(a.mode1), ids(a.mode2), readers.read_whitelist(spark, a.whitelist), fp, words, a.dataset or "all")
        sinks.save_results(results, totals, a.out)
    elif a.command == "scan":
        fp = readers.read_name_set(spark, a.false_positives) if a.false_positives else None
        rows, sums = pipelines.scan_master(readers.with_row_id(readers.read_jsonl(spark, a.master, "Prompts STRING, Answers STRING")), readers.read_name_set(spark, a.whitelist), fp)
        sinks.save_csv(rows, f"{a.out}/import_scan_results")
        sinks.save_csv(sums, f"{a.out}/import_scan_totals", single=True)
    elif a.command == "split":
        x = pipelines.train_test_split(readers.read_results(spark, a.results), int(a.per_file or 100), float(a.ratio or 0.9), int(a.seed or 42))
        from namesift.operators.split import split_metadata

        sinks.save_split(x, split_metadata(x), a.out)
    elif a.command == "build":
        out = pipelines.build_datasets(readers.read_results(spark, a.results), WordTokenizer(), a.family or "llama3", float(a.ratio or 0.1), int(a.seed or 42))
        for name, df in out.items():
            sinks.save_parquet(df, f"{a.out}/{name}")
    elif a.command == "report":
        tags = [tuple(t.split("=", 1)) for t in a.tags.split(",")]
        runs = None
        for tag, _ in tags:
            path = f"{a.runs}/{tag}/FINAL_RESULTS"
            if readers.exists(spark, path):
                t = spark.read.csv(path, header=True).where("dataset = 'Totals'").select(F.lit(tag).alias("tag"), *(F.col(c).cast("long").alias(c) for c in report.COUNTS))
                runs = t if runs is None else runs.unionByName(t)
        if runs is None:
            raise SystemExit("no runs")
        sinks.save_report(*report.build_report(runs, tags), a.out)


if __name__ == "__main__":
    main()
