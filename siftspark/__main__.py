"""Command line: scan, baseline, sweep, fix, report, learn, propose-rules, probes."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import findings as kept, fixes, history, report
from siftspark.plans.scan import build_registry, load_probes, scan, sweep
from siftspark.sources import files as sources

HOME = ".siftspark"


def _arguments() -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="siftspark")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "baseline", "sweep", "fix", "report"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format", default="table", choices=("table", "json", "jsonl", "markdown", "sarif"))
        c.add_argument("--layers", default="")
        c.add_argument("--probes", default="")
        c.add_argument("--probe-module", action="append", default=[])
        c.add_argument("--exec", action="store_true", help="with probes of the dynamic layer; commands are not run")
        c.add_argument("--baseline")
        c.add_argument("--changed", help="a file that lists the files to scan")
        c.add_argument("--min", dest="least")
        c.add_argument("--fail-on")
        c.add_argument("--corpus")
        c.add_argument("--learn", help="a knowledge base to grow; written next to it as .new")
        c.add_argument("--out")
        c.add_argument("--apply", action="store_true")
        c.add_argument("--issues", action="store_true")
        c.add_argument("--timeout", type=float)
    learn = commands.add_parser("learn")
    learn.add_argument("report")
    learn.add_argument("--kb", required=True)
    propose = commands.add_parser("propose-rules")
    propose.add_argument("--kb", required=True)
    propose.add_argument("--least", type=int, default=3)
    commands.add_parser("probes")
    return top.parse_args()


def _first_text(root: str, *names: str) -> str | None:
    return next((Path(root, n).read_text() for n in names if Path(root, n).is_file()), None)


def _scan(spark: SparkSession, a: argparse.Namespace, files: DataFrame):
    rules, error = sources.load_custom_rules(_first_text(a.path, f"{HOME}/rules.json", f"{HOME}rules.json", f"{HOME}/rules.jsonc"))
    only = spark.createDataFrame([(x,) for x in Path(a.changed).read_text().split("\n") if x], "path string") if a.changed else None
    extra = load_probes(a.probe_module)
    return scan(spark, files, probes=tuple(filter(None, a.probes.split(","))), layers=tuple(filter(None, a.layers.split(","))), exec_=a.exec, only=only, globs=sources.load_ignore_globs(files), custom_rules=rules, custom_error=error, extra_probes=extra, isolate=bool(extra), probe_seconds=a.timeout)


def main() -> int:
    a = _arguments()
    if a.command == "probes":
        for p in build_registry().select(exec_=True):
            print(f"{p.layer:<8} {p.id:<24} {p.title}")
        return 0
    cores = str(os.cpu_count() or 8)
    spark = SparkSession.builder.appName("siftspark").config("spark.sql.shuffle.partitions", cores).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "learn":
        seen = history.observe(history.read_report(spark, a.report))
        history.save_kb(history.upsert(_kb(spark, a.kb), seen), f"{a.kb}.new")
        return 0
    if a.command == "propose-rules":
        for r in history.proposals(history.promote(_kb(spark, a.kb), a.least), a.least).toJSON().collect():
            print(r)
        return 0
    if not Path(a.path).exists():
        print(f"no such path: {a.path}", file=sys.stderr)
        return 2
    files = sources.read_files(spark, str(Path(a.path).resolve()))
    if a.command == "sweep":
        files = files.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("repo"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "size", "language", "text")
        projects = sources.discover_projects(files.select(F.concat("repo", F.lit("/"), "path").alias("path")))
        result, worst = sweep(spark, files.join(projects.withColumnRenamed("project", "repo"), "repo", "left_semi"), exec_=a.exec)
        if a.out:
            report.write_by_repo(result.findings, a.out)
        if a.corpus:
            history.append_corpus(history.examples(result.findings), a.corpus)
        worst.show(100, truncate=False)
        return 0
    result = _scan(spark, a, files)
    found = result.findings.persist()
    if a.command == "baseline":
        target = Path(a.baseline or Path(a.path, HOME, "baseline.json"))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps({"keys": [r["key"] for r in history.accept(found).collect()]}, indent=2))
        return 0
    if a.corpus:
        history.append_corpus(history.examples(found, F.lit(Path(a.path).resolve().name)), a.corpus)
    if a.learn:
        history.save_kb(history.upsert(_kb(spark, a.learn), history.observe(found)), f"{a.learn}.new")
    if a.baseline:
        found = history.new_findings(found, history.load_baseline(spark, a.baseline))
    code = kept.gate(found, a.fail_on) if a.fail_on else 0
    if a.command == "fix":
        lines = sources.lines(result.files)
        fixed = fixes.with_fixes(found, lines)
        if a.apply:
            changed = fixes.applicable(fixed).select(F.col("file").alias("path")).distinct()
            for r in fixes.files_of(fixes.apply_fixes(lines, fixed).join(changed, "path", "left_semi")).toLocalIterator():
                Path(a.path, r["path"]).write_text(r["text"])
            for r in fixes.created_files(files, fixed).collect():  # one row at most: fixes create only the ignore file
                if not Path(a.path, r["path"]).exists():
                    Path(a.path, r["path"]).write_text(r["text"])
            for r in fixes.outcomes(files, fixed).groupBy("outcome").count().orderBy("outcome").collect():
                print(f"{r['outcome']}: {r['count']}")
        for r in kept.ranked(fixed, 40).collect():
            print(f"{r['file']}:{r['line']} {r['rule_id']}: {r['fix']['note']}\n{r['fix']['patch']}\n")
        return code
    if a.issues:
        for r in report.issue_plan(found).collect():
            print(f"{r['title']}\n{r['body']}\n")
        return code
    shown = kept.floor(found, a.least or report.default_floor(a.format))
    text = report.render(shown, a.format, a.path)
    Path(a.out).write_text(text) if a.out else print(text)
    return code


def _kb(spark: SparkSession, path: str) -> DataFrame:
    return history.load_kb(spark, path) if Path(path).exists() else spark.createDataFrame([], history.KB)


if __name__ == "__main__":
    sys.exit(main())
