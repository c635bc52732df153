"""What happens to findings: suppression, first per key, order, floors and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.text import SEVERITIES, rank

#: The word that begins a suppression comment. Callers with other comments pass their own.
MARKER = "sift"


def directives(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """The suppression comments of lines: keys, target line, rule ('' for all). disable-next-line counts for the line after it, ignore and disable-line for their own."""
    rest = [c for c in lines.columns if c not in ("language", "line")]
    pattern = rf"{marker}-(ignore|disable-line|disable-next-line)(?::?\s+([^\s*]+))?"
    # the longer word must win over its prefix: a regular expression takes the first that fits
    pattern = pattern.replace("ignore|disable-line|disable-next-line", "ignore|disable-next-line|disable-line")
    found = lines.where(F.col("line").contains(f"{marker}-")).select(*rest, F.regexp_extract("line", pattern, 1).alias("kind"), F.regexp_extract("line", pattern, 2).alias("target")).where("kind <> ''")
    return found.withColumn("line_no", F.when(F.col("kind") == "disable-next-line", F.col("line_no") + 1).otherwise(F.col("line_no"))).drop("kind")


def rule_matches(rule_id: Column, target: Column) -> Column:
    return (target == "") | (rule_id == target) | F.endswith(rule_id, F.concat(F.lit("/"), target)) | (rule_id == F.regexp_replace(target, "^.*/", ""))


def suppress(findings: DataFrame, lines: DataFrame, globs: list[str] = (), marker: str = MARKER) -> DataFrame:
    """Findings without those that a comment or an ignored path suppresses.

    Comments are few; they meet findings by file and line, and only lines that hold one are joined.
    """
    kept = findings
    if globs:
        kept = kept.where(F.col("file").isNull() | ~F.col("file").rlike("|".join(f"(?:{g})" for g in globs)))
    marks = directives(lines, marker)
    keys = [c for c in marks.columns if c not in ("path", "line_no", "target")]
    m = marks.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("path").alias("_path"), F.col("line_no").alias("_line"), "target").distinct()
    same = (F.col("file") == F.col("_path")) & (F.col("line") == F.col("_line"))
    for c in keys:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return kept.join(m, same & rule_matches(F.col("rule_id"), F.col("target")), "left_anti")


def dedupe(findings: DataFrame) -> DataFrame:
    """The first finding per signature, file and line, in the order of layers, probes and rules."""
    keys = [c for c in findings.columns if c == "repo"]
    first = Window.partitionBy(*keys, "signature", "file", "line").orderBy("layer_ord", "probe_ord", "probe", "rule_ord", F.col("column").asc_nulls_first(), "message")
    return findings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def report_order() -> list[Column]:
    """Worst first: severity, confidence, file without regard to case, line; then probe and rule, so that the order is total."""
    return [rank(F.col("severity")).desc(), F.col("confidence").desc(), F.lower(F.coalesce("file", F.lit("null"))), F.coalesce("file", F.lit("null")), F.coalesce("line", F.lit(0)), F.col("layer_ord"), F.col("probe_ord"), F.col("rule_ord"), F.col("rule_id"), F.coalesce("snippet", F.lit(""))]


def ranked(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings in report order; with limit, the first ones: a top-k, no full sort."""
    out = findings.orderBy(*report_order())
    return out if limit is None else out.limit(limit)


def floor(findings: DataFrame, least: str) -> DataFrame:
    """Findings of least severity or worse; an unknown name counts as low."""
    return findings.where(rank(F.col("severity")) >= (SEVERITIES.index(least) if least in SEVERITIES else 1))


def gate(findings: DataFrame, least: str = "high") -> int:
    """The exit code of a run: 1 if any finding is of least severity or worse; an unknown name counts as high."""
    return int(bool(findings.where(rank(F.col("severity")) >= (SEVERITIES.index(least) if least in SEVERITIES else 3)).take(1)))


def by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of all five severities, zeros included, in one aggregation."""
    counted = findings.groupBy(*keys).agg(*(F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES))
    return counted.select(*keys, F.expr(f"stack({len(SEVERITIES)}, {', '.join(f'{chr(39)}{s}{chr(39)}, {s}' for s in SEVERITIES)}) as (severity, findings)"))


def by_probe_and_rule(findings: DataFrame) -> DataFrame:
    """Counts by probe and by rule, in one pass: kind, name, findings."""
    sets = findings.groupingSets([["probe"], ["rule_id"]], "probe", "rule_id").agg(F.count(F.lit(1)).alias("findings"), F.grouping("probe").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "probe").otherwise("rule").alias("kind"), F.when(F.col("g") == 0, F.col("probe")).otherwise(F.col("rule_id")).alias("name"), "findings")


def risk(findings: DataFrame, *keys: str) -> DataFrame:
    """The risk score: severity ranks weighted by half and half the confidence, to six digits."""
    score = F.round(F.coalesce(F.sum(rank(F.col("severity")) * (0.5 + F.col("confidence") / 2)), F.lit(0.0)), 6)
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"), score.alias("risk_score"))


def languages(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("files"))


def summary(findings: DataFrame) -> DataFrame:
    """(kind, name, value): totals, risk score and counts by severity, probe and rule in long form."""
    scored = risk(findings)
    total = scored.select(F.lit("total").alias("kind"), F.lit("findings").alias("name"), F.col("findings").cast("double").alias("value")).unionByName(scored.select(F.lit("total").alias("kind"), F.lit("risk_score").alias("name"), F.col("risk_score").alias("value")))
    severities = by_severity(findings).select(F.lit("severity").alias("kind"), F.col("severity").alias("name"), F.col("findings").cast("double").alias("value"))
    rest = by_probe_and_rule(findings).select("kind", "name", F.col("findings").cast("double").alias("value"))
    return total.unionByName(severities).unionByName(rest)
