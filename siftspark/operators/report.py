"""Reports: rows for issues and SARIF as columns, whole documents rendered on the driver from ranked findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import SEVERITIES, lookup, rank
from siftspark.operators.findings import ranked

TOOL = "siftspark"
#: SARIF levels and the marks of the table and of Markdown.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
MARKS = {"critical": "⛔", "high": "✗", "medium": "▲", "low": "•", "info": "·"}
BADGES = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵", "info": "⚪"}
TABLE_ROWS, ISSUES = 200, 25


def sarif_level(severity: Column) -> Column:
    return lookup(severity, LEVELS, F.lit("note"))


def place() -> Column:
    return F.when(F.col("file").isNull(), "(project)").otherwise(F.concat_ws(":", "file", "line", F.when(F.col("line").isNotNull(), F.col("column"))))


def jsonl(findings: DataFrame) -> DataFrame:
    """One JSON text per finding."""
    public = [c for c in findings.columns if not c.endswith("_ord")]
    return findings.select(F.to_json(F.struct(*public), {"ignoreNullFields": "false"}).alias("value"))


def default_floor(kind: str) -> str:
    """The least severity that a report of a kind shows unless asked otherwise."""
    return "info" if kind in ("json", "jsonl") else "low"


def write_by_repo(findings: DataFrame, path: str) -> None:
    """All findings of a sweep as JSON lines, a folder for each repository."""
    findings.drop("layer_ord", "probe_ord", "rule_ord").write.mode("overwrite").partitionBy("repo").json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF results as structs; line and column count from 1."""
    region = F.struct(F.coalesce(F.nullif("line", F.lit(0)), F.lit(1)).alias("startLine"), F.coalesce(F.nullif("column", F.lit(0)), F.lit(1)).alias("startColumn"))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    hint = F.when(F.col("fix_hint") != "", F.concat(F.lit(" — "), "fix_hint")).otherwise("")
    return findings.select(F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.concat("title", hint).alias("text")).alias("message"), F.when(F.col("file").isNull(), F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>")).otherwise(F.array(location)).alias("locations"), F.struct("severity", "confidence", "probe").alias("properties"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The distinct rules of findings, each as its worst finding shows it."""
    key = F.struct((-rank(F.col("severity"))).alias("s"), (-F.col("confidence")).alias("c"), F.coalesce("file", F.lit("")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"))
    first = findings.groupBy(F.col("rule_id").alias("id")).agg(F.min_by(F.struct("title", "severity", "tags", "probe"), key).alias("f"))
    return first.select("id", F.col("id").alias("name"), F.struct(F.col("f.title").alias("text")).alias("shortDescription"), F.struct(sarif_level(F.col("f.severity")).alias("level")).alias("defaultConfiguration"), F.struct("f.tags", "f.probe").alias("properties"))


def issue_plan(findings: DataFrame, least: str = "medium", most: int = ISSUES, known: DataFrame | None = None) -> DataFrame:
    """The issues to file: the worst findings of least severity, without signatures in known. Nothing is sent anywhere."""
    chosen = findings.where(rank(F.col("severity")) >= (SEVERITIES.index(least) if least in SEVERITIES else 2))
    if known is not None:
        chosen = chosen.join(known.select("signature").distinct(), "signature", "left_anti")
    title = F.substring(F.concat(F.lit(f"[{TOOL}/"), F.upper("severity"), F.lit("] "), "title", F.coalesce(F.concat(F.lit(" in "), "file"), F.lit(""))), 1, 240)
    labels = F.concat(F.array(F.lit(TOOL), F.concat(F.lit("severity:"), "severity")), F.when(F.size("tags") > 0, F.array(F.substring(F.get("tags", F.lit(0)), 1, 40))).otherwise(F.array().cast("array<string>")))
    return ranked(chosen, most).select(title.alias("title"), labels.alias("labels"), "signature", issue_body(findings.columns).alias("body"), place().alias("finding"))


def issue_body(columns: list[str]) -> Column:
    part = lambda head, *body: F.concat(F.lit(f"## {head}\n"), *body, F.lit("\n\n"))
    code = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n```\n"), F.replace("snippet", F.lit("```"), F.lit("'''")), F.lit("\n```"))).otherwise("")
    fixed = F.lit("")
    if "fix" in columns:
        fixed = F.when(F.col("fix").isNotNull(), F.concat(F.lit("\n\n### Suggested change"), F.when(F.col("fix.auto"), " (can be applied)").otherwise(" (review first)"), F.lit("\n\n"), F.col("fix.note"), F.when(F.col("fix.patch") != "", F.concat(F.lit("\n\n```diff\n"), F.col("fix.patch"), F.lit("\n```"))).otherwise(""))).otherwise("")
    return F.concat(
        part("What", F.col("title"), F.lit("\n\nSeverity: "), F.col("severity"), F.lit(", confidence: "), F.format_number(F.col("confidence") * 100, 0), F.lit(" %, rule: "), F.col("probe"), F.lit(" / "), F.col("rule_id")), part("Where", place(), code), part("Why", F.coalesce(F.when(F.col("message") != "", F.col("message")), F.col("title"))),
        part("How to fix", F.coalesce(F.when(F.col("fix_hint") != "", F.col("fix_hint")), F.lit("Review the pattern above.")), fixed), part("Done when", F.lit("- [ ] another scan no longer reports "), F.col("rule_id"), F.lit(" here")), F.lit(f"<sub>{TOOL}-sig:"), F.coalesce("signature", F.lit("")), F.lit("</sub>"),
    )


def render(findings: DataFrame, kind: str = "table", root: str = "", limit: int = TABLE_ROWS) -> str:
    """A report as one text: table (the first limit findings), markdown, json, jsonl or sarif. Documents are for people and tools that read one file; findings of any number are written with jsonl()."""
    if kind == "jsonl":
        return "\n".join(r["value"] for r in jsonl(ranked(findings)).collect())
    if kind == "sarif":
        results = [json.loads(r["v"]) for r in sarif_results(ranked(findings)).select(F.to_json(F.struct("*")).alias("v")).collect()]
        rules = [json.loads(r["v"]) for r in sarif_rules(findings).orderBy("id").select(F.to_json(F.struct("*")).alias("v")).collect()]
        return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": TOOL, "rules": rules}}, "results": results}]}, indent=2)
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    score = findings.agg(F.coalesce(F.sum(rank(F.col("severity")) * (0.5 + F.col("confidence") / 2)), F.lit(0.0)).alias("r")).first()["r"]
    total = sum(counts.values())
    if kind == "json":
        return json.dumps({"tool": TOOL, "root": root, "summary": {"total": total, "bySeverity": {s: counts.get(s, 0) for s in SEVERITIES}, "riskScore": score}, "findings": [json.loads(r["value"]) for r in jsonl(ranked(findings)).collect()]}, indent=2)
    shown = [r.asDict() for r in (ranked(findings) if kind == "markdown" else ranked(findings, limit)).collect()]
    if kind == "markdown":
        out = [f"# {TOOL} report", "", f"**Target:** `{root}`  ", f"**Findings:** {total} (risk score {score:.1f})", "", "| Severity | Count |", "|---|---|", *(f"| {s} | {counts[s]} |" for s in reversed(SEVERITIES) if counts.get(s)), ""]
        if not total:
            return "\n".join([*out, "✅ No findings."])
        for f in shown:
            where = ":".join(str(x) for x in (f["file"], f["line"], f["column"]) if x is not None) if f["file"] else "(project)"
            out += [f"### {BADGES[f['severity']]} {f['title']}", "", f"- **Location:** `{where}`", f"- **Rule:** `{f['probe']}` / `{f['rule_id']}`", f"- **Confidence:** {f['confidence'] * 100:.0f}%"]
            out += [f"- **Code:** `{f['snippet'].replace('`', chr(39))}`"] if f["snippet"] else []
            out += [f"- **Fix:** {f['fix_hint']}", ""]
        return "\n".join(out)
    if not total:
        return f"  {TOOL} — {root}\n\n  ✓ No findings."
    out, groups = [f"  {TOOL} — {root}", ""], {}
    for f in shown:
        groups.setdefault(f["file"] or "(project)", []).append(f)
    for file, rows in groups.items():
        out += [f"  {file}", *(f"    {MARKS[f['severity']]} {f['severity'].upper():<8} {f['title']}" + (f":{f['line']}" if f["line"] is not None else "") for f in rows), ""]
    return "\n".join([*out, "  … and more" if total > len(shown) else "", "  Summary: " + " · ".join(f"{counts[s]} {s}" for s in reversed(SEVERITIES) if counts.get(s)), f"  risk score {score:.1f} · {total} findings"])
