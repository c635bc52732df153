"""Line rules compiled to Column expressions: one pass over the lines, no join but with the rules' fixed attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.tables import constant
from siftspark.functions.text import classify_secret, fits, java, redact, redact_entropy, signature, strip
from siftspark.operators.catalog import GROUPS, SECRETS, Group, Rule

FINDING = "probe string, rule_id string, severity string, title string, message string, file string, line int, column int, snippet string, language string, fix_hint string, confidence double, tags array<string>, meta string"
LAYERS = ("static", "dynamic", "fuzz", "meta")
#: The white space that strip takes off.
BLANK = " \t\n\v\f\r"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def file_fits(group: Group) -> Column:
    """Whether a group's rules see a file."""
    tests = [F.lit(True)]
    if group.languages is not None:
        tests.append(F.col("language").isin(*group.languages))
    if group.unless_languages:
        tests.append(~F.col("language").isin(*group.unless_languages))
    if group.paths is not None:
        tests.append(fits(F.col("path"), F.lower("path"), group.paths))
    if group.unless_paths is not None:
        tests.append(~fits(F.col("path"), F.lower("path"), group.unless_paths))
    return reduce(lambda a, b: a & b, tests[1:], tests[0])


def line_fits(group: Group) -> Column:
    short = F.lit(True) if group.longest is None else F.length("line") <= group.longest
    return short & ~any_of([F.col("_head").startswith(mark) for mark in group.comments])


def rule_fires(rule: Rule) -> Column:
    fires = fits(F.col("line"), F.col("_low"), rule.pattern)
    return fires if rule.unless is None else fires & ~F.col("line").rlike(java(rule.unless))


def attributes(spark, groups: tuple[Group, ...]) -> DataFrame:
    """The rules' attributes by number: a fixed table, one row for each rule."""
    rows = [(i, g.probe, r.id, r.severity, r.title, float(r.confidence), list(r.tags), r.hint, g.column, g.test_paths or "(?!x)x", float(g.test_weight), LAYERS.index(g.layer), g.order, n) for i, (g, n, r) in enumerate((g, n, r) for g in groups for n, r in enumerate(g.rules))]
    return constant(spark, rows, "rule int, probe string, rule_id string, severity string, title string, base double, tags array<string>, fix_hint string, column int, test_paths string, test_weight double, layer_ord int, probe_ord int, rule_ord int")


def rule_numbers(groups: tuple[Group, ...]) -> Column:
    """The numbers of the rules that fire on a line, with _low, the line in lower case, and _head, the line without blanks before it. A group's guards are tested once, and before its patterns."""
    parts, at = [], 0
    for group in groups:
        own = F.array(*(F.when(rule_fires(r), F.lit(at + k)) for k, r in enumerate(group.rules)))
        parts.append(F.when(file_fits(group), F.when(line_fits(group), own)).otherwise(F.array().cast("array<int>")))
        at += len(group.rules)
    return F.filter(F.concat(*(F.coalesce(p, F.array().cast("array<int>")) for p in parts)), lambda x: x.isNotNull())


def scan_lines(lines: DataFrame, groups: tuple[Group, ...] = GROUPS) -> DataFrame:
    """Findings of line rules over (path, language, line_no, line) and any partition columns such as repo.

    One finding for each line and rule, however often the rule fits. Secrets are redacted
    in snippet. Confidence falls in test files.
    """
    rest = [c for c in lines.columns if c not in ("path", "language", "line_no", "line")]
    marked = lines.select(*rest, "path", "language", "line_no", "line", F.lower("line").alias("_low"), F.ltrim("line", F.lit(BLANK)).alias("_head"))
    hits = marked.select(*rest, "path", "language", "line_no", "line", F.explode(rule_numbers(groups)).alias("rule"))
    found = hits.join(F.broadcast(attributes(lines.sparkSession, groups)), "rule")
    # each pattern as a literal, which is compiled once; one that comes from a column is compiled again for each row
    tested = any_of([(F.col("test_paths") == p) & F.col("path").rlike(p) for p in dict.fromkeys(g.test_paths for g in groups if g.test_paths)])
    snippet = F.substring(strip(F.col("line")), 1, 200)
    if SECRETS in groups:
        snippet = F.when(F.col("probe") == SECRETS.probe, F.substring(redacted(strip(F.col("line"))), 1, 200)).otherwise(snippet)
    return found.select(
        *rest, "probe", "rule_id", "severity", "title", F.concat("title", F.lit(" at "), "path", F.lit(":"), "line_no", F.lit(".")).alias("message"), F.col("path").alias("file"), F.col("line_no").cast("int").alias("line"),
        "column", snippet.alias("snippet"), "language", "fix_hint", (F.col("base") * F.when(tested, F.col("test_weight")).otherwise(1.0)).alias("confidence"), "tags", F.lit(None).cast("string").alias("meta"), "layer_ord", "probe_ord", "rule_ord",
    )


def redacted(line: Column) -> Column:
    """A line whose secrets keep their first and last four characters."""
    scoped = [f"(?i:{java(r.pattern)[4:]})" if r.pattern.startswith("(?i)") else f"(?:{java(r.pattern)})" for r in SECRETS.rules]
    return F.aggregate(F.regexp_extract_all(line, F.lit("|".join(scoped)), F.lit(0)), line, lambda text, found: F.replace(text, found, redact(found)))


def scan_entropy(lines: DataFrame) -> DataFrame:
    """Findings for quoted strings of high entropy next to a credential word; one for each line and value."""
    rest = [c for c in lines.columns if c not in ("path", "language", "line_no", "line")]
    from siftspark.functions.text import candidates

    name = F.regexp_extract("line", r"([A-Za-z_$][\w$.-]*)[\"'`]?\s*[:=]\s*[\"'`]", 1)
    values = lines.where(F.length("line") <= 2000).select(*rest, "path", "language", "line_no", "line", F.posexplode(candidates(F.col("line"))).alias("nth", "value"))
    judged = values.withColumn("c", classify_secret(F.col("value"), F.replace(F.col("line"), F.col("value"), F.lit("")), name)).where("c is not null and c.secret_name")
    return judged.select(
        *rest, F.lit("static/entropy-secrets").alias("probe"), F.lit("high-entropy-secret").alias("rule_id"), F.lit("high").alias("severity"), F.concat(F.lit("Possible secret: "), "c.reason").alias("title"),
        F.concat(F.lit("High-entropy value at "), "path", F.lit(":"), "line_no", F.lit(".")).alias("message"), F.col("path").alias("file"), F.col("line_no").cast("int").alias("line"), F.lit(None).cast("int").alias("column"),
        F.substring(F.replace(strip(F.col("line")), F.col("value"), redact_entropy(F.col("value"))), 1, 200).alias("snippet"), "language", F.lit("Move the value to a secret store and rotate it.").alias("fix_hint"), F.lit(0.65).alias("confidence"),
        F.array(*map(F.lit, ("secret", "entropy", "zero-day", "cwe-798"))).alias("tags"), F.to_json(F.struct("c.kind", "c.entropy", "c.length")).alias("meta"), F.lit(0).alias("layer_ord"), F.lit(1).alias("probe_ord"), F.col("nth").alias("rule_ord"),
    )


CUSTOM = "id string, pattern string, severity string, title string, message string, languages array<string>, fix_hint string, tags array<string>, confidence double, skip_tests boolean"


def custom_rule_table(spark, rules: list[dict]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The rules that compile as a table, and (id, error) of those that do not. Flags other than i, m, s and u are ignored."""
    good, bad = [], []
    compiler = spark._jvm.java.util.regex.Pattern
    for r in rules:
        flags = "".join(f for f in "ims" if f in (r.get("flags") or ""))
        pattern = (f"(?{flags})" if flags else "") + java(r["pattern"])
        try:
            compiler.compile(pattern)
        except Exception as e:  # py4j wraps the syntax error
            bad.append((r["id"], str(e).splitlines()[0]))
            continue
        good.append((r["id"], pattern, r["severity"], r["title"], r.get("message"), r.get("languages") or ["*"], r.get("fixHint") or "Review this match of a custom rule.", ["custom", *(r.get("tags") or [])], min(1.0, max(0.0, float(r["confidence"]))) if isinstance(r.get("confidence"), (int, float)) else 0.7, bool(r.get("skipTests"))))
    return constant(spark, good, CUSTOM), bad


CUSTOM_TESTS = r"(^|/)(test|tests|__tests__|spec|fixtures?)/|\.(test|spec)\."


def scan_custom(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of table-driven rules (at most 500 rows, so they are sent to all executors): languages name * or the file's.

    The pattern is a column here, so this is a nested loop over rules for each line.
    """
    rest = [c for c in lines.columns if c not in ("path", "language", "line_no", "line")]
    r = F.broadcast(rules.withColumnRenamed("id", "rule_id").withColumn("rule_ord", F.xxhash64("rule_id")))
    hits = lines.where(F.length("line") <= 2000).join(r, (F.array_contains("languages", "*") | F.array_contains(F.col("languages"), F.col("language"))) & F.expr("line rlike pattern"))
    weight = F.when(F.col("skip_tests") & F.col("path").rlike(CUSTOM_TESTS), 0.4).otherwise(1.0)
    return hits.select(
        *rest, F.lit("static/custom-rules").alias("probe"), "rule_id", "severity", "title", F.coalesce("message", F.concat("title", F.lit(" at "), "path", F.lit(":"), "line_no", F.lit("."))).alias("message"), F.col("path").alias("file"),
        F.col("line_no").cast("int").alias("line"), F.expr("regexp_instr(line, pattern)").cast("int").alias("column"), F.substring(strip(F.col("line")), 1, 200).alias("snippet"), "language", "fix_hint", (F.col("confidence") * weight).alias("confidence"),
        "tags", F.to_json(F.struct(F.lit(True).alias("custom"))).alias("meta"), F.lit(0).alias("layer_ord"), F.lit(10).alias("probe_ord"), F.lit(0).alias("rule_ord"),
    )


def with_signature(findings: DataFrame) -> DataFrame:
    return findings.withColumn("signature", signature(F.col("probe"), F.col("rule_id"), F.col("language"), F.col("snippet"), F.col("title")))
