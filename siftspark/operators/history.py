"""What runs leave for later ones: baselines, the training corpus, the signature knowledge base, proposed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.functions.tables import constant
from siftspark.functions.text import short_hash, template, template_to_regex

# ---- baselines


def baseline_key() -> Column:
    """A finding's signature and file: the same when its line moves."""
    return F.concat(F.coalesce("signature", F.concat_ws("::", "probe", "rule_id")), F.lit("@@"), F.coalesce("file", F.lit("")))


def accept(findings: DataFrame) -> DataFrame:
    """The baseline (key) that accepts all findings, in order."""
    return accepted_keys(findings).orderBy("key")


def accepted_keys(findings: DataFrame) -> DataFrame:
    """The same in no order, for a baseline that is only joined."""
    return findings.select(baseline_key().alias("key")).distinct()


def baseline_document(findings: DataFrame, root: str = "", created_at: Column | None = None) -> DataFrame:
    """One row about a baseline: tool, created_at, root, total (its keys), by_rule (findings of each rule)."""
    rules = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    named = rules.agg(F.coalesce(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "n")))), F.create_map().cast("map<string,bigint>")).alias("by_rule"))
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if created_at is None else created_at
    return accept(findings).agg(F.count(F.lit(1)).alias("total")).join(named).select(F.lit("siftspark").alias("tool"), when.alias("created_at"), F.lit(root).alias("root"), "total", "by_rule")


def write_baseline(findings: DataFrame, path: str) -> None:
    accept(findings).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A written baseline, or one JSON document with a list keys; no file gives an empty one."""
    try:
        found = spark.read.schema("key string, keys array<string>").json(path, multiLine=not spark.read.text(path).where("value like '{\"key\":%'").take(1))
    except Exception as e:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return constant(spark, [], "key string")
    return found.select(F.explode(F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.when(F.col("key").isNotNull(), F.array("key")).otherwise(F.array().cast("array<string>")))).alias("key")).distinct()


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.withColumn("key", baseline_key()).join(baseline.select("key"), "key", "left_anti").drop("key")


def accepted_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.withColumn("key", baseline_key()).join(baseline.select("key"), "key", "left_semi").drop("key")


def fixed_keys(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return baseline.select("key").distinct().join(findings.select(baseline_key().alias("key")), "key", "left_anti")


# ---- training corpus

CORPUS = "snippet string, language string, context_path string, label string, category string, severity string, probe string, fix string, confidence double, tags array<string>, signature string, source_repo string, collected_at string, schema_version int, hash string"


def corpus_hash(label: Column, language: Column, snippet: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", label, language, snippet).cast("binary")), 1, 16)


def examples(findings: DataFrame, repo: Column | None = None, collected_at: str | None = None) -> DataFrame:
    """Training examples of findings."""
    snippet, language = F.coalesce("snippet", F.lit("")), F.coalesce("language", F.lit("unknown"))
    source = F.col("repo") if repo is None and "repo" in findings.columns else F.lit("") if repo is None else repo
    return findings.select(
        snippet.alias("snippet"), language.alias("language"), F.col("file").alias("context_path"), F.col("rule_id").alias("label"), F.coalesce(F.get("tags", F.lit(0)), F.col("probe")).alias("category"), "severity", "probe",
        F.col("fix_hint").alias("fix"), "confidence", "tags", "signature", source.alias("source_repo"), F.lit(collected_at).cast("string").alias("collected_at"), F.lit(1).alias("schema_version"), corpus_hash(F.col("rule_id"), language, snippet).alias("hash"),
    )


def append_corpus(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of JSON lines; lines that do not parse are left out."""
    return spark.read.schema(CORPUS).option("mode", "DROPMALFORMED").json(path)


def rewrite_corpus(spark: SparkSession, path: str, new_path: str) -> None:
    """Writes the corpus at path without repeats to new_path."""
    dedupe_corpus(read_corpus(spark, path)).write.mode("overwrite").json(new_path)


def dedupe_corpus(rows: DataFrame) -> DataFrame:
    """The first row per hash, by collection time and place."""
    first = Window.partitionBy("hash").orderBy(F.col("collected_at").asc_nulls_first(), F.col("source_repo").asc_nulls_first(), F.col("context_path").asc_nulls_first(), "snippet")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def corpus_stats(rows: DataFrame) -> DataFrame:
    """(kind, name, examples): all, by label, by language and by severity, in one pass."""
    sets = rows.groupingSets([[], ["label"], ["language"], ["severity"]], "label", "language", "severity").agg(F.count(F.lit(1)).alias("examples"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "label").when(F.col("g") == 5, "language").otherwise("severity")
    return sets.select(kind.alias("kind"), F.coalesce("label", "language", "severity", F.lit("")).alias("name"), "examples")


def manifest(previous: DataFrame | None, rows: DataFrame, run_at: str | None) -> DataFrame:
    """One row: runs, total_added, last_run, repos; previous is the last such row."""
    now = rows.agg(F.lit(1).cast("long").alias("runs"), F.count(F.lit(1)).alias("total_added"), F.lit(run_at).cast("string").alias("last_run"), F.collect_set("source_repo").alias("repos"))
    both = now if previous is None else previous.select("runs", "total_added", "last_run", "repos").unionByName(now)
    return both.agg(F.sum("runs").alias("runs"), F.sum("total_added").alias("total_added"), F.max("last_run").alias("last_run"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("repos")))).alias("repos"))


# ---- knowledge base

KB = "signature string, rule_id string, probe string, language string, severity string, title string, tags array<string>, fix_hint string, template string, examples array<string>, count long, first_seen string, last_seen string, status string"
MOST_EXAMPLES = 5
REPORTED = "probe:string,rule_id:string,severity:string,title:string,message:string,file:string,line:int,column:int,snippet:string,language:string,fix_hint:string,confidence:double,tags:array<string>,signature:string"


def by_file(findings: DataFrame, *keys: str) -> DataFrame:
    """What observe needs of findings, a row for each signature, file and value of keys: counts, the first place, the first finding's attributes.

    Findings are read once, and one of each such group is left after map-side combining.
    """
    # the first finding's attributes, by a total order, without gathering a signature's findings
    key = F.struct("layer_ord", "probe_ord", "rule_ord", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"))
    shown = F.struct("rule_id", "probe", F.coalesce("language", F.lit("any")).alias("language"), "severity", "title", "tags", "fix_hint", F.coalesce(F.when(F.col("snippet") != "", F.col("snippet")), F.col("title"), F.lit("")).alias("shown"))
    return findings.where("signature is not null").groupBy("signature", "file", *keys).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("layer_ord", "probe_ord", "rule_ord")).alias("place"), F.min(key).alias("key"), F.min_by(shown, key).alias("f"))


def observe(findings: DataFrame, run_at: str | None = None) -> DataFrame:
    """Knowledge entries of one run: a row per signature with its count and its first five distinct files in report order.

    Files are first reduced to one row per signature and file, and only the five first are gathered.
    """
    return observe_files(by_file(findings), run_at)


def observe_files(reduced: DataFrame, run_at: str | None = None) -> DataFrame:
    """observe of findings that by_file has reduced; rows of several keys add up."""
    order = Window.partitionBy("signature").orderBy("place", "file")
    attributes = ("rule_id", "probe", "language", "severity", "title", "tags", "fix_hint")
    first = reduced.groupBy("signature").agg(F.sum("count").alias("count"), F.min_by("f", "key").alias("f")).select("signature", "count", *(f"f.{c}" for c in attributes), template(F.col("f.shown")).alias("template"))
    files = reduced.where("file is not null").groupBy("signature", "file").agg(F.min("place").alias("place")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_EXAMPLES)
    shown = files.groupBy("signature").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "file"))), lambda x: x["file"]).alias("examples"))
    when = F.lit(run_at).cast("string")
    return first.join(shown, "signature", "left").select("signature", *attributes, "template", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), "count", when.alias("first_seen"), when.alias("last_seen"), F.lit("observed").alias("status"))


def upsert(kb: DataFrame, seen: DataFrame) -> DataFrame:
    """The knowledge base with a run's entries: counts add up, examples stay at five, attributes and status of known signatures stay."""
    old, new = kb.alias("o"), seen.alias("n")
    both = old.join(new, F.col("o.signature") == F.col("n.signature"), "full")
    keep = [c.split()[0] for c in KB.split(", ")]
    merged = {
        "examples": F.slice(F.array_union(F.coalesce("o.examples", F.array().cast("array<string>")), F.coalesce("n.examples", F.array().cast("array<string>"))), 1, MOST_EXAMPLES),
        "count": F.coalesce("o.count", F.lit(0)) + F.coalesce("n.count", F.lit(0)),
        "last_seen": F.coalesce("n.last_seen", "o.last_seen"),
    }
    return both.select(*(merged.get(c, F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in keep))


def load_kb(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge base of JSON lines: lines that do not parse are left out; of a signature's lines the last counts."""
    rows = spark.read.schema(KB).option("mode", "DROPMALFORMED").json(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at")).where("signature is not null")
    last = Window.partitionBy("signature").orderBy(F.col("_at").desc())
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_at")


def save_kb(kb: DataFrame, new_path: str) -> None:
    """Writes a knowledge base to a path of its own: the one that was read must stay until this is done."""
    kb.write.mode("overwrite").json(new_path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a written JSON report, as a run sees them, so that its signatures can be learned."""
    rows = spark.read.schema(f"findings array<struct<{REPORTED}>>").json(path, multiLine=True).select(F.explode("findings").alias("f")).select("f.*")
    return rows.where("signature is not null").select("*", F.lit(0).alias("layer_ord"), F.lit(0).alias("probe_ord"), F.lit(0).alias("rule_ord"))


def promote(kb: DataFrame, least: int = 3) -> DataFrame:
    """The knowledge base in which signatures seen least times are candidates for rules."""
    return kb.withColumn("status", F.when((F.col("status") == "observed") & (F.col("count") >= least), "candidate-rule").otherwise(F.col("status")))


def kb_stats(kb: DataFrame) -> DataFrame:
    sets = kb.groupingSets([["status"], ["language"]], "status", "language").agg(F.count(F.lit(1)).alias("entries"), F.grouping("status").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "status").otherwise("language").alias("kind"), F.when(F.col("g") == 0, F.col("status")).otherwise(F.col("language")).alias("name"), "entries")


def proposals(kb: DataFrame, least: int = 3) -> DataFrame:
    """Custom rules drafted from candidate signatures; templates too general for a pattern give none."""
    chosen = kb.where((F.col("status") == "candidate-rule") | ((F.col("status") == "observed") & (F.col("count") >= least))).withColumn("pattern", template_to_regex(F.col("template"))).where("pattern is not null")
    return chosen.select(
        F.concat(F.lit("learned-"), "rule_id", F.lit("-"), short_hash(F.col("signature"))).alias("id"), "pattern", F.lit("").alias("flags"), "severity", F.concat(F.lit("[learned] "), "title").alias("title"),
        F.concat(F.lit("Proposed from "), "count", F.lit(" findings of "), "rule_id", F.lit("; review before use.")).alias("message"), F.when(F.col("language") == "any", F.array(F.lit("*"))).otherwise(F.array("language")).alias("languages"),
        F.coalesce(F.when(F.col("fix_hint") != "", F.col("fix_hint")), F.lit("Review this learned pattern.")).alias("fix_hint"), "tags", F.lit(0.5).alias("confidence"), F.struct("signature", "count", F.col("examples").alias("seen_in")).alias("provenance"),
    )
