"""The scan: probes over files, one plan from lines to ranked findings."""

from __future__ import annotations

import importlib
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.tables import constant, stored
from siftspark.operators import catalog, findings as kept, history, lines as line_ops, report, structured
from siftspark.sources import files as sources


@dataclass(frozen=True)
class Probe:
    """A detector: run takes a Context and returns findings. layer and order place its findings; languages * or a tuple."""

    id: str
    title: str
    run: Callable[[Context], DataFrame]
    layer: str = "static"
    order: int = 100
    languages: tuple[str, ...] = ("*",)
    #: Line rules, which a scan evaluates for all probes in one pass over the lines; run then gives the rest, if any.
    groups: tuple[catalog.Group, ...] = ()


@dataclass(frozen=True)
class Context:
    """What probes read. options has exec for probes of the dynamic layer, custom_rules, command_results."""

    spark: SparkSession
    files: DataFrame
    lines: DataFrame
    options: dict = field(default_factory=dict)


class Registry:
    """Probes by id; a second probe of an id is an error."""

    def __init__(self, probes: tuple[Probe, ...] = ()):
        self.probes: dict[str, Probe] = {}
        for p in probes:
            self.register(p)

    def register(self, probe: Probe) -> None:
        if not probe.id or not callable(probe.run):
            raise ValueError("a probe has an id and a function run")
        if probe.layer not in line_ops.LAYERS:
            raise ValueError(f"{probe.id}: layer is one of {', '.join(line_ops.LAYERS)}")
        if probe.id in self.probes:
            raise ValueError(f"{probe.id} is registered already")
        self.probes[probe.id] = probe

    def get(self, id_: str) -> Probe | None:
        return self.probes.get(id_)

    def select(self, ids=(), layers=(), languages=(), exec_: bool = False) -> list[Probe]:
        """Probes of ids and layers that see one of languages (no filter where empty), by layer, order and id; dynamic ones only with exec_."""
        chosen = [p for p in self.probes.values() if (not ids or p.id in ids) and (not layers or p.layer in layers) and (not languages or "*" in p.languages or set(p.languages) & set(languages)) and (exec_ or p.layer != "dynamic")]
        return sorted(chosen, key=lambda p: (line_ops.LAYERS.index(p.layer), p.order, p.id))


def _group_probe(probe_id: str) -> Probe:
    groups = tuple(g for g in catalog.GROUPS if g.probe == probe_id)
    extra = {"static/dangerous-js": structured.empty_catches, "static/ci-docker": structured.pull_request_target}.get(probe_id)
    return Probe(probe_id, groups[0].title, lambda c: extra(c.files) if extra else None, "static", groups[0].order, tuple({x for g in groups for x in (g.languages or ("*",))}), groups)


def _custom(c: Context) -> DataFrame:
    """Matches of custom rules, and findings for a rule file that does not load and for patterns that do not compile."""
    source = F.lit(c.options.get("custom_source") or "(custom rules)")
    rules, bad = line_ops.custom_rule_table(c.spark, c.options.get("custom_rules") or [])
    faults = [("custom-rules-invalid", "Custom rules file is invalid", c.options["custom_error"])] if c.options.get("custom_error") else []
    faults += [("custom-rule-bad-regex", f'Custom rule "{id_}" has an invalid regex', error) for id_, error in bad]
    told = constant(c.spark, faults, "r string, t string, m string").select(*structured.finding([], "static/custom-rules", F.col("r"), "low", F.col("t"), F.col("m"), source, 0.9, "Correct the rule.", ("config",), 10))
    found = line_ops.scan_custom(c.lines, rules)
    for name in [x for x in found.columns if x not in told.columns]:  # partition columns such as repo
        told = told.withColumn(name, F.lit(None).cast(found.schema[name].dataType))
    return found.unionByName(told)


def _computed(spark: SparkSession, found: DataFrame, probe: str, seconds: float | None) -> DataFrame:
    """found computed on its own and written to the shared folder; its jobs are interrupted after seconds."""
    group = f"probe {probe} {time.time()}"
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group)) if seconds else None
    spark.sparkContext.setJobGroup(group, f"probe {probe}", interruptOnCancel=True)
    try:
        if timer:
            timer.start()
        return found.checkpoint(eager=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if timer:
            timer.cancel()


def _self_check(c: Context) -> DataFrame:
    """Findings about the engine itself: rules with an unknown severity, probes in an unknown layer. None in a sound build."""
    bad = [(g.probe, r.id) for g in catalog.GROUPS for r in g.rules if r.severity not in sources.SEVERITY_NAMES or not 0 <= r.confidence <= 1]
    rows = constant(c.spark, bad, "p string, r string")
    return rows.select(*structured.finding([], "meta/self-integrity", "invalid-probe", "high", F.concat(F.lit("Rule breaks the schema: "), "r"), F.col("p"), F.lit("(engine)"), 1.0, "Correct the rule.", ("meta",), 99, layer="meta"))


def build_registry() -> Registry:
    """All probes of this engine."""
    of = lambda f: lambda c: f(c.files)
    return Registry((
        *(_group_probe(p) for p in dict.fromkeys(g.probe for g in catalog.GROUPS)),
        Probe("static/entropy-secrets", "Unknown secrets by entropy", lambda c: line_ops.scan_entropy(c.lines), order=1),
        Probe("static/deps", "Manifests", of(structured.dependencies), order=4),
        Probe("static/config-hygiene", "Repository hygiene", of(structured.hygiene), order=7),
        Probe("static/complexity", "Size and complexity", of(structured.complexity), order=9, languages=(*structured.BRACES, "python")),
        Probe("static/custom-rules", "Custom and learned rules", _custom, order=10),
        Probe("dynamic/build", "Results of builds", lambda c: structured.command_results(c.options["command_results"]), "dynamic", 1),
        Probe("dynamic/tests", "Test suites", of(structured.no_tests), "dynamic", 2),
        Probe("fuzz/json-roundtrip", "JSON that does not parse", of(structured.malformed_json), "fuzz", 1, ("json",)),
        Probe("meta/self-integrity", "The engine's own rules", _self_check, "meta", 99),
    ))


def load_probes(modules: list[str]) -> list[Probe]:
    """The PROBES of modules named by import path."""
    return [p for name in modules for p in importlib.import_module(name).PROBES]


@dataclass
class Result:
    """A scan: findings (deduplicated, suppressed ones gone), raw findings, probes that could not be planned, progress events."""

    findings: DataFrame
    raw: DataFrame
    files: DataFrame
    errors: dict[str, str]
    events: list[tuple[str, str]]

    def ranked(self, limit: int | None = None) -> DataFrame:
        return kept.ranked(self.findings, limit)

    def suppressed(self) -> int:
        return self.raw.count() - self.findings_before_dedupe.count()

    findings_before_dedupe: DataFrame | None = None


def scan(spark: SparkSession, files: DataFrame, probes=(), layers=(), exec_: bool = False, only: DataFrame | None = None, globs: list[str] = (), custom_rules: list[dict] | None = None, command_results: DataFrame | None = None, extra_probes=(), baseline: DataFrame | None = None, least: str = "info", marker: str = kept.MARKER, custom_error: str | None = None, isolate: bool = False, probe_seconds: float | None = None, walked: bool = False, gitignore: bool = True) -> Result:
    """Scans files (path, size, language, text; a column repo keeps repositories apart).

    Probes are planned one by one; one that fails is recorded in errors and the rest go
    on. With isolate, each probe's findings are also computed on their own, so that
    failures at run time are caught as well (for probes from elsewhere), and one that takes
    over probe_seconds is stopped. Directories that a repository's top-level .gitignore
    names are left out unless gitignore is off; walked files are taken as they are.
    """
    registry = build_registry()
    for p in extra_probes:
        registry.register(p)
    events: list[tuple[str, str]] = [("walk", "start")]
    seen = files if walked else sources.walk(sources.without_gitignored(files) if gitignore else files)
    if only is not None and only.take(1):
        seen = sources.only_files(seen, only)
    seen = stored(seen)  # some twenty steps read it
    lines = sources.lines(seen)
    context = Context(spark, seen, lines, {"custom_rules": custom_rules, "custom_error": custom_error, "command_results": command_results, "exec": exec_})
    chosen = registry.select(probes, layers, exec_=exec_)
    parts, errors = [], {}
    if groups := tuple(g for p in chosen for g in p.groups):
        parts.append(line_ops.scan_lines(lines, groups))
    for probe in chosen:
        if probe.id == "dynamic/build" and command_results is None or probe.id == "static/custom-rules" and not (custom_rules or custom_error):
            continue
        began = time.time()
        try:
            found = probe.run(context)
            if found is None:
                continue
            if "repo" in files.columns and "repo" not in found.columns:
                found = found.withColumn("repo", F.lit(None).cast("string"))
            if isolate:
                found = _computed(spark, found, probe.id, probe_seconds)
            parts.append(found)
            events.append((probe.id, f"done in {time.time() - began:.3f} s"))
        except Exception as e:  # a probe's fault must not end the scan
            errors[probe.id] = str(e).splitlines()[0] if str(e) else type(e).__name__
            events.append((probe.id, "error"))
    if not parts:
        parts = [_self_check(context)]
    raw = line_ops.with_signature(structured.union(parts))
    left = kept.suppress(raw, lines, globs, marker)
    out = kept.dedupe(left)
    if baseline is not None:
        out = history.new_findings(out, baseline)
    if least != "info":
        out = kept.floor(out, least)
    return Result(out, raw, seen, errors, events, left)


def scan_and_render(spark: SparkSession, root: str, kind: str = "table", **options) -> tuple[Result, str]:
    """Scans all files under root; the result and its findings as text: table, json, jsonl, sarif or markdown."""
    found = scan(spark, sources.read_files(spark, root), **options)
    return found, report.render(found.findings, kind)


def sweep(spark: SparkSession, files: DataFrame, **options) -> tuple[Result, DataFrame]:
    """One scan over many repositories (files with a column repo), and their risk, worst first."""
    result = scan(spark, files, **options)
    return result, kept.risk(result.findings, "repo").orderBy(F.col("risk_score").desc(), "repo")
