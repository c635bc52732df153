"""Probes over whole files: manifests, repository hygiene, JSON, size and complexity, command results.

All take files (path, size, language, text and any partition columns such as repo) and
return findings. Project-level checks aggregate over the partition columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from siftspark.functions.text import java, line_of, strip_json_comments, tail
from siftspark.operators.lines import LAYERS

# ---- fixed values: manifests, hooks, ranges, key files, thresholds
HOOKS = ("preinstall", "install", "postinstall", "prepare", "prepublishOnly", "prepack", "postpublish")
REMOTE = r"(?i)\b(curl|wget)\b[^|&\n]*[|]\s*(sudo\s+)?(sh|bash|zsh|python)\b|\bnode\s+-e\b|\bbash\s+-c\b"
UNBOUNDED = r"^(\*|x|)$|^(?i:latest|next|canary|beta|alpha|nightly|dev|rc)$|^>=?\s*[\d.]|^\d+\.x$"
NONREGISTRY = r"^(git\+|https?:|github:|file:)"
LOCKS = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb")
DOTENV, DOTENV_SAMPLES = r"^\.env(\.\w+)?$", r"\.(example|sample|template|dist)$"
KEY_FILES = r"(?i)\.(key|p12|pfx|pkcs12|keystore|jks|ppk|kdbx)$|^(?-i:id_rsa|id_dsa|id_ecdsa|id_ed25519)$|^(?-i:\.wallet-key)$"
MAYBE_KEYS, PRIVATE_KEY = r"(?i)\.(pem|crt|cer|der|asc)$", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
MANIFESTS = r"package\.json$|requirements\.txt$|Cargo\.toml$|go\.mod$"
JSONC = r"(?i)\.(jsonc|json5)$|tsconfig|jsconfig|devcontainer|\.vscode/|\.babelrc$|\.eslintrc(\.json)?$|\.swcrc$|\.hintrc$"
TEST_FILES = r"(\.(test|spec)\.[jt]sx?$)|((^|/)(test|tests|__tests__|spec)/)"
FILE_LINES, FUNCTION_LINES, COMPLEXITY, NESTING = (1500, 800), (150, 80), (30, 18), 7
BRACES = "javascript typescript solidity go java c cpp csharp rust php kotlin vue svelte".split()


def _rest(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c not in ("path", "size", "language", "text")]


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def finding(rest: list[str], probe: str, rule: Column | str, severity: Column | str, title: Column, message: Column, file: Column, confidence: Column | float, hint: str, tags: tuple[str, ...], order: int, line: Column | int = 1, language: Column | str | None = None, layer: str = "static", rule_ord: int = 0, meta: Column | None = None, snippet: Column | None = None) -> list[Column]:
    """The columns of a finding, in the order of the findings table."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        *map(F.col, rest), F.lit(probe).alias("probe"), as_column(rule).alias("rule_id"), as_column(severity).alias("severity"), title.alias("title"), message.alias("message"), file.alias("file"), as_column(line).cast("int").alias("line"),
        F.lit(None).cast("int").alias("column"), as_column(snippet).cast("string").alias("snippet"), as_column(language).cast("string").alias("language"), F.lit(hint).alias("fix_hint"), as_column(confidence).cast("double").alias("confidence"), F.array(*map(F.lit, tags)).alias("tags"),
        as_column(meta).cast("string").alias("meta"), F.lit(LAYERS.index(layer)).alias("layer_ord"), F.lit(order).alias("probe_ord"), F.lit(rule_ord).alias("rule_ord"),
    ]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _json_ok(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


_MANIFEST = "dependencies map<string,string>, devDependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>, scripts map<string,string>"


def dependencies(files: DataFrame) -> DataFrame:
    """Findings over package.json files: syntax, lock file, ranges, sources, install hooks, downloads run in a shell.

    Of a dependency that several maps name, the last of dependencies, dev, optional and peer counts.
    """
    rest = _rest(files)
    packages = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(*rest, "path", "text", F.regexp_replace("path", r"package\.json$", "").alias("dir"), F.from_json("text", _MANIFEST).alias("m"), _json_ok(F.col("text")).alias("ok"), F.get_json_object("text", "$.workspaces").alias("spaces"))
    locks = files.where(_name(F.col("path")).isin(*LOCKS)).select(*[F.col(c).alias(f"_{c}") for c in rest], F.regexp_replace("path", "[^/]*$", "").alias("_dir")).distinct()
    same = F.col("dir") == F.col("_dir")
    for c in rest:
        same = same & (F.col(c) == F.col(f"_{c}"))
    maps = [F.coalesce(F.map_entries(f"m.{k}"), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")]
    listed = packages.where("ok").withColumn("all", F.concat(*maps))
    deps = F.filter("all", lambda e, i: ~F.exists(F.slice("all", i + 2, F.size("all")), lambda later: later["key"] == e["key"]))
    listed = listed.withColumn("deps", deps)
    probe, order = "static/deps", 4
    broken = packages.where("not ok").select(*finding(rest, probe, "invalid-package-json", "high", F.lit("package.json is not valid JSON"), F.concat(F.lit("Cannot parse "), "path"), F.col("path"), 0.99, "Fix the JSON.", ("manifest",), order, language="json"))
    unlocked = listed.where((F.size("deps") > 0) & (F.col("spaces").isNull() | F.col("spaces").isin("false", "0", ""))).join(locks, same, "left_anti").select(*finding(rest, probe, "missing-lockfile", "medium", F.lit("No lockfile alongside package.json"), F.concat("path", F.lit(" declares "), F.size("deps"), F.lit(" dependencies without a lock file")), F.col("path"), 0.7, "Commit a lock file.", ("supply-chain",), order, language="json", rule_ord=1))
    each = listed.select(*rest, "path", "text", F.explode("deps").alias("d")).where("d.value is not null")
    name, version = F.col("d.key"), F.col("d.value")
    wild = each.where(version.rlike(UNBOUNDED)).select(*finding(rest, probe, "wildcard-dependency", "medium", F.concat(F.lit("Unpinned dependency: "), name, F.lit("@"), F.when(version == "", "(empty)").otherwise(version)), F.concat(name, F.lit(" takes any version in "), version), F.col("path"), 0.8, "Pin the version.", ("supply-chain",), order, line_of(F.col("text"), name), "json", rule_ord=2))
    foreign = each.where(version.rlike(NONREGISTRY)).select(*finding(rest, probe, "nonregistry-dependency", "low", F.concat(F.lit("Non-registry dependency: "), name), F.concat(name, F.lit(" comes from "), version), F.col("path"), 0.6, "Prefer a published version.", ("supply-chain",), order, line_of(F.col("text"), name), "json", rule_ord=3))
    scripts = listed.select(*rest, "path", "text", F.explode("m.scripts").alias("script", "command")).where("command is not null")
    place = line_of(F.col("text"), F.concat(F.lit('"'), "script", F.lit('"')))
    hooks = scripts.where(F.col("script").isin(*HOOKS) & (F.col("command") != "")).select(*finding(rest, probe, "install-script-hook", "low", F.concat(F.lit("Lifecycle install hook present: "), "script"), F.concat("path", F.lit(" runs on install: "), F.substring("command", 1, 120)), F.col("path"), 0.5, "Make sure the hook is needed.", ("supply-chain",), order, place, "json", rule_ord=4))
    remote = scripts.where(F.col("command").rlike(java(REMOTE))).select(*finding(rest, probe, "script-remote-exec", "high", F.concat(F.lit('npm script "'), "script", F.lit('" pipes remote content into a shell')), F.concat("path", F.lit(" runs: "), F.substring("command", 1, 140)), F.col("path"), 0.8, "Download, check, then run.", ("supply-chain", "cwe-494"), order, place, "json", rule_ord=5))
    return union([broken, unlocked, wild, foreign, hooks, remote])


def hygiene(files: DataFrame) -> DataFrame:
    """Findings over committed environment and key files, and over a project's ignore file."""
    rest = _rest(files)
    probe, order, base = "static/config-hygiene", 7, _name(F.col("path"))
    env = files.where(base.rlike(DOTENV) & ~base.rlike(DOTENV_SAMPLES)).select(*finding(rest, probe, "committed-dotenv", "high", F.concat(F.lit("Environment file committed: "), "path"), F.concat("path", F.lit(" looks like a live environment file.")), F.col("path"), 0.75, "Remove it from the repository and rotate its values.", ("secret", "config"), order, language="dotenv"))
    always, private = base.rlike(KEY_FILES), F.col("text").rlike(PRIVATE_KEY)
    keys = files.where(always).select(*finding(rest, probe, "key-file-committed", "critical", F.concat(F.lit("Private key/credential file committed: "), "path"), F.concat("path", F.lit(" is private key material.")), F.col("path"), 0.85, "Remove and rotate it.", ("secret", "config"), order, rule_ord=1))
    maybe = files.where(~always & base.rlike(MAYBE_KEYS)).withColumn("p", F.coalesce(private, F.lit(False)))
    maybe = maybe.select(*finding(rest, probe, F.when(F.col("p"), "key-file-committed").otherwise("cert-file-committed"), F.when(F.col("p"), "critical").otherwise("info"), F.concat(F.when(F.col("p"), "Private key file committed: ").otherwise("Certificate file committed: "), "path"), F.concat("path", F.when(F.col("p"), " holds a private key.").otherwise(" looks like a public certificate.")), F.col("path"), F.when(F.col("p"), 0.9).otherwise(0.5), "Keep private keys out of the repository.", ("secret", "config"), order, rule_ord=1))
    facts = project_facts(files)
    root = F.lit("(repo root)")
    open_ = facts.where("has_env and not ignores_env").select(*finding(rest, probe, "env-not-ignored", "medium", F.lit(".env files are not covered by .gitignore"), F.lit("An environment file exists but is not ignored."), F.when(F.col("has_ignore"), F.lit(".gitignore")).otherwise(root), 0.6, "Ignore .env and .env.*.", ("config",), order, rule_ord=2))
    bare = facts.where("has_manifest and not has_ignore").select(*finding(rest, probe, "missing-gitignore", "low", F.lit("No .gitignore in a code project"), F.lit("There is a manifest but no ignore file."), root, 0.6, "Add an ignore file.", ("config",), order, rule_ord=3))
    return union([env, keys, maybe, open_, bare])


def project_facts(files: DataFrame) -> DataFrame:
    """One row per project (the partition columns): whether it has environment files, an ignore file, a manifest, tests."""
    any_ = lambda c, name: F.max(F.coalesce(c, F.lit(False))).alias(name)
    path, top = F.col("path"), F.col("path") == ".gitignore"
    package = path == "package.json"
    script = F.get_json_object("text", "$.scripts.test")
    return files.groupBy(*_rest(files)).agg(
        any_(path.rlike(r"(^|/)\.env(\.|$)"), "has_env"), any_(top, "has_ignore"), any_(top & F.col("text").rlike(r"(^|\n)\s*\.?\*?\.env"), "ignores_env"), any_(path.rlike(MANIFESTS), "has_manifest"), any_(path.rlike(TEST_FILES), "has_test_files"),
        any_(package & _json_ok(F.col("text")), "has_package"), any_(package, "has_any_package"), any_(package & F.coalesce(script != "", F.lit(False)) & ~script.rlike(r"(?i)no test specified|echo\s+[\"']?Error"), "has_test_script"),
        any_(path.rlike(r"requirements\.txt$|pyproject\.toml$|setup\.py$"), "has_python"), any_(path.rlike(r"test_.*\.py$|_test\.py$"), "has_python_tests"),
    )


def no_tests(files: DataFrame) -> DataFrame:
    """Projects without a test script and test files (package.json), or without Python tests."""
    rest, probe = _rest(files), "dynamic/tests"
    facts = project_facts(files)
    js = facts.where("has_package and not has_test_script and not has_test_files").select(*finding(rest, probe, "no-tests", "medium", F.lit("Project has no test suite"), F.lit("Neither a test script nor test files were found."), F.lit("package.json"), 0.7, "Add tests and a script that runs them.", ("test-coverage",), 2, layer="dynamic"))
    py = facts.where("not has_any_package and has_python and not has_test_files and not has_python_tests").select(*finding(rest, probe, "no-tests", "medium", F.lit("Python project has no tests"), F.lit("No test files were found."), F.lit("(repo root)"), 0.6, "Add tests.", ("test-coverage",), 2, layer="dynamic"))
    return js.unionByName(py)


def command_results(results: DataFrame) -> DataFrame:
    """Findings for commands that others ran: (kind, exit_code, stdout, stderr, timed_out); kind is build, typecheck, cargo-build, go-build or tests."""
    rest = [c for c in results.columns if c not in ("kind", "exit_code", "stdout", "stderr", "timed_out")]
    failed = results.where((F.col("exit_code") != 0) | F.col("timed_out"))
    probe = F.when(F.col("kind") == "tests", "dynamic/tests").otherwise("dynamic/build")
    out = failed.select(*finding(rest, "", F.concat("kind", F.lit("-failed")), "high", F.concat("kind", F.lit(" failed")), F.concat(F.lit("Exit code "), "exit_code", F.lit("\n\n"), tail(F.coalesce(F.when(F.col("stdout") != "", F.col("stdout")), F.col("stderr"), F.lit("")))), F.lit("(project)"), 0.9, "Run the command and fix what it reports.", ("build",), 1, layer="dynamic", meta=F.to_json(F.struct("exit_code", "timed_out"))), probe.alias("_probe"))
    return out.withColumn("probe", F.col("_probe")).drop("_probe")


def json_files(files: DataFrame) -> DataFrame:
    """JSON files with a text: path, cleaned text (comments out of files that may have them), valid."""
    chosen = files.where(((F.col("language") == "json") | F.col("path").rlike(r"\.json$")) & F.col("text").rlike(r"\S"))
    return chosen.withColumn("cleaned", F.when(F.col("path").rlike(JSONC), strip_json_comments(F.col("text"))).otherwise(F.col("text"))).withColumn("valid", _json_ok(F.col("cleaned")))


@F.pandas_udf(IntegerType())
def _error_line(texts: pd.Series) -> pd.Series:
    def line(text: str) -> int:
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            return e.lineno
        except RecursionError:
            return 1
        return 1

    return texts.map(line)


def malformed_json(files: DataFrame) -> DataFrame:
    """Findings for JSON files that do not parse; only these go through Python, for the error's line."""
    rest = _rest(files)
    bad = json_files(files).where("not valid").withColumn("at", _error_line(F.col("cleaned")))
    return bad.select(*finding(rest, "fuzz/json-roundtrip", "malformed-json", "high", F.concat(F.lit("Malformed JSON: "), "path"), F.concat("path", F.lit(" does not parse as JSON.")), F.col("path"), 0.9, "Fix the syntax at this line.", ("data-integrity", "crash"), 1, F.col("at"), "json", layer="fuzz"))


CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"


def empty_catches(files: DataFrame) -> DataFrame:
    """Findings for empty catch blocks, also over several lines: the text is split at them, and line breaks before each are counted."""
    rest = _rest(files)
    js = files.where(F.col("language").isin("javascript", "typescript", "vue", "svelte") & F.col("text").rlike(CATCH))
    parts = js.select(*rest, "path", "language", "text", F.split("text", CATCH, -1).alias("between"), F.regexp_extract_all("text", F.lit(CATCH), F.lit(0)).alias("at"))
    breaks = lambda s: F.regexp_count(s, F.lit("\n"))
    upto = lambda i: F.aggregate(F.slice("between", 1, i + 1), F.lit(0), lambda s, x: s + breaks(x)) + F.aggregate(F.slice("at", 1, i), F.lit(0), lambda s, x: s + breaks(x))
    lines = F.transform("at", lambda _, i: upto(i) + 1)
    each = parts.select(*rest, "path", "language", F.split("text", r"\r?\n", -1).alias("all"), F.explode(lines).alias("n"))
    tested = F.col("path").rlike(r"(^|/)(test|tests|__tests__|spec)/|\.(test|spec)\.")
    title = F.lit("Empty catch block")
    shown = F.substring(F.regexp_replace(F.element_at("all", F.col("n")), r"^\s+|\s+$", ""), 1, 200)
    out = each.select(*finding(rest, "static/dangerous-js", "catch-swallow", "low", title, F.concat(title, F.lit(" at "), "path", F.lit(":"), "n", F.lit(".")), F.col("path"), F.when(tested, 0.35).otherwise(0.7), "Log the error or handle it.", ("reliability",), 2, F.col("n"), F.col("language"), rule_ord=90, snippet=shown))
    return out.withColumn("column", F.lit(1))


def oversized(files: DataFrame) -> DataFrame:
    """Findings for files of many lines; a file with a line over 5000 characters is generated and left out."""
    rest = _rest(files)
    sized = files.where(F.col("language").isin(*BRACES, "python")).withColumn("all", F.split("text", r"\r?\n", -1)).where(~F.exists("all", lambda x: F.length(x) > 5000)).withColumn("n", F.size("all")).where(F.col("n") >= FILE_LINES[1])
    return sized.select(*finding(rest, "static/complexity", "oversized-file", F.when(F.col("n") >= FILE_LINES[0], "low").otherwise("info"), F.concat(F.lit("Oversized file ("), "n", F.lit(" lines)")), F.concat("path", F.lit(" has "), "n", F.lit(" lines.")), F.col("path"), 0.5, "Split the file.", ("maintainability",), 9, language=F.col("language"), meta=F.to_json(F.struct(F.col("n").alias("lines")))))


# ---- function metrics: a parser's state, so Python over each file

_BLANKED = [(re.compile(rf'{q}(?:[^{q}\\]|\\.)*{q}'), q + q) for q in "\"'`"] + [(re.compile(r"/(?:[^/\\\n]|\\.){2,}/"), "/RE/")]
_BRANCH = re.compile(r"\b(if|for|while|case|catch|switch)\b|&&|\|\||\?[^.:]|(?<=\W)\?(?=\s)")
_PY_BRANCH = re.compile(r"\b(if|elif|for|while|except|and|or)\b")
_START = re.compile(
    r"\b(?:function\s+([A-Za-z_$][\w$]*)|([A-Za-z_$][\w$]*)\s*(?:=|:)\s*(?:async\s+)?function|([A-Za-z_$][\w$]*)\s*(?:=|:)\s*(?:async\s*)?\([^)]*\)\s*=>"
    r"|(?:function|func)\s*\*?\s*([A-Za-z_$][\w$]*)?|(?:public|private|external|internal|def)\s+([A-Za-z_$][\w$]*)\s*\()"
)
_DEF = re.compile(r"^(\s*)def\s+([A-Za-z_]\w*)\s*\(")
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "typeof", "function"}
LONGEST_FUNCTION = 1200


def _blank(line: str) -> str:
    for pattern, new in _BLANKED:
        line = pattern.sub(new, line)
    return line


def brace_functions(lines: list[str]) -> Iterator[tuple]:
    """(name, first line, lines, complexity, nesting, signature) of functions in braces; what lies within one is part of it."""
    code, at = [_blank(x) for x in lines], 0
    while at < len(code):
        match = _START.search(code[at])
        name = next((g for g in match.groups() if g), "(anonymous)") if match else None
        if name is None or name in _CONTROL or not any("{" in x for x in code[at : at + 3]):
            at += 1
            continue
        depth = deepest = 0
        for end in range(at, min(len(code), at + LONGEST_FUNCTION)):
            for mark in re.findall("[{}]", code[end]):
                depth += 1 if mark == "{" else -1
                deepest = max(deepest, depth)
            if deepest and depth <= 0:
                break
        else:
            end = min(len(code), at + LONGEST_FUNCTION)
        body = "\n".join(code[at : end + 1]) + "\n"
        yield name, at + 1, end - at + 1, 1 + len(_BRANCH.findall(body)), deepest, lines[at].strip()
        at = end + 1


def python_functions(lines: list[str]) -> Iterator[tuple]:
    """The same of Python functions, by indentation; functions within functions are reported too."""
    for at, line in enumerate(lines):
        if not (match := _DEF.match(line)):
            continue
        indent, deepest, end = len(match[1]), 0, at + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
            if lines[end].strip():
                deepest = max(deepest, (len(lines[end]) - len(lines[end].lstrip()) - indent) // 4)
            end += 1
        yield match[2], at + 1, end - at, 1 + len(_PY_BRANCH.findall("\n".join(lines[at:end]))), deepest, line.strip()


METRIC = "name string, start_line int, lines int, complexity int, nesting int, signature string"


def function_metrics(files: DataFrame) -> DataFrame:
    """One row per function: name, start_line, lines, complexity, nesting, signature. Files are independent, so nothing is shuffled."""
    rest = _rest(files)
    chosen = files.where(F.col("language").isin(*BRACES, "python")).select(*rest, "path", "language", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                lines = re.split(r"\r?\n", row.text or "")
                if any(len(x) > 5000 for x in lines):
                    continue
                parse = python_functions if row.language == "python" else brace_functions
                out += [(*row[:-1], *f) for f in parse(lines)]
            yield pd.DataFrame(out, columns=[*pdf.columns[:-1], *(x.split()[0] for x in METRIC.split(", "))])

    return chosen.mapInPandas(run, f"{kinds}, {METRIC}")


def complexity(files: DataFrame) -> DataFrame:
    """Findings for complex, long and deeply nested functions, and for oversized files."""
    rest, probe = _rest(files), "static/complexity"
    m = function_metrics(files)
    at = F.concat("path", F.lit(":"), "start_line", F.lit(": "), "name")
    bad = F.when(F.col("complexity") >= COMPLEXITY[0], "medium").when(F.col("complexity") >= COMPLEXITY[1], "low")
    complex_ = m.where(bad.isNotNull()).select(*finding(rest, probe, "high-cyclomatic-complexity", bad, F.concat(F.lit("High cyclomatic complexity (~"), "complexity", F.lit(") in "), "name"), at, F.col("path"), 0.6, "Split the function.", ("complexity", "maintainability", "bug-risk"), 9, F.col("start_line"), F.col("language"), rule_ord=1, meta=F.to_json(F.struct("complexity", "lines", "nesting")), snippet=F.substring("signature", 1, 160)))
    long = F.when(F.col("lines") >= FUNCTION_LINES[0], "medium").when((F.col("lines") >= FUNCTION_LINES[1]) & bad.isNull(), "info")
    long_ = m.where(long.isNotNull()).select(*finding(rest, probe, "long-function", long, F.concat(F.lit("Long function ("), "lines", F.lit(" lines): "), "name"), at, F.col("path"), 0.5, "Split the function.", ("maintainability",), 9, F.col("start_line"), F.col("language"), rule_ord=2, meta=F.to_json(F.struct("lines"))))
    deep = m.where(F.col("nesting") >= NESTING).select(*finding(rest, probe, "deep-nesting", "low", F.concat(F.lit("Deep nesting ("), "nesting", F.lit(" levels) in "), "name"), at, F.col("path"), 0.5, "Return early or extract the inner blocks.", ("complexity", "maintainability"), 9, F.col("start_line"), F.col("language"), rule_ord=3, meta=F.to_json(F.struct("nesting"))))
    return union([complex_, long_, deep, oversized(files)])


def pull_request_target(files: DataFrame) -> DataFrame:
    """Workflows that run on pull_request_target: one finding a file, at the word's first line."""
    from siftspark.operators.catalog import CI_PATHS, DOCKER_PATHS

    rest = _rest(files)
    hit = files.where(F.col("path").rlike(CI_PATHS) & ~F.col("path").rlike(DOCKER_PATHS) & F.col("text").rlike(r"(?i)on:\s*[\s\S]{0,80}pull_request_target"))
    return hit.select(*finding(rest, "static/ci-docker", "ci-pull-request-target", "medium", F.lit("Workflow triggers on pull_request_target"), F.concat(F.lit("Fork code may run with the repository's secrets in "), "path"), F.col("path"), 0.6, "Do not check out or run the fork's code here.", ("supply-chain", "cwe-269"), 8, line_of(F.col("text"), F.lit("pull_request_target")), F.col("language"), rule_ord=91))


def debt_density(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Debt markers a file, and a thousand bytes; files of different repositories are kept apart."""
    repo = ["repo"] if "repo" in findings.columns and "repo" in files.columns else []
    markers = findings.where("probe = 'static/debt'").groupBy(*repo, F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("markers"))
    return markers.join(files.select(*repo, "path", "size"), [*repo, "path"]).withColumn("density", F.round(F.col("markers") * 1000 / F.greatest("size", F.lit(1)), 6)).drop("size")

