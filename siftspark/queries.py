"""The registered queries of the scanner, each with the SQL that gives the same rows.

Code comes from the fixtures, which are the same SELECT in both engines; prose and pages
come from the driver's tables. All queries run over whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.functions.tables import constant, stored
from siftspark.operators import catalog, findings as kept, fixes, history, lines as line_ops, report, structured
from siftspark.sources import files as sources, fixtures

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CODE = (catalog.JS, catalog.PYTHON, catalog.SOLIDITY, catalog.DEBT, catalog.ENV_LEAK, catalog.DOCKER, catalog.CI)
_STRIP = r"regexp_replace({}, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')"


def group_sql(group: catalog.Group) -> str:
    """The findings of a group's rules as SQL over code_lines."""
    guards = ["TRUE"]
    if group.languages is not None:
        guards.append(f"language IN ({', '.join(map(q, group.languages))})")
    if group.unless_languages:
        guards.append(f"language NOT IN ({', '.join(map(q, group.unless_languages))})")
    if group.paths is not None:
        guards.append(f"regexp_matches(path, {q(group.paths)})")
    if group.unless_paths is not None:
        guards.append(f"NOT regexp_matches(path, {q(group.unless_paths)})")
    if group.longest is not None:
        guards.append(f"length(line) <= {group.longest}")
    guards += [f"NOT starts_with(bare, {q(mark)})" for mark in group.comments]
    weight = f"CASE WHEN regexp_matches(path, {q(group.test_paths)}) THEN CAST({group.test_weight} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END" if group.test_paths else "CAST(1 AS DOUBLE)"
    parts = []
    for k, r in enumerate(group.rules):
        unless = r.re2_unless or r.unless
        fires = f"regexp_matches(line, {q(r.re2 or r.pattern)})" + (f" AND NOT regexp_matches(line, {q(unless)})" if unless else "")
        tags = "[" + ", ".join(map(q, r.tags)) + "]"
        parts.append(f"SELECT repo, {q(group.probe)} AS probe, {q(r.id)} AS rule_id, {q(r.severity)} AS severity, {q(r.title)} AS title, path AS file, line_no AS line, substring(bare, 1, 200) AS snippet, language, {q(r.hint)} AS fix_hint, CAST({r.confidence} AS DOUBLE) * {weight} AS confidence, {tags} AS tags, {line_ops.LAYERS.index(group.layer)} AS layer_ord, {group.order} AS probe_ord, {k} AS rule_ord FROM bare_lines WHERE {' AND '.join(guards)} AND {fires}")
    return " UNION ALL ".join(parts)


def shape_sql(expr: str) -> str:
    """SQL of the snippet normaliser."""
    steps = [(T.STRING, "STR"), (T.HEX, "HEX"), (T.NUMBER, "NUM")]
    marked = reduce(lambda e, s: f"regexp_replace({e}, {q(s[0])}, '{s[1]}', 'g')", steps, expr)
    words = f"list_transform(regexp_extract_all({marked}, '[A-Za-z_$][A-Za-z0-9_$]*|[^A-Za-z_$]+'), lambda w: CASE WHEN regexp_full_match(w, '[A-Za-z_$][A-Za-z0-9_$]*') AND w NOT IN ({', '.join(map(q, T.KEYWORDS))}) THEN 'ID' ELSE w END)"
    return rf"substring(trim(regexp_replace(coalesce(array_to_string({words}, ''), ''), '[\t-\r ]+', ' ', 'g')), 1, 200)"


_BARE = f"bare_lines AS (SELECT *, {_STRIP.format('line')} AS bare FROM code_lines)"
_RAW = f"raw AS ({' UNION ALL '.join(group_sql(g) for g in CODE)})"
_SIGNED = f"f AS (SELECT *, probe || '::' || rule_id || '::' || language || '::' || {shape_sql('''CASE WHEN snippet <> '' THEN snippet ELSE title END''')} AS signature FROM raw)"
_RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"
LINES = f"WITH {fixtures.LINES_SQL}, {_BARE}"
FOUND = f"{LINES}, {_RAW}, {_SIGNED}"
FILES = f"WITH {fixtures.FILES_SQL}"


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_ops.with_signature(line_ops.scan_lines(fixtures.code_lines(spark, sf_dir), CODE))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return sources.from_table(docs, F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.coalesce("text", F.lit("")))


# ---- sources


@query(r"SELECT path, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS l FROM documents)")
def lines_explode(spark, sf_dir):
    return sources.lines(doc_files(spark, sf_dir)).select("path", "line_no", "line")


@query(f"{FILES} SELECT language, count(*) AS files FROM code_files GROUP BY language")
def language_histogram(spark, sf_dir):
    return kept.languages(fixtures.code_files(spark, sf_dir))


_TEXTUAL = f"(language <> 'unknown' OR regexp_matches(path, {q(T.SECURITY_NAMES)}) OR regexp_matches(path, {q(T.SECURITY_EXTENSIONS)}) OR regexp_matches(path, {q(T.TEXT_EXTENSIONS)}))"
_WALKED = f"NOT list_has_any(string_split(path, '/')[:-2], [{', '.join(map(q, sources.IGNORED_DIRS))}]) AND NOT regexp_matches(path, {q(sources.IGNORED_NAMES)}) AND size <= {sources.MOST_BYTES} AND {_TEXTUAL}"


@query(f"{FILES} SELECT repo, path, size, language FROM code_files WHERE {_WALKED}")
def walk_filter(spark, sf_dir):
    return sources.walk(fixtures.code_files(spark, sf_dir)).select("repo", "path", "size", "language")


@query(f"{FILES} SELECT path, {_TEXTUAL} AS text_source, regexp_matches(path, {q(T.SECURITY_NAMES)}) OR regexp_matches(path, {q(T.SECURITY_EXTENSIONS)}) AS security_file FROM code_files")
def file_kinds(spark, sf_dir):
    return fixtures.code_files(spark, sf_dir).select("path", T.is_text_source(F.col("path")).alias("text_source"), T.is_security_file(F.col("path")).alias("security_file"))


@query(f"{FILES} SELECT repo, path FROM code_files WHERE language = 'json'")
def only_files_semi(spark, sf_dir):
    files = fixtures.code_files(spark, sf_dir)
    allowed = files.where("language = 'json'").select(F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    return sources.only_files(files, sources.changed_files(allowed, allowed)).select("repo", "path")


@query(f"{FILES} SELECT DISTINCT string_split(path, '/')[1] AS project FROM code_files WHERE regexp_matches(path, '^[^/.][^/]*/(package.json|Cargo.toml|go.mod)$')")
def project_discovery(spark, sf_dir):
    return sources.discover_projects(fixtures.code_files(spark, sf_dir).select("path"))


# ---- line rules

_LINE_COLUMNS = ("repo", "probe", "rule_id", "severity", "title", "file", "line", "snippet", "language", "confidence")


def _rules(name: str, *groups: catalog.Group, columns=_LINE_COLUMNS) -> None:
    def run(spark, sf_dir):
        return line_ops.scan_lines(fixtures.code_lines(spark, sf_dir), groups).select(*columns)

    run.__name__ = name
    query(f"{LINES}, raw AS ({' UNION ALL '.join(map(group_sql, groups))}) SELECT {', '.join(columns)} FROM raw")(run)


_rules("rules_js", catalog.JS)
_rules("rules_python", catalog.PYTHON)
_rules("rules_solidity", catalog.SOLIDITY)
_rules("rules_debt", catalog.DEBT)
_rules("rules_env_leak", catalog.ENV_LEAK)
_rules("rules_ci_docker", catalog.DOCKER, catalog.CI)
_rules("rules_secrets", catalog.SECRETS, columns=("repo", "rule_id", "severity", "file", "line", "confidence"))

CUSTOM = [
    {"id": "hex-token", "pattern": 'token = "[0-9a-f]{40}"', "severity": "high", "title": "Token in prose", "tags": ["secret"], "confidence": 0.9},
    {"id": "mail", "pattern": "[a-z0-9._]+@[a-z0-9.]+[.][a-z]{2,}", "severity": "low", "title": "Mail address", "languages": ["*"]},
    {"id": "wrong-language", "pattern": "the", "severity": "info", "title": "Never", "languages": ["python"]},
]
_CUSTOM_SQL = " UNION ALL ".join(f"SELECT {q(r['id'])} AS rule_id, {q(r['severity'])} AS severity, path AS file, line_no AS line, CAST(instr(line, regexp_extract(line, {q(r['pattern'])})) AS INTEGER) AS \"column\", CAST({r.get('confidence', 0.7)} AS DOUBLE) AS confidence FROM l WHERE length(line) <= 2000 AND regexp_matches(line, {q(r['pattern'])})" for r in CUSTOM[:2])


@query(rf"WITH l AS (SELECT path, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS l FROM documents)) {_CUSTOM_SQL}")
def custom_rules_match(spark, sf_dir):
    rules, _ = line_ops.custom_rule_table(spark, CUSTOM)
    return line_ops.scan_custom(sources.lines(doc_files(spark, sf_dir)), rules).select("rule_id", "severity", "file", "line", "column", "confidence")


# ---- whole files

_LINE_OF = "CAST(CASE WHEN instr(text, {0}) > 0 THEN len(regexp_extract_all(substring(text, 1, CAST(instr(text, {0}) AS BIGINT) - 1), chr(10))) + 1 ELSE 1 END AS INTEGER)"
_DEPS = rf"""{FILES}, pk AS (SELECT repo, path, text, regexp_replace(path, 'package[.]json$', '') AS dir FROM code_files WHERE regexp_matches(path, '(^|/)package[.]json$')),
ok AS (SELECT * FROM pk WHERE (json_valid(text) AND NOT regexp_matches(text, ',\s*[}}\]]'))),
kinds(kind, rank) AS (VALUES ('dependencies', 1), ('devDependencies', 2), ('optionalDependencies', 3), ('peerDependencies', 4)),
each AS (SELECT repo, path, text, dir, rank, unnest(json_keys(text, '$.' || kind)) AS name, kind FROM ok, kinds),
valued AS (SELECT *, json_extract_string(text, '$.' || kind || '."' || name || '"') AS version FROM each),
deps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY rank DESC) AS n FROM valued) WHERE n = 1),
scripts AS (SELECT *, json_extract_string(text, '$.scripts."' || script || '"') AS command FROM (SELECT repo, path, text, unnest(json_keys(text, '$.scripts')) AS script FROM ok))"""
_DEP_COLUMNS = ("repo", "rule_id", "severity", "title", "file", "line", "confidence")


def _deps(spark, sf_dir, *rules):
    return structured.dependencies(fixtures.code_files(spark, sf_dir)).where(F.col("rule_id").isin(*rules)).select(*_DEP_COLUMNS)


@query(f"""{_DEPS} SELECT repo, 'wildcard-dependency' AS rule_id, 'medium' AS severity, 'Unpinned dependency: ' || name || '@' || CASE WHEN version = '' THEN '(empty)' ELSE version END AS title, path AS file, {_LINE_OF.format('name')} AS line, CAST(0.8 AS DOUBLE) AS confidence FROM deps WHERE regexp_matches(version, {q(structured.UNBOUNDED)})
UNION ALL SELECT repo, 'nonregistry-dependency', 'low', 'Non-registry dependency: ' || name, path, {_LINE_OF.format('name')}, CAST(0.6 AS DOUBLE) FROM deps WHERE regexp_matches(version, {q(structured.NONREGISTRY)})""")
def deps_wildcard(spark, sf_dir):
    return _deps(spark, sf_dir, "wildcard-dependency", "nonregistry-dependency")


@query(rf"""{_DEPS} SELECT repo, 'invalid-package-json' AS rule_id, 'high' AS severity, 'package.json is not valid JSON' AS title, path AS file, CAST(1 AS INTEGER) AS line, CAST(0.99 AS DOUBLE) AS confidence FROM pk WHERE NOT (json_valid(text) AND NOT regexp_matches(text, ',\s*[}}\]]'))
UNION ALL SELECT DISTINCT d.repo, 'missing-lockfile', 'medium', 'No lockfile alongside package.json', d.path, CAST(1 AS INTEGER), CAST(0.7 AS DOUBLE) FROM deps d WHERE NOT EXISTS (SELECT 1 FROM code_files c WHERE c.repo = d.repo AND c.path IN ({', '.join(f"d.dir || '{x}'" for x in structured.LOCKS)}))""")
def deps_lockfile(spark, sf_dir):
    return _deps(spark, sf_dir, "invalid-package-json", "missing-lockfile")


@query(f"""{_DEPS} SELECT repo, 'install-script-hook' AS rule_id, 'low' AS severity, 'Lifecycle install hook present: ' || script AS title, path AS file, {_LINE_OF.format(chr(39) + chr(34) + chr(39) + " || script || " + chr(39) + chr(34) + chr(39))} AS line, CAST(0.5 AS DOUBLE) AS confidence FROM scripts WHERE script IN ({', '.join(map(q, structured.HOOKS))}) AND command <> ''
UNION ALL SELECT repo, 'script-remote-exec', 'high', 'npm script "' || script || '" pipes remote content into a shell', path, {_LINE_OF.format(chr(39) + chr(34) + chr(39) + " || script || " + chr(39) + chr(34) + chr(39))}, CAST(0.8 AS DOUBLE) FROM scripts WHERE regexp_matches(command, {q(structured.REMOTE)})""")
def deps_scripts(spark, sf_dir):
    return _deps(spark, sf_dir, "install-script-hook", "script-remote-exec")


_BASE = "regexp_extract(path, '[^/]*$')"
_ALWAYS = r"(regexp_matches(" + _BASE + r", '(?i)\.(key|p12|pfx|pkcs12|keystore|jks|ppk|kdbx)$') OR regexp_matches(" + _BASE + r", '^(id_rsa|id_dsa|id_ecdsa|id_ed25519|\.wallet-key)$'))"


@query(f"""{FILES} SELECT repo, 'committed-dotenv' AS rule_id, 'high' AS severity, path AS file, CAST(0.75 AS DOUBLE) AS confidence FROM code_files WHERE regexp_matches({_BASE}, {q(structured.DOTENV)}) AND NOT regexp_matches({_BASE}, {q(structured.DOTENV_SAMPLES)})
UNION ALL SELECT repo, 'key-file-committed', 'critical', path, CAST(0.85 AS DOUBLE) FROM code_files WHERE {_ALWAYS}
UNION ALL SELECT repo, CASE WHEN regexp_matches(text, {q(structured.PRIVATE_KEY)}) THEN 'key-file-committed' ELSE 'cert-file-committed' END, CASE WHEN regexp_matches(text, {q(structured.PRIVATE_KEY)}) THEN 'critical' ELSE 'info' END, path, CASE WHEN regexp_matches(text, {q(structured.PRIVATE_KEY)}) THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END FROM code_files WHERE NOT {_ALWAYS} AND regexp_matches({_BASE}, {q(structured.MAYBE_KEYS)})""")
def key_files(spark, sf_dir):
    return structured.hygiene(fixtures.code_files(spark, sf_dir)).where("rule_id not in ('env-not-ignored', 'missing-gitignore')").select("repo", "rule_id", "severity", "file", "confidence")


@query(rf"""{FILES}, p AS (SELECT repo, bool_or(regexp_matches(path, '(^|/)\.env(\.|$)')) AS has_env, bool_or(path = '.gitignore') AS has_ignore, bool_or(path = '.gitignore' AND regexp_matches(text, '(^|\n)\s*\.?\*?\.env')) AS ignores_env, bool_or(regexp_matches(path, {q(structured.MANIFESTS)})) AS has_manifest FROM code_files GROUP BY repo)
SELECT repo, 'env-not-ignored' AS rule_id, CASE WHEN has_ignore THEN '.gitignore' ELSE '(repo root)' END AS file FROM p WHERE has_env AND NOT ignores_env UNION ALL SELECT repo, 'missing-gitignore', '(repo root)' FROM p WHERE has_manifest AND NOT has_ignore""")
def config_project_flags(spark, sf_dir):
    return structured.hygiene(fixtures.code_files(spark, sf_dir)).where("rule_id in ('env-not-ignored', 'missing-gitignore')").select("repo", "rule_id", "file")


@query(rf"""{FILES}, j AS (SELECT repo, path, CASE WHEN regexp_matches(path, {q(structured.JSONC)}) THEN regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '(?m)(^|[^:])//.*$', '\1', 'g'), ',([\t-\r ]*[}}\]])', '\1', 'g') ELSE text END AS cleaned FROM code_files WHERE (language = 'json' OR regexp_matches(path, '[.]json$')) AND regexp_matches(text, '\S'))
SELECT repo, path, json_valid(cleaned) AND NOT regexp_matches(cleaned, ',\s*[}}\]]') AS valid FROM j""")
def json_validity(spark, sf_dir):
    return structured.json_files(fixtures.code_files(spark, sf_dir)).select("repo", "path", "valid")


@query(f"""{FILES}, p AS (SELECT repo, bool_or(path = 'package.json') AS package, bool_or(regexp_matches(path, {q(structured.TEST_FILES)})) AS tests, bool_or(regexp_matches(path, 'requirements[.]txt$|pyproject[.]toml$|setup[.]py$')) AS python FROM code_files GROUP BY repo)
SELECT repo, 'no-tests' AS rule_id, 'package.json' AS file FROM p WHERE package AND NOT tests UNION ALL SELECT repo, 'no-tests', '(repo root)' FROM p WHERE NOT package AND python AND NOT tests""")
def no_tests(spark, sf_dir):
    return structured.no_tests(fixtures.code_files(spark, sf_dir)).select("repo", "rule_id", "file")


@query(f"""SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id || '.py' AS path, CAST(len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS INTEGER) AS lines, CASE WHEN len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) >= {structured.FILE_LINES[0]} THEN 'low' ELSE 'info' END AS severity FROM documents WHERE len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) >= {structured.FILE_LINES[1]} AND list_max(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: length(x))) <= 5000""")
def oversized_file(spark, sf_dir):
    files = doc_files(spark, sf_dir).withColumn("path", F.regexp_replace("path", "[.]txt$", ".py")).withColumn("language", F.lit("python"))
    return structured.oversized(files).select(F.col("file").alias("path"), F.get_json_object("meta", "$.lines").cast("int").alias("lines"), "severity")


@query()
def fn_complexity(spark, sf_dir):
    """Function metrics of the generated code, file by file."""
    files = fixes.files_of(fixtures.code_lines(spark, sf_dir)).withColumn("size", F.length("text").cast("long"))
    return structured.function_metrics(files)


@query(rf"""{FILES}, c AS (SELECT repo, path, regexp_split_to_array(text, 'catch\s*\([^)]*\)\s*\{{\s*\}}') AS parts, regexp_extract_all(text, 'catch\s*\([^)]*\)\s*\{{\s*\}}') AS hits FROM code_files WHERE language IN ('javascript', 'typescript', 'vue', 'svelte') AND NOT starts_with(path, 'node_modules')),
e AS (SELECT repo, path, parts, hits, unnest(range(1, len(hits) + 1)) AS i FROM c)
SELECT repo, path AS file, CAST(1 + len(regexp_extract_all(array_to_string(parts[1:i], ''), '\n')) + len(regexp_extract_all(coalesce(array_to_string(hits[1:i - 1], ''), ''), '\n')) AS INTEGER) AS line FROM e""")
def catch_swallow_multiline(spark, sf_dir):
    return structured.empty_catches(sources.walk(fixtures.code_files(spark, sf_dir))).select("repo", "file", "line")


@query()
def json_error_line(spark, sf_dir):
    """Where JSON files stop to parse: the parser's own line."""
    return structured.malformed_json(sources.walk(fixtures.code_files(spark, sf_dir))).select("repo", "file", "line", "title")


@query(rf"""{FILES} SELECT repo, path AS file, {_LINE_OF.format("'pull_request_target'")} AS line FROM code_files WHERE regexp_matches(path, {q(catalog.CI_PATHS)}) AND regexp_matches(text, '(?i)on:\s*[\s\S]{{0,80}}pull_request_target')""")
def workflow_target(spark, sf_dir):
    return structured.pull_request_target(fixtures.code_files(spark, sf_dir)).select("repo", "file", "line")


@query("SELECT event_type || '-failed' AS rule_id, count(*) AS findings FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def command_results(spark, sf_dir):
    """Commands that others ran, as findings: each event stands for a command whose exit code is its id modulo 3."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ran = events.select(F.col("event_type").alias("kind"), F.pmod("event_id", F.lit(3)).cast("int").alias("exit_code"), F.lit("").alias("stdout"), F.col("props").alias("stderr"), F.lit(False).alias("timed_out"))
    return structured.command_results(ran).groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


# ---- scalars

_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]{16,}')) AS word FROM documents"


def _long_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]{16,}"), F.lit(0))).alias("word")).distinct()


@query(f"SELECT word, round(list_aggregate(string_split(word, ''), 'entropy'), 6) AS entropy, round(length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) / CAST(length(word) AS DOUBLE), 6) AS alnum, regexp_matches(word, '^[A-Za-z0-9+/=_-]{{16,}}$') AND length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) / CAST(length(word) AS DOUBLE) > 0.85 AS token FROM ({_WORDS})")
def entropy_score(spark, sf_dir):
    w = F.col("word")
    return _long_words(spark, sf_dir).select("word", F.round(T.shannon_entropy(w), 6).alias("entropy"), F.round(T.alnum_ratio(w), 6).alias("alnum"), T.looks_like_token(w).alias("token"))


_TOKENS = r"regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.]+', ' ', 'g')"
_CLASSIFY = rf"""{LINES}, c AS (SELECT repo, path, line_no, line, unnest(regexp_extract_all(line, {q(T.CANDIDATE)}, 1)) AS value FROM code_lines WHERE length(line) <= 2000),
v AS (SELECT *, regexp_replace({_STRIP.format('value')}, '^0[xX]', '') AS p, replace(line, value, '') AS context, regexp_extract(line, '([A-Za-z_$][\w$.-]*)["''`]?\s*[:=]\s*["''`]', 1) AS name FROM c),
w AS (SELECT *, {_TOKENS.format('name')} || ' ' || {_TOKENS.format('context')} AS around, regexp_matches(p, '^[0-9a-fA-F]+$') AS hex, list_aggregate(string_split(p, ''), 'entropy') AS bits FROM v),
x AS (SELECT *, regexp_matches(around, {q(T.SECRET_WORDS)}) AS named FROM w)
SELECT repo, path, line_no, CASE WHEN hex THEN 'hex' WHEN regexp_matches(p, '^[A-Za-z0-9+/]+=*$') THEN 'base64' ELSE 'token' END AS kind, round(bits, 2) AS entropy, named AS secret_name FROM x
WHERE length(p) BETWEEN 20 AND 200 AND regexp_matches(p, '^[A-Za-z0-9+/=_-]{{16,}}$') AND length(regexp_replace(p, '[^A-Za-z0-9]', '', 'g')) / CAST(length(p) AS DOUBLE) > 0.85
AND NOT regexp_matches(p, '^[0-9a-fA-F]{{40}}$') AND NOT regexp_matches(p, {q(T.SLUG)}) AND NOT regexp_matches(p, {q(T.UUID)}) AND NOT regexp_matches(around, {q(T.HASH_WORDS)}) AND NOT regexp_matches(context, {q(T.DATA_CONTEXT)}) AND NOT (hex AND length(p) = 64 AND NOT named) AND bits >= CASE WHEN hex THEN 3.0 ELSE 4.0 END"""


@query(_CLASSIFY)
def secret_classify(spark, sf_dir):
    lines = fixtures.code_lines(spark, sf_dir).where(F.length("line") <= 2000)
    each = lines.select("repo", "path", "line_no", "line", F.explode(T.candidates(F.col("line"))).alias("value"))
    name = F.regexp_extract("line", r"([A-Za-z_$][\w$.-]*)[\"'`]?\s*[:=]\s*[\"'`]", 1)
    judged = each.withColumn("c", T.classify_secret(F.col("value"), F.replace(F.col("line"), F.col("value"), F.lit("")), name)).where("c is not null")
    return judged.select("repo", "path", "line_no", "c.kind", "c.entropy", "c.secret_name")


@query(f"SELECT word, substring(word, 1, 4) || '…******…' || right(word, 4) AS hidden, substring(word, 1, 4) || '…[' || length(word) || ' chars, redacted]…' || right(word, 2) AS counted FROM ({_WORDS})")
def secret_redact(spark, sf_dir):
    return _long_words(spark, sf_dir).select("word", T.redact(F.col("word")).alias("hidden"), T.redact_entropy(F.col("word")).alias("counted"))


@query(f"WITH l AS (SELECT DISTINCT unnest(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) AS line FROM documents) SELECT line, {shape_sql('line')} AS shape FROM l")
def normalize_signature(spark, sf_dir):
    return sources.lines(doc_files(spark, sf_dir)).select("line").distinct().select("line", T.normalize_snippet(F.col("line")).alias("shape"))


_HASH_SQL = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(signature, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, x: (h * 31 + x) % 4294967296)"
_BASE36 = "substring(ltrim(array_to_string(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(1 + (h // CAST(36 ** k AS BIGINT)) % 36 AS BIGINT), 1)), ''), '0'), 1, 6)"


@query(f"{FOUND}, s AS (SELECT DISTINCT signature FROM f), n AS (SELECT signature, {_HASH_SQL} AS h FROM s) SELECT signature, {_BASE36} AS hash FROM n")
def short_hash(spark, sf_dir):
    return raw_findings(spark, sf_dir).select("signature").distinct().select("signature", T.short_hash(F.col("signature")).alias("hash"))


_TEMPLATE = r"substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, " + q(T.STRING) + r", '<STR>', 'g'), '\b0x[0-9a-fA-F]+\b', '<HEX>', 'g'), '\b\d+\b', '<NUM>', 'g'), '[\t-\r ]+', ' ', 'g')), 1, 160)"
_REGEX = r"regexp_replace(replace(replace(replace(regexp_replace(trim({0}), '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), '<STR>', '[" + '"' + "''`][^" + '"' + "''`]*[" + '"' + r"''`]'), '<HEX>', '0x[0-9a-fA-F]+'), '<NUM>', '\d+'), '[\t-\r ]+', '\\s+', 'g')"


@query(f"{LINES}, t AS (SELECT DISTINCT {_TEMPLATE.format('bare')} AS template FROM bare_lines), r AS (SELECT template, {_REGEX.format('template')} AS source FROM t) SELECT template, CASE WHEN regexp_matches(regexp_replace(template, '<STR>|<HEX>|<NUM>', '', 'g'), '[A-Za-z]{{3,}}') AND length(source) BETWEEN 6 AND 300 THEN source END AS pattern FROM r")
def rule_templates(spark, sf_dir):
    shown = fixtures.code_lines(spark, sf_dir).select(T.template(T.strip(F.col("line"))).alias("template")).distinct()
    return shown.select("template", T.template_to_regex(F.col("template")).alias("pattern"))


# ---- suppression, order, summaries

_MARKS = r"""marks AS (SELECT repo, path, CASE WHEN kind = 'disable-next-line' THEN line_no + 1 ELSE line_no END AS line_no, target FROM (SELECT repo, path, line_no, regexp_extract(line, 'sift-(ignore|disable-next-line|disable-line)(?::?\s+([^\s*]+))?', 1) AS kind, regexp_extract(line, 'sift-(ignore|disable-next-line|disable-line)(?::?\s+([^\s*]+))?', 2) AS target FROM code_lines) WHERE kind <> '')"""


@query(f"{FOUND}, {_MARKS} SELECT repo, rule_id, file, line FROM f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.repo = f.repo AND m.path = f.file AND m.line_no = f.line AND (target = '' OR rule_id = target OR ends_with(rule_id, '/' || target) OR rule_id = regexp_replace(target, '^.*/', '')))")
def suppress_directives(spark, sf_dir):
    return kept.suppress(raw_findings(spark, sf_dir), fixtures.code_lines(spark, sf_dir)).select("repo", "rule_id", "file", "line")


GLOBS = ["contracts/", "**/*.test.ts", "/lib/u1*.py"]


@query(rf"{FOUND} SELECT repo, rule_id, file, line FROM f WHERE NOT starts_with(file, 'contracts/') AND NOT regexp_matches(file, '[.]test[.]ts$') AND NOT regexp_matches(file, '^lib/u1[^/]*[.]py$')")
def ignore_globs(spark, sf_dir):
    globs = [T.compile_glob(g) for g in GLOBS]
    return raw_findings(spark, sf_dir).where(~F.col("file").rlike("|".join(f"(?:{g})" for g in globs))).select("repo", "rule_id", "file", "line")


_DEDUPED = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, signature, file, line ORDER BY layer_ord, probe_ord, probe, rule_ord) AS n FROM f) WHERE n = 1)"
_KEY = "signature || '@@' || file"


@query(f"{FOUND}, {_DEDUPED} SELECT repo, signature, file, line, rule_id FROM d")
def dedupe_first(spark, sf_dir):
    return kept.dedupe(raw_findings(spark, sf_dir)).select("repo", "signature", "file", "line", "rule_id")


@query(f"{FOUND} SELECT severity, confidence, file, line, rule_id FROM f ORDER BY {_RANK} DESC, confidence DESC, lower(file), file, line, layer_ord, probe_ord, rule_ord, rule_id, snippet LIMIT 200")
def rank_order_topk(spark, sf_dir):
    """The 200 findings that a table report shows."""
    return kept.ranked(raw_findings(spark, sf_dir), report.TABLE_ROWS).select("severity", "confidence", "file", "line", "rule_id")


@query(f"{FOUND} SELECT repo, rule_id, severity, file, line FROM f WHERE {_RANK} >= 3")
def severity_floor(spark, sf_dir):
    return kept.floor(raw_findings(spark, sf_dir), "high").select("repo", "rule_id", "severity", "file", "line")


@query(f"{FOUND} SELECT v.severity, count(f.severity) AS findings FROM (VALUES ('info'), ('low'), ('medium'), ('high'), ('critical')) v(severity) LEFT JOIN f ON f.severity = v.severity GROUP BY v.severity")
def summary_by_severity(spark, sf_dir):
    return kept.by_severity(raw_findings(spark, sf_dir))


@query(f"{FOUND} SELECT 'probe' AS kind, probe AS name, count(*) AS findings FROM f GROUP BY probe UNION ALL SELECT 'rule', rule_id, count(*) FROM f GROUP BY rule_id")
def summary_by_probe_rule(spark, sf_dir):
    return kept.by_probe_and_rule(raw_findings(spark, sf_dir))


@query(f"{FOUND} SELECT count(*) AS findings, round(sum({_RANK} * (0.5 + confidence / 2)), 6) AS risk_score FROM f")
def risk_score(spark, sf_dir):
    return kept.risk(raw_findings(spark, sf_dir))


@query(f"{FOUND} SELECT repo, count(*) AS findings, round(sum({_RANK} * (0.5 + confidence / 2)), 6) AS risk_score FROM f GROUP BY repo")
def sweep_by_repo(spark, sf_dir):
    return kept.risk(raw_findings(spark, sf_dir), "repo")


@query(f"{FOUND} SELECT file AS path, count(*) AS markers, round(count(*) * 1000 / CAST(any_value(s.size) AS DOUBLE), 6) AS density FROM f JOIN (SELECT path, sum(length(line)) AS size FROM code_lines GROUP BY path) s ON s.path = f.file WHERE probe = 'static/debt' GROUP BY file")
def debt_density(spark, sf_dir):
    sizes = fixtures.code_lines(spark, sf_dir).groupBy("path").agg(F.sum(F.length("line")).alias("size"))
    return structured.debt_density(raw_findings(spark, sf_dir), sizes)


# ---- history: the baseline accepts what is high or worse, and two keys that no finding has

_BASELINE = f"b AS (SELECT DISTINCT {_KEY} AS key FROM f WHERE {_RANK} >= 3 UNION ALL VALUES ('gone::a@@x'), ('gone::b@@y'))"


def _baseline(spark, found):
    return history.accepted_keys(kept.floor(found, "high")).union(constant(spark, [("gone::a@@x",), ("gone::b@@y",)], "key string"))


@query(f"{FOUND}, {_BASELINE} SELECT repo, rule_id, file, line FROM f WHERE {_KEY} NOT IN (SELECT key FROM b)")
def baseline_new(spark, sf_dir):
    found = raw_findings(spark, sf_dir)
    return history.new_findings(found, _baseline(spark, found)).select("repo", "rule_id", "file", "line")


@query(f"{FOUND}, {_BASELINE} SELECT repo, rule_id, file, line FROM f WHERE {_KEY} IN (SELECT key FROM b)")
def baseline_accepted(spark, sf_dir):
    found = raw_findings(spark, sf_dir)
    return history.accepted_findings(found, _baseline(spark, found)).select("repo", "rule_id", "file", "line")


@query(f"{FOUND}, {_BASELINE} SELECT key FROM b WHERE key NOT IN (SELECT {_KEY} FROM f)")
def baseline_fixed(spark, sf_dir):
    found = raw_findings(spark, sf_dir)
    return history.fixed_keys(found, _baseline(spark, found))


_CORPUS_HASH = "substring(sha1(rule_id || '|' || language || '|' || snippet), 1, 16)"


@query(f"{FOUND} SELECT DISTINCT rule_id AS label, language, snippet, {_CORPUS_HASH} AS hash FROM f")
def corpus_hash(spark, sf_dir):
    return history.examples(raw_findings(spark, sf_dir)).select("label", "language", "snippet", "hash").distinct()


@query(f"{FOUND}, e AS (SELECT {_CORPUS_HASH} AS hash, rule_id AS label, tags[1] AS category, repo AS source_repo, file AS context_path, snippet FROM f) SELECT hash, label, category, source_repo, context_path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY source_repo, context_path, snippet) AS n FROM e) WHERE n = 1")
def corpus_dedupe(spark, sf_dir):
    return history.dedupe_corpus(history.examples(raw_findings(spark, sf_dir))).select("hash", "label", "category", "source_repo", "context_path")


@query(f"{FOUND} SELECT 'all' AS kind, '' AS name, count(*) AS examples FROM f UNION ALL SELECT 'label', rule_id, count(*) FROM f GROUP BY rule_id UNION ALL SELECT 'language', language, count(*) FROM f GROUP BY language UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity")
def corpus_stats_grouping_sets(spark, sf_dir):
    return history.corpus_stats(history.examples(raw_findings(spark, sf_dir)))


_OBSERVED = f"""fp AS (SELECT signature, file, min((layer_ord * 1000 + probe_ord) * 1000 + rule_ord) AS place FROM f GROUP BY signature, file),
fn AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY place, file) AS n FROM fp),
ex AS (SELECT signature, array_to_string(list(file ORDER BY n), ',') AS examples FROM fn WHERE n <= 5 GROUP BY signature),
seen AS (SELECT signature, any_value(rule_id) AS rule_id, any_value(severity) AS severity, any_value(title) AS title, any_value(language) AS language, count(*) AS n FROM f GROUP BY signature)"""


@query(f"{FOUND}, {_OBSERVED} SELECT signature, rule_id, severity, CASE WHEN {_RANK} >= 3 THEN 2 * n ELSE n END AS \"count\", examples FROM seen JOIN ex USING (signature)")
def kb_upsert(spark, sf_dir):
    """A first run that saw what is high or worse, and a second that sees everything."""
    reduced = stored(history.by_file(raw_findings(spark, sf_dir), "severity"))
    first = history.observe_files(kept.floor(reduced, "high"), "2024-01-01")
    return history.upsert(first, history.observe_files(reduced, "2024-01-02")).select("signature", "rule_id", "severity", "count", F.array_join("examples", ",").alias("examples"))


@query(f"{FOUND}, {_OBSERVED} SELECT signature, n AS \"count\", CASE WHEN n >= 3 THEN 'candidate-rule' ELSE 'observed' END AS status FROM seen")
def kb_promote(spark, sf_dir):
    return history.promote(history.observe(raw_findings(spark, sf_dir))).select("signature", "count", "status")


@query(f"{FOUND}, {_OBSERVED} SELECT 'status' AS kind, CASE WHEN n >= 3 THEN 'candidate-rule' ELSE 'observed' END AS name, count(*) AS entries FROM seen GROUP BY ALL UNION ALL SELECT 'language', language, count(*) FROM seen GROUP BY ALL")
def kb_stats(spark, sf_dir):
    return history.kb_stats(history.promote(history.observe(raw_findings(spark, sf_dir))))


@query(f"{FOUND}, ft AS (SELECT *, {_TEMPLATE.format('snippet')} AS template FROM f), tp AS (SELECT signature, rule_id, severity, arg_min(template, (((layer_ord * 1000 + probe_ord) * 1000 + rule_ord), file, line)) AS template, count(*) AS n FROM ft GROUP BY signature, rule_id, severity), r AS (SELECT *, {_HASH_SQL} AS h, {_REGEX.format('template')} AS source FROM tp WHERE n >= 3) SELECT 'learned-' || rule_id || '-' || {_BASE36} AS id, source AS pattern, severity, n AS seen FROM r WHERE regexp_matches(regexp_replace(template, '<STR>|<HEX>|<NUM>', '', 'g'), '[A-Za-z]{{3,}}') AND length(source) BETWEEN 6 AND 300")
def rule_proposals(spark, sf_dir):
    drafted = history.proposals(history.promote(history.observe(raw_findings(spark, sf_dir))))
    return drafted.select("id", "pattern", "severity", F.col("provenance.count").alias("seen"))


# ---- fixes and reports


@query(f"{FOUND} SELECT '[{report.TOOL}/' || upper(severity) || '] ' || title || ' in ' || file AS title, array_to_string(['{report.TOOL}', 'severity:' || severity, tags[1]], ',') AS labels, signature, file || ':' || line || CASE WHEN probe IN ('static/dangerous-js', 'static/solidity') THEN ':1' ELSE '' END AS finding FROM f WHERE {_RANK} >= 2 ORDER BY {_RANK} DESC, confidence DESC, lower(file), file, line, layer_ord, probe_ord, rule_ord, rule_id, snippet LIMIT {report.ISSUES}")
def issue_plan(spark, sf_dir):
    """The 25 issues that a run may file."""
    return report.issue_plan(raw_findings(spark, sf_dir)).select("title", F.array_join("labels", ",").alias("labels"), "signature", "finding")


@query(f"{FOUND} SELECT CASE WHEN {_RANK} >= 3 THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, rule_id, count(*) AS results FROM f GROUP BY ALL")
def sarif_levels(spark, sf_dir):
    return report.sarif_results(raw_findings(spark, sf_dir)).groupBy("level", F.col("ruleId").alias("rule_id")).agg(F.count(F.lit(1)).alias("results"))


_FIX_RULES = ("debugger-stmt", "tx-origin-auth", "py-yaml-load", "py-requests-noverify", "py-mktemp", "floating-pragma", "py-bare-except")


@query(rf"""{FOUND} SELECT f.repo, f.file, f.line, rule_id, CASE rule_id WHEN 'tx-origin-auth' THEN regexp_replace(l.line, '\btx\.origin\b|tx\.origin', 'msg.sender', 'g') WHEN 'py-yaml-load' THEN regexp_replace(regexp_replace(l.line, ',\s*Loader\s*=\s*[\w.]+', '', 'g'), 'yaml\.load\s*\(', 'yaml.safe_load(', 'g')
WHEN 'py-requests-noverify' THEN regexp_replace(l.line, ',\s*verify\s*=\s*False|verify\s*=\s*False\s*,?\s*', '', 'g') WHEN 'py-mktemp' THEN regexp_replace(l.line, 'tempfile\.mktemp\s*\(', 'tempfile.mkstemp(', 'g') WHEN 'floating-pragma' THEN regexp_replace(l.line, '(pragma\s+solidity\s+)\^', '\1', 'g') WHEN 'py-bare-except' THEN regexp_replace(l.line, 'except\s*:', 'except Exception:', 'g') END AS replacement
FROM f JOIN code_lines l ON l.repo = f.repo AND l.path = f.file AND l.line_no = f.line WHERE rule_id IN ({', '.join(map(q, _FIX_RULES))})""")
def fix_replace(spark, sf_dir):
    found = raw_findings(spark, sf_dir).where(F.col("rule_id").isin(*_FIX_RULES))
    return fixes.with_fixes(found, fixtures.code_lines(spark, sf_dir)).select("repo", "file", "line", "rule_id", "fix.replacement")


@query()
def scan_all(spark, sf_dir):
    """The whole scan of the generated files: all probes, suppression, first per key."""
    from siftspark.plans.scan import scan

    files = fixtures.code_files(spark, sf_dir).unionByName(fixes.files_of(fixtures.code_lines(spark, sf_dir)).withColumn("size", F.length("text").cast("long")))
    found = scan(spark, files, exec_=True, custom_rules=CUSTOM).findings
    return found.select("repo", "probe", "rule_id", "severity", "file", "line", "confidence", "signature")


_FLAGSHIP = f"{FOUND}, {_MARKS}, s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.repo = f.repo AND m.path = f.file AND m.line_no = f.line AND (target = '' OR rule_id = target OR rule_id = regexp_replace(target, '^.*/', '')))), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, signature, file, line ORDER BY layer_ord, probe_ord, probe, rule_ord) AS n FROM s) WHERE n = 1) SELECT severity, rule_id, count(*) AS findings, count(DISTINCT file) AS files, round(sum({_RANK} * (0.5 + confidence / 2)), 6) AS risk_score FROM d GROUP BY severity, rule_id"


@query(_FLAGSHIP)
def scan_summary(spark, sf_dir):
    """The flagship: lines to rules to signatures, suppression, first per key, summary by severity and rule."""
    lines = fixtures.code_lines(spark, sf_dir)
    found = kept.dedupe(kept.suppress(line_ops.with_signature(line_ops.scan_lines(lines, CODE)), lines))
    score = F.round(F.sum(T.rank(F.col("severity")) * (0.5 + F.col("confidence") / 2)), 6)
    return found.groupBy("severity", "rule_id").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("file").alias("files"), score.alias("risk_score"))
