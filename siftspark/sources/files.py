"""Files and lines as tables: readers, the walk's filters, selections."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.tables import constant
from siftspark.functions.text import compile_glob, detect_language, is_text_source, strip

FILE_SCHEMA = "path string, size long, language string, text string"

# ---- fixed values: what a walk leaves out
IGNORED_DIRS = (
    "node_modules .git .hg .svn dist build out coverage .next .nuxt .cache .turbo vendor target __pycache__ .venv venv env .idea .vscode artifacts cache typechain typechain-types .pnpm "
    "bower_components .gradle bin obj .claude worktrees .worktrees .svelte-kit .astro .parcel-cache broadcast .foundry .serena .output .vercel .wrangler forge-std ds-test solmate solady permit2 "
    "v4-core v4-periphery openzeppelin-contracts openzeppelin-contracts-upgradeable @openzeppelin openzeppelin uniswap v3-core v3-periphery"
).split()
IGNORED_NAMES = r"(?i)\.(min\.js|map|lock|png|jpe?g|gif|webp|ico|svg|pdf|zip|tar|gz|exe|dll|so|dylib|woff2?|ttf|eot|mp4|mp3|wav|bin|wasm|node)$"
MOST_BYTES, MOST_FILES = 2 * 1024 * 1024, 20_000
PROJECT_MARKERS = ("package.json", ".git", "Cargo.toml", "go.mod", "pyproject.toml", "requirements.txt", "foundry.toml", "hardhat.config.js", "hardhat.config.ts")
SKIPPED_PROJECT_DIRS = ("node_modules", "dist", "build", "coverage", ".git", "vendor", "target")
SEVERITY_NAMES = ("info", "low", "medium", "high", "critical")
MOST_RULES = 500
#: Repositories up to which their ignored names (some 100 bytes each) are sent to all executors.
REPOS_SENT = 50_000


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """All files under root, or the one file that root is: path relative to root, size, language, text. A missing root gives no rows.

    Files over the size bound are left out by the reader; their content is not loaded. Bytes
    that are not UTF-8 become replacement characters.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return constant(spark, [], FILE_SCHEMA)
    full = fs.getFileStatus(path).getPath().toUri().getPath()
    base = full.rpartition("/")[0] if fs.getFileStatus(path).isFile() else full.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MOST_BYTES)
    relative = F.regexp_replace(F.url_decode(F.regexp_replace(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")), "^[a-z0-9]+:(//[^/]*)?", "")), "^" + re.escape(base) + "/", "")
    rows = found.select(relative.alias("path"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).unionByName(_hidden_files(spark, fs, path, base))
    return rows.select("path", "size", detect_language(F.col("path")).alias("language"), "text")


def _hidden_files(spark: SparkSession, fs, root, base: str) -> DataFrame:
    """Files with a part of their path that begins with . or _, which Spark's readers pass over: listed on the driver, read on executors."""
    found, listing = [], fs.listFiles(root, True)
    while listing.hasNext():
        status = listing.next()
        uri = status.getPath().toUri()
        relative = uri.getPath()[len(base) + 1 :]
        if status.getLen() <= MOST_BYTES and any(part[:1] in "._" for part in relative.split("/")) and not set(relative.split("/")[:-1]) & set(IGNORED_DIRS):
            found.append((relative, status.getPath().toString(), status.getLen()))

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            texts = []
            for uri in batch.column(1).to_pylist():
                store, at = pafs.FileSystem.from_uri(uri.replace(" ", "%20"))
                with store.open_input_stream(at, compression=None) as stream:
                    texts.append(stream.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=["path", "size", "text"])

    listed = spark.createDataFrame(found, "path string, uri string, size long") if found else constant(spark, [], "path string, uri string, size long")
    return listed.mapInArrow(read, "path string, size long, text string")


def from_table(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """Any table of texts as files."""
    return rows.select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), detect_language(path).alias("language"), text.alias("text"))


def gitignore_dirs(files: DataFrame) -> list[str]:
    """The plain directory names that the top-level .gitignore lists: one small file's lines."""
    return sorted(r["n"] for r in _gitignored(files).distinct().collect())


def _gitignored(files: DataFrame) -> DataFrame:
    """(n, and repo where files have it) of the names that top-level .gitignore files list."""
    repo = [c for c in files.columns if c == "repo"]
    lines = files.where("path = '.gitignore'").select(*repo, F.explode(F.split("text", r"\r?\n", -1)).alias("l")).select(*repo, F.regexp_replace(strip(F.col("l")), "^/+|/+$", "").alias("n"), strip(F.col("l")).alias("l"))
    return lines.where(~F.col("l").rlike("^[#!]") & (F.col("n") != "") & ~F.col("n").rlike(r"[/*.]")).select(*repo, "n")


def without_gitignored(files: DataFrame) -> DataFrame:
    """files without those in a directory that their repository's top-level .gitignore names.

    The names are one small row a repository, sent to all executors if they are few.
    """
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    if "repo" not in files.columns:
        names = gitignore_dirs(files)
        return files.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, names)))) if names else files
    listed = _gitignored(files).groupBy(F.col("repo").alias("_repo")).agg(F.collect_set("n").alias("_names"))
    named = files.join(F.broadcast(listed) if listed.limit(REPOS_SENT + 1).count() <= REPOS_SENT else listed, F.col("repo").eqNullSafe(F.col("_repo")), "left")
    return named.where(F.col("_names").isNull() | ~F.arrays_overlap(dirs, "_names")).drop("_repo", "_names")


def walk(files: DataFrame, ignore_dirs: tuple[str, ...] = tuple(IGNORED_DIRS), include_non_source: bool = False, most_files: int | None = None) -> DataFrame:
    """The files that a scan sees: no ignored directory, name or over-long file, and only text sources unless include_non_source.

    most_files caps the number of files in path order, where a caller asks for it.
    """
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = files.where(~F.arrays_overlap(dirs, F.array(*map(F.lit, ignore_dirs))) & ~F.col("path").rlike(IGNORED_NAMES) & (F.col("size") <= MOST_BYTES))
    if not include_non_source:
        kept = kept.where(is_text_source(F.col("path")))
    return kept if most_files is None else kept.orderBy("path").limit(most_files)


def lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; other columns than text and size stay."""
    rest = [c for c in files.columns if c not in ("text", "size")]
    return files.select(*rest, F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line")).select(*rest, (F.col("pos") + 1).alias("line_no"), "line")


def only_files(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files that the path column of allowed names, after \\ to / and without a leading ./."""
    named = allowed.select(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "").alias("path")).distinct()
    return files.join(named, "path", "left_semi")


def changed_files(*lists: DataFrame) -> DataFrame:
    """The distinct paths of several lists of changed files."""
    out = lists[0].select("path")
    for more in lists[1:]:
        out = out.union(more.select("path"))
    return out.distinct()


def discover_projects(paths: DataFrame) -> DataFrame:
    """(project): '' if the root holds a project marker, else the top-level directories that do, hidden and build ones left out."""
    parts = F.split("path", "/")
    marked = paths.select(parts.alias("p")).where(F.element_at("p", -1).isin(*PROJECT_MARKERS) | F.exists("p", lambda x: x == ".git"))
    at = marked.select(F.when((F.size("p") == 1) | (F.get("p", F.lit(0)) == ".git"), F.lit("")).when((F.size("p") == 2) | (F.get("p", F.lit(1)) == ".git"), F.get("p", F.lit(0))).alias("project")).where("project is not null")
    good = at.where((F.col("project") == "") | (~F.col("project").startswith(".") & ~F.col("project").isin(*SKIPPED_PROJECT_DIRS))).distinct()
    return good.where("project = ''") if good.where("project = ''").take(1) else good


# ---- small documents that the driver parses


def load_custom_rules(text: str | None) -> tuple[list[dict], str | None]:
    """(rules, error) of a JSON rule file with comments: a list, or an object with rules; at most 500 are read."""
    if text is None:
        return [], None
    try:
        parsed = json.loads(re.sub(r"(?m)(^|[^:])//.*$", r"\1", re.sub(r"(?s)/\*.*?\*/", "", text)))
    except ValueError as e:
        return [], f"not valid JSON: {e}"
    found = parsed if isinstance(parsed, list) else parsed.get("rules") if isinstance(parsed, dict) else None
    if not isinstance(found, list):
        return [], "neither a list of rules nor an object with rules"
    for i, rule in enumerate(found[:MOST_RULES]):
        if not isinstance(rule, dict):
            return [], f"rule {i} is no object"
        for key in ("id", "pattern", "title"):
            if not isinstance(rule.get(key), str) or not rule[key]:
                return [], f"rule {rule.get('id', i)} has no {key}"
        if rule.get("severity") not in SEVERITY_NAMES:
            return [], f"rule {rule['id']} has no known severity"
    return found[:MOST_RULES], None


def load_ignore_globs(files: DataFrame, name: str = ".siftignore") -> list[str]:
    """The compiled globs of the top-level ignore file."""
    from siftspark.functions.text import ignore_globs

    found = files.where(F.col("path") == name).select("text").limit(1).collect()
    return [compile_glob(g) for g in ignore_globs(found[0]["text"] if found else "")]
