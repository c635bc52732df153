"""Suggested fixes as a column of findings, and their application to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.text import env_name, java, strip

FIX = "struct<strategy:string,original:string,replacement:string,patch:string,note:string,auto:boolean,confidence:double,create_path:string>"
GITIGNORE = "node_modules/\n.env\n.env.*\n!.env.example\ndist/\n__pycache__/\n"


def _rewritten(line: Column) -> dict[str, tuple[Column, float, str]]:
    """The replacement of a line by rule, with its confidence and note; only those that keep the code valid apply themselves."""
    r = lambda pattern, new, text=line: F.regexp_replace(text, F.lit(java(pattern)), F.lit(new))
    tls = r(r",?\s*rejectUnauthorized\s*:\s*false\s*(?=[}\n])|rejectUnauthorized\s*:\s*false\s*,\s*", " ")
    tls = r(r"""NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0['"]?""", "NODE_TLS_REJECT_UNAUTHORIZED = '1'", tls)
    yaml = r(r"yaml\.load\s*\(", "yaml.safe_load(", r(r",\s*Loader\s*=\s*[\w.]+", ""))
    return {
        "disable-tls-verify": (tls, 0.9, "Certificate checks are on again once the option is gone."),
        "py-yaml-load": (yaml, 0.9, "safe_load builds plain data only and takes no Loader."),
        "py-requests-noverify": (r(r",\s*verify\s*=\s*False|verify\s*=\s*False\s*,?\s*", ""), 0.9, "Requests check certificates unless told not to."),
        "tx-origin-auth": (r(r"tx\.origin", "msg.sender"), 0.85, "msg.sender is the caller; tx.origin can be lured into a call."),
        "py-mktemp": (r(r"tempfile\.mktemp\s*\(", "tempfile.mkstemp("), 0.6, "mkstemp creates the file; it returns a handle and a path."),
        "py-flask-debug": (r(r"debug\s*=\s*True", "debug=False", r(r"DEBUG\s*=\s*True", "DEBUG = False")), 0.8, "Debug mode stays off unless switched on for development."),
        "py-bare-except": (r(r"except\s*:", "except Exception:"), 0.7, "Exits and interrupts pass through."),
        "floating-pragma": (r(r"(pragma\s+solidity\s+)\^", "$1"), 0.8, "One compiler version gives one bytecode."),
    }


def with_fixes(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with a column fix: a rewritten or deleted line, a file to create, or a manual note; every finding has one."""
    keys = [c for c in lines.columns if c not in ("path", "language", "line_no", "line")]
    at = lines.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("path").alias("_path"), F.col("line_no").alias("_no"), F.col("line").alias("_text"))
    same = (F.col("file") == F.col("_path")) & (F.col("line") == F.col("_no"))
    for c in keys:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = findings.join(at, same, "left")
    return joined.withColumn("fix", fix_of(F.col("rule_id"), F.col("language"), F.col("_text"))).drop("_path", "_no", "_text", *(f"_{c}" for c in keys))


def fix_of(rule: Column, language: Column, line: Column) -> Column:
    def fix(strategy: str, replacement: Column | None, note: Column | str, auto: Column | bool, confidence: float, create: str | None = None) -> Column:
        new = F.lit(None).cast("string") if replacement is None else replacement
        old = F.coalesce(strip(line), F.lit(""))
        patch = F.lit("") if strategy == "manual" else F.concat(F.lit("+ "), new) if create else F.concat(F.lit("- "), old, F.lit("" if strategy == "delete-line" else "\n+ "), F.lit("") if strategy == "delete-line" else F.coalesce(strip(new), F.lit("")))
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(strategy).alias("strategy"), line.alias("original"), new.alias("replacement"), patch.alias("patch"), as_column(note).alias("note"), as_column(auto).alias("auto"), F.lit(confidence).alias("confidence"), F.lit(create).cast("string").alias("create_path")).cast(FIX)

    out = F.when(rule == "missing-gitignore", fix("create-file", F.lit(GITIGNORE), "Creates an ignore file for builds, environments and dependencies.", True, 0.8, ".gitignore"))
    out = out.when((rule == "env-not-ignored"), fix("insert", F.lit(".env\n.env.*\n!.env.example"), "Add these lines to the ignore file.", False, 0.7, ".gitignore"))
    out = out.when((rule == "debugger-stmt") & line.rlike(r"^\s*debugger\s*;?\s*$"), fix("delete-line", None, "The statement only stops a debugger.", True, 0.95))
    secret = rule.isin("hardcoded-password", "high-entropy-secret", "aws-access-key", "github-token", "openai-key", "slack-token", "stripe-secret", "stripe-webhook", "connection-string-creds")
    name = F.regexp_extract(line, r"([A-Za-z_$][\w$.-]*)[\"'`]?\s*[:=]\s*[\"'`]", 1)
    variable = F.regexp_extract(name, r"[^.]*$", 0)
    read = F.when(language == "python", F.concat(F.lit('os.environ["'), env_name(variable), F.lit('"]'))).otherwise(F.concat(F.lit("process.env."), env_name(variable)))
    moved = F.replace(line, F.regexp_substr(line, F.lit(r"""["'`][^"'`]*["'`](?=[^"'`]*$)""")), read)
    out = out.when(secret & (name != ""), fix("replace-line", moved, "Set the variable in the environment and ROTATE the value: it is in the history.", False, 0.7))
    for id_, (new, confidence, note) in _rewritten(line).items():
        out = out.when((rule == id_) & line.isNotNull() & (new != line), fix("replace-line", new, note, confidence >= 0.7, confidence))
    return out.otherwise(fix("manual", None, "No safe rewrite is known: follow the hint of the finding and review by hand.", False, 0.3))


def applicable(findings: DataFrame, least: float = 0.7) -> DataFrame:
    return findings.where(F.col("fix.auto") & (F.col("fix.confidence") >= least))


def apply_fixes(lines: DataFrame, findings: DataFrame, least: float = 0.7) -> DataFrame:
    """The lines after all applicable fixes: replaced, deleted; of several fixes of a line the most confident counts, a deletion first.

    Nothing is written: callers save the lines or files that they want changed.
    """
    keys = [c for c in lines.columns if c not in ("path", "language", "line_no", "line")]
    chosen = applicable(findings, least).where("fix.strategy in ('replace-line', 'delete-line')").groupBy(*keys, F.col("file").alias("path"), F.col("line").alias("line_no")).agg(F.max(F.struct(F.col("fix.strategy") == "delete-line", "fix.confidence", "fix.replacement")).alias("f"))
    done = lines.join(chosen, [*keys, "path", "line_no"], "left").where("f is null or not f.col1")
    return done.withColumn("line", F.coalesce("f.replacement", "line")).drop("f")


def created_files(files: DataFrame, findings: DataFrame, least: float = 0.7) -> DataFrame:
    """(keys, path, text) of the files that applicable create-file fixes make, once each; none where files has the path already."""
    keys = [c for c in files.columns if c == "repo"]
    made = applicable(findings, least).where("fix.strategy = 'create-file'").groupBy(*keys, F.col("fix.create_path").alias("path")).agg(F.min("fix.replacement").alias("text"))
    return made.join(files.select(*keys, "path"), [*keys, "path"], "left_anti")


def outcomes(files: DataFrame, findings: DataFrame, least: float = 0.7) -> DataFrame:
    """Findings with a column outcome: applied, or why a fix was skipped: review (not safe by itself), exists (its file is there), superseded (another fix of the line counts).

    Of several fixes of a line the one that apply_fixes takes is applied; equal ones all are.
    """
    keys = [c for c in files.columns if c == "repo"]
    order = F.struct(F.col("fix.strategy") == "delete-line", "fix.confidence", "fix.replacement")
    line = Window.partitionBy(*keys, "file", "line")
    there = files.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("path").alias("_path")).distinct()
    same = F.col("fix.create_path") == F.col("_path")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    safe = applicable(findings, least).where("fix.strategy <> 'insert'")
    edits = safe.where("fix.strategy in ('replace-line', 'delete-line')").withColumn("_o", order)
    edits = edits.withColumn("outcome", F.when(F.col("_o") == F.max("_o").over(line), "applied").otherwise("superseded")).drop("_o")
    creations = safe.where("fix.strategy = 'create-file'").join(there, same, "left").withColumn("outcome", F.when(F.col("_path").isNull(), "applied").otherwise("exists")).drop("_path", *(f"_{k}" for k in keys))
    applies = F.coalesce(F.col("fix.auto") & (F.col("fix.confidence") >= least) & F.col("fix.strategy").isin("replace-line", "delete-line", "create-file"), F.lit(False))
    rest = findings.where(~applies).withColumn("outcome", F.lit("review"))
    return edits.unionByName(creations).unionByName(rest)


def files_of(lines: DataFrame) -> DataFrame:
    """Files of lines: (keys, path, language, text)."""
    keys = [c for c in lines.columns if c not in ("line_no", "line")]
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
