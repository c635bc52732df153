"""Scalar functions over paths, code lines and snippets, as Column expressions."""

from __future__ import annotations

import re
from functools import cache, reduce
from re import _constants as ops, _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary over ASCII words; Java's own \b also counts other letters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# ---- fixed values: severities, languages by file name and extension, files worth reading

SEVERITIES = ("info", "low", "medium", "high", "critical")
BY_EXTENSION = {
    "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx .mts .cts", "python": ".py .pyi", "solidity": ".sol", "rust": ".rs", "go": ".go", "java": ".java", "kotlin": ".kt",
    "ruby": ".rb", "php": ".php", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp", "csharp": ".cs", "shell": ".sh .bash .zsh", "powershell": ".ps1", "json": ".json .jsonc", "yaml": ".yaml .yml",
    "toml": ".toml", "markdown": ".md .mdx", "html": ".html .htm", "css": ".css .scss .sass", "sql": ".sql", "vue": ".vue", "svelte": ".svelte", "dotenv": ".env",
}
BY_NAME = {"dockerfile": "dockerfile", "makefile": "makefile", ".gitignore": "gitignore", ".npmrc": "ini", ".env": "dotenv"}
SECURITY_NAMES = r"(?i)(^|[\\/])(id_rsa|id_dsa|id_ecdsa|id_ed25519|\.wallet-key|\.netrc|_netrc|\.pgpass|\.htpasswd|\.pypirc|credentials|\.npmrc)$"
SECURITY_EXTENSIONS = r"(?i)\.(pem|key|p12|pfx|pkcs12|keystore|jks|der|ppk|crt|cer|asc|gpg|kdbx|ovpn)$"
TEXT_EXTENSIONS = r"(?i)\.(txt|cfg|conf|ini|properties|gradle|lock|xml|graphql|proto|env|tfstate|tfvars)$"
#: Words that the normaliser leaves as they are.
KEYWORDS = (
    "function return if else for while const let var require import export eval new async await class "
    "public private external internal payable call delegatecall selfdestruct transfer send assembly tx origin msg sender"
).split()

#: White space at either end, the same in Java and RE2.
ENDS = r"^[\t-\r ]+|[\t-\r ]+$"
BLANKS = r"[\t-\r ]+"


def java(pattern: str) -> str:
    """A pattern with ASCII word boundaries for Java."""
    return pattern.replace(r"\b", BOUNDARY)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def _needed(tree) -> tuple[str, ...]:
    """Strings of which every match of a parsed pattern holds one: of all such sets that with the longest shortest string; empty where there is none."""
    best: tuple[str, ...] = ()

    def offer(found) -> None:
        nonlocal best
        if found and all(found) and (not best or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = tuple(found)

    run = ""
    for op, what in (*tree, (None, None)):
        if op is ops.LITERAL:
            run += chr(what)
            continue
        offer([run])
        run = ""
        if op is ops.SUBPATTERN:
            offer(_needed(what[3]))
        elif op is ops.BRANCH:
            each = [_needed(x) for x in what[1]]
            offer([x for found in each for x in found] if all(each) else [])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and what[0] > 0:
            offer(_needed(what[2]))
    return best


@cache
def needed(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Strings of which every text that the pattern fits holds one (empty: none known), and whether letters' case is ignored: then they are lower-cased, as the text must be."""
    try:
        found, fold = _needed(parser.parse(pattern)), bool(re.search(r"\(\?[a-z]*i", pattern))
    except re.error:
        return (), False
    if fold:
        found = tuple(x.lower() for x in found)
    if not all(x.isascii() for x in found):
        return (), False
    return tuple(x for x in dict.fromkeys(found) if not any(y != x and y in x for y in found)), fold


def fits(text: Column, low: Column, pattern: str) -> Column:
    """text rlike pattern, with ASCII word boundaries; low is text in lower case. Texts that hold none of the strings which a match needs are not put to the pattern."""
    strings, fold = needed(pattern)
    some = [F.contains(low if fold else text, F.lit(x)) for x in strings]
    return reduce(lambda a, b: a | b, some) & text.rlike(java(pattern)) if some else text.rlike(java(pattern))


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    return F.coalesce(found, default)


def rank(severity: Column) -> Column:
    """info 0 to critical 4; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("int") - 1


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1))


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot; empty where there is none or the name begins with its only dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def detect_language(path: Column) -> Column:
    by_extension = {e: lang for lang, all_ in BY_EXTENSION.items() for e in all_.split()}
    name = basename(path)
    return lookup(name, BY_NAME, F.when(name.startswith(".env"), "dotenv").otherwise(lookup(extension(path), by_extension, F.lit("unknown"))))


def is_security_file(path: Column) -> Column:
    return path.rlike(SECURITY_NAMES) | path.rlike(SECURITY_EXTENSIONS)


def is_text_source(path: Column) -> Column:
    return (detect_language(path) != "unknown") | is_security_file(path) | path.rlike(TEXT_EXTENSIONS)


# ---- fingerprints

STRING, HEX, NUMBER, INTEGER = r"""["'`][^"'`]*["'`]""", r"\b0x[0-9a-fA-F]+\b", r"\b\d+(\.\d+)?\b", r"\b\d+\b"
#: The same three for Java, with ASCII boundaries that are looked at only where the first digit stands.
_BEFORE, _AFTER = r"(?<![A-Za-z0-9_]{})", r"(?![A-Za-z0-9_])"
JAVA_HEX, JAVA_NUMBER, JAVA_INTEGER = "0" + _BEFORE.format("0") + "x[0-9a-fA-F]+" + _AFTER, r"\d" + _BEFORE.format(r"\d") + r"\d*(\.\d+)?" + _AFTER, r"\d" + _BEFORE.format(r"\d") + r"\d*" + _AFTER


def normalize_snippet(text: Column) -> Column:
    """The shape of a line: strings, hex and other numbers and all identifiers but KEYWORDS become one mark, blanks are squeezed."""
    steps = [(STRING, "STR"), (JAVA_HEX, "HEX"), (JAVA_NUMBER, "NUM"), (r"[A-Za-z_$][A-Za-z0-9_$]*", "\u0001$0\u0002"), ("\u0001(?!(?:" + "|".join(KEYWORDS) + ")\u0002)[^\u0002]*\u0002", "ID"), ("[\u0001\u0002]", ""), (BLANKS, " ")]
    return F.substring(F.trim(reduce(lambda c, step: F.regexp_replace(c, F.lit(step[0]), F.lit(step[1])), steps, text)), 1, 200)


def signature(probe: Column, rule_id: Column, language: Column, snippet: Column, title: Column) -> Column:
    """probe::rule::language::shape, the same wherever in a file or repository the line stands."""
    shown = F.coalesce(F.when(snippet != "", snippet), title, F.lit(""))
    return F.concat_ws("::", probe, rule_id, F.coalesce(F.when(language != "", language), F.lit("any")), normalize_snippet(shown))


def location(file: Column, line: Column, column: Column) -> Column:
    return F.when(file.isNull(), "(project)").otherwise(F.concat(file, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(":"), column.cast("string")), F.lit(""))))


def clamp01(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.8).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def template(text: Column) -> Column:
    """A line with strings, hex numbers and integers replaced by placeholders."""
    steps = [(STRING, "<STR>"), (JAVA_HEX, "<HEX>"), (JAVA_INTEGER, "<NUM>"), (BLANKS, " ")]
    return F.substring(F.trim(reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)), 1, 160)


def template_to_regex(found: Column) -> Column:
    """A regular expression for lines of a template's shape; null where the template has no three letters in a row of its own, or the result is under 6 or over 300 long."""
    steps = [(r"[.*+?^${}()|\[\]\\]", r"\\$0"), ("<STR>", r"""["'`][^"'`]*["'`]"""), ("<HEX>", "0x[0-9a-fA-F]+"), ("<NUM>", r"\\d+"), (BLANKS, r"\\s+")]
    source = reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, F.trim(found))
    literal = F.regexp_replace(found, "<STR>|<HEX>|<NUM>", "").rlike("[A-Za-z]{3,}")
    return F.when(literal & F.length(source).between(6, 300), source)


def short_hash(text: Column) -> Column:
    """Six base-36 digits of the 32-bit polynomial hash with factor 31."""
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    total = F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + x, F.lit(4294967296)))
    return F.substring(F.lower(F.conv(total.cast("string"), 10, 36)), 1, 6)


def env_name(identifier: Column) -> Column:
    """camelCase, kebab-case and dotted names as SCREAMING_SNAKE."""
    return F.upper(F.regexp_replace(F.regexp_replace(identifier, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


def line_of(text: Column, needle: Column) -> Column:
    """The line of the first place of needle in text, 1 where it has none."""
    at = F.call_function("locate", needle, text)
    return F.when(at > 0, F.regexp_count(F.substring(text, F.lit(1), at - 1), F.lit("\n")) + 1).otherwise(1).cast("int")


def strip_json_comments(text: Column) -> Column:
    for pattern, new in ((r"(?s)/\*.*?\*/", ""), (r"(?m)(^|[^:])//.*$", "$1"), (r",([\t-\r ]*[}\]])", "$1")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new))
    return text


def tail(text: Column, n: int = 3000) -> Column:
    return F.when(F.length(text) > n, F.concat(F.lit("…"), F.right(text, F.lit(n)))).otherwise(text)


# ---- entropy and secret candidates


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.length(text)
    share = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, ch: s - share(ch) * F.log2(share(ch)))).otherwise(0.0)


def alnum_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) / F.length(text)).otherwise(0.0)


def looks_like_token(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9+/=_-]{16,}$") & (alnum_ratio(text) > 0.85)


def tokenize_identifier(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]+", " ")


# fixed values: the words that clear or mark a candidate, and the shapes of values that are no secrets
HASH_WORDS = r"(?i)\b(hash|sha\d*|md5|checksum|digest|integrity|etag|commit|revision|sri|subresource|blockhash|txhash|merkle|root|nonce|iv|salt|uuid|guid)\b"
SECRET_WORDS = r"(?i)\b(key|secret|token|password|passwd|pwd|auth|api|access|credential|cred|bearer|session|cookie|private)\b"
DATA_CONTEXT = r"(?i)data:|base64,|\.(png|jpe?g|gif|woff|ttf|svg)\b"
SLUG, UUID = r"(?i)^[a-z0-9]+([-_][a-z0-9]+){3,}$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CANDIDATE = r"""["'`]([^"'`\n]{16,200})["'`]"""


def classify_secret(value: Column, context: Column, name: Column) -> Column:
    """struct<kind, entropy, length, secret_name, reason> of a value that may be a secret, null for others."""
    payload = F.regexp_replace(strip(value), "^0[xX]", "")
    hex_, n = payload.rlike("^[0-9a-fA-F]+$"), F.length(payload)
    around = F.concat_ws(" ", tokenize_identifier(F.coalesce(name, F.lit(""))), tokenize_identifier(F.coalesce(context, F.lit(""))))
    bits, named = shannon_entropy(payload), around.rlike(java(SECRET_WORDS))
    dull = payload.rlike("^[0-9a-fA-F]{40}$") | payload.rlike(SLUG) | payload.rlike(UUID) | around.rlike(java(HASH_WORDS)) | F.coalesce(context, F.lit("")).rlike(java(DATA_CONTEXT)) | (hex_ & (n == 64) & ~named)
    kind = F.when(hex_, "hex").when(payload.rlike("^[A-Za-z0-9+/]+=*$"), "base64").otherwise("token")
    reason = F.concat(F.lit("high-entropy "), F.when(hex_, "hex").otherwise("token"), F.lit(" string (H="), F.format_string("%.2f", bits), F.lit(" bits/char, len "), n.cast("string"), F.lit(")"))
    found = F.struct(kind.alias("kind"), F.round(bits, 2).alias("entropy"), n.alias("length"), named.alias("secret_name"), reason.alias("reason"))
    return F.when(n.between(20, 200) & looks_like_token(payload) & ~dull, F.when(bits >= F.when(hex_, 3.0).otherwise(4.0), found))


def candidates(line: Column) -> Column:
    """The quoted strings of 16 to 200 characters in a line."""
    return F.regexp_extract_all(line, F.lit(CANDIDATE), F.lit(1))


def redact(value: Column) -> Column:
    """The first and last four characters of a secret."""
    return F.concat(F.substring(value, 1, 4), F.lit("…******…"), F.right(value, F.lit(4)))


def redact_entropy(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 4), F.lit("…["), F.length(value).cast("string"), F.lit(" chars, redacted]…"), F.right(value, F.lit(2)))


# ---- patterns made on the driver


def compile_glob(glob: str) -> str:
    """A regular expression for an ignore glob: whole path segments, * within one, ** over many, a leading / for the root."""
    body = glob.strip()
    if not body.strip("/"):
        return r"(?!x)x"
    parts = re.split(r"(\*\*/|\*\*|\*)", body.strip("/"))
    marks = {"**/": r"(?:[^\n]*?/)?", "**": ".*", "*": "[^/]*"}
    return ("^" if body.startswith("/") else "(?:^|/)") + "".join(marks.get(p, re.escape(p).replace(r"\-", "-").replace(r"\ ", " ")) for p in parts) + "(?:/|$)"


def ignore_globs(text: str) -> list[str]:
    """The globs of an ignore file, without blank lines and comments."""
    return [x.strip() for x in re.split(r"\r?\n", text) if x.strip() and not x.strip().startswith("#")]
