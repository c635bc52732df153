"""The detection rules that look at one line at a time, as data.

A rule is a pattern with guards; titles and hints are this engine's own. Patterns, rule
ids, severities, confidences and tags are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One line rule. re2: the same language without look-around, for SQL engines that lack it; none: the pattern itself."""

    id: str
    pattern: str
    severity: str
    confidence: float
    title: str
    tags: tuple[str, ...] = ()
    hint: str = ""
    unless: str | None = None
    re2: str | None = None
    re2_unless: str | None = None


@dataclass(frozen=True)
class Group:
    """A probe over lines: the rules, and which files and lines they see. order: place among its layer's probes."""

    probe: str
    title: str
    order: int
    rules: tuple[Rule, ...]
    languages: tuple[str, ...] | None = None
    paths: str | None = None
    unless_paths: str | None = None
    unless_languages: tuple[str, ...] = ()
    longest: int | None = None
    comments: tuple[str, ...] = ()
    test_paths: str | None = None
    test_weight: float = 0.5
    column: int | None = None
    layer: str = "static"


_ERR = r"(?:e|ex|err|error|exception|\w*[eE]rr(?:or)?|\w*[eE]xception)"

# ---- fixed values: patterns, severities, confidences and tags of all line rules

JS = Group(
    "static/dangerous-js", "Dangerous JavaScript and TypeScript", 2, languages=("javascript", "typescript", "vue", "svelte"), longest=2000, comments=("//", "*"), column=1,
    test_paths=r"(^|/)(test|tests|__tests__|spec)/|\.(test|spec)\.",
    rules=(
        Rule("eval-use", r"(?<![.\w])eval\s*\(", "high", 0.7, "eval() runs a string as code", ("injection", "cwe-95"), "Parse data with JSON.parse or pick the action from a table.", re2=r"(?:^|[^.\w])eval\s*\("),
        Rule("indirect-eval", r"""\(\s*0\s*,\s*eval\s*\)|(?:window|globalThis|self|global)\s*\[\s*["'`]eval["'`]\s*\]""", "high", 0.75, "eval reached by another name", ("injection", "cwe-95"), "Remove it: the string runs in the global scope."),
        Rule("function-constructor", r"""new\s+Function\s*\(|(?<![.\w])Function\s*\(\s*["'`]""", "high", 0.7, "Function constructor builds code from strings", ("injection", "cwe-95"), "Write the logic out.", re2=r"""new\s+Function\s*\(|(?:^|[^.\w])Function\s*\(\s*["'`]"""),
        Rule("string-arg-timer", r"""\b(?:setTimeout|setInterval)\s*\(\s*["'`]""", "medium", 0.7, "Timer that evaluates a string", ("injection", "cwe-95"), "Pass a function."),
        Rule("child-process-concat", r"""(?:\b(?:execSync|spawnSync|execFileSync)\s*\(|(?<![.\w])(?:exec|spawn|execFile)\s*\()\s*(?:[`"'][^`"']*\$\{|[^,)]*["'`]\s*\+|[^,)]*\+\s*[A-Za-z_$])""", "critical", 0.75, "Shell command joined from parts", ("injection", "cwe-78"), "Pass the arguments as a list.", re2=r"""(?:\b(?:execSync|spawnSync|execFileSync)\s*\(|(?:^|[^.\w])(?:exec|spawn|execFile)\s*\()\s*(?:[`"'][^`"']*\$\{|[^,)]*["'`]\s*\+|[^,)]*\+\s*[A-Za-z_$])"""),
        Rule("sql-concat", r"""(?i)\b(SELECT\s+[\w*,\s.()]+\s+FROM|INSERT\s+INTO\s+\w|UPDATE\s+["'`\w.]+\s+SET|DELETE\s+FROM\s+\w|DROP\s+(?:TABLE|DATABASE)\s+\w)\b[^;]*(?:["'`]\s*\+\s*\w|\$\{)""", "high", 0.55, "SQL joined from parts", ("injection", "cwe-89"), "Use placeholders and bind the values.", unless=r"(?i)\$\{\s*(Number|parseInt|parseFloat|BigInt)\s*\(|\$\{\s*(placeholders?|qmarks?|marks|qs|phs?|params|questionMarks|binds?|inClause)\b"),
        Rule("dom-xss-sink", r"\.(innerHTML|outerHTML)\s*\+?=|\.insertAdjacentHTML\s*\(|(?<![.\w])document\.write(?:ln)?\s*\(|\.html\s*\(\s*[^)]*(?:\$\{|\+|req\.|user)", "medium", 0.5, "Markup written into the page", ("xss", "cwe-79"), "Set textContent or sanitise first.", unless=r"""DOMPurify|sanitize|escapeHtml|\.textContent|\.(innerHTML|outerHTML)\s*\+?=\s*(?:`[^`$]*`|"[^"\\]*"|'[^'\\]*')\s*;?\s*$""", re2=r"\.(innerHTML|outerHTML)\s*\+?=|\.insertAdjacentHTML\s*\(|(?:^|[^.\w])document\.write(?:ln)?\s*\(|\.html\s*\(\s*[^)]*(?:\$\{|\+|req\.|user)"),
        Rule("insecure-random-token", r"(?i)Math\.random\(\)[^;\n]*\b(token|secret|password|passwd|nonce|salt|session|otp|apikey|api_key|privateKey)\b|\b(token|secret|nonce|salt|session|otp|apiKey)\b[^;=\n]{0,40}=\s*[^;\n]*Math\.random", "medium", 0.6, "Guessable random number for a secret", ("crypto", "cwe-338"), "Draw it from a cryptographic generator."),
        Rule("disable-tls-verify", r"""rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0""", "high", 0.85, "TLS certificates are not checked", ("tls", "cwe-295"), "Remove the option."),
        Rule("jwt-none-alg", r"""(?i)algorithms?\s*:\s*\[?\s*["'`]none["'`]|["'`]alg["'`]\s*:\s*["'`]none["'`]""", "high", 0.8, "Unsigned tokens accepted", ("auth", "cwe-347"), "Name the one algorithm that is in use."),
        Rule("await-in-loop-hint", r"for\s*\([^)]*\)\s*\{[^}]*await\s", "info", 0.3, "await within a loop", ("performance",), "Collect independent calls and await them together."),
        Rule("process-exit-in-lib", r"process\.exit\s*\(", "info", 0.3, "process.exit() call", ("reliability",), "Throw, or return a status to the caller."),
        Rule("debugger-stmt", r"""(?<![\w."'`-])debugger\b(?![\w-])""", "low", 0.85, "debugger statement left in", ("debug",), "Remove it.", re2=r"""(?:^|[^\w."'`-])debugger(?:$|[^\w-])"""),
    ),
)

PYTHON = Group(
    "static/python-danger", "Dangerous Python", 3, languages=("python",), comments=("#",), test_paths=r"(^|/)(tests?|__tests__)/|(^|/)test_.*\.py$|_test\.py$",
    rules=(
        Rule("py-eval-exec", r"(?<![.\w])(eval|exec)\s*\(", "high", 0.65, "eval() or exec() on a string", ("injection", "cwe-95"), "Use ast.literal_eval for data.", re2=r"(?:^|[^.\w])(eval|exec)\s*\("),
        Rule("py-pickle-load", r"pickle\.loads?\s*\(|cPickle\.loads?\s*\(", "high", 0.6, "pickle read from outside", ("deserialization", "cwe-502"), "Use JSON for data that others write."),
        Rule("py-yaml-load", r"yaml\.load\s*\((?![^)]*Loader\s*=\s*yaml\.(Safe|CSafe))", "high", 0.75, "yaml.load without a safe loader", ("deserialization", "cwe-502"), "Call yaml.safe_load.", re2=r"yaml\.load\s*\(", re2_unless=r"yaml\.load\s*\([^)]*Loader\s*=\s*yaml\.(Safe|CSafe)"),
        Rule("py-subprocess-shell", r"subprocess\.(run|call|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True", "high", 0.7, "subprocess through a shell", ("injection", "cwe-78"), "Pass a list and leave shell off."),
        Rule("py-os-system", r"os\.system\s*\(", "medium", 0.6, "os.system() call", ("injection", "cwe-78"), "Use subprocess with a list."),
        Rule("py-assert-auth", r"(?i)\bassert\s+[^\n]*\b(auth|admin|permission|is_authenticated|is_admin|role|verify|authorized)\b", "medium", 0.45, "Access check by assert", ("auth", "cwe-617"), "Raise an error: -O removes asserts."),
        Rule("py-requests-noverify", r"\b\w+\.(get|post|put|delete|patch|head|request)\s*\([^)]*verify\s*=\s*False|\bverify\s*=\s*False\b", "high", 0.8, "Request that skips certificate checks", ("tls", "cwe-295"), "Drop verify=False."),
        Rule("py-unsafe-deserialize", r"\b(torch\.load|joblib\.load|dill\.loads?|pandas\.read_pickle|pd\.read_pickle|pickle\.Unpickler)\s*\(|numpy\.load\s*\([^)]*allow_pickle\s*=\s*True|np\.load\s*\([^)]*allow_pickle\s*=\s*True", "high", 0.6, "Loader that can run code", ("deserialization", "cwe-502"), "Use a format without code, or check where the file is from."),
        Rule("py-ssti", r"render_template_string\s*\(|Template\s*\([^)]*\)\s*\.render\s*\([^)]*\brequest\b|jinja2[^;\n]*autoescape\s*=\s*False", "high", 0.55, "Template made from input", ("injection", "cwe-1336"), "Render fixed templates with escaping on."),
        Rule("py-django-secret", r"""SECRET_KEY\s*=\s*["'][^"'\n]{8,}["']""", "high", 0.6, "SECRET_KEY in the source", ("secret", "cwe-798"), "Read it from the environment.", unless=r"(?i)os\.(environ|getenv)|config\(|env\(|process\.env"),
        Rule("py-weak-hash", r"hashlib\.(md5|sha1)\s*\(", "low", 0.4, "md5 or sha1", ("crypto", "cwe-327"), "Use sha256 or a password hash."),
        Rule("py-flask-run-host", r"tarfile[^;\n]*\.extractall\s*\(|ssl\._create_unverified_context\s*\(", "medium", 0.55, "Unchecked archive or TLS context", ("injection", "cwe-22"), "Check member paths; keep verification on."),
        Rule("py-flask-debug", r"app\.run\s*\([^)]*debug\s*=\s*True|DEBUG\s*=\s*True", "medium", 0.5, "Debug mode on", ("info-disclosure",), "Turn it off outside development."),
        Rule("py-mktemp", r"tempfile\.mktemp\s*\(", "low", 0.7, "tempfile.mktemp()", ("race", "cwe-377"), "Use mkstemp."),
        Rule("py-bare-except", r"except\s*:", "low", 0.6, "except without a class", ("reliability",), "Name the exceptions."),
    ),
)

ENV_LEAK = Group(
    "static/env-leak", "Internals shown to clients", 6, languages=("javascript", "typescript", "python", "go", "ruby", "php", "java"), longest=2000, comments=("//", "*", "#"),
    rules=(
        Rule("error-message-to-response", rf"(?i)res(?:ponse)?\.(?:json|send|end|write|status\([^)]*\)\.(?:json|send))\s*\([^)]*\b{_ERR}\.(?:message|stack)\b", "medium", 0.7, "Error text sent to the client", ("info-disclosure", "cwe-209"), "Send a general message and log the rest."),
        Rule("stack-in-response", rf"(?i)\.(?:json|send|write|render)\s*\([^)]*\b{_ERR}\.stack\b|ctx\.body\s*=\s*[^;\n]*\b{_ERR}\.(?:stack|message)\b|reply\.send\s*\(\s*{_ERR}\b", "medium", 0.65, "Stack trace sent to the client", ("info-disclosure", "cwe-209"), "Log it and send a request id."),
        Rule("render-error-object", rf"(?i)res\.render\s*\([^)]*\{{[^}}]*\b{_ERR}\b", "low", 0.4, "Error object given to a template", ("info-disclosure",), "Pass a message made for users."),
        Rule("env-dump", r"(?:res(?:ponse)?\.(?:json|send)\s*\(\s*process\.env|JSON\.stringify\s*\(\s*process\.env|ctx\.body\s*=\s*process\.env)", "high", 0.85, "Whole environment sent or written", ("info-disclosure", "secret"), "Pick the values that are no secrets."),
        Rule("cors-wildcard", r"""Access-Control-Allow-Origin['"]?\s*[,:]\s*['"]\*['"]|\bcors\s*\(\s*\)""", "medium", 0.55, "Any origin may call", ("cors", "cwe-942"), "List the origins."),
        Rule("verbose-error-flag", r"(?i)\b(?:showStack|includeStack|exposeErrors?|stackTrace|verboseErrors?)\s*:\s*true|errors?\s*:\s*\{\s*[^}]*stack\s*:\s*true", "low", 0.45, "Errors shown in full", ("info-disclosure",), "Turn it off in production."),
    ),
)

DOCKER_PATHS = r"(?i)(^|/)(dockerfile|[^/]*\.dockerfile|dockerfile\.[^/]*)$"
CI_PATHS = r"(^|/)\.github/workflows/.*\.ya?ml$|(^|/)\.gitlab-ci\.yml$|(^|/)(\.circleci|\.woodpecker)/"
_CURL = r"(?i)curl\s+[^|]*\|\s*(sudo\s+)?(sh|bash)"

DOCKER = Group(
    "static/ci-docker", "Container and pipeline files", 8, paths=DOCKER_PATHS, comments=("#",),
    rules=(
        Rule("docker-latest-tag", r"(?i)^\s*FROM\s+\S+:latest\b|^\s*FROM\s+[^:@\s]+\s*$", "low", 0.7, "Base image without a fixed version", ("supply-chain",), "Pin a version or digest."),
        Rule("docker-add-remote", r"(?i)^\s*ADD\s+https?://", "medium", 0.7, "ADD from the network", ("supply-chain",), "Copy a checked file."),
        Rule("docker-curl-bash", _CURL, "high", 0.8, "Download piped into a shell", ("supply-chain", "cwe-494"), "Download, check, then run."),
        Rule("docker-root", r"(?i)^\s*USER\s+root\b", "low", 0.5, "Container runs as root", ("hardening",), "Add another user."),
    ),
)

CI = Group(
    "static/ci-docker", "Container and pipeline files", 8, paths=CI_PATHS, unless_paths=DOCKER_PATHS, comments=("#",),
    rules=(
        Rule("ci-unpinned-action", r"(?i)uses:\s*[\w.-]+/[\w.-]+@(main|master|v?\d+)\s*$", "low", 0.55, "Action without a fixed commit", ("supply-chain",), "Pin the commit."),
        Rule("ci-curl-bash", _CURL, "high", 0.8, "Download piped into a shell in CI", ("supply-chain",), "Download, check, then run."),
    ),
)

DEBT = Group(
    "static/debt", "Debt markers", 5, unless_languages=("unknown", "markdown"), longest=1000,
    rules=tuple(
        Rule(id_, pattern, severity, 0.6, id_.replace("-", " ") + " marker", tags, "Resolve the marker or file a ticket for it.")
        for id_, pattern, severity, tags in (
            ("todo", r"\b(TODO|FIXME|HACK|XXX|BUG|REFACTOR|OPTIMIZE)\b[:\s]", "info", ("debt",)),
            ("not-implemented", r"""(?i)throw\s+new\s+Error\s*\(\s*["'`](not implemented|unimplemented|todo|TODO)""", "low", ("debt",)),
            ("console-log", r"console\.(log|debug|info)\s*\(", "info", ("debug",)),
            ("ts-ignore", r"@ts-(ignore|nocheck|expect-error)", "low", ("types",)),
            ("any-cast", r"\bas\s+any\b|:\s*any\b", "info", ("types",)),
            ("nonnull-assert", r"\w!\.\w|\w!\)", "info", ("types",)),
        )
    ),
)

SOLIDITY = Group(
    "static/solidity", "Solidity contracts", 3, languages=("solidity",), comments=("//", "*", "/*"), column=1,
    rules=(
        Rule("tx-origin-auth", r"require\s*\(\s*tx\.origin\s*[!=]=|tx\.origin\s*[!=]=\s*(owner|msg\.sender|admin)", "high", 0.85, "Access decided by tx.origin", ("access-control", "swc-115"), "Compare msg.sender."),
        Rule("unchecked-low-level-call", r"\.call\{[^}]*\}\s*\(|\.call\s*\(|\.delegatecall\s*\(", "medium", 0.4, "Low-level call", ("reentrancy", "swc-104"), "Check what it returns, and guard against reentry."),
        Rule("delegatecall", r"\.delegatecall\s*\(", "high", 0.5, "delegatecall", ("delegatecall", "swc-112"), "Make sure the target is fixed and trusted."),
        Rule("selfdestruct", r"selfdestruct\s*\(|suicide\s*\(", "high", 0.7, "selfdestruct", ("swc-106",), "Guard it or remove it."),
        Rule("block-timestamp-logic", r"(block\.timestamp|now)\s*[<>=]", "low", 0.4, "Logic on block time", ("swc-116",), "Do not depend on exact times."),
        Rule("blockhash-randomness", r"keccak256\s*\([^)]*(block\.(timestamp|difficulty|prevrandao|number)|blockhash)|\b(blockhash\s*\([^)]*\)|block\.(prevrandao|difficulty))\s*[%*/+]|[%*/+]\s*(blockhash\s*\(|block\.(prevrandao|difficulty|timestamp))", "high", 0.7, "Randomness from block values", ("randomness", "swc-120"), "Use a verifiable random source."),
        Rule("floating-pragma-range", r"pragma\s+solidity\s+(>=|>|<=|<)", "low", 0.7, "Compiler version by range", ("swc-103",), "Pin one version."),
        Rule("unbounded-loop", r"for\s*\([^;]*;\s*[^;]*<\s*\w+\.length\s*;[^)]*\)", "low", 0.35, "Loop over a growing array", ("dos", "swc-128"), "Bound the number of turns."),
        Rule("missing-zero-address-check", r"function\s+(setOwner|transferOwnership|setAdmin|changeOwner|setBeneficiary|setRecipient|setTreasury)\s*\(\s*address\s+\w+", "low", 0.3, "Setter that may take the zero address", ("access-control",), "Require a non-zero address."),
        Rule("unprotected-selfmint-or-transfer", r"function\s+(mint|burn|withdraw|setOwner|transferOwnership|upgrade|initialize)\b[^;{]*\{", "medium", 0.3, "Powerful function without a visible guard", ("access-control",), "Add a role check or an initializer guard.", unless=r"only[A-Z]\w*|onlyOwner|require\s*\(\s*msg\.sender|_checkRole|initializer"),
        Rule("floating-pragma", r"pragma\s+solidity\s+\^", "low", 0.8, "Floating compiler version", ("swc-103",), "Pin one version."),
        Rule("unsafe-erc20-transfer", r"\.transfer\s*\(|\.transferFrom\s*\(|\.approve\s*\(", "low", 0.25, "Token call whose result may be lost", ("erc20",), "Use a safe wrapper."),
        Rule("assembly-block", r"\bassembly\s*\{", "info", 0.4, "Inline assembly", ("assembly",), "Review it by hand."),
    ),
)

#: Known secrets. Patterns of this engine; ids, severities and confidences of the first four are fixed values.
SECRETS = Group(
    "static/secrets", "Secrets in the source", 1, longest=2000,
    rules=(
        Rule("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "critical", 0.95, "AWS access key", ("secret", "cwe-798"), "Revoke the key and read it from the environment."),
        Rule("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})\b", "critical", 0.95, "GitHub token", ("secret", "cwe-798"), "Revoke the token."),
        Rule("connection-string-creds", r"""\b[a-z][a-z0-9+.-]{1,20}://[^\s:@/"'`$<{]{1,80}:[^\s:@/"'`$<{]{3,120}@[\w.-]+""", "high", 0.8, "Credentials in a URL", ("secret", "cwe-798"), "Keep the credentials out of the URL."),
        Rule("hardcoded-password", r"""(?i)\b[\w.-]*(?:password|passwd|pwd|secret|api_?key)[\w-]*["'`]?\s*[:=]\s*["'`][^"'`\s]{6,100}["'`]""", "high", 0.55, "Password in the source", ("secret", "cwe-798"), "Read it from the environment and rotate it.", unless=r"""(?i)process\.env|os\.(environ|getenv)|randomBytes|randomUUID|generate|[:=]\s*["'`](?:/|\./|https?:|\$\{|<|\{\{|your|example|changeme|placeholder|x{4,}|\*{3,})"""),
        Rule("private-key-pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "critical", 0.95, "Private key", ("secret", "cwe-321"), "Remove the key and replace it."),
        Rule("eth-wallet-literal", r"""Wallet\s*\(\s*["'`](?:0x)?[0-9a-fA-F]{60,64}["'`]""", "critical", 0.9, "Wallet made from a literal key", ("secret", "cwe-321"), "Load the key from a secret store."),
        Rule("eth-private-key", r"""(?i)\b(?:private_?key|priv_?key|secret_?key|wallet_?key|pk)\b["'`]?\s*[:=]\s*["'`]0x[0-9a-f]{64}["'`]""", "critical", 0.85, "Private key of an account", ("secret", "cwe-321"), "Move the funds and remove the key."),
        Rule("eth-private-key-loose", r"""(?i)\b(?:private|wallet|signer|deployer)\w*["'`]?\s*[:=]\s*["'`][0-9a-f]{64}["'`]""", "high", 0.5, "Likely private key", ("secret", "cwe-321"), "Load it from a secret store.", unless=r"(?i)hash|merkle|root|sha|digest|checksum|salt|nonce"),
        Rule("slack-token", r"\b(?:xox[abprs]|xapp)-[0-9A-Za-z-]{10,}\b", "critical", 0.9, "Slack token", ("secret", "cwe-798"), "Revoke the token."),
        Rule("slack-webhook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/_-]{20,}", "high", 0.85, "Slack webhook", ("secret", "cwe-798"), "Replace the webhook."),
        Rule("stripe-secret", r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}\b", "critical", 0.9, "Stripe key", ("secret", "cwe-798"), "Roll the key."),
        Rule("stripe-webhook", r"\bwhsec_[0-9A-Za-z]{24,}\b", "high", 0.85, "Stripe webhook secret", ("secret", "cwe-798"), "Roll the secret."),
        Rule("openai-key", r"\bsk-(?:proj-)?[A-Za-z0-9]{32,}\b", "critical", 0.85, "API key with the prefix sk-", ("secret", "cwe-798"), "Revoke the key."),
        Rule("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}\b", "high", 0.9, "Google API key", ("secret", "cwe-798"), "Restrict or replace the key."),
        Rule("gitlab-token", r"\bglpat-[0-9A-Za-z_-]{20,}\b", "critical", 0.9, "GitLab token", ("secret", "cwe-798"), "Revoke the token."),
        Rule("npm-token", r"\bnpm_[0-9A-Za-z]{36}\b", "critical", 0.9, "npm token", ("secret", "cwe-798"), "Revoke the token."),
        Rule("sendgrid-key", r"\bSG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}\b", "critical", 0.9, "SendGrid key", ("secret", "cwe-798"), "Replace the key."),
        Rule("twilio-key", r"\bSK[0-9a-f]{32}\b", "high", 0.7, "Twilio key", ("secret", "cwe-798"), "Replace the key."),
        Rule("telegram-bot-token", r"\b[0-9]{8,10}:AA[0-9A-Za-z_-]{33}\b", "high", 0.85, "Telegram bot token", ("secret", "cwe-798"), "Replace the token."),
        Rule("discord-webhook", r"https://discord(?:app)?\.com/api/webhooks/[0-9]+/[0-9A-Za-z_-]{20,}", "high", 0.85, "Discord webhook", ("secret", "cwe-798"), "Replace the webhook."),
        Rule("jwt-literal", r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", "medium", 0.6, "Signed token in the source", ("secret", "cwe-798"), "Do not keep tokens in files."),
    ),
)

GROUPS = (SECRETS, JS, PYTHON, SOLIDITY, DEBT, ENV_LEAK, DOCKER, CI)
