"""Line scanners: secrets, injection, environment, documents, tokens. All are Column expressions over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of secrets, in order of precedence, with their severity.
SECRETS = [
    ("AWS_ACCESS_KEY", r"(?:A3T[A-Z0-9]|AKIA|AGPA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}", "high"),
    ("GITHUB_TOKEN", r"(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36,255}", "high"),
    ("SLACK_TOKEN", r"xox[bposa]-[0-9a-zA-Z\-]{10,}", "high"),
    ("STRIPE_SECRET_KEY", r"sk_(?:live|test)_[0-9a-zA-Z]{24,}", "high"),
    ("STRIPE_PUBLIC_KEY", r"pk_live_[0-9a-zA-Z]{24,}", "medium"),
    ("GOOGLE_API_KEY", r"AIza[0-9A-Za-z\-_]{35}", "high"),
    ("TWILIO_SID", r"\bAC[0-9a-f]{32}\b", "high"),
    ("SENDGRID_KEY", r"SG\.[a-zA-Z0-9_\-]{20,}\.[a-zA-Z0-9_\-]{39,}", "high"),
    ("NPM_TOKEN", r"//registry\.npmjs\.org/:_authToken=[A-Za-z0-9\-]+", "high"),
    ("PYPI_TOKEN", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9\-_]{50,}", "high"),
    ("PRIVATE_KEY", r"-----BEGIN[A-Z ]*PRIVATE KEY-----", "high"),
    ("OPENAI_KEY", r"\bsk-[A-Za-z0-9]{20,}\b", "high"),
]
GENERIC_SECRET = r"""(?i)(?:api[_-]?key|secret[_-]?key|password|passwd|token|auth[_-]?token|credential|client[_-]?secret)\s*[:=]\s*["'][^"']{20,}["']"""
SECRET_HINT = r"""(?i)A3T|AKIA|AGPA|AROA|AIPA|ANPA|ANVA|ASIA|gh[pousr]_|xox[bposa]-|[sp]k_(?:live|test)_|AIza|\bAC[0-9a-f]|SG\.|_authToken=|pypi-|-----BEGIN|\bsk-|[:=]\s*["']"""
SECRET_SKIP = r"(?i)(os\.environ|process\.env|getenv|\.env\(|^\s*#|^\s*//|^\s*\*|your[_-].*[_-]here|changeme|xxx+|TODO|REPLACE|example|placeholder|<[A-Z_]+>)"

# Names of unsafe calls, and of sources and sinks of model output.
UNSAFE_CALLS = [
    "eval", "exec", "compile", "Function", "pickle.loads", "pickle.load", "yaml.unsafe_load", "yaml.load", "marshal.loads",
    "shelve.open", "os.system", "os.popen", "subprocess.call", "subprocess.run", "subprocess.Popen", "child_process.exec", "child_process.execSync", "child_process.spawn",
]
LLM_SOURCES = [
    "completions.create", "messages.create", "chat.completions", "cohere.generate", "cohere.chat", "chain.invoke", "chain.run", "agent.invoke", "llm.invoke",
    "llm.predict", "llm.generate", "model.generate_content", "generate_content",
]
LLM_SINKS = [
    "eval", "exec", "compile", "Function", "cursor.execute", "db.execute", "connection.execute", "session.execute", "execute",
    "executemany", "os.system", "os.popen", "subprocess.call", "subprocess.run", "child_process.exec", "child_process.execSync", "document.write", "render_template_string",
]
SQL_EXECUTORS = ["execute", "executemany", "$executeRaw", "$executeRawUnsafe", "cursor.execute", "connection.execute", "db.execute", "session.execute", "query(", "$queryRaw", "raw("]

# Environment lookups, kinds of documents and of config files.
PYTHON_ENV = [r"""os\.environ\[["']([A-Z_][A-Z0-9_]*)["']\]""", r"""os\.environ\.get\(["']([A-Z_][A-Z0-9_]*)["']""", r"""os\.getenv\(["']([A-Z_][A-Z0-9_]*)["']"""]
WEB_ENV = [r"process\.env\.([A-Z_][A-Z0-9_]*)", r"""process\.env\[["']([A-Z_][A-Z0-9_]*)["']\]""", r"""Deno\.env\.get\(["']([A-Z_][A-Z0-9_]*)["']"""]
DOC_TYPES = [("readme", "readme"), ("changelog", "changelog|changes|release.?notes"), ("adr", "adr|arch.*decision"), ("architecture", "architect|design|system"), ("contributing", "contribut"), ("api", "api|endpoint|openapi|swagger"), ("guide", "guide|tutorial|howto|getting.?started|onboard")]
SOURCE_LINK = r"\.(tsx?|jsx?|py|s?css|json|ya?ml|toml|sql)"
CONFIG_NAMES = {"package.json": "package", "tsconfig.json": "tsconfig", "Dockerfile": "dockerfile", "docker-compose.yml": "compose", "docker-compose.yaml": "compose", "compose.yml": "compose", "compose.yaml": "compose", "requirements.txt": "package", "pyproject.toml": "package"}
CONFIG_PATHS = [(r"\.github/workflows/[^/]+\.ya?ml$", "ci"), (r"\.env\.(example|template|sample)$", "env_template")]

# Name parts of design tokens by category.
TOKEN_COLOR = [
    "color", "bg", "background", "foreground", "border", "ring", "accent", "primary", "secondary",
    "muted", "destructive", "success", "warning", "info", "popover", "card", "input", "chart",
    "gradient", "fill", "stroke", "brand", "surface",
]
TOKEN_TYPE = [
    "font", "leading", "tracking", "letter", "weight", "family", "text",
]
TOKEN_SPACE = [
    "spacing", "space", "gap", "size", "width", "height", "inset", "margin", "padding",
    "breakpoint", "container",
]
TOKEN_MOTION = [
    "animate", "animation", "keyframe", "duration", "ease", "transition", "delay",
]
COLOR_VALUE = r"#[0-9a-fA-F]{3,8}\b|\brgba?\(|\bhsla?\(|\boklch\(|\boklab\(|\bcolor\("


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line from 1, body) of every line."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def secret(body: str | Column) -> Column:
    """The kind of secret in a line, the first that fits; null for none and for lines that only look up or show one."""
    c = F.col(body) if isinstance(body, str) else body
    out = F.when(c.rlike(GENERIC_SECRET), "GENERIC_SECRET")
    for kind, pattern, _ in reversed(SECRETS):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    # one cheap look before fourteen patterns: parts that every one of them has
    return F.when(c.rlike(SECRET_HINT), F.when(~c.rlike(SECRET_SKIP), out))


def severity(kind: Column) -> Column:
    out = F.when(kind == "GENERIC_SECRET", "medium")
    for name, _, level in SECRETS:
        out = F.when(kind == name, level).otherwise(out)
    return out


def runs_sql(text: Column) -> Column:
    """Whether a file calls anything that executes SQL; lines of other files are no injections."""
    return F.exists(F.array(*map(F.lit, SQL_EXECUTORS)), lambda e: F.contains(text, e))


def sql_injection(body: Column, language: Column) -> Column:
    """Whether a line puts SQL together from values; comment lines do not count."""
    word = r"\b(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b"
    concat = body.rlike(rf"""(?i)["'].*{word}.*["']\s*\+""")
    python = body.rlike(rf"""(?i)f["'].*{word}.*\{{""") | body.rlike(rf"""(?i)["'].*{word}.*["']\s*%\s*(?!\()""") | body.rlike(rf"""(?i)["'].*{word}.*\{{.*\}}.*["']\.format\(""")
    web = body.rlike(rf"(?i)`[^`]*{word}[^`]*\$\{{")
    return ~body.rlike(r"^\s*(#|//|\*)") & (concat | F.when(language == "python", python).otherwise(web))


def unsafe_calls(calls: Column) -> Column:
    return F.transform(F.array_intersect(calls, F.array(*map(F.lit, UNSAFE_CALLS))), lambda c: F.concat(F.lit("unsafe_call:"), c))


def llm_output_risks(calls: Column) -> Column:
    """Sinks that a function with a model call hands results to."""
    sources = F.array(*map(F.lit, LLM_SOURCES))
    has = F.exists(calls, lambda c: F.exists(sources, lambda s: F.contains(c, s)))
    sinks = F.array_intersect(calls, F.array(*map(F.lit, LLM_SINKS)))
    return F.when(has, F.transform(sinks, lambda c: F.concat(F.lit("llm_output:"), c))).otherwise(F.array().cast("array<string>"))


def env_names(text: Column, language: Column) -> Column:
    found = lambda patterns: F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p)) for p in patterns)))
    return F.array_sort(F.array_distinct(F.when(language == "python", found(PYTHON_ENV)).otherwise(found(WEB_ENV))))


def doc_type(path: Column, title: Column) -> Column:
    both, out = F.concat_ws(" ", path, title), F.lit("other")
    for kind, pattern in reversed(DOC_TYPES):
        out = F.when(both.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def config_type(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(CONFIG_PATHS):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in CONFIG_NAMES.items() for x in p)), F.element_at(F.split(path, "/"), -1)), out)


def reference_kind(text: Column) -> Column:
    """What an inline code reference of a document names: a file, an entity, or nothing (null)."""
    path = text.rlike(r"^[\w@.-]+(/[\w@.-]+)+\.\w+$")
    entity = text.rlike(r"^[A-Z][a-zA-Z0-9]*(\.[a-zA-Z]\w*)*$|^[a-z]\w*(\.[a-z]\w*)+$|^use[A-Z]\w*$|^[a-z]+[A-Z]\w*$|^[a-z]+(_[a-z0-9]+)+$")
    return F.when((F.length(text) >= 2) & (F.length(text) <= 100) & ~text.rlike(r"^(http|#|-|\$)|\s"), F.when(path, "file").when(entity, "entity"))


def token_category(name: Column, value: Column) -> Column:
    n, v = F.lower(name), F.trim(value)
    has = lambda words: n.rlike("|".join(words))
    color = v.rlike(COLOR_VALUE)
    triplet = v.rlike(r"^-?\d+(\.\d+)?\s+-?\d+(\.\d+)?%\s+-?\d+(\.\d+)?%")
    shadow = v.rlike(r"^\s*(inset\s+)?-?\d[\d.]*(px|rem|em)?\s+-?\d")
    layer = v.rlike(r"^-?\d+$") & ((n == "z") | n.startswith("z-") | n.rlike("z-index|zindex|z_index"))
    return (
        F.when(n.rlike("colou?r$"), "color").when(n.rlike("radius|rounded"), "radius").when(F.contains(n, F.lit("shadow")), "shadow").when(layer, "z_index")
        .when(has(TOKEN_MOTION), "animation").when(shadow & color, "shadow").when(color | triplet | has(TOKEN_COLOR), "color").when(has(TOKEN_TYPE), "typography")
        .when(has(TOKEN_SPACE) | v.rlike(r"\d(px|rem|em|vh|vw|vmin|vmax|ch|%)(\b|$)"), "spacing").otherwise("other")
    )


# The namespaces of tokens that utility classes of a prefix draw from, nearest first.
UTILITY_SPACES = {
    "bg": ["color"], "text": ["color", "text"], "border": ["color"], "ring": ["color"], "ring-offset": ["color"], "fill": ["color"], "stroke": ["color"], "outline": ["color"], "decoration": ["color"],
    "accent": ["color"], "caret": ["color"], "placeholder": ["color"], "divide": ["color"], "from": ["color"], "via": ["color"], "to": ["color"],
    "shadow": ["shadow", "color"], "rounded": ["radius"], "font": ["font"], "leading": ["leading"], "tracking": ["tracking"], "z": ["z"], "animate": ["animate", "animation"], "duration": ["duration"], "ease": ["ease"],
    "p": ["spacing"], "px": ["spacing"], "py": ["spacing"], "pt": ["spacing"], "pr": ["spacing"], "pb": ["spacing"], "pl": ["spacing"], "ps": ["spacing"], "pe": ["spacing"],
    "m": ["spacing"], "mx": ["spacing"], "my": ["spacing"], "mt": ["spacing"], "mr": ["spacing"], "mb": ["spacing"], "ml": ["spacing"], "ms": ["spacing"], "me": ["spacing"],
    "gap": ["spacing"], "gap-x": ["spacing"], "gap-y": ["spacing"], "space-x": ["spacing"], "space-y": ["spacing"],
    "w": ["spacing"], "h": ["spacing"], "size": ["spacing"], "min-w": ["spacing"], "max-w": ["spacing"], "min-h": ["spacing"], "max-h": ["spacing"],
}


def utility_tokens(name: Column) -> Column:
    """Token names a utility class may draw from, nearest first: those of its prefix's namespaces, and for colours the bare
    name. Arbitrary values, fractions and bare utilities draw from none."""
    spaces = UTILITY_SPACES
    bare = F.regexp_replace(F.element_at(F.split(name, ":"), -1), "^[!-]+", "")
    shape = "^(" + "|".join(sorted(spaces, key=len, reverse=True)) + ")-(.+)$"
    prefix, rest = F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2)
    own = F.element_at(F.create_map(*(x for p, k in spaces.items() for x in (F.lit(p), F.array(*map(F.lit, k))))), prefix)
    suffix = F.split_part(rest, F.lit("/"), F.lit(1))
    fraction = F.contains(rest, F.lit("/")) & suffix.rlike(r"^\d*\.?\d*$")
    named = F.concat(F.transform(own, lambda k: F.concat(k, F.lit("-"), suffix)), F.when(F.array_contains(own, "color"), F.array(suffix)).otherwise(F.array().cast("array<string>")))
    return F.when(F.contains(bare, F.lit("[")) | (prefix == "") | fraction, F.array().cast("array<string>")).otherwise(named)


def style_drift(text: Column) -> tuple[Column, Column]:
    """(hard-coded colours, off-scale values) in arbitrary utility values."""
    values = F.regexp_extract_all(text, F.lit(r"[a-z]-\[([^\]\s]+)\]"))
    colors = F.filter(values, lambda v: v.rlike(COLOR_VALUE))
    return F.array_sort(F.array_distinct(F.transform(colors, F.lower))), F.array_sort(F.array_distinct(F.filter(values, lambda v: v.rlike(r"^-?\d[\d.]*(px|rem|em|%|vh|vw)$"))))
