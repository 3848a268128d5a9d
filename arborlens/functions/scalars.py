"""Scalar functions of the code graph as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directory names by layer.
LAYERS = {
    "routes": 3, "pages": 3, "handlers": 3, "views": 3, "services": 2, "usecases": 2, "logic": 2, "adapters": 1, "repositories": 1, "db": 1, "database": 1,
    "utils": 0, "shared": 0, "lib": 0, "common": 0, "helpers": 0,
}

# Packages by category of external service.
SERVICES = {
    "database": ["@supabase/supabase-js", "supabase", "prisma", "@prisma/client", "drizzle-orm", "mongoose", "typeorm", "sequelize", "knex", "pg", "mysql2", "better-sqlite3", "redis", "ioredis"],
    "auth": ["@clerk/nextjs", "@clerk/clerk-js", "next-auth", "@auth/core", "passport", "lucia", "arctic", "@supabase/auth-helpers-nextjs"],
    "payments": ["stripe", "@stripe/stripe-js", "@stripe/react-stripe-js", "@lemonsqueezy/lemonsqueezy.js"],
    "email": ["resend", "@sendgrid/mail", "nodemailer", "postmark", "@react-email/components", "react-email"],
    "ai": ["openai", "@anthropic-ai/sdk", "ai", "@ai-sdk/openai", "@ai-sdk/anthropic", "langchain", "@langchain/core", "replicate"],
    "storage": ["@aws-sdk/client-s3", "@supabase/storage-js", "cloudinary", "uploadthing", "@uploadthing/react"],
    "analytics": ["posthog-js", "@vercel/analytics", "@sentry/nextjs", "@sentry/node", "mixpanel", "amplitude-js"],
    "ui": ["tailwindcss", "class-variance-authority", "clsx", "tailwind-merge", "lucide-react", "@heroicons/react", "framer-motion", "@headlessui/react", "cmdk"],
    "forms": ["react-hook-form", "@hookform/resolvers", "zod", "yup", "formik"],
    "state": ["zustand", "jotai", "@tanstack/react-query", "swr", "@reduxjs/toolkit", "react-redux", "recoil"],
}

# Packages by framework.
FRAMEWORKS = {
    "nextjs": ["next"], "react": ["react"], "express": ["express"], "hono": ["hono"], "fastify": ["fastify"], "supabase": ["@supabase/supabase-js", "supabase"],
    "clerk": ["@clerk/nextjs", "@clerk/clerk-js"], "nextauth": ["next-auth"], "stripe": ["stripe", "@stripe/stripe-js"], "prisma": ["prisma", "@prisma/client"],
    "drizzle": ["drizzle-orm"], "trpc": ["@trpc/server", "@trpc/client"], "tailwind": ["tailwindcss"], "fastapi": ["fastapi"], "django": ["django"], "flask": ["flask"],
    "vue": ["vue"], "angular": ["@angular/core"], "svelte": ["svelte"], "nuxt": ["nuxt"], "remix": ["@remix-run/react"], "astro": ["astro"],
}

# Path fragments of server code, and decorator words of authentication.
SERVER_MARKERS = ["supabase/functions/", "/workers/", "workers/", "/server/", "/backend/", "/api/", "/functions/"]
AUTH_WORDS = ["auth", "login_required", "permission", "protect", "jwt", "token", "requires_auth", "authenticated", "verify", "guard", "session", "bearer", "oauth", "apikey", "api_key", "credentials"]
AUTH_DECORATORS = ["auth", "login_required", "permission", "protect", "jwt", "token", "requires_auth", "authenticated", "verify"]
#: Words of functions that guard all paths of a pattern.
GUARD_WORDS = ["auth", "login", "permission", "protect", "jwt", "token", "verify", "guard", "session", "bearer", "oauth", "apikey", "api_key", "credentials", "clerk", "passport", "unkey"]

# Standard library modules that are no package.
STDLIB = "os sys re json typing pathlib datetime collections functools itertools logging asyncio dataclasses enum abc math random string time uuid hashlib base64 io copy contextlib unittest argparse subprocess threading multiprocessing shutil tempfile urllib http socket struct csv inspect warnings traceback importlib operator decimal statistics secrets types textwrap glob pickle __future__".split()


# Generics whose second argument counts, and words of calls that write and read.
MAPPINGS = ["dict", "map", "record", "mapping"]
WRITE_WORDS = ["create", "insert", "save", "add", "update", "delete", "remove", "bulk_create", "upsert", "put", "write"]
READ_WORDS = ["query", "select", "get", "find", "filter", "all", "first", "one", "fetch", "read", "exists", "count", "list"]


def cap(items: Column, n: int) -> tuple[Column, Column]:
    """(first n items, how many are left out); a null list is empty."""
    some = F.coalesce(items, F.array().cast("array<string>"))
    return F.slice(some, 1, n), F.greatest(F.size(some) - n, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.when(whole != 0, whole), 1)


def directory(path: Column, depth: int = 2) -> Column:
    """The first `depth` segments of a path's directory."""
    return F.array_join(F.slice(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), 1, depth), "/")


def layer(path: Column, layers: dict[str, int] | None = None) -> Column:
    """Layer of the deepest directory that names one; the file name does not count."""
    layers = LAYERS if layers is None else layers
    table = F.create_map(*(x for k, v in layers.items() for x in (F.lit(k), F.lit(v))))
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    found = F.filter(F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.element_at(table, p)), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def category(name: Column, table: dict[str, list[str]]) -> Column:
    """First category whose packages hold the name; an entry that ends in * stands for its prefix."""
    out = F.lit(None).cast("string")
    for key, packages in reversed(list(table.items())):
        exact = [p for p in packages if not p.endswith("*")]
        hit = name.isin(exact) if exact else F.lit(False)
        for p in packages:
            if p.endswith("*"):
                hit = hit | name.startswith(p[:-1])
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def rotate_least(items: Column) -> Column:
    """A cycle from its least member on."""
    at = F.array_position(items, F.array_min(items)).cast("int")
    return F.concat(F.slice(items, at, F.size(items)), F.slice(items, F.lit(1), at - 1))


def surfaces(paths: Column, markers: list[str] = SERVER_MARKERS) -> Column:
    """Which of client and server the paths belong to."""
    some = F.filter(paths, lambda p: p.isNotNull())
    marks = F.array(*map(F.lit, markers))
    server = lambda p: F.exists(marks, lambda m: F.contains(p, m))
    both = F.array(F.when(F.exists(some, lambda p: ~server(p)), "client"), F.when(F.exists(some, server), "server"))
    return F.filter(both, lambda v: v.isNotNull())


def family(key: Column) -> Column:
    """A flag key without its version and stage endings."""
    return F.regexp_replace(key, r"(?:_?V\d+|_GLOBAL_ROLLOUT|_GLOBAL|_PREVIEW_GENERATION|_COLLAPSE_MENUS)+$", "")


def flag_dependencies(description: Column, key: Column) -> Column:
    """Keys that a description says a flag depends on, in order, without itself."""
    words = r"(?i)(?:Requires|Only meaningful when|Only engages when|Sub-switch of|paired with)\s+([A-Z][A-Z0-9_]{3,})"
    return F.filter(F.array_distinct(F.transform(F.regexp_extract_all(description, F.lit(words), F.lit(1)), F.upper)), lambda k: k != key)


def path_matches(path: Column, pattern: Column) -> Column:
    """A route path under an app pattern: *, prefix/* or the same."""
    prefix = F.regexp_replace(pattern, r"/?\*$", "")
    return F.when(pattern == "*", True).when(pattern.endswith("/*"), (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))).otherwise(path == pattern)


def unwrap_type(annotation: Column, layers: int = 10) -> Column:
    """The class inside generics: X | None is X, of a mapping the part behind its first comma; unions of more members stay.
    A layer is what stands between the first opening and the last closing bracket."""

    def inside(out: Column, opening: str, closing: str) -> tuple[Column, Column]:
        at = F.instr(out, opening)
        inner = F.trim(out.substr(at + 1, F.length(out) - at - 1))
        mapping = F.lower(F.trim(out.substr(F.lit(1), at - 1))).isin(MAPPINGS) & F.contains(inner, F.lit(","))
        return (at > 1) & out.endswith(closing), F.when(mapping, F.trim(F.regexp_replace(inner, "^[^,]*,", ""))).otherwise(inner)

    def peel(out: Column, _: Column) -> Column:
        members = F.filter(F.transform(F.split(out, r"\|"), lambda m: F.trim(m)), lambda m: ~m.isin("None", "null", "undefined"))
        bare = F.when(F.size(members) == 1, members[0]).otherwise(out)
        return F.element_at(F.transform(F.array(bare), unlayer), 1)

    def unlayer(bare: Column) -> Column:
        angle, square = inside(bare, "<", ">"), inside(bare, "[", "]")
        return F.when(bare.endswith("[]"), F.trim(bare.substr(F.lit(1), F.length(bare) - 2))).when(angle[0], angle[1]).when(square[0], square[1]).otherwise(bare)

    # a fold, so that the expression does not grow with the layers
    return F.aggregate(F.sequence(F.lit(1), F.lit(layers)), F.trim(F.regexp_replace(annotation, "[\"']", "")), peel)


def package(module: Column, language: Column) -> Column:
    """The package an import names: the top module of Python, one segment (two if scoped) of npm; null for none."""
    top = F.split_part(module, F.lit("."), F.lit(1))
    python = F.when(~top.isin(STDLIB) & (top != ""), top)
    parts = F.split(module, "/")
    scoped = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, 2), "/"))
    npm = F.when(module.startswith(".") | module.startswith("/") | module.startswith("node:"), None).when(module.startswith("@"), scoped).otherwise(parts[0])
    return F.when(language == "python", python).otherwise(npm)


def graph_name(repo_id: Column) -> Column:
    """A repository id as a namespace: other characters to _, at most 48, longer ones with a hash."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(repo_id, "[^A-Za-z0-9]", "_"), "^_+|_+$", ""))
    return F.when(F.length(clean) > 48, F.concat(F.substring(clean, 1, 36), F.lit("_"), F.substring(F.sha2(repo_id, 256), 1, 8))).otherwise(clean)


def repo_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def version_parts(version: Column) -> Column:
    """Numbers of a version, without range signs."""
    bare = F.regexp_replace(F.trim(F.split_part(version, F.lit(","), F.lit(1))), r"^[\^~<>=!v\s]+", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"(\d+)")), lambda x: F.try_to_number(x, F.lit("999999999")).cast("long"))


def is_outdated(version: Column, latest: Column) -> Column:
    """Whether latest is the higher version; anything that is no version is not outdated."""
    a, b = version_parts(version), version_parts(latest)
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (a < b), F.lit(False))


def access_of(call: Column) -> Column:
    """write or read by the segments of a call and the words of its last one; a write word counts first."""
    head = F.split_part(call, F.lit("("), F.lit(1))
    segments = F.regexp_extract_all(head, F.lit(r"(\w+)"))
    last = F.regexp_extract_all(F.element_at(F.split(head, r"\."), -1), F.lit("([A-Z]?[a-z]+|[A-Z]+(?![a-z]))"))
    words = F.transform(F.concat(segments, last), F.lower)
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    return F.when(has(WRITE_WORDS), "write").when(has(READ_WORDS), "read")


def method_access(name: Column) -> Column:
    """write or read by the words of a method's name (findOne, soft_delete); a write word counts first."""
    words = F.transform(F.regexp_extract_all(name, F.lit("([A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+)")), F.lower)
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    return F.when(has(WRITE_WORDS), "write").when(has(READ_WORDS), "read")


def next_route(path: Column) -> Column:
    """A page or route file of a file-based router as its path."""
    inner = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)(?:app|pages)/(.*)$", 1), r"(?:^|/)(?:page|route|index)\.[jt]sx?$", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\.[jt]sx?$", ""), r"(?:^|/)\([^)]*\)", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\[\[?\.\.\.(\w+)\]?\]", "*$1"), r"\[(\w+)\]", ":$1")
    return F.concat(F.lit("/"), F.regexp_replace(inner, "^/+|/+$", ""))


def embedding_text(signature: Column, name: Column, docstring: Column) -> Column:
    head = F.when(F.coalesce(signature, F.lit("")) != "", signature).otherwise(name)
    return F.concat_ws("\n", head, F.when(F.coalesce(docstring, F.lit("")) != "", docstring))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm != 0, norm)


STRINGS = T.ArrayType(T.StringType())
