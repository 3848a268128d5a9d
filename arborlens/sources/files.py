"""Repository files as rows, and rows extracted from them by Column expressions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scanners
from ..functions.lexical import with_code
from ..operators import blocks as nest
from ..operators.cascade import normalise
from ..storage import materialize
from .ignore import Rules, read_rules

# Directories never scanned, and the largest file.
EXCLUDED = "node_modules .git __pycache__ .pycache dist build .venv venv .env env .tox .mypy_cache .pytest_cache .ruff_cache egg-info .eggs".split()
MAX_BYTES = 512_000
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "vue": "vue", "svelte": "svelte", "astro": "astro", "md": "markdown", "mdx": "markdown", "css": "css", "sql": "sql", "prisma": "prisma"}
#: Files that set aliases of import paths: JSON with comments, no source files of their own.
ALIAS_FILE = r"(^|/)(jsconfig|tsconfig[^/]*)\.json$"
TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|conftest\.py|[^/]*\.(test|spec)\.[jt]sx?)$|(^|/)(tests|__tests__)/"


def decode(content: Column) -> Column:
    """Text of a file's bytes: by its byte order mark, else UTF-8 with malformed bytes replaced; line ends as \\n."""
    head = F.hex(F.substring(content, 1, 4))
    body = lambda n: F.expr(f"substring(content, {n + 1})")
    text = (
        F.when(head.isin("0000FEFF"), F.decode(body(4), "UTF-32BE")).when(head == "FFFE0000", F.decode(body(4), "UTF-32LE"))
        .when(head.startswith("FEFF"), F.decode(body(2), "UTF-16BE")).when(head.startswith("FFFE"), F.decode(body(2), "UTF-16LE"))
        .when(head.startswith("EFBBBF"), F.make_valid_utf8(body(3).cast("string"))).otherwise(F.make_valid_utf8(content.cast("string")))
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def _walk(frames: Iterator[pd.DataFrame], root: str, excluded: list[str], most: int, rules: Rules) -> Iterator[pd.DataFrame]:
    """(path, length) of the files below each given folder; excluded and ignored folders are never entered."""
    store, base = fs.FileSystem.from_uri(root)
    for frame in frames:
        todo, rows = list(frame["path"]), []
        while todo:
            for info in store.get_file_info(fs.FileSelector(f"{base}/{todo.pop()}".rstrip("/"))):
                path = info.path[len(base) :].lstrip("/")
                if info.type == fs.FileType.Directory and info.base_name not in excluded and not rules.drops(path + "/"):
                    todo.append(path)
                elif info.type == fs.FileType.File and info.size <= most:
                    rows.append((path, info.size))
        yield pd.DataFrame(rows, columns=["path", "length"])


def _load(frames: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    store, base = fs.FileSystem.from_uri(root)
    for frame in frames:
        for a in range(0, len(frame), 64):
            part = frame.iloc[a : a + 64]
            yield part.assign(content=[store.open_input_stream(f"{base}/{p}").readall() for p in part["path"]])


def list_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, rules: Rules | None = None) -> DataFrame:
    """(path, length) of files that no rule ignores, listed by the executors: one task per part of the top folders. Spark's own file sources leave out
    names that begin with _ or ., which a repository needs."""
    store, base = fs.FileSystem.from_uri(root)
    top = store.get_file_info(fs.FileSelector(base))
    own = [(i.base_name, i.size) for i in top if i.type == fs.FileType.File and i.size <= max_bytes]
    rules = rules or Rules([])
    folders = [(i.base_name,) for i in top if i.type == fs.FileType.Directory and i.base_name not in EXCLUDED and not rules.drops(i.base_name + "/")]
    rows = spark.createDataFrame(own, "path string, length long")
    if folders:
        below = spark.createDataFrame(folders, "path string").repartition(min(len(folders), 1024))
        rows = rows.unionByName(below.mapInPandas(lambda frames: _walk(frames, root, EXCLUDED, max_bytes, rules), "path string, length long"))
    return rows.where(~rules.ignored(F.col("path")))


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, extensions: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, config_type, text) of the text files under root (a path or URI) whose extension or name is known. The
    rules of the root's .gitignore hold, then those of `ignore`; the last that fits a path decides."""
    root = root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)
    rows = list_files(spark, root, max_bytes, read_rules(root, ignore))
    rows = rows.where(~F.arrays_overlap(F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/"), F.array(*map(F.lit, EXCLUDED))))
    known = {k: v for k, v in LANGUAGES.items() if extensions is None or k in extensions}
    language = F.element_at(F.create_map(*(F.lit(x) for p in known.items() for x in p)), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    language = F.coalesce(language, F.when(F.col("path").rlike(ALIAS_FILE), "jsonc"))
    config = scanners.config_type(F.col("path"))
    # names decide before contents are read
    head = F.substring("content", 1, 8192)
    wide = F.hex(F.substring("content", 1, 2)).isin("FEFF", "FFFE") | (F.hex(F.substring("content", 1, 4)) == "0000FEFF")
    rows = rows.withColumn("language", language).withColumn("config_type", config).where("language is not null or config_type is not null").select("path", "language", "config_type")
    rows = rows.repartition(F.xxhash64("path")).mapInPandas(lambda frames: _load(frames, root), "path string, language string, config_type string, content binary")
    rows = rows.where(wide | ~F.contains(F.hex(head), F.lit("00")) | ~F.hex(head).rlike("^(..)*00") | F.col("config_type").isNotNull())
    return rows.select("path", "language", "config_type", decode(F.col("content")).alias("text"))


def file_nodes(files: DataFrame) -> DataFrame:
    files = files.where(F.coalesce(F.col("language"), F.lit("")) != "jsonc").unionByName(files.where("language = 'jsonc' and config_type is not null").withColumn("language", F.lit(None).cast("string")))
    todo = F.size(F.filter(F.split("text", "\n"), lambda l: l.rlike(r"(#|//|/\*|\*)\s*(TODO|FIXME|HACK|XXX)\b")))
    return files.select(
        F.concat(F.lit("file::"), F.col("path")).alias("id"), F.lit("File").alias("label"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("path").alias("file_path"), "language", "config_type",
        F.size(F.split("text", "\n")).alias("line_count"), todo.alias("todo_count"), F.col("path").rlike(TEST_FILE).alias("is_test_file"), F.when(F.col("config_type").isNull(), F.col("language") == "markdown").alias("is_documentation"),
    )


def coded(files: DataFrame) -> DataFrame:
    """files with the columns `code` and `bare` of functions/lexical.py."""
    return files if {"code", "bare"} <= set(files.columns) else with_code(files)


def markdown_sections(files: DataFrame) -> DataFrame:
    """(path, heading, level, start_line, end_line): headings outside fences; a section ends before the next heading."""
    rows = scanners.lines(coded(files.where("language = 'markdown'")), "path", "bare")
    last = F.max("line").over(Window.partitionBy("path"))
    heads = rows.withColumn("last", last).where(F.col("body").rlike(r"^#{1,6}\s+\S"))
    after = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    return heads.select("path", F.trim(F.regexp_replace("body", r"^#{1,6}\s+|\s+#*$", "")).alias("heading"), F.length(F.regexp_extract("body", "^(#+)", 1)).alias("level"), F.col("line").alias("start_line"), F.coalesce(after - 1, "last").alias("end_line"))


def section_references(files: DataFrame) -> DataFrame:
    """(path, start_line, reference, kind): names of each section outside fences, once: inline code, links to source files and
    bare paths with an extension of source files. What stands before the first heading belongs to line 1."""
    rows = coded(files.where("language = 'markdown'"))
    start = markdown_sections(rows).select("path", F.col("start_line").alias("line"), F.lit(1).alias("head"))
    marked = scanners.lines(rows, "path", "bare").join(start, ["path", "line"], "left")
    section = F.last(F.when(F.col("head") == 1, F.col("line")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    marked = marked.withColumn("start_line", F.coalesce(section, F.lit(1)))
    inline = marked.select("path", "start_line", F.explode(F.regexp_extract_all("body", F.lit("`([^`]+)`"))).alias("reference"))
    inline = inline.withColumn("reference", F.regexp_replace("reference", r"\(\)$", "")).withColumn("kind", scanners.reference_kind(F.col("reference"))).where("kind is not null")
    linked = marked.select("path", "start_line", F.explode(F.regexp_extract_all("body", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"))).alias("reference"))
    linked = linked.where(~F.col("reference").rlike("^(https?://|mailto:|#)") & F.col("reference").rlike(scanners.SOURCE_LINK)).withColumn("reference", F.regexp_replace("reference", r"^(\./)+|[#?].*$", "")).withColumn("kind", F.lit("file"))
    return inline.unionByName(linked).distinct()


def css_tokens(files: DataFrame) -> DataFrame:
    """Custom properties with value, category and references; of equal names the shallowest, then first, path stays. A
    declaration inside of a comment or a string is none; `;` and braces inside of strings do not end one."""
    rows = coded(files.where("language = 'css'"))
    found = nest.heads(rows, r"(?<![\w-])--[A-Za-z0-9_-]+\s*:", keep=("code", "bare"))
    end = F.regexp_extract(F.expr("substring(code, stop + 1)"), r"^([^;{}]*)", 1)
    ends = F.expr("substring(code, stop + 1)").rlike(r"^[^;{}]*[;}]")
    value = F.trim(F.regexp_replace(nest.between("bare", F.col("stop"), F.col("stop") + F.length(end)), r"\s+", " "))
    name = F.regexp_replace(F.regexp_replace("head", r"\s*:$", ""), "^--", "")
    rows = found.where(ends).select("path", F.concat(F.lit("--"), name).alias("raw_name"), name.alias("name"), value.alias("value"), "start").where("value <> ''")
    rows = rows.withColumn("category", scanners.token_category(F.col("name"), F.col("value"))).withColumn("references", F.regexp_extract_all("value", F.lit(r"var\(\s*(--[A-Za-z0-9_-]+)")))
    order = F.row_number().over(Window.partitionBy("name").orderBy(F.size(F.split("path", "/")), "path", "start"))
    return rows.withColumn("_k", order).where("_k = 1").select("path", "raw_name", "name", "value", "category", "references")


def flag_registry(files: DataFrame, symbol: str = "featureFlags") -> DataFrame:
    """(key, registry_default, description) of a registry object literal with boolean values."""
    body = F.regexp_extract("text", rf"(?s)\b{symbol}\b[^=]*=\s*\{{(.*?)\n\}}", 1)
    entry = F.explode(F.regexp_extract_all(body, F.lit(r"((?://[^\n]*\n\s*)?[\"']?\w+[\"']?\s*:\s*(?:true|false))"))).alias("entry")
    rows = files.where(F.contains("text", F.lit(symbol))).select("path", body.alias("b"), entry)
    return rows.select(F.regexp_extract("entry", r"[\"']?(\w+)[\"']?\s*:\s*(?:true|false)$", 1).alias("key"), (F.regexp_extract("entry", "(true|false)$", 1) == "true").alias("registry_default"), F.trim(F.regexp_extract("entry", r"^//([^\n]*)", 1)).alias("description"))


def flag_migrations(files: DataFrame, table: str = "feature_flags") -> tuple[DataFrame, DataFrame]:
    """((key, db_seeded_enabled) inserted, (key) deleted) by SQL files; reversal scripts do not count."""
    sql = files.where((F.col("language") == "sql") & ~F.col("path").rlike(r"(?i)(down|rollback|revert)[^/]*\.sql$"))
    insert = F.regexp_extract_all("text", F.lit(rf"(?is)insert\s+into\s+(?:public\.)?{table}\b([^;]*);"))
    rows = sql.select(F.explode(insert).alias("body")).select(F.explode(F.regexp_extract_all("body", F.lit(r"\(\s*('[^']+'[^)]*)\)"))).alias("row"))
    inserted = rows.select(F.regexp_extract("row", "^'([^']+)'", 1).alias("key"), F.lower(F.regexp_extract("row", r"(?i)\b(true|false)\b", 1)).alias("v")).groupBy("key").agg(F.first(F.when(F.col("v") != "", F.col("v") == "true"), ignorenulls=True).alias("db_seeded_enabled"))
    gone = sql.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?is)delete\s+from\s+(?:public\.)?{table}\b([^;]*);"))).alias("body")).select(F.explode(F.regexp_extract_all("body", F.lit("'([^']+)'"))).alias("key")).distinct()
    return inserted, gone


# Scalar types of schema files; column functions of table definitions with their type and database type.
PRISMA_TYPES = {"String": "string", "Int": "number", "Float": "number", "Decimal": "number", "BigInt": "number", "Boolean": "boolean", "DateTime": "Date", "Json": "object", "Bytes": "bytes"}
DRIZZLE_TYPES = {
    "uuid": "string", "varchar": "string", "text": "string", "char": "string", "integer": "number", "serial": "number", "bigint": "number", "smallint": "number", "boolean": "boolean",
    "timestamp": "Date", "date": "Date", "time": "string", "json": "object", "jsonb": "object", "real": "number", "doublePrecision": "number", "numeric": "number", "decimal": "number",
}


def _names(text: Column, pattern: str) -> Column:
    """Trimmed names of the comma lists that the pattern's group holds."""
    lists = F.regexp_extract_all(text, F.lit(pattern))
    return F.transform(F.flatten(F.transform(lists, lambda l: F.split(l, ","))), lambda n: F.trim(n))


def _typed(kinds: dict[str, str], name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), name)


def prisma_models(files: DataFrame) -> DataFrame:
    """(path, model, table_name, line, is_enum, field, field_type, is_list, is_optional, is_primary, is_unique, is_indexed, has_default, default_value,
    db_type, relation, references): a row per field, and per member of an enumeration. Fields may run over lines inside of brackets; comments do
    not count; ignored models and fields are left out."""
    rows = coded(files.where("language = 'prisma'"))
    found = nest.heads(rows, r"(?m)^(?:model|enum)[ \t]+\w+\s*\{", keep=("code",)).withColumn("line", nest.line_of("code", F.col("start"))).withColumn("open", F.col("stop") - 1).drop("code")
    found = nest.bodies(found, rows).withColumn("model", F.regexp_extract("head", r"^\w+\s+(\w+)", 1)).withColumn("is_enum", F.col("head").startswith("enum"))
    found = found.where(F.col("is_enum") | ~F.col("body_code").rlike(r"@@ignore\b"))
    mapped = F.regexp_extract("body_bare", r"@@map\(\s*(?:name:\s*)?\"([^\"]+)\"", 1)
    of_all = found.select(
        "path", "open", "model", "line", "is_enum", F.when(mapped != "", mapped).otherwise(F.concat(F.lower("model"), F.lit("s"))).alias("table_name"), _names(F.col("body_code"), r"@@id\(\s*\[([^\]]+)\]").alias("ids"),
        _names(F.col("body_code"), r"@@unique\(\s*\[([^\]]+)\]").alias("uniques"), _names(F.col("body_code"), r"@@index\(\s*\[([^\]]+)\]").alias("indexes"),
    )
    parts = nest.segments(found, ["path", "open"], "\n").withColumn("s", F.trim(F.regexp_replace("segment", r"\s+", " "))).where(~F.col("s").startswith("@@") & ~F.col("s").rlike(r"@ignore\b"))
    parts = parts.join(of_all, ["path", "open"])
    shape = r"^(\w+) (\w+)(\[\])?(\?)?( |$)"
    at = lambda n: F.regexp_extract("s", shape, n)
    field = parts.where(~F.col("is_enum") & F.col("s").rlike(shape))
    has = lambda w: F.col("s").rlike(rf"@{w}\b")
    listed = lambda of: F.array_contains(of, at(1))
    some = lambda c: F.when(c != "", c)
    out = field.select(
        "path", "model", "table_name", "line", "is_enum", at(1).alias("field"), at(2).alias("field_type"), (at(3) == "[]").alias("is_list"), (at(4) == "?").alias("is_optional"), (has("id") | listed("ids")).alias("is_primary"),
        (has("unique") | listed("uniques")).alias("is_unique"), listed("indexes").alias("is_indexed"), has("default").alias("has_default"), some(F.regexp_extract("s", r"@default\(([^()]*(?:\([^()]*\))?[^()]*)\)", 1)).alias("default_value"),
        some(F.lower(F.regexp_extract("s", r"@db\.(\w+(?:\([^)]*\))?)", 1))).alias("db_type"), F.regexp_extract("s", r"fields:\s*\[\s*(\w+)", 1).alias("relation"), F.regexp_extract("s", r"references:\s*\[\s*(\w+)", 1).alias("references"), "at",
    )
    member = parts.where(F.col("is_enum") & F.col("s").rlike(r"^[A-Za-z_]\w*( |$)"))
    no, none = F.lit(False), F.lit(None).cast("string")
    members = member.select("path", "model", "table_name", "line", "is_enum", F.regexp_extract("s", r"^(\w+)", 1).alias("field"), F.lit("enum_member").alias("field_type"), *(no.alias(c) for c in ("is_list", "is_optional", "is_primary", "is_unique", "is_indexed", "has_default")), none.alias("default_value"), none.alias("db_type"), F.lit("").alias("relation"), F.lit("").alias("references"), "at")
    return out.unionByName(members).drop("at")


def drizzle_tables(files: DataFrame) -> DataFrame:
    """(path, model, variable, line, field, db_name, field_type, db_type, is_primary, not_null, is_unique, is_indexed, has_default, default_value,
    references, references_field): a row per column of table definitions; a column may run over lines, and hold objects and calls.
    The model is the table's name; `references` is the referenced table's, found by its variable in the same file."""
    rows = coded(files.where(F.contains("text", F.lit("Table(")) & F.col("language").isin("typescript", "javascript")))
    found = nest.heads(rows, r"\b(?:const|let)\s+\w+\s*=\s*(?:pg|mysql|sqlite)Table\(\s*['\"]\w+['\"]", text="bare", keep=("code",))
    found = found.withColumn("line", nest.line_of("code", F.col("start"))).withColumn("open", nest.place("code", "{", F.col("stop"))).drop("code").where("open is not null")
    found = nest.bodies(found, rows).withColumn("variable", F.regexp_extract("head", r"^\w+\s+(\w+)", 1)).withColumn("model", F.regexp_extract("head", r"['\"](\w+)['\"]$", 1))
    # the block behind the columns, if there is one, holds the indexes
    after = F.expr("substring(code, close + 2)")
    tail = found.select("path", "open", "close").join(rows.select("path", "code"), "path").where(after.rlike(r"^\s*,")).withColumn("open2", nest.place("code", "{", F.col("close") + 1)).drop("code").where("open2 is not null")
    tail = nest.bodies(tail.drop("close"), rows, "open2").select("path", "open", F.regexp_extract_all("body_code", F.lit(r"\.on\(\s*\w+\.(\w+)")).alias("indexes"))
    parts = nest.segments(found, ["path", "open"]).withColumn("s", F.trim("segment")).where(F.col("s").rlike(r"\w+\s*:\s*\w+\("))
    parts = parts.join(found.select("path", "open", "variable", "model", "line"), ["path", "open"]).join(tail, ["path", "open"], "left")
    shape = r"(\w+)\s*:\s*(\w+)\("
    name, call = F.regexp_extract("s", shape, 1), F.regexp_extract("s", shape, 2)
    has = lambda w: F.col("s").rlike(rf"\.{w}\(")
    some = lambda c: F.when(c != "", c)
    db = some(F.regexp_extract("s", r":\s*\w+\(\s*['\"](\w+)['\"]", 1))
    default = F.when(has("defaultRandom"), "random()").when(has("defaultNow"), "now()").otherwise(some(F.trim(F.regexp_extract("s", r"\.default\(([^()]*(?:\([^()]*\))?[^()]*)\)", 1))))
    refers = r"\.references\(\s*\(\)(?:\s*:\s*\w+)?\s*=>\s*(\w+)\.(\w+)"
    columns = parts.select(
        "path", "model", "variable", "line", name.alias("field"), F.coalesce(db, name).alias("db_name"), F.coalesce(_typed(DRIZZLE_TYPES, call), F.lit("unknown")).alias("field_type"), F.when(call == "doublePrecision", "double precision").otherwise(call).alias("db_type"),
        has("primaryKey").alias("is_primary"), has("notNull").alias("not_null"), has("unique").alias("is_unique"), F.coalesce(F.array_contains("indexes", name), F.lit(False)).alias("is_indexed"), F.col("s").rlike(r"\.default\w*\(").alias("has_default"),
        default.alias("default_value"), F.regexp_extract("s", refers, 1).alias("of"), F.regexp_extract("s", refers, 2).alias("references_field"),
    )
    tables = found.select("path", F.col("variable").alias("of"), F.col("model").alias("target")).groupBy("path", "of").agg(F.max("target").alias("target"))
    return columns.join(tables, ["path", "of"], "left").withColumn("references", F.coalesce("target", "of")).drop("of", "target")


# Words that stand where a table's name could.
SQL_WORDS = "select where set values on as only lateral unnest if then else end loop return into using from join table exists not null when and or limit order group having union all with new old excluded".split()


def sql_functions(files: DataFrame) -> DataFrame:
    """(path, name, line, table, access): tables that stored functions of the public schema touch; write beats read. A function is a definition
    outside of comments and strings, its body the first dollar-quoted text before the next definition. Comments and
    strings of the body do not count; tables of other schemas, common table expressions, parameters, declared and loop variables are none."""
    rows = coded(files.where("language = 'sql'"))
    found = nest.heads(rows, r"(?i)\bcreate\s+(?:or\s+replace\s+)?function\s+[\w.\"]+\s*\(", keep=("text",))
    after = F.lead("start").over(Window.partitionBy("path").orderBy("start"))
    full = F.regexp_replace(F.regexp_extract("head", r"(?i)function\s+([\w.\"]+)", 1), '"', "")
    found = found.withColumn("until", F.coalesce(after, F.length("text"))).withColumn("full", full).withColumn("line", nest.line_of("text", F.col("start")))
    body = F.regexp_extract(nest.between("text", F.col("stop"), F.col("until")), r"(?s)\$(\w*)\$(.*?)\$\1\$", 2)
    found = found.where(~F.contains("full", F.lit(".")) | F.lower("full").startswith("public.")).select("path", "start", "line", (F.col("stop") - 1).alias("open"), F.element_at(F.split("full", r"\."), -1).alias("name"), body.alias("text"))
    signature = nest.segments(nest.bodies(found.select("path", "open"), rows, kinds="()"), ["path", "open"])
    parameter = F.lower(F.regexp_extract(F.trim("segment"), r"^(?i:(?:in|out|inout|variadic)\s+)?\"?(\w+)", 1))
    parameters = signature.groupBy("path", "open").agg(F.collect_set(parameter).alias("parameters"))
    inner = with_code(found.withColumn("language", F.lit("sql"))).withColumn("c", F.lower("code")).join(parameters, ["path", "open"], "left")
    declared = F.flatten(F.transform(F.regexp_extract_all("c", F.lit(r"(?s)\bdeclare\b(.*?)\bbegin\b")), lambda d: F.transform(F.split(d, ";"), lambda v: F.regexp_extract(v, r"^\s*\"?(\w+)", 1))))
    loops, ctes = F.regexp_extract_all("c", F.lit(r"\b(?:for|foreach)\s+(\w+)\s+in\b")), F.regexp_extract_all("c", F.lit(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)\"?(\w+)\"?\s*(?:\([^()]*\)\s*)?as\s+(?:not\s+)?(?:materialized\s+)?\("))
    local = F.array_union(F.array_union(F.coalesce("parameters", F.array().cast("array<string>")), declared), F.array_union(loops, ctes))
    inner = inner.select("path", "start", "line", "name", "c", F.array_union(local, F.array(*map(F.lit, SQL_WORDS))).alias("local"))
    table = r"(?:only\s+)?((?:\"?\w+\"?\s*\.\s*)?\"?\w+\"?)(?!\s*\(|\w|\s*\.)"

    def touched(pattern: str, access: str) -> DataFrame:
        refs = inner.select("path", "start", "line", "name", "local", F.explode(F.regexp_extract_all("c", F.lit(pattern))).alias("table"))
        refs = refs.withColumn("table", F.regexp_replace("table", r"[\"\s]", "")).where(~F.contains("table", F.lit(".")) | F.col("table").startswith("public."))
        return refs.withColumn("table", F.regexp_replace("table", r"^public\.", "")).where(~F.array_contains("local", F.col("table"))).select("path", "start", "line", "name", "table", F.lit(access).alias("access"))

    writes = touched(rf"\binsert\s+into\s+((?:\"?\w+\"?\s*\.\s*)?\"?\w+\"?)", "write").unionByName(touched(rf"(?<!\bfor )(?<!\bdo )(?<!\bon )(?<!\bor )(?<!\bbefore )(?<!\bafter )\bupdate\s+{table}", "write")).unionByName(touched(rf"\bdelete\s+from\s+{table}", "write"))
    reads = touched(rf"(?<!\bdelete )(?<!\bdistinct )\b(?:from|join)\s+{table}", "read")
    return writes.unionByName(reads).groupBy("path", "name", "table").agg(F.max("access").alias("access"), F.min("line").alias("line"))


def path_aliases(files: DataFrame) -> DataFrame:
    """(folder, pattern, target, place) of the import aliases that configuration files set: targets are paths from the repository's
    root, `folder` is the file's own. Comments and commas before a closing bracket are taken out first, but not
    inside of strings; a file that is no object after that sets none."""
    rows = coded(files.where(F.col("path").rlike(ALIAS_FILE)).withColumn("language", F.lit("jsonc")))
    pieces = F.split("code", r"(?=,\s*[}\]])")
    ends = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    # the places of these commas: sums of the lengths before them
    places = F.aggregate(ends, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    clean = F.aggregate(F.slice(places, F.lit(2), F.size(places)), F.col("bare"), lambda text, at: F.overlay(text, F.lit(" "), at + 1, F.lit(1)))
    parsed = rows.select("path", F.from_json(clean, "compilerOptions struct<baseUrl string, paths map<string,array<string>>>").alias("j"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    found = parsed.select(folder.alias("folder"), "path", F.coalesce("j.compilerOptions.baseUrl", F.lit(".")).alias("base"), F.posexplode(F.map_entries("j.compilerOptions.paths")).alias("n", "e"))
    found = found.select("folder", "path", "base", "n", F.col("e.key").alias("pattern"), F.posexplode("e.value").alias("k", "to"))
    target = normalise(F.split(F.concat_ws("/", "folder", "base", "to"), r"[/\\]"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path", "n", "k")).cast("int")
    return found.where("to is not null").select("folder", "pattern", target.alias("target"), place.alias("place"))


def web_imports(files: DataFrame) -> DataFrame:
    """(path, line, module_path, names): imports, re-exports, require and import() of web files, read outside of comments and strings;
    names are pairs "name alias", * for the whole module."""
    rows = coded(files.where(F.col("language").isin("typescript", "javascript", "vue", "svelte", "astro")))
    quoted = r"['\"][^'\"\n]+['\"]"
    form = rf"\b(?:import|export)\b\s*(?:type\s+)?(?:[\w$*{{}},\s]*?\bfrom\s*)?{quoted}|\b(?:require|import)\(\s*{quoted}\s*\)"
    found = nest.heads(rows, form, text="bare", keep=("code", "bare")).withColumn("line", nest.line_of("code", F.col("start")))
    found = found.where(~F.trim(nest.between("code", F.greatest(F.lit(0), F.col("start") - 1), F.col("start"))).isin(".", "$"))
    module = F.regexp_extract("head", rf"({quoted})\s*\)?$", 1)
    clause = F.regexp_extract("head", r"^(?:import|export)\b\s*(?:type\s+)?([^'\"]*?)\s*\bfrom\b", 1)
    listed = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda n: F.trim(n)), lambda n: n != "")
    listed = F.transform(listed, lambda n: F.regexp_replace(n, r"^type\s+", ""))
    named = F.transform(listed, lambda n: F.concat(F.regexp_extract(n, r"^([\w$]+)", 1), F.lit(" "), F.regexp_extract(n, r"([\w$]+)$", 1)))
    star = F.when(F.regexp_extract(clause, r"\*\s*(?:as\s+([\w$]+))?", 0) != "", F.array(F.concat(F.lit("* "), F.coalesce(F.nullif(F.regexp_extract(clause, r"\*\s*as\s+([\w$]+)", 1), F.lit("")), F.lit("*"))))).otherwise(F.array().cast("array<string>"))
    first = F.regexp_extract(clause, r"^\s*([\w$]+)", 1)
    default = F.when(first != "", F.array(F.concat(first, F.lit(" "), first))).otherwise(F.array().cast("array<string>"))
    before = F.regexp_extract(nest.between("code", F.greatest(F.lit(0), F.col("start") - 80), F.col("start")), r"(?:const|let|var)\s+([\w$]+)\s*=\s*(?:await\s+)?$", 1)
    whole = F.when(before != "", F.array(F.concat(F.lit("* "), before))).otherwise(F.array().cast("array<string>"))
    return found.select("path", "line", F.substring(module, 2, 1_000_000).alias("m"), F.concat(default, star, named, whole).alias("names")).select("path", "line", F.expr("substring(m, 1, length(m) - 1)").alias("module_path"), "names")


#: Words before a bracket that call nothing.
WEB_WORDS = "if for while switch catch function return typeof await new in of do else case delete void yield super import require async throw instanceof".split()


def web_functions(files: DataFrame) -> DataFrame:
    """(path, name, line, end_line, calls, renders, classes, is_exported, is_component, hardcoded_colors, off_scale_values, inline_style_count) of the functions
    that stand outside of any block of a web file: declarations, and constants that are arrow functions. `calls` are chains before a
    bracket, `renders` the components its markup names, `classes` its literal class names; colours and values that bypass
    the design tokens are those written out in class names."""
    rows = coded(files.where(F.col("language").isin("typescript", "javascript")))
    declared = r"\bfunction\s*\*?\s+[\w$]+\s*(?:<[^<>()]*>)?\s*\("
    arrow = r"\b(?:const|let|var)\s+[\w$]+\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:<[^<>()]*>\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::\s*[^=;{}\n]+)?=>\s*[\{\(]"
    nested = nest.blocks(rows, "path", "{}()")
    first = nest.heads(rows, f"{declared}|{arrow}", keep=("code",)).withColumn("at", F.col("stop") - 1)
    first = first.withColumn("declared", F.col("head").startswith("function"))
    # behind the parameters of a declaration its body begins
    ends = first.where("declared").join(nested.select("path", F.col("open").alias("at"), "close"), ["path", "at"]).withColumn("open", nest.place("code", "{", F.col("close")))
    found = first.where("not declared").select("path", "start", "head", F.col("at").alias("open")).unionByName(ends.where("open is not null").select("path", "start", "head", "open"))
    found = found.join(nested, ["path", "open"]).where("depth = 0 and close is not null").drop("depth").join(rows.select("path", "code", "bare"), "path")
    inside, shown = nest.between("code", F.col("open") + 1, F.col("close")), nest.between("bare", F.col("open"), F.col("close") + 1)
    before = nest.between("code", F.greatest(F.lit(0), F.col("start") - 24), F.col("start"))
    name = F.regexp_extract("head", r"^(?:function\s*\*?|const|let|var)\s+([\w$]+)", 1)
    found = found.select("path", name.alias("name"), nest.line_of("code", F.col("start")).alias("line"), nest.line_of("code", F.col("close")).alias("end_line"), inside.alias("c"), shown.alias("b"), before.rlike(r"\bexport\s+(?:default\s+)?(?:async\s+)?$").alias("is_exported"))
    calls = F.filter(F.regexp_extract_all("c", F.lit(r"([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\s*\(")), lambda n: ~n.isin(WEB_WORDS))
    calls = F.array_distinct(F.transform(calls, lambda n: F.regexp_replace(F.regexp_replace(n, r"\?\.", "."), r"^this\.", "")))
    classes = F.flatten(F.transform(F.regexp_extract_all("b", F.lit(r"class(?:Name)?=[\"']([^\"']+)[\"']")), lambda v: F.split(F.trim(v), r"\s+")))
    colors, values = scanners.style_drift(F.col("b"))
    markup = F.col("c").rlike(r"<[A-Za-z][\w.]*[\s/>]|<>")
    return found.select(
        "path", "name", "line", "end_line", "is_exported", calls.alias("calls"), F.array_distinct(F.regexp_extract_all("c", F.lit(r"<([A-Z][\w.]*)[\s/>]"))).alias("renders"), F.array_distinct(classes).alias("classes"),
        (F.col("name").rlike("^[A-Z]") & markup).alias("is_component"), colors.alias("hardcoded_colors"), values.alias("off_scale_values"), F.regexp_count("c", F.lit(r"\bstyle=\{\{")).cast("int").alias("inline_style_count"),
    )


def source_slices(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (file_path, start_line, end_line and more) with `source`: these lines of the file, both included; null where the file is not there
    or no such line is."""
    lines = F.split("text", "\n")
    some = F.col("start_line").between(1, F.size(lines)) & (F.col("end_line") >= F.col("start_line"))
    source = F.when(some, F.array_join(F.slice(lines, F.col("start_line"), F.least("end_line", F.size(lines)) - F.col("start_line") + 1), "\n"))
    return spans.join(files.select(F.col("path").alias("_path"), "text"), F.col("file_path") == F.col("_path"), "left").select(*spans.columns, source.alias("source"))


def web_routes(files: DataFrame, guards: list[str]) -> tuple[DataFrame, DataFrame]:
    """((path, line, method, route, handler, middleware) of calls that register a route, (pattern, file_path) of `use` calls whose
    functions name one of the guards). A route's functions are names: the last is its handler, those before it its middleware."""
    rows = coded(files.where(F.col("language").isin("typescript", "javascript")))
    form = r"\b[\w$]+\.(?:get|post|put|delete|patch|all|options|head|use)\(\s*['\"`][/*][^'\"`\n]*['\"`]"
    found = nest.heads(rows, form, text="bare", keep=("code",)).withColumn("line", nest.line_of("code", F.col("start")))
    found = found.withColumn("open", nest.place("code", "(", F.col("start"))).drop("code").withColumn("verb", F.regexp_extract("head", r"\.(\w+)\(", 1)).withColumn("route", F.regexp_extract("head", r"['\"`]([^'\"`]*)['\"`]$", 1))
    found = nest.bodies(found, rows, kinds="()")
    given = nest.segments(found, ["path", "open"]).where("n > 1").select("path", "open", "n", F.trim(F.regexp_replace("segment", r"\s+", " ")).alias("s"))
    given = given.select("path", "open", "n", F.regexp_extract("s", r"^([A-Za-z_$][\w$.]*)(?: ?\(.*)?$", 1).alias("name"))
    names = given.groupBy("path", "open").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda g: g["name"]).alias("names"))
    calls = materialize(found.select("path", "open", "line", "verb", "route").join(names, ["path", "open"]))
    real = lambda of: F.filter(of, lambda n: n != "")
    routes = calls.where("verb <> 'use'").select("path", "line", F.upper("verb").alias("method"), "route", F.nullif(F.element_at("names", -1), F.lit("")).alias("handler"), real(F.slice("names", F.lit(1), F.size("names") - 1)).alias("middleware"))
    guard = F.exists("names", lambda n: F.lower(n).rlike("|".join(guards)))
    return routes, calls.where((F.col("verb") == "use") & guard).select(F.col("route").alias("pattern"), F.col("path").alias("file_path")).distinct()


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(path, name, version) of package.json, requirements files and pyproject dependency lists."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    parsed = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.from_json("text", schema).alias("j"))
    every = F.map_concat(*(F.coalesce(F.col(f"j.{k}"), F.create_map().cast("map<string,string>")) for k in ("peerDependencies",)), F.create_map().cast("map<string,string>"))
    npm = parsed.select("path", F.explode(F.array(F.col("j.dependencies"), F.col("j.devDependencies"), every)).alias("m")).where("m is not null").select("path", F.explode("m").alias("name", "version"))
    lines = scanners.lines(files.where(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")), "path", "text").select("path", F.col("body").alias("spec"))
    quoted = files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$")).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)dependencies\s*=\s*\[(.*?)\]"))).alias("list")).select("path", F.explode(F.regexp_extract_all("list", F.lit("[\"']([^\"']+)[\"']"))).alias("spec"))
    specs = lines.unionByName(quoted).where(F.col("spec").rlike(r"^[A-Za-z0-9]"))
    pypi = specs.select("path", F.regexp_replace(F.lower(F.regexp_extract("spec", r"^([A-Za-z0-9_.-]+)", 1)), "-", "_").alias("name"), F.trim(F.regexp_extract("spec", r"^[A-Za-z0-9_.-]+(?:\[[^\]]*\])?\s*([^;#]*)", 1)).alias("version"))
    return npm.unionByName(pypi)


def env_template(files: DataFrame) -> DataFrame:
    """(name, default_value, required) of environment templates; a name without a value is required."""
    rows = scanners.lines(files.where("config_type = 'env_template'"), "path", "text").where(F.col("body").rlike(r"^\s*(export\s+)?[A-Z_][A-Z0-9_]*\s*="))
    value = F.trim(F.regexp_replace("body", r"^[^=]*=", ""))
    return rows.select(F.regexp_extract("body", r"([A-Z_][A-Z0-9_]*)\s*=", 1).alias("name"), value.alias("default_value"), (value == "").alias("required"))
