"""Edges between code and what it uses: packages, routes' guards, data models, stored functions, tokens, types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, scanners
from ..storage import materialize
from .cascade import first_of, unique_names
from .traverse import closure

# Types that no class edge is made for.
PRIMITIVES = "str int float bool bytes None Any object string number boolean void any unknown never null undefined dict list tuple set".split()


def enrich_dependencies(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """dependencies (name, version, ...) with latest_version, is_outdated, vulnerabilities and their number from
    advisories (name, latest_version, vulnerabilities); versions by the exact name, then the normalised one."""
    known = advisories.select(F.col("name").alias("_n"), "latest_version", "vulnerabilities")
    plain = known.select(F.regexp_replace(F.lower("_n"), "-", "_").alias("_n"), F.col("latest_version").alias("_l"), F.col("vulnerabilities").alias("_v")).dropDuplicates(["_n"])
    rows = dependencies.join(known.dropDuplicates(["_n"]), F.col("name") == F.col("_n"), "left").drop("_n")
    rows = rows.join(plain, F.regexp_replace(F.lower("name"), "-", "_") == F.col("_n"), "left")
    latest, found = F.coalesce("latest_version", "_l"), F.array_distinct(F.coalesce("vulnerabilities", "_v", F.array().cast("array<string>")))
    return rows.select(*dependencies.columns, latest.alias("latest_version"), found.alias("vulnerabilities")).withColumn("vulnerability_count", F.size("vulnerabilities")).withColumn("is_outdated", scalars.is_outdated(F.col("version"), F.col("latest_version")))


def route_auth(routes: DataFrame, patterns: DataFrame) -> DataFrame:
    """routes (id, path, file_path, middleware, decorators) with has_auth: a guard among its own words, or an app-level
    pattern (pattern, file_path) that covers its path; a lone * covers only its own file. Patterns are looked up by the
    route's leading path, so there is no comparison of every route with every pattern."""
    words = F.array(*map(F.lit, scalars.AUTH_WORDS))
    own = F.concat(F.coalesce("middleware", F.array().cast("array<string>")), F.coalesce("decorators", F.array().cast("array<string>")))
    named = F.exists(own, lambda o: F.exists(words, lambda w: F.contains(F.lower(o), w)))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/*")))
    keys = routes.select("id", F.col("file_path").alias("_f"), F.explode(F.array_union(prefixes, F.array(F.col("path"), F.lit("/*"), F.lit("*")))).alias("pattern"))
    met = keys.join(patterns.select("pattern", F.col("file_path").alias("_p")), "pattern").where((F.col("pattern") != "*") | (F.col("_f") == F.col("_p"))).select("id").distinct().withColumn("covered", F.lit(True))
    return routes.join(met, "id", "left").select(*(c for c in routes.columns if c != "has_auth"), (named | F.coalesce("covered", F.lit(False))).alias("has_auth"))


def _model_keys(models: DataFrame) -> DataFrame:
    return models.where("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("model"))


def field_models(fields: DataFrame, models: DataFrame) -> DataFrame:
    """(src, field, model) of annotated fields (src, field, type): the type's words name exactly one model."""
    words = fields.select("src", "field", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("type"), F.lit("([a-z0-9_]+)")))).alias("key"))
    met = words.join(_model_keys(models), "key").groupBy("src", "field").agg(F.min("model").alias("model"), F.count_distinct("model").alias("n"))
    return met.where("n = 1").select("src", "field", "model")


def model_edges(calls: DataFrame, models: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """USES_MODEL (src, dst, access) from calls (src, call), written as chains (db.user.create), with arguments (db.insert(user)), or as
    verb.from('table'). A quoted table is the model of that table or nothing. Else the first segment that names a model, those of
    the chain before those of the arguments, is the model, and the chain's own segments must hold a word that reads or
    writes. A call of a field whose type names a model (field_models of `fields`) goes to that model by the words of the
    method's name. Write outranks read."""
    quoted = r"^(select|insert|update|upsert|delete)\.from\('([^']+)'\)$"
    tables = models.where("table_name is not null").groupBy(F.lower("table_name").alias("key")).agg(F.min("id").alias("dst"))
    direct = calls.where(F.col("call").rlike(quoted)).select("src", F.lower(F.regexp_extract("call", quoted, 2)).alias("key"), F.when(F.col("call").startswith("select"), "read").otherwise("write").alias("access")).join(tables, "key").select("src", "dst", "access")
    chains = calls.where(~F.col("call").rlike(quoted)).select("src", "call").distinct()
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"))
    head = words(F.split_part("call", F.lit("("), F.lit(1)))
    has = lambda known: F.arrays_overlap("head", F.array(*map(F.lit, known)))
    access = F.when(has(scalars.WRITE_WORDS), "write").when(has(scalars.READ_WORDS), "read")
    verbs = chains.withColumn("head", head).withColumn("access", access).where("access is not null")
    segments = verbs.select("src", "call", "access", F.posexplode(F.concat("head", words(F.regexp_extract("call", r"\((.*)$", 1)))).alias("at", "key"))
    first = segments.join(_model_keys(models), "key").groupBy("src", "call", "access").agg(F.min_by("model", "at").alias("dst")).select("src", "dst", "access")
    found = direct.unionByName(first)
    if fields is not None:
        parts = F.split("call", r"\.")
        by_field = chains.where(F.size(parts) > 1).select("src", F.element_at(parts, -2).alias("field"), scalars.method_access(F.element_at(parts, -1)).alias("access")).where("access is not null")
        found = found.unionByName(by_field.join(field_models(fields, models).withColumnRenamed("model", "dst"), ["src", "field"]).select("src", "dst", "access"))
    return found.groupBy("src", "dst").agg(F.max("access").alias("access"))  # write sorts after read


def named_targets(refs: DataFrame, entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, name, target) for names (src, file_path, name) that a file mentions and another may define: of the file's own
    entities (id, name, class_name, file_path), what the file imports by the name, or the only one of the repository."""
    plain = entities.where("class_name is null").select(F.col("id").alias("target"), "name", "file_path")
    last = refs.withColumn("full", F.col("name")).withColumn("name", F.element_at(F.split("name", r"\."), -1))
    key = ["src", "full", "target"]
    same = last.join(plain, ["file_path", "name"]).select(*key, F.lit(1).alias("priority"))
    known = last.join(imports.select("file_path", "name", "target"), ["file_path", "name"]).select(*key, F.lit(2).alias("priority"))
    alone = last.join(unique_names(plain, target="target"), "name").select(*key, F.lit(3).alias("priority"))
    return first_of([same, known, alone], ["src", "full"]).select("src", F.col("full").alias("name"), "target")


# Folders that documents leave out or put before a path.
DOC_PREFIXES = ["src/", "lib/", "app/", "packages/"]


def document_references(refs: DataFrame, entities: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, reference, dst) for references (src, reference, kind) of documents. Every name and path is a key of an index, as it is and
    in small letters; keys that several things share resolve to none. A file reference is tried as it is, without its
    extension, with and without the usual first folders, and in small letters; an entity as a name, by its last segment, as a qualified name, and
    in small letters; the first that is known counts."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    name = entities.select(F.explode(F.array_distinct(F.array("name", "qualified_name", F.element_at(F.split("qualified_name", "::"), -1)))).alias("key"), F.col("id").alias("dst"))
    file = paths.select(F.explode(F.array_distinct(F.array("path", stem(F.col("path")), F.element_at(F.split("path", "/"), -1)))).alias("key"), F.concat(F.lit("file::"), "path").alias("dst"))
    index = name.unionByName(file).where("key is not null").distinct()
    lower = index.select(F.concat(F.lit("\u0001"), F.lower("key")).alias("key"), "dst").distinct()
    index = index.unionByName(lower).groupBy("key").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").drop("n")
    small = lambda c: F.concat(F.lit("\u0001"), F.lower(c))
    clean = F.split_part(F.regexp_replace(F.regexp_replace("reference", r"^[./]+", ""), r"\\", "/"), F.lit("#"), F.lit(1))
    turned = [x for p in DOC_PREFIXES for bare in (F.expr(f"substring(clean, {len(p) + 1})"),) for x in (F.when(F.col("clean").startswith(p), F.array(bare, stem(bare))).otherwise(F.array(F.concat(F.lit(p), F.col("clean")))),)]
    as_file = F.concat(F.array("clean", stem(F.col("clean"))), *turned, F.array(small(F.col("clean"))))
    segment = F.element_at(F.split("reference", r"\."), -1)
    as_name = F.array(F.col("reference"), segment, small(F.col("reference")), small(segment))
    tried = refs.withColumn("clean", clean).select("src", "reference", F.posexplode(F.when(F.col("kind") == "file", as_file).otherwise(as_name)).alias("priority", "key"))
    met = tried.join(index, "key")
    return met.groupBy("src", "reference").agg(F.min_by("dst", "priority").alias("dst"))


def stored_function_edges(bodies: DataFrame, functions: DataFrame, models: DataFrame) -> DataFrame:
    """USES_MODEL (src, dst, access) of stored functions: bodies (path, name, table, access), functions (id, name,
    file_path). Of functions of one name the one of the last path that touches tables counts."""
    last = bodies.groupBy("name").agg(F.max("path").alias("path"))
    rows = bodies.join(last, ["name", "path"]).join(functions.select(F.col("id").alias("src"), "name", F.col("file_path").alias("path")), ["name", "path"])
    return rows.join(models.select(F.col("id").alias("dst"), F.col("table_name").alias("table")), "table").groupBy("src", "dst").agg(F.max("access").alias("access"))


def rpc_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """CALLS_RPC (src, dst): calls of the form rpc:name with a stored function of that name, the last by path."""
    named = functions.groupBy(F.col("name").alias("rpc")).agg(F.max_by("id", "file_path").alias("dst"))
    return calls.where(F.col("call").startswith("rpc:")).select("src", F.substring("call", 5, 10_000).alias("rpc")).join(named, "rpc").select("src", "dst").distinct()


def token_usage(classes: DataFrame, tokens: DataFrame) -> DataFrame:
    """USES_TOKEN (src, dst) from utility classes (src, name): the nearest token a class may draw from."""
    tried = classes.select("src", "name", F.posexplode(scanners.utility_tokens(F.col("name"))).alias("priority", "token"))
    met = tried.join(tokens.select(F.col("name").alias("token"), F.col("id").alias("target")), "token")
    return first_of([met], ["src", "name"]).select("src", F.col("target").alias("dst")).distinct()


def orm_classes(classes: DataFrame, roots: list[str]) -> DataFrame:
    """Names of classes (name, bases) that derive from one of the roots, over any number of steps."""
    pairs = materialize(classes.select("name", F.explode("bases").alias("base")).withColumn("base", F.element_at(F.split("base", r"\."), -1)).distinct())
    own = pairs.where(F.col("base").isin(roots)).select(F.col("name").alias("node"))
    return closure(pairs.select(F.col("base").alias("src"), F.col("name").alias("dst")), own).withColumnRenamed("node", "name")


def type_edges(annotations: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, type, param_name) from annotations (src, file_path, param_name, annotation; RETURNS if param_name is
    null): the unwrapped class by qualified name, in the same file, imported, or unique by name."""
    rows = annotations.withColumn("t", scalars.unwrap_type(F.col("annotation"))).where(~F.col("t").isin(PRIMITIVES) & F.col("t").rlike(r"^[A-Za-z_][\w.]*$"))
    rows = rows.withColumn("last", F.element_at(F.split("t", r"\."), -1))
    take = lambda df, priority: df.select("src", "param_name", "annotation", F.col("target"), F.lit(priority).alias("priority"))
    c = classes.select(F.col("id").alias("target"), F.col("name").alias("c_name"), F.col("qualified_name").alias("c_qn"), F.col("file_path").alias("c_file"))
    known = imports.select(F.col("file_path").alias("i_file"), F.col("name").alias("i_name"), "target").join(classes.select(F.col("id").alias("target")), "target", "left_semi")
    found = first_of(
        [
            take(rows.join(c, F.col("t") == F.col("c_qn")), 1), take(rows.join(c, (F.col("last") == F.col("c_name")) & (F.col("file_path") == F.col("c_file"))), 2),
            take(rows.join(known, (F.col("file_path") == F.col("i_file")) & (F.col("last") == F.col("i_name"))), 3), take(rows.join(unique_names(classes).withColumnRenamed("name", "u"), F.col("last") == F.col("u")), 4),
        ],
        ["src", "param_name", "annotation"],
    )
    return found.select("src", F.col("target").alias("dst"), F.when(F.col("param_name").isNull(), "RETURNS").otherwise("ACCEPTS").alias("type"), "param_name").distinct()


def import_coverage(tests: DataFrame, imports: DataFrame, functions: DataFrame, covered: DataFrame) -> DataFrame:
    """TESTS_FUNCTION of depth 3: test functions (id, file_path) without a nearer edge in covered (src) to the exported
    functions (id, file_path, is_exported) of the files their file imports (file_path, target), all if none is exported."""
    idle = tests.join(covered.select(F.col("src").alias("id")), "id", "left_anti")
    has = functions.groupBy("file_path").agg(F.max(F.coalesce("is_exported", F.lit(False))).alias("some"))
    open_ = functions.join(has, "file_path").where("coalesce(is_exported, false) or not some").select(F.col("id").alias("dst"), F.col("file_path").alias("target"))
    return idle.select(F.col("id").alias("src"), "file_path").join(imports.select("file_path", "target").distinct(), "file_path").join(open_, "target").select("src", "dst", F.lit(3).alias("depth")).distinct()


def external_usage(calls: DataFrame, resolved: DataFrame, imports: DataFrame) -> DataFrame:
    """USES_DEPENDENCY (src, dst): calls (src, file_path, call) that resolved to nothing (src, call) and whose first or
    last segment is a name that the file imports from a package (file_path, name, package)."""
    rest = calls.join(resolved.select("src", "call"), ["src", "call"], "left_anti")
    ends = rest.select("src", "call", "file_path", F.explode(F.array_distinct(F.array(F.split_part("call", F.lit("."), F.lit(1)), F.element_at(F.split("call", r"\."), -1)))).alias("name"))
    return ends.join(imports.select("file_path", "name", "package"), ["file_path", "name"]).select("src", F.concat(F.lit("dep::"), F.col("package")).alias("dst")).distinct()
