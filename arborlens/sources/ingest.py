"""A repository folder as a code graph: scan, rows, and edges resolved by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, scanners
from ..graph import CodeGraph
from ..operators import links
from ..operators.cascade import coverage_edges, import_targets, keep_best_edges, merge_flags, reexport_closure, resolve_refs
from ..schema import EDGES, NODES, conform
from ..storage import materialize
from . import files as src
from .python_code import python_rows


#: Decorators that make a function a route's handler, and calls that ask for a flag by its key.
ROUTE = r"^[\w.]+\.(get|post|put|delete|patch|route)\(\s*[rf]?[\"']([^\"']*)[\"']"
TABLE_CALL = r"\b(?:table|from_?)\(\s*[\"'](\w+)[\"']\s*\)\s*\.(select|insert|update|upsert|delete)\("
FLAG_CALL = r"(?:is_enabled|isEnabled|feature_enabled|isFeatureEnabled|useFeatureFlag|has_feature|flag_enabled)\(\s*[\"'](\w+)[\"']"


def inside(found: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, value) of rows (path, line, value) by the function of the file that holds the line. Functions of a file do not
    overlap, so the last start is carried on to the lines behind it; no line is compared with every function."""
    starts = functions.select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.struct("id", "end_line").alias("f"), F.lit(None).cast("string").alias("value"))
    rows = starts.unionByName(found.select("path", "line", F.lit(None).cast(starts.schema["f"].dataType).alias("f"), "value"))
    # at one line the start comes first
    last = F.last("f", ignorenulls=True).over(Window.partitionBy("path").orderBy("line", F.col("f").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("f", last).where("value is not null and line <= f.end_line").select("f.id", "value").distinct()


def data_models(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, fields, relations (model, target, kind)) of schema files and table definitions. A field whose type is no scalar
    is a relation; a reference by a unique field is one to one."""
    prisma = materialize(src.prisma_models(files))
    scalar = F.col("field_type").isin(*src.PRISMA_TYPES, "enum_member")
    enums = prisma.where("is_enum").select(F.col("model").alias("field_type")).distinct()
    columns = prisma.where(scalar).unionByName(prisma.where(~scalar).join(enums, "field_type", "left_semi").select(*prisma.columns))
    keys = prisma.where("relation <> ''").select("path", "model", F.col("relation").alias("field")).distinct().withColumn("is_foreign_key", F.lit(True))
    typed = F.coalesce(src._typed(src.PRISMA_TYPES, F.col("field_type")), F.col("field_type"))
    own = columns.join(keys, ["path", "model", "field"], "left").select("path", "model", "table_name", F.lit("prisma").alias("orm"), "is_enum", "line", "field", typed.alias("field_type"), "db_type", "is_primary", "is_unique", "is_indexed", F.coalesce("is_foreign_key", F.lit(False)).alias("is_foreign_key"), "has_default", "default_value", F.col("is_optional").alias("is_nullable"))
    tables = materialize(src.drizzle_tables(files))
    own = own.unionByName(tables.select("path", "model", F.col("model").alias("table_name"), F.lit("drizzle").alias("orm"), F.lit(False).alias("is_enum"), "line", F.col("db_name").alias("field"), "field_type", "db_type", "is_primary", "is_unique", "is_indexed", (F.col("references") != "").alias("is_foreign_key"), "has_default", "default_value", (~F.col("not_null")).alias("is_nullable")))
    unique = prisma.where("is_unique").select("path", "model", F.col("field").alias("relation")).distinct().withColumn("one", F.lit(True))
    related = prisma.where(~scalar).join(enums, "field_type", "left_anti").join(unique, ["path", "model", "relation"], "left")
    kind = F.when(F.col("is_list"), "one_to_many").when(F.col("one"), "one_to_one").otherwise("many_to_one")
    related = related.select("model", F.col("field_type").alias("target"), kind.alias("kind"))
    related = related.unionByName(tables.where("`references` <> ''").select("model", F.col("references").alias("target"), F.lit("many_to_one").alias("kind")))
    models = own.groupBy("model").agg(F.min("path").alias("file_path"), F.first("table_name").alias("table_name"), F.first("orm").alias("orm"), F.max("is_enum").alias("is_enum"), F.count_distinct("field").cast("int").alias("field_count"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_primary"), F.col("field")))), ",").alias("primary_key"))
    models = models.select(F.concat(F.lit("model::"), "model").alias("id"), F.lit("Model").alias("label"), F.col("model").alias("name"), "table_name", "orm", "is_enum", "field_count", F.when(F.col("primary_key") != "", F.col("primary_key")).alias("primary_key"), "file_path")
    return models, own.dropDuplicates(["model", "field"]), related.distinct()


def build(spark: SparkSession, root: str, repo_id: str, ignore: list[str] | None = None, advisories: DataFrame | None = None) -> CodeGraph:
    return from_files(materialize(src.scan(spark, root, ignore)), repo_id, advisories)


def from_files(files: DataFrame, repo_id: str, advisories: DataFrame | None = None) -> CodeGraph:
    """The graph of (path, language, config_type, text) rows; advisories (name, latest_version, vulnerabilities) enrich the packages
    in use."""
    files = materialize(src.coded(files))
    rows = materialize(python_rows(files))
    at = lambda *parts: F.concat(*(F.lit(p) if p.endswith("::") or p == "." else F.col(p) for p in parts))
    file_nodes = src.file_nodes(files)
    qualified = F.concat_ws("::", "path", F.concat_ws(".", "class_name", "name"))
    is_test = F.col("path").rlike(src.TEST_FILE) & F.col("name").startswith("test")
    fixture = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: F.contains(d, F.lit("fixture")))
    private = F.col("name").startswith("_")
    functions = rows.where("kind = 'function'").select(
        F.concat(F.lit("func::"), qualified).alias("id"), F.lit("Function").alias("label"), "name", qualified.alias("qualified_name"), F.col("path").alias("file_path"), "class_name", F.col("line").alias("start_line"), "end_line",
        "signature", "docstring", "complexity", "decorators", F.col("returns").alias("return_type"), "calls", F.col("params").alias("parameters"), "annotations", (~private & F.col("class_name").isNull()).alias("is_exported"), is_test.alias("is_test"), fixture.alias("is_fixture"),
        (F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.rlike(ROUTE)) | (F.col("name") == "main")).alias("is_entry_point"), F.when(private, "private").otherwise("public").alias("visibility"), F.exists("calls", lambda c: F.lower(c).rlike("auth|permission|jwt")).alias("calls_auth"),
    )
    web = materialize(src.web_functions(files))
    web_name = F.concat_ws("::", "path", "name")
    functions = functions.unionByName(
        web.select(
            F.concat(F.lit("func::"), web_name).alias("id"), F.lit("Function").alias("label"), "name", web_name.alias("qualified_name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), "end_line", "calls",
            "is_exported", F.lit(False).alias("is_test"), F.lit(False).alias("is_fixture"), "is_component", F.lit(False).alias("is_entry_point"), F.when(F.col("is_exported"), "public").otherwise("private").alias("visibility"),
            F.exists("calls", lambda c: F.lower(c).rlike("auth|permission|jwt")).alias("calls_auth"), "hardcoded_colors", "off_scale_values", "inline_style_count",
        ).dropDuplicates(["id"]),
        allowMissingColumns=True,
    )
    lines = scanners.lines(files.where("language is not null"), "path", "text")
    # comments hold no calls
    bare_lines = scanners.lines(files.where("language is not null"), "path", "bare")
    risky = files.select("path", "language", scanners.runs_sql(F.col("text")).alias("sql"))
    found = lines.select("path", "line", F.concat(F.lit("hardcoded_secret:"), scanners.secret("body")).alias("value")).where("value is not null")
    injected = lines.join(risky.where("sql"), "path").where(scanners.sql_injection(F.col("body"), F.col("language"))).select("path", "line", F.lit("sql_injection:interpolated").alias("value"))
    by_line = inside(found.unionByName(injected), functions).groupBy("id").agg(F.collect_set("value").alias("_lines"))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    findings = F.array_sort(F.concat(scanners.unsafe_calls(F.col("calls")), scanners.llm_output_risks(F.col("calls")), some(F.col("_lines"))))
    functions = materialize(functions.join(by_line, "id", "left").withColumn("security_findings", findings).drop("_lines").withColumn("security_finding_count", F.size("security_findings")))
    classes = rows.where("kind = 'class'").select(F.concat(F.lit("class::"), qualified).alias("id"), F.lit("Class").alias("label"), "name", qualified.alias("qualified_name"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), "end_line", "docstring", "bases", F.lit("class").alias("kind"), (~private).alias("is_exported"), F.when(private, "private").otherwise("public").alias("visibility"))
    imports = rows.where("kind = 'import'").select("path", "line", F.col("module").alias("module_path"), "names", F.lit("python").alias("language"))
    imports = materialize(imports.unionByName(src.web_imports(files).withColumn("language", F.lit("javascript"))))
    import_nodes = imports.select(F.concat_ws("::", F.lit("import"), "path", F.col("line").cast("string")).alias("id"), F.lit("Import").alias("label"), F.col("path").alias("file_path"), "line", "module_path", F.transform("names", lambda n: F.split_part(n, F.lit(" "), F.lit(1))).alias("imported_names"), F.col("module_path").startswith(".").alias("is_relative"))

    edge = lambda df, kind, *more: df.select("src", "dst", F.lit(kind).alias("type"), *more)
    both = functions.select("id", "file_path", "is_exported", "class_name").unionByName(classes.select("id", "file_path", "is_exported", F.lit(None).cast("string").alias("class_name")))
    contains = edge(both.select(F.concat(F.lit("file::"), F.col("file_path")).alias("src"), F.col("id").alias("dst")), "CONTAINS")
    methods = edge(functions.where("class_name is not null").select(F.concat(F.lit("class::"), F.col("file_path"), F.lit("::"), F.col("class_name")).alias("src"), F.col("id").alias("dst")), "CONTAINS")
    defined = edge(both.select(F.col("id").alias("src"), F.concat(F.lit("file::"), F.col("file_path")).alias("dst")), "DEFINED_IN")
    exports = edge(both.where("is_exported").select(F.concat(F.lit("file::"), F.col("file_path")).alias("src"), F.col("id").alias("dst")), "EXPORTS")

    # imports: module -> file, then names -> entities, through re-exports
    asked = imports.select(F.col("path").alias("file_path"), "line", "module_path", "language").distinct()
    targets = materialize(import_targets(asked, files.select("path"), src.path_aliases(files)))
    hits = materialize(imports.withColumnRenamed("path", "file_path").join(targets, ["file_path", "line"]).select("file_path", "line", "target", F.explode_outer("names").alias("pair")))
    hits = hits.withColumn("pair", F.coalesce("pair", F.lit("* *")))
    hits = hits.select("file_path", "line", F.col("target").alias("origin"), F.split_part("pair", F.lit(" "), F.lit(1)).alias("origin_name"), F.split_part("pair", F.lit(" "), F.lit(2)).alias("name"))
    entities = functions.select("id", "label", "name", "qualified_name", "file_path", "class_name").unionByName(classes.select("id", "label", "name", "qualified_name", "file_path", F.lit(None).cast("string").alias("class_name")))
    entities = materialize(entities)
    own = entities.where("class_name is null").select(F.col("file_path").alias("file"), "name", F.col("id").alias("target"))
    offered = reexport_closure(own, hits.select(F.col("file_path").alias("file"), "name", "origin", "origin_name"))
    imported = hits.join(offered.select(F.col("file").alias("origin"), F.col("name").alias("origin_name"), "target"), ["origin", "origin_name"]).select("file_path", "name", "target")
    star = hits.where("origin_name = '*'").select("file_path", "origin").distinct().join(own.select(F.col("file").alias("origin"), "name", "target"), "origin").select("file_path", "name", "target")
    imported = materialize(imported.unionByName(star).groupBy("file_path", "name").agg(F.min("target").alias("target")))
    import_edges = hits.groupBy("file_path", "origin").agg(F.array_sort(F.collect_set("origin_name")).alias("names")).select(F.concat(F.lit("file::"), F.col("file_path")).alias("src"), F.concat(F.lit("file::"), F.col("origin")).alias("dst"), F.lit("IMPORTS").alias("type"), "names")

    # bases before calls, so that inherited methods resolve
    named = classes.select(F.col("id").alias("src"), F.col("file_path").alias("f"), F.posexplode("bases").alias("place", "base")).withColumn("base", F.element_at(F.split("base", r"\."), -1))
    here = entities.where("label = 'Class'").select(F.col("file_path").alias("f"), F.col("name").alias("base"), F.col("id").alias("target"))
    linked = named.join(here, ["f", "base"]).withColumn("k", F.lit(1)).unionByName(named.join(imported.select(F.col("file_path").alias("f"), F.col("name").alias("base"), "target"), ["f", "base"]).withColumn("k", F.lit(2)))
    base_rows = materialize(linked.groupBy("src", "place").agg(F.min_by("target", "k").alias("dst")))
    inherits = edge(base_rows, "INHERITS_FROM")
    refs = functions.select(F.col("id").alias("src"), "file_path", "class_name", F.explode("calls").alias("call"))
    bases = base_rows.select(F.col("src").alias("class_id"), F.col("dst").alias("base_id"), "place")
    notes = functions.select(F.col("id").alias("src"), "file_path", F.explode("annotations").alias("pair")).select("src", "file_path", F.split_part("pair", F.lit(" "), F.lit(1)).alias("param_name"), F.regexp_replace("pair", r"^\S+ ", "").alias("annotation"))
    typed = notes.select("src", F.col("param_name").alias("receiver"), F.col("annotation").alias("type"))
    resolved = materialize(resolve_refs(refs, entities, imported, bases, typed))
    calls = materialize(keep_best_edges(resolved.where("src <> dst").select("src", "dst", F.lit("CALLS").alias("type"), "resolution")))
    notes = notes.unionByName(functions.where("return_type is not null").select(F.col("id").alias("src"), "file_path", F.lit(None).cast("string").alias("param_name"), F.col("return_type").alias("annotation")))
    types = links.type_edges(notes, classes, imported)
    fields = rows.where("kind = 'field'").select(F.concat(F.lit("typefield::"), "path", F.lit("::"), "class_name", F.lit("."), "name").alias("id"), F.lit("TypeField").alias("label"), "name", F.col("returns").alias("type_annotation"), F.col("returns").rlike(r"Optional\[|\bNone\b").alias("is_optional"), "line", F.col("path").alias("file_path"), F.concat(F.lit("class::"), "path", F.lit("::"), "class_name").alias("_class"))
    tests = functions.where("is_test").select("id")
    covered = materialize(coverage_edges(calls, tests, functions.where("not is_test").select("id")))
    reached = import_edges.select(F.regexp_replace("src", "^file::", "").alias("file_path"), F.regexp_replace("dst", "^file::", "").alias("target"))
    covered = materialize(covered.unionByName(links.import_coverage(functions.where("is_test").select("id", "file_path"), reached, functions.where("not is_test").select("id", "file_path", "is_exported"), covered.select("src").distinct())))
    tested = covered.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").cast("int").alias("tested_by_count"))
    functions = functions.join(tested, "id", "left")
    test_files = edge(import_edges.join(file_nodes.where("is_test_file").select(F.col("id").alias("src")), "src", "left_semi").join(file_nodes.where("is_test_file").select(F.col("id").alias("dst")), "dst", "left_anti"), "TESTS")
    fixtures = functions.where("is_test").select(F.col("id").alias("src"), F.explode("parameters").alias("name")).join(functions.where("is_fixture").groupBy("name").agg(F.max("id").alias("dst")), "name")

    # dependencies and environment
    outside = imports.withColumnRenamed("path", "file_path").join(targets, ["file_path", "line"], "left_anti").where(~F.col("module_path").startswith(".")).select("file_path", scalars.package(F.col("module_path"), F.col("language")).alias("name")).where("name is not null")
    versions = src.manifest_dependencies(files).groupBy("name").agg(F.max_by("version", "path").alias("version"))
    deps = outside.groupBy("name").agg(F.count("*").cast("int").alias("import_count")).join(versions, "name", "left").select(F.concat(F.lit("dep::"), F.col("name")).alias("id"), F.lit("Dependency").alias("label"), "name", "version", "import_count")
    if advisories is not None:
        deps = links.enrich_dependencies(deps, advisories)
    depends = edge(outside.distinct().select(F.concat(F.lit("file::"), F.col("file_path")).alias("src"), F.concat(F.lit("dep::"), F.col("name")).alias("dst")), "DEPENDS_ON")
    reads = files.select("path", F.explode(scanners.env_names(F.col("text"), F.col("language"))).alias("name"))
    env = src.env_template(files).withColumn("k", F.lit(1)).unionByName(reads.select("name", F.lit(None).cast("string").alias("default_value"), F.lit(False).alias("required"), F.lit(2).alias("k")))
    env_nodes = env.groupBy("name").agg(F.min_by(F.struct("default_value", "required"), "k").alias("v")).select(F.concat(F.lit("envvar::"), F.col("name")).alias("id"), F.lit("EnvVar").alias("label"), "name", "v.default_value", "v.required")
    uses_env = edge(reads.select(F.concat(F.lit("file::"), F.col("path")).alias("src"), F.concat(F.lit("envvar::"), F.col("name")).alias("dst")), "USES_ENV")

    # documents, design tokens
    sections = src.markdown_sections(files)
    section_nodes = sections.select(F.concat(F.lit("docsec::"), F.col("path"), F.lit("::L"), F.col("start_line").cast("string")).alias("id"), F.lit("DocumentSection").alias("label"), "heading", "level", "start_line", "end_line", F.col("path").alias("file_path"))
    titles = sections.groupBy("path").agg(F.min_by("heading", "start_line").alias("title"), F.count("*").cast("int").alias("section_count"))
    mentions = materialize(src.section_references(files))
    refs_count = mentions.groupBy("path").agg(F.count("*").cast("int").alias("reference_count"))
    documents = titles.join(refs_count, "path", "left").select(F.concat(F.lit("doc::"), F.col("path")).alias("id"), F.lit("Document").alias("label"), "title", "section_count", F.coalesce("reference_count", F.lit(0)).alias("reference_count"), F.col("path").alias("file_path"), scanners.doc_type(F.col("path"), F.col("title")).alias("doc_type"))
    has_section = edge(section_nodes.select(F.concat(F.lit("doc::"), F.col("file_path")).alias("src"), F.col("id").alias("dst")), "HAS_SECTION")
    mentioned = mentions.select(F.concat(F.lit("docsec::"), F.col("path"), F.lit("::L"), F.col("start_line").cast("string")).alias("src"), "reference", "kind")
    references = edge(links.document_references(mentioned, entities, files.select("path")).select("src", "dst").distinct(), "REFERENCES")
    tokens = src.css_tokens(files).select(F.concat(F.lit("token::"), F.col("name")).alias("id"), F.lit("Token").alias("label"), "name", "raw_name", "value", "category", "references", F.col("path").alias("file_path"))

    # what components render, and the tokens their class names draw from
    own_web = web.select(F.concat(F.lit("func::"), web_name).alias("src"), F.col("path").alias("file_path"), "renders", "classes")
    shown = own_web.select("src", "file_path", F.explode("renders").alias("name")).distinct()
    renders = edge(links.named_targets(shown, entities, imported).where("src <> target").select("src", F.col("target").alias("dst")).distinct(), "RENDERS")
    uses_token = edge(links.token_usage(own_web.select("src", F.explode("classes").alias("name")).distinct(), tokens), "USES_TOKEN")

    # routes, data models, stored functions, flags, packages in use
    marked = functions.select("id", "name", "file_path", "start_line", "decorators", F.explode(F.coalesce("decorators", F.array().cast("array<string>"))).alias("d")).where(F.col("d").rlike(ROUTE))
    route_id = F.concat_ws("::", F.lit("route"), "file_path", F.col("start_line").cast("string"), F.upper(F.regexp_extract("d", ROUTE, 1)), F.regexp_extract("d", ROUTE, 2))
    method = F.upper(F.regexp_extract("d", ROUTE, 1))
    texts = F.array().cast("array<string>")
    guarded = F.flatten(F.transform(F.regexp_extract_all("d", F.lit(r"(?s)dependencies\s*=\s*\[(.*?)\]")), lambda d: F.regexp_extract_all(d, F.lit(r"(?:Depends|Security)\(\s*([A-Za-z_][\w.]*)"))))
    others = F.filter("decorators", lambda d: ~d.rlike(ROUTE))
    mine = marked.select(route_id.alias("id"), F.when(method == "ROUTE", "ALL").otherwise(method).alias("method"), F.regexp_extract("d", ROUTE, 2).alias("path"), F.col("name").alias("handler_name"), "file_path", F.col("start_line").alias("line"), guarded.alias("middleware"), others.alias("decorators"))
    web_calls, web_guards = src.web_routes(files, scalars.GUARD_WORDS)
    web_id = F.concat_ws("::", F.lit("route"), "path", F.col("line").cast("string"), "method", "route")
    found_routes = materialize(mine.unionByName(web_calls.select(web_id.alias("id"), F.when(F.col("method") == "ALL", "ALL").otherwise(F.col("method")).alias("method"), F.col("route").alias("path"), F.col("handler").alias("handler_name"), F.col("path").alias("file_path"), "line", "middleware", texts.alias("decorators"))))
    # guards of whole applications and routers, from all files before any route is judged
    app_wide = files.where("language = 'python'").select(F.col("path").alias("file_path"), F.explode(F.regexp_extract_all("bare", F.lit(r"(?s)(?:FastAPI|APIRouter)\([^)]*?dependencies\s*=\s*\[([^\]]*)\]"))).alias("given")).where(F.lower("given").rlike("|".join(scalars.GUARD_WORDS))).select(F.lit("*").alias("pattern"), "file_path")
    patterns = materialize(web_guards.unionByName(app_wide).distinct())
    routes = links.route_auth(found_routes.withColumn("label", F.lit("Route")), patterns).drop("decorators")
    # names of middleware and handlers are resolved when all files are known
    asked_guards = found_routes.select(F.col("id").alias("src"), "file_path", F.explode("middleware").alias("name"))
    wanted = asked_guards.unionByName(found_routes.where("handler_name is not null").select(F.col("id").alias("src"), "file_path", F.col("handler_name").alias("name"))).distinct()
    linked_names = materialize(links.named_targets(wanted, entities, imported))
    uses_middleware = edge(asked_guards.join(linked_names, ["src", "name"]).select("src", F.col("target").alias("dst")).distinct(), "USES_MIDDLEWARE")
    late = found_routes.join(marked.select(route_id.alias("id")), "id", "left_anti").select(F.col("id").alias("src"), F.col("handler_name").alias("name")).join(linked_names, ["src", "name"]).select("src", F.col("target").alias("dst"))
    handles = edge(marked.select(route_id.alias("src"), F.col("id").alias("dst")).unionByName(late).distinct(), "HANDLES")
    models, model_rows, related = data_models(files)
    models = materialize(models)
    field_id = F.concat(F.lit("mf::"), "model", F.lit("::"), "field")
    model_fields = model_rows.select(field_id.alias("id"), F.lit("ModelField").alias("label"), F.col("field").alias("name"), "field_type", "db_type", "is_primary", "is_unique", "is_indexed", F.col("is_foreign_key").alias("is_foreign"), "has_default", "default_value", "is_nullable", F.col("path").alias("file_path"))
    has_field = edge(model_rows.select(F.concat(F.lit("model::"), "model").alias("src"), field_id.alias("dst")), "HAS_MODEL_FIELD")
    relations = edge(related.select(F.concat(F.lit("model::"), "model").alias("src"), F.concat(F.lit("model::"), "target").alias("dst"), F.col("kind").alias("relation_type")), "RELATED_TO", "relation_type")
    bodies = materialize(src.sql_functions(files))
    stored = bodies.select("path", "name").distinct().select(F.concat(F.lit("dbfunc::"), "path", F.lit("::"), "name").alias("id"), F.lit("DBFunction").alias("label"), "name", F.col("path").alias("file_path"))
    # fields of a class and typed parameters of its constructor, for each of its methods
    members = functions.where("class_name is not null").select(F.col("id").alias("src"), "file_path", "class_name", "name")
    owned = rows.where("kind = 'field'").select(F.col("path").alias("file_path"), "class_name", F.col("name").alias("field"), F.col("returns").alias("type"))
    given = notes.join(members.where("name = '__init__'").select("src", "class_name"), "src").where("param_name is not null").select("file_path", "class_name", F.col("param_name").alias("field"), F.col("annotation").alias("type"))
    typed_fields = members.select("src", "file_path", "class_name").join(owned.unionByName(given).distinct(), ["file_path", "class_name"]).select("src", "field", "type")
    quoted = inside(bare_lines.select("path", "line", F.regexp_extract("body", TABLE_CALL, 1).alias("t"), F.regexp_extract("body", TABLE_CALL, 2).alias("verb")).where("t <> ''").select("path", "line", F.concat("verb", F.lit(".from('"), "t", F.lit("')")).alias("value")), functions)
    every_call = refs.select("src", "call").unionByName(quoted.select(F.col("id").alias("src"), F.col("value").alias("call")))
    uses_model = edge(links.model_edges(every_call, models, typed_fields).unionByName(links.stored_function_edges(bodies, stored, models)), "USES_MODEL", "access")
    rpc = inside(bare_lines.select("path", "line", F.concat(F.lit("rpc:"), F.regexp_extract("body", r"\.rpc\(\s*[\"'](\w+)[\"']", 1)).alias("value")).where("value <> 'rpc:'"), functions)
    calls_rpc = edge(links.rpc_edges(rpc.select(F.col("id").alias("src"), F.col("value").alias("call")), stored), "CALLS_RPC")
    gates = materialize(inside(bare_lines.select("path", "line", F.regexp_extract("body", FLAG_CALL, 1).alias("value")).where("value <> ''"), functions).select(F.concat(F.lit("flag::"), "value").alias("src"), F.col("id").alias("dst"), F.col("value").alias("key")))
    seeded, retired = src.flag_migrations(files)
    flags = merge_flags(src.flag_registry(files).drop("path").dropDuplicates(["key"]), seeded, retired, gates.groupBy("key").agg(F.count_distinct("dst").cast("int").alias("gates_count")))
    flags = flags.select(F.concat(F.lit("flag::"), "key").alias("id"), F.lit("Flag").alias("label"), F.col("key").alias("name"), "in_registry", "in_db", "retired", "orphan", "registry_default", "db_seeded_enabled", "description", "gates_count")
    packages = imports.withColumnRenamed("path", "file_path").join(targets, ["file_path", "line"], "left_anti").select("file_path", F.explode("names").alias("pair"), scalars.package(F.col("module_path"), F.col("language")).alias("package"))
    packages = packages.where("package is not null").select("file_path", F.split_part(F.split_part("pair", F.lit(" "), F.lit(2)), F.lit("."), F.lit(1)).alias("name"), "package")
    uses_package = edge(links.external_usage(refs.select("src", "file_path", "call"), resolved.select("src", "call").distinct(), packages), "USES_DEPENDENCY")
    accepts = types.select("src", "dst", "type", "param_name")
    holds = edge(fields.select(F.col("_class").alias("src"), F.col("id").alias("dst")), "HAS_FIELD")

    nodes = [file_nodes, functions, classes, import_nodes, deps, env_nodes, documents, section_nodes, tokens, routes, models, model_fields, stored, flags, fields]
    edges = [contains, methods, defined, exports, import_edges, inherits, calls, edge(covered, "TESTS_FUNCTION", "depth"), test_files, edge(fixtures, "USES_FIXTURE"), depends, uses_env, has_section, references, handles, uses_middleware, renders, uses_token, has_field, relations, uses_model, calls_rpc, edge(gates, "GATES"), uses_package, accepts, holds]
    own_id = lambda df: df.withColumn("repo_id", F.lit(repo_id))
    all_nodes = reduce(DataFrame.unionByName, (conform(own_id(n), NODES) for n in nodes))
    all_edges = reduce(DataFrame.unionByName, (conform(own_id(e), EDGES) for e in edges))
    return CodeGraph(materialize(all_nodes), materialize(all_edges))
