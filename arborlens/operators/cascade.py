"""Name resolution as prioritised joins: every strategy proposes targets for references, and per reference the
proposal of least priority stays; ties go to the least target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import rank
from ..storage import materialize

# Words that name no class in a type expression.
TYPE_NOISE = {"Optional", "Union", "List", "Dict", "Set", "Tuple", "Any", "None", "Promise", "Array", "Partial", "Readonly", "Record", "null", "undefined", "string", "number", "boolean", "str", "int", "float", "bool", "list", "dict", "set", "tuple", "readonly"}


def first_of(proposals: list[DataFrame], key: list[str], priority: str = "priority", target: str = "target") -> DataFrame:
    """One row per key: of least priority, then least target. A window, so that all of a row's columns stay."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), proposals)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(priority, target))
    return every.withColumn("_place", place).where("_place = 1").drop("_place")


def strategy(refs: DataFrame, table: DataFrame, on: Column, priority: int, label: str, target: str = "target") -> DataFrame:
    return refs.join(table, on).select(*(refs[c] for c in refs.columns), table[target].alias("target"), F.lit(priority).alias("priority"), F.lit(label).alias("resolution"))


def unique_names(entities: DataFrame, name: str = "name", target: str = "id") -> DataFrame:
    """(name, target) of names that exactly one entity has."""
    return entities.groupBy(F.col(name).alias("name")).agg(F.min(target).alias("target"), F.count_distinct(target).alias("n")).where("n = 1").select("name", "target")


def keep_best_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type): of highest rank, then least label."""
    best = F.min_by("resolution", F.struct(-rank(F.col("resolution")), F.col("resolution")))
    return edges.groupBy("src", "dst", "type").agg(best.alias("resolution"))


def inherited_methods(methods: DataFrame, bases: DataFrame, most: int = 10) -> DataFrame:
    """(class_id, name, target): methods a class has through its bases, the nearest first, then in base order; bases more than
    `most` steps up (a fixed value by default) are not looked at.
    methods (class_id, name, target), bases (class_id, base_id, place)."""
    line = bases.select("class_id", "base_id", F.array("place").alias("order"), F.lit(1).alias("depth"))
    found = [line]
    for depth in range(2, most + 1):
        up = bases.select(F.col("class_id").alias("_c"), F.col("base_id").alias("_b"), "place")
        line = line.join(up, F.col("base_id") == F.col("_c")).where(F.col("_b") != F.col("class_id"))
        line = materialize(line.groupBy("class_id", F.col("_b").alias("base_id")).agg(F.min(F.concat("order", F.array("place"))).alias("order")).withColumn("depth", F.lit(depth)))
        if line.isEmpty():
            break
        found.append(line)
    lineage = reduce(DataFrame.unionByName, found)
    own = methods.select(F.col("class_id").alias("_m"), "name", "target")
    met = lineage.join(own, F.col("base_id") == F.col("_m"))
    return met.groupBy("class_id", "name").agg(F.min_by("target", F.struct("order", "depth", "target")).alias("target"))


def resolve_calls(refs: DataFrame, entities: DataFrame, imports: DataFrame, bases: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """CALLS edges (src, dst, type, resolution) of resolve_refs."""
    chosen = resolve_refs(refs, entities, imports, bases, fields).where(F.col("src") != F.col("dst"))
    return keep_best_edges(chosen.select("src", "dst", F.lit("CALLS").alias("type"), "resolution"))


def resolve_refs(refs: DataFrame, entities: DataFrame, imports: DataFrame, bases: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(src, call, dst, resolution) of every call that resolves within the repository, calls of the caller itself included.

    refs (src, file_path, class_name, call); entities (id, label, name, qualified_name, file_path, class_name);
    imports (file_path, name, target): what a file's import of a name means; bases as in inherited_methods;
    fields (src, receiver, type): annotated parameters of the caller and fields of its class.
    Order: qualified name, file::name, own or inherited method of self, imported receiver, typed receiver, same-file
    method of the last segment, imported name, same-file name, a name unique in the repository.
    """
    refs = refs.withColumn("ref", F.concat_ws("\u0001", "src", "call")).withColumn("head", F.split_part("call", F.lit("."), F.lit(1))).withColumn("tail", F.element_at(F.split("call", r"\."), -1)).withColumn("dotted", F.contains("call", F.lit(".")))
    callable_ = entities.where(F.col("label").isin("Function", "Class"))
    e = entities.select(F.col("id").alias("target"), F.col("name").alias("e_name"), F.col("qualified_name").alias("e_qn"), F.col("file_path").alias("e_file"), F.col("class_name").alias("e_class"))
    single = ~F.col("dotted")
    self_call = F.col("head").isin("self", "this") & F.col("dotted")
    out = [
        strategy(refs, e, refs["call"] == e["e_qn"], 1, "exact"),
        strategy(refs, e, F.concat_ws("::", refs["file_path"], refs["call"]) == e["e_qn"], 2, "file_scoped"),
        strategy(refs.where(self_call), e, (refs["file_path"] == e["e_file"]) & (refs["class_name"] == e["e_class"]) & (refs["tail"] == e["e_name"]), 3, "file_scoped"),
        strategy(refs.where("dotted"), e, (refs["file_path"] == e["e_file"]) & (refs["head"] == e["e_class"]) & (refs["tail"] == e["e_name"]), 3, "dotted"),
        strategy(refs.where(single), e.where(e["e_class"].isNull()), (refs["file_path"] == e["e_file"]) & (refs["tail"] == e["e_name"]), 8, "same_file"),
        strategy(refs.where(F.col("dotted") & ~self_call), e.where(e["e_class"].isNotNull()), (refs["file_path"] == e["e_file"]) & (refs["tail"] == e["e_name"]), 6, "dotted"),
    ]
    known = imports.select(F.col("file_path").alias("i_file"), F.col("name").alias("i_name"), "target")
    out.append(strategy(refs.where(single), known, (refs["file_path"] == known["i_file"]) & (refs["call"] == known["i_name"]), 7, "import"))
    members = known.join(entities.select(F.col("id"), F.col("file_path").alias("m_file"), F.col("name").alias("m_class")), F.col("target") == F.col("id"))
    methods = entities.where(F.col("class_name").isNotNull()).select(F.col("id").alias("target"), F.col("file_path").alias("f"), F.col("class_name").alias("c"), F.col("name").alias("m"))
    dotted = members.drop("target").join(methods, (F.col("m_file") == F.col("f")) & (F.col("m_class") == F.col("c")))
    out.append(strategy(refs.where("dotted"), dotted, (refs["file_path"] == dotted["i_file"]) & (refs["head"] == dotted["i_name"]) & (refs["tail"] == dotted["m"]), 4, "import"))
    classes = entities.where("label = 'Class'").select(F.col("id").alias("class_id"), F.col("name").alias("c_name"), F.col("file_path").alias("c_file"))
    own_methods = entities.where(F.col("class_name").isNotNull()).join(classes, (F.col("class_name") == F.col("c_name")) & (F.col("file_path") == F.col("c_file"))).select("class_id", "name", F.col("id").alias("target"))
    if bases is not None:
        inherited = inherited_methods(own_methods, bases)
        caller = refs.where(self_call).join(classes, (F.col("class_name") == F.col("c_name")) & (F.col("file_path") == F.col("c_file")))
        inherited = inherited.select(F.col("class_id").alias("h_class"), F.col("name").alias("h_name"), "target")
        met = caller.join(inherited, (F.col("class_id") == F.col("h_class")) & (F.col("tail") == F.col("h_name")))
        out.append(met.select(*refs.columns, "target", F.lit(4).alias("priority"), F.lit("file_scoped").alias("resolution")))
        every_method = own_methods.unionByName(inherited.select(F.col("h_class").alias("class_id"), F.col("h_name").alias("name"), "target").join(own_methods, ["class_id", "name"], "left_anti"))
    else:
        every_method = own_methods
    if fields is not None:
        words = fields.select("src", "receiver", F.explode(F.array_distinct(F.regexp_extract_all("type", F.lit(r"([A-Za-z_]\w*)")))).alias("word")).where(~F.col("word").isin(*TYPE_NOISE))
        named = words.join(unique_names(entities.where("label = 'Class'")).withColumnRenamed("name", "word"), "word").groupBy("src", "receiver").agg(F.min("target").alias("class_id"), F.count_distinct("target").alias("n")).where("n = 1")
        typed = named.join(every_method, "class_id").select(F.col("src").alias("t_src"), F.col("receiver").alias("t_head"), F.col("name").alias("t_name"), "target")
        two = refs.where(F.size(F.split("call", r"\.")) == 2)
        out.append(strategy(two, typed, (two["src"] == typed["t_src"]) & (two["head"] == typed["t_head"]) & (two["tail"] == typed["t_name"]), 5, "typed_receiver"))
    alone = unique_names(callable_).withColumnRenamed("name", "u_name")
    out.append(strategy(refs, alone, refs["tail"] == alone["u_name"], 9, "unique_global"))
    return first_of(out, ["ref"]).select("src", "call", F.col("target").alias("dst"), "resolution")


def reexport_closure(exports: DataFrame, forwards: DataFrame, most: int = 5) -> DataFrame:
    """(file, name, target): names a file offers, its own (file, name, target) and those it forwards (file, name, origin,
    origin_name) from others, over at most `most` passes; the first target found stays, the least of one pass."""
    have = materialize(exports.groupBy("file", "name").agg(F.min("target").alias("target")))
    for _ in range(most):
        seen = have.select(F.col("file").alias("_f"), F.col("name").alias("_n"), "target")
        new = forwards.join(seen, (F.col("origin") == F.col("_f")) & (F.col("origin_name") == F.col("_n"))).groupBy("file", "name").agg(F.min("target").alias("target"))
        new = materialize(new.join(have, ["file", "name"], "left_anti"))
        if new.isEmpty():
            break
        have = have.unionByName(new)
    return have


def forward_whole(offers: DataFrame, pairs: DataFrame, passes: int) -> DataFrame:
    """(file, name, target): names a file offers, its own (file, name, target; one row each) and all that the files offer which it forwards
    as a whole, pairs (file, origin), over so many passes; the first target found stays, the least of one pass. The offers are
    dealt out by name once: what a pass finds for a name is summed up where it is found, and no pass moves rows."""
    name_of = offers.where("file is not null and name is not null").select("file", "name", "target").repartition("name")
    ways = pairs.where("file is not null and origin is not null and file <> origin").select("file", "origin", F.lit(1).alias("way"))
    ways = materialize(ways.distinct().unionByName(offers.where("file is not null").select("file", F.col("file").alias("origin"), F.lit(0).alias("way")).distinct()))
    ways = F.broadcast(ways) if ways.count() <= 1 << 17 else ways  # about 10 MB; more of them are joined as Spark thinks best
    for _ in range(passes):
        met = name_of.withColumnRenamed("file", "origin").join(ways, "origin")
        own, least = F.max(F.col("way") == 0), lambda way: F.min(F.when(F.col("way") == way, F.col("target")))
        name_of = met.groupBy("name", "file").agg(F.when(own, least(0)).otherwise(least(1)).alias("target")).select("file", "name", "target")
    return name_of.unionByName(offers.where("file is null and name is not null").select("file", "name", "target"))


def source_root_paths(paths: DataFrame) -> DataFrame:
    """(path, target): Python files below a source root by their path without it. A source root is a top folder that is no
    package and holds packages at any depth; paths that exist as they are stay theirs."""
    folders = paths.where(F.col("path").endswith("/__init__.py")).select(F.regexp_replace("path", "/__init__.py$", "").alias("folder"))
    top = F.split_part("folder", F.lit("/"), F.lit(1)).alias("top")
    roots = folders.where(F.contains("folder", F.lit("/"))).select(top).distinct().join(folders.select(F.col("folder").alias("top")), "top", "left_anti")
    below = paths.where(F.col("path").rlike(r"/.*\.pyi?$")).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("top"), F.col("path").alias("target")).join(roots, "top")
    below = below.select(F.regexp_replace("target", "^[^/]*/", "").alias("path"), "target").join(paths.select("path"), "path", "left_anti")
    return below.groupBy("path").agg(F.min("target").alias("target"))


def alias_bases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_path, line, place, base): paths that imports of non-relative modules may mean by aliases (pattern, target,
    place and, if there is one, the folder of the file that sets it), in which a * stands for any text. Aliases of the
    folders above the importing file come first, the nearest folder before others. Patterns are met by every beginning of
    the module, without a cross join."""
    folder = F.col("folder") if "folder" in aliases.columns else F.lit(None).cast("string")
    known = aliases.select(folder.alias("_folder"), "place", "target", F.contains("pattern", F.lit("*")).alias("open"), F.split_part("pattern", F.lit("*"), F.lit(1)).alias("head"), F.when(F.contains("pattern", F.lit("*")), F.regexp_replace("pattern", r"^[^*]*\*", "")).otherwise("").alias("tail"))
    heads = F.transform(F.sequence(F.lit(0), F.length("module_path")), lambda n: F.col("module_path").substr(F.lit(1), n))
    met = imports.where(~F.col("module_path").startswith(".")).select("file_path", "line", "module_path", F.explode(heads).alias("head")).join(known, "head")
    fits = F.when(F.col("open"), F.col("module_path").endswith(F.col("tail")) & (F.length("module_path") >= F.length("head") + F.length("tail"))).otherwise(F.col("head") == F.col("module_path"))
    caught = F.col("module_path").substr(F.length("head") + 1, F.length("module_path") - F.length("head") - F.length("tail"))
    above = F.when(F.col("_folder") == "", 0).when(F.col("file_path").startswith(F.concat(F.col("_folder"), F.lit("/"))), F.size(F.split("_folder", "/"))).otherwise(-1)
    near = F.when(F.col("_folder").isNull(), 0).otherwise(F.lit(255) - F.least(F.lit(254), above)) * 4096
    return met.where(fits).select("file_path", "line", (near + F.col("place")).alias("place"), F.replace("target", F.lit("*"), caught).alias("base"))


def web_roots(paths: DataFrame) -> DataFrame:
    """(root, order): top folders that hold a tenth of the web files or more, so ten at most, the fullest first."""
    web = paths.where(F.col("path").rlike(r"\.(tsx?|jsx?|mjs|cjs)$"))
    counts = web.where(F.contains("path", F.lit("/"))).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).agg(F.count("*").alias("n"))
    total = web.count()
    few = counts.where(F.col("n") * 10 >= total).orderBy(F.desc("n"), "root").limit(10)
    return few.select("root", F.row_number().over(Window.orderBy(F.desc("n"), "root")).alias("order"))


ENDINGS = [".py", "/__init__.py", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


def import_targets(imports: DataFrame, paths: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(file_path, line, target): the file each import names. Candidates in order: what aliases make of it, the path itself,
    with an extension, its index or __init__ file, without a .js ending, and these below a Python source root; relative ones
    start in the importer's folder."""
    dots = F.length(F.regexp_extract("module_path", r"^(\.+)", 1))
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    python = F.col("language") == "python"
    up = F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(folder, "/")) - dots + 1))
    rest = F.regexp_replace(F.regexp_replace("module_path", r"^\.+", ""), r"\.", "/")
    python_path = F.when(dots > 0, F.concat_ws("/", F.array_join(up, "/"), rest)).otherwise(rest)
    parts = F.split(F.concat_ws("/", folder, "module_path"), "/")
    # @/x, ~/x and #/x mean the root or a folder that holds a tenth of the web files; so does a short @name/x, other bare modules are packages
    bare = F.when(F.col("module_path").rlike(r"^[@~#]/|^@[^/-]{1,14}/"), F.regexp_replace("module_path", "^[^/]*/", ""))
    web_path = F.when(F.col("module_path").startswith("."), normalise(parts)).otherwise(bare)
    rows = imports.select("file_path", "line", F.lit(1 << 24).alias("place"), F.when(python, python_path).otherwise(web_path).alias("base"))
    if aliases is not None:
        rows = rows.unionByName(alias_bases(imports.where(~python), aliases).withColumn("place", F.col("place").cast("int")))
    rooted = imports.where(~python & ~F.col("module_path").startswith(".")).select("file_path", "line", bare.alias("rest")).where("rest is not null").withColumn("_k", F.lit(1))
    rooted = rooted.join(web_roots(paths).withColumn("_k", F.lit(1)), "_k").select("file_path", "line", ((1 << 24) + F.col("order")).cast("int").alias("place"), F.concat_ws("/", "root", "rest").alias("base"))
    rows = rows.unionByName(rooted).where("base is not null").withColumn("base", F.regexp_replace("base", r"^/+|/+$", ""))
    stems = F.array("base", F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", ""))
    candidates = F.flatten(F.transform(stems, lambda s: F.concat(F.array(s), F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(s, e)))))
    tried = rows.select("file_path", "line", "place", F.posexplode(candidates).alias("priority", "candidate"))
    known = paths.select(F.col("path").alias("candidate"), F.col("path").alias("target"), F.lit(0).alias("root")).unionByName(source_root_paths(paths).select(F.col("path").alias("candidate"), "target", F.lit(1).alias("root")))
    found = tried.join(known, "candidate")
    return found.groupBy("file_path", "line").agg(F.min_by("target", F.struct("place", "root", "priority")).alias("target"))


def normalise(parts: Column) -> Column:
    """A path of the parts with . and .. folded."""
    step = lambda out, p: F.when(p.isin(".", ""), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(out) - 1))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def coverage_edges(calls: DataFrame, tests: DataFrame, functions: DataFrame) -> DataFrame:
    """TESTS_FUNCTION (src, dst, depth): 1 for functions a test calls, 2 for what these call and the test does not
    reach directly; test functions are never targets."""
    test = tests.select(F.col("id").alias("src"))
    plain = functions.join(tests.select("id"), "id", "left_anti").select(F.col("id").alias("dst"))
    steps = calls.select("src", "dst").distinct()
    one = steps.join(test, "src", "left_semi").join(plain, "dst", "left_semi").select("src", "dst")
    two = one.select("src", F.col("dst").alias("mid")).join(steps.select(F.col("src").alias("mid"), "dst"), "mid").join(plain, "dst", "left_semi").select("src", "dst").distinct()
    two = two.join(one, ["src", "dst"], "left_anti")
    return one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2)))


def dedupe_by_name(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where("_place = 1").drop("_place")


def merge_flags(registry: DataFrame, database: DataFrame, retired: DataFrame, checked: DataFrame) -> DataFrame:
    """Flags from registry (key, registry_default, description), database (key, db_seeded_enabled), retired (key) and
    checked (key, gates_count); a key of any of them is a flag, orphan if only checked."""
    r = registry.withColumn("in_registry", F.lit(True))
    d = database.withColumn("seeded", F.lit(True))
    every = r.join(d, "key", "full_outer").join(retired.select("key").distinct().withColumn("retired", F.lit(True)), "key", "full_outer").join(checked, "key", "full_outer")
    gone, listed = F.coalesce("retired", F.lit(False)), F.coalesce("in_registry", F.lit(False))
    in_db = F.coalesce("seeded", F.lit(False)) & ~gone
    gates = F.coalesce("gates_count", F.lit(0))
    return every.select("key", listed.alias("in_registry"), in_db.alias("in_db"), gone.alias("retired"), ((gates > 0) & ~listed & ~in_db & ~gone).alias("orphan"), "registry_default", "db_seeded_enabled", "description", gates.alias("gates_count"))
