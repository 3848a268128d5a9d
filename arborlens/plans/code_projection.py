"""The driver's tables as a code graph: customers, orders and parts are functions that call each other, suppliers are
classes, nations routes, part types models, event keys flags, part names tokens, days of events snapshots."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..operators.cascade import coverage_edges
from ..schema import EDGES, NODES, conform, rank
from ..storage import delete, exists, files_state, materialize
from .projections import table

#: The same projection for DuckDB: functions, calls, tests, files' imports, routes, flags.
SQL = """fn AS (
  SELECT 'func::c' || c_custkey AS id, 'c' || c_custkey AS name, 'src/handlers/' || c_mktsegment || '.py' AS file_path, c_acctbal < 0 AS is_test, c_acctbal >= 5000 AS is_exported, NULL::INTEGER AS complexity, false AS is_component, '' AS docstring, '' AS return_type, c_mktsegment = 'BUILDING' AS calls_auth FROM customer
  UNION ALL SELECT 'func::o' || o_orderkey, 'o' || o_orderkey, 'src/services/' || o_orderpriority || '.py', false, o_totalprice > 250000, CAST(floor(o_totalprice / 50000) AS INTEGER), false, '', '', o_orderpriority = '1-URGENT' FROM orders
  UNION ALL SELECT 'func::p' || p_partkey, 'p' || p_partkey, 'src/db/' || p_brand || '.py', false, p_size >= 25, CAST(p_size AS INTEGER), p_type = 'PROMO', p_name, p_type, false FROM part),
fq AS (SELECT *, file_path || '::' || name AS qualified_name FROM fn),
ca AS (SELECT src, dst, max(rank) AS rank FROM (
  SELECT 'func::c' || o_custkey AS src, 'func::o' || o_orderkey AS dst, CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 4 ELSE 3 END AS rank FROM orders
  UNION ALL SELECT 'func::o' || l_orderkey, 'func::p' || l_partkey, CASE l_returnflag WHEN 'R' THEN 6 WHEN 'A' THEN 5 ELSE 2 END FROM lineitem) GROUP BY 1, 2),
ts AS (SELECT ca.src, ca.dst FROM ca JOIN fn a ON a.id = ca.src AND a.is_test JOIN fn b ON b.id = ca.dst AND NOT b.is_test),
tb AS (SELECT dst AS id, count(DISTINCT src) AS tested_by FROM ts GROUP BY 1),
im AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst, NULL::VARCHAR[] AS names FROM ca JOIN fn a ON a.id = ca.src JOIN fn b ON b.id = ca.dst WHERE a.id LIKE 'func::c%'
  UNION ALL SELECT 'src/services/' || o_orderpriority || '.py', 'src/db/' || p_brand || '.py', coalesce(list(DISTINCT 'p' || p_partkey) FILTER (WHERE l_quantity >= 49 AND l_returnflag = 'R'), []) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
  UNION ALL SELECT DISTINCT 'src/handlers/' || c_mktsegment || '.py', 'src/db/' || p_brand || '.py', [] FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey),
ro AS (SELECT 'route::n' || n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'GET' ELSE 'POST' END AS method, '/' || n_name AS path, n_regionkey = 0 AS guarded FROM nation),
ha AS (SELECT 'route::n' || c_nationkey AS src, 'func::c' || c_custkey AS dst FROM customer),
ek AS (SELECT 'K_' || CAST(json_extract(props, '$.k') AS BIGINT) AS key, event_type, user_id, value FROM events),
ga AS (SELECT DISTINCT key, 'func::c' || user_id AS dst FROM ek JOIN customer ON c_custkey = user_id WHERE event_type = 'click' AND value > 100),
fg AS (SELECT key, bool_or(event_type = 'signup' AND value > 150) AS in_registry, bool_or(event_type = 'purchase' AND value > 150) AS in_db, bool_or(event_type = 'error' AND value > 200) AS retired FROM ek GROUP BY 1),
us AS (SELECT 'func::p' || p_partkey AS src, p_type AS model, CASE WHEN p_size >= 40 THEN 'write' ELSE 'read' END AS access FROM part)"""


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _path(folder: str, key: str):
    return F.concat(F.lit(f"src/{folder}/"), F.col(key), F.lit(".py"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS edges (src, dst, type, resolution): customers to their orders, orders to their parts."""
    status = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "import").otherwise("same_file")
    flag = F.when(F.col("l_returnflag") == "R", "exact").when(F.col("l_returnflag") == "A", "file_scoped").otherwise("unique_global")
    own = table(spark, sf_dir, "orders").select(_id("func::c", "o_custkey").alias("src"), _id("func::o", "o_orderkey").alias("dst"), status.alias("resolution"))
    own = own.unionByName(table(spark, sf_dir, "lineitem").select(_id("func::o", "l_orderkey").alias("src"), _id("func::p", "l_partkey").alias("dst"), flag.alias("resolution")))
    return own.groupBy("src", "dst").agg(F.max_by("resolution", rank(F.col("resolution"))).alias("resolution")).withColumn("type", F.lit("CALLS"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None).cast("int")
    make = lambda df, key, name, path, test, exported, complexity, component, doc, returns, auth: df.select(
        _id("func::" + name, key).alias("id"), _id(name, key).alias("name"), path.alias("file_path"), test.alias("is_test"), exported.alias("is_exported"), complexity.alias("complexity"), component.alias("is_component"), doc.alias("docstring"), returns.alias("return_type"), auth.alias("calls_auth")
    )
    no, blank = F.lit(False), F.lit("")
    rows = [
        make(t("customer"), "c_custkey", "c", _path("handlers", "c_mktsegment"), F.col("c_acctbal") < 0, F.col("c_acctbal") >= 5000, none, no, blank, blank, F.col("c_mktsegment") == "BUILDING"),
        make(t("orders"), "o_orderkey", "o", _path("services", "o_orderpriority"), no, F.col("o_totalprice") > 250000, F.floor(F.col("o_totalprice") / 50000).cast("int"), no, blank, blank, F.col("o_orderpriority") == "1-URGENT"),
        make(t("part"), "p_partkey", "p", _path("db", "p_brand"), no, F.col("p_size") >= 25, F.col("p_size").cast("int"), F.col("p_type") == "PROMO", F.col("p_name"), F.col("p_type"), no),
    ]
    every = reduce(DataFrame.unionByName, rows)
    return every.select("*", F.concat_ws("::", "file_path", "name").alias("qualified_name"), F.lit("Function").alias("label"), F.lit(False).alias("is_entry_point"), F.lit("public").alias("visibility"))


#: Tables that the projection reads.
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Parts that take joins or aggregations of large tables; they are written when a query first asks for them.
HEAVY = ("Function", "CALLS", "TESTS_FUNCTION", "IMPORTS")


class TableGraph(CodeGraph):
    """The projection with its labels and edge types apart: a query computes and reads those that it asks for. Heavy parts are written
    at first use and stay while their inputs do; the others are plans over the tables."""

    def __init__(self, spark: SparkSession, parts: dict[str, Callable[[TableGraph], DataFrame]]) -> None:
        self._spark, self._parts, self._plans, self._written = spark, parts, {}, {}

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def part(self, name: str) -> DataFrame:
        if name in HEAVY and (name not in self._written or not exists(self._written[name])):
            # columns that are null or the same in all rows are not written: Spark takes a selection of columns for that share of a
            # file that they have of its columns, so they would make ends of joins look small enough to send to every executor
            self._written[name] = materialize(self._parts[name](self).drop("label", "type"))
        return self.plan(name)

    def plan(self, name: str) -> DataFrame:
        """The part as it was written or, if it was not, its plan over the tables."""
        edge = name in TYPES
        if name in self._written:
            rows = self._written[name].withColumn("type" if edge else "label", F.lit(name))
        elif name in self._plans:
            return self._plans[name]
        else:
            rows = self._parts[name](self)
        if name == "Function":
            # Catalyst leaves this join out where the number is not asked for
            rows = rows.join(self.plan("TESTS_FUNCTION").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").cast("int").alias("tested_by_count")), "id", "left")
        rows = conform(rows, EDGES if edge else NODES)
        if name not in HEAVY:
            self._plans[name] = rows
        return rows

    def label(self, *labels: str, **columns: str) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.part(n) for n in labels if n in LABELS] or [self.part("File").limit(0)])
        return rows.select(*(F.col(old).alias(new) for new, old in columns.items())) if columns else rows

    def edge(self, *types: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.part(n) for n in types if n in TYPES] or [self.part("GATES").limit(0)])

    def _all(self, names: tuple[str, ...]) -> DataFrame:
        # calls and functions are what queries over everything look for; other heavy parts stay plans, which Catalyst leaves out
        # where the query's labels or types exclude them
        return reduce(DataFrame.unionByName, [self.part(n) if n in ("Function", "CALLS") else self.plan(n) for n in names])

    @property
    def nodes(self) -> DataFrame:
        return self._all(LABELS)

    @property
    def edges(self) -> DataFrame:
        return self._all(TYPES)

    def drop(self) -> None:
        """Deletes the written parts."""
        for df in self._written.values():
            delete(df)
        self._written.clear()


LABELS = ("Function", "File", "Route", "Class", "TypeField", "Model", "ModelField", "Flag", "Token", "Dependency", "Snapshot")
TYPES = ("CALLS", "TESTS_FUNCTION", "IMPORTS", "EXPORTS", "HANDLES", "HAS_FIELD", "ACCEPTS", "RETURNS", "HAS_MODEL_FIELD", "USES_MODEL", "GATES", "USES_TOKEN", "USES_DEPENDENCY")
_built: dict[tuple[str, str], tuple[str, TableGraph]] = {}


def code_graph(spark: SparkSession, sf_dir: str) -> TableGraph:
    """The projection of the tables in sf_dir as they are now: what was written of it is used again while the tables' files have the
    same names, sizes and times, and deleted once they have not."""
    key, state = (spark.sparkContext.applicationId, sf_dir), files_state(spark, [f"{sf_dir}/{name}.parquet" for name in TABLES])
    if key in _built and _built[key][0] != state:
        _built.pop(key)[1].drop()
    if key not in _built:
        _built[key] = state, TableGraph(spark, project(spark, sf_dir))
    return _built[key][1]


def project(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[TableGraph], DataFrame]]:
    """Plans of the parts by label and edge type, made when they are asked for."""
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>")
    edge = lambda df, src, dst, kind, *more: df.select(src.alias("src"), dst.alias("dst"), *more, F.lit(kind).alias("type"))

    def tested(g: TableGraph) -> DataFrame:
        own = functions(spark, sf_dir)
        return coverage_edges(g.plan("CALLS"), own.where("is_test").select("id"), own.select("id")).where("depth = 1").select("src", "dst", "depth").withColumn("type", F.lit("TESTS_FUNCTION"))

    def imports(g: TableGraph) -> DataFrame:
        # orders' lines are joined once; files and their pairs are few
        lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        lines = lines.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        handler, service, store = _path("handlers", "c_mktsegment"), _path("services", "o_orderpriority"), _path("db", "p_brand")
        asked = F.collect_set(F.when((F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R"), _id("p", "p_partkey")))
        pairs = lines.groupBy(handler.alias("h"), service.alias("s"), store.alias("d")).agg(asked.alias("names"))
        buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        out = buyers.select(handler.alias("a"), service.alias("b")).distinct().withColumn("names", F.lit(None).cast("array<string>"))
        out = out.unionByName(pairs.groupBy(F.col("s").alias("a"), F.col("d").alias("b")).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")))
        out = out.unionByName(pairs.where("h is not null").select(F.col("h").alias("a"), F.col("d").alias("b")).distinct().withColumn("names", none))
        return edge(out, F.concat(F.lit("file::"), "a"), F.concat(F.lit("file::"), "b"), "IMPORTS", "names")

    def files(g: TableGraph) -> DataFrame:
        paths = functions(spark, sf_dir).select("file_path").distinct()
        return paths.select(F.concat(F.lit("file::"), "file_path").alias("id"), F.lit("File").alias("label"), F.col("file_path").alias("path"), "file_path", F.lit("python").alias("language"), F.lit(False).alias("is_test_file"), F.lit(False).alias("is_documentation"))

    def routes(g: TableGraph) -> DataFrame:
        guard = F.when(F.col("n_regionkey") == 0, F.array(F.lit("auth"))).otherwise(none)
        return t("nation").select(_id("route::n", "n_nationkey").alias("id"), F.lit("Route").alias("label"), F.when(F.col("n_regionkey") < 2, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "n_name").alias("path"), guard.alias("middleware"))

    def classes(g: TableGraph) -> DataFrame:
        return t("supplier").select(_id("class::s", "s_suppkey").alias("id"), F.lit("Class").alias("label"), F.col("s_name").alias("name"), F.col("s_name").alias("qualified_name"))

    def fields(g: TableGraph) -> DataFrame:
        return t("supplier").select(_id("typefield::s", "s_suppkey").alias("id"), F.lit("TypeField").alias("label"), F.lit("nation").alias("name"), _id("Nation_", "s_nationkey").alias("type_annotation"))

    def models(g: TableGraph) -> DataFrame:
        return t("part").groupBy("p_type").agg(F.count_distinct("p_brand").cast("int").alias("field_count")).select(F.concat(F.lit("model::"), "p_type").alias("id"), F.lit("Model").alias("label"), F.col("p_type").alias("name"), F.lower("p_type").alias("table_name"), "field_count")

    columns = lambda: t("part").select("p_type", "p_brand").distinct()
    field_id = F.concat_ws("::", F.lit("mf"), "p_type", "p_brand")
    keyed = lambda: t("events").withColumn("key", F.concat(F.lit("K_"), F.get_json_object("props", "$.k")))

    def flags(g: TableGraph) -> DataFrame:
        when = lambda kind, least: F.bool_or((F.col("event_type") == kind) & (F.col("value") > least))
        out = keyed().groupBy("key").agg(when("signup", 150).alias("in_registry"), when("purchase", 150).alias("in_db"), when("error", 200).alias("retired"))
        return out.select(F.concat(F.lit("flag::"), "key").alias("id"), F.lit("Flag").alias("label"), F.col("key").alias("name"), "in_registry", "in_db", "retired", F.lit(False).alias("orphan"), F.lit(False).alias("registry_default"))

    def gates(g: TableGraph) -> DataFrame:
        hits = keyed().where("event_type = 'click' and value > 100").join(t("customer"), F.col("user_id") == F.col("c_custkey"), "left_semi")
        return edge(hits, F.concat(F.lit("flag::"), "key"), _id("func::c", "user_id"), "GATES").distinct()

    def tokens(g: TableGraph) -> DataFrame:
        return t("part").groupBy("p_name").agg(F.min("p_type").alias("value")).select(F.concat(F.lit("token::"), "p_name").alias("id"), F.lit("Token").alias("label"), F.col("p_name").alias("name"), F.concat(F.lit("--"), "p_name").alias("raw_name"), "value", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("category"))

    def dependencies(g: TableGraph) -> DataFrame:
        return t("part").groupBy("p_brand").agg(F.count("*").cast("int").alias("import_count"), F.max("p_type").alias("version")).select(F.concat(F.lit("dep::"), "p_brand").alias("id"), F.lit("Dependency").alias("label"), F.col("p_brand").alias("name"), "version", "import_count")

    def snapshots(g: TableGraph) -> DataFrame:
        days = t("events").groupBy(F.to_date("ts").cast("string").alias("captured_at")).agg(F.count("*").cast("int").alias("file_count"), F.count_distinct("user_id").cast("int").alias("function_count"), F.to_json(F.array_sort(F.collect_set(F.when(F.col("value") > 250, _id("u", "user_id"))))).alias("file_paths_json"))
        return days.select(F.concat(F.lit("snapshot::"), "captured_at").alias("id"), F.lit("Snapshot").alias("label"), "captured_at", "file_count", "function_count", "file_paths_json")

    part_id, model_id = _id("func::p", "p_partkey"), F.concat(F.lit("model::"), "p_type")
    return {
        "Function": lambda g: functions(spark, sf_dir), "File": files, "Route": routes, "Class": classes, "TypeField": fields, "Model": models, "Flag": flags, "Token": tokens, "Dependency": dependencies, "Snapshot": snapshots,
        "ModelField": lambda g: columns().select(field_id.alias("id"), F.lit("ModelField").alias("label"), F.col("p_brand").alias("name"), F.col("p_type").alias("field_type")),
        "CALLS": lambda g: calls(spark, sf_dir), "TESTS_FUNCTION": tested, "IMPORTS": imports, "GATES": gates,
        "EXPORTS": lambda g: edge(functions(spark, sf_dir).where("is_exported"), F.concat(F.lit("file::"), "file_path"), F.col("id"), "EXPORTS"),
        "HANDLES": lambda g: edge(t("customer"), _id("route::n", "c_nationkey"), _id("func::c", "c_custkey"), "HANDLES"),
        "HAS_FIELD": lambda g: edge(t("supplier"), _id("class::s", "s_suppkey"), _id("typefield::s", "s_suppkey"), "HAS_FIELD"),
        "ACCEPTS": lambda g: edge(t("lineitem"), _id("func::p", "l_partkey"), _id("class::s", "l_suppkey"), "ACCEPTS", F.col("l_returnflag").alias("param_name")).distinct(),
        "RETURNS": lambda g: edge(t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")), _id("func::p", "l_partkey"), _id("class::s", "s"), "RETURNS"),
        "HAS_MODEL_FIELD": lambda g: edge(columns(), model_id, field_id, "HAS_MODEL_FIELD"),
        "USES_MODEL": lambda g: edge(t("part"), part_id, model_id, "USES_MODEL", F.when(F.col("p_size") >= 40, "write").otherwise("read").alias("access")),
        "USES_TOKEN": lambda g: edge(t("part"), part_id, F.concat(F.lit("token::"), "p_name"), "USES_TOKEN"),
        "USES_DEPENDENCY": lambda g: edge(t("part"), part_id, F.concat(F.lit("dep::"), "p_brand"), "USES_DEPENDENCY"),
    }
