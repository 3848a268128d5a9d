"""The code graph and its queries. Every method returns a DataFrame; `to_report` is the only one that collects.

Names are looked up as name or qualified name, so one name may stand for several nodes: rows then carry the node they
belong to. Lists inside a row are sorted; list caps count what they leave out and never change counts or scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import reports
from .operators.traverse import closure, longest_chain, reach, shortest_paths, simple_cycles
from .schema import EDGES, NODES, conform, confidence, rank
from .sources.files import source_slices
from .storage import materialize

LIST_CAP = 25
#: Edge types and labels of the subgraph views.
VIEWS = {
    "impact": (["CALLS", "RENDERS", "IMPORTS", "TESTS_FUNCTION"], True),
    "call_flow": (["CALLS", "RENDERS", "PASSED_TO"], False),
    "component_tree": (["RENDERS", "CONTAINS"], False),
    "request_trace": (["HANDLES", "CALLS", "CALLS_RPC", "USES_MODEL"], False),
}


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


class CodeGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = conform(nodes, NODES), conform(edges, EDGES)

    @classmethod
    def read(cls, spark: SparkSession, path: str, repo_id: str | None = None) -> CodeGraph:
        """The tables under path; repo_id prunes to one namespace's partitions."""
        nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
        own = F.lit(True) if repo_id is None else F.col("repo_id") == repo_id
        return cls(nodes.where(own), edges.where(own))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def register(self) -> None:
        """Views for spark.sql: nodes and edges."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")

    # ------------------------------------------------------------ pieces

    def label(self, *labels: str, **columns: str) -> DataFrame:
        """Nodes of the labels; keyword arguments choose columns by new names."""
        rows = self.nodes.where(F.col("label").isin(*labels))
        return rows.select(*(F.col(old).alias(new) for new, old in columns.items())) if columns else rows

    def edge(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def named(self, name: str, *labels: str) -> DataFrame:
        rows = self.nodes.where((F.col("name") == name) | (F.col("qualified_name") == name))
        return rows.where(F.col("label").isin(*labels)) if labels else rows

    def _count_in(self, types: list[str], alias: str, labels: list[str] | None = None, distinct: bool = True) -> DataFrame:
        """(id, alias): distinct sources of edges into a node."""
        rows = self.edge(*types)
        if labels:
            rows = rows.join(self.label(*labels, src="id"), "src", "left_semi")
        return rows.groupBy(F.col("dst").alias("id")).agg((F.count_distinct("src") if distinct else F.count("*")).alias(alias))

    def _list(self, types: list[str], alias: str, key: str = "src", other: str = "dst", what: str = "name", labels: list[str] | None = None) -> DataFrame:
        """(id, alias): the sorted distinct values of a column of the nodes at the other end."""
        ends = (self.label(*labels) if labels else self.nodes).select(F.col("id").alias(other), F.col(what).alias("_v"))
        return self.edge(*types).join(ends, other).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set("_v")).alias(alias))

    def _best(self, types: list[str], key: str, other: str, alias: str) -> DataFrame:
        """(id, alias): structs (name, resolution, confidence) of the neighbours, the best label each."""
        ends = self.nodes.select(F.col("id").alias(other), F.col("qualified_name").alias("_q"))
        best = self.edge(*types).join(ends, other).where("_q is not null").groupBy(F.col(key).alias("id"), "_q").agg(F.max_by("resolution", F.struct(rank(F.col("resolution")), F.col("resolution"))).alias("resolution"))
        item = F.struct(F.col("_q").alias("name"), "resolution", confidence(rank(F.col("resolution"))).alias("confidence"))
        return best.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias(alias))

    @staticmethod
    def _with(base: DataFrame, *sides: DataFrame) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "id", "left"), sides, base)

    def _seeds(self, name: str, *labels: str) -> DataFrame:
        return self.named(name, *labels).select(F.lit(name).alias("source"), F.col("id").alias("node"))

    def _named_reach(self, found: DataFrame, labels: tuple[str, ...] = ("Function",)) -> DataFrame:
        ends = self.label(*labels, node="id", name="name", qualified_name="qualified_name", file_path="file_path")
        rows = found.join(ends, "node").select("name", "qualified_name", "file_path", "depth", confidence(F.col("rank")).alias("confidence"))
        return rows.orderBy("depth", "qualified_name")

    # ------------------------------------------------------------ entities

    def function_context(self, name: str, files: DataFrame | None = None) -> DataFrame:
        """Functions of the name with callers, callees and components; with files (path, text) their source too."""
        base = self.named(name, "Function").select("id", "qualified_name", "name", "signature", "docstring", "start_line", "end_line", "is_async", "complexity", "decorators", "visibility", "return_type", "file_path", "class_name")
        sides = [self._best(["CALLS"], "dst", "src", "callers"), self._best(["CALLS"], "src", "dst", "callees"), self._list(["RENDERS"], "renders", what="qualified_name"), self._list(["RENDERS"], "rendered_by", "dst", "src", "qualified_name")]
        rows = self._with(base, *sides)
        return (source_slices(files, rows) if files is not None else rows).orderBy("qualified_name")

    def source(self, name: str, files: DataFrame) -> DataFrame:
        """(qualified_name, file_path, start_line, end_line, source) of the functions and classes of the name."""
        spans = self.named(name, "Function", "Class").select("qualified_name", "file_path", "start_line", "end_line")
        return source_slices(files, spans).orderBy("qualified_name")

    def class_structure(self, name: str) -> DataFrame:
        base = self.named(name, "Class").select("id", "name", "qualified_name", "kind", "bases", "file_path")
        members = self.edge("CONTAINS").join(self.label("Function", dst="id", method="name", signature="signature", visibility="visibility"), "dst")
        methods = members.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("method", "signature", "visibility"))).alias("methods"))
        chain = longest_chain(self.edge("INHERITS_FROM"), base.select(F.col("id").alias("source"), F.col("id").alias("node")), 10)
        return self._with(base, methods, chain.withColumnRenamed("source", "id"))

    def file_overview(self, path: str) -> DataFrame:
        base = self.label("File").where(F.col("path") == path).select("id", "path", "language", "docstring", "line_count")
        inside = self.edge("CONTAINS").join(base.select(F.col("id").alias("src")), "src", "left_semi").join(self.nodes.withColumnRenamed("id", "dst").drop("repo_id", "type"), "dst")
        pick = lambda label, alias, *cols: inside.where(F.col("label") == label).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct(*cols))).alias(alias))
        sides = [pick("Class", "classes", "start_line", "name", "kind"), pick("Function", "functions", "start_line", "name", "signature"), pick("Import", "imports", "line", "module_path"), pick("Route", "routes", "line", "method", "path")]
        return self._with(base, *sides, self._list(["TESTS"], "tested_by", "dst", "src", "path"), self._list(["TESTS"], "tests_files", what="path"))

    def callers(self, name: str, depth: int = 2, renders: bool = False) -> DataFrame:
        return self._named_reach(reach(self.edges, self._seeds(name, "Function", "Class"), depth, ["CALLS", "RENDERS"] if renders else ["CALLS"], reverse=True))

    def callees(self, name: str, depth: int = 2) -> DataFrame:
        return self._named_reach(reach(self.edges, self._seeds(name, "Function"), depth, ["CALLS"]))

    def search(self, term: str, labels: tuple[str, ...] = ("Function", "Class", "File"), limit: int = 20) -> DataFrame:
        hit = reduce(lambda a, b: a | b, (F.coalesce(F.contains(c, F.lit(term)), F.lit(False)) for c in ("name", "qualified_name", "docstring", "path")))
        return self.label(*labels).where(hit).select("label", "name", "qualified_name", F.coalesce("file_path", "path").alias("file")).orderBy("label", "qualified_name", "file").limit(limit)

    # ------------------------------------------------------------ impact

    def impact(self, only: DataFrame | None = None) -> DataFrame:
        """Scores of every function and class at once, or of those in `only` (id), from which walks start then."""
        base = self.label("Function", "Class")
        base = base if only is None else base.join(only.select("id").distinct(), "id", "left_semi")
        base = base.select("id", "label", "name", "qualified_name", "file_path", "is_entry_point", "is_exported")
        direct = self._count_in(["CALLS", "RENDERS"], "n_callers")
        passers = self._count_in(["PASSED_TO"], "n_passers")
        routes = self._count_in(["HANDLES"], "n_routes")
        every = base.select(F.col("id").alias("source"), F.col("id").alias("node"))
        far = reach(self.edges, every, 3, ["CALLS"], reverse=True)
        places = far.join(self.label("Function", node="id", at="file_path"), "node").groupBy(F.col("source").alias("id")).agg(F.count_distinct("node").alias("n_far"), F.count_distinct("at").alias("n_files"))
        tests = self.tests_for_all(only).groupBy("id").agg(F.count_distinct("test_file").alias("n_tests"))
        rows = self._with(base, direct, passers, routes, places, tests)
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        scored = reports.impact_scores(rows, callers=_n("n_callers"), passers=_n("n_passers"), route=_n("n_routes") > 0, entry=yes("is_entry_point"), exported=yes("is_exported"), transitive=_n("n_far"), files=_n("n_files"), untested=_n("n_tests") == 0)
        return scored.select("id", "label", "name", "qualified_name", "file_path", "callers", "transitive", _n("n_files").alias("files"), _n("n_tests").alias("test_files"), "direct_score", "transitive_score", "blast", "risk")

    def impact_analysis(self, name: str) -> DataFrame:
        """(kind, item, file): what a change of the name touches."""
        seeds = self._seeds(name, "Function", "Class")
        near = self._named_reach(reach(self.edges, seeds, 1, ["CALLS", "RENDERS"], reverse=True))
        far = self._named_reach(reach(self.edges, seeds, 3, ["CALLS"], reverse=True))
        row = lambda df, kind, item, file: df.select(F.lit(kind).alias("kind"), F.col(item).alias("item"), F.col(file).alias("file"))
        routes = self.edge("HANDLES").join(seeds.select(F.col("node").alias("dst")), "dst").join(self.label("Route", src="id", method="method", path="path", file_path="file_path"), "src").withColumn("route", F.concat_ws(" ", "method", "path"))
        tests = self.tests_for(name)
        parts = [row(near, "caller", "qualified_name", "file_path"), row(near.where("confidence in ('low', 'unknown')"), "low_confidence_caller", "qualified_name", "file_path"), row(far, "transitive_caller", "qualified_name", "file_path"), row(routes, "route", "route", "file_path"), row(tests, "test", "test", "test_file")]
        found = reduce(DataFrame.unionByName, parts).distinct()
        files = found.where("kind in ('caller', 'transitive_caller') and file is not null").select(F.lit("file").alias("kind"), F.col("file").alias("item"), "file").distinct()
        return found.unionByName(files)

    def change_impact(self, name: str) -> DataFrame:
        rows = self.impact(self.named(name, "Function", "Class"))
        advice = F.when(F.col("risk").isin("critical", "high"), "review all callers before the change").when(F.col("test_files") == 0, "add tests before the change").otherwise("run the covering tests")
        return rows.withColumn("recommendation", F.format_string("%s risk, blast %.1f: %s", "risk", "blast", advice))

    def changeset_impact(self, names: list[str]) -> DataFrame:
        """(kind, item): external callers, files and tests of a set of names, those not found, and the highest risk."""
        asked = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "asked string")
        own = self.label("Function", "Class").select("id", "name", "qualified_name", "file_path")
        hit = own.join(asked, (F.col("name") == F.col("asked")) | (F.col("qualified_name") == F.col("asked")))
        ids = hit.select("id").distinct()
        callers = self.edge("CALLS", "RENDERS").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(ids, "id", "left_anti").join(own, "id")
        kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("item")).distinct()
        tests = self.tests_for_all(ids)
        order = F.create_map(*(F.lit(x) for p in {"low": 0, "medium": 1, "high": 2, "critical": 3}.items() for x in p))
        worst = self.impact(ids).agg(F.max_by("risk", F.element_at(order, F.col("risk"))).alias("risk")).where("risk is not null")
        files = callers.select("file_path").distinct().join(hit.select("file_path").distinct(), "file_path", "left_anti")
        lost = asked.join(hit.select("asked").distinct(), "asked", "left_anti")
        return reduce(DataFrame.unionByName, [kind(callers, "external_caller", "qualified_name"), kind(files, "file", "file_path"), kind(tests, "test", "test"), kind(lost, "not_found", "asked"), kind(worst, "risk", "risk")])

    # ------------------------------------------------------------ overview and health

    def repo_overview(self) -> DataFrame:
        languages = self.label("File").where("language is not null").groupBy(F.col("language").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("language").alias("part"), "kind", "n")
        calls = self._with(self.label("Function", id="id", kind="qualified_name"), self._count_in(["CALLS"], "n", distinct=False)).select(F.lit("most_called").alias("part"), "kind", _n("n").alias("n")).orderBy(F.desc("n"), "kind").limit(10)
        return reports.counts(self.nodes, self.edges).unionByName(languages).unionByName(calls)

    def graph_health(self) -> DataFrame:
        return reports.health(self.label("Function", "Class", id="id"), self.edge("CALLS", "RENDERS"))

    def coverage_ratios(self) -> DataFrame:
        """(measure, percent): functions that are tested, documented, typed, and imports that are resolved."""
        f, i = self.label("Function").where("not coalesce(is_test, false)"), self.label("Import")
        share = lambda df, name, c: df.agg(scalars.percent(F.count_if(c), F.count("*")).alias("percent")).select(F.lit(name).alias("measure"), "percent")
        return reduce(DataFrame.unionByName, [share(f, "tested", F.coalesce(F.col("tested_by_count"), F.lit(0)) > 0), share(f, "documented", F.coalesce(F.col("docstring"), F.lit("")) != ""), share(f, "typed", F.coalesce(F.col("return_type"), F.lit("")) != ""), share(i, "resolved", F.coalesce(F.col("resolved"), F.lit(False)))])

    def hubs(self, limit: int = 10) -> DataFrame:
        d = reports.degrees(self.label("Function", "Class", id="id"), self.edge("CALLS", "RENDERS"))
        return d.join(self.label("Function", "Class", id="id", qualified_name="qualified_name"), "id").orderBy(F.desc("callers"), "qualified_name").limit(limit)

    def dark_orphans(self) -> DataFrame:
        """Functions that are no entry, test or export and that nothing calls, renders, passes or routes to."""
        rows = self.label("Function").where("not coalesce(is_exported, false) and not coalesce(is_entry_point, false) and not coalesce(is_test, false)")
        used = self.edge("CALLS", "RENDERS", "PASSED_TO", "HANDLES", "USES_FIXTURE").select(F.col("dst").alias("id"))
        return rows.join(used, "id", "left_anti").select("id", "qualified_name", "file_path")

    # ------------------------------------------------------------ documents

    def docs_for(self, name: str) -> DataFrame:
        target = self.nodes.where((F.col("name") == name) | (F.col("qualified_name") == name) | (F.col("path") == name)).select(F.col("id").alias("dst"))
        parts = self.edge("REFERENCES").join(target, "dst").join(self.label("Document", "DocumentSection", src="id", label="label", heading="heading", title="title", file_path="file_path"), "src")
        return parts.select("label", F.coalesce("heading", "title").alias("heading"), "file_path").distinct()

    def doc_staleness(self, limit: int = 20) -> DataFrame:
        """Documents with references and how many of their sections have a resolved one."""
        hit = self.edge("HAS_SECTION").join(self.edge("REFERENCES").select(F.col("src").alias("dst")).distinct(), "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("live"))
        rows = self.label("Document").where("reference_count > 0").select("id", "title", "file_path", "section_count", "reference_count")
        return self._with(rows, hit).select("title", "file_path", "section_count", "reference_count", _n("live").alias("live_sections")).orderBy("live_sections", F.desc("reference_count"), "file_path").limit(limit)

    def doc_overview(self) -> DataFrame:
        kinds = self.label("Document").groupBy(F.col("doc_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("doc_type").alias("part"), "kind", "n")
        total = self.edge("REFERENCES").agg(F.count("*").alias("n")).select(F.lit("references").alias("part"), F.lit("all").alias("kind"), "n")
        top = self.edge("REFERENCES").join(self.nodes.select(F.col("id").alias("dst"), F.coalesce("qualified_name", "path", "name").alias("kind")), "dst").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(10)
        return kinds.unionByName(total).unionByName(top.select(F.lit("referenced").alias("part"), "kind", "n"))

    # ------------------------------------------------------------ routes, components, tests

    def routes(self, method: str | None = None) -> DataFrame:
        rows = self.label("Route").select("id", "method", "path", "handler_name", "has_auth", "middleware", "file_path", "line")
        if method:
            rows = rows.where(F.upper("method").isin(method.upper(), "ALL"))
        handler = self.edge("HANDLES").join(self.label("Function", "Class", dst="id", handler="qualified_name", signature="signature"), "dst").select(F.col("src").alias("id"), "handler", "signature")
        return self._with(rows, handler).orderBy("path", "method", "handler")

    def components(self, limit: int = 50, exclude_docs: bool = True) -> DataFrame:
        rows = self.label("Function").where("is_component").select("id", "qualified_name", "file_path")
        if exclude_docs:  # three-valued: files without the property drop out
            rows = rows.join(self.label("File", file_path="path", is_documentation="is_documentation").where("is_documentation <> true"), "file_path", "left_semi")
        return self._with(rows, self._count_in(["CALLS", "RENDERS"], "used_by")).select("qualified_name", "file_path", _n("used_by").alias("used_by")).orderBy(F.desc("used_by"), "qualified_name").limit(limit)

    def tests_for_all(self, only: DataFrame | None = None) -> DataFrame:
        """(id, test, test_file, via): tests of every function or class or, walking back from them, of those in `only` (id), each test once by its nearest evidence: a test
        edge, then a test's calls within 3 steps, then a test file of its file whose tests are not among those."""
        own = self.label("Function", "Class", id="id", at="file_path")
        own = own if only is None else own.join(only.select("id").distinct(), "id", "left_semi")
        tests = self.nodes.where("label = 'TestCase' or coalesce(is_test, false)").select(F.col("id").alias("src"), F.coalesce("qualified_name", "name").alias("test"), F.col("file_path").alias("test_file"))
        edge = self.edge("TESTS_FUNCTION").join(tests, "src").select(F.col("dst").alias("id"), "test", "test_file", F.lit("tests_function").alias("via"), F.lit(1).alias("priority"))
        if only is None:
            walks = reach(self.edges, tests.select(F.col("src").alias("source"), F.col("src").alias("node")), 3, ["CALLS"]).select(F.col("source").alias("src"), F.col("node").alias("id"))
        else:
            walks = reach(self.edges, own.select(F.col("id").alias("source"), F.col("id").alias("node")), 3, ["CALLS"], reverse=True).select(F.col("node").alias("src"), F.col("source").alias("id"))
        calls = walks.join(tests, "src").select("id", "test", "test_file", F.lit("calls").alias("via"), F.lit(2).alias("priority"))
        best = edge.unionByName(calls).withColumn("k", F.row_number().over(Window.partitionBy("id", "test", "test_file").orderBy("priority"))).where("k = 1").drop("k", "priority")
        files = self.label("File", f="id", path="path")
        covered = self.edge("TESTS").join(files.select(F.col("f").alias("src"), F.col("path").alias("test_file")), "src").join(files.select(F.col("f").alias("dst"), F.col("path").alias("at")), "dst").join(own, "at").select("id", F.lit(None).cast("string").alias("test"), "test_file", F.lit("file_coverage").alias("via"))
        more = covered.distinct().join(best.select("id", "test_file").distinct(), ["id", "test_file"], "left_anti")
        return best.unionByName(more).join(own.select("id"), "id", "left_semi")

    def tests_for(self, name: str) -> DataFrame:
        return self.tests_for_all(self.named(name, "Function", "Class"))

    def function_coverage(self, name: str) -> DataFrame:
        tests = self.edge("TESTS_FUNCTION").join(self.nodes.select(F.col("id").alias("src"), F.coalesce("qualified_name", "name").alias("test")), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(F.struct("depth", "test"))).alias("tests"))
        return self._with(self.named(name, "Function").select("id", "qualified_name", "complexity", "is_exported", "tested_by_count"), tests)

    def _untested(self) -> DataFrame:
        return self.label("Function").where("is_exported and not coalesce(is_test, false) and coalesce(tested_by_count, 0) = 0")

    def untested_functions(self, limit: int = 30) -> DataFrame:
        return self._untested().where("not coalesce(is_component, false)").select("qualified_name", "file_path", "complexity").orderBy(F.desc("complexity"), "qualified_name").limit(limit)

    def untested_critical(self, limit: int = 20) -> DataFrame:
        callers = self.edge("CALLS").join(self.label("Function").where("not coalesce(is_test, false)").select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
        return self._untested().join(callers, "id").select("qualified_name", "file_path", "complexity", "callers").orderBy(F.desc("callers"), F.desc("complexity"), "qualified_name").limit(limit)

    def todos(self, limit: int = 50) -> DataFrame:
        return self.label("File").where("todo_count > 0").select("path", "todo_count").orderBy(F.desc("todo_count"), "path").limit(limit)

    # ------------------------------------------------------------ flags

    def flags(self) -> DataFrame:
        """Every flag with its facts, gated files' surfaces, version family and the flags its description names."""
        gates = self.edge("GATES").join(self.label("Function", dst="id", at="file_path"), "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("gates"), F.collect_set("at").alias("paths"))
        rows = self._with(self.label("Flag").select("id", "name", "in_registry", "in_db", "retired", "orphan", "registry_default", "db_seeded_enabled", "description"), gates)
        family = scalars.family(F.col("name"))
        rows = rows.select("*", scalars.surfaces(F.coalesce("paths", F.array().cast("array<string>"))).alias("surfaces"), family.alias("family"), scalars.flag_dependencies(F.coalesce("description", F.lit("")), F.col("name")).alias("depends_on"))
        members = F.count("*").over(Window.partitionBy("family"))
        used, listed, gone = _n("gates") > 0, F.coalesce("in_registry", F.lit(False)), F.coalesce("retired", F.lit(False))
        return rows.select(
            "name", "in_registry", "in_db", "retired", "orphan", _n("gates").alias("gates"), "surfaces", F.when(members > 1, F.col("family")).alias("family"), "depends_on",
            (listed & ~used & ~gone).alias("dead"), (used & (F.size("surfaces") == 1) & F.array_contains("surfaces", "client")).alias("client_only"),
            (listed & ~F.coalesce("in_db", F.lit(False)) & ~gone & ~F.coalesce("registry_default", F.lit(True)) & used).alias("config_gap"),
        ).orderBy("name")

    def flag_gates(self, key: str) -> DataFrame:
        return self.label("Flag").where(F.col("name") == key).select(F.col("id").alias("src")).join(self.edge("GATES"), "src").join(self.label("Function", dst="id", qualified_name="qualified_name", file_path="file_path"), "dst").select("qualified_name", "file_path").distinct().orderBy("qualified_name")

    def flag_reach(self, key: str, depth: int = 3) -> DataFrame:
        """(kind, item, access): routes that reach gated code, models it uses directly or by stored functions, other flags."""
        gated = self.label("Flag").where(F.col("name") == key).select(F.col("id").alias("src")).join(self.edge("GATES"), "src").select(F.lit(key).alias("source"), F.col("dst").alias("node")).distinct()
        back = gated.select("node").unionByName(reach(self.edges, gated, depth, ["CALLS", "RENDERS"], reverse=True).select("node")).distinct()
        ahead = gated.select("node").unionByName(reach(self.edges, gated, depth, ["CALLS", "RENDERS"]).select("node")).distinct()
        routes = self.edge("HANDLES").join(back, F.col("dst") == F.col("node")).join(self.label("Route", src="id", method="method", path="path"), "src").select(F.lit("route").alias("kind"), F.concat_ws(" ", "method", "path").alias("item"), F.lit(None).cast("string").alias("access"))
        rpc = self.edge("CALLS_RPC").join(ahead, F.col("src") == F.col("node")).select(F.col("dst").alias("node"))
        uses = self.edge("USES_MODEL").join(ahead.unionByName(rpc).distinct(), F.col("src") == F.col("node")).join(self.label("Model", dst="id", item="name"), "dst")
        models = uses.groupBy("item").agg(F.max(F.coalesce("access", F.lit("read"))).alias("access")).select(F.lit("model").alias("kind"), "item", "access")  # write sorts after read
        shared = self.edge("GATES").join(gated.select(F.col("node").alias("dst")), "dst").join(self.label("Flag", src="id", item="name"), "src").where(F.col("item") != key).groupBy("item").agg(F.count_distinct("dst").alias("n"))
        return routes.distinct().unionByName(models).unionByName(shared.select(F.lit("co_gating_flag").alias("kind"), "item", F.col("n").cast("string").alias("access")))

    # ------------------------------------------------------------ conventions, services, layers, dependencies

    def conventions(self) -> DataFrame:
        """(part, kind, n): languages, methods, visibility, usual directories, most imported files, layer violations."""
        count = lambda df, part, c, k=None: (lambda r: r if k is None else r.orderBy(F.desc("n"), "kind").limit(k))(df.where(c.isNotNull()).groupBy(c.alias("kind")).agg(F.count("*").alias("n"))).select(F.lit(part).alias("part"), "kind", "n")
        f = self.label("Function")
        imported = self.edge("IMPORTS").join(self.label("File", dst="id", path="path"), "dst")
        violations = self.layer_violations().agg(F.count("*").alias("n")).select(F.lit("layer_violations").alias("part"), F.lit("all").alias("kind"), "n")
        parts = [
            count(self.label("File"), "language", F.col("language")), count(self.label("Route"), "method", F.col("method")), count(f, "visibility", F.col("visibility")),
            count(f.where("is_component"), "component_dir", scalars.directory(F.col("file_path")), 5), count(self.label("File").where("is_test_file"), "test_dir", scalars.directory(F.col("path")), 5),
            count(f.where("is_entry_point"), "entry_point", F.col("qualified_name"), 20), count(imported, "imported", F.col("path"), 10), violations,
        ]
        return reduce(DataFrame.unionByName, parts)

    def frameworks(self) -> DataFrame:
        pairs = self.spark.createDataFrame([(k, p) for k, v in scalars.FRAMEWORKS.items() for p in v], "framework string, name string")
        return self.label("Dependency").select("name").join(F.broadcast(pairs), "name").groupBy("framework").agg(F.array_sort(F.collect_set("name")).alias("packages"))

    def framework_conventions(self) -> DataFrame:
        """(convention, n) by file patterns of file-based routers and component code."""
        files = self.label("File").select("path")
        patterns = {"app_router_pages": r"(^|/)app/.*page\.[jt]sx?$", "app_router_routes": r"(^|/)app/.*route\.[jt]s$", "layouts": r"layout\.[jt]sx?$", "pages_router": r"(^|/)pages/.*\.[jt]sx?$", "middleware": r"(^|/)middleware\.[jt]s$", "hooks": r"(^|/)use[A-Z]\w*\.[jt]sx?$", "edge_functions": r"supabase/functions/", "stories": r"\.stories\.[jt]sx?$"}
        wide = files.agg(*(F.count_if(F.col("path").rlike(p)).alias(k) for k, p in patterns.items()))
        return wide.select(F.explode(F.create_map(*(x for k in patterns for x in (F.lit(k), F.col(k))))).alias("convention", "n"))

    def external_services(self) -> DataFrame:
        name = F.col("name")
        return self.label("Dependency").select("name", F.coalesce(scalars.category(name, scalars.SERVICES), F.lit("uncategorized")).alias("category"), "version").orderBy("category", "name")

    def layer_violations(self, layers: dict[str, int] | None = None) -> DataFrame:
        files = self.label("File").select("id", "path", scalars.layer(F.col("path"), layers).alias("layer")).where("layer is not null")
        side = lambda end, p: files.select(F.col("id").alias(end), F.col("path").alias(f"{p}_path"), F.col("layer").alias(f"{p}_layer"))
        rows = self.edge("IMPORTS").join(side("src", "from"), "src").join(side("dst", "to"), "dst")
        return rows.where("from_layer > to_layer + 1 and from_layer <> 0 and to_layer <> 0").select("from_path", "from_layer", "to_path", "to_layer").distinct().orderBy("from_path", "to_path")

    def dependencies(self, limit: int = 50) -> DataFrame:
        rows = self._with(self.label("Dependency").select("id", "name", "version", "import_count"), self._count_in(["USES_DEPENDENCY"], "functions"))
        return rows.select("name", "version", "import_count", _n("functions").alias("functions")).orderBy(F.desc("import_count"), "name").limit(limit)

    def dependency_users(self, name: str) -> DataFrame:
        dep = self.label("Dependency").where(F.col("name") == name).select(F.col("id").alias("dst"), "version", "latest_version", "is_outdated", "vulnerabilities")
        ends = self.nodes.select(F.col("id").alias("src"), "label", F.coalesce("qualified_name", "path").alias("user"))
        return self.edge("DEPENDS_ON", "USES_DEPENDENCY").select("src", "dst").join(dep, "dst").join(ends, "src").drop("src", "dst").distinct().orderBy("label", "user")

    def outdated_dependencies(self, severity: str = "all") -> DataFrame:
        rows = self._with(self.label("Dependency").select("id", "name", "version", "latest_version", "is_outdated", "vulnerability_count", "vulnerabilities"), self._count_in(["DEPENDS_ON"], "files"))
        risky = F.coalesce(F.col("vulnerability_count"), F.lit(0)) > 0
        rows = rows.where(F.coalesce("is_outdated", F.lit(False)) | risky)
        rows = rows.where(risky) if severity == "vulnerable" else rows.where(~risky) if severity == "safe" else rows
        return rows.withColumn("files", _n("files")).orderBy(F.desc("vulnerability_count"), "name")

    # ------------------------------------------------------------ subgraphs, paths, cycles

    def subgraph(self, view: str, centre: str | None = None, depth: int = 2, edge_types: list[str] | None = None, limit: int = 300, models_only: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a view around a centre (or its usual roots), cut to the nodes of highest degree."""
        if view not in VIEWS or isinstance(depth, bool):
            raise ValueError(f"unknown view or depth: {view}, {depth}")
        depth = max(1, min(4, int(depth)))
        types, both = VIEWS[view]
        types = [t for t in types if t in edge_types] if edge_types else types
        roots = {"request_trace": self.label("Route"), "component_tree": self.label("Function").where("is_component"), "call_flow": self.label("Function").where("is_entry_point"), "impact": self.label("Function").where("is_exported")}
        seeds = (self.nodes.where((F.col("name") == centre) | (F.col("qualified_name") == centre) | (F.col("path") == centre)) if centre else roots[view]).select(F.lit("s").alias("source"), F.col("id").alias("node")).distinct()
        walks = [seeds.select("node"), reach(self.edges, seeds, depth, types).select("node")]
        if both:
            walks.append(reach(self.edges, seeds, depth, types, reverse=True).select("node"))
        ids = materialize(reduce(DataFrame.unionByName, walks).distinct().withColumnRenamed("node", "id"))
        inside = self.edge(*types).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        if models_only:
            goal = self.label("Model", "DBFunction").join(ids, "id", "left_semi").select(F.col("id").alias("node"))
            ids = closure(inside, goal, reverse=True).withColumnRenamed("node", "id")
        nodes = self.nodes.join(ids, "id", "left_semi")
        first = self.named(centre).agg(F.min("id")).first()[0] if centre else None
        return reports.truncate(nodes, inside, limit, first, ["Route", "Model", "DBFunction"])

    def find_path(self, start: str, end: str, most: int = 5) -> DataFrame:
        ids = lambda n: self.named(n, "Function").select(F.col("id").alias("node"))
        return shortest_paths(self.edge("CALLS"), ids(start), ids(end), most)

    def import_cycles(self, most: int = 10) -> DataFrame:
        return simple_cycles(self.edge("IMPORTS"), most).orderBy("length", "cycle")

    # ------------------------------------------------------------ configuration

    def env_vars(self) -> DataFrame:
        rows = self.label("EnvVar").select("id", "name", "default_value", "required")
        return self._with(rows, self._list(["DEFINED_IN"], "defined_in", what="path"), self._list(["USES_ENV"], "used_by", "dst", "src", "path")).orderBy("name")

    def config_files(self) -> DataFrame:
        return self.label("File").where("config_type is not null").select("path", "config_type").orderBy("config_type", "path")

    def setup_requirements(self) -> DataFrame:
        """(part, item): required and optional variables, config files, and the number of dependencies."""
        env = self.env_vars().select(F.when(F.coalesce("required", F.lit(False)), "required_env").otherwise("optional_env").alias("part"), F.col("name").alias("item"))
        deps = self.label("Dependency").agg(F.count("*").cast("string").alias("item")).select(F.lit("dependencies").alias("part"), "item")
        return env.unionByName(self.config_files().select(F.lit("config").alias("part"), F.col("path").alias("item"))).unionByName(deps)

    # ------------------------------------------------------------ types

    def _fields(self) -> DataFrame:
        rows = self.edge("HAS_FIELD").join(self.label("TypeField", dst="id", field="name", annotation="type_annotation", optional="is_optional", line="line"), "dst")
        return rows.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("line", "field", "annotation", "optional"))).alias("fields"))

    def data_contract(self, name: str) -> DataFrame:
        """(role, param, type, fields) of what a function accepts and returns."""
        own = self.named(name, "Function").select(F.col("id").alias("src"))
        rows = self.edge("ACCEPTS", "RETURNS").join(own, "src").join(self.label("Class", dst="id", kind_name="qualified_name"), "dst")
        rows = rows.select(F.when(F.col("type") == "ACCEPTS", "input").otherwise("output").alias("role"), F.col("param_name").alias("param"), F.col("dst").alias("id"), F.col("kind_name").alias("type"))
        return self._with(rows, self._fields()).drop("id").orderBy("role", "param", "type")

    def type_usage(self, name: str) -> DataFrame:
        """(role, item): functions that accept or return a type, and fields whose annotation names it."""
        own = self.named(name, "Class").select(F.col("id").alias("dst"))
        by = self.edge("ACCEPTS", "RETURNS").join(own, "dst").join(self.label("Function", src="id", item="qualified_name"), "src").select(F.when(F.col("type") == "ACCEPTS", "accepted_by").otherwise("returned_by").alias("role"), "item")
        fields = self.label("TypeField").where(F.contains("type_annotation", F.lit(name))).select(F.lit("field").alias("role"), F.col("id").alias("item"))
        own_fields = self.edge("HAS_FIELD").join(own.withColumnRenamed("dst", "src"), "src").select(F.lit("own_field").alias("role"), F.col("dst").alias("item"))
        return by.unionByName(fields).unionByName(own_fields).distinct().orderBy("role", "item")

    # ------------------------------------------------------------ exports and interface

    def dead_exports(self) -> DataFrame:
        """Exported functions whose name no file imports from their file; an import without names keeps all alive. Nodes
        without is_entry_point (classes, variables) and files without is_documentation drop out: three-valued logic."""
        files = self.label("File", src="id", path="path", doc="is_documentation", test="is_test_file").where("doc <> true and not test")
        rows = self.edge("EXPORTS").select("src", "dst").join(files, "src").join(self.nodes.select(F.col("id").alias("dst"), "label", "name", "qualified_name", "is_entry_point").where("not is_entry_point"), "dst")
        asked = self.edge("IMPORTS").select(F.col("dst").alias("_file"), F.explode_outer("names").alias("_name"))
        whole = self.edge("IMPORTS").where("names is null").select(F.col("dst").alias("src")).distinct()
        named = asked.where("_name is not null").distinct()
        rows = rows.join(whole, "src", "left_anti").join(named, (F.col("src") == F.col("_file")) & (F.col("name") == F.col("_name")), "left_anti")
        return rows.select("label", "qualified_name", "path").orderBy("path", "qualified_name")

    def public_api(self, include_internal: bool = False) -> DataFrame:
        files = self.label("File", src="id", path="path", doc="is_documentation", test="is_test_file").where("doc <> true and not test")
        if not include_internal:
            files = files.where(~F.contains("path", F.lit("__")) & ~F.contains("path", F.lit("/internal/")) & ~F.contains("path", F.lit("/_")))
        ends = self.nodes.where("visibility = 'public'").select(F.col("id").alias("dst"), "label", "name", "qualified_name", (F.coalesce("docstring", F.lit("")) != "").alias("has_docs"))
        return self.edge("EXPORTS").select("src", "dst").join(files, "src").join(ends, "dst").select("label", "name", "qualified_name", "path", "has_docs").orderBy("label", "name", "path")

    # ------------------------------------------------------------ security

    def security_issues(self) -> DataFrame:
        rows = self.label("Function").where(F.size(F.coalesce("security_findings", F.array().cast("array<string>"))) > 0).select("qualified_name", "file_path", "start_line", F.explode("security_findings").alias("finding"))
        return rows.withColumn("category", F.split_part("finding", F.lit(":"), F.lit(1))).orderBy("file_path", "start_line", "finding")

    def unauthenticated_routes(self) -> DataFrame:
        handlers = self.edge("HANDLES").select(F.col("src").alias("route"), F.col("dst").alias("node"))
        fn = self.label("Function").select(F.col("id").alias("node"), "name", "qualified_name", "decorators", "calls_auth", "file_path")
        plain = self.label("Route").where(F.size(F.coalesce("middleware", F.array().cast("array<string>"))) == 0).select(F.col("id").alias("route"), "method", "path")
        guarded = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: reduce(lambda a, b: a | b, (F.contains(d, F.lit(w)) for w in scalars.AUTH_DECORATORS)))
        rows = plain.join(handlers, "route").join(fn, "node").where(~F.coalesce("calls_auth", F.lit(False)) & ~guarded)
        seeds = rows.select(F.col("node").alias("source"), "node").distinct()
        helpers = fn.where(F.coalesce("calls_auth", F.lit(False)) | F.contains(F.lower("name"), F.lit("auth"))).select("node")
        safe = reach(self.edges, seeds, 2, ["CALLS"]).join(helpers, "node", "left_semi").select(F.col("source").alias("node")).distinct()
        return rows.join(safe, "node", "left_anti").select("method", "path", "qualified_name", "file_path").orderBy("file_path", "path", "method")

    def security_overview(self) -> DataFrame:
        count = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n")
        return count(self.security_issues(), "issues").unionByName(count(self.unauthenticated_routes(), "unauthenticated_routes")).unionByName(count(self.outdated_dependencies("vulnerable"), "vulnerable_dependencies"))

    # ------------------------------------------------------------ snapshots

    def snapshot_history(self, limit: int = 20) -> DataFrame:
        return self.label("Snapshot").select("captured_at", "file_count", "function_count", "class_count", "import_total", "route_count", "test_count", "edge_count", "node_count", "file_paths_json").orderBy(F.desc("captured_at")).limit(limit)

    def changelog(self) -> DataFrame:
        """(part, kind, before, after): counts and files of the newest snapshot against the one before."""
        two = self.snapshot_history(2)
        place = F.row_number().over(Window.orderBy(F.desc("captured_at")))  # two rows
        two = two.withColumn("k", place)
        new, old = two.where("k = 1"), two.where("k = 2")
        measures = ["file_count", "function_count", "class_count", "import_total", "route_count", "test_count", "edge_count", "node_count"]
        tall = lambda df, name: df.select(F.explode(F.create_map(*(x for m in measures for x in (F.lit(m), F.col(m))))).alias("kind", name))
        counts = tall(new, "after").join(tall(old, "before"), "kind", "left").select(F.lit("count").alias("part"), "kind", F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after"))
        paths = lambda df: df.select(F.explode(F.from_json("file_paths_json", "array<string>")).alias("kind"))
        added, gone = paths(new).join(paths(old), "kind", "left_anti"), paths(old).join(paths(new), "kind", "left_anti")
        mark = lambda df, part: df.select(F.lit(part).alias("part"), "kind", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
        return counts.unionByName(mark(added, "file_added")).unionByName(mark(gone, "file_removed"))

    # ------------------------------------------------------------ data models

    def models(self, limit: int = 50) -> DataFrame:
        rows = self.label("Model").where("not coalesce(is_enum, false)").select("id", "name", "orm", "table_name", "field_count", "file_path")
        fields = self.edge("HAS_MODEL_FIELD").join(self.label("ModelField", dst="id", field="name", kind="field_type", line="line"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("line", "field", "kind"))).alias("fields"))
        related = self.edge("RELATED_TO").join(self.label("Model", dst="id", target="name"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("target", "relation_type"))).alias("relations"))
        rows = self._with(rows, fields, related).orderBy("name").limit(limit)
        return rows.withColumn("fields_omitted", F.greatest(F.size(F.coalesce("fields", F.array())) - 10, F.lit(0))).withColumn("fields", F.slice("fields", 1, 10))

    def model_detail(self, name: str) -> DataFrame:
        rows = self.label("Model").where(F.col("name") == name).select("id", "name", "orm", "table_name", "primary_key")
        fields = self.edge("HAS_MODEL_FIELD").join(self.label("ModelField", dst="id", field="name", kind="field_type", target="references_model", line="line"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("line", "field", "kind", "target"))).alias("fields"))
        return self._with(rows, fields, self._list(["RELATED_TO"], "relates_to"), self._list(["RELATED_TO"], "related_from", "dst", "src"), self._list(["USES_MODEL"], "users", "dst", "src", "qualified_name"))

    def model_relationships(self) -> DataFrame:
        return self.edge("RELATED_TO").join(self.label("Model", src="id", from_model="name"), "src").join(self.label("Model", dst="id", to_model="name"), "dst").select("from_model", "to_model", "relation_type").distinct().orderBy("from_model", "to_model", "relation_type")

    def db_functions(self) -> DataFrame:
        rows = self.label("DBFunction").select("id", "name", "args", "returns", "file_path")
        uses = self.edge("USES_MODEL").join(self.label("Model", dst="id", table="table_name"), "dst")
        by = lambda access, alias: uses.where(F.col("access") == access).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("table")).alias(alias))
        rows = self._with(rows, self._list(["CALLS_RPC"], "callers", "dst", "src", "qualified_name"), by("write", "writes_tables"), by("read", "reads_tables"))
        return rows.withColumn("n_callers", F.size(F.coalesce("callers", F.array().cast("array<string>")))).orderBy(F.desc("n_callers"), "name")

    # ------------------------------------------------------------ design tokens

    def tokens(self, category: str | None = None) -> DataFrame:
        """Tokens with their users; a token that another token refers to is not unused."""
        rows = self.label("Token").select("id", "name", "raw_name", "value", "category", "references", "file_path")
        aliased = rows.select(F.explode("references").alias("raw_name")).distinct().withColumn("aliased", F.lit(True))
        rows = self._with(rows, self._count_in(["USES_TOKEN"], "used_by")).join(aliased, "raw_name", "left")
        rows = rows.select("name", "value", "category", "file_path", _n("used_by").alias("used_by"), ((_n("used_by") == 0) & ~F.coalesce("aliased", F.lit(False))).alias("unused"))
        return (rows.where(F.col("category") == category) if category else rows).orderBy("category", "name")

    def drift(self) -> DataFrame:
        """(part, item, n): hard-coded colours (top 25), and files by their hard-coded and off-scale values (top 20)."""
        f = self.label("Function")
        colours = f.select("id", F.explode("hardcoded_colors").alias("item")).groupBy("item").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "item").limit(25)
        n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
        count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
        files = f.groupBy(F.col("file_path").alias("item")).agg(F.sum(count("hardcoded_colors") + count("off_scale_values") + F.coalesce("inline_style_count", F.lit(0))).alias("n")).where("n > 0").orderBy(F.desc("n"), "item").limit(20)
        return colours.select(F.lit("colour").alias("part"), "item", "n").unionByName(files.select(F.lit("file").alias("part"), "item", "n"))

    # ------------------------------------------------------------ reports

    def explore(self, name: str) -> DataFrame:
        """What a name is: functions, else classes, else files, else search results, as (label, qualified_name, file)."""
        hits = self.nodes.where(((F.col("name") == name) | (F.col("qualified_name") == name) | (F.col("path") == name)) & F.col("label").isin("Function", "Class", "File"))
        ranked = hits.select("label", "qualified_name", F.coalesce("file_path", "path").alias("file"), F.when(F.col("label") == "Function", 1).when(F.col("label") == "Class", 2).otherwise(3).alias("k"))
        found = self.search(name).select("label", "qualified_name", "file", F.lit(4).alias("k"))
        every = ranked.unionByName(found)
        first = every.agg(F.min("k").alias("k"))
        return every.join(F.broadcast(first), "k").drop("k").orderBy("qualified_name", "file")

    @staticmethod
    def to_report(rows: DataFrame, cap: int = LIST_CAP) -> dict[str, object]:
        """The first rows as dictionaries and how many are left out. The only call that brings rows to the driver."""
        shown = [r.asDict(recursive=True) for r in rows.limit(cap + 1).collect()]
        return {"items": shown[:cap], "omitted": rows.count() - cap if len(shown) > cap else 0}
