from arborlens.operators import links


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_dependencies_and_routes(spark):
    deps = spark.createDataFrame([("My-Lib", "1.0"), ("x", "2.0"), ("none", None)], "name string, version string")
    known = spark.createDataFrame([("my_lib", "1.1", ["A", "A"]), ("x", "2.0", [])], "name string, latest_version string, vulnerabilities array<string>")
    assert rows(links.enrich_dependencies(deps, known), "name", "is_outdated", "vulnerability_count") == [("My-Lib", True, 1), ("none", False, 0), ("x", False, 0)]
    routes = spark.createDataFrame([("1", "/api/a", "f", [], []), ("2", "/b", "g", ["requireAuth"], None), ("3", "/b", "f", None, None), ("4", "/c", "h", None, None)], "id string, path string, file_path string, middleware array<string>, decorators array<string>")
    patterns = spark.createDataFrame([("/api/*", "z"), ("*", "h")], "pattern string, file_path string")
    assert rows(links.route_auth(routes, patterns), "id", "has_auth") == [("1", True), ("2", True), ("3", False), ("4", True)]


def test_models_tokens_types(spark):
    # a chain's verb is a segment of its own; words within a method's name count for typed fields
    calls = spark.createDataFrame([("f", "db.user.get"), ("f", "db.user.update"), ("g", "user.all"), ("g", "rpc:top"), ("h", "x.user.noop"), ("h", "user.getAll")], "src string, call string")
    models = spark.createDataFrame([("m", "User", "users")], "id string, name string, table_name string")
    assert rows(links.model_edges(calls, models), "src", "access") == [("f", "write"), ("g", "read")]
    stored = spark.createDataFrame([("d1", "top", "a.sql"), ("d2", "top", "b.sql")], "id string, name string, file_path string")
    assert rows(links.rpc_edges(calls, stored), "src", "dst") == [("g", "d2")]
    bodies = spark.createDataFrame([("a.sql", "top", "users", "write"), ("b.sql", "top", "users", "read")], "path string, name string, table string, access string")
    assert rows(links.stored_function_edges(bodies, stored, models), "src", "access") == [("d2", "read")]
    classes = spark.createDataFrame([("c", "hover:bg-primary"), ("c", "p-[3px]")], "src string, name string")
    tokens = spark.createDataFrame([("t1", "color-primary"), ("t2", "primary")], "id string, name string")
    assert rows(links.token_usage(classes, tokens), "src", "dst") == [("c", "t1")]
    tree = spark.createDataFrame([("A", ["models.Model"]), ("B", ["A"]), ("C", ["B"]), ("D", ["X"])], "name string, bases array<string>")
    assert rows(links.orm_classes(tree, ["Model"]), "name") == [("A",), ("B",), ("C",)]
    own = spark.createDataFrame([("k", "User", "a::User", "a"), ("l", "Item", "b::Item", "b")], "id string, name string, qualified_name string, file_path string")
    notes = spark.createDataFrame([("f", "a", "x", "Optional[User]"), ("f", "a", None, "list[Item]"), ("f", "a", "n", "int")], "src string, file_path string, param_name string, annotation string")
    none = spark.createDataFrame([], "file_path string, name string, target string")
    assert sorted(rows(links.type_edges(notes, own, none), "dst", "type")) == [("k", "ACCEPTS"), ("l", "RETURNS")]


def test_tests_and_packages(spark):
    tests = spark.createDataFrame([("t1", "t"), ("t2", "t")], "id string, file_path string")
    functions = spark.createDataFrame([("p", "m", True), ("q", "m", False), ("r", "n", False)], "id string, file_path string, is_exported boolean")
    imports = spark.createDataFrame([("t", "m"), ("t", "n")], "file_path string, target string")
    covered = spark.createDataFrame([("t2",)], "src string")
    assert rows(links.import_coverage(tests, imports, functions, covered), "src", "dst") == [("t1", "p"), ("t1", "r")]
    calls = spark.createDataFrame([("f", "a", "requests.get"), ("f", "a", "own")], "src string, file_path string, call string")
    got = links.external_usage(calls, calls.where("call = 'own'"), spark.createDataFrame([("a", "requests", "requests"), ("a", "own", "z")], "file_path string, name string, package string"))
    assert rows(got, "src", "dst") == [("f", "dep::requests")]


def test_models_by_place_field_and_table(spark):
    models = spark.createDataFrame([("u", "User", "users"), ("o", "Order", "orders"), ("p", "Order2", "orders2")], "id string, name string, table_name string")
    calls = spark.createDataFrame(
        [("a", "order.user.create"), ("b", "db.insert(user, order)"), ("c", "self.repo.findOne"), ("c", "self.repo.softDelete"), ("d", "self.both.find"), ("e", "select.from('orders')"), ("e", "upsert.from('users')"), ("g", "select.from('user')"), ("h", "self.plain.reload"), ("i", "insert(x)")],
        "src string, call string",
    )
    fields = spark.createDataFrame([("c", "repo", "Repository[Order] | None"), ("d", "both", "dict[User, Order]"), ("h", "plain", "Order"), ("z", "repo", "User")], "src string, field string, type string")
    got = rows(links.model_edges(calls, models, fields), "src", "dst", "access")
    assert got == [("a", "o", "write"), ("b", "u", "write"), ("c", "o", "write"), ("e", "o", "read"), ("e", "u", "write")]
    assert links.model_edges(calls.limit(0), models, fields).count() == 0


def test_names_and_document_references(spark):
    entities = spark.createDataFrame(
        [("f1", "create_order", "a/svc.py::create_order", None, "a/svc.py"), ("f2", "Svc.run", "a/svc.py::Svc.run", "Svc", "a/svc.py"), ("c1", "Svc", "a/svc.py::Svc", None, "a/svc.py"), ("d1", "twice", "a/x.py::twice", None, "a/x.py"), ("d2", "twice", "b/x.py::twice", None, "b/x.py")],
        "id string, name string, qualified_name string, class_name string, file_path string",
    )
    paths = spark.createDataFrame([("src/app/main.ts",), ("a/svc.py",), ("README.md",), ("a/x.py",), ("b/x.py",)], "path string")
    refs = spark.createDataFrame(
        [("s", r, k) for r, k in [("app/main.ts", "file"), ("./src/app/main.ts#L3", "file"), ("SRC/App/Main.ts", "file"), ("src/app/main", "file"), ("x.py", "file"), ("Svc", "entity"), ("svc", "entity"), ("mod.create_order", "entity"), ("twice", "entity"), ("a/svc.py::Svc", "entity"), ("Nothing", "entity")]],
        "src string, reference string, kind string",
    )
    got = dict(rows(links.document_references(refs, entities, paths), "reference", "dst"))
    main = "file::src/app/main.ts"
    assert got == {"app/main.ts": main, "./src/app/main.ts#L3": main, "SRC/App/Main.ts": main, "src/app/main": main, "Svc": "c1", "svc": "c1", "mod.create_order": "f1", "a/svc.py::Svc": "c1"}
    asked = spark.createDataFrame([("r", "a/x.py", "twice"), ("r", "b/y.py", "create_order"), ("q", "b/y.py", "lib.guard"), ("q", "b/y.py", "twice")], "src string, file_path string, name string")
    known = spark.createDataFrame([("b/y.py", "guard", "g9")], "file_path string, name string, target string")
    assert rows(links.named_targets(asked, entities, known), "src", "name", "target") == [("q", "lib.guard", "g9"), ("r", "create_order", "f1"), ("r", "twice", "d1")]
