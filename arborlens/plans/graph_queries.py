"""Registered queries that call the methods of CodeGraph on the tables' projection as code, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cascade import coverage_edges
from .code_projection import SQL, calls, code_graph, functions
from .queries import query

_LABEL = "CASE WHEN rank >= 5 THEN 'high' WHEN rank >= 4 THEN 'medium' WHEN rank >= 2 THEN 'low' ELSE 'unknown' END"
_NAMES = "CASE rank WHEN 6 THEN 'exact' WHEN 5 THEN 'file_scoped' WHEN 4 THEN 'import' WHEN 3 THEN 'same_file' WHEN 2 THEN 'unique_global' END"
_WALK = """,
w1 AS (SELECT dst AS id, src AS node, rank FROM ca),
w2 AS (SELECT w1.id, ca.src AS node, max(least(w1.rank, ca.rank)) AS rank FROM w1 JOIN ca ON ca.dst = w1.node GROUP BY 1, 2),
wa AS (SELECT id, node, min(depth) AS depth, max(rank) AS rank FROM (SELECT *, 1 AS depth FROM w1 UNION ALL SELECT *, 2 FROM w2) GROUP BY 1, 2)"""
_IMPACT = _WALK + """,
te AS (SELECT id, file_path AS test_file FROM fn WHERE is_test),
ft AS (SELECT ts.dst AS id, te.test_file FROM ts JOIN te ON te.id = ts.src UNION SELECT wa.id, te.test_file FROM wa JOIN te ON te.id = wa.node),
pc AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM ca GROUP BY 1), ph AS (SELECT DISTINCT dst AS id, 20 AS route FROM ha),
pf AS (SELECT wa.id, count(DISTINCT node) AS far, count(DISTINCT file_path) AS files FROM wa JOIN fn ON fn.id = wa.node GROUP BY 1),
pt AS (SELECT id, count(DISTINCT test_file) AS test_files FROM ft GROUP BY 1),
al AS (SELECT id, 'Function' AS label, name, qualified_name, file_path, is_exported FROM fq UNION ALL SELECT 'class::s' || s_suppkey, 'Class', s_name, s_name, NULL, NULL FROM supplier),
sc AS (SELECT al.id, label, name, qualified_name, file_path, coalesce(callers, 0) AS callers, coalesce(far, 0) AS transitive, coalesce(files, 0) AS files, coalesce(test_files, 0) AS test_files,
  least(100, least(5 * coalesce(callers, 0), 40) + coalesce(route, 0) + CASE WHEN is_exported THEN 5 ELSE 0 END) AS direct_score,
  least(100, least(2 * coalesce(far, 0), 50) + least(5 * coalesce(files, 0), 30) + CASE WHEN coalesce(test_files, 0) = 0 THEN 20 ELSE 0 END) AS transitive_score
  FROM al LEFT JOIN pc USING (id) LEFT JOIN ph USING (id) LEFT JOIN pf USING (id) LEFT JOIN pt USING (id)),
sb AS (SELECT *, round(0.6::DOUBLE * direct_score + 0.4::DOUBLE * transitive_score, 1) AS blast FROM sc),
sr AS (SELECT *, CASE WHEN blast >= 85 THEN 'critical' WHEN blast >= 60 THEN 'high' WHEN blast >= 30 THEN 'medium' ELSE 'low' END AS risk FROM sb)"""
_SCORES = "id, label, name, qualified_name, file_path, callers, transitive, files, test_files, direct_score, transitive_score, blast, risk"


@query(f"WITH {SQL}{_IMPACT} SELECT {_SCORES} FROM sr")
def impact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).impact()


@query(f"""WITH {SQL}{_IMPACT} SELECT {_SCORES}, format('{{}} risk, blast {{:.1f}}: {{}}', risk, blast, CASE WHEN risk IN ('critical', 'high') THEN 'review all callers before the change' WHEN test_files = 0 THEN 'add tests before the change' ELSE 'run the covering tests' END) AS recommendation FROM sr WHERE name = 'p1'""")
def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).change_impact("p1")


@query(f"""WITH {SQL}{_IMPACT}, ch AS (SELECT * FROM fq WHERE name IN ('p1', 'p2', 'o1')),
xc AS (SELECT DISTINCT f.qualified_name, f.file_path FROM ca JOIN ch ON ch.id = ca.dst JOIN fq f ON f.id = ca.src WHERE f.id NOT IN (SELECT id FROM ch)),
xt AS (SELECT t.qualified_name FROM ts JOIN ch ON ch.id = ts.dst JOIN fq t ON t.id = ts.src UNION SELECT t.qualified_name FROM wa JOIN ch ON ch.id = wa.id JOIN fq t ON t.id = wa.node AND t.is_test)
SELECT 'external_caller' AS kind, qualified_name AS item FROM xc UNION ALL SELECT DISTINCT 'file', file_path FROM xc WHERE file_path NOT IN (SELECT file_path FROM ch)
UNION ALL SELECT 'test', qualified_name FROM xt UNION ALL SELECT 'not_found', 'nope'
UNION ALL SELECT 'risk', arg_max(risk, list_position(['low', 'medium', 'high', 'critical'], risk)) FROM sr WHERE id IN (SELECT id FROM ch)""")
def changeset_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).changeset_impact(["p1", "p2", "o1", "nope"])


@query(f"WITH {SQL}{_WALK} SELECT f.name, f.qualified_name, f.file_path, CAST(depth AS INTEGER) AS depth, {_LABEL} AS confidence FROM wa JOIN fq f ON f.id = wa.node WHERE wa.id = 'func::p1'")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).callers("p1", 2)


@query(f"WITH {SQL}{_WALK} SELECT f.name, f.qualified_name, f.file_path, CAST(depth AS INTEGER) AS depth, {_LABEL} AS confidence FROM wa JOIN fq f ON f.id = wa.id WHERE wa.node = 'func::c1'")
def callees_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).callees("c1", 3)


@query(f"""WITH {SQL} SELECT 'caller' AS side, f.qualified_name AS name, {_NAMES} AS resolution, {_LABEL} AS confidence FROM ca JOIN fq f ON f.id = ca.src WHERE ca.dst = 'func::o1'
UNION ALL SELECT 'callee', f.qualified_name, {_NAMES}, {_LABEL} FROM ca JOIN fq f ON f.id = ca.dst WHERE ca.src = 'func::o1'""")
def function_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = code_graph(spark, sf_dir).function_context("o1")
    side = lambda c, name: row.select(F.lit(name).alias("side"), F.explode(c).alias("x")).select("side", "x.*")
    return side("callers", "caller").unionByName(side("callees", "callee"))


@query(f"""WITH {SQL}, nn AS (SELECT 'Function' AS kind, count(*) AS n FROM fn UNION ALL SELECT 'File', count(DISTINCT file_path) FROM fn UNION ALL SELECT 'Route', count(*) FROM ro UNION ALL SELECT 'Class', count(*) FROM supplier UNION ALL SELECT 'TypeField', count(*) FROM supplier
 UNION ALL SELECT 'Model', count(DISTINCT p_type) FROM part UNION ALL SELECT 'ModelField', count(DISTINCT p_type || p_brand) FROM part UNION ALL SELECT 'Flag', count(*) FROM fg UNION ALL SELECT 'Token', count(DISTINCT p_name) FROM part UNION ALL SELECT 'Dependency', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'Snapshot', count(DISTINCT CAST(ts AS DATE)) FROM events),
ee AS (SELECT 'CALLS' AS kind, count(*) AS n FROM ca UNION ALL SELECT 'TESTS_FUNCTION', count(*) FROM ts UNION ALL SELECT 'IMPORTS', count(*) FROM im UNION ALL SELECT 'EXPORTS', count(*) FROM fn WHERE is_exported UNION ALL SELECT 'HANDLES', count(*) FROM ha UNION ALL SELECT 'HAS_FIELD', count(*) FROM supplier
 UNION ALL SELECT 'ACCEPTS', count(DISTINCT l_partkey || '-' || l_suppkey || l_returnflag) FROM lineitem UNION ALL SELECT 'RETURNS', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'HAS_MODEL_FIELD', count(DISTINCT p_type || p_brand) FROM part UNION ALL SELECT 'USES_MODEL', count(*) FROM us UNION ALL SELECT 'GATES', count(*) FROM ga UNION ALL SELECT 'USES_TOKEN', count(*) FROM part UNION ALL SELECT 'USES_DEPENDENCY', count(*) FROM part)
SELECT 'node' AS part, kind, n FROM nn WHERE n > 0 UNION ALL SELECT 'edge', kind, n FROM ee WHERE n > 0 UNION ALL SELECT 'language', 'python', count(DISTINCT file_path) FROM fn
UNION ALL SELECT * FROM (SELECT 'most_called', qualified_name, count(ca.src) AS n FROM fq LEFT JOIN ca ON ca.dst = fq.id GROUP BY qualified_name ORDER BY n DESC, qualified_name LIMIT 10)""")
def top_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).repo_overview()


@query(f"""WITH {SQL}, im2 AS MATERIALIZED (SELECT * FROM im), wide AS (SELECT DISTINCT dst FROM im2 WHERE names IS NULL), asked AS MATERIALIZED (SELECT DISTINCT dst, n FROM (SELECT dst, unnest(names) AS n FROM im2))
SELECT 'Function' AS label, qualified_name, file_path AS path FROM fq ANTI JOIN wide ON wide.dst = fq.file_path ANTI JOIN asked ON asked.dst = fq.file_path AND asked.n = fq.name WHERE is_exported""")
def dead_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).dead_exports()


@query(f"WITH {SQL} SELECT 'Function' AS label, name, qualified_name, file_path AS path, docstring <> '' AS has_docs FROM fq WHERE is_exported")
def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).public_api()


@query(f"WITH {SQL} SELECT id, qualified_name, file_path FROM fq WHERE NOT is_exported AND NOT is_test AND id NOT IN (SELECT dst FROM ca UNION SELECT dst FROM ha)")
def dark_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).dark_orphans()


@query(f"""WITH {SQL}, cl AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM ca WHERE src NOT IN (SELECT id FROM fn WHERE is_test) GROUP BY 1)
SELECT qualified_name, file_path, complexity, callers FROM fq JOIN cl USING (id) LEFT JOIN tb USING (id) WHERE is_exported AND NOT is_test AND tested_by IS NULL ORDER BY callers DESC, complexity DESC, qualified_name LIMIT 20""")
def untested_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).untested_critical()


@query(f"WITH {SQL} SELECT qualified_name, file_path, complexity FROM fq LEFT JOIN tb USING (id) WHERE is_exported AND NOT is_test AND NOT is_component AND tested_by IS NULL ORDER BY complexity DESC NULLS LAST, qualified_name LIMIT 30")
def untested_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).untested_functions()


@query(f"""WITH {SQL}{_WALK}, te AS (SELECT * FROM fq WHERE is_test), a AS (SELECT DISTINCT ts.dst AS id, te.qualified_name AS test, te.file_path AS test_file, 1 AS k FROM ts JOIN te ON te.id = ts.src UNION ALL SELECT DISTINCT wa.id, te.qualified_name, te.file_path, 2 FROM wa JOIN te ON te.id = wa.node)
SELECT id, test, test_file, CASE min(k) WHEN 1 THEN 'tests_function' ELSE 'calls' END AS via FROM a GROUP BY 1, 2, 3""")
def coverage_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).tests_for_all()


@query(f"""WITH {SQL}, one AS (SELECT src, dst FROM ts), two AS (SELECT DISTINCT one.src, ca.dst FROM one JOIN ca ON ca.src = one.dst JOIN fn ON fn.id = ca.dst AND NOT is_test)
SELECT src, dst, 1 AS depth FROM one UNION ALL SELECT src, dst, 2 FROM two WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.src = two.src AND one.dst = two.dst)""")
def test_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = functions(spark, sf_dir)
    return coverage_edges(calls(spark, sf_dir), own.where("is_test").select("id"), own.select("id"))


@query(f"""WITH {SQL}, f AS (SELECT fq.*, tested_by FROM fq LEFT JOIN tb USING (id) WHERE NOT is_test)
SELECT 'tested' AS measure, round(100.0::DOUBLE * count(*) FILTER (WHERE tested_by > 0) / count(*), 1) AS percent FROM f UNION ALL SELECT 'documented', round(100.0::DOUBLE * count(*) FILTER (WHERE docstring <> '') / count(*), 1) FROM f
UNION ALL SELECT 'typed', round(100.0::DOUBLE * count(*) FILTER (WHERE return_type <> '') / count(*), 1) FROM f UNION ALL SELECT 'resolved', NULL""")
def coverage_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).coverage_ratios()


@query(f"""WITH {SQL}, i AS (SELECT dst AS id, count(*) AS callers FROM ca GROUP BY 1), o AS (SELECT src AS id, count(*) AS callees FROM ca GROUP BY 1)
SELECT id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, qualified_name FROM fq LEFT JOIN i USING (id) LEFT JOIN o USING (id) ORDER BY callers DESC, qualified_name LIMIT 10""")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).hubs()


@query(f"""WITH {SQL}, la AS (SELECT DISTINCT file_path AS path, CASE split_part(file_path, '/', 2) WHEN 'handlers' THEN 3 WHEN 'services' THEN 2 WHEN 'db' THEN 1 END AS layer FROM fn)
SELECT DISTINCT a.path AS from_path, a.layer AS from_layer, b.path AS to_path, b.layer AS to_layer FROM im JOIN la a ON a.path = im.src JOIN la b ON b.path = im.dst WHERE a.layer > b.layer + 1""")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).layer_violations()


@query(f"WITH {SQL} SELECT 'Function' AS label, name, qualified_name, file_path AS file FROM fq WHERE contains(docstring, 'ring') ORDER BY qualified_name, file LIMIT 20")
def search_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).search("ring", ("Function",))


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag AS param FROM lineitem WHERE l_partkey = 1), b AS (SELECT min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_partkey = 1)
SELECT 'input' AS role, param, s_name AS type, 'nation:Nation_' || s_nationkey AS fields FROM a JOIN supplier ON s_suppkey = l_suppkey UNION ALL SELECT 'output', NULL, s_name, 'nation:Nation_' || s_nationkey FROM b JOIN supplier ON s_suppkey = l_suppkey""")
def data_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_graph(spark, sf_dir).data_contract("p1")
    return rows.withColumn("fields", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["field"], f["annotation"])), ","))


@query(f"""WITH {SQL}, s AS (SELECT s_suppkey FROM supplier WHERE s_name = 'Supplier#000000001'), r AS (SELECT l_partkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1)
SELECT DISTINCT 'accepted_by' AS role, qualified_name AS item FROM lineitem JOIN s ON s_suppkey = l_suppkey JOIN fq ON id = 'func::p' || l_partkey UNION ALL SELECT 'returned_by', qualified_name FROM r JOIN s ON s_suppkey = k JOIN fq ON id = 'func::p' || l_partkey
UNION ALL SELECT 'own_field', 'typefield::s' || s_suppkey FROM s""")
def type_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).type_usage("Supplier#000000001")


@query("""WITH b AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS k FROM (SELECT DISTINCT p_type, p_brand FROM part))
SELECT p_type AS name, lower(p_type) AS table_name, CAST(count(*) AS INTEGER) AS field_count, CAST(greatest(count(*) - 10, 0) AS INTEGER) AS fields_omitted, string_agg(p_brand, ',' ORDER BY p_brand) FILTER (WHERE k <= 10) AS fields FROM b GROUP BY p_type ORDER BY name LIMIT 50""")
def models_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = code_graph(spark, sf_dir).models()
    return rows.select("name", "table_name", "field_count", "fields_omitted", F.array_join(F.col("fields")["field"], ",").alias("fields"))


@query(f"""WITH {SQL}, c AS (SELECT key, count(*) AS gates FROM ga GROUP BY 1), x AS (SELECT fg.*, coalesce(gates, 0) AS gates FROM fg LEFT JOIN c USING (key))
SELECT key AS name, in_registry, in_db, retired, false AS orphan, gates, CASE WHEN gates > 0 THEN 'client' ELSE '' END AS surfaces, in_registry AND gates = 0 AND NOT retired AS dead, gates > 0 AS client_only, in_registry AND NOT in_db AND NOT retired AND gates > 0 AS config_gap FROM x""")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).flags().drop("family", "depends_on").withColumn("surfaces", F.array_join("surfaces", ","))


@query(f"WITH {SQL} SELECT DISTINCT qualified_name, file_path FROM ga JOIN fq ON fq.id = ga.dst WHERE key = 'K_7'")
def flag_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).flag_gates("K_7")


@query(f"""WITH {SQL}{_WALK}, g AS (SELECT dst AS node FROM ga WHERE key = 'K_7'), ah AS (SELECT node FROM g UNION SELECT wa.id FROM g JOIN wa ON wa.node = g.node)
SELECT DISTINCT 'route' AS kind, method || ' ' || path AS item, NULL AS access FROM g JOIN ha ON ha.dst = g.node JOIN ro ON ro.id = ha.src
UNION ALL SELECT 'model', model, max(access) FROM us JOIN ah ON ah.node = us.src GROUP BY 2 UNION ALL SELECT 'co_gating_flag', key, CAST(count(DISTINCT dst) AS VARCHAR) FROM ga JOIN g ON g.node = ga.dst WHERE key <> 'K_7' GROUP BY 2""")
def flag_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).flag_reach("K_7")


@query(f"WITH {SQL} SELECT method, path, qualified_name AS handler FROM ro JOIN ha ON ha.src = ro.id JOIN fq ON fq.id = ha.dst")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).routes().select("method", "path", "handler")


@query(f"""WITH {SQL} SELECT method, path, qualified_name, file_path FROM ro JOIN ha ON ha.src = ro.id JOIN fq ON fq.id = ha.dst WHERE NOT guarded AND NOT calls_auth
AND NOT EXISTS (SELECT 1 FROM ca JOIN fn h ON h.id = ca.dst WHERE ca.src = fq.id AND h.calls_auth)""")
def unauthenticated_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).unauthenticated_routes()


@query("SELECT p_name AS name, min(p_type) AS value, split_part(p_name, ' ', 1) AS category, NULL::VARCHAR AS file_path, count(*) AS used_by, false AS unused FROM part GROUP BY p_name")
def design_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).tokens()


@query("SELECT p_brand AS name, max(p_type) AS version, CAST(count(*) AS INTEGER) AS import_count, count(*) AS functions FROM part GROUP BY p_brand ORDER BY import_count DESC, name LIMIT 50")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).dependencies()


@query(f"""WITH {SQL} SELECT 'Function' AS label, qualified_name AS user, (SELECT max(p_type) FROM part WHERE p_brand = 'Brand#1') AS version FROM fq WHERE file_path = 'src/db/Brand#1.py'""")
def dependency_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).dependency_users("Brand#1").select("label", "user", "version")


@query(f"WITH {SQL} SELECT qualified_name, file_path, count(DISTINCT ca.src) AS used_by FROM fq LEFT JOIN ca ON ca.dst = fq.id WHERE is_component GROUP BY 1, 2 ORDER BY used_by DESC, qualified_name LIMIT 50")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).components()


@query("""WITH d AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS files, count(DISTINCT user_id) AS functions, coalesce(list(DISTINCT 'u' || user_id) FILTER (WHERE value > 250), []) AS paths FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM d), a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k = 2),
p AS (SELECT unnest(paths) AS kind FROM a), q AS (SELECT unnest(paths) AS kind FROM b)
SELECT 'count' AS part, kind, before, after FROM (SELECT 'file_count' AS kind, (SELECT CAST(files AS VARCHAR) FROM b) AS before, CAST(files AS VARCHAR) AS after FROM a UNION ALL SELECT 'function_count', (SELECT CAST(functions AS VARCHAR) FROM b), CAST(functions AS VARCHAR) FROM a
 UNION ALL SELECT unnest(['class_count', 'import_total', 'route_count', 'test_count', 'edge_count', 'node_count']), NULL, NULL FROM a)
UNION ALL SELECT 'file_added', kind, NULL, NULL FROM p WHERE kind NOT IN (SELECT kind FROM q) UNION ALL SELECT 'file_removed', kind, NULL, NULL FROM q WHERE kind NOT IN (SELECT kind FROM p)""")
def changelog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_graph(spark, sf_dir).changelog()
