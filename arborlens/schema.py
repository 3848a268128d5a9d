"""Data model: one node frame and one edge frame, namespaced by repo_id; properties are nullable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

_STRINGS = """name qualified_name file_path path language docstring react_directive config_type signature visibility return_type
kind module_path method handler_name block_type parent_describe value_kind title doc_type heading version latest_version checked_at
default_value orm table_name primary_key field_type db_type references_model references_field returns schema description raw_name value
category source_kind type_annotation captured_at file_paths_json class_name""".split()
_INTS = """line line_count todo_count start_line end_line complexity security_finding_count tested_by_count inline_style_count parametrize_count
section_count reference_count level import_count vulnerability_count field_count arg_count gates_count file_count function_count class_count
import_total route_count test_count edge_count node_count""".split()
_BOOLS = """is_test_file is_documentation is_exported is_test is_fixture is_component is_entry_point is_async is_callback calls_auth is_abstract
is_optional is_relative resolved has_auth is_outdated required is_enum is_junction is_unique is_nullable is_primary is_foreign is_indexed has_default
in_registry in_db retired orphan registry_default db_seeded_enabled""".split()
_LISTS = "decorators security_findings raises catches hardcoded_colors off_scale_values bases permission_classes imported_names middleware vulnerabilities args references calls parameters".split()

NODES = T.StructType(
    [T.StructField("repo_id", T.StringType()), T.StructField("id", T.StringType()), T.StructField("label", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _STRINGS]
    + [T.StructField(c, T.IntegerType()) for c in _INTS]
    + [T.StructField(c, T.BooleanType()) for c in _BOOLS]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS]
)
EDGES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("repo_id", "src", "dst", "type", "resolution", "context", "access", "param_name", "relation_type")]
    + [T.StructField("depth", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType()))]
)

# Ranks of resolution labels, and the least rank of each confidence.
RESOLUTION_RANKS = {"exact": 6, "file_scoped": 5, "typed_receiver": 5, "import": 4, "dotted": 4, "same_file": 3, "unique_global": 2}
CONFIDENCE = ((5, "high"), (4, "medium"), (2, "low"))

# Labels of the nodes by the prefix of their ids.
LABEL_OF_PREFIX = {
    "file": "File", "func": "Function", "class": "Class", "typefield": "TypeField", "import": "Import", "route": "Route", "testcase": "TestCase",
    "var": "Variable", "doc": "Document", "docsec": "DocumentSection", "dep": "Dependency", "envvar": "EnvVar", "model": "Model", "mf": "ModelField",
    "dbfunc": "DBFunction", "flag": "Flag", "token": "Token",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema; missing ones are null."""
    have = set(df.columns)
    return df.selectExpr(*(f"cast({f'`{f.name}`' if f.name in have else 'null'} as {f.dataType.simpleString()}) as `{f.name}`" for f in schema))


def rank(resolution: Column) -> Column:
    out = F.lit(0)
    for label, value in RESOLUTION_RANKS.items():
        out = F.when(resolution == label, F.lit(value)).otherwise(out)
    return out


def confidence(value: Column) -> Column:
    out = F.lit("unknown")
    for least, label in reversed(CONFIDENCE):
        out = F.when(value >= least, F.lit(label)).otherwise(out)
    return out


def label_of(node_id: Column) -> Column:
    prefix = F.split_part(node_id, F.lit("::"), F.lit(1))
    pairs = [x for k, v in LABEL_OF_PREFIX.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), prefix)
