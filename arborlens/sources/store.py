"""Graph tables: partitioned by namespace, written whole or per file, with snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..operators.cascade import keep_best_edges
from ..schema import EDGES, NODES, conform
from ..storage import materialize

KEPT_SNAPSHOTS = 20


def first_nodes(nodes: DataFrame, order: str = "label") -> DataFrame:
    """One node per (repo_id, id): the first in order."""
    place = F.row_number().over(Window.partitionBy("repo_id", "id").orderBy(order, F.xxhash64(*nodes.columns)))
    return nodes.withColumn("_k", place).where("_k = 1").drop("_k")


def live_edges(edges: DataFrame, nodes: DataFrame, merge: bool = False) -> DataFrame:
    """Edges whose both ends are nodes of their repository; merged ones are unique per (src, type, dst)."""
    ids = nodes.select("repo_id", "id").distinct()
    rows = edges.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")
    return rows.dropDuplicates(["repo_id", "src", "type", "dst"]) if merge else rows


def write(graph: CodeGraph, path: str) -> None:
    """Replaces the partitions of the graph's namespaces only."""
    nodes = first_nodes(graph.nodes)
    for name, rows, by in (("nodes", nodes, ["repo_id", "label"]), ("edges", live_edges(graph.edges, nodes), ["repo_id", "type"])):
        rows.repartition(*by).sortWithinPartitions("id" if name == "nodes" else "src").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{name}")


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, nodes, captured_at): namespaces with the time of their newest snapshot."""
    nodes = spark.read.parquet(f"{path}/nodes")
    return nodes.groupBy("repo_id").agg(F.count("*").alias("nodes"), F.max("captured_at").alias("captured_at")).orderBy("repo_id")


def drop(spark: SparkSession, path: str, repo_id: str) -> None:
    """Removes a namespace's partitions through the file system that holds them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in ("nodes", "edges"):
        target = hadoop.Path(f"{path}/{name}/repo_id={repo_id}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def without_files(graph: CodeGraph, paths: DataFrame) -> CodeGraph:
    """The graph without the nodes of the given files (path) and the edges that touch them."""
    gone = paths.select(F.col("path").alias("_p")).distinct()
    nodes = graph.nodes.join(gone, F.coalesce("file_path", "path") == F.col("_p"), "left_anti")
    dead = graph.nodes.join(gone, F.coalesce("file_path", "path") == F.col("_p"), "left_semi").select("id")
    edges = graph.edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return CodeGraph(materialize(nodes), materialize(edges))


def with_snapshot(graph: CodeGraph, repo_id: str, captured_at: str, keep: int = KEPT_SNAPSHOTS) -> CodeGraph:
    """The graph with a Snapshot node of its counts and file list; the newest `keep` stay."""
    n = lambda label: F.count_if(F.col("label") == label).cast("int")
    counts = graph.nodes.where("label <> 'Snapshot'").agg(
        n("File").alias("file_count"), n("Function").alias("function_count"), n("Class").alias("class_count"), n("Import").alias("import_total"), n("Route").alias("route_count"), n("TestCase").alias("test_count"), F.count("*").cast("int").alias("node_count"),
        F.to_json(F.array_sort(F.collect_set(F.when(F.col("label") == "File", F.col("path"))))).alias("file_paths_json"),
    )
    row = counts.withColumn("edge_count", F.lit(graph.edges.count()).cast("int")).withColumn("repo_id", F.lit(repo_id)).withColumn("label", F.lit("Snapshot")).withColumn("captured_at", F.lit(captured_at)).withColumn("id", F.concat(F.lit("snapshot::"), F.lit(captured_at)))
    every = graph.nodes.unionByName(conform(row, NODES))
    place = F.row_number().over(Window.partitionBy("repo_id", "label").orderBy(F.desc("captured_at")))
    old = every.where("label = 'Snapshot'").withColumn("_k", place).where(F.col("_k") > keep).select("id")
    return CodeGraph(materialize(every.join(old, "id", "left_anti")), graph.edges)


def apply_changes(graph: CodeGraph, changes: DataFrame, build, repo_id: str) -> CodeGraph:
    """The graph after a batch of changed files (path, op, language, config_type, text): their nodes are replaced, and
    edges into them that still have both ends are kept. build makes a graph of file rows."""
    old = without_files(graph, changes)
    fresh = build(changes.where("op <> 'delete'").select("path", "language", "config_type", "text"), repo_id)
    nodes = materialize(old.nodes.unionByName(fresh.nodes))
    into = graph.edges.join(fresh.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(fresh.nodes.select(F.col("id").alias("src")), "src", "left_anti")
    edges = live_edges(old.edges.unionByName(fresh.edges).unionByName(into.select(*graph.edges.columns)), nodes)
    return CodeGraph(nodes, materialize(edges.dropDuplicates(["repo_id", "src", "type", "dst"])))


def html(nodes: DataFrame, edges: DataFrame, title: str) -> str:
    """A page that holds a subgraph as data; for subgraphs cut to a limit."""
    data = {"nodes": [r.asDict() for r in nodes.select("id", "label", "name").collect()], "edges": [r.asDict() for r in edges.select("src", "dst", "type").collect()]}
    body = json.dumps(data, sort_keys=True).replace("</", "<\\/")
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!doctype html><meta charset=utf-8><title>{safe}</title><h1>{safe}</h1><script type='application/json' id='graph'>{body}</script>"


__all__ = ["EDGES", "NODES", "apply_changes", "drop", "first_nodes", "html", "keep_best_edges", "live_edges", "repositories", "with_snapshot", "without_files", "write"]
