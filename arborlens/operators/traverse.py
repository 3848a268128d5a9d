"""Traversal operators. Reachability carries one row per (source, node) and step, not one per path: keeping the best
weakest rank per node is exact, since cutting a loop out of a walk neither lowers its weakest rank nor adds depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import rank
from ..storage import materialize

DEEP = 3  # steps planned at once; beyond, the frontier is written between steps


def ranked(edges: DataFrame, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(a, b, w): ends in walking order, weight the rank of the best parallel edge."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    weight = F.col("rank") if "rank" in edges.columns else rank(F.col("resolution")) if "resolution" in edges.columns else F.lit(0)
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def reach(edges: DataFrame, seeds: DataFrame, most: int, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(source, node, depth, rank) for nodes within `most` steps of each source's seed nodes (source, node).
    depth is the least number of steps; rank the best over all routes of the weakest edge of a route."""
    steps = ranked(edges, types, reverse)
    now = seeds.select("source", "node", F.lit(99).alias("rank")).distinct()
    found = []
    for depth in range(1, most + 1):
        now = now.join(steps, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), F.least("rank", "w").alias("rank")).groupBy("source", "node").agg(F.max("rank").alias("rank"))
        if most > DEEP:
            now = materialize(now)
            if now.isEmpty():
                break
        found.append(now.withColumn("depth", F.lit(depth)))
    if not found:
        return now.withColumn("depth", F.lit(0)).limit(0).select("source", "node", "depth", "rank")
    return reduce(DataFrame.unionByName, found).groupBy("source", "node").agg(F.min("depth").alias("depth"), F.max("rank").alias("rank"))


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """All nodes that the seeds (node) reach over any number of steps, themselves included."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    seen = now = materialize(seeds.select("node").distinct())
    turn = 0
    while True:
        now = materialize(now.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if now.isEmpty():
            return seen
        turn += 1
        seen = seen.unionByName(now) if turn % 16 else materialize(seen.unionByName(now))


def shortest_paths(edges: DataFrame, start: DataFrame, end: DataFrame, most: int = 5, limit: int = 5) -> DataFrame:
    """(hops, path): up to `limit` shortest trails (no edge twice) from a start node to an end node, in order of hops
    and path. Nodes that cannot reach an end in the steps left are cut off before they are expanded. Parallel edges are told apart
    only where they are met, so the edges themselves are neither sorted nor written; what is written are the nodes near an end and the paths."""
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    new = materialize(end.select("node").distinct())
    back = [new]
    for _ in range(most - 1):
        new = materialize(steps.join(new, F.col("node") == F.col("b")).select(F.col("a").alias("node")).distinct().join(back[-1], "node", "left_anti"))
        back.append(back[-1].unionByName(new))
    rows = start.select(F.array("node").alias("path"), F.array().cast("array<string>").alias("used"))
    found = []
    for hop in range(1, most + 1):
        rows = rows.withColumn("at", F.element_at("path", -1)).join(steps, F.col("at") == F.col("a")).withColumn("edge", F.concat_ws(">", "a", "b"))
        rows = rows.where(~F.array_contains("used", F.col("edge"))).join(back[most - hop], F.col("b") == F.col("node"), "left_semi")
        rows = materialize(rows.select(F.concat("path", F.array("b")).alias("path"), F.concat("used", F.array("edge")).alias("used")).distinct())
        found.append(rows.join(back[0], F.element_at("path", -1) == F.col("node"), "left_semi").select(F.lit(hop).alias("hops"), "path"))
    return reduce(DataFrame.unionByName, found).orderBy("hops", "path").limit(limit)


def simple_cycles(edges: DataFrame, most: int = 10) -> DataFrame:
    """(length, cycle): every cycle without a repeated node once, from its least node on. Paths start at their least
    node and never pass a smaller one, and nodes off every cycle are trimmed first."""
    steps = materialize(ranked(edges).select("a", "b"))
    core = steps.where("a <> b")
    for _ in range(2 * most):
        kept = core.join(core.select(F.col("b").alias("x")).distinct(), F.col("a") == F.col("x"), "left_semi")
        kept = materialize(kept.join(kept.select(F.col("a").alias("x")).distinct(), F.col("b") == F.col("x"), "left_semi"))
        if kept.count() == core.count():
            break
        core = kept
    found = [steps.where("a = b").select(F.lit(1).alias("length"), F.array("a").alias("cycle"))]
    paths = core.where("b > a").select(F.array("a", "b").alias("path"))
    for length in range(2, most + 1):
        ends = paths.select("path", F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))
        found.append(ends.join(core, (F.col("last") == F.col("a")) & (F.col("first") == F.col("b"))).select(F.lit(length).alias("length"), F.col("path").alias("cycle")))
        if length < most:
            grown = ends.join(core, F.col("last") == F.col("a")).where((F.col("b") > F.col("first")) & ~F.array_contains("path", F.col("b")))
            paths = grown.select(F.concat("path", F.array("b")).alias("path"))
            if length >= DEEP:
                paths = materialize(paths)
                if paths.isEmpty():
                    break
    return reduce(DataFrame.unionByName, found)


def longest_chain(edges: DataFrame, seeds: DataFrame, most: int = 10) -> DataFrame:
    """(source, chain): the longest trail from each source along the edges, at most `most` steps; the source alone if
    there is none; the least in order of its nodes if there are several."""
    steps = ranked(edges).select("a", "b")
    rows = seeds.select("source", F.array("node").alias("chain"))
    found = [rows]
    for _ in range(most):
        at = rows.withColumn("at", F.element_at("chain", -1)).join(steps, F.col("at") == F.col("a"))
        rows = materialize(at.where(~F.array_contains("chain", F.col("b"))).select("source", F.concat("chain", F.array("b")).alias("chain")))
        if rows.isEmpty():
            break
        found.append(rows)
    every = reduce(DataFrame.unionByName, found)
    best = every.groupBy("source").agg(F.min_by("chain", F.struct(-F.size("chain"), F.col("chain"))).alias("chain"))
    return best
