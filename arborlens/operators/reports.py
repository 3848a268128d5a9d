"""Report operators over node and edge frames. Sides are aggregated before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, percent
from ..schema import confidence
from .temporal import rollup_totals


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): nodes per label and edges per type."""
    by = lambda df, part, kind: df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return by(nodes, "node", "label").unionByName(by(edges, "edge", "type"))


def neighbours(nodes: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """Per node its first `most` callers and callees in order, with confidence, and how many are left out."""

    def side(key: str, other: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy(other))
        rows = edges.select(F.col(key).alias("id"), F.concat_ws("=", F.col(other), confidence(F.col("rank"))).alias("text"), place.alias("k"))
        shown = rows.where(F.col("k") <= most).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "text"))).getField("text"), ",").alias(name))
        total = edges.groupBy(F.col(key).alias("id")).agg(F.greatest(F.count("*") - most, F.lit(0)).alias(f"{name}_omitted"))
        return shown.join(total, "id")

    rows = nodes.select("id").join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left")
    return rows.select("id", *(x for n in ("callers", "callees") for x in (F.coalesce(n, F.lit("")).alias(n), F.coalesce(f"{n}_omitted", F.lit(0)).alias(f"{n}_omitted"))))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers, callees): distinct other ends."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    callers = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    callees = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    rows = nodes.select("id").join(callers, "id", "left").join(callees, "id", "left")
    return rows.select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def role() -> Column:
    none_in, none_out = F.col("callers") == 0, F.col("callees") == 0
    return F.when(none_in & none_out, "isolated").when(none_in, "root").when(none_out, "leaf").otherwise("intermediate")


def roles(degrees_: DataFrame) -> DataFrame:
    return degrees_.groupBy(role().alias("role")).agg(F.count("*").alias("n"), F.max("callers").alias("most_callers"))


def level(value: Column, good: float, fair: float) -> Column:
    return F.when(value >= good, "good").when(value >= fair, "fair").otherwise("poor")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, share of linked and of intermediate nodes, their levels, and whether many nodes are dark."""
    total = degrees(nodes, edges).agg(
        F.count("*").alias("nodes"), F.count_if((F.col("callers") > 0) | (F.col("callees") > 0)).alias("linked"),
        F.count_if((F.col("callers") > 0) & (F.col("callees") > 0)).alias("between"), F.count_if((F.col("callers") == 0) & (F.col("callees") == 0)).alias("dark"),
    )
    size = edges.agg(F.count("*").alias("edges"))
    rows = total.withColumn("one", F.lit(1)).join(size.withColumn("one", F.lit(1)), "one")
    share = lambda c: F.lit(100.0) * F.col(c) / F.col("nodes")
    return rows.select(
        "nodes", "edges", F.round(F.col("edges") / F.col("nodes"), 2).alias("edge_ratio"), percent(F.col("linked"), F.col("nodes")).alias("connectivity"), percent(F.col("between"), F.col("nodes")).alias("intermediate"),
        level(share("linked"), 60, 30).alias("connectivity_level"), level(share("between"), 25, 15).alias("intermediate_level"), (share("dark") > 15).alias("many_dark"),
    )


def health_totals(nodes: DataFrame, edges: DataFrame, levels: list[str]) -> DataFrame:
    """Per level, with its coarser ones and over all: nodes, how many have a caller or callee, and their share in percent."""
    linked = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_linked", F.lit(True))
    rows = nodes.join(linked, "id", "left")
    out = rollup_totals(rows, levels, {"nodes": F.count("*"), "linked": F.count("_linked")})
    return out.withColumn("connectivity", percent(F.col("linked"), F.col("nodes")))


def impact_scores(rows: DataFrame, callers: Column, passers: Column, route: Column, entry: Column, exported: Column, transitive: Column, files: Column, untested: Column) -> DataFrame:
    """rows with direct_score, transitive_score, blast and risk from the given counts and facts."""
    some = lambda c, n: F.when(c, n).otherwise(0)
    direct = F.least(F.lit(100), F.least(callers * 5, F.lit(40)) + F.least(passers * 8, F.lit(20)) + some(route, 20) + some(entry, 15) + some(exported, 5))
    further = F.least(F.lit(100), F.least(transitive * 2, F.lit(50)) + F.least(files * 5, F.lit(30)) + some(untested, 20))
    rows = rows.withColumn("callers", callers).withColumn("transitive", transitive).withColumn("direct_score", direct).withColumn("transitive_score", further)
    rows = rows.withColumn("blast", F.round(F.lit(0.6) * F.col("direct_score") + F.lit(0.4) * F.col("transitive_score"), 1))
    return rows.withColumn("risk", F.when(F.col("blast") >= 85, "critical").when(F.col("blast") >= 60, "high").when(F.col("blast") >= 30, "medium").otherwise("low"))


def truncate(nodes: DataFrame, edges: DataFrame, limit: int, centre: str | None = None, pinned: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The centre, nodes of pinned labels and then those of highest degree, `limit` in all, and the edges among them."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    degree = nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    pin = F.col("label").isin(pinned) if pinned else F.lit(False)
    kept = degree.orderBy((F.col("id") == F.lit(centre)).desc_nulls_last(), F.when(pin, 1).otherwise(0).desc(), F.desc("degree"), "id").limit(limit)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inside


def attribute_lines(findings: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """(key, line, section): the section, counted from 1, that a finding's line lies in. Findings and starts are merged in
    order of line and the last start is carried on, so there is no range join."""
    both = findings.distinct().select(key, "line", F.lit(1).alias("kind")).unionByName(starts.distinct().select(key, F.col("start_line").alias("line"), F.lit(0).alias("kind")))
    seen = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("section", seen.cast("int")).where("kind = 1 and section > 0").select(key, "line", "section")


def snapshot_deltas(snapshots: DataFrame, measures: list[str], keep: int = 20) -> DataFrame:
    """The newest `keep` snapshots with each measure's change from the one before."""
    # snapshots are one row per capture, kept to a fixed number
    order = Window.orderBy("captured_at")
    rows = snapshots.select("*", *((F.col(m) - F.lag(m).over(order)).alias(f"{m}_delta") for m in measures))
    return rows.orderBy(F.desc("captured_at")).limit(keep)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(vec_id, label, similarity): the k nearest by cosine, taken per label first and then over all."""
    near = vectors.select("vec_id", "label", cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("s"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))
    return near.withColumn("k", place).where(F.col("k") <= k).orderBy(F.desc("s"), "vec_id").limit(k).select("vec_id", "label", F.round("s", 3).alias("similarity"))
