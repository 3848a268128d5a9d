"""Graphs projected from the driver's tables, with the columns of the code graph, so that its operators run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types as resolution labels, and their ranks.
EVENT_LABELS = {"purchase": "exact", "signup": "file_scoped", "click": "import", "view": "same_file", "error": "unique_global"}
EVENT_RANKS = {"purchase": 6, "signup": 5, "click": 4, "view": 3, "error": 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_event(values: dict[str, object]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col("event_type") == k, F.lit(v)).otherwise(out)
    return out


def user(c: str) -> Column:
    return F.concat(F.lit("user::"), F.col(c).cast("string"))


def steps(events: DataFrame) -> DataFrame:
    """Each event with the user of the next event of its hour."""
    hour = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return events.withColumn("next_user", F.lead("user_id").over(hour)).where("next_user is not null")


def flow(events: DataFrame) -> DataFrame:
    """Edges user -> user of the hour's next event: one per pair, with the best rank and the number of steps."""
    rows = steps(events).select(user("user_id").alias("src"), user("next_user").alias("dst"), by_event(EVENT_RANKS).alias("rank"))
    return rows.groupBy("src", "dst").agg(F.max("rank").alias("rank"), F.count("*").alias("n")).withColumn("type", F.lit("CALLS"))


def top_successors(events: DataFrame, most: int = 2) -> DataFrame:
    """Edges from each user to the `most` users that follow most often, ties to the lesser."""
    place = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    ranked = flow(events).where("src <> dst").withColumn("_k", F.row_number().over(place))
    return ranked.where(F.col("_k") <= most).select("src", "dst", F.lit(6).alias("rank"), F.lit("CALLS").alias("type"))


def users(events: DataFrame) -> DataFrame:
    return events.select(user("user_id").alias("id")).distinct()


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label) of regions, nations, customers, orders, parts and suppliers."""
    keys = {"region": ("Region", "r_regionkey"), "nation": ("Nation", "n_nationkey"), "customer": ("Customer", "c_custkey"), "orders": ("Order", "o_orderkey"), "part": ("Part", "p_partkey"), "supplier": ("Supplier", "s_suppkey")}
    out = None
    for name, (label, key) in keys.items():
        rows = table(spark, sf_dir, name).select(node(label, key).alias("id"), F.lit(label).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def node(label: str, key: str) -> Column:
    return F.concat(F.lit(label.lower() + "::"), F.col(key).cast("string"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges from regions down to suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    e = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    return (
        e(t("nation"), node("Region", "n_regionkey"), node("Nation", "n_nationkey"), "HAS_NATION")
        .unionByName(e(t("customer"), node("Nation", "c_nationkey"), node("Customer", "c_custkey"), "HAS_CUSTOMER"))
        .unionByName(e(t("orders"), node("Customer", "o_custkey"), node("Order", "o_orderkey"), "PLACED"))
        .unionByName(e(t("lineitem"), node("Order", "l_orderkey"), node("Part", "l_partkey"), "CONTAINS_PART"))
        .unionByName(e(t("lineitem"), node("Part", "l_partkey"), node("Supplier", "l_suppkey"), "FROM_SUPPLIER"))
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, host, href): every link of every page."""
    return pages.select("page_id", host("url").alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


def host(url: str) -> Column:
    return F.regexp_extract(url, r"^https?://([^/]+)", 1)


def turns(conversations: DataFrame) -> DataFrame:
    """Edges from each turn to the next of its conversation."""
    at = lambda c: F.concat_ws("::", F.lit("turn"), F.col("conv_id").cast("string"), c.cast("string"))
    here = conversations.select("conv_id", "turn").distinct()
    after = here.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return here.join(after, ["conv_id", "turn"]).select(at(F.col("turn")).alias("src"), at(F.col("turn") + 1).alias("dst"), F.lit(6).alias("rank"), F.lit("INHERITS_FROM").alias("type"), "conv_id")
