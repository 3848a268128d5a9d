"""As-of joins and interval joins over ordered values: merged, carried on and split by spans, never compared row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tolerance: float | None = None, span: float = 86_400.0, tie: str | None = None) -> DataFrame:
    """left with the columns of the last row of right (but for `key`) of the same key at or before the left row; null where there is none, or none within the tolerance
    (in the units of the two columns; seconds for times). Of right rows of one place that of greatest `tie` counts.

    Both sides are merged and the last right row is carried on within spans of the axis; what a span begins with is carried over
    from the spans before it, of which one row each is enough. A key with many rows is so dealt to as many tasks as it has
    spans. Rows with null key or place match nothing.
    """
    number = lambda c, df: F.col(c).cast("timestamp").cast("double") if df.schema[c].dataType.typeName().startswith("timestamp") or df.schema[c].dataType.typeName() == "date" else F.col(c).cast("double")
    columns = [c for c in right.columns if c != key]
    clash = set(columns) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    r = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("_key"), number(right_at, right).alias("_t"), F.struct(*columns).alias("_r"))
    last = F.struct("_t", F.col(f"_r.{tie}") if tie else F.lit(0))
    r = r.groupBy("_key", "_t").agg(F.max_by("_r", last).alias("_r")) if tie else r.groupBy("_key", "_t").agg(F.first("_r").alias("_r"))
    r = r.withColumn("_span", F.floor(F.col("_t") / span))
    rows = left.select(F.struct(*left.columns).alias("_l"), F.col(key).alias("_key"), number(left_at, left).alias("_t")).withColumn("_span", F.floor(F.col("_t") / span))
    usable = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    kind = r.schema["_r"].dataType
    # what every span of a key begins with: the last row of the spans before
    ends = r.groupBy("_key", "_span").agg(F.max_by(F.struct("_t", "_r"), "_t").alias("_end"))
    spans = ends.unionByName(rows.where(usable).select("_key", "_span").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    spans = spans.groupBy("_key", "_span").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    begins = spans.select("_key", "_span", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    right_rows = r.select("_key", "_span", "_t", F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.struct("_t", "_r").alias("_m"))
    merged = rows.where(usable).withColumn("_m", F.lit(None).cast(right_rows.schema["_m"].dataType)).select(*right_rows.columns).unionByName(right_rows)
    # at one place right rows come first
    within = Window.partitionBy("_key", "_span").orderBy("_t", F.col("_m").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = merged.withColumn("_m", F.last("_m", ignorenulls=True).over(within)).where("_l is not null").join(begins, ["_key", "_span"], "left")
    met = met.select("_l", "_t", F.coalesce("_m", "_begin").alias("_m"))
    near = F.lit(True) if tolerance is None else F.col("_t") - F.col("_m._t") <= tolerance
    found = met.select("_l", F.when(near, F.col("_m._r")).alias("_r"))
    alone = rows.where(~usable).select("_l", F.lit(None).cast(kind).alias("_r"))
    return found.unionByName(alone).select("_l.*", *(F.col(f"_r.{c}").alias(c) for c in columns))


def rollup_totals(rows: DataFrame, levels: list[str], totals: dict[str, Column]) -> DataFrame:
    """Totals of every level with its coarser ones and of all rows; `level` counts the columns that hold (nulls of others mean
    "all", those of the data itself keep their level)."""
    out = rows.rollup(*levels).agg(F.grouping_id().alias("_g"), *(v.alias(k) for k, v in totals.items()))
    held = F.lit(len(levels)) - F.length(F.regexp_replace(F.bin("_g"), "0", ""))
    return out.select(held.cast("int").alias("level"), *levels, *totals)
