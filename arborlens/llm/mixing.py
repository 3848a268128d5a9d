"""Mixing sources to target weights by systematic sampling.

Targets: sources weigh by their place in code point order and share `share` times all words; a target stops at `cap`
times its source's words, and the excess goes to the others by weight until none is above. That level is the largest
of (total - words of the k most easily filled sources' caps) / (weight of the rest) over all k.

Sampling: within a source, ordered by size and id, expected copies are summed from the first document on, in integer
billionths so that the order of addition cannot matter; a fixed pseudo-random offset per source is added, and a
document is emitted once per whole number that its span of the sum crosses. Ordering by size keeps the words taken
within about one largest document of the target.

Prefix sums are distributed: rows are range-partitioned by (source, size, id), summed per partition, and each
partition starts from the sums of those before it, so a source with a third of all rows is spread over many tasks.

Defined results: null texts have size 0, expect copies like others and take no words; a null source is a source of its
own and comes last; rows without doc_id and repeated rows count as rows; reruns agree; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UNIT = 1_000_000_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with one column per entry of sums: the sum over the rows of the same keys that come before, exclusive.
    Rows equal in keys and order are interchangeable."""
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(k).asc_nulls_last() for k in keys] + order
    dealt = df.select("*", *(v.alias(f"_{k}") for k, v in sums.items())).repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt)
    totals = dealt.groupBy("_part", *keys).agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *keys, *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_from_{k}") for k in sums))
    starts = starts.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(f"_from_{k}" for k in sums))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *(F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)).alias(f"_in_{k}") for k in sums))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return summed.join(starts, same).select(*df.columns, *((F.col(f"_in_{k}") + F.col(f"_from_{k}")).alias(k) for k in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target from (source, size) rows."""
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    place = prefix_sums(totals, [], [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    weighed = place.select("source", "source_size", weight.cast("long").alias("weight"), full.alias("full"))
    filled = prefix_sums(weighed, [], [(F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"c": F.col("source_size"), "w": F.col("weight")})
    filled = materialize(filled)
    s, v = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if v is None:
        return filled.select("source", "source_size", F.lit(0.0).alias("target"))
    rest = (F.lit(s * float(share)) - F.col("c") * F.lit(float(cap))) / (F.lit(v) - F.col("w"))
    level = filled.agg(F.max(rest)).first()[0]
    return filled.select("source", "source_size", F.least("full", F.lit(level) * F.col("weight")).alias("target"))


def taken_copies(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", order: tuple[str, ...] = ()) -> DataFrame:
    """sizes (doc_id, source, size and more, a table) with source_size, target and copies. Rows of a source are taken in
    order of size, doc_id and the columns of `order`."""
    targets = materialize(source_targets(sizes, weights, share, cap))
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(UNIT))
    rates = targets.select(F.col("source").alias("of"), "source_size", "target", rate.alias("rate"), start.alias("start"))
    # one row per source: sorted and merged unless it is small enough for Spark's own broadcast threshold
    expected = sizes.join(rates, sizes["source"].eqNullSafe(rates["of"])).drop("of")
    by = [F.col("size").asc(), F.col("doc_id").asc_nulls_last(), *(F.col(c).asc() for c in order)]
    spans = prefix_sums(expected, ["source"], by, {"sum": F.col("rate")})
    copies = F.expr(f"(sum + start + rate) div {UNIT} - (sum + start) div {UNIT}")
    return spans.select(*sizes.columns, "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (without its text)."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    return taken_copies(sizes, **options).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of docs, each as often as it was taken. Rows go by a number of their own, so ids may repeat or
    be missing."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_size", word_count(F.col("text"))), codec="zstd")
    sizes = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("_size").alias("size"), F.xxhash64("text").alias("hash"))
    chosen = taken_copies(sizes, order=("hash",), **options).where("copies > 0").select("_row", "copies")
    return rows.join(chosen, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
