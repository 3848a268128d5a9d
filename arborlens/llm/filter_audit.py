"""Filter interaction audit: what each filter removes in every order, by path counting on the lattice of filter subsets.

Every document becomes a mask of the filters it fails. A state of the lattice is the set of filters applied so far; its
edge (state, filter) removes the documents that fail the filter and nothing in the state. Forward and backward passes
over the lattice count the orders that reach a state and leave it; an edge lies on the product of both, which weighs
its removals for the Shapley figure. The steps of every single order are read from the same edges. Only counts by (part, mask)
reach the lattice: at most 32 rows a part, whatever the number of documents.

All of it is Spark expressions. Copies are found by one grouped least id per text; texts and ids that many rows share are
joined without gathering their rows.

Defined results: null texts are empty; a null part is the empty string and joins the rows whose part is empty; rows
without doc_id count, are no copies and make none; rows that share an id and a text are no copies of each other; a label
counts once for an id, 1 if any of its rows has 1, and holds for every row of that id; labels without id or document are
ignored; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialize, text_key

LETTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> list[Column]:
    """Failure conditions of the filters that look at one text: A short, B repetitive, C capitals, D symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, size = F.size(words), F.length(text)
    capitals = size - F.length(F.translate(text, _UPPER, ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * size, text.rlike(r"[#$%&*|]")]


def lattice(n: int) -> dict[tuple[int, int], int]:
    """Orders through every edge (state, bit of the filter applied next) of the lattice of n filters."""
    full = (1 << n) - 1
    bits = [1 << k for k in range(n)]
    reach = {0: 1}
    for state in range(full):  # a subset's number is above those of its own subsets
        for bit in bits:
            if not state & bit:
                reach[state | bit] = reach.get(state | bit, 0) + reach[state]
    leave = {full: 1}
    for state in range(full - 1, -1, -1):
        leave[state] = sum(leave[state | bit] for bit in bits if not state & bit)
    return {(state, bit): reach[state] * leave[state | bit] for state in range(full) for bit in bits if not state & bit}


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic for every row of docs; bit k of the mask stands for the k-th of LETTERS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = materialize(rows.select("doc_id", "part", mask.alias("mask"), text_key(F.col("text")).alias("key")))
    total = rows.count()
    texts = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("doc_id").alias("first")).where("k > 1")
    rows = join_spread(rows, texts, "key", "k", total, "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    rows = rows.select("doc_id", "part", F.when(copy, F.col("mask") + (1 << LETTERS.index("E"))).otherwise(F.col("mask")).alias("mask"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = materialize(rows)
    marks = rows.groupBy("doc_id").agg(F.count("*").alias("k")).join(marks, "doc_id")
    rows = join_spread(rows, marks, "doc_id", "k", total, "left")
    return rows.select("part", "mask", *[F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")])


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of every order's steps, for rows (part, mask, good, toxic)."""
    spark = masks.sparkSession
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    paths = lattice(len(letters))
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(b).alias("bit"), F.lit(w).cast("long").alias("paths")) for (s, b), w in paths.items()]))
    pairs = cells.withColumn("edge", edge).select("*", "edge.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    edges = pairs.groupBy("part", "state", "bit", "paths").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    edges = materialize(edges)
    shapley = edges.groupBy("part", "bit").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    steps = []
    for order in permutations(letters):
        state = 0
        for k, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append(("".join(order), k, state, bit))
            state |= bit
    # n! * n rows of the filters alone
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, bit int"))
    out = edges.join(shapley, ["part", "bit"]).join(steps, ["state", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over docs by language."""
    return audit(failure_masks(docs, labels))
