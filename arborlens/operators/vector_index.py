"""Inverted lists for nearest neighbours by cosine: vectors by their nearest centre, in a table partitioned by cell.

Centres come from k-means on a bounded sample; every vector is in the lists. A search asks the cells whose centres are nearest, so
Spark reads those partitions alone; with `probes` left out it goes on to every cell that could still hold one of the k nearest
(by the distance of its centre and its radius), which makes it exact. A cell's vectors and queries meet in blocks, so a cell
that holds a third of all rows is dealt to many tasks. Rows carry a digest of their text, so a refresh embeds changed texts only
and writes the cells they leave or enter alone.

Vectors that are null, empty, zero or not finite, or of another length than most of the sample, take no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import delete, materialize, remove

#: Vectors and queries that one task compares at a time; cells at most, whose centres every task holds; sampled vectors.
BLOCK, CELLS, SAMPLE = 20_000, 1_024, 20_000
LISTS = "id long, digest string, vector array<double>, cell int, distance double"


def unit(vector: str):
    """The vector with length one; null if it cannot take part."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    usable = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0)
    return F.when(usable, F.transform(v, lambda x: x / norm))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from a random start; empty cells keep their centre."""
    draw = np.random.Generator(np.random.PCG64(seed))
    centres = sample[draw.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            some = [k for k, v in enumerate(vectors) if len(v) == centres.shape[1]]
            if not some:
                continue
            x = np.array([vectors[k] for k in some])
            d = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))
            cell = d.argmin(1)
            part = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(some)), cell]))], names=["id", "digest", "vector", "cell", "distance"])

    return run


class VectorIndex:
    """Tables under `path`: centres, and lists partitioned by cell."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """From rows (id, vector and, for refresh, digest)."""
        spark = rows.sparkSession
        digest = F.col("digest") if "digest" in rows.columns else F.lit(None).cast("string")
        vectors = materialize(rows.select(F.col("id").cast("long").alias("id"), digest.alias("digest"), unit("vector").alias("vector")).where("vector is not null and id is not null"))
        n = vectors.count()
        taken = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["vector"].to_list() or [[0.0]]
        lengths = [len(v) for v in taken]
        some = np.array([v for v in taken if len(v) == max(set(lengths), key=lengths.count)])
        centres = centres_of(some, min(len(some), CELLS, cells or max(1, int(n**0.5))), seed=seed)
        spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        vectors.mapInArrow(_assign(centres), LISTS).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
        delete(vectors)
        return cls(spark, path)

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.schema(LISTS).parquet(f"{self.path}/lists")

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # CELLS at most
        return np.array([r["centre"] for r in rows])

    def cells(self) -> DataFrame:
        """(cell, n, radius); at most CELLS rows."""
        return self.lists.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))

    def _ask(self, queries: DataFrame, probes: int, stats: list) -> DataFrame:
        """(query_id, vector, cell, place, slack): every cell of each query by distance of its centre; slack is the least distance
        that a vector of the cell can have from the query."""
        centres = self.centres()
        radius = np.full(len(centres), -1.0)
        for cell, _, r in stats:
            radius[cell] = r

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full = np.flatnonzero(radius >= 0)
            for batch in batches:
                ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for q, v in zip(ids, vectors):
                    if len(v) != centres.shape[1] or not len(full):
                        continue
                    d = np.sqrt(np.maximum(0, ((centres[full] - np.array(v)) ** 2).sum(1)))
                    order = np.argsort(d, kind="stable")[: probes or None]
                    n = len(order)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([q] * n, pa.int64()), pa.array(full[order].astype(np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.maximum(0, d[order] - radius[full[order]]))], names=["query_id", "cell", "place", "slack"]
                    )

        return queries.mapInArrow(run, "query_id long, cell int, place int, slack double")

    def _meet(self, asked: DataFrame, queries: DataFrame, k: int, stats: list, block: int) -> DataFrame:
        """(query_id, id, similarity): the k nearest of each query in every block of the cells it asks."""
        sizes = self.spark.createDataFrame([(c, -(-n // block)) for c, n, _ in stats], "cell int, vblocks long")
        load = asked.groupBy("cell").agg(F.count("*").alias("m")).join(F.broadcast(sizes), "cell").select("cell", "vblocks", F.ceil(F.col("m") / F.lit(block)).alias("qblocks"))
        load = materialize(load)
        # partition pruning: only the lists of cells that a query asks are read
        wanted = [r["cell"] for r in load.select("cell").collect()]
        lists = self.lists.where(F.col("cell").isin(wanted)).join(F.broadcast(load), "cell")
        held = lists.select("cell", F.pmod(F.xxhash64("id"), F.col("vblocks")).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qblocks") - 1)).alias("qb"), "id", "vector")
        ask = asked.join(F.broadcast(load), "cell").join(queries, "query_id")
        ask = ask.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vblocks") - 1)).alias("vb"), F.pmod(F.xxhash64("query_id"), F.col("qblocks")).alias("qb"), "query_id", "vector")

        def pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "id": [], "similarity": []}).astype({"query_id": "int64", "id": "int64"})
            right = right.sort_values("id", kind="stable")
            ids, x = right["id"].to_numpy(), np.array(right["vector"].to_list())
            out = []
            for a in range(0, len(left), 256):
                part = left.iloc[a : a + 256]
                s = np.round(np.array(part["vector"].to_list()) @ x.T, 9)
                top = min(k + 1, len(ids))
                best = np.argsort(-s, axis=1, kind="stable")[:, :top]  # ids ascend, so ties go to the lesser
                rows = np.repeat(np.arange(len(part)), top)
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[rows], "id": ids[best.ravel()], "similarity": s[rows, best.ravel()]}))
            return pd.concat(out)

        by = ["cell", "vb", "qb"]
        found = ask.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(pairs, "query_id long, id long, similarity double")
        return found.where("query_id <> id")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, block: int = BLOCK, first: int = 4) -> DataFrame:
        """(query_id, rank, id, similarity) for queries (query_id, vector): the k nearest but for the query's own id, ties to the lesser id. With
        `probes` that many cells are asked; without, as many as it takes for the exact answer."""
        asked_of = materialize(queries.select(F.col("query_id").cast("long").alias("query_id"), unit("vector").alias("vector")).where("vector is not null and query_id is not null"))
        stats = [tuple(r) for r in self.cells().collect()]  # CELLS rows at most
        every = materialize(self._ask(asked_of, probes or 0, stats))
        near = every.where(F.col("place") < (probes or first))
        found = materialize(self._meet(near, asked_of, k, stats, block))
        if probes is None:
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
            last = found.withColumn("r", place).where(F.col("r") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("reach"))
            rest = every.where(F.col("place") >= first).join(last, "query_id", "left").where("reach is null or slack <= reach + 1e-6").select("query_id", "cell")
            found = found.unionByName(self._meet(materialize(rest), asked_of, k, stats, block))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")

    def rows_read(self, queries: DataFrame, probes: int) -> DataFrame:
        """One row: vectors compared with the queries' cells, of how many comparisons without an index, and the partitions read."""
        asked_of = queries.select(F.col("query_id").cast("long").alias("query_id"), unit("vector").alias("vector")).where("vector is not null")
        stats = [tuple(r) for r in self.cells().collect()]
        asked = self._ask(asked_of, probes, stats).groupBy("cell").agg(F.count("*").alias("m"))
        sizes = self.spark.createDataFrame([(c, n) for c, n, _ in stats], "cell int, n long")
        whole = asked_of.count() * sum(n for _, n, _ in stats)
        return asked.join(F.broadcast(sizes), "cell").agg(F.sum(F.col("m") * F.col("n")).alias("compared"), F.lit(whole).alias("without_index"), F.count("*").alias("cells_read"), F.sum("n").alias("rows_read"))

    def recall(self, queries: DataFrame, k: int, probes: int) -> float:
        """Share of the exact k nearest that a search of so many cells finds."""
        exact = self.search(queries, k).select("query_id", "id")
        hits = self.search(queries, k, probes).select("query_id", "id")
        total = exact.count()
        return exact.join(hits, ["query_id", "id"]).count() / total if total else 1.0

    def refresh(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Brings the lists up to rows (id, text): embed gets (id, text) of new and changed texts only and gives (id, vector). Ids that are
        gone leave. Only cells that a vector leaves or enters are written."""
        now = materialize(rows.select(F.col("id").cast("long").alias("id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")))
        old = self.lists.select("id", F.col("digest").alias("had"), "cell")
        changed = materialize(now.join(old, "id", "left").where("had is null or had <> digest").select("id", "text", "digest"))
        vectors = embed(changed.select("id", "text")).join(changed.select("id", "digest"), "id").select("id", "digest", unit("vector").alias("vector")).where("vector is not null")
        fresh = materialize(vectors.mapInArrow(_assign(self.centres()), LISTS))
        gone = materialize(old.join(now.select("id"), "id", "left_anti").select("id"))
        leaving = materialize(changed.select("id").unionByName(gone))
        touched = old.join(leaving, "id", "left_semi").select("cell").unionByName(fresh.select("cell")).distinct()
        cells = [r["cell"] for r in touched.collect()]  # CELLS at most
        counts = {"embedded": changed.count(), "gone": gone.count(), "cells_written": len(cells)}
        if cells:
            kept = materialize(self.lists.where(F.col("cell").isin(cells)).join(leaving, "id", "left_anti").select(*[c.split()[0] for c in LISTS.split(", ")]).unionByName(fresh))
            # new files first, then the old ones of these cells go: a reader never misses a vector
            before = [r[0] for r in self.lists.where(F.col("cell").isin(cells)).select(F.col("_metadata.file_path")).distinct().collect()]
            kept.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")
            remove(self.spark, before)
        return counts


def temporary_path(spark: SparkSession) -> str:
    from ..storage import shared_dir

    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
