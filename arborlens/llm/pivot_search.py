"""Exact top-k inner product search by pivot-table elimination.

Vectors become integers, floor(scale * x). With M the largest norm and one more coordinate sqrt(M^2 - |x|^2), the
largest inner products are the smallest distances: d^2 = |q|^2 + M^2 - 2 q.x. Every salt's vectors have a table of
their distances to the pivots; for a query, the largest difference between its own and a vector's distance to any pivot
is a lower bound of theirs. Candidates are evaluated in the order of that bound until the next one lies beyond the
k-th best distance, so nothing that could enter the result is left out.

Vectors are dealt to salts, and every query goes to every salt: rows come to a task in order, first the salt's vectors, which it holds,
then the queries, block by block. No table is broadcast, and per query and salt at most k rows leave a task. The number of salts grows
with the table, and the queries do: pairs, and the copies of the queries, grow with the square of the table.

Defined results: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no
part; a query meets only vectors of its own dimension, and none of its own vec_id; repeated rows are candidates as
often as they come; ties go to the smaller vec_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def usable(vector: Column) -> Column:
    """Not null or empty, and all components are there and finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _lift(rows: np.ndarray, top: float) -> np.ndarray:
    norm = np.einsum("ij,ij->i", rows, rows)
    return np.sqrt(np.maximum(top - norm, 0))


def _table(rows: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances (pivots x rows) in the lifted space."""
    out = np.empty((len(pivots), len(rows)))
    for k, (p, e) in enumerate(zip(pivots, pivot_extra, strict=True)):
        gap = rows - p
        out[k] = np.sqrt(np.einsum("ij,ij->i", gap, gap) + (extra - e) ** 2)
    return out


def packed(ids: list[np.ndarray], vectors: list[np.ndarray], pivots: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and the table of distances of a salt's vectors of one dimension."""
    rows = np.concatenate(vectors)
    wide = rows.astype(float)
    return np.concatenate(ids), rows, _table(wide, _lift(wide, top), pivots, _lift(pivots, top))


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, table: np.ndarray, k: int, top: float) -> None:
        self.ids, self.rows, self.table, self.k, self.top = ids, rows, table, k, top
        self.exact = top < 2**52
        self.wide = rows.astype(float)
        self.norm = np.einsum("ij,ij->i", self.wide, self.wide)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def reach(self, q: int) -> float:
        score = self.found[q][0]
        if len(score) < self.k:
            return np.inf
        return float(np.sqrt(max(0.0, self.norm[q] + self.top - 2.0 * float(score[-1])))) + 1e-6 * (1 + np.sqrt(self.top))

    def take(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        old_score, old_ids = self.found[q]
        if len(old_score) == self.k:
            fit = score >= old_score[-1]
            score, ids = score[fit], ids[fit]
        if len(score) > self.k:
            fit = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[fit], ids[fit]
        score, ids = np.concatenate((old_score, score)), np.concatenate((old_ids, ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.found[q] = score[order], ids[order]

    def meet(self, ids: np.ndarray, rows: np.ndarray, table: np.ndarray) -> None:
        wide = rows.astype(float) if self.exact else None
        for a in range(0, len(self.ids), 64):
            b = min(len(self.ids), a + 64)
            bound = np.zeros((b - a, len(ids)))
            for mine, theirs in zip(self.table[:, a:b], table, strict=True):
                np.maximum(bound, np.abs(mine[:, None] - theirs[None, :]), out=bound)
            for q in range(a, b):
                low = bound[q - a]
                near = np.flatnonzero((low <= self.reach(q)) & (ids != self.ids[q]))
                near = near[np.argsort(low[near], kind="stable")]
                at, width = 0, 256
                while at < len(near) and low[near[at]] <= self.reach(q):
                    some = near[at : at + width]
                    score = (wide[some] @ self.wide[q]).astype(np.int64) if self.exact else rows[some] @ self.rows[q]
                    self.take(q, score, ids[some])
                    at, width = at + width, width * 4

    def rows_out(self, numbers: np.ndarray) -> pd.DataFrame:
        n = [len(s) for s, _ in self.found]
        number = np.repeat(np.arange(len(n)), n)
        return pd.DataFrame({"number": numbers[number], "query_id": self.ids[number], "vec_id": np.concatenate([i for _, i in self.found]), "score": np.concatenate([s for s, _ in self.found])})


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256, pivots: int = 32, query_block: int = 1024, most: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id is divisible by `every`, its k best others."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    clean = materialize(clean.select("vec_id", integers(F.col("vector"), scale).alias("vector")))
    length2 = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    asks = F.col("vec_id") % every == 0
    n, top = clean.agg(F.count("*"), F.max(length2)).first()
    top = float(top or 0.0)
    # a fixed number of pivots, whatever the number of vectors
    chosen: dict[int, list] = {}
    for row in clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect():
        chosen.setdefault(len(row["vector"]), []).append(row["vector"])
    pivots_of = {dim: np.array(rows, float) for dim, rows in chosen.items()}

    # a salt has few vectors, so that a task holds them in memory; their number grows with the table
    salts = int(max(1, min(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 2000), -(-n // most)))
    rows = clean.withColumn("number", F.monotonically_increasing_id()).withColumn("dim", F.size("vector"))
    own = rows.withColumn("role", F.lit(0)).withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)).cast("int"))
    asked = rows.where(asks).withColumn("role", F.lit(1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = own.unionByName(asked).repartitionById(salts, F.col("salt")).sortWithinPartitions("salt", "dim", "role", "number")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, met = None, [], None
        for frame in frames:
            for key, part in frame.groupby(["salt", "dim", "role"], sort=True):
                if key[:2] != now:
                    now, held, met = key[:2], [], None
                ids, wide = part["vec_id"].to_numpy(np.int64), np.stack(part["vector"].to_list()).astype(np.int64)
                if key[2] == 0:
                    held.append((ids, wide))
                    continue
                if not held:  # no vector of this dimension in the salt
                    continue
                own = pivots_of.get(int(key[1]), np.zeros((0, int(key[1]))))
                met = met or packed([x[0] for x in held], [x[1] for x in held], own, top)
                for at in range(0, len(ids), query_block):
                    some = slice(at, at + query_block)
                    q = wide[some]
                    best = Best(ids[some], q, _table(q.astype(float), np.zeros(len(q)), own, _lift(own, top)), k, top)
                    best.meet(*met)
                    yield best.rows_out(part["number"].to_numpy(np.int64)[some])

    found = dealt.mapInPandas(search, "number long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
