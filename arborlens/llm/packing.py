"""Best-fit packing by length patterns.

A document's ids, with the end id, are cut into pieces of `capacity` tokens (the first piece takes the remainder), so
sequences are a matter of piece lengths alone. Only the histogram of lengths (at most `capacity` numbers) reaches the
driver: patterns of few lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down to what is there, and the residual histogram is packed by
best fit decreasing, whole patterns at a time. The plan is a table of at most a few thousand intervals of ranks; every
piece gets a rank among the pieces of its length, by prefix sums over ranges of rows, so that a length most pieces have is
dealt to many tasks, and finds its sequence and offset there by bisection.

Defined results: null texts are empty and hold the end id alone; empty tables give no rows; repeated rows are packed as
often as they come; rows without doc_id are packed too; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_ids, materialize
from .mixing import prefix_sums
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n >= 1 tokens; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def patterns(lengths: np.ndarray, count: np.ndarray, capacity: int, spread: int = 12) -> list[tuple[int, ...]]:
    """Multisets of 2 to 4 present lengths that fill a sequence exactly: all pairs; of triples and quadruples those that
    join each length with some common partners (`spread` of them), which keeps the number linear in the lengths."""
    have = set(lengths.tolist())
    common = lengths[np.argsort(-count, kind="stable")][: max(spread, len(lengths) // 16)].tolist()
    found = {(a, capacity - a) for a in have if 2 * a <= capacity and capacity - a in have}
    for a in have:
        for k in range(spread):
            b = common[(a * 7 + k * 13) % len(common)]
            rest = capacity - a - b
            if rest in have:
                found.add(tuple(sorted((a, b, rest))))
            c = common[(a * 11 + k * 17) % len(common)]
            if rest - c in have:
                found.add(tuple(sorted((a, b, c, rest - c))))
    return sorted(found)


def fit(items: np.ndarray, count: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 of the patterns (rows of items: length numbers, -1 for none) that
    bring their use of every length nearest to count. Accelerated projected gradient."""
    used = items >= 0
    slot = np.where(used, items, 0)

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(slot[used], np.broadcast_to(x[:, None], items.shape)[used], minlength=len(count))

    degree = np.bincount(slot[used], minlength=len(count))
    step = 1.0 / max(1.0, float((np.where(used, degree[slot], 0)).sum(1).max()) * 1.0)
    x = y = np.zeros(len(items))
    t = 1.0
    for _ in range(rounds):
        gap = count - use(y)
        new = np.maximum(0, y + step * np.where(used, gap[slot], 0).sum(1))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats); together they use every length exactly as often as it is there."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        out.append(((capacity,), left.pop(capacity)))
    if left:
        lengths = np.array(sorted(left))
        count = np.array([left[k] for k in lengths.tolist()], float)
        number = {k: i for i, k in enumerate(lengths.tolist())}
        found = patterns(lengths, count, capacity)
        if found:
            items = np.full((len(found), 4), -1)
            for i, p in enumerate(found):
                items[i, : len(p)] = [number[k] for k in p]
            repeats = np.floor(fit(items, count) + 1e-6).astype(np.int64)
            for i in np.argsort(-repeats, kind="stable"):
                p = found[i]
                n = min(int(repeats[i]), *(left.get(k, 0) // p.count(k) for k in p))
                if n > 0:
                    out.append((p, n))
                    for k in p:
                        left[k] -= n
    order = sorted(k for k, v in left.items() if v)
    while order:  # best fit decreasing on the residual histogram; every turn uses up a length
        take: dict[int, int] = {}
        gap, top = capacity, len(order)
        while (at := bisect_right(order, gap, 0, top)) > 0:
            k = order[at - 1]
            n = min(gap // k, left[k])
            take[k] = n
            gap, top = gap - n * k, at - 1
        n = min(left[k] // m for k, m in take.items())
        out.append((tuple(k for k, m in take.items() for _ in range(m)), n))
        for k, m in take.items():
            left[k] -= n * m
        order = [k for k in order if left[k]]
    return out


def intervals(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past the last rank, sequence of the first rank, offset) of each place in the plan."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in planned:
        offset = 0
        for k in lengths:
            at = seen.get(k, 0)
            rows.append((k, at, at + n, base, offset))
            seen[k] = at + n
            offset += k
        base += n
    return rows


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.append(own.ids(text or ""), own.kind.type(end_id)).astype("<u4")
                rows += [(doc_id, k, at, n, crc32_ids(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(pieces, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = materialize(tokenize_pieces(docs, tokenizer, capacity, end_id))
    # at most `capacity` counts and a few thousand intervals, whatever the number of documents
    histogram = {r["length"]: r["k"] for r in pieces.groupBy("length").agg(F.count("*").alias("k")).collect()}
    table = np.array(sorted(intervals(plan(histogram, capacity))), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 40 | table[:, 1]
    ranked = prefix_sums(pieces, ["length"], [F.col("doc_id").asc_nulls_first(), F.col("piece").asc(), F.col("ids_crc32").asc()], {"rank": F.lit(1)})

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, frame["length"].to_numpy(np.int64) << 40 | rank, "right") - 1
            yield frame.drop(columns="rank").assign(sequence_id=table[at, 3] + rank - table[at, 1], offset=table[at, 4])

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
