"""Shared pieces of the training-data operators: table access, shared storage, text hashing, components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import shared_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def materialize(df: DataFrame, stays: bool = False, codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors. With
    `stays` the end of a scratch block leaves the table; tables with whole texts are worth a denser codec than Spark's own."""
    spark = df.sparkSession
    path = f"{_folder.get() if _folder.get() and not stays else shared_dir(spark)}/arborlens-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that no later plan reads."""
    for df in tables:
        if getattr(df, "written", None):
            _delete(df.sparkSession, df.written)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside are deleted at the end; what is to stay must be read to its end or written
    elsewhere before."""
    path = f"{shared_dir(spark)}/arborlens-scratch-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        _delete(spark, path)


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that are built and run inside are deleted at the end of each, not when the driver happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A key of more than one in HOT of all rows is hot: there are fewer than HOT such keys, however many rows.
HOT = 1000


def join_spread(rows: DataFrame, side: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with side, which has one row per key and in `count` how many of the `total` rows hold
    it. The fewer than HOT hot keys are broadcast, so that their rows stay where they are; all others are merged by key.
    Both frames are read several times: side is written if it is no table yet, rows should be one."""
    side = side if getattr(side, "written", None) else materialize(side)
    hot = F.broadcast(side.where(F.col(count) * HOT > total))
    cold = side.where(F.col(count) * HOT <= total)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key, how))


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal id, modulo 4, equal to 2 (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def text_bytes(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def text_key(text: Column) -> Column:
    """Digest of a text, by which rows that share an id (or have none) are told apart; null texts count as empty."""
    return F.md5(text_bytes(text))


def labelled_texts(base: DataFrame, learned: DataFrame, sample: int) -> DataFrame:
    """label and raw of at most `sample` rows (those of least hash) of base (doc_id, _key, raw) whose id `learned` (doc_id,
    label; small) holds: one row for each id and text, however often it is repeated."""
    own = base.select("doc_id", "_key").join(F.broadcast(learned), "doc_id").distinct()
    chosen = materialize(own.orderBy(F.xxhash64("doc_id", "_key"), "doc_id", "_key").limit(sample))
    rows = base.select("doc_id", "_key", "raw").join(F.broadcast(chosen), ["doc_id", "_key"])
    return rows.groupBy("doc_id", "_key").agg(F.min("label").alias("label"), F.first("raw").alias("raw")).select("label", "raw")


def release() -> None:
    """Gives what a task has freed back to the system: a worker stays for later tasks, beside those of other functions, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def with_text_score(docs: DataFrame, name: str, score: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """docs with a double column of what the function that score() makes in each task gives for the texts; all other columns
    pass through as they are, so that rows can be filtered where they lie."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for batch in batches:
            texts, found = batch.column(text).cast(pa.binary()), [np.zeros(0)]
            # only one group's texts are Python objects at a time
            for low, high in groups_of_bytes(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), WINDOW):
                found.append(np.asarray(of([t or b"" for t in texts.slice(low, high - low).to_pylist()]), float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*batch.schema.names, name])
        release()

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


# ---------------------------------------------------------------- words and hashes, vectorised over bytes

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: all ASCII but letters and digits separates.
TERM_GAPS = np.ones(256, bool)
TERM_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_STEP_BACK = U64(pow(int(_STEP), -1, 2**64))
_powers = [np.ones(1, U64), np.ones(1, U64)]
WINDOW = 1 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, WINDOW + 4096)
        for k, base in enumerate((_STEP, _STEP_BACK)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _hash_window(raw: bytes, gaps: np.ndarray, head: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of raw, which begins and ends at word boundaries. Words are maximal runs of
    bytes outside gaps, with `fold` A-Z lower-cased."""
    buf = np.frombuffer(raw, np.uint8)
    gap = gaps[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, back = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[_LOWER[buf] if fold else buf] * power[: len(buf)], out=total[1:])
    if head:
        ends = np.minimum(ends, starts + head)
    return starts, mix((total[ends] - total[starts]) * back[starts])


def _windows(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (text number, piece) of about WINDOW bytes; longer texts are cut between words."""
    numbers, pieces, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + WINDOW
            if end < len(text):
                while end < len(text) and not _SEPARATOR[text[end]]:
                    end += 1
            piece = text[at:end] if at or end < len(text) else text
            numbers.append(k)
            pieces.append(piece)
            held += len(piece)
            at = end
            if held >= WINDOW:
                yield numbers, pieces
                numbers, pieces, held = [], [], 0
    if pieces:
        yield numbers, pieces


def word_hashes(texts: list[bytes], gaps: np.ndarray = _SEPARATOR, head: int = 0, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit word hash) of every word of the texts, in order. Words are runs of bytes outside gaps
    (by default x20 and x09-x0D), which must hold these; with `head`, only so many first bytes of a word count; without
    `fold`, A-Z differ from a-z."""
    docs, words = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for numbers, pieces in _windows(texts):
        offsets = np.cumsum([0] + [len(p) + 1 for p in pieces])
        starts, hashes = _hash_window(b"\n".join(pieces), gaps, head, fold)
        docs.append(np.asarray(numbers)[np.searchsorted(offsets, starts, "right") - 1])
        words.append(hashes)
    return np.concatenate(docs), np.concatenate(words)


def groups_of_bytes(sizes: Iterable[int], limit: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of items that hold about `limit` bytes together."""
    start = held = at = 0
    for at, size in enumerate(sizes, 1):
        held += size
        if held >= limit:
            yield start, at
            start, held = at, 0
    if at > start:
        yield start, at


def batches_of_texts(frame, column: str = "raw", limit: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of a pandas frame whose texts hold about `limit` bytes together."""
    return groups_of_bytes((len(raw) if raw is not None else 0 for raw in frame[column]), limit)


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) & 0xFFFFFFFF


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): component is the least node it reaches.

    Alternates large-star and small-star contraction; each round is two joins with aggregated minima, of which the first does
    not gather the rows of hot nodes, and tables in the shared folder. Ends when a round changes nothing.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    total = 2 * pairs.count()
    for _ in range(most_rounds):
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), "k")
        least = materialize(least)
        large = join_spread(both, least, "a", "k", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        step = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, pairs = pairs, materialize(step)
        discard(old, least)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, total = now, 2 * now[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each of n nodes' component under the links (a, b), within one task."""
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        live = parent[a] != parent[b]
        a, b = a[live], b[live]
    return parent
