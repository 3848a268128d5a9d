"""Structured Streaming: change streams, their last state per key, and event-time windows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import files_state, materialize, shared_dir

#: The state of no files.
NOTHING = hashlib.sha256().hexdigest()
LATE = "1 day"


def run_available(spark: SparkSession, path: str, schema: T.StructType, plan: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] | None = None, append: bool = False, files: int | None = None, base: str | None = None) -> DataFrame:
    """All files at path as a stream, through plan, until none is left; the sink's rows as a batch. State and sink lie in
    the shared folder. With `keys` the stream gives changed rows only (update mode, so that the watermark frees state), and
    of each key the row of the last batch counts; without, a plan gives its whole result in every batch (session windows
    know no update mode) and the last one counts. With `append` a row is given once, when nothing can change it any more. `files` bounds the
    files of a batch; a `base` that was used before goes on where that run ended."""
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    out = plan(stream) if plan else stream
    held: dict[str, int] = {}

    def sink(batch: DataFrame, number: int) -> None:
        # a batch that is given again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        held["last"] = number

    mode = "append" if append else "update" if keys else "complete" if plan else "append"
    query = out.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    target = out.schema
    if not held:
        return spark.createDataFrame([], target)
    if keys:
        rows = spark.read.schema(T.StructType([*target, T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*target.names), F.col("batch")).alias("_row")).select("_row.*")
    last = f"{base}/rows/batch={held['last']}" if mode == "complete" else f"{base}/rows/batch=*"
    return spark.read.schema(target).parquet(last)


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's rows the last in order. As a stream its state is one row for every key that ever came, without an end: use
    settle_changes where keys go."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def tumbling_counts(events: DataFrame) -> DataFrame:
    hours = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return hours.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


def session_counts(events: DataFrame) -> DataFrame:
    visits = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE).groupBy(F.session_window("at", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return visits.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def sliding_counts(events: DataFrame, width: str = "2 hours", slide: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(start, event_type, n): counts of overlapping windows; a row counts in every window that holds it, rows later than the
    watermark in none."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    found = rows.groupBy(F.window("at", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: str, late: str = LATE) -> DataFrame:
    """Rows of two streams of one key whose right time lies at or after the left one by no more than `within`. Both sides have a
    watermark, so state holds a row no longer than a partner could still come. Names of columns but for the key must differ."""
    a, b = left.withWatermark(left_at, late), right.withColumnRenamed(key, "_right_key").withWatermark(right_at, late)
    same = (F.col(key) == F.col("_right_key")) & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}"))
    return a.join(b, same).drop("_right_key")


SETTLED = "path string, seq long, op string, content string"


def settle_changes(changes: DataFrame, debounce: float = 2.0, forget: float = 86_400.0, late: str = "0 seconds") -> DataFrame:
    """Stream of settled changes (path, seq, op, content) from (path, seq, op, content, at): per path the last change once the watermark
    has passed it by `debounce` seconds without a newer one.

    State per path is one waiting change and what was last given (its number and digest). Changes with a number at or below that, such as a batch
    that is replayed, and contents that are as they were change nothing. A deleted path keeps a tombstone for `forget`
    seconds, then its state is dropped. Event time alone drives the timers, so a rerun gives the same rows.
    """

    class Settle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "seq long, op string, content string, at long")
            self.given = handle.getValueState("given", "seq long, digest string, gone boolean, at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            changes = sorted({(int(seq), op, content, int(at.timestamp() * 1000)) for frame in rows for seq, op, content, at in zip(frame["seq"], frame["op"], frame["content"], frame["at"])}, key=lambda c: c[0])
            best = old = self.waiting.get() if self.waiting.exists() else None
            out = []
            for change in changes:
                last = self.given.get()[0] if self.given.exists() else -1
                if change[0] <= last or (best is not None and change[0] <= best[0]):
                    continue
                if best is not None and change[3] > best[3] + int(debounce * 1000):
                    out += self.settle(key[0], best)  # it stood long enough before this one came
                best = change
            if best is not None and best != old:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.waiting.update(best)
                self.handle.registerTimer(best[3] + int(debounce * 1000))
            yield pd.DataFrame(out, columns=["path", "seq", "op", "content"], dtype=object)

        def settle(self, path: str, change) -> list[tuple]:
            """The change as what was last given; nothing to give if the path is as it was."""
            seq, op, content, at = change
            digest, gone = hashlib.md5((content or "").encode()).hexdigest(), op == "delete"
            had = self.given.get() if self.given.exists() else None
            self.given.update((seq, digest, gone, at))
            same = had is not None and bool(had[2]) == gone and (gone or had[1] == digest)
            return [] if same else [(path, seq, op, content)]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            out = []
            if self.waiting.exists():
                change = self.waiting.get()
                out = self.settle(key[0], change)
                self.waiting.clear()
                if change[1] == "delete":
                    self.handle.registerTimer(change[3] + int(forget * 1000))
            elif self.given.exists() and self.given.get()[2]:
                self.given.clear()
            yield pd.DataFrame(out, columns=["path", "seq", "op", "content"], dtype=object)

        def close(self) -> None:
            pass

    rows = changes.select("path", F.col("seq").cast("long").alias("seq"), "op", "content", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=Settle(), outputStructType=SETTLED, outputMode="append", timeMode="EventTime")


#: Store of keyed state with timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def apply_isolated(rows: DataFrame, apply: Callable[[DataFrame], None], most: int = 1024) -> list[str]:
    """Applies changes (path, ...) and gives the paths that apply refuses: all at once, and where that fails by halves of the path hashes, so one bad
    file costs a few more passes and holds up no other. Groups that fail at 1 / `most` of the hashes are given up whole."""
    failed: list[str] = []
    todo = [(0, most)]
    place = F.pmod(F.xxhash64("path"), F.lit(most))
    while todo:
        low, high = todo.pop()
        part = rows.where((place >= low) & (place < high))
        if part.isEmpty():
            continue
        try:
            apply(part)
        except Exception:  # whatever a file's content makes the extraction raise
            if high - low == 1:
                failed += [r["path"] for r in part.select("path").distinct().collect()]
            else:
                todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
    return sorted(failed)


class Watches:
    """Running change queries by repository; starting one that runs gives the same."""

    def __init__(self) -> None:
        self.running: dict[str, StreamingQuery] = {}

    def start(self, repo_id: str, changes: DataFrame, apply: Callable[[DataFrame], None], state: str, seconds: float = 2.0) -> StreamingQuery:
        """changes (path, seq, op, content): per batch the last change of each path goes to apply. A batch is applied once, whatever is
        replayed; paths that apply refuses are listed in the folder `state`-applied and hold up no other."""
        if not self.active(repo_id):

            def batch(rows: DataFrame, number: int) -> None:
                spark, mark = rows.sparkSession, f"{state}-applied/batch={number}"
                if files_state(spark, [mark]) != NOTHING:  # given again after a failure: it was applied whole
                    return
                last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))
                chosen = materialize(rows.withColumn("_k", last).where("_k = 1").drop("_k"))
                bad = apply_isolated(chosen, apply)
                spark.createDataFrame([(p,) for p in bad], "failed string").coalesce(1).write.mode("overwrite").parquet(mark)

            self.running[repo_id] = changes.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(processingTime=f"{seconds} seconds").start()
        return self.running[repo_id]

    def active(self, repo_id: str) -> bool:
        return repo_id in self.running and self.running[repo_id].isActive

    def stop(self, repo_id: str) -> bool:
        query = self.running.pop(repo_id, None)
        if query:
            query.stop()
        return query is not None
