"""As-of joins, totals, the vector index, streams with late rows and state, and the projection's copies."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlens.operators.temporal import asof_join, rollup_totals
from arborlens.operators.vector_index import VectorIndex
from arborlens.plans import graph_queries
from arborlens.plans.code_projection import code_graph
from arborlens.streaming.changes import STATE_STORE, Watches, apply_isolated, interval_join, run_available, settle_changes, sliding_counts


# ---------------------------------------------------------------- as-of joins and totals


@pytest.mark.parametrize("tolerance, span", [(None, 7.0), (5.0, 7.0), (30.0, 1000.0), (0.0, 3.0)])
def test_asof_join_equals_a_search(spark, tolerance, span):
    draw = random.Random(5)
    left = [(k, draw.choice(["a", "hot", "hot", "hot", None, "z"]), draw.choice([None, *range(-60, 60)]) if k % 9 == 0 else draw.randint(-60, 60)) for k in range(300)]
    right = [(draw.choice(["a", "hot", "hot", None, "b"]), draw.choice([None, *range(-60, 60, 4)]), n) for n in range(120)]
    got = asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, at int, n int"), "k", "t", "at", tolerance, span, tie="n")
    assert got.columns == ["id", "k", "t", "at", "n"]
    want = []
    for i, k, t in left:
        met = [(at, n) for rk, at, n in right if rk == k and k is not None and None not in (at, t) and at <= t and (tolerance is None or t - at <= tolerance)]
        want.append((i, k, t, *(max(met) if met else (None, None))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert asof_join(spark.createDataFrame(left, "id int, k string, t int").limit(0), spark.createDataFrame(right, "k string, at int, n int"), "k", "t", "at").count() == 0


def test_rollup_keeps_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), (None, "x"), ("a", "x")], "p string, q string")
    got = sorted((tuple(r) for r in rollup_totals(rows, ["p", "q"], {"n": F.count("*")}).collect()), key=repr)
    assert got == sorted([(0, None, None, 4), (1, "a", None, 3), (1, None, None, 1), (2, "a", None, 1), (2, "a", "x", 2), (2, None, "x", 1)], key=repr)


# ---------------------------------------------------------------- vector index


def nearest(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit @ unit.T, 9)
    out = []
    for q in queries:
        order = [j for j in np.lexsort((ids, -s[q])) if j != q][:k]
        out += [(int(ids[q]), r, int(ids[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def test_index_is_exact_and_probes_read_less(spark, tmp_path):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8)) * 4
    x = np.concatenate([centres[k % 12] + draw.normal(size=8) * 0.4 for k in range(400)]).reshape(400, 8)
    x[300:380] = x[300]  # a third in one place, and ties
    ids = np.arange(400) * 3
    rows = [(int(i), [float(v) for v in r], "clash") for i, r in zip(ids, x)] + [(5000, None, "c"), (5001, [0.0] * 8, "c"), (5002, [float("nan")] * 8, "c"), (5003, [1.0], "c"), (None, [1.0] * 8, "c")]
    frame = spark.createDataFrame(rows, "id long, vector array<double>, cell string")
    index = VectorIndex.build(frame, str(tmp_path / "i"), cells=15)
    asked = frame.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    queries = [k for k in range(400) if ids[k] % 20 == 0]
    for block in (20_000, 25):
        got = sorted((r.query_id, r.rank, r.id) for r in index.search(asked, 5, block=block).collect())
        assert got == nearest(ids, x, queries, 5)
    assert index.recall(asked, 5, probes=3) >= 0.9
    read = index.rows_read(asked, probes=2).first()
    assert read.compared < 0.6 * read.without_index and read.cells_read <= 15
    assert index.search(asked.limit(0), 5).count() == 0
    empty = VectorIndex.build(frame.limit(0), str(tmp_path / "e"))
    assert empty.search(asked, 5).count() == 0


def test_index_refresh_embeds_changed_texts_only(spark, tmp_path):
    from arborlens.functions.embedding import embed

    seen = []

    def embedder(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return embed(rows, "id", "text", 16).withColumnRenamed("embedding", "vector")

    texts = {k: f"word{k % 7} other{k} thing{k % 3}" for k in range(60)}
    table = lambda t: spark.createDataFrame(list(t.items()), "id long, text string")
    made = embed(table(texts), "id", "text", 16).withColumnRenamed("embedding", "vector").join(table(texts).select("id", F.md5(F.col("text").cast("binary")).alias("digest")), "id")
    index = VectorIndex.build(made, str(tmp_path / "r"), cells=6)
    texts[3], texts[900] = "quite new words here", "another new text"
    del texts[10]
    counts = index.refresh(table(texts), embedder)
    assert seen == [[3, 900]] and (counts["embedded"], counts["gone"]) == (2, 1)
    rows = {r.id: r for r in index.lists.collect()}
    assert set(rows) == set(texts) and index.lists.count() == len(texts)
    again = index.refresh(table(texts), embedder)
    assert again == {"embedded": 0, "gone": 0, "cells_written": 0}
    fresh = embed(table(texts), "id", "text", 16).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    best = {r.query_id: r.id for r in index.search(fresh.where("query_id = 900"), 1).collect()}
    assert set(best) == {900} and best[900] != 900


# ---------------------------------------------------------------- streams


EVENT = "event_id long, ts timestamp, event_type string, user_id long"


def at(hours):
    return dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hours)


def parts(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"{k}.parquet"))
    return str(folder / "*.parquet")


def test_sliding_windows_leave_late_rows_out(spark, tmp_path):
    # a batch drops what was late for the watermark before the last one
    batches = [[(1, at(0), "a", 1), (2, at(100), "a", 1)], [(4, at(100.25), "a", 1)], [(3, at(1), "a", 1), (5, at(99), "a", 1)]]
    path = parts(spark, tmp_path, batches, EVENT)
    schema = spark.read.schema(EVENT).parquet(path).schema
    plan = lambda s: sliding_counts(s, "2 hours", "1 hour")
    got = {(r.start, r.n) for r in run_available(spark, path, schema, plan, ["start", "event_type"], files=1).collect()}
    # row 3 came 99 hours behind: dropped; row 5 within the day: counted
    assert got == {("2024-01-09 23:00:00", 1), ("2024-01-10 00:00:00", 1), ("2024-01-14 03:00:00", 3), ("2024-01-14 04:00:00", 2), ("2024-01-14 02:00:00", 1)}


def test_interval_join_equals_the_batch_join(spark, tmp_path):
    draw = random.Random(1)
    rows = [(k, at(k * 0.3), draw.choice("ab"), draw.randint(0, 3)) for k in range(120)]
    path = parts(spark, tmp_path, [rows[:40], rows[40:80], rows[80:]], EVENT)
    schema = spark.read.schema(EVENT).parquet(path).schema

    def plan(s):
        side = lambda kind, n: s.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(n), F.col("ts").alias(f"{n}_at"))
        return interval_join(side("a", "x"), side("b", "y"), "user_id", "x_at", "y_at", "2 hours").select("x", "y")

    got = sorted(tuple(r) for r in run_available(spark, path, schema, plan, append=True, files=1).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == "a" and b[2] == "b" and a[3] == b[3] and dt.timedelta() <= b[1] - a[1] <= dt.timedelta(hours=2))
    assert got == want and got


CHANGE = "path string, seq long, op string, content string, at timestamp"


def test_changes_settle_once_whatever_is_replayed(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    try:
        first = [("a", 1, "update", "x", at(0)), ("a", 2, "update", "y", at(0.0001)), ("b", 3, "update", "b", at(0)), ("clock", 4, "update", "t", at(1))]
        second = [*first[:3], ("b", 5, "update", "b", at(1.1)), ("c", 6, "delete", None, at(1.1)), ("clock", 7, "update", "t", at(2))]
        third = [("c", 8, "update", "again", at(3)), ("a", 9, "delete", None, at(3)), ("clock", 10, "update", "t2", at(4))]
        last = [("clock", 11, "update", "t3", at(5))]
        folder, base = tmp_path / "in", str(tmp_path / "state")
        schema = spark.createDataFrame([], CHANGE).schema
        go = lambda: sorted((r.path, r.seq, r.op, r.content) for r in run_available(spark, str(folder / "*.parquet"), schema, settle_changes, append=True, files=1, base=base).collect())
        parts(spark, folder, [first, second], CHANGE)
        one = go()
        assert ("a", 2, "update", "y") in one and ("b", 3, "update", "b") in one and not [r for r in one if r[1] in (1, 5)]
        # a restart goes on from the state on disk
        parts(spark, tmp_path / "more", [third, last], CHANGE)
        for k in (0, 1):
            (tmp_path / "more" / f"{k}.parquet").rename(folder / f"{k + 2}.parquet")
        two = go()
        new = [r for r in two if r not in one]
        assert ("a", 9, "delete", None) in two and ("c", 8, "update", "again") in two and [r for r in two if r[0] == "a"] == [("a", 2, "update", "y"), ("a", 9, "delete", None)]
        assert len(set(two)) == len(two) and new
    finally:
        spark.conf.unset(STATE_STORE[0])


def test_a_bad_file_holds_up_no_other(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{k}", k, "update", "bad" if k in (3, 17) else "ok") for k in range(25)], "path string, seq long, op string, content string")
    done = []

    def apply(part):
        found = part.collect()
        if any(r.content == "bad" for r in found):
            raise ValueError("cannot be read")
        done.extend(r.path for r in found)

    assert apply_isolated(rows, apply) == ["p17", "p3"]
    assert sorted(done) == sorted(f"p{k}" for k in range(25) if k not in (3, 17))
    # a batch that is given again is not applied again
    source, state = tmp_path / "s", str(tmp_path / "w")
    rows.where("seq < 3").coalesce(1).write.parquet(str(source))
    done.clear()
    watches = Watches()
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    watches.start("r", stream, apply, state, 0.1).processAllAvailable()
    watches.stop("r")
    assert sorted(done) == ["p0", "p1", "p2"]
    (tmp_path / "w" / "commits" / "0").unlink()
    (tmp_path / "w" / "commits" / ".0.crc").unlink(missing_ok=True)
    watches.start("r", stream, apply, state, 0.1).processAllAvailable()
    watches.stop("r")
    assert sorted(done) == ["p0", "p1", "p2"]


# ---------------------------------------------------------------- copies of the projection


def test_the_projection_follows_its_tables(spark, tmp_path):
    import shutil

    folder = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", folder)
    before = graph_queries.routes(spark, str(folder)).count()
    assert before == graph_queries.routes(spark, "/root/testdata/sf0.001").count() > 20
    called = graph_queries.callees_of(spark, str(folder)).count()
    written = set(code_graph(spark, str(folder))._written)
    assert {"CALLS", "Function"} <= written and "IMPORTS" not in written
    few = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey between 1 and 10").toPandas()
    (folder / "customer.parquet").unlink()
    few.to_parquet(folder / "customer.parquet")
    assert graph_queries.routes(spark, str(folder)).where("handler is not null").count() == 10
    assert graph_queries.callees_of(spark, str(folder)).count() == called


def test_ends_of_joins_are_estimated_by_the_columns_that_are_written(spark):
    graph = code_graph(spark, "/root/testdata/sf0.01")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ends, steps = graph.label("Function", id="id", name="qualified_name"), graph.edge("CALLS").select("src", "dst")
    # null columns once made two columns look like 3 % of the file, so that eleven million rows were broadcast
    assert size(ends) > size(graph._written["Function"]) / 4
    assert size(steps) > size(graph._written["CALLS"]) / 2
    # the number of tests is joined only where it is asked for
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(graph.label("Function", id="id")) and "Join" in plan(graph.label("Function", n="tested_by_count"))
