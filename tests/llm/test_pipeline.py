import random
import re
from collections import Counter

import corpus_pipeline
from arborlens.llm.mixing import mix_sources, mixed_rows, source_targets, word_count
from arborlens.llm.quality import keep_quality
from arborlens.llm.toxicity import keep_clean
from pyspark.sql import functions as F

from .test_models import DOCS, corpus, frames


def filling(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    total, fixed = share * sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        level = (total - sum(fixed.values())) / sum(weights[k] for k in free) if free else 0
        over = [k for k in free if level * weights[k] > cap * sizes[k]]
        if not over:
            return [fixed.get(k, level * weights[k]) for k in range(len(sizes))]
        fixed |= {k: cap * sizes[k] for k in over}


def test_targets_and_samples(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randint(0, 50)) or None, draw.choice(["a", "b", "B", "é", None, "big", "big", "big"])) for i in range(900)] + [(5, "w w", "a"), (5, "w w", "a"), (None, "w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mix_sources(docs).collect()
    assert len(out) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows if r[2] == n) for n in names]
    want = dict(zip(names, filling(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    taken = Counter()
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[n] - want[n]) <= 101 for n in names)
    assert sorted(map(str, out)) == sorted(map(str, mix_sources(docs.repartition(7)).collect()))
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == sum(taken.values())
    assert mix_sources(docs.limit(0)).count() == 0 and mixed_rows(docs.limit(0)).count() == 0


def test_source_targets_of_many_sources(spark):
    draw = random.Random(2)
    sizes = [draw.choice((0, 1, 10, 1000, 50_000)) for _ in range(40)]
    rows = [(f"s{k:03}", n) for k, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long"), (5, 2, 1), 1.5, 2.0).collect()}
    want = filling(sizes, [(5, 2, 1)[k % 3] for k in range(40)])
    assert all(abs(got[f"s{k:03}"] - w) < 1e-6 * max(1, w) for k, w in enumerate(want))


def test_pipeline_stages(spark, tmp_path):
    rows, labels = corpus()
    rows = [(*r, len(r[1] or "")) for r in rows]
    copy = next(r for r in rows if r[0] is not None and r[0] % 5 and r[0] % 4 != 1)
    rows += [(5000 + k, copy[1] + " mi", *copy[2:]) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    bad = {i for i, q, _ in labels if not q}
    toxic = {i for i, q, t in labels if t and q}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        seen.append(set(ids))
        if name != "best-fit packing":
            assert docs.columns == before.columns
    known = {i for i, _, _ in labels}
    assert len(bad & seen[0]) <= 0.03 * len(bad) and len((known - bad) - seen[0]) <= 0.03 * len(known)
    assert len(toxic & seen[1]) <= 0.1 * len(toxic) and len((known - bad - toxic) - seen[1]) <= 0.05 * len(known)
    assert copy[0] in seen[2] and not {5000 + k for k in range(6)} & seen[2]
    assert seen[3] <= seen[2] and seen[4] == seen[3]


def test_rows_are_kept_by_their_own_text(spark):
    docs, labels, rows, truth = frames(spark)
    docs = docs.drop("label", "score", "x")
    known = {i: (q, t) for i, q, t in truth}
    # clean and bad texts under no id and under one repeated id without label
    picked = [(i, s, *rows[i][1:]) for i in range(40, 80) for s in (None, 4242)]
    more = spark.createDataFrame([r[1:] for r in picked], DOCS)
    both = docs.where("doc_id is not null").unionByName(more)
    for keep, bad in ((keep_quality, lambda i: not known[i][0]), (keep_clean, lambda i: known[i] == (1, 1))):
        kept = Counter((r["doc_id"], r["text"]) for r in keep(both, labels).collect())
        for shared in (None, 4242):
            good = [r for r in picked if r[1] == shared and known[r[0]] == (1, 0)]
            wrong = [r for r in picked if r[1] == shared and bad(r[0])]
            assert sum((shared, r[2]) in kept for r in good) >= 0.9 * len(good) > 0
            assert sum((shared, r[2]) in kept for r in wrong) <= 0.1 * len(wrong) and wrong


def test_near_duplicates_go_by_row(spark):
    draw = random.Random(12)
    text = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    one, two, three, four = text(60), text(60), text(60), text(60)
    rows = [(3, one), (7, one + " more"), (7, two), (None, two), (None, three), (None, three + " more"), (9, three), (11, four), (11, four), (None, None), (4, ""), (4, ""), (None, "few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(3, one), (7, two), (9, three), (11, four), (None, None), (4, ""), (4, ""), (None, "few words")]
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
    # the mix takes rows of one id, or of none, by themselves
    mixed = Counter((r["doc_id"], r["text"]) for r in mixed_rows(docs, share=2.0).collect())
    assert set(mixed) <= {tuple(r) for r in rows} and all(n <= 2 * rows.count(r) for r, n in mixed.items())
