"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Evidence: a logistic model over the shape of the whole text (shares of byte classes, word lengths, repetition), fitted
on labelled documents. Site posteriors: every document counts in its host (`source`) and path (`source`, `lang`), with
its label if it has one that may be learned from, else with the model's probability. The prior strengths are the
method-of-moments estimates of a beta-binomial: hosts shrink toward the global rate, paths toward their host's
posterior, so a sparse site falls back to what lies above it. A document's score adds the log-odds its path has beyond
the global rate to its own evidence. All site figures are grouped sums with partial aggregation, so a host with a third
of all documents costs no more than others.

Fitting reads at most `sample` labelled rows, one for each id and text (those of least hash); nothing else is sampled.

Defined results: null texts are empty; empty texts have the features of an empty text; null hosts and languages are
sites of their own; labels of the held-out quarter (crc32 of the id mod 4 = 2) and repeated labels beyond the first
are not learned from; without both labels in the sample the evidence is the prior; repeated rows are scored as rows;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WINDOW, batches_of_texts, held_out, join_spread, labelled_texts, materialize, text_bytes, text_key, with_text_score, word_hashes

SAMPLE = 20_000
_CLASSES = np.zeros((6, 256), np.float32)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:!?'\"()-")):
    _CLASSES[_k, list(_chars)] = 1
_CLASSES[5] = 1 - _CLASSES[:5].sum(0)
FEATURES = 20


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of FEATURES numbers: shares of byte classes and their square roots, word length, repetition, size."""
    n = len(texts)
    size = np.array([len(t) for t in texts], float)
    share = np.zeros((n, 6))
    some = np.flatnonzero(size)
    if len(some):
        buf = np.frombuffer(b"".join([texts[k] for k in some]), np.uint8)
        starts = np.concatenate(([0], np.cumsum(size[some])[:-1])).astype(np.int64)
        for k in range(6):
            share[some, k] = np.add.reduceat(_CLASSES[k][buf], starts, dtype=np.float64)
    share /= np.maximum(size, 1)[:, None]
    doc, word = word_hashes(texts)
    words = np.bincount(doc, minlength=n).astype(float)
    order = np.lexsort((word, doc))
    d, w = doc[order], word[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    distinct = np.bincount(d[new], minlength=n)
    again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (word[1:] == word[:-1])], minlength=n)
    per = np.maximum(words, 1)
    mean = size * (1 - share[:, 3]) / per
    # the part of distinct words falls with length by itself: compared with what its length makes usual
    usual = np.log1p(distinct) - 0.85 * np.log1p(words)
    return np.column_stack([share, np.sqrt(share), np.log1p(words), words < 5, mean, mean**2 / 10, distinct / per, usual, again / per, np.sqrt(again / per)])


def _frames(frames: Iterator[pd.DataFrame], then) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for low, high in batches_of_texts(frame, "raw", WINDOW):
            part = frame.iloc[low:high]
            yield then(part.drop(columns="raw"), features(list(part["raw"])))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept last, mean, deviation) by damped Newton steps."""
    mean, dev = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / dev, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - penalty * (w - np.where(np.arange(len(w)) == len(w) - 1, w, 0))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, dev


def logit(p):
    return F.log(p / (1 - p))


def strength(groups: DataFrame, n: str, good: str, centre) -> float:
    """Method-of-moments prior strength of a beta-binomial over the groups around `centre`."""
    at = F.col(good) / F.col(n)
    row = groups.where(F.col(n) > 0).agg(
        F.sum(F.col(n) * (at - centre) ** 2).alias("ss"), F.sum(F.col(n) * centre * (1 - centre)).alias("pq"), F.sum(n).alias("n"), F.sum(F.col(n) ** 2).alias("n2"), F.count("*").alias("g"), F.avg(centre * (1 - centre)).alias("v")
    ).first()
    if not row["g"] or row["g"] < 2 or not row["pq"]:
        return 1e6
    # E[ss] = g * v + between * (n - n2 / n), up to the groups' own binomial noise
    between = (row["ss"] - row["g"] * row["v"]) / max(1e-9, row["n"] - row["n2"] / row["n"])
    return 1e6 if between <= row["v"] / 1e6 else max(2.0, row["v"] / between - 1)


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int):
    """Function that makes, in a task, the function from texts to evidence; learned from the labelled rows of docs."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), text_bytes(F.col("text")).alias("raw"))
    learned = materialize(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` rows, repeated ids or not
    schema = "label int, x array<double>"
    rows = labelled_texts(base, learned, sample).mapInPandas(lambda f: _frames(f, lambda part, x: part.assign(x=list(x))), schema).toPandas()
    y = rows["label"].to_numpy(float)
    if 0 < y.sum() < len(y):
        w, mean, dev = fit_logistic(np.stack(rows["x"].to_list()), y)
    else:
        w, mean, dev = np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES)
    return lambda: lambda texts: np.clip(np.clip((features(texts) - mean) / dev, -8, 8) @ w[:-1] + w[-1], -20, 20)


def site_of(source: Column, lang: Column) -> Column:
    """One value for each path; nulls are paths of their own."""
    return F.to_json(F.struct(source.cast("string").alias("h"), lang.cast("string").alias("p")))


def score_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with _evidence, _host, _path and _score; rows stay where they are but for those of sites with few rows."""
    labels = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("label")).where("_id is not null and label in (0, 1)")
    labels = materialize(labels.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("label").alias("label")))
    evidence = fit_evidence(docs, labels.withColumnRenamed("_id", "doc_id"), sample)
    scored = materialize(with_text_score(docs, "_evidence", evidence).withColumn("_site", site_of(F.col("source"), F.col("lang"))), codec="zstd")
    rows = scored.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("source"), "_site", "_evidence")
    total = rows.count()
    marked = rows.groupBy("_id").agg(F.count("*").alias("k")).join(labels, "_id")
    good = F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-F.col("_evidence"))))
    paths = join_spread(rows, marked, "_id", "k", total, "left").groupBy("_site").agg(F.count("*").alias("n"), F.sum(good).alias("good"), F.first("source").alias("source"))
    paths = materialize(paths)
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    n, good = hosts.agg(F.sum("host_n"), F.sum("host_good")).first()
    rate = min(1 - 1e-4, max(1e-4, (good or 0.0) / n)) if n else 0.5
    k = strength(hosts, "host_n", "host_good", F.lit(rate))
    hosts = hosts.select(F.col("source").alias("_of"), ((F.col("host_good") + k * rate) / (F.col("host_n") + k)).alias("_host"))
    sites = materialize(paths.join(hosts, F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "source"))
    inner = strength(sites, "n", "good", F.col("_host"))
    inside = (F.col("good") + inner * F.col("_host")) / (F.col("n") + inner)
    sites = materialize(sites.select("_site", F.col("n").alias("_n"), "_host", F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), inside)).alias("_path")))
    # the model's intercept holds the global rate; the site adds what it has beyond it
    beyond = logit(F.col("_path")) - float(np.log(rate / (1 - rate)))
    joined = join_spread(scored, sites, "_site", "_n", total)
    return joined.withColumn("_score", 1 / (1 + F.exp(-(F.col("_evidence") + beyond)))).select(*docs.columns, "_evidence", "_host", "_path", "_score")


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, source, lang, evidence, host_posterior, path_posterior, score for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    names = {"_evidence": "evidence", "_host": "host_posterior", "_path": "path_posterior", "_score": "score"}
    return score_rows(rows, labels, sample).select("doc_id", "source", "lang", *(F.col(c).alias(n) for c, n in names.items()))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Rows of docs whose score is at least `least`."""
    return score_rows(docs, labels, sample).where(F.col("_score") >= least).select(*docs.columns)
