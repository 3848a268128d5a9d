import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from arborlens.llm.ngram_join import _need, jaccard_join, shingles


def brute(rows, width=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def texts(seed=5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdéß", k=3))
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two three four five"), (906, "É é")]
    passage = [word() for _ in range(30)]
    for base in range(6):
        words = [word() for _ in range(draw.choice((12, 60, 200)))] + passage
        for copy in range(7):
            own = list(words)
            for _ in range(copy % 4):
                own[draw.randrange(len(own))] = word()
            rows.append((base * 10 + copy, draw.choice((" ", "\n", "  ")).join(own)))
    return rows


def chained(seed=11):
    """Families whose members link along chains only, and many texts around one passage that do not link with each other."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("klmnop", k=4))
    rows, at = [], 2000
    for _ in range(4):
        own = [word() for _ in range(90)]
        for _ in range(12):
            place = draw.randrange(85)
            own = own[:place] + [word()] + own[place + 1 :]
            rows.append((at, " ".join(own)))
            at += 1
    passage, extra = [word() for _ in range(60)], [[word() for _ in range(9)] for _ in range(6)]
    for k in range(40):
        rows.append((at, " ".join(passage + [w for e in draw.sample(extra, 3) for w in e])))
        at += 1
    return rows


def test_same_as_brute_force_with_hubs_and_blocks(spark):
    rows = texts() + chained()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1))
    want = brute(rows)
    for block, rounds in ((3, 0), (512, 4)):
        assert sorted(tuple(r) for r in jaccard_join(docs, block=block, rounds=rounds).collect()) == want


def test_threshold_is_exact_for_large_counts(spark):
    sizes = spark.createDataFrame([(6_750_004, 5_400_003 + 6_750_004 - 6_750_004)], "n_a long, n_b long")
    n, m = sizes.first()
    need = sizes.select(_need(80)).first()[0]
    assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = sorted(tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_is_cut_between_words_only():
    long = b"word " * 300_000 + b"x" * 1_500_000 + b" tail"
    doc, value = shingles([b"a b c d e", long, b"a b c d e"])
    assert np.bincount(doc).tolist() == [1, 3, 1]
    assert value[0] == value[-1]
