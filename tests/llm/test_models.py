import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from arborlens.llm.common import TERM_GAPS, labelled_texts, text_bytes, text_key, word_hashes
from arborlens.llm.language import Parser, folded, identify, learn_samples, suffix_automaton
from arborlens.llm.pseudo_likelihood import BRANCH, Index, Network, classes, cluster, grow, score, windows, word_counts
from arborlens.llm.pseudo_likelihood import fit as fit_language_model
from arborlens.llm.quality import score_quality
from arborlens.llm.toxicity import fit, score_toxicity

DOCS = "doc_id long, text string, lang string, source string"


def corpus(n=360, seed=9):
    """Invented documents: two languages, junk ones of low quality, insults in some; with null, empty and long texts."""
    draw = random.Random(seed)
    parts = {"xx": "ka lo mi tur ben sil dor pas".split(), "yy": "ze qui vä nor hap fru ßen jol".split()}
    rows, labels = [], []
    for i in range(n):
        lang = draw.choice(("xx", "yy"))
        words = ["".join(draw.choices(parts[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(20, 120))]
        toxic, good = i % 5 == 0, i % 4 != 1
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(("blorg", "snarf"))
        if not good:
            words = [w + "%%%" for w in words] if i % 8 == 1 else ["|"] * len(words)
        rows.append((i, " ".join(words) + ".", lang, f"s{i % 6}"))
        labels.append((i, int(good), int(toxic)))
    return [*rows, (9001, None, None, None), (9002, "", "xx", "s0"), (9003, "12 34 !!", "yy", None), (None, "ka lo mi", "xx", "s1"), (3, rows[3][1], "xx", "s3"), (9004, "kalo mi " * 40_000, "xx", "s2")], labels


def frames(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("clash")).withColumn("score", F.lit(-1.0)).withColumn("x", F.lit(1))
    return docs, spark.createDataFrame([*labels, (0, 0, 0), (None, 1, 1), (77777, None, None)], "doc_id long, quality int, toxic int"), rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality(spark):
    docs, labels, rows, truth = frames(spark)
    out = score_quality(docs, labels).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["score"] for r in out}
    right = [(got[i] >= 0.5) == bool(q) for i, q, _ in truth if held(i)]
    assert np.mean(right) > 0.97
    assert all(0 <= r["host_posterior"] <= 1 and 0 <= r["path_posterior"] <= 1 and r["score"] is not None for r in out)
    # the posteriors shrink: they vary less than the raw rates of the sites
    assert max(r["host_posterior"] for r in out) - min(r["host_posterior"] for r in out) < 0.6
    assert score_quality(docs.limit(0), labels).count() == 0
    assert score_quality(docs, labels.limit(0)).count() == len(rows)


def test_toxicity(spark):
    docs, labels, rows, truth = frames(spark)
    out = score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) and {r["predicted"] for r in out} == {0, 1}
    got = {r["doc_id"]: r for r in out}
    right = [got[i]["predicted"] == t for i, q, t in truth if held(i) and q]
    assert np.mean(right) > 0.95
    assert all(got[i]["held_out"] == held(i) for i, _, _ in truth) and got[9001]["score"] == got[9002]["score"] < 0.3
    assert all(r["score"] == 0 or r["score"] < 1e-9 for r in score_toxicity(docs, labels.limit(0)).collect())
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_factorization_machine_learns_a_pair():
    draw = np.random.default_rng(3)
    texts, y = [], []
    for _ in range(1500):
        a, b = draw.random(2) < 0.5
        texts.append(np.unique(np.concatenate(([7] if a else [], [9] if b else [], draw.integers(100, 140, 5)))).astype(np.int64))
        y.append(float(a and b))
    machine = fit(texts, np.array(y), bits=8, rounds=120)
    pairs = machine.margin(np.array([0, 0, 1, 2]), machine.slots(8)[[7, 9, 7, 9]], 3)
    assert pairs[0] > 0.5 > -0.5 > max(pairs[1:])


def test_factorization_machine_learns_a_pair_without_marginal_signal():
    draw = np.random.default_rng(3)
    texts, y = [], []
    for k in range(1600):
        # 7 and 9 are each in half of the toxic and half of the clean texts; together they are toxic, alone clean
        toxic, half = k % 4 == 0, k // 4 % 2
        own = ([7, 9] if half else [11]) if toxic else [7 if half else 9]
        texts.append(np.unique(np.concatenate((own, draw.integers(100, 140, 5)))).astype(np.int64))
        y.append(float(toxic))
    machine = fit(texts, np.array(y), bits=8)
    slots = machine.slots(8)
    assert slots[7] >= 0 and slots[9] >= 0
    pairs = machine.margin(np.array([0, 0, 1, 2]), slots[[7, 9, 7, 9]], 3)
    assert pairs[0] > 0.5 > -0.5 > max(pairs[1:])


def test_language(spark):
    docs, _, rows, _ = frames(spark)
    out = {r["doc_id"]: r for r in identify(docs, sample=6000).collect()}
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 9000}
    letters = [i for i in truth if any(c.isalpha() for c in rows[i][1])]
    assert np.mean([out[i]["lang_pred"] == truth[i] for i in letters if held(i)]) > 0.97
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert out[9004]["lang_pred"] == "xx" and all(0 <= r["score"] <= 1 for r in out.values())
    assert identify(docs.limit(0)).count() == 0


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = folded(b"abcbcabbca")
    moves = suffix_automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            at = moves[at].get(c)
            if at is None:
                return False
        return True

    body = text.tolist()
    subs = {tuple(body[i:j]) for i in range(len(body)) for j in range(i + 1, len(body) + 1)}
    draw = random.Random(1)
    assert all(accepts(s) for s in subs)
    assert all(accepts(s) == (s in subs) for s in (tuple(draw.choices([97, 98, 99], k=draw.randint(1, 5))) for _ in range(300)))


def test_phrases_are_those_of_one_greedy_parse_of_the_whole_text():
    draw = random.Random(6)
    word = lambda letters: "".join(draw.choices(letters, k=draw.randint(1, 6)))
    samples = {k: " ".join(word(v) for _ in range(600)).encode() for k, v in {"p": "abcde", "q": "cdefé"}.items()}
    own = Parser(samples, {})
    automata = {k: suffix_automaton(folded(v)) for k, v in samples.items()}

    def greedy(moves, text):
        count, state = 0, 0
        for at, c in enumerate(folded(text).tolist()):
            to = moves[state].get(c)
            count += at == 0 or to is None
            state = moves[0].get(c, 0) if to is None else to
        return max(1, count)

    whole = samples["p"] * 3  # phrases of thousands of bytes, over many runs
    texts = [whole, b"", b"a", "é".encode() * 700, *(" ".join(word("abcdefghé") for _ in range(draw.choice((3, 90, 400, 1500)))).encode() for _ in range(40)), samples["q"][:513], b"z" * 1100]
    got = own.phrases(texts)
    for row, text in zip(got.tolist(), texts, strict=True):
        assert row == [greedy(automata[k], text) for k in ("p", "q")]


def test_pseudo_likelihood(spark):
    docs, _, rows, _ = frames(spark)
    counts = {r["n"] for r in word_counts(docs).orderBy(F.desc("n")).limit(2).collect()}
    assert max(counts) >= 40_000
    out = {r["doc_id"]: r for r in score(docs, rate=2, group=3000).collect()}
    assert len(out) == len({r[0] for r in rows})
    assert out[9001]["n_tokens"] == 0 and out[9001]["score"] is None and out[9001]["log_prob"] == 0
    # a repeated phrase is the most predictable text
    assert out[9004]["score"] > np.median([r["score"] for r in out.values() if r["score"] is not None])
    assert all(r["log_prob"] <= 0 for r in out.values())
    assert score(docs.limit(0)).count() == 0


def test_pseudo_likelihood_tells_words_of_a_bucket_apart(spark):
    draw = random.Random(5)
    body = ["ka " + " ".join(draw.choices(("lomi", "turben", "silda"), (8, 3, 1), k=30)) for _ in range(200)]
    rows = list(enumerate(body)) + [(1000, "ka lomi ka"), (1001, "ka odd ka")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # one frequent class, all others in one bucket: the network cannot tell lomi from odd
    def scores(head):
        return {r["doc_id"]: r["log_prob"] for r in score(docs, words=1, buckets=1, head=head, clusters=0).collect()}

    n = {w: sum(t.split().count(w) for _, t in rows) for w in ("lomi", "odd", "ka")}
    most = max(("lomi", "turben", "silda", "ka"), key=lambda w: sum(t.split().count(w) for _, t in rows))
    assert most == "lomi"
    total = sum(len(t.split()) for _, t in rows) - n["lomi"]
    alone = score(docs, words=0, buckets=1, rounds=0, clusters=0).collect()
    want = {i: sum(np.log(sum(u.split().count(w) for _, u in rows) / (total + n["lomi"] + 1)) for w in t.split()) for i, t in rows}
    assert all(abs(r["log_prob"] - want[r["doc_id"]]) < 1e-3 for r in alone)
    few, many = scores(1), scores(1000)
    assert all(abs(few[i] - many[i]) < 0.05 * abs(many[i]) for i in many)
    assert many[1000] > many[1001] + 3


def tongues(n=240, seed=4):
    """Texts of two invented languages that share no word; most words are rare."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        small, rare = (("ka", "lo", "mi"), "tur") if k % 2 else (("ze", "vu", "xi"), "bon")
        out.append((k, " ".join(draw.choice(small) if draw.random() < 0.5 else f"{rare}{int(draw.paretovariate(0.7)) % 900}" for _ in range(draw.choice((1, 3, 40, 90))))))
    return [*out, (n, ""), (n + 1, None), (n + 2, "?!"), (n + 3, "neverseenelsewhere"), (n + 3, "ka tur1 ze")]


def test_pseudo_likelihood_equals_brute_force(spark):
    rows = tongues()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for settings in ({}, {"head": 40, "words": 5}):
        model, coded = fit_language_model(docs, **settings)
        got = sorted((r["doc_id"], r["n_tokens"], r["log_prob"]) for r in model.scored(coded).collect())
        texts = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows]
        count = Counter(w for _, t in texts for w in t)
        names = sorted(count)
        hashes = word_hashes([w.encode() for w in names], TERM_GAPS)[1]
        kind = dict(zip(names, model.kinds(hashes, Index(model.heads))[0].tolist(), strict=True))
        mass = Counter()
        for w, n in count.items():
            mass[kind[w]] += n
        net, want = Network(model.flat, model.size, model.hidden), []
        for i, t in texts:
            total = 0.0
            for k, w in enumerate(t):
                around = [kind[t[k + o]] if 0 <= k + o < len(t) else model.size for o in (-2, -1, 1, 2)]
                h = np.tanh(net.bias + sum(net.embed[o][c] for o, c in enumerate(around)))
                z = (h @ net.out + net.prior).astype(float)
                total += z[kind[w]] - np.log(np.exp(z).sum())
                if kind[w] >= len(model.frequent):
                    total += np.log(count[w] / (mass[kind[w]] + 1))
            want.append((i, len(t), total))
        for (i, n, value), (j, m, other) in zip(got, sorted(want), strict=True):
            assert (i, n) == (j, m) and abs(value - other) < 1e-3 * max(1, abs(other))
        # words that were seen once have hash classes, and classes keep the languages apart
        first = len(model.frequent) + model.clusters
        assert all(kind[w] >= first for w, n in count.items() if n == 1 and kind[w] >= len(model.frequent))
        sides = {k: {w[:3] for w in names if kind[w] == k} for k in set(kind.values()) if len(model.frequent) <= k < first}
        assert sides and sum(len(v & {"tur", "bon"}) > 1 for v in sides.values()) <= len(sides) // 4


def test_clusters_make_context_tell(spark):
    rows = tongues(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    mean = lambda **kw: score(docs, words=6, hidden=8, **kw).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert mean(clusters=6, buckets=2) > mean(clusters=0, buckets=8) + 0.1


def test_words_of_a_cluster_follow_their_context(spark):
    draw = random.Random(6)
    rows = [(k, " ".join(f"{lead} {lead}{draw.randrange(20)}x" for lead in draw.choices(("ka", "ze"), k=60))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # one cluster holds all words but ka and ze; what stands before each of them says which half of it can come
    mean = lambda branch: score(docs, words=2, clusters=1, buckets=1, branch=branch).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert mean(BRANCH) > mean(0) + 0.2


def test_trees_equal_brute_force(spark):
    rows = tongues()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows]
    count = Counter(w for _, t in texts for w in t)
    names = sorted(count)
    hashes = word_hashes([w.encode() for w in names], TERM_GAPS)[1]
    for settings in ({"rounds": 0}, {}, {"head": 40, "words": 5}):
        model, rows_ = fit_language_model(docs, branch=BRANCH, **settings)
        kind, at, found = model.kinds(hashes, Index(model.heads))
        leaf = np.where(found & (kind >= len(model.frequent)), model.leaf[at] if len(at) else -1, -1)
        kind, leaf = (dict(zip(names, x.tolist(), strict=True)) for x in (kind, leaf))
        assert {w for w in names if leaf[w] >= 0} == {w for w in names if len(model.frequent) <= kind[w] < len(model.frequent) + model.clusters}
        mass = Counter()
        for w, n in count.items():
            mass[kind[w]] += n
        trees, net = model.trees, Network(model.flat, model.size, model.hidden)

        def inside(w, h):
            total = 0.0
            for step in trees.steps[trees.first[leaf[w]] : trees.first[leaf[w] + 1]].tolist():
                z = float(np.append(h[: BRANCH - 1], 1) @ trees.nodes[step // 2])
                total -= np.log1p(np.exp(-z if step % 2 else z))
            return total

        want = []
        for i, t in texts:
            total = 0.0
            for k, w in enumerate(t):
                around = [kind[t[k + o]] if 0 <= k + o < len(t) else model.size for o in (-2, -1, 1, 2)]
                h = np.tanh(net.bias + sum(net.embed[o][c] for o, c in enumerate(around)))
                z = (h @ net.out + net.prior).astype(float)
                total += z[kind[w]] - np.log(np.exp(z).sum())
                if leaf[w] >= 0:
                    total += inside(w, h)
                elif kind[w] >= len(model.frequent):
                    total += np.log(count[w] / (mass[kind[w]] + 1))
            want.append((i, len(t), total))
        got = sorted((r["doc_id"], r["n_tokens"], r["log_prob"]) for r in model.scored(rows_).collect())
        for (i, n, value), (j, m, other) in zip(got, sorted(want), strict=True):
            assert (i, n) == (j, m) and abs(value - other) < 1e-3 * max(1, abs(other))
        # a cluster's words have all of its probability, in an untrained tree their shares of its counts
        for k in range(len(model.frequent), len(model.frequent) + model.clusters):
            own = [w for w in names if kind[w] == k]
            share = {w: np.exp(inside(w, h)) for w in own}
            assert not own or abs(sum(share.values()) - 1) < 1e-4
            assert settings != {"rounds": 0} or all(abs(share[w] - count[w] / mass[k]) < 1e-4 for w in own)


def test_trees_are_sent_by_their_last_steps():
    draw = np.random.default_rng(3)
    label = np.append(draw.integers(0, 5, 3000), 5)  # the last leaf is alone and has no steps
    trees = grow(draw.normal(size=(3001, 4)).astype(np.float32), draw.random(3001) + 0.1, label, 8)
    sent = pickle.dumps(trees, 5)
    back = pickle.loads(sent)
    assert all((getattr(back, k) == getattr(trees, k)).all() for k in ("first", "steps", "nodes"))
    assert len(sent) < trees.nodes.nbytes + trees.steps.nbytes // 3
    assert len(pickle.loads(pickle.dumps(grow(np.zeros((1, 2), np.float32), np.ones(1), np.zeros(1, np.int64), 3))).steps) == 0


def test_training_leaves_no_shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in map(store.getAllFiles().apply, range(store.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = files()
    docs = spark.createDataFrame(tongues(), "doc_id long, text string").repartition(3)
    got = score(docs, branch=BRANCH)
    time.sleep(2)  # blocks go in the background
    assert not files() - before
    assert got.count() == len(tongues())


def test_trees_split_by_weight_and_direction():
    x = np.array([[1, 0], [0, 1], [0.9, 0.1], [0.1, 0.9], [1, 0]], np.float32)
    trees = grow(x, np.array([1, 2, 3, 4, 5.0]), np.array([0, 0, 0, 0, 1]), 3)
    _, node, side = trees.ways(np.arange(5))
    assert np.diff(trees.first).tolist() == [2, 2, 2, 2, 0] and len(trees.nodes) == 3
    first = dict(zip((0, 1, 2, 3), side[::2].tolist(), strict=True))
    assert first[0] == first[2] != first[1] == first[3] and set(node[::2].tolist()) == {0}
    same = grow(np.ones((3, 2), np.float32), np.ones(3), np.zeros(3, np.int64), 3)
    assert np.exp(same.log_probs(np.zeros((3, 2), np.float32), np.arange(3))).round(5).tolist() == [0.33333] * 3
    assert len(grow(x[:0], np.zeros(0), np.zeros(0, np.int64), 3).nodes) == 0


def test_index_finds_what_is_there():
    draw = np.random.Generator(np.random.PCG64(3))
    for n in (0, 1, 2, 500):
        own = np.unique(np.concatenate((draw.integers(0, 2**64, n, dtype=np.uint64), np.arange(min(n, 9), dtype=np.uint64))))  # some share a prefix
        ask = np.concatenate((own, draw.integers(0, 2**64, 50, dtype=np.uint64), np.array([0, 7, 11, 2**64 - 1], np.uint64)))
        at, found = Index(own).places(ask)
        assert (found == np.isin(ask, own)).all() and (own[at[found]] == ask[found]).all()


def test_cluster_of_directions():
    x = np.array([[1, 0], [0.98, 0.199], [0, 1], [0.199, 0.98]], np.float32)
    own = cluster(x, np.ones(4), 2)
    assert own[0] == own[1] != own[2] == own[3]
    assert len(set(cluster(x[:1].repeat(3, 0), np.ones(3), 4).tolist())) == 1


def test_network_sums_to_one_and_sees_both_sides():
    net = Network(Network.fresh(6, 4), 6, 4)
    context = np.array([[0, 1, 2, 3]])
    p = np.exp([net.log_probs(context, np.array([k]))[0] for k in range(6)])
    assert abs(p.sum() - 1) < 1e-4
    kind = classes(np.arange(5, dtype=np.uint64), np.array([1, 3], np.uint64), 4)
    assert kind[1] == 0 and kind[3] == 1 and (kind[[0, 2, 4]] >= 2).all()
    w = windows(np.array([0, 0, 0, 1]), np.array([5, 4, 3, 2]), 9)
    assert w.tolist() == [[9, 9, 4, 3], [9, 5, 3, 9], [5, 4, 9, 9], [9, 9, 9, 9]]


def test_repeated_ids_stay_within_the_sample(spark):
    rows = [(1, f"text {k % 700}") for k in range(1400)] + [(2, "other"), (2, "other"), (3, "unlabelled")]
    base = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", text_key(F.col("text")).alias("_key"), text_bytes(F.col("text")).alias("raw"))
    learned = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    few = labelled_texts(base, learned, 50).collect()
    assert len(few) == 50 and len({bytes(r["raw"]) for r in few}) == 50
    every = labelled_texts(base, learned, 5000).collect()
    assert len(every) == 701 and sum(r["label"] for r in every) == 1
    # a scorer asked for `sample` rows takes no more of them to the driver
    assert score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), learned.select("doc_id", F.col("label").alias("toxic")), sample=60).count() == len(rows)


def test_language_sample_of_a_repeated_id(spark, monkeypatch):
    from arborlens.llm import language

    seen = []
    draw = random.Random(8)
    rows = [(1, " ".join(draw.choices(("ka", "lo", "mi", "tur"), k=6)) + f" w{k}", "xx") for k in range(500)]
    rows += [(1, rows[0][1], "xx")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    real = language.materialize
    monkeypatch.setattr(language, "materialize", lambda df: seen.append(real(df)) or seen[-1])
    train, unseen = learn_samples(docs, 2000)
    # as many different texts as the bound takes, not one text 128 times
    assert seen[0].count() == seen[0].select("_key").distinct().count() == language.DOCS
    assert len(train["xx"]) == 2000 and unseen["xx"]


def test_language_sample_takes_a_share_of_every_document(spark):
    draw = random.Random(6)
    rows = [(k, "same again " * 400 if k % 2 else f"doc{k} " + " ".join(draw.choices("abcdefgh", k=300)), "xx") for k in range(0, 60)]
    rows = [(k, f"{t} end{k}", lang) for k, t, lang in rows if not held(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train, unseen = learn_samples(docs, 4000)
    names = [f"doc{k} " for k, _, _ in rows if k % 2 == 0]
    learned = {n for n in names if n.encode() in train["xx"]}
    apart = {n for n in names if n.encode() in unseen["xx"]}
    assert learned and apart and not learned & apart and learned | apart == set(names)
    assert 3500 < len(train["xx"]) <= 4000 and len(unseen["xx"]) <= 1000
    one, rest = learn_samples(docs, 4000, most=1)
    assert one["xx"] and rest["xx"]


def test_each_context_is_asked_once(monkeypatch):
    draw = np.random.default_rng(8)
    size, hidden, n = 12, 9, 500
    trees = grow(draw.normal(size=(40, 4)).astype(np.float32), draw.random(40) + 0.1, draw.integers(0, 2, 40), BRANCH)
    trees.nodes[:] += draw.normal(size=trees.nodes.shape)
    net = Network(Network.fresh(size, hidden), size, hidden)
    some = draw.integers(0, size + 1, (5, 4))
    context, target, leaf = some[draw.integers(0, 5, n)], draw.integers(0, size, n), draw.integers(-1, 40, n)
    asked, hidden_of = [], Network.hidden
    monkeypatch.setattr(Network, "hidden", lambda self, c: asked.append(len(c)) or hidden_of(self, c))
    got = net.log_probs(context, target, 64, trees, leaf)
    assert sum(asked) == len(np.unique(some, axis=0)) < n
    # position by position: log-probabilities and the gradients of one batch
    embed, out, nodes = net.embed.astype(float), net.out.astype(float), trees.nodes.astype(float)
    grad = Network(np.zeros(len(net.flat)), size, hidden)
    inner, often = np.zeros_like(nodes), np.zeros(len(nodes))
    for k in range(n):
        h = np.tanh(net.bias + sum(embed[o][c] for o, c in enumerate(context[k])))
        z = h @ out + net.prior
        p = np.exp(z) / np.exp(z).sum()
        want, dz = np.log(p[target[k]]), (p - np.eye(size)[target[k]]) / n
        dh, read = out @ dz, np.append(h[: BRANCH - 1], 1)
        for step in trees.steps[trees.first[leaf[k]] : trees.first[leaf[k] + 1]].tolist() if leaf[k] >= 0 else []:
            node, side = step // 2, step % 2
            right = 1 / (1 + np.exp(-nodes[node] @ read))
            want += np.log(1 - right if not side else right)
            dh[: BRANCH - 1] += (right - side) * nodes[node][:-1] / n
            inner[node] += (right - side) * read
            often[node] += 1
        assert abs(got[k] - want) < 1e-4
        dh *= 1 - h * h
        grad.out[...] += np.outer(h, dz)
        grad.prior[...] += dz
        grad.bias[...] += dh
        for o, c in enumerate(context[k]):
            grad.embed[o][c] += dh
    flat = net.flat - 0.05 * grad.flat / np.sqrt(1e-4 + grad.flat**2)
    nodes -= 0.5 * inner / np.sqrt(1 + (inner**2).max(1))[:, None]
    asked.clear()
    passed = net.train(context, target, np.full(len(flat), 1e-4, np.float32), trees=trees, leaf=leaf, past_nodes=np.ones(len(nodes), np.float32))
    assert sum(asked) == len(np.unique(some, axis=0))
    assert (passed == often).all()
    assert np.abs(net.flat - flat).max() < 1e-3 and np.abs(trees.nodes - nodes).max() < 1e-3
    assert len(net.log_probs(context[:0], target[:0], trees=trees, leaf=leaf[:0])) == 0
