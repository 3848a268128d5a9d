"""Conversation repair, filter audit and substring dedup against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from arborlens.llm.conversation_repair import PUT_IN, Repair, damage, repair_report, repaired_turns
from arborlens.llm.filter_audit import audit_filters, lattice
from arborlens.llm.substring_dedup import SuffixAutomaton, remove_repeats, repeated_windows, segments

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- conversation repair


def cheapest(turns):
    """(cost, edits, lines) of the best of all edits of (role, text, must go, truncated), two inserts at a place at most."""
    found = []

    def go(k, roles, cost, edits, lines):
        for inserts in product("ua", repeat=0), product("ua", repeat=1), product("ua", repeat=2):
            for put in inserts:
                now, paid, done = roles + "".join(put), cost + 3 * len(put), edits + "I" * len(put)
                said = lines + [{"u": "user:", "a": "assistant:"}[r] for r in put]
                if not re.fullmatch(r"s?(ua)*u?", now):
                    continue
                if k == len(turns):
                    if re.fullmatch(r"(s?(ua)+)?", now):
                        found.append((paid, done, said))
                    continue
                role, text, must, cut = turns[k]
                go(k + 1, now, paid + 4, done + "D", said)
                if not must:
                    more = 3 if cut else 0
                    if role[:1] in tuple("sua"):
                        go(k + 1, now + role[:1], paid + more, done + "K", [*said, f"{role}:{text}"])
                    go(k + 1, now + "u", paid + 3 + more, done + "R", [*said, f"user:{text}"])
                    go(k + 1, now + "a", paid + 3 + more, done + "R", [*said, f"assistant:{text}"])

    go(0, "", 0, "", [])
    return min(found)


def repaired(turns):
    letters, lines = [], []

    def emit(letter, role, text):
        letters.append(letter)
        if role is not None:
            lines.append(f"{role}:{text}")

    work = Repair(emit, {})
    for turn in turns:
        work.add(*turn)
    return work.close(), "".join(letters), lines, work.most_unsettled


def test_repair_equals_the_best_of_all_edits():
    draw = random.Random(3)
    for _ in range(120):
        turns = [(draw.choice(["system", "user", "assistant", "tool", ""]), f"t{k}", draw.random() < 0.25, draw.random() < 0.3) for k in range(draw.randint(0, 4))]
        turns = [(r, t, must, cut and not must) for r, t, must, cut in turns]
        assert repaired(turns)[:3] == cheapest(turns), turns


def test_repair_compares_complete_tied_suffixes():
    """Long random conversations against a table of complete strings of edits, without pruning or shared histories."""
    draw = random.Random(4)
    for _ in range(40):
        turns = [(draw.choice(["system", "user", "user", "assistant", "x"]), str(k), draw.random() < 0.5, False) for k in range(60)]
        best = {"": (0, "")}
        for role, _, must, _ in turns:
            new = {}
            for state, (cost, edits) in best.items():
                for k in range(3):
                    options = [("D", state, 4)]
                    if not must:
                        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                        options += [("K", role[:1], 0)] * (role[:1] in tuple(legal)) + [("R", PUT_IN[state][0], 3)]
                    for letter, to, price in options:
                        new[to] = min(new.get(to, (10**9, "")), (cost + 3 * k + price, edits + "I" * k + letter))
                    state = PUT_IN[state][0]
            best = new
        ends = [(c + 3 * k, e + "I" * k) for s, (c, e) in best.items() for k in range(3) if (s in ("", "a") and k == 0) or (s == "u" and k == 1) or (s == "s" and k == 2)]
        assert repaired(turns)[:2] == min(ends)


def test_repair_settles_long_conversations():
    turns = [(("user", "assistant")[k % 2] if k % 97 else "user", str(k), k % 31 == 5, False) for k in range(20_000)]
    cost, edits, lines, unsettled = repaired(turns)
    assert unsettled < 200 and len(edits) >= 20_000 and cost > 0
    assert repaired([("user", "", True, False)] * 5_000)[3] < 5  # nothing but turns that must go


def harm(rows):
    out, space = [], lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(rows):
    got = {}
    harmed = harm(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in harmed if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, role, text in own:
            bare = text.strip(" \t\n\r\v\f")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
            turns.append((role, text, fault in ("b", "d"), fault == "t"))
        numbers = {r[0] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, lines, _ = repaired(turns)
        got[conv] = (gaps, blank, duplicate, truncated, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return got


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, kind int, late string"


def conversations():
    draw = random.Random(9)
    texts = ["Yes.", "No!", "And then", " \t", "", None, "Ünd? \n", "a.b"]
    rows = []
    for conv in [*range(60), None]:
        for k in range(draw.randint(1, 9)):
            turn = draw.choice([k, k, k, k + 2, None, draw.randint(0, 3)])
            rows.append((conv, turn, draw.choice(["system", "user", "assistant", "tool", "", None]), draw.choice(texts), "x", 1, "y"))
    rows += [(5, 900 + k % 2, "user", "Again.", "x", 1, "y") for k in range(300)]  # one text of most rows
    return rows


def test_repair_query_equals_brute_force(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r[0]: tuple(r)[1:9] for r in repair_report(damage(frame)).collect()}
    assert got == report([r[:4] for r in rows])
    lines = repaired_turns(damage(frame)).where("conv_id = 7").orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == got[7][-1]
    assert repair_report(damage(frame.limit(0))).count() == 0


# ---------------------------------------------------------------- filter audit


def audited(docs, labels):
    first, out = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = WORDS.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows.append((lang or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    for part in {r[0] for r in rows}:
        own, taken = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                taken[f] += len(gone)
                fails = sum(f in r[1] for r in own)
                steps.append((part, "".join(order), k, len(left), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], taken[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_equals_every_order_by_itself(spark):
    draw = random.Random(2)
    prose = lambda n, pool: " ".join(draw.choice(pool) for _ in range(n))
    pool = [f"w{k}" for k in range(900)]
    texts = [prose(150, pool), prose(150, pool[:40]), "ABC DEF", "a # b", None, "", " \t\n", "é " * 120, prose(3000, pool) + " $", prose(120, [w.upper() for w in pool])]
    docs = [(draw.choice([k, k, k // 2, None]), draw.choice(texts), draw.choice(["en", "de", "", None]), "m", 1) for k in range(300)]
    labels = [(draw.choice([draw.randint(0, 300), None]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask string, k int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit_filters(frame, marks).collect())
    assert got == audited([d[:3] for d in docs], labels) and len(got) % 600 == 0
    assert audit_filters(frame.limit(0), marks).count() == 0


def test_lattice_counts_the_orders_through_every_edge():
    paths = lattice(4)
    for (state, bit), n in paths.items():
        through = 0
        for order in permutations((1, 2, 4, 8)):
            k = order.index(bit)
            through += sum(order[:k]) == state
        assert n == through


# ---------------------------------------------------------------- substring dedup


def stripped(texts, width):
    words = [WORDS.findall(t or "") for t in texts]
    times = {}
    for w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            times[key] = times.get(key, 0) + 1
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if times[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(seed, width):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abAB é", k=3)).replace(" ", "x")
    fresh = lambda n: [word() + str(draw.randint(0, 10**6)) for _ in range(n)]
    common = [fresh(n) for n in (width - 1, width, width + 1, 3 * width)]
    texts = [None, "", " \n", "one", " ".join(["la"] * (3 * width)), " ".join(["do", "re"] * width)]
    for _ in range(60):
        body = fresh(draw.randint(0, 2 * width))
        for _ in range(draw.randint(0, 3)):
            part = draw.choice(common)
            low = draw.randint(0, len(part) // 2)
            body += part[low : draw.randint(low, len(part))] + fresh(draw.randint(0, 4))
        texts.append("\t".join(body) if draw.random() < 0.2 else " ".join(body))
    texts += texts[-5:] + texts[-1:] * 6
    texts.append(" ".join(fresh(3000) + common[-1] + fresh(10) + common[-1]))
    # one short phrase in ever other contexts
    phrase = fresh(10)
    return texts + [" ".join(fresh(20) + phrase + common[1] + fresh(20)) for _ in range(30)]


@pytest.mark.parametrize("width, gram, kinds, shard", [(35, 8, 1000, 1000), (12, 4, 3, 5), (6, 6, 2, 1), (9, 1, 4, 50)])
def test_repeats_equal_counted_windows(spark, width, gram, kinds, shard):
    texts = passages(width, width)
    rows = [(None if k % 11 == 0 else k // 2, t, "a", 3, "b") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, uid string, at int, raw string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(frame, width, gram, kinds, shard).collect()]
    want = [(r[0], *s) for r, s in zip(rows, stripped(texts, width))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(n for _, _, n, _ in got)
    assert remove_repeats(frame.limit(0), width, gram, kinds, shard).count() == 0


def test_segments_hold_every_window_once():
    texts = [b"", b"a b", b" ".join(b"w%d" % (k % 50) for k in range(400)), b"x " * 60]
    doc, at, n, _, _ = segments(texts, 12, 4)
    windows = [(d, a + k) for d, a, m in zip(doc, at, n) for k in range(m)]
    assert sorted(windows) == [(d, k) for d, t in enumerate(texts) for k in range(max(0, len(t.split()) - 11))]
    assert n.max() <= 9


def test_automaton_counts_weighted_occurrences():
    draw = random.Random(6)
    shard = [([draw.randint(0, 2) for _ in range(draw.randint(1, 12))], draw.choice([1, 1, 2])) for _ in range(12)]
    times = {}
    for s, k in shard:
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                times[tuple(s[a:b])] = times.get(tuple(s[a:b]), 0) + k
    automaton = SuffixAutomaton(shard)
    for text in [s for s, _ in shard] + [[draw.randint(0, 3) for _ in range(30)]]:
        want = [max([b - a for a in range(b) if times.get(tuple(text[a:b]), 0) > 1], default=0) for b in range(1, len(text) + 1)]
        assert list(automaton.matches(text)) == want
    assert repeated_windows([(b"a b c", 1), (b"b c d", 1), (b"x y", 2)], 2) == [0b10, 0b01, 0b1]
