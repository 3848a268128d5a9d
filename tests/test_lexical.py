"""Lexical regions and balanced blocks against plain scanners."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arborlens.functions.lexical import automaton, mask, with_code
from arborlens.operators.blocks import blocks, bodies, heads, place, segments

QUOTED = r"""'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\\?\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)"""
PLAIN = {  # (string, comment) as alternatives, the first that fits at a place
    "web": (QUOTED + r"|`(?:\\.|[^`\\])*(?:`|\\?\Z)", r"//[^\n]*|/\*.*?(?:\*/|\Z)"),
    "python": (r"'''(?:\\.|[^\\])*?(?:'''|\\?\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\\?\Z)|" + QUOTED, r"#[^\n]*"),
    "css": (r"""'(?:\\.|[^'\\])*(?:'|\\?\Z)|"(?:\\.|[^"\\])*(?:"|\\?\Z)|(?<![\w-])(?i:url\()[^)]*(?:\)|\Z)""", r"/\*.*?(?:\*/|\Z)"),
    "prisma": (r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\\?\Z)', r"//[^\n]*"),
}
ALPHABET = {"web": "'\"`/*\\\n a${}", "python": "'\"#\\\n a", "css": "'\"/*\\\n url()-;", "prisma": '"/\\\n a', "sql": "'-/*$\n ab_", "markdown": "`~\n a", "": "'a\n"}


def blank(text):
    return re.sub(r"[^\n]", " ", text)


def plain(text, dialect):
    """(code, bare), one character at a time or by one regular expression."""
    if dialect in PLAIN:
        string, comment = PLAIN[dialect]
        both = re.compile(f"(?P<s>{string})|(?P<c>{comment})", re.S)
        return both.sub(lambda m: blank(m[0]), text), both.sub(lambda m: m[0] if m["s"] is not None else blank(m[0]), text)
    if dialect == "markdown":
        out, fence = [], None
        for line in text.split("\n"):
            mark = re.match(r"[ \t\r\f\v]*(```|~~~)", line)
            if fence:
                out.append(blank(line))
                fence = None if mark and mark[1] == fence else fence
            elif mark:
                fence = mark[1]
                out.append(line[: mark.start(1)] + blank(line[mark.start(1) :]))
            else:
                out.append(line)
        return ("\n".join(out),) * 2
    if dialect == "sql":
        code, bare, i = "", "", 0
        while i < len(text):
            kind, end = None, i + 1
            dollar = re.compile(r"\$\w*\$", re.A).match(text, i)
            if text.startswith("--", i):
                kind, end = "c", (text + "\n").index("\n", i)
            elif text.startswith("/*", i):
                kind, depth, end = "c", 1, i + 2
                while end < len(text) and depth:
                    two = text[end : end + 2]
                    depth += (two == "/*") - (two == "*/")
                    end += 2 if two in ("/*", "*/") else 1
            elif text[i] == "'":
                kind, end = "s", text.find("'", i + 1) + 1 or len(text)
            elif dollar:
                close = text.find(dollar[0], dollar.end())
                kind, end = "s", close + len(dollar[0]) if close >= 0 else len(text)
            part = text[i:end]
            code += blank(part) if kind else part
            bare += blank(part) if kind == "c" else part
            i = end
        return code, bare
    return text, text


def samples(dialect, n, seed, size=40):
    draw = random.Random(seed)
    pool = list(ALPHABET[dialect]) + ["'''", '"""', "```", "~~~", "/*", "*/", "//", "--", "$a$", "$$", "url(", "é", "日"]
    return ["".join(draw.choice(pool) for _ in range(draw.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("dialect", list(ALPHABET))
def test_masks_equal_a_plain_scanner(dialect):
    texts = samples(dialect, 1500, 5) + samples(dialect, 20, 6, 900)
    got = [(c.decode(), b.decode()) for c, b in mask([t.encode() for t in texts], [dialect] * len(texts))]
    for text, pair in zip(texts, got):
        assert pair == plain(text, dialect), repr(text)
        assert len(pair[0]) == len(text) == len(pair[1])


def test_functions_of_runs_compose():
    machine = automaton("sql", (b"$a$",))
    texts = [t.encode() for t in samples("sql", 60, 7, 300)]
    for a, b in zip(texts, texts[1:]):
        one, two = machine.function(a), machine.function(b)
        assert [two[s] for s in one] == machine.function(a + b)


def test_long_texts_are_followed_in_pieces(spark):
    rows = [(k, d, t) for d in ALPHABET for k, t in enumerate(samples(d, 12, 8, 700))] + [(99, "web", None), (99, None, "'a'"), (98, "typescript", "// x\ny"), (97, "sql", "x" * 900 + "'y'")]
    frame = spark.createDataFrame(rows, "path int, language string, text string").withColumn("uid", F.lit("clash"))
    out = with_code(frame, piece=64)
    assert out.columns == ["path", "language", "text", "uid", "code", "bare"]
    for r in out.collect():
        dialect = {"typescript": "web", None: ""}.get(r.language, r.language)
        assert (r.code, r.bare) == ((None, None) if r.text is None else plain(r.text, dialect)), repr(r.text)
    assert out.count() == len(rows) and with_code(frame.limit(0)).count() == 0


def matches(text):
    out, stack = {}, []
    for k, c in enumerate(text):
        if c == "{":
            stack.append(k)
        elif c == "}" and stack:
            out[stack.pop()] = k
    return {**out, **dict.fromkeys(stack)}


def test_blocks_equal_a_stack(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("{}{}ax\n(") for _ in range(draw.randint(0, 60))) for _ in range(150)] + ["", "{", "}", "}}{{}", "a{b{c}d}e{"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "path int, code string")
    got = {}
    for r in blocks(rows).collect():
        got.setdefault(r.path, {})[r.open] = r.close
        inside = texts[r.path][: r.open]
        depth = 0
        for c in inside:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
        assert r.depth == depth
    assert all(got.get(k, {}) == matches(t) for k, t in enumerate(texts))


def test_bodies_and_segments(spark):
    text = "x = f({\n a: g(1, 2), // c, d\n b: ['p,q', {r: 1}],\n\n})\ny = f({ z: 1"
    rows = with_code(spark.createDataFrame([("p", "web", text)], "path string, language string, text string")).cache()
    found = heads(rows, r"\w+ = f\(", keep=("code",)).withColumn("open", place("code", "{", F.col("stop")))
    found = bodies(found.drop("code"), rows)
    assert [r.head for r in found.orderBy("start").collect()] == ["x = f(", "y = f("]
    parts = [(r.n, r.segment.strip()) for r in segments(found.where("start = 0"), ["path", "open"]).orderBy("n").collect()]
    assert [(n, re.sub(r"\s+", " ", s)) for n, s in parts] == [(1, "a: g(1, 2)"), (2, "b: ['p,q', {r: 1}]")]
    assert [r.segment.strip() for r in segments(found.where("start > 0"), ["path", "open"]).collect()] == ["z: 1"]
    lines = segments(found.where("start = 0"), ["path", "open"], "\n")
    assert lines.count() == 2


def test_the_end_of_a_string_ends_its_word_as_in_sql(spark, tmp_path):
    import duckdb

    from arborlens.plans import queries

    draw = random.Random(11)
    texts = ['a = "b"!! c', "'a''b'\"c\"d''e", '"""a"b"""c\'\'\'d', "'a#b'c#d'e'f", '"a\\"b"c\\', None, "", "x" + '"' + "ab " * 40_000 + '"y', "'''" + "\\'a\n" * 30_000 + "'''z"]
    texts += ["".join(draw.choice(ALPHABET["python"]) for _ in range(draw.randint(1, 40))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["lexical_regions"]).fetchall()
    got = queries.QUERIES["lexical_regions"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
