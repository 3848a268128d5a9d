"""Ignore rules, aliases, web files, schema files and stored functions against plain evaluators and fixed texts."""

import random
import re

from pyspark.sql import functions as F

from arborlens.operators.cascade import import_targets
from arborlens.sources import files as src
from arborlens.sources.ignore import Rules
from arborlens.sources.ingest import data_models


def table(spark, rows):
    return spark.createDataFrame([(p, lang, None, t) for p, lang, t in rows], "path string, language string, config_type string, text string")


# ---------------------------------------------------------------- ignore rules


def fits(parts, path):
    """Whether pattern parts fit all of the path's segments, by trying every length of **."""
    if not parts:
        return not path
    if parts[0] == "**":
        return any(fits(parts[1:], path[k:]) for k in range(len(path) + 1))
    return bool(path) and segment(parts[0], path[0]) and fits(parts[1:], path[1:])


def segment(pattern, name):
    if not pattern:
        return not name
    if pattern[0] == "*":
        return any(segment(pattern[1:], name[k:]) for k in range(len(name) + 1))
    return bool(name) and (pattern[0] in ("?", name[0])) and segment(pattern[1:], name[1:])


def rule_fits(rule, path):
    """Whether one rule fits a path (folders end with /) or a folder above it."""
    folder_only, bare = rule.endswith("/"), rule.strip("/")
    parts = bare.split("/")
    if "/" not in rule.rstrip("/"):
        parts = ["**", *parts]
    names, is_folder = path.strip("/").split("/"), path.endswith("/")
    for k in range(1, len(names) + 1):
        if (k < len(names) or is_folder or not folder_only) and fits(parts, names[:k]):
            return True
    # what ends in ** fits what is below
    return False


def ignored(rules, path):
    names = path.split("/")
    for k in range(1, len(names) + 1):
        here = "/".join(names[:k]) + ("/" if k < len(names) else "")
        said = [not r.startswith("!") for r in rules if rule_fits(r.lstrip("!"), here)]
        if said and said[-1]:
            return True
    return False


def test_ignore_rules_equal_a_plain_evaluator(spark):
    draw = random.Random(11)
    names = ["a", "b", "ab", "x.py", "y.log", "c"]
    for turn in range(6):
        paths = sorted({"/".join(draw.choice(names) for _ in range(draw.randint(1, 4))) for _ in range(80)})
        pool = ["*.log", "a/", "/a", "b", "!b", "!x.py", "a/b", "**/b", "a/**/c", "!a/b/c", "x.*", "?b", "/ab/", "!ab/", "c/", "*", "!*/", "!y.log", "/*.py"]
        lines = [draw.choice(pool) for _ in range(draw.randint(1, 7))]
        rules = Rules(["# comment", "", *lines, "  "])
        frame = spark.createDataFrame([(p,) for p in paths], "path string")
        got = {r.path: r.gone for r in frame.select("path", rules.ignored(F.col("path")).alias("gone")).collect()}
        assert got == {p: ignored(lines, p) for p in paths}, lines


def test_ignore_rules_of_fixed_texts(spark):
    paths = ["keep/a.txt", "keep/b.md", "build/x", "src/build/y", "#odd", "!odd", "doc/[x].md", "doc/x.md", "t e.md", "deep/a/b/c.tmp", "foo/bar"]
    rules = Rules(["keep/*", "!keep/b.md", "/build", "\\#odd", "\\!odd", "doc/\\[x].md", "*.tm[op]  ", "foo/**"])
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    gone = {r.path for r in frame.where(rules.ignored(F.col("path"))).collect()}
    assert gone == {"keep/a.txt", "build/x", "#odd", "!odd", "doc/[x].md", "deep/a/b/c.tmp", "foo/bar"}


def test_scan_reads_the_ignore_file(spark, tmp_path):
    for name, text in {".gitignore": "# x\n*.py\n!keep.py\ngen/\n!gen/a.py\n", "a.py": "x", "keep.py": "x", "gen/a.py": "x", "lib/keep.py": "x", "lib/b.ts": "x", "out/c.ts": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r.path for r in src.scan(spark, str(tmp_path), ["/out", "!a.py"]).collect()) == ["a.py", "keep.py", "lib/b.ts", "lib/keep.py"]


# ---------------------------------------------------------------- aliases and imports of web files


def test_aliases_and_web_imports(spark):
    config = """{
  // "baseUrl": "no",
  "compilerOptions": { /* x */ "baseUrl": "./src", "paths": {
      "@lib/*": ["lib/*", "vendor/*",], // "a,]"
      "env": ["env,]//.ts"],
    },
  },
}"""
    code = """import React, { useState as state, type X } from 'react'
// import no from './no'
import * as all from "./local.js"; const s = "import q from 'q'";
export { a as b } from '@lib/tool'
export * from "env"
const fs = require('fs'), lazy = () => import('~/pages/home')
import './side.css'
obj.require('nope')
"""
    rows = [("web/tsconfig.json", "jsonc", config), ("jsconfig.json", "jsonc", '{"compilerOptions": {"paths": {"@lib/*": ["other/*"]}}}'), ("tsconfig.bad.json", "jsonc", "{ not json"), ("web/src/a.ts", "typescript", code)]
    rows += [(p, "typescript", "") for p in ("web/src/local.ts", "web/src/lib/tool.ts", "other/tool.ts", "web/src/env,]//.ts", "pages/home/index.tsx", "far/b.ts")]
    files = table(spark, rows)
    aliases = sorted(tuple(r) for r in src.path_aliases(files).collect())
    assert [a[:3] for a in aliases] == [("", "@lib/*", "other/*"), ("web", "@lib/*", "web/src/lib/*"), ("web", "@lib/*", "web/src/vendor/*"), ("web", "env", "web/src/env,]/.ts")]
    found = {(r.line, r.module_path): r.names for r in src.web_imports(files).collect()}
    assert found == {
        (1, "react"): ["React React", "useState state", "X X"], (3, "./local.js"): ["* all"], (4, "@lib/tool"): ["a b"], (5, "env"): ["* *"], (6, "fs"): ["* fs"], (6, "~/pages/home"): [], (7, "./side.css"): [],
    }
    asked = src.web_imports(files).select(F.col("path").alias("file_path"), "line", "module_path", F.lit("typescript").alias("language"))
    far = spark.createDataFrame([("far/b.ts", 1, "@lib/tool", "typescript"), ("far/b.ts", 2, "react", "typescript")], asked.schema)
    got = {(r.file_path, r.line): r.target for r in import_targets(asked.unionByName(far), files.select("path"), src.path_aliases(files)).collect()}
    # the alias of the nearest folder above the importing file comes first
    assert got == {("web/src/a.ts", 3): "web/src/local.ts", ("web/src/a.ts", 4): "web/src/lib/tool.ts", ("web/src/a.ts", 6): "pages/home/index.tsx", ("far/b.ts", 1): "other/tool.ts"}


def test_routes_and_guards_of_web_files(spark):
    code = """app.use('/api/admin/*', requireAuth({ a: [1, 2] }))
app.use('/open', logger)
router.get("/users/:id", limit, guards.check(1), (req, res) => { send(",") })
router.post('/users', validate, users.create)
// app.get('/no', x)
const t = "app.get('/never', y)"
client.get('relative', z)
"""
    routes, guards = src.web_routes(table(spark, [("r.ts", "typescript", code)]), ["auth"])
    got = sorted((r.line, r.method, r.route, r.handler, r.middleware) for r in routes.collect())
    assert got == [(3, "GET", "/users/:id", None, ["limit", "guards.check"]), (4, "POST", "/users", "users.create", ["validate"])]
    assert [tuple(r) for r in guards.collect()] == [("/api/admin/*", "r.ts")]


# ---------------------------------------------------------------- schema files, tables, stored functions


def test_prisma_blocks(spark):
    text = """// model Old { id Int @id }
model User {
  id    Int     @id @default(autoincrement())
  email String? @unique @db.VarChar(255) // a } brace
  name  String  @default("{")
  posts Post[]
  role  Role    @default(USER)
  skip  String  @ignore
  @@map("users")
}

enum Role { USER
  ADMIN // x
}

model Post {
  id       Int
  part     Int
  authorId Int @unique
  author   User @relation(
    fields: [authorId],
    references: [id]
  )
  @@id([id, part])
  @@index([part])
}

model Gone {
  id Int @id
  @@ignore
}
"""
    rows = {(r.model, r.field): r for r in src.prisma_models(table(spark, [("s.prisma", "prisma", text)])).collect()}
    assert {m for m, _ in rows} == {"User", "Role", "Post"} and ("User", "skip") not in rows
    email, name, post = rows["User", "email"], rows["User", "name"], rows["Post", "author"]
    assert (email.is_optional, email.is_unique, email.db_type, email.table_name, email.line) == (True, True, "varchar(255)", "users", 2)
    assert name.has_default and name.default_value == '"{"' and rows["User", "id"].default_value == "autoincrement()"
    assert (post.relation, post.references) == ("authorId", "id") and rows["Post", "id"].is_primary and rows["Post", "part"].is_indexed and not rows["Post", "authorId"].is_primary
    assert sorted(f for m, f in rows if m == "Role") == ["ADMIN", "USER"] and rows["Role", "USER"].is_enum
    models, fields, related = data_models(table(spark, [("s.prisma", "prisma", text)]))
    assert {r.name: r.primary_key for r in models.collect()} == {"User": "id", "Post": "id,part", "Role": None}
    assert {(r.model, r.target, r.kind) for r in related.collect()} == {("User", "Post", "one_to_many"), ("Post", "User", "one_to_one")}
    assert {r.field for r in fields.where("model = 'User'").collect()} == {"id", "email", "name", "role"} and fields.where("is_foreign_key").first().field == "authorId"


def test_drizzle_tables(spark):
    text = """import { pgTable } from 'drizzle-orm/pg-core'
export const users = pgTable('users', {
  id: uuid('id').primaryKey().defaultRandom(),
  age: integer("years").notNull().default(3), // a, b
  meta: jsonb('meta').$type<{ a: string, b: number }>()
    .default({ x: [1, 2] }),
})
/* const old = pgTable('old', { id: serial('id') }) */
const posts = pgTable("posts", {
  authorId: uuid('author_id')
    .references(() => users.id, { onDelete: 'cascade' })
    .notNull(),
  at: timestamp('at').defaultNow(),
  odd: custom('odd').unique(),
}, (table) => ({ byAuthor: index('i').on(table.authorId) }))
"""
    rows = {(r.model, r.field): r for r in src.drizzle_tables(table(spark, [("s.ts", "typescript", text)])).collect()}
    assert set(rows) == {("users", "id"), ("users", "age"), ("users", "meta"), ("posts", "authorId"), ("posts", "at"), ("posts", "odd")}
    key, age, author, odd = rows["users", "id"], rows["users", "age"], rows["posts", "authorId"], rows["posts", "odd"]
    assert (key.is_primary, key.default_value, key.field_type) == (True, "random()", "string") and (age.db_name, age.not_null, age.default_value) == ("years", True, "3")
    assert rows["users", "meta"].has_default and (author.references, author.references_field, author.is_indexed, author.not_null) == ("users", "id", True, True)
    assert (odd.field_type, odd.db_type, odd.is_unique, rows["posts", "at"].default_value) == ("unknown", "custom", True, "now()")


def test_stored_functions(spark):
    text = """-- create function no() returns void as $$ delete from a $$;
create or replace function public.spend(p_user uuid, amount numeric(10, 2)) returns void as $fn$
declare
  rec record; total int := 0;
begin
  with recent as (select * from payments p join auth.users u on true), more as (select 1)
  insert into public.ledger (a) select x from recent, more;
  update only accounts set n = 1 from limits l where l.id = accounts.id;
  for rec in select * from jobs loop delete from queue q; end loop;
  raise exception $m$cannot delete from orders$m$; -- from comments_table
  execute 'delete from secret'; /* update hidden */
  select n into total from amount;
  insert into t values (1) on conflict do update set n = 2;
  select extract(epoch from now());
end $fn$ language plpgsql;
create function internal.skip() returns void as $$ delete from z $$ language sql;
CREATE FUNCTION "Count"() RETURNS int AS $$ SELECT count(*) FROM "ledger" JOIN accounts ON true $$ LANGUAGE sql;
"""
    got = {(r.name, r.table): (r.access, r.line) for r in src.sql_functions(table(spark, [("m.sql", "sql", text)])).collect()}
    assert got == {
        ("spend", "payments"): ("read", 2), ("spend", "ledger"): ("write", 2), ("spend", "accounts"): ("write", 2), ("spend", "limits"): ("read", 2), ("spend", "jobs"): ("read", 2), ("spend", "queue"): ("write", 2),
        ("spend", "t"): ("write", 2), ("Count", "ledger"): ("read", 17), ("Count", "accounts"): ("read", 17),
    }


def test_markdown_and_css_ignore_masked_text(spark):
    doc = "Intro `first_name` [x](./src/a.ts#L2) [y](https://z.ts)\n\n# One\n\n```py\n# no `inner_name`\n~~~\n```\nText `two_parts()`\n~~~\n`lost_name`\n~~~\n## Two ##\n"
    css = ":root { /* --no: 1px; */ --a: \"x;}\"; --b : var(--a,\n  4px) ; content: \"--c: 2px;\"; --d: url(a;b.png) }\n.x--y:hover { --e: }\n"
    files = table(spark, [("d.md", "markdown", doc), ("s.css", "css", css)])
    assert [(r.heading, r.level, r.start_line, r.end_line) for r in src.markdown_sections(files).orderBy("start_line").collect()] == [("One", 1, 3, 12), ("Two", 2, 13, 14)]
    refs = sorted((r.start_line, r.reference, r.kind) for r in src.section_references(files).collect())
    assert refs == [(1, "first_name", "entity"), (1, "src/a.ts", "file"), (3, "two_parts", "entity")]
    tokens = {r.name: (r.value, r.references) for r in src.css_tokens(files).collect()}
    assert tokens == {"a": ('"x;}"', []), "b": ("var(--a, 4px)", ["--a"]), "d": ("url(a;b.png)", [])}
    assert re.match(r"\w", "a")
