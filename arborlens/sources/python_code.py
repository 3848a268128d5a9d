"""Python files as rows: one small visitor per file, then Spark explodes and resolves."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, kind string, name string, class_name string, line int, end_line int, calls array<string>, bases array<string>, names array<string>, module string, signature string, docstring string, complexity int, decorators array<string>, returns string, params array<string>, annotations array<string>"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp)


def _dotted(node: ast.AST) -> str | None:
    try:
        text = ast.unparse(node)
    except ValueError:
        return None
    return text if re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", text) else None


def _function(path: str, f: ast.FunctionDef, owner: str | None) -> tuple:
    calls = [c for n in ast.walk(f) if isinstance(n, ast.Call) and (c := _dotted(n.func))]
    complexity = 1 + sum(isinstance(n, _BRANCHES) for n in ast.walk(f)) + sum(len(n.values) - 1 for n in ast.walk(f) if isinstance(n, ast.BoolOp))
    signature = f"def {f.name}({ast.unparse(f.args)})"
    params = [a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]]
    typed = [f"{a.arg} {ast.unparse(a.annotation)}" for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs] if a.annotation]
    return (path, "function", f.name, owner, f.lineno, f.end_lineno, list(dict.fromkeys(calls)), None, None, None, signature, ast.get_docstring(f), complexity, [ast.unparse(d) for d in f.decorator_list], ast.unparse(f.returns) if f.returns else None, params, typed)


def rows_of(path: str, text: str) -> list[tuple]:
    """Functions, methods, classes, their annotated fields and top-level imports; of a file that does not parse, top-level names only."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        found = re.finditer(r"^(?:async\s+)?(def|class)\s+(\w+)", text, re.M)
        return [(path, "function" if m[1] == "def" else "class", m[2], None, text[: m.start()].count("\n") + 1, None, [], [], None, None, None, None, 1, [], None, [], []) for m in found]
    out: list[tuple] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_function(path, node, None))
        elif isinstance(node, ast.ClassDef):
            bases = [b for x in node.bases if (b := _dotted(x))]
            out.append((path, "class", node.name, None, node.lineno, node.end_lineno, [], bases, None, None, None, ast.get_docstring(node), 1, [ast.unparse(d) for d in node.decorator_list], None, [], []))
            out += [(path, "field", x.target.id, node.name, x.lineno, x.end_lineno, None, None, None, None, None, None, 0, None, ast.unparse(x.annotation), None, None) for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
            out += [_function(path, m, node.name) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
        elif isinstance(node, ast.ImportFrom):
            names = [f"{a.name} {a.asname or a.name}" for a in node.names]
            out.append((path, "import", None, None, node.lineno, node.end_lineno, None, None, names, "." * node.level + (node.module or ""), None, None, 0, None, None, None, None))
        elif isinstance(node, ast.Import):
            out += [(path, "import", None, None, node.lineno, node.end_lineno, None, None, [f"* {a.asname or a.name}"], a.name, None, None, 0, None, None, None, None) for a in node.names]
    return out


def python_rows(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, text in zip(frame["path"], frame["text"], strict=True) for r in rows_of(path, text)]
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in ROWS.split(", ")])

    return files.where(F.col("language") == "python").select("path", "text").mapInPandas(run, ROWS)
