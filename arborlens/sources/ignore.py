"""Ignore rules of a repository: ordered patterns of which the last that fits decides, `!` included.

A path is ignored if a folder above it is, or if it is itself; rules below an ignored folder change nothing there, as it is never
entered. Rules become one Column expression over a path and the folders above it, so no path is joined with every rule.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F


def _glob(pattern: str) -> str:
    """Regular expression of one path segment's wildcards."""
    if pattern == "*":
        return "[^/]+"
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", k + 1 + (pattern[k : k + 1] in ("!", "^")))) > 0:
            inner = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[^/" + inner[1:] + "]" if inner[0] in "!^" else "[" + inner + "]"
            k = end + 1
        elif c == "\\" and k < len(pattern):
            out += re.escape(pattern[k])
            k += 1
        else:
            out += re.escape(c)
    return out


def ignore_regex(rule: str) -> str | None:
    """One pattern (without !) as a regular expression over a relative path, folders ending with /; null if it means nothing."""
    rule = re.sub(r"(?<!\\)[ \t]+$", "", rule.rstrip("\r\n"))
    folder = rule.endswith("/")
    parts = [p for p in rule.strip("/").split("/")]
    if not rule.strip("/"):
        return None
    anchored = "/" in rule.rstrip("/")
    if anchored and parts[0] == "**" and len(parts) > 1:
        anchored, parts = False, parts[1:]
    out = "^" if anchored else "^(?:.+/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            # at the end everything below, between two names any folders or none
            out += ".*" if last else "(?:.+/)?"
        else:
            out += _glob(part) + ("" if last else "/")
    if parts[-1] == "**":
        return out + "$"
    return out + ("/.*$" if folder else "(?:/.*)?$")


class Rules:
    """Lines of an ignore file, in order."""

    def __init__(self, lines: list[str]) -> None:
        self.rules: list[tuple[str, bool]] = []
        for line in lines:
            text = line.strip() if not line.rstrip("\r\n").endswith("\\ ") else line.lstrip()
            if not text or text.startswith("#"):
                continue
            keeps = text.startswith("!")
            pattern = ignore_regex(re.sub(r"^\\([#!])", r"\1", text[1:] if keeps else text))
            if pattern:
                self.rules.append((pattern, not keeps))
        self._compiled = [(re.compile(p), drops) for p, drops in self.rules]

    def drops(self, path: str) -> bool:
        """What the last rule that fits the path itself says."""
        return next((drops for pattern, drops in reversed(self._compiled) if pattern.search(path)), False)

    def ignored(self, path: Column) -> Column:
        """Whether a file's path is ignored, by itself or by a folder above it."""
        if not self.rules:
            return F.lit(False)
        parts = F.split(path, "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n < F.size(parts), F.lit("/")).otherwise("")))

        def dropped(p: Column) -> Column:
            last = F.greatest(F.lit(0), F.lit(0), *(F.when(p.rlike(pattern), F.lit(k)).otherwise(F.lit(0)) for k, (pattern, drops) in enumerate(self.rules, 1) if drops))
            kept = F.greatest(F.lit(0), F.lit(0), *(F.when(p.rlike(pattern), F.lit(k)).otherwise(F.lit(0)) for k, (pattern, drops) in enumerate(self.rules, 1) if not drops))
            return last > kept

        return F.exists(folders, dropped)


def read_rules(root: str, more: list[str] | None = None) -> Rules:
    """The rules of the root's .gitignore, if there is one, and then those of `more`."""
    store, base = fs.FileSystem.from_uri(root)
    info = store.get_file_info(f"{base.rstrip('/')}/.gitignore")
    lines: list[str] = []
    if info.type == fs.FileType.File:
        with store.open_input_stream(info.path) as stream:
            lines = stream.readall().decode("utf-8", "replace").lstrip("\ufeff").splitlines()
    return Rules([*lines, *(more or [])])
