"""Balanced blocks of text: nesting depth by prefix sums, matching brackets by windows over one depth.

Texts come with `code` and `bare` (functions/lexical.py), so brackets in comments and strings do not count, and places
found in one hold in the other. Places are characters from 0. Rows are one per bracket, header or separator, never one
per character; all of it is Spark's windows and joins by (text, place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "([{", ")]}"


def _pieces(rows: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, n, at, piece: the text cut in front of every match of the pattern, with the place of each piece."""
    cut = rows.select(*keys, F.posexplode(F.split(F.col(text), f"(?={pattern})")).alias("n", "piece"))
    before = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))


def blocks(rows: DataFrame, key: str = "path", kinds: str = "{}", code: str = "code") -> DataFrame:
    """(key, open, close, depth) of every opening bracket of the kinds: the place of its match (null where it is never
    closed) and how many of them are open around it. Closing brackets without an open one change nothing."""
    left, right = kinds[::2], kinds[1::2]
    one = "[" + "".join("\\" + c for c in kinds) + "]"
    pieces = _pieces(rows.select(key, code), [key], code, one).withColumn("c", F.substring("piece", 1, 1)).where(F.col("c").rlike(one))
    opens = F.col("c").isin(*left)
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = pieces.withColumn("run", F.sum(F.when(opens, 1).otherwise(-1)).over(so_far)).withColumn("low", F.min("run").over(so_far))
    # both ends of a block see the same number of open brackets outside of it
    level = run.withColumn("level", F.when(opens, F.col("run")).otherwise(F.col("run") + 1))
    same = Window.partitionBy(key, "level").orderBy("at")
    matched = level.withColumn("close", F.lead("at").over(same))
    # closing brackets in excess lower the run for good; depth counts from there
    return matched.where(opens).select(key, F.col("at").alias("open"), "close", (F.col("run") - 1 - F.least(F.col("low"), F.lit(0))).alias("depth"))


def place(text: str, what: str, start: Column) -> Column:
    """Place of the next `what` at or behind the start, null without one."""
    found = F.position(F.lit(what), F.col(text), (start + 1).cast("int"))
    return F.when(found > 0, found - 1)


def between(text: str, start: Column, end: Column) -> Column:
    """The text from start to before end."""
    return F.substr(F.col(text), (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))


def line_of(text: str, at: Column) -> Column:
    return (F.regexp_count(between(text, F.lit(0), at), F.lit("\n")) + 1).cast("int")


def heads(rows: DataFrame, pattern: str, text: str = "code", keep: tuple[str, ...] = (), key: str = "path") -> DataFrame:
    """(key, start, stop, head) of every match of the pattern that begins in code; `pattern` must not match again within its own match."""
    pieces = _pieces(rows.select(key, text), [key], text, pattern).withColumn("head", F.regexp_extract("piece", f"^(?:{pattern})", 0)).where("head <> ''")
    found = pieces.select(key, F.col("at").alias("start"), (F.col("at") + F.length("head")).alias("stop"), "head")
    found = found.join(rows.select(key, "code", *keep), key)
    return found.where(F.trim(between("code", F.col("start"), F.col("start") + 1)) != "").drop(*(() if "code" in keep else ("code",)))


def bodies(found: DataFrame, rows: DataFrame, at: str = "open", kinds: str = "{}", key: str = "path") -> DataFrame:
    """found with `close`, `body_code` and `body_bare` of the block that opens at its column `at`; a block that is never closed reaches to the end
    of the text."""
    known = blocks(rows, key, kinds).select(key, F.col("open").alias(at), "close")
    whole = found.join(known, [key, at]).join(rows.select(key, "code", "bare"), key)
    end = F.coalesce(F.col("close"), F.length("code"))
    inside = lambda text: between(text, F.col(at) + 1, end)
    return whole.select(*found.columns, end.alias("close"), inside("code").alias("body_code"), inside("bare").alias("body_bare"))


def segments(rows: DataFrame, keys: list[str], separator: str = ",") -> DataFrame:
    """(keys, n, at, segment) of body_bare, cut at the separators that stand in no bracket of body_code; blank segments are left
    out."""
    mark = "\\n" if separator == "\n" else "\\" + separator
    pieces = _pieces(rows.select(*keys, "body_code"), keys, "body_code", f"[\\(\\)\\[\\]{{}}{mark}]").withColumn("c", F.substring("piece", 1, 1))
    step = F.when(F.col("c").isin(*OPEN), 1).when(F.col("c").isin(*CLOSE), -1).otherwise(0)
    so_far = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    deep = pieces.withColumn("depth", F.sum(step).over(so_far))
    starts = deep.where(((F.col("c") == separator) & (F.col("depth") == 0)) | (F.col("n") == 0)).withColumn("cut", (F.col("c") == separator) & (F.col("depth") == 0))
    after = Window.partitionBy(*keys).orderBy("n")
    starts = starts.withColumn("until", F.lead("at").over(after)).withColumn("from", F.when(F.col("cut"), F.col("at") + 1).otherwise(F.lit(0)))
    # a text that begins with a separator has one blank segment more, which is left out anyway
    bare = rows.select(*keys, "body_bare")
    out = starts.join(bare, keys).withColumn("until", F.coalesce("until", F.length("body_bare"))).withColumn("segment", between("body_bare", F.col("from"), F.col("until")))
    kept = out.where(F.regexp_replace("segment", r"\s", "") != "")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("from"))
    return kept.select(*keys, number.alias("n"), F.col("from").alias("at"), "segment")
