"""Deduplication, set subtraction and keyed state over ordered lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.fields import range_key
from textloom.operators.keyed import first_per_key, lookup, numbered
from textloom.operators.pipe import pipe_lines

SPACES = "\t\n\u000b\u000c\r "
#: Fixed value: lines that begin so are markers of a crawl, no text.
MAGIC = "df6fa1abb58549287111ba8d776733e9"


def dedupe(df: DataFrame, line: str = "line", order: list[str] | None = None, spec: str = "1-", delim: str = "\t") -> DataFrame:
    """The first row for each distinct line, or for each distinct key of its fields. Null lines count as one line."""
    order = order or ["pos"]
    if spec == "1-":
        return first_per_key(df, [line], order).drop("_n").select(*df.columns)
    got = first_per_key(df.withColumn("_key", range_key(F.col(line), spec, delim)), ["_key"], order)
    return got.select(*df.columns)


def dedupe_parallel(df: DataFrame, left: str = "line0", right: str = "line1", order: list[str] | None = None) -> DataFrame:
    """Rows whose left side is new, and of these the rows whose right side is new: a rejected row's right side is not
    remembered."""
    order = order or ["pos"]
    once = first_per_key(df, [left], order).drop("_n").select(*df.columns)
    return first_per_key(once, [right], order).drop("_n").select(*df.columns)


def strip_spaces(c: str | Column) -> Column:
    """Without ASCII white space at both ends; other spaces stay."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACES))


def commoncrawl_dedupe(df: DataFrame, remove: DataFrame | None = None, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """Stripped lines without markers, lines of ``remove(line)``, repetitions and invalid UTF-8; the empty line once.

    Null lines are left out.
    """
    order = order or ["pos"]
    df = df.withColumn(line, strip_spaces(line)).where(F.col(line).isNotNull() & ~F.col(line).startswith(MAGIC))
    if remove is not None:
        gone = remove.select(strip_spaces("line").alias("_gone")).where("_gone is not null").distinct()
        df = df.join(gone, F.col(line) == F.col("_gone"), "left_anti")
    return first_per_key(df, [line], order).drop("_n").select(*df.columns).where(F.is_valid_utf8(F.col(line)))


def subtract_lines(df: DataFrame, remove: DataFrame, line: str = "line") -> DataFrame:
    """Rows whose line is not in ``remove(line)``; repetitions of the others stay. A null line is never removed."""
    gone = remove.select(F.col("line").alias("_gone")).where("_gone is not null").distinct()
    return df.join(gone, F.col(line) == F.col("_gone"), "left_anti")


def memoize(df: DataFrame, f: Callable[[Column], Column] | list[str], line: str = "line", order: list[str] | None = None, spec: str = "-", delim: str = "\t", out: str = "mapped") -> DataFrame:
    """Every row gets ``f`` of the first line that has its key; ``f`` runs once for each key. Null lines share a key.

    ``f`` is a function of columns or the words of a command that writes a line for each line it reads.
    """
    order = order or ["pos"]
    keyed = df.withColumn("_key", range_key(F.col(line), "1-" if spec == "-" else spec, delim))
    firsts = first_per_key(keyed, ["_key"], order, [line])
    firsts = pipe_lines(firsts, f, line, out) if isinstance(f, list) else firsts.withColumn(out, f(F.col(line)))
    return lookup(keyed, firsts, ["_key"], out).drop("_key")


def substitute(df: DataFrame, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """Tab-separated rows of six fields or more: field 5 becomes that of the first row with the same fields 3 and 4.

    Rows with fewer fields raise an error when they are read; null lines are left out.
    """
    order = order or ["pos"]
    f = F.split(line, "\t", -1)
    checked = df.where(F.col(line).isNotNull()).withColumn("_f", F.when(F.size(f) >= 6, f).otherwise(F.raise_error(F.lit("fewer than six fields"))))
    keyed = checked.withColumn("_a", F.get("_f", 2)).withColumn("_b", F.get("_f", 3)).withColumn("_v", F.get("_f", 4))
    firsts = first_per_key(keyed, ["_a", "_b"], order, ["_v"]).withColumnRenamed("_v", "_first")
    got = lookup(keyed, firsts, ["_a", "_b"], "_first")
    joined = F.array_join(F.transform("_f", lambda x, i: F.when(i == 4, F.col("_first")).otherwise(x)), "\t")
    return got.withColumn(line, joined).select(*df.columns)


def words(c: str) -> Column:
    """Words between NUL, tab, CR, LF and space; none for null."""
    return F.filter(F.split(c, "[\\x00\\t\\r\\n ]+"), lambda x: x != "")


def vocab(df: DataFrame, line: str = "line", order: list[str] | None = None) -> DataFrame:
    """Distinct words with dense ids in the order in which they are first seen, from 1 (0 is kept for unknown words)."""
    order = order or ["pos"]
    toks = df.select(*order, F.posexplode(words(line)).alias("_i", "word"))
    seen = toks.groupBy("word").agg(F.min(F.struct(*order, "_i")).alias("_at"))
    return numbered(seen, ["_at"], "id", 1).select("word", "id")
