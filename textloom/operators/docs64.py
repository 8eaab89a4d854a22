"""Documents as base64 lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.fields import parse_spec
from textloom.operators.keyed import running_sum
from textloom.session import settle


def encode(c: Column) -> Column:
    """Base64 without line breaks, whatever the session's setting."""
    return F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", "")


def decode(c: Column, strict: bool = True) -> Column:
    """Binary of base64 up to the first '='; missing padding is fine. Other characters raise an error, or give null."""
    body = F.regexp_extract(c, r"^[^=]*", 0)
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    good = F.when(body.rlike(r"^[A-Za-z0-9+/]*$") & (F.length(body) % 4 != 1), F.unbase64(padded))
    return F.when(c.isNull(), None).otherwise(F.coalesce(good, F.raise_error(F.concat(F.lit("not base64: "), c))) if strict else good)


def text(c: Column) -> Column:
    return decode(c).cast("string")


def number_lines(df: DataFrame, b64: str = "b64", doc: str = "doc_no") -> DataFrame:
    """``(doc_no, line_no, line)``: every non-empty line of every document, its tabs as spaces."""
    lines = F.filter(F.split(F.translate(text(F.col(b64)), "\t", " "), "\n"), lambda x: x != "")
    return df.select(doc, F.posexplode(lines).alias("line_no", "line"))


def drop_invalid(c: Column) -> Column:
    """The line if its document is valid UTF-8, else an empty line; null stays null."""
    return F.when(c.isNull() | F.is_valid_utf8(decode(c).cast("string")), c).otherwise("")


def map_lines(df: DataFrame, f: Callable[[DataFrame], DataFrame], b64: str = "b64", doc: str = "doc_no") -> DataFrame:
    """Documents whose lines were mapped by ``f``, a transform of ``(doc, line_no, line)`` that keeps the row count.

    A missing final newline stays missing; an empty document stays empty. A changed number of lines raises an error.
    """
    base = df.select(doc, b64, text(F.col(b64)).alias("_t"))
    ends = F.col("_t").endswith("\n")
    body = F.when(ends, F.expr("left(_t, length(_t) - 1)")).otherwise(F.col("_t"))
    base = base.withColumn("_ends", ends).withColumn("_lines", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1)))
    base = settle(base.drop("_t"), "b64-docs")
    mapped = f(base.select(doc, F.posexplode("_lines").alias("line_no", "line")))
    back = mapped.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_m"))
    got = base.join(back, doc, "left")
    same = F.coalesce(F.size("_m"), F.lit(0)) == F.size("_lines")
    joined = F.concat(F.array_join(F.transform("_m", lambda x: x["line"]), "\n"), F.when(F.col("_ends"), "\n").otherwise(""))
    out = F.when(~same, F.raise_error(F.lit("the number of lines changed"))).when(F.size("_lines") == 0, F.lit("")).otherwise(encode(joined))
    return got.select(doc, F.when(F.col(b64).isNotNull(), out).alias(b64))


def counts(docs: DataFrame, b64: str = "b64", stream: str = "stream", delimiter: str = "\n\n") -> DataFrame:
    """``(stream, documents, with_delimiter)``: the documents of each stream, and those that hold the delimiter that is to
    stand between them, which could not be told apart again."""
    held = F.count_if(F.coalesce(text(F.col(b64)).contains(delimiter), F.lit(False)))
    return docs.groupBy(stream).agg(F.count("*").alias("documents"), held.alias("with_delimiter"))


def join_documents(docs: DataFrame, b64: str = "b64", nul: bool = False) -> DataFrame:
    """``docs`` with ``document``: the decoded text and the delimiter after it, a line feed or NUL."""
    return docs.withColumn("document", F.concat(text(F.col(b64)), F.lit("\0" if nul else "\n")))


def split_documents(df: DataFrame, content: str = "content", stream: str = "stream") -> DataFrame:
    """``(stream, doc_no, b64)``: documents between NUL characters of each stream's content; an empty end makes none."""
    parts = F.split(content, "\0", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(stream, F.posexplode(parts).alias("doc_no", "_t")).select(stream, F.col("doc_no").cast("long"), encode(F.col("_t")).alias("b64"))


def docenc(df: DataFrame, stream: str = "stream", pos: str = "pos", line: str = "line") -> DataFrame:
    """``(stream, doc_no, b64)``: documents between blank lines of each stream; blank lines in a row make empty ones,
    a blank or missing end makes none. A long stream is split over tasks; only a document has to fit into one."""
    blank = (F.coalesce(F.col(line), F.lit("")) == "").cast("int")
    numbered = running_sum(df.withColumn("_b", blank), stream, pos, F.col("_b"), "_n").withColumn("doc_no", F.col("_n") - F.col("_b"))
    got = numbered.groupBy(stream, "doc_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("_b") == 0, F.struct(pos, line)))).alias("_l")
    )
    return got.select(stream, "doc_no", encode(F.concat(F.array_join(F.transform("_l", lambda x: x[line]), "\n"), F.when(F.size("_l") > 0, "\n").otherwise(""))).alias("b64"))


def docdec(df: DataFrame, b64: str = "b64", doc: str = "doc_no", number: bool = False, only: list[int] | str | None = None) -> DataFrame:
    """``(doc_no, line_no, line)`` of decoded documents; ``number`` puts the 1-based document number and a tab before
    each line; ``only`` keeps these 1-based documents, a list or ranges as ``"1,4-6,9-"``."""
    if isinstance(only, str):
        inside = F.lit(False)
        for begin, end in parse_spec(only):
            inside = inside | F.col(doc).between(begin, end - 1)
        df = df.where(inside)
    elif only is not None:
        df = df.where(F.col(doc).isin([i - 1 for i in set(only)]))
    lines = df.select(doc, F.posexplode(F.split(text(F.col(b64)), "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", F.concat((F.col(doc) + 1).cast("string"), F.lit("\t"), F.col("line"))) if number else lines
