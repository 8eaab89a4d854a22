"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idf(df: DataFrame, line: str = "line") -> DataFrame:
    """``(token, idf)``: ln N - ln df, where each line is a document and a token counts once in it. Blank and null
    lines count in N."""
    toks = F.array_distinct(F.filter(F.split(line, "[\\t-\\r ]+"), lambda x: x != ""))
    n = df.agg(F.count("*").alias("n"))
    counts = df.select(F.explode(toks).alias("token")).groupBy("token").agg(F.count("*").alias("k"))
    return counts.join(F.broadcast(n)).select("token", (F.log("n") - F.log("k")).alias("idf"))


def case_counts(links: DataFrame) -> DataFrame:
    """``(source, lower_target, form, cnt)`` from aligned words ``(source, target)``."""
    return links.groupBy("source", F.lower("target").alias("lower_target"), F.col("target").alias("form")).agg(F.count("*").alias("cnt"))


def best_forms(counts: DataFrame) -> DataFrame:
    """The most frequent form of each source word and lower-case target; ties go to the smaller form."""
    best = F.min(F.struct((-F.col("cnt")).alias("n"), "form")).alias("b")
    return counts.groupBy("source", "lower_target").agg(best).select("source", "lower_target", F.col("b.form").alias("form"))
