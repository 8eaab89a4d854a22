"""Folding lines at a width for an external step, and joining them again."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import settle

WIDTH, DELIMITERS = 80, ":, -./"


def fold_line(line: str, width: int = WIDTH, delimiters: str = DELIMITERS, skip: bool = False) -> tuple[list[str], list[str]]:
    """Pieces of at most ``width`` bytes, and the delimiters taken out after each (empty unless ``skip``).

    A piece may reach to the first place that is ``width`` bytes or more from its start. It is cut where the run of
    delimiters begins that holds the last occurrence of the most preferred delimiter in reach, or else at that place;
    the delimiters from there on belong to it too, when they are kept only while the piece stays within the width.
    """
    ends = list(itertools.accumulate((len(c.encode("utf-8", "surrogatepass")) for c in line), initial=0))
    runs = [m.span() for m in re.finditer(f"[{re.escape(delimiters)}]+", line)] if delimiters else []
    begins = [a for a, _ in runs]

    def run_at(i: int) -> tuple[int, int]:
        """The run of delimiters that holds place ``i``, or an empty one there."""
        k = bisect.bisect_right(begins, i) - 1
        return runs[k] if k >= 0 and i < runs[k][1] else (i, i)

    pieces, gaps = [], []
    start = 0
    while (reach := max(start + 1, bisect.bisect_left(ends, ends[start] + width))) <= len(line):
        last = (line.rfind(d, start, reach) for d in delimiters)
        cut = next((a for a, _ in map(run_at, filter(lambda i: i >= 0, last)) if a > start), reach)
        after = run_at(cut)[1]
        if not skip:
            after = max(cut, min(after, bisect.bisect_left(ends, ends[start] + width)))
        pieces.append(line[start : cut if skip else after])
        gaps.append(line[cut:after] if skip else "")
        start = after
    if start < len(line) or not line:
        pieces.append(line[start:])
        gaps.append("")
    return pieces, gaps


def fold(c: Column, width: int = WIDTH, delimiters: str = DELIMITERS, skip: bool = False) -> Column:
    """``struct<pieces, gaps>`` of a line; null for null, one empty piece for an empty line."""

    @F.pandas_udf("pieces array<string>, gaps array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        got = [fold_line(t, width, delimiters, skip) if t is not None else (None, None) for t in s]
        return pd.DataFrame({"pieces": [g[0] for g in got], "gaps": [g[1] for g in got]})

    return F.when(c.isNotNull(), run(c))


def fold_map(df: DataFrame, f: Callable[[DataFrame], DataFrame], key: str, line: str = "line", **options) -> DataFrame:
    """Lines whose pieces went through ``f``, a transform of ``(key, piece_no, line)`` that keeps the row count."""
    base = settle(df.select(key, fold(F.col(line), **options).alias("_f")), "folded")
    mapped = f(base.select(key, F.posexplode("_f.pieces").alias("piece_no", "line")))
    back = mapped.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece_no", "line"))).alias("_m"))
    got = base.join(back, key, "left")
    joined = F.array_join(F.zip_with(F.transform("_m", lambda x: x["line"]), F.col("_f.gaps"), lambda a, b: F.concat(a, b)), "")
    checked = F.when(F.size("_m") != F.size("_f.pieces"), F.raise_error(F.lit("the number of pieces changed"))).otherwise(joined)
    return got.select(key, checked.alias(line))
