"""Selecting fields of delimited lines by ``cut``-like specifications."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = 1 << 30


def parse_spec(spec: str) -> list[tuple[int, int]]:
    """``"1,3-4,6-"`` as sorted, merged, 0-based half-open ranges.

    Raises ValueError for a missing number, field 0, an empty range, junk, or ranges that overlap.
    """
    ranges = []
    for part in spec.split(","):
        m = re.fullmatch(r"(\d*)(-?)(\d*)", part)
        if not m or part == "":
            raise ValueError(f"bad field range {part!r}")
        lo, dash, hi = m.groups()
        if not dash and not lo:
            raise ValueError(f"bad field range {part!r}")
        begin = int(lo) - 1 if lo else 0
        end = (int(hi) if hi else OPEN) if dash else begin + 1
        if begin < 0 or end <= begin:
            raise ValueError(f"empty field range {part!r}")
        ranges.append((begin, end))
    ranges.sort()
    out = [ranges[0]]
    for begin, end in ranges[1:]:
        if begin < out[-1][1]:
            raise ValueError(f"overlapping field ranges in {spec!r}")
        if begin == out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def split_fields(line: Column, delim: str) -> Column:
    return F.split(line, re.escape(delim), -1)


def range_key(line: Column, spec: str = "1-", delim: str = "\t") -> Column:
    """Key of a line: the text of each range with its inner delimiters, as an array.

    A range that begins after the line's end is left out (a last field that is empty counts as after the end), so all
    such lines share a key. A finite range that ends at the line's last delimiter keeps that delimiter. Null gives null.
    """
    ranges = parse_spec(spec)
    if ranges == [(0, OPEN)]:
        return F.when(line.isNotNull(), F.array(line))
    f = split_fields(line, delim)
    # a last empty field is no field
    n = F.when(F.element_at(f, -1) == "", F.size(f) - 1).otherwise(F.size(f))
    parts = []
    for begin, end in ranges:
        if end == OPEN:
            text = F.array_join(F.slice(f, begin + 1, F.greatest(F.size(f) - begin, F.lit(0))), delim)
        else:
            text = F.array_join(F.slice(f, begin + 1, end - begin), delim)
            text = F.when((F.size(f) > n) & (n == end), F.concat(text, F.lit(delim))).otherwise(text)
        parts.append(F.when(n > begin, text))
    return F.when(line.isNotNull(), F.filter(F.array(*parts), lambda x: x.isNotNull()))


def selected_fields(line: Column, spec: str = "1-", delim: str = "\t") -> Column:
    """The single fields of a line that the specification names; missing ones and a last empty one are left out."""
    f = split_fields(line, delim)
    n = F.when(F.element_at(f, -1) == "", F.size(f) - 1).otherwise(F.size(f))
    return F.flatten(F.array(*[F.slice(f, begin + 1, F.greatest(F.least(n, F.lit(end)) - begin, F.lit(0))) for begin, end in parse_spec(spec)]))
