"""Row filters for lines, on one stream or on two aligned ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.fields import selected_fields


def short_enough(c: Column, limit: int = 2000) -> Column:
    """At most ``limit`` bytes; null for null."""
    return F.octet_length(c) <= limit


def valid_utf8(c: Column) -> Column:
    return F.is_valid_utf8(c)


def clean_field(
    f: Column, min_chars: int = 30, character_run: int = 5, max_common: float = 0.2, min_punct: float = 0.01, punct_sample: int = 200,
    scripts: list[str] | None = None, min_scripts: float = 0.9,
) -> Column:
    """Whether one field passes all quality rules: valid UTF-8 without control characters (but tab and CR), no run of a
    character, enough characters, few characters of no script, enough punctuation in long fields, and, if scripts are
    given, most letters in them. Shares are compared in single precision."""
    single = lambda c: c.cast("float")
    chars = F.length(f)
    run = max(character_run, 2)
    common = F.length(F.regexp_replace(f, r"[^\p{IsCommon}\p{IsInherited}]", ""))
    spaces = F.regexp_count(f, F.lit(r"(?U)\s"))
    ok = (
        F.is_valid_utf8(f)
        & ~f.rlike(r"[\x00-\x08\x0A-\x0C\x0E-\x1F]")
        & ~f.rlike(rf"(?s)(?U)(\S)\1{{{run - 1},}}")
        & (chars >= min_chars)
        & ~(single(common - spaces) > F.lit(max_common).cast("float") * single(chars))
        & ~((chars > punct_sample) & (single(F.regexp_count(f, F.lit(r"\p{P}"))) < F.lit(min_punct).cast("float") * single(chars)))
    )
    if scripts:
        inside = F.length(F.regexp_replace(f, "[^" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]", ""))
        letters = chars - common
        ok = ok & ((letters == 0) | ~(single(inside) / single(F.nullif(letters, F.lit(0))) < F.lit(min_scripts).cast("float")))
    return ok


def simple_cleaning(c: Column, spec: str = "1-", delim: str = "\t", **rules) -> Column:
    """Whether all selected fields of a line pass; a null line does not."""
    return F.coalesce(F.forall(selected_fields(c, spec, delim), lambda f: F.coalesce(clean_field(f, **rules), F.lit(False))), F.lit(False))


def filter_parallel(df: DataFrame, keep: Callable[[Column], Column], left: str = "line0", right: str = "line1") -> DataFrame:
    """Rows both of whose sides pass; rows with a null side do not."""
    return df.where(F.coalesce(keep(F.col(left)), F.lit(False)) & F.coalesce(keep(F.col(right)), F.lit(False)))


def kept_ratio(df: DataFrame, kept: Column) -> DataFrame:
    """``(kept, total, ratio)`` of a filter, in one scan; ratio is null for no rows."""
    keep = F.count_if(F.coalesce(kept, F.lit(False)))
    return df.agg(keep.alias("kept"), F.count("*").alias("total")).select("kept", "total", (F.col("kept") / F.nullif(F.col("total"), F.lit(0))).alias("ratio"))
