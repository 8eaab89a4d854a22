"""Bounded training samples that cover every script of a table, whatever its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scripts that are strata of their own; writing systems that share one language stand together.
SCRIPTS = {
    "latin": r"\p{IsLatin}",
    "cyrillic": r"\p{IsCyrillic}",
    "greek": r"\p{IsGreek}",
    "arabic": r"\p{IsArabic}",
    "hebrew": r"\p{IsHebrew}",
    "armenian": r"\p{IsArmenian}",
    "georgian": r"\p{IsGeorgian}",
    "ethiopic": r"\p{IsEthiopic}",
    "devanagari": r"\p{IsDevanagari}",
    "bengali": r"\p{IsBengali}",
    "gujarati": r"\p{IsGujarati}",
    "gurmukhi": r"\p{IsGurmukhi}",
    "kannada": r"\p{IsKannada}",
    "malayalam": r"\p{IsMalayalam}",
    "tamil": r"\p{IsTamil}",
    "telugu": r"\p{IsTelugu}",
    "thai": r"\p{IsThai}",
    "hangul": r"\p{IsHangul}",
    "cjk": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}",
}
#: The 62 bits of a hash that a kept share is compared with; a share of one row in 10^18 is not yet zero.
_SPAN = 1 << 62


def stratum(col: str, prefer: str | None = None) -> Column:
    """Name of the script of the first letter (of the first letter matched by ``prefer``, if there is one), else 'other'."""
    letter = F.regexp_extract(col, r"\p{L}", 0)
    if prefer:
        letter = F.coalesce(F.nullif(F.regexp_extract(col, prefer, 0), F.lit("")), letter)
    out = F.lit("other")
    for name, chars in reversed(SCRIPTS.items()):
        out = F.when(letter.rlike(f"[{chars}]"), name).otherwise(out)
    return out


def shares(sizes: dict[str, tuple[int, int]], bound: int, chars: int) -> dict[str, float]:
    """Share of each stratum to keep, from its ``(rows, characters)``: half of the bound is dealt out evenly, what a
    small stratum leaves goes to the others, and half by size. No stratum's expected characters exceed its part of ``chars``."""
    quota = dict.fromkeys(sizes, 0.0)
    left, open_ = bound / 2, sorted(sizes, key=lambda s: sizes[s][0])
    for i, s in enumerate(open_):  # the smallest first
        quota[s] = min(sizes[s][0], left / (len(open_) - i))
        left -= quota[s]
    rest = {s: sizes[s][0] - quota[s] for s in sizes}
    total = sum(rest.values())
    spare = bound - sum(quota.values())
    out = {}
    for s, (rows, size) in sizes.items():
        want = quota[s] + (min(1.0, spare / total) * rest[s] if total else 0.0)
        out[s] = min(1.0, want / max(1, rows), chars * want / bound / max(1, size))
    return out


def sampled(df: DataFrame, col: str, id_col: str, bound: int, seed: int, chars: int, prefer: str | None = None) -> list[str]:
    """About ``bound`` texts of ``col`` (all if there are fewer), at most about ``chars`` characters, in the order of their ids.

    Two scans of the two columns: one counts every script, one picks rows by a hash of the id, each script with a share
    of its own. The result does not depend on partitions or row order. ValueError if rows exist and none was picked.
    """
    some = df.select(F.col(id_col).alias("i"), F.col(col).alias("t")).where(F.col("t").isNotNull() & F.col("t").rlike(r"\S")).withColumn("s", stratum("t", prefer))
    sizes = {r.s: (r.n, r.c) for r in some.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.length("t").cast("long")).alias("c")).collect()}
    if not sizes:
        return []
    keep = shares(sizes, bound, chars)
    wanted = F.lit(0).cast("long")
    for s, k in keep.items():
        wanted = F.when(F.col("s") == s, F.lit(max(1, int(k * _SPAN))).cast("long")).otherwise(wanted)
    hashed = F.shiftrightunsigned(F.xxhash64("i", F.lit(seed)), 2)
    rows = some.where(hashed < wanted).select("i", "t").toPandas()
    if not len(rows):
        raise ValueError(f"no row of {sum(n for n, _ in sizes.values())} was sampled")
    return rows.sort_values(["i", "t"])["t"].tolist()
