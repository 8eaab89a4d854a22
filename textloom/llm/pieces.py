"""Problem 4: cutting lines that are longer than a limit in bytes.

The line is held as one character per UTF-8 byte, so a regular expression's bounded quantifier counts bytes. Its
alternatives, in the order of the boundary's strength, consume the line from left to right: up to a delimiter within
what the overlap leaves free, up to a delimiter within the whole limit (the overlap then shrinks), and by characters
where a stretch without delimiters is longer than the limit. Overlaps are taken from offsets before each piece.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import table

WIDTH, DELIMITERS = 80, ":, -./"
#: How far the first byte of a character is moved that belongs to the one before it.
_MOVED = 0x100
_CHAR_END = r"(?![\x80-\xBF])"


def _mark_bytes() -> dict[int, list[bytes]]:
    """By first byte, the UTF-8 forms of all characters that belong to the one before: combining marks and vowel signs,
    joiners, selectors and skin tones."""
    out: dict[int, list[bytes]] = {}
    for cp in range(0x300, 0xE01F0):
        if unicodedata.category(chr(cp))[0] == "M" or cp in (0x200C, 0x200D) or 0x1F3FB <= cp <= 0x1F3FF or 0xE0020 <= cp <= 0xE007F:
            raw = chr(cp).encode()
            out.setdefault(raw[0], []).append(raw)
    return out


def _tree(tails: list[bytes]) -> str:
    """Pattern of byte strings of one length, as a tree of byte classes."""
    hexed = lambda b: f"\\x{b:02X}"
    if len(tails[0]) == 1:
        return "[" + "".join(hexed(t[0]) for t in sorted(tails)) + "]"
    heads: dict[int, list[bytes]] = {}
    for t in tails:
        heads.setdefault(t[0], []).append(t[1:])
    same: dict[str, list[int]] = {}
    for h, rest in heads.items():
        same.setdefault(_tree(rest), []).append(h)
    return "(?:" + "|".join("[" + "".join(map(hexed, hs)) + "]" + p for p, hs in same.items()) + ")"


@lru_cache(maxsize=1)
def _mark_rules() -> list[tuple[str, str]]:
    """Rules that move the first bytes of marks, of what a joiner joins, and of all but the first regional indicator."""
    out = [(f"\\x{lead:02X}(?={_tree([r[1:] for r in raws])})", chr(lead + _MOVED)) for lead, raws in _mark_bytes().items()]
    flag = r"\x9F\x87[\xA6-\xBF]"
    out += [(rf"(?<=\x{{{0xE2 + _MOVED:X}}}\x80\x8D)\x{lead:02X}", chr(lead + _MOVED)) for lead in (0xE2, 0xF0)]
    return [*out, (rf"(?<=[\xF0\x{{{0xF0 + _MOVED:X}}}]{flag})\xF0(?={flag})", chr(0xF0 + _MOVED))]


_LEADS = "".join(chr(b) for b in range(0xC2, 0xF5))
_MOVED_LEADS = "".join(chr(b + _MOVED) for b in range(0xC2, 0xF5))
_MARK = f"[{_MOVED_LEADS[0]}-{_MOVED_LEADS[-1]}]"
#: Texts in which no character belongs to the one before it have none of these.
_SOME_MARK = r"[\p{M}\x{200C}\x{200D}\x{1F3FB}-\x{1F3FF}\x{1F1E6}-\x{1F1FF}\x{E0020}-\x{E007F}]"


def as_bytes(c: Column) -> Column:
    """Text with one character per UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def from_bytes(c: Column) -> Column:
    return F.decode(F.encode(F.translate(c, _MOVED_LEADS, _LEADS), "ISO-8859-1"), "UTF-8")


def marked_bytes(c: Column) -> Column:
    """``as_bytes`` in which the first byte of a character that belongs to the one before it is moved out of the range of bytes."""
    moved = reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), _mark_rules(), as_bytes(c))
    return F.when(c.rlike(_SOME_MARK), moved).otherwise(as_bytes(c))


def _any_form(char: Column) -> Column:
    """Pattern of one character's bytes, its first one moved or not."""
    raw = as_bytes(char)
    first = F.substring(raw, 1, 1)
    return F.when(F.length(raw) == 1, F.concat(F.lit(r"\Q"), raw, F.lit(r"\E"))).otherwise(
        F.concat(F.lit("["), first, F.translate(first, _LEADS, _MOVED_LEADS), F.lit(r"]\Q"), F.substring(raw, 2, 4), F.lit(r"\E"))
    )


def cut_pattern(width: Column, delimiters: Column, overlap: Column) -> Column:
    """Java pattern whose successive matches are the new parts of the pieces.

    Groups: 1 natural within what the overlap leaves, 2 natural within the limit, 3 forced.
    """
    marks = F.array_join(F.transform(F.regexp_extract_all(delimiters, F.lit("(?s)."), F.lit(0)), _any_form), "|")
    edge = F.when(marks == "", F.lit(r"\z")).otherwise(F.concat(F.lit("(?:(?<="), marks, F.lit(")|(?="), marks, F.lit(r")|\z)")))
    w, free = width.cast("string"), (width - overlap).cast("string")
    return F.concat(
        F.lit("(?s)(.{1,"), free, F.lit("}"), edge,
        F.lit(")|(.{1,"), w, F.lit("}"), edge,
        F.lit(")|(.{1,"), free, F.lit(f"}}{_CHAR_END}(?!{_MARK})|.{{1,"), free, F.lit(f"}}{_CHAR_END}|.[\\x80-\\xBF]*)"),
    )


def with_pattern(df: DataFrame) -> DataFrame:
    """``df`` of ``fold_items`` with the width and overlap that hold, and for lines over their width the bytes and the
    pattern, else null.

    Null width, delimiters and overlap mean 80 bytes, the six default delimiters and no overlap; a width below 1 counts
    as 1, a negative overlap as none. Every piece goes on by a character at least, with as much of the overlap as fits.
    """
    width = F.greatest(F.coalesce(F.col("column_width").cast("int"), F.lit(WIDTH)), F.lit(1))
    delims = F.coalesce(F.col("delimiters"), F.lit(DELIMITERS))
    over = F.greatest(F.least(F.coalesce(F.col("overlap").cast("int"), F.lit(0)), width - 1), F.lit(0))
    df = df.withColumn("_w", width).withColumn("_o", over).withColumn("_long", F.octet_length("line") > width)
    return df.withColumn("_b", F.when(F.col("_long"), marked_bytes(F.col("line")))).withColumn("_p", F.when(F.col("_long"), cut_pattern(F.col("_w"), delims, F.col("_o"))))


def forced_cuts(df: DataFrame) -> DataFrame:
    """``df`` with ``forced array<string>``: for each new part its text if it ends by force, else ''. One pass of the pattern."""
    df = with_pattern(df).withColumn("forced", F.regexp_extract_all("_b", F.col("_p"), F.lit(3)))
    return df.drop("_w", "_o", "_long", "_b", "_p")


def with_pieces(df: DataFrame) -> DataFrame:
    """``df`` of ``fold_items`` with ``pieces array<struct<piece,new_bytes,forced>>``, for lines longer than their width; null for others.

    A single character longer than the width is one piece. Pieces without their overlaps join to the line.
    """
    df = with_pattern(df)
    df = df.withColumn("_new", F.regexp_extract_all("_b", F.col("_p"), F.lit(0))).withColumn("_forced", F.regexp_extract_all("_b", F.col("_p"), F.lit(3)))
    ends = F.aggregate(
        "_new",
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))),
    )
    df = df.withColumn("_ends", ends)

    def piece(x: Column, i: Column) -> Column:
        at = F.get("_ends", i)
        back = F.when(i == 0, 0).otherwise(F.greatest(F.least(F.col("_o"), F.col("_w") - F.length(x), at), F.lit(0)))
        head = F.when(back == 0, "").otherwise(F.regexp_replace(F.substring(F.col("_b"), at - back + 1, back), r"^[\x80-\xBF]+", ""))
        return F.struct(
            from_bytes(F.concat(head, x)).alias("piece"),
            F.length(x).alias("new_bytes"),
            (F.get("_forced", i) != "").alias("forced"),
        )

    return df.withColumn("pieces", F.when(F.col("_long"), F.transform("_new", piece))).drop("_w", "_o", "_long", "_b", "_p", "_new", "_forced", "_ends")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items over their limit, and whether a stretch between delimiters forced a cut by characters."""
    df = forced_cuts(table(spark, sf_dir, "fold_items")).where("forced is not null")
    return df.select("item_id", F.when(F.exists("forced", lambda p: p != ""), "forced").otherwise("natural").alias("kind"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's pieces in order; an item within its limit is its own only piece, a null line has none."""
    df = with_pieces(table(spark, sf_dir, "fold_items")).where("line is not null")
    one = F.array(F.struct(F.col("line").alias("piece"), F.octet_length("line").alias("new_bytes"), F.lit(False).alias("forced")))
    return df.select("item_id", F.posexplode(F.coalesce("pieces", one)).alias("piece_no", "p")).select("item_id", "piece_no", "p.piece", "p.new_bytes", "p.forced")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
ORACLES = {
    "p4_found": """
SELECT item_id, CASE WHEN list_max(list_transform(string_split(
    translate(line, coalesce(delimiters, ':, -./'), repeat(chr(1), length(coalesce(delimiters, ':, -./')))), chr(1)), lambda x: strlen(x)))
    > coalesce(column_width, 80) THEN 'forced' ELSE 'natural' END AS kind
FROM fold_items WHERE strlen(line) > coalesce(column_width, 80)""",
}
