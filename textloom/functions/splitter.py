"""Rule-based sentence splitter by language, with lists of abbreviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions.prefixes import builtin

_OPEN = r"['\"(\[¿¡\p{Pi}]"
_SHUT = r"[」』'\")\]\p{Pf}]"
# Scripts whose letters may start a sentence, by language.
_STARTS = {
    "hi": r"\p{InDevanagari}", "mr": r"\p{InDevanagari}", "gu": r"\p{InGujarati}", "as": r"\p{InBengali}", "bn": r"\p{InBengali}", "mni": r"\p{InBengali}",
    "kn": r"\p{InKannada}", "ml": r"\p{InMalayalam}", "or": r"\p{InOriya}", "pa": r"\p{InGurmukhi}", "ta": r"\p{InTamil}", "te": r"\p{InTelugu}",
    "ko": r"\p{IsHangul}", "fa": r"\p{IsArabic}", "hy": r"\p{IsArmenian}",
}
_CJK = ("zh", "ja", "yue")


def breaks(lang: str) -> list[rules.Rule]:
    """Rules that put a newline at each boundary that does not hang on a full stop."""
    start = r"\p{IsUppercase}0-9" + _STARTS.get(lang, "")
    r: list[rules.Rule] = [
        (" +", " "), ("^ | $", ""),
        (rf"([?!؟।॥]) +({_OPEN}*[{start}])", "$1\n$2"),
        (rf"(\.\.+) +({_OPEN}*[{start}])", "$1\n$2"),
        (rf"([?!؟.।॥] *{_SHUT}+) +({_OPEN}* *[{start}])", "$1\n$2"),
        (rf"([?!؟.।॥]) +((?:[」』]|{_OPEN})+ *[{start}])", "$1\n$2"),
    ]
    if lang in _CJK:
        r += [("([。．？！]+\\s*[\"”„」』]?\\s*)", "$1\n"), (r"([.?!؟]) *(\p{InCJK_UNIFIED_IDEOGRAPHS})", "$1\n$2"), (r"(\p{P}) *(\p{P})", " $1 $2 ")]
    if lang == "ur":
        r.append((r"((?:[.?!۔]|\.\.+)['\"„»(\[¿¡\p{Pf}]*)\s+(['\"„»(\[¿¡\p{Pi}]*[؀-ۿ])", "$1\n$2"))
    if lang == "hy":
        r.append((r"([։:]) +([Ա-ՖևA-ZА-ЯЁ])", "$1\n$2"))
    return r


def split_text(c: Column, lang: str = "en", prefixes: dict[str, int] | None = None, list_items: bool = False) -> Column:
    """Sentences of one paragraph as an array; none for null and blank paragraphs."""
    prefixes = builtin(lang) if prefixes is None else prefixes
    never = [p for p, k in prefixes.items() if k == 1]
    numeric = [p for p, k in prefixes.items() if k == 2]
    start = r"\p{IsUppercase}0-9" + _STARTS.get(lang, "")

    def word(w: Column, i: Column, ws: Column) -> Column:
        nxt = F.coalesce(F.get(ws, i + 1), F.lit(""))
        prefix = F.regexp_extract(w, r"([\p{IsAlphabetic}\p{Nd}.-]*)(['\")\]%\p{Pf}]*)(\.+)$", 1)
        closing = F.regexp_extract(w, r"([\p{IsAlphabetic}\p{Nd}.-]*)(['\")\]%\p{Pf}]*)(\.+)$", 2)
        keep = w.rlike(r"\.[\p{IsUppercase}-]+\.+$")
        if never:
            keep = keep | (prefix.isin(never) & (closing == ""))
        if numeric:
            keep = keep | (prefix.isin(numeric) & (closing == "") & nxt.rlike("^[0-9]"))
        if list_items:
            keep = keep | (((i == 0) | F.coalesce(F.get(ws, i - 1), F.lit("")).endswith("\n")) & w.rlike(r"^\(?([0-9]+|[ivx]+|[A-Za-z])\)?\.$"))
        ends = w.rlike(r"\.$") & ~keep & (i < F.size(ws) - 1) & nxt.rlike(rf"^ *{_OPEN}* *[{start}]")
        return F.when(ends, F.concat(w, F.lit("\n"))).otherwise(w)

    s = rules.apply(c, breaks(lang))
    looped = F.element_at(F.transform(F.array(F.split(s, r"\h", -1)), lambda ws: F.array_join(F.transform(ws, lambda w, i: word(w, i, ws)), " ")), 1)
    s = rules.apply(looped, [(" +", " "), ("\n ", "\n"), (" \n", "\n"), ("^ | $", "")])
    return F.filter(F.transform(F.split(s, "\n"), lambda x: F.btrim(x)), lambda x: x != "")


def paragraphs(df: DataFrame, stream: str = "stream", pos: str = "pos", line: str = "line", each_line: bool = False) -> DataFrame:
    """``(stream, at, text, markup)``: lines joined with spaces up to a blank line or a line that is one tag.

    ``markup`` is the tag that ends the paragraph, ``<P>`` where a blank line did and text follows, else null.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    if each_line:
        return df.select(stream, F.col(pos).alias("at"), text.alias("text"), F.lit(None).cast("string").alias("markup"))
    w = Window.partitionBy(stream).orderBy(pos)
    stop = text.rlike(r"^<.+>$") | text.rlike(r"^\s*$")
    part = df.withColumn("_stop", stop).withColumn("_p", F.coalesce(F.sum(F.col("_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = part.groupBy(stream, "_p").agg(
        F.min(pos).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_stop"), F.struct(pos, line)))), lambda x: x[line]), " ").alias("text"),
        F.max(F.when(F.col("_stop"), text)).alias("_mark"),
    )
    following = F.lead("text").over(Window.partitionBy(stream).orderBy("at"))
    return joined.withColumn("markup", F.when(F.col("_mark").rlike(r"\S"), F.col("_mark")).when((F.col("_mark") != "") | F.col("_mark").isNotNull(), F.when(F.coalesce(following, F.lit("")) != "", "<P>"))).select(stream, "at", "text", "markup")


def split_stream(df: DataFrame, lang: str = "en", stream: str = "stream", pos: str = "pos", line: str = "line", each_line: bool = False, no_p: bool = False) -> DataFrame:
    """``(stream, at, n, sentence)``: sentences of a stream of lines in order, with its markup lines between them."""
    para = paragraphs(df, stream, pos, line, each_line)
    mark = F.when((F.col("markup") == "<P>") & F.lit(no_p), None).otherwise(F.col("markup"))
    items = F.concat(split_text(F.col("text"), lang), F.when(mark.isNotNull(), F.array(mark)).otherwise(F.array().cast("array<string>")))
    return para.select(stream, "at", F.posexplode(items).alias("n", "sentence"))
