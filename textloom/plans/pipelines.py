"""Whole pipelines as chains of transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.rules import apply_heuristics, normalize_punctuation
from textloom.functions.splitter import split_stream, split_text
from textloom.functions.tokenizer import tokenize
from textloom.functions.unicode import process_unicode
from textloom.sources.newswire import unwrap


def text_pipeline(c: Column, lang: str = "en", lower: bool = True, prefixes: dict[str, int] | None = None) -> Column:
    """Flatten and NFKC, tokenise, heuristics, punctuation, and lower case if wanted. One Python step, the rest on the JVM."""
    if len(lang) != 2:
        raise ValueError("a language has two letters")
    s = process_unicode(c, lang, flatten=True, normalize=True)
    s = normalize_punctuation(apply_heuristics(tokenize(s, lang, prefixes=prefixes), lang), lang)
    return F.lower(s) if lower else s


#: Languages with rules of their own in the splitter or a built-in list of abbreviations.
LANGUAGES = ("en", "de", "fr", "es", "it", "ru", "zh", "ja", "yue", "ko", "hi", "mr", "gu", "as", "bn", "mni", "kn", "ml", "or", "pa", "ta", "te", "fa", "hy", "ur")


def by_language(lang: Column, f: Callable[[str], Column], default: str = "en") -> Column:
    """``f`` of each row's language; of ``default`` for other languages and null."""
    out = f(default)
    for x in LANGUAGES:
        if x != default:
            out = F.when(lang == x, f(x)).otherwise(out)
    return out


def resplit(df: DataFrame, lang: str = "en", line: str = "line", lang_col: str | None = None, prefixes: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Lines split into sentences; existing line ends stay. ``(…, n, sentence)``

    With ``lang_col`` each line goes by the language in that column where it is one of LANGUAGES, else by ``lang``.
    ``prefixes``: lists of abbreviations by language, instead of the built-in ones.
    """
    lists = prefixes or {}
    one = lambda x: split_text(F.col(line), x, lists.get(x))
    got = by_language(F.col(lang_col), one, lang) if lang_col else one(lang)
    return df.select(*[c for c in df.columns if c != line], F.posexplode(got).alias("n", "sentence"))


def newswire_extract(df: DataFrame, lang: str = "en", stream: str = "stream", pos: str = "pos", line: str = "line") -> DataFrame:
    """Sentences of newswire blocks, without lines that hold a paragraph mark."""
    if len(lang) != 2:
        raise ValueError("a language has two letters")
    blocks = unwrap(df, stream, pos, line).select(stream, F.col("block_no").alias(pos), F.col("text").alias(line))
    return split_stream(blocks, lang, stream, pos, line, each_line=True).where(~F.col("sentence").contains("<P>"))
