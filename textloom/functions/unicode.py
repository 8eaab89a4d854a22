"""Lower case, flattening, NFKC and HTML entities."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Flattening rules; longer ones first at each starting character, in this order.
_GENERAL = [
    ("æ", "ae"), ("Æ", "Ae"), ("Œ", "Oe"), ("œ", "oe"), ("ﬁ", "fi"), ("\u00a0", " "), ("\u2028", " "), ("…", "..."), ("）", ")"), ("（", "("),
    ("–", "--"), ("—", "--"), ("●", "*"), ("•", "*"), ("·", "*"), ("& quot ;", '"'), ("& lt ;", "<"), ("& gt ;", ">"), ("& squot ;", "'"), ("& amp ;", "&"),
]
_QUOTES = [("``", '"'), ("''", '"'), ("«", '"'), ("»", '"'), ("”", '"'), ("“", '"'), ("″", '"'), ("„", '"'), ("’", "'"), ("‘", "'"), ("′", "'"), ("´", "'"), ("‹", "'"), ("›", "'"), ("`", "'")]
_FRENCH = [("``", "«"), ("''", "»"), ("”", "»"), ("“", "«"), ("″", "»"), ("„", "«"), ("’", "›"), ("‘", "‹"), ("′", "'")]
_DIGITS = [(f"{d}{{", str(d)) for d in range(10)]
#: Rules that hold only before white space or the end.
_BOUNDED = [("' s", "'s"), (" - year - old", " -year-old"), (" - years - old", " -years-old")]
LANGUAGES = {"en": _GENERAL + _QUOTES + _DIGITS, "de": _GENERAL + _QUOTES, "es": _GENERAL + _QUOTES, "fr": _GENERAL + _FRENCH, "cs": _GENERAL}


@lru_cache(maxsize=8)
def _flattener(lang: str) -> tuple[re.Pattern, dict[str, str]]:
    if lang not in LANGUAGES:
        raise ValueError(f"no flattening rules for {lang!r}")
    rules = dict(LANGUAGES[lang])
    parts = [re.escape(k) for k in sorted(rules, key=len, reverse=True)]
    if lang == "en":
        parts = [f"{re.escape(k)}(?=\\s|$)" for k, _ in _BOUNDED] + parts
        rules |= dict(_BOUNDED)
    return re.compile("|".join(parts)), rules


def flatten_text(text: str, lang: str) -> str:
    pattern, rules = _flattener(lang)
    return pattern.sub(lambda m: rules[m.group()], text)


def process_text(text: str | None, lang: str, lower: bool, flatten: bool, normalize: bool) -> str | None:
    if text is None:
        return None
    if lower:
        text = text.lower()
    if flatten:
        text = flatten_text(text, lang)
    return unicodedata.normalize("NFKC", text) if normalize else text


def process_unicode(c: Column, lang: str = "en", lower: bool = False, flatten: bool = False, normalize: bool = False) -> Column:
    """Lower case, then flattening, then NFKC, each if asked for. Bytes that are no UTF-8 become U+FFFD; null stays null.

    The language counts only for flattening; other languages than en, fr, de, es and cs are refused there.
    """
    if flatten:
        _flattener(lang)
    c = F.make_valid_utf8(c)
    if lower:
        c = F.lower(c)
    if not flatten and not normalize:
        return c

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: process_text(t, lang, False, flatten, normalize), na_action="ignore")

    # nothing else can change: characters beyond ASCII, and in flattening what begins a rule of ASCII characters
    changes = c.rlike(r"[^\x00-\x7F]" + (r"|['`{]|& | - years? - old" if flatten else ""))
    return F.when(changes, run(F.when(changes, c))).otherwise(c)


def nfkc(c: Column) -> Column:
    return process_unicode(c, normalize=True)


def unescape_html(c: Column) -> Column:
    """All named and numeric entities as characters; U+FEFF becomes a space."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t).replace("\ufeff", " "), na_action="ignore")

    return F.when(c.contains("&") | c.contains("\ufeff"), run(c)).otherwise(c)


def tokens(c: Column, delim: str, keep_empty: bool = True) -> Column:
    """Parts of a string between a fixed delimiter."""
    parts = F.split(c, re.escape(delim), -1)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")
