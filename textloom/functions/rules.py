"""Ordered rewriting rules as tables, applied on the JVM, and the same tables as DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern, replacement) in Java syntax; only what RE2 reads too, so that the tables can be checked in SQL.
Rule = tuple[str, str]

NB = "\u00a0"

# Characters with a meaning in later tools, and their entities; the ampersand first.
ESCAPES: list[tuple[str, str]] = [("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;")]
LEGACY: list[tuple[str, str]] = [("&bar;", "|"), ("&bra;", "["), ("&ket;", "]")]


def apply(c: Column, rules: list[Rule]) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def sql(expr: str, rules: list[Rule]) -> str:
    """The same rules as nested DuckDB calls."""

    def one(acc: str, rule: Rule) -> str:
        pat, rep = rule
        rep = rep.replace("\\$", "\u0001").replace("$", "\\").replace("\u0001", "$")
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        return f"regexp_replace({acc}, {quote(pat)}, {quote(rep)}, 'g')"

    return reduce(one, rules, expr)


def escape(c: Column) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), ESCAPES, c)


def tidy_escape(c: Column) -> Column:
    """A whole line as later tools want it: spaces squeezed and trimmed, control characters gone, escaped, and translation
    instructions that were markup before put back."""
    out = escape(apply(c, TIDY))
    return apply(out, RESTORED)


def deescape(c: Column) -> Column:
    """Inverse of ``escape``, with the older names; the ampersand last."""
    pairs = [(b, a) for a, b in ESCAPES[1:]] + LEGACY + [("&amp;", "&")]
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_sql(expr: str, undo: bool = False) -> str:
    pairs = ([(b, a) for a, b in ESCAPES[1:]] + LEGACY + [("&amp;", "&")]) if undo else ESCAPES
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return reduce(lambda acc, p: f"replace({acc}, {quote(p[0])}, {quote(p[1])})", pairs, expr)


#: Before escaping a whole file: control characters go, spaces are squeezed and trimmed.
TIDY: list[Rule] = [(r"[\x00-\x1f]", ""), (r"\s+", " "), (r"^ | $", "")]


# Fixed value: an instruction that was markup before escaping.
RESTORED: list[Rule] = [(r"&lt;(\S+) translation=&quot;(.+?)&quot;&gt; (.+?) &lt;/(\S+)&gt;", '<$1 translation="$2"> $3 </$4>')]


# The rules of this function, in their order.
def punctuation(lang: str = "en", penn: bool = False) -> list[Rule]:
    """Rules that bring punctuation to plain ASCII, for one language. ``(\\s*[^<])`` may match the line's end, so the
    caller adds a newline and takes it away again (``normalize_punctuation``)."""
    r: list[Rule] = [
        (r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "), (r"\) ([.!:?;,])", r")$1"), (r"\( ", "("), (r" \)", ")"),
        (r"([0-9]) %", r"$1%"), (r" :", ":"), (r" ;", ";"),
    ]
    if not penn:
        r += [("`", "'"), ("''", ' " ')]
    r += [("[„“”]", '"'), ("–", "-"), ("—", " - "), (r" +", " "), ("´", "'")]
    r += [(r"([a-zA-Z])‘([a-zA-Z])", r"$1'$2"), (r"([a-zA-Z])’([a-zA-Z])", r"$1'$2"), ("[‘‚’]", '"'), ("''", '"'), ("´´", '"'), ("…", "...")]
    r += [(f"{NB}«{NB}", ' "'), (f"«{NB}", '"'), ("«", '"'), (f"{NB}»{NB}", '" '), (f"{NB}»", '"'), ("»", '"')]
    r += [(f"{NB}%", "%"), (f"nº{NB}", "nº "), (f"{NB}:", ":"), (f"{NB}ºC", " ºC"), (f"{NB}cm", " cm"), (rf"{NB}\?", "?"), (f"{NB}!", "!"), (f"{NB};", ";"), (f",{NB}", ", "), (r" +", " ")]
    if lang == "en":
        r += [(r'"([,.]+)', r'$1"')]
    elif lang not in ("cs", "cz"):
        r += [(r',"', r'",'), (r'(\.+)"(\s*[^<])', r'"$1$2')]
    r += [(rf"([0-9]){NB}([0-9])", r"$1,$2" if lang in ("de", "es", "cz", "cs", "fr") else r"$1.$2")]
    return r


def normalize_punctuation(c: Column, lang: str = "en", penn: bool = False) -> Column:
    return F.regexp_replace(apply(F.concat(c, F.lit("\n")), punctuation(lang, penn)), r"\n$", "")


def normalize_punctuation_sql(expr: str, lang: str = "en", penn: bool = False) -> str:
    return f"regexp_replace({sql(f'({expr} || chr(10))', punctuation(lang, penn))}, chr(10) || '$', '')"


# French pronouns that follow a verb with a hyphen, English words that join with a following "- " or "n 't".
_PRONOUNS = "je|j'|tu|il|elle|on|nous|vous|ils|elles|me|m'|te|t'|le|l'|la|les|lui|leur|moi|toi|eux|ce|c'|ça|ceci|cela|qui|ci|là"
_PREFIXES = "short|long|medium|one|half|two|on|off|in|post|ex|multi|de|mid|co|inter|intra|anti|re|pre|e|non|pro|self"
_NEGATED = "ca|are|do|could|did|does|had|has|have|is|must|need|should|was|were|wo|would"

# The rules of the lists below, in their order.
_COMMON: list[Rule] = [
    (r"_\s*_[\s_]*", " __ "), (r"\*\s*\*[\s*]*", " * "), ("#+", ""), ("!+", "!"), (r"!([^ ])", r"! $1"), (r"\.([^\s0-9.])", r". $1"),
    (r"\+([^0-9])", r"+ $1"), (r"([^0-9])\+", r"$1 +"), (r",([^0-9])", r", $1"), (r"(\s)-([^\s0-9-])", r"$1- $2"), (r"^ *-- *", ""), (" dlrs ", r" \$ "),
]
_FRENCH: list[Rule] = [
    (rf"(?i)([^ -]+)-t-({_PRONOUNS}) ", r"$1 -t-$2 "), (rf"(?i)([^ -]+)-({_PRONOUNS}) ", r"$1 -$2 "),
    (r"(?i)\s+(qu|c|d|l|j|s|n|m|lorsqu|puisqu)\s+'\s+", r" $1' "), (r"(?i)\s+aujourd\s*'\s*hui\s+", " aujourd'hui "),
]
_ENGLISH: list[Rule] = [
    (r"(?i) élite ", " elite "), (r"(?i) (s|at) & (t|p) ", r" $1&$2 "), (r"(?i) (full|half|part) - (time) ", r" $1-$2 "),
    (r"(?i) (vis|viz) - (.|..) - (vis|viz) ", " vis-à-vis "), (rf"(?i) ({_PREFIXES}) - ", r" $1- "), (rf"(?i) ({_NEGATED})n 't ", r" $1n't "),
]
_TAIL: list[Rule] = [
    (r"\.\s*\.\s*\.\s*[.\s]*", " ... "), (r"!\s*![!\s]*", " ! "), (r"\?\s*\?[?\s]*", " ? "), (" ' s ", " 's "), (r"([^-])--+([^-])", r"$1 - $2"),
    (r"\s+", " "), (r"^\s+", ""), (r"\s+$", ""),
]


def heuristics(lang: str = "en", compat: str = "observed") -> list[Rule]:
    """Rules after tokenising, for text with a space at both ends.

    ``observed`` is what the usual pipeline does: French and English rules always, long words never. ``intended`` goes
    by the language.
    """
    r = list(_COMMON)
    if compat == "observed" or lang == "fr":
        r += _FRENCH
    if compat == "observed" or lang == "en":
        r += _ENGLISH
    r.append((r" ([AaEe][Ll]) - ", r" $1-"))
    if compat == "intended" and lang != "de":
        r.append((r"\S{50,}", "-"))
    return r + _TAIL


def apply_heuristics(c: Column, lang: str = "en", compat: str = "observed") -> Column:
    return apply(F.concat(F.lit(" "), c, F.lit(" ")), heuristics(lang, compat))


def heuristics_sql(expr: str, lang: str = "en", compat: str = "observed") -> str:
    return sql(f"(' ' || {expr} || ' ')", heuristics(lang, compat))
