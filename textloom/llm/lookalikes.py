"""Problem 5: one form for texts that read the same but differ in their characters.

Strings and code points that look alike are joined into classes by union-find: compatibility forms (width, styling,
ligatures), composed and decomposed letters and syllables, kinds of space, invisible characters, and letters of other
scripts with the same shape; for flattening also typographic and plain punctuation. The most frequent member in the
whole corpus represents its class, and a multi-pattern automaton rewrites every text greedily, longest member first,
until nothing changes.
"""

from __future__ import annotations

import itertools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import BROADCAST_ROWS, table

# For each letter the letters of other scripts and alphabets that are drawn like it, one script a string:
# Cyrillic, Greek, Armenian, Cherokee, Lisu, Coptic, then other Latin and phonetic letters and Roman numerals.
LETTERS: dict[str, tuple[str, ...]] = {
    "a": ("а", "ɑ"),
    "c": ("с", "ⲥ", "ⅽ"),
    "d": ("ԁ", "ⅾ"),
    "e": ("е", "ҽ"),
    "g": ("ց", "ɡ"),
    "h": ("һ", "հ"),
    "i": ("і", "ι", "ⅰ", "ı"),
    "j": ("ј", "յ"),
    "l": ("ӏ", "ⅼ"),
    "m": ("ⅿ",),
    "n": ("ո",),
    "o": ("о", "ο", "օ", "ⲟ"),
    "p": ("р", "ρ", "ⲣ"),
    "q": ("ԛ", "զ"),
    "s": ("ѕ",),
    "u": ("υ", "ս"),
    "v": ("ѵ", "ν", "ⅴ"),
    "w": ("ԝ", "ѡ"),
    "x": ("х", "ⅹ"),
    "y": ("у",),
    "A": ("А", "Α", "Ꭺ", "ꓮ", "Ⲁ"),
    "B": ("В", "Β", "Ᏼ", "ꓐ", "Ⲃ"),
    "C": ("С", "Ꮯ", "ꓚ", "Ⲥ", "Ⅽ"),
    "D": ("Ꭰ", "ꓓ", "Ⅾ"),
    "E": ("Е", "Ε", "Ꭼ", "ꓰ", "Ⲉ"),
    "F": ("Ϝ", "ꓝ"),
    "G": ("Ԍ", "Ԍ", "Ꮐ", "ꓖ"),
    "H": ("Н", "Η", "Ꮋ", "ꓧ", "Ⲏ"),
    "I": ("І", "Ι", "ꓲ", "Ⲓ", "Ⅰ"),
    "J": ("Ј", "Ꭻ", "ꓙ"),
    "K": ("К", "Κ", "Ꮶ", "ꓗ", "Ⲕ"),
    "L": ("Ꮮ", "ꓡ", "Ⅼ"),
    "M": ("М", "Μ", "Ꮇ", "ꓟ", "Ⲙ", "Ⅿ"),
    "N": ("Ν", "ꓠ", "Ⲛ"),
    "O": ("О", "Ο", "Օ", "ꓳ", "Ⲟ"),
    "P": ("Р", "Ρ", "Ꮲ", "ꓑ", "Ⲣ"),
    "Q": ("Ԛ",),
    "R": ("Ꭱ", "ꓣ"),
    "S": ("Ѕ", "Տ", "Ꮪ", "ꓢ"),
    "T": ("Т", "Τ", "Ꭲ", "ꓔ", "Ⲧ"),
    "U": ("Ս", "ꓴ"),
    "V": ("Ѵ", "Ꮩ", "ꓦ", "Ⅴ"),
    "W": ("Ԝ", "Ꮃ", "ꓪ"),
    "X": ("Х", "Χ", "ꓫ", "Ⲭ", "Ⅹ"),
    "Y": ("Ү", "Υ", "Ꮍ", "ꓬ", "Ⲩ"),
    "Z": ("Ζ", "Ꮓ", "ꓜ", "Ⲍ"),
    "к": ("κ", "ⲕ", "ĸ"),
    "т": ("τ", "ⲧ", "ᴛ"),
    "ʟ": ("ꮮ",),
}
#: Single characters with the same shape as a punctuation mark or another letter.
_SHAPES = {"‐": "-", "‑": "-", "−": "-", "ː": ":", "∶": ":", "∕": "/", "⁄": "/", "‚": ",", "ʼ": "’", "Đ": "Ð", "Ɖ": "Ð"}
#: Classes of typographic and plain punctuation and of joined letters, for flattening.
_FLAT = (
    ("'", "’", "‘", "‛", "′", "´", "`", "ʼ", "ʹ", "ʻ", "‹", "›"),
    ('"', "“", "”", "„", "‟", "″", "«", "»", "''", "``", "‘‘", "’’", "〝", "〞"),
    ("--", "–", "—", "―", "‒"),
    ("...", "…"),
    ("ae", "æ"),
    ("Ae", "Æ"),
    ("oe", "œ"),
    ("Oe", "Œ"),
    ("ij", "ĳ"),
    ("IJ", "Ĳ"),
)
_STYLES = {"<font>", "<wide>", "<narrow>", "<noBreak>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>"}


class Classes:
    """Union-find over strings; the smallest string is the root until representatives are chosen."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        self.parent[x] = p
        return p

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            lo, hi = sorted((ra, rb), key=lambda s: (len(s), s))
            self.parent[hi] = lo

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def spellings(c: str) -> set[str]:
    """All ways to write a composed letter: marks in any order that doesn't change it, in part composed."""
    full = unicodedata.normalize("NFD", c)
    base, marks = full[0], full[1:]
    out = set()
    for order in set(itertools.permutations(marks)) if len(marks) <= 3 else {tuple(marks)}:
        s = base + "".join(order)
        if unicodedata.normalize("NFC", s) != unicodedata.normalize("NFC", c):
            continue
        out.add(s)
        for k in range(1, len(order)):
            head = unicodedata.normalize("NFC", base + "".join(order[:k]))
            out.add(head + "".join(order[k:]))
    return out - {c}


@lru_cache(maxsize=2)
def classes(flatten: bool) -> dict[str, list[str]]:
    """Members of each class with more than one member, by any member as the key; '' stands for invisible characters."""
    uf = Classes()
    composed: list[str] = []
    for cp in itertools.chain(range(0x20, 0x30000), range(0xE0000, 0xE0200)):  # all planes with letters or format characters
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind == "Zs" or cp in (0x2028, 0x2029):
            uf.union(" ", c)
            continue
        if kind == "Cf" or cp in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180D:
            uf.union("", c)
            continue
        dec = unicodedata.decomposition(c)
        if 0xAC00 <= cp <= 0xD7A3 or (dec and dec[0] != "<"):
            composed.append(c)
        elif dec:
            plain = unicodedata.normalize("NFKC", c)
            tag = dec.split(" ", 1)[0]
            if plain != c and " " not in plain and (tag in _STYLES or (tag == "<compat>" and plain.isalpha())):
                uf.union(c, plain)
    for a, others in LETTERS.items():
        for b in others:
            uf.union(a, b)
    for a, b in _SHAPES.items():
        uf.union(a, b)
    alike: dict[str, list[str]] = {}
    for members in uf.groups().values():
        signs = [m for m in members if len(m) == 1 and unicodedata.category(m)[0] in "LM" and not unicodedata.decomposition(m).startswith("<font>")]
        alike.update((m, signs) for m in signs)
    for c in composed:
        for s in spellings(c):
            for variant in itertools.product(*([x] if 0xAC00 <= ord(c) <= 0xD7A3 else alike.get(x, [x]) for x in s)):
                uf.union(c, "".join(variant))
        if len(s := unicodedata.normalize("NFD", c)) == 3 and 0xAC00 <= ord(c) <= 0xD7A3:
            uf.union(c, unicodedata.normalize("NFC", s[:2]) + s[2])
    if flatten:
        for group in _FLAT:
            for x in group[1:]:
                uf.union(group[0], x)
    return {r: ms for r, ms in uf.groups().items() if len(ms) > 1}


def automaton(words: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, rep in words.items():
        if w:
            a.add_word(w, (len(w), rep))
    a.make_automaton()
    return a


def rewrite(text: str, a: ahocorasick.Automaton) -> str:
    """Replace leftmost-longest members by their representatives, again until nothing changes.

    Should rewriting come back to an earlier text, the smallest of those it goes round is taken.
    """
    if not len(a):
        return text
    seen: list[str] = []
    while text not in seen:
        seen.append(text)
        out, at = [], 0
        for end, (n, rep) in a.iter_long(text):
            start = end - n + 1
            if start > at:
                out.append(text[at:start])
            out.append(rep)
            at = end + 1
        if not at:
            return text
        out.append(text[at:])
        text = "".join(out)
        if len(seen) > 1000:
            raise RuntimeError(f"a text of {len(seen[0])} characters does not settle")
    return min(seen[seen.index(text) :], key=lambda t: (len(t), t))


def _counted(texts: DataFrame, schema: str, count: Callable[[str, Counter, str], None]) -> dict[str, Counter]:
    """Sums of what ``count(text, counter, field)`` counts over ``texts(field, text)``, by field, in one scan with a
    bounded table in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    count(t, seen.setdefault(f, Counter()), f)
        rows = [(f, m, n) for f, c in seen.items() for m, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["field", "member", "n"])

    out: dict[str, Counter] = {}
    for r in texts.mapInArrow(run, schema).groupBy("field", "member").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.field, Counter())[r.member] = r.n
    return out


def member_counts(texts: DataFrame) -> dict[str, Counter]:
    """How often each class member occurs in each field of ``texts(field, text)``, over all rows.

    The first scan counts characters; at most one entry comes back for each assigned character. Members of several
    characters are counted by an automaton in a second scan, which knows those only all of whose characters occur.
    """
    schema = "field string, member string, n long"
    out = _counted(texts, schema, lambda t, c, _: c.update(t))
    several = {f: sorted(m for ms in classes(f == "flatten").values() for m in ms if len(m) > 1 and all(x in c for x in m)) for f, c in out.items()}
    held = texts.sparkSession.sparkContext.broadcast({f: (ms, frozenset(m[0] for m in ms)) for f, ms in several.items()})
    made: dict = {}

    def count(text: str, c: Counter, field: str) -> None:
        members, first = held.value[field]
        if field not in made:
            made[field] = automaton({m: m for m in members})
        if members and not first.isdisjoint(text):
            c.update([m for _, (_, m) in made[field].iter_long(text)])

    for f, c in _counted(texts, schema, count).items():
        out[f].update(c)
    return out


def representatives(counts: Counter, flatten: bool) -> dict[str, str]:
    """Each member's representative: the most frequent of its class, then plain ASCII, then the shortest and first.

    Members with a character that neither occurs nor can come from rewriting are left out, as no text will hold them;
    without any counts all members stay.
    """
    best = [(ms, "" if "" in ms else min(ms, key=lambda m: (-counts[m], not m.isascii(), len(m), m))) for ms in classes(flatten).values()]
    chars = {m for m in counts if len(m) == 1}
    grown = bool(counts)
    while grown:
        reached = {x for ms, rep in best if not chars.issuperset(rep) and any(chars.issuperset(m) for m in ms if m) for x in rep}
        grown = not reached <= chars
        chars |= reached
    return {m: rep for ms, rep in best for m in ms if m != rep and (not counts or chars.issuperset(m))}


_BUILT: dict = {}


def triggers(words: dict[str, str]) -> frozenset[str]:
    """Characters of which every member that changes holds one: its last one beyond ASCII, or else its first.

    A text without any of them stays as it is.
    """
    return frozenset(next((c for c in reversed(w) if not c.isascii()), w[0]) for w in words if w)


def canonical(col: Column, reps: dict[str, str], spark: SparkSession) -> Column:
    """Column of rewritten texts; null stays null, an empty text empty."""
    name, held = uuid.uuid4().hex, spark.sparkContext.broadcast(reps)

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        if name not in _BUILT:
            if len(_BUILT) >= 8:  # of earlier queries
                _BUILT.clear()
            _BUILT[name] = (automaton(held.value), triggers(held.value))
        a, trigger = _BUILT[name]
        return pa.array([t if t is None or trigger.isdisjoint(t) else rewrite(t, a) for t in texts.to_pylist()], pa.string())

    # else the filter that is inferred for a join would run the function a second time
    return form.asNondeterministic()(col)


FIELDS = ("normalize", "flatten")


def _reps(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, str]]:
    both = lambda df, a, b: df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in zip(FIELDS, (a, b))))).alias("x")).select("x.*")
    texts = both(table(spark, sf_dir, "unicode_text"), *FIELDS).unionByName(both(table(spark, sf_dir, "glossary"), "form", "form"))
    counts = member_counts(texts)
    return {f: representatives(counts.get(f, Counter()), f == "flatten") for f in FIELDS}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that read like a glossary form without being the same string."""
    glossary = table(spark, sf_dir, "glossary").select("term_id", "form").where("form is not null")
    few = glossary.count() <= BROADCAST_ROWS
    parts = []
    for field, reps in _reps(spark, sf_dir).items():
        terms = glossary.select("term_id", "form", canonical(F.col("form"), reps, spark).alias("canon"))
        texts = table(spark, sf_dir, "unicode_text").select("text_id", F.col(field).alias("text")).where("text is not null and text <> ''")
        texts = texts.select("text_id", "text", canonical(F.col("text"), reps, spark).alias("canon"))
        hit = texts.join(F.broadcast(terms) if few else terms, "canon").where("text <> form")
        parts.append(hit.select("text_id", F.lit(field).alias("field"), "term_id"))
    return parts[0].unionByName(parts[1])


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every row in their one form."""
    df = table(spark, sf_dir, "unicode_text")
    return df.select("text_id", *[canonical(F.col(f), reps, spark).alias(f) for f, reps in _reps(spark, sf_dir).items()])


QUERIES = {"p5_found": p5_found, "p5_canonical": p5_canonical}
ORACLES: dict = {}
