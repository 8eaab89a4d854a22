"""Restoring the usual case of words, and models of case from aligned words."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.stats import best_forms, case_counts
from textloom.session import BROADCAST_ROWS, settle

# Words that end a sentence, and words after which a sentence's start is still to come.
ENDS = {".", ":", "?", "!"}
DELAYS = {"(", "[", '"', "'", "&apos;", "&quot;", "&#91;", "&#93;"}


_SPACES = re.compile(r"[\t\n\v\f\r ]+")


def load_model(lines: Iterable[str]) -> dict[str, tuple[str, bool]]:
    """``form -> (best form, whether the form itself is known)`` from lines ``best (n/total) other (n) ...``.

    The first line about a form decides its best form; a blank line ends the model.
    """
    model: dict[str, tuple[str, bool]] = {w: (w, True) for w in ENDS | DELAYS}

    def note(form: str, best: str, known: bool) -> None:
        old = model.get(form)
        model[form] = (old[0], old[1] or known) if old else (best, known)

    for ln in lines:
        parts = split_words(ln)
        if not parts:
            break
        best = parts[0]
        note(best, best, True)
        note(best.lower(), best, False)
        for form in parts[2::2]:
            note(form, best, True)
    return model


def train_model(df: DataFrame, line: str = "line") -> dict[str, tuple[str, bool]]:
    """A model from the words of all lines but their first ones: the most frequent form of each word is the best, then the
    smaller one. Its size is checked before it is collected."""
    words = df.select(F.posexplode(F.filter(F.split(line, "[\\t\\n\\x0b\\f\\r ]+"), lambda x: x != "")).alias("i", "form")).where("i > 0")
    forms = words.groupBy(F.lower("form").alias("low"), "form").agg(F.count("*").alias("n"))
    lines = forms.groupBy("low").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "form"))).alias("f"))
    lines = settle(lines, "case-model")
    if lines.count() > BROADCAST_ROWS:
        raise ValueError(f"a case model of more than {BROADCAST_ROWS} words")
    model: dict[str, tuple[str, bool]] = {w: (w, True) for w in ENDS | DELAYS}
    for r in lines.toLocalIterator():
        best = r.f[0].form
        for w, known in [(r.low, False), *((x.form, True) for x in r.f)]:
            old = model.get(w)
            model[w] = (old[0], old[1] or known) if old else (best, known)
    return model


def split_words(line: str) -> list[str]:
    """Words between ASCII white space; other spaces belong to their words."""
    return [w for w in _SPACES.split(line) if w]


def truecase_line(line: str, model: dict[str, tuple[str, bool]]) -> str:
    start, out = True, []
    for w in split_words(line):
        best, known = model.get(w, (w, False))
        out.append(w if known and not start else model.get(w.lower(), (w, False))[0])
        if w in ENDS:
            start = True
        elif w not in DELAYS or not known:
            start = False
    return " ".join(out)


def truecase(c: Column, model: dict[str, tuple[str, bool]]) -> Column:
    """Lines with each word in its best case. The model goes once to every worker, so its size is checked."""
    if len(model) > BROADCAST_ROWS:
        raise ValueError(f"a case model of {len(model)} forms is over the bound of {BROADCAST_ROWS}")
    held = SparkSession.builder.getOrCreate().sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        forms = held.value
        return s.map(lambda t: truecase_line(t, forms), na_action="ignore")

    return run(c)


def checked_links() -> Column:
    """The column ``links``; an error where one lies beyond the words of ``source`` or ``target``."""
    inside = F.forall("links", lambda x: (x["i"] >= 0) & (x["j"] >= 0) & (x["i"] < F.size("source")) & (x["j"] < F.size("target")))
    return F.when(inside, F.col("links")).when(F.col("links").isNotNull(), F.raise_error(F.lit("a link lies beyond the words")))


def links_of(df: DataFrame) -> DataFrame:
    """``(source, target)`` of aligned words from ``(source array, target array, links array<struct<i,j>>)``.

    Links on the first word of either side are left out; a link beyond the words is an error. Null links are none.
    """
    one = df.select("source", "target", F.explode(checked_links()).alias("l")).where("l.i <> 0 and l.j <> 0")
    return one.select(F.get("source", F.col("l.i")).alias("source"), F.get("target", F.col("l.j")).alias("target"))


def train_case(df: DataFrame) -> DataFrame:
    """``(source, lower_target, form, cnt)`` from aligned sentences."""
    return case_counts(links_of(df))


def apply_case(df: DataFrame, counts: DataFrame, key: str = "sent") -> DataFrame:
    """``(sent, text)``: target words in the most frequent form for their source word; later links go over earlier ones."""
    model = best_forms(counts)
    words = df.select(key, F.posexplode("target").alias("j", "word"))
    links = df.select(key, "source", "target", F.posexplode(checked_links()).alias("k", "l")).select(key, "k", F.col("l.j").alias("j"), F.get("source", F.col("l.i")).alias("source"), F.lower(F.get("target", F.col("l.j"))).alias("lower_target"))
    chosen = links.join(model, ["source", "lower_target"]).groupBy(key, "j").agg(F.max(F.struct("k", "form")).alias("c")).select(key, "j", F.col("c.form").alias("form"))
    got = words.join(chosen, [key, "j"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", F.coalesce("form", "word").alias("w")))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda x: x["w"]), " ")
    return df.select(key).join(got, key, "left").select(key, F.coalesce(text, F.lit("")).alias("text"))


def parse_alignment(c: Column) -> Column:
    """``"n ||| i-j i-j"`` as an array of links."""
    pairs = F.regexp_extract_all(F.element_at(F.split(c, r"\|\|\|"), -1), F.lit(r"\d+-\d+"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("i"), F.split(p, "-")[1].cast("int").alias("j")))


def parse_giza(sentence: Column) -> Column:
    """Links of a third line of an alignment triple, ``NULL ({ 3 }) word ({ 1 2 }) ...``, of each source word from 0 to the
    1-based target words; the first word, NULL, has none. Null for a line that does not begin with it."""
    sets = F.regexp_extract_all(sentence, F.lit(r"\(\{([ 0-9]*)\}\)"), F.lit(1))
    of = F.transform(F.slice(sets, 2, F.greatest(F.size(sets) - 1, F.lit(0))), lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda n: F.struct(i.alias("i"), (n.cast("int") - 1).alias("j"))))
    return F.when(sentence.startswith("NULL "), F.flatten(of))


def giza_sentences(triples: DataFrame, texts: DataFrame, key: str = "sent") -> tuple[DataFrame, DataFrame]:
    """Aligned sentences ``(sent, source, target, links)`` and the discarded ones ``(sent)``.

    ``triples(sent, comment, target_line, alignment)`` are the three lines of each sentence, ``texts(sent, source, target)``
    its words with their case. A sentence whose lengths in the comment are not those of its texts is discarded.
    """
    both = triples.join(texts, key)
    size = lambda name: F.regexp_extract("comment", name + r" length (\d+)", 1).cast("int")
    good = F.coalesce((size("source") == F.size("source")) & (size("target") == F.size("target")), F.lit(False))
    links = F.coalesce(parse_giza(F.col("alignment")), F.raise_error(F.lit("an alignment does not begin with NULL")))
    return both.where(good).select(key, "source", "target", links.alias("links")), both.where(~good).select(key)


def model_lines(counts: DataFrame) -> DataFrame:
    """``(source, lower_target, line)``: the forms of each pair and their counts, tab-separated, the most frequent first."""
    forms = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "form")))
    text = F.array_join(F.transform("f", lambda x: F.concat(x["form"], F.lit(" "), (-x["n"]).cast("string"))), "\t")
    return counts.groupBy("source", "lower_target").agg(forms.alias("f")).select("source", "lower_target", text.alias("line"))
