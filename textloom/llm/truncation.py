"""Problem 8: texts cut off by field limits or in mid-transfer.

For each source, lengths (in characters and in bytes) more frequent than their neighbours are candidate limits, however
few texts reach them. A log-normal length
distribution is fitted to the source by maximum likelihood, with the values at the limit right-censored, and gives
each value at the limit its posterior of having been longer. That is combined with the evidence of the text's ending,
whose likelihood among cut texts is learnt from the values that were censored for certain.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import BROADCAST_ROWS, settle, table

#: A length is a candidate limit if chance gives so frequent a length to fewer than this many lengths of its source.
CHANCE = 0.001
#: Lengths whose logarithm times this has the same whole part are neighbours, and those of the next parts below and above.
NEIGHBOURS = 10
#: A last line's shape is a closing line from this share of all documents (so at most its inverse many shapes), if it has
#: at most so many characters and words: signatures, tags and notices are short.
CLOSING_SHARE, CLOSING_CHARS, CLOSING_WORDS = 0.0015, 60, 5
#: A word of up to so many letters with a full stop is an abbreviation if less than this share of its occurrences end a line
#: and if chance, at the usual share of such ends, gives so few of them with less than this probability.
ABBREVIATION_LETTERS, FINAL_SHARE, ABBREVIATION_CHANCE = 8, 0.02, 0.01
#: An opening mark of markup or a bracket further from the end is text, not a fragment.
FRAGMENT_CHARS = 40
#: Longest headline in writing without upper case.
HEADLINE_CHARS = 120
#: The fit of a source's lengths is never surer than this of a value at a limit, and a length alone never says more than
#: this factor about a cut in mid-transfer.
FIT_ERROR, LENGTH_SAYS = 1e-3, 20.0
#: Share of endings that are read as complete although they aren't; the shares of complete texts that are expected to end
#: inside a sentence, on an abbreviation or on a broken character, and the weight of that against what the corpus says.
MISREAD, UNFINISHED, EXPECTED_WEIGHT = 1e-4, {"open": 2e-4, "short": 2e-4, "broken": 2e-6}, 3.0

# Marks that end a sentence, and marks that may follow them.
_END = r"[.!?。．！？｡।॥؟۔]"
_CLOSERS = " \t\n\x0b\f\r\u00a0\u2007\u2009\u202f\"'’”“»›)]}」』）】》"
# Scripts that are written without sentence marks.
_UNMARKED = r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
ENDINGS = ("whole", "trail", "closing", "headline", "broken", "short", "open", "unmarked")


def trimmed(c: str) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def shape(line: Column) -> Column:
    """A line's letters and digits by kind: ``A`` a capitalised word, ``a`` another word, ``9`` a number."""
    s = F.regexp_replace(line, r"\p{N}+", "9")
    s = F.regexp_replace(s, r"\p{Lu}[\p{L}\p{M}’]*", "A")
    return F.regexp_replace(s, r"[\p{Ll}\p{Lo}\p{M}][\p{L}\p{M}’]*", "a")


def abbreviations(hits: DataFrame) -> DataFrame:
    """``(tok)`` of ``hits(h)``, words with a full stop and the character after it: those that hardly ever end a line."""
    toks = hits.groupBy(F.regexp_replace("h", r"\s+$", "").alias("tok")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("h").rlike(r"[\r\n]$|\.$"), 1).otherwise(0)).alias("final")
    )
    toks = settle(toks, "stopped-words")
    shared = toks.agg(F.sum("final") / F.sum("n")).first()[0]
    usual = F.lit(min(max(float(shared or 0.0), 1e-6), 1 - 1e-6))
    q = F.col("final") / F.col("n")
    apart = F.when(q > 0, q * F.log(q / usual)).otherwise(0.0) + (1 - q) * F.log((1 - q) / (1 - usual))
    few = (q < FINAL_SHARE) & (q < usual) & (F.col("n") * apart > -math.log(ABBREVIATION_CHANCE))
    return toks.where(few).select("tok")


def with_endings(df: DataFrame) -> DataFrame:
    """``df(doc_id, source, text)`` of non-blank texts with ``ending``, ``n`` (code points), ``b`` (bytes) and hash ``h`` of the text.

    whole: a sentence ends; trail: an ellipsis ends; closing: a frequent closing line; headline: a single line without
    a sentence's end; broken: a broken character or a fragment of markup; short: an abbreviation; unmarked: writing
    without sentence marks; open: anything else. The texts are read once; what the classes need of them is written.
    """
    df = df.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("_t", trimmed("text")).where("_t <> ''")
    df = df.withColumn("_last", F.substring_index(F.translate("_t", "\r", "\n"), "\n", -1)).withColumn("_one", F.length("_last") == F.length("_t"))
    df = df.withColumn("_tail", F.expr(f"right(_last, {FRAGMENT_CHARS + 2})")).withColumn("_bare", F.rtrim("_last", F.lit(_CLOSERS)))
    lone = F.col("_tail").rlike(rf"\ufffd$|&#?\w{{0,8}}$|<[^<>]{{0,{FRAGMENT_CHARS}}}$|\[[^\[\]]{{0,{FRAGMENT_CHARS}}}$")
    marked = F.expr("right(_bare, 1)").rlike(_END)
    df = df.withColumn("_shape", F.when((F.length("_last") <= CLOSING_CHARS) & ~lone, shape(F.col("_last"))))
    words = F.regexp_count("_last", F.lit(r"(?<![\p{L}\p{M}\p{N}’'])\p{L}"))
    small = F.regexp_count("_last", F.lit(r"(?<![\p{L}\p{M}\p{N}’'])\p{Ll}"))
    caseless = ~F.col("_last").rlike(r"[\p{Lu}\p{Ll}]{3}")
    title = (~caseless & (words >= 3) & (small * 8 <= words)) | (caseless & (F.length("_last") <= HEADLINE_CHARS) & ~F.col("_last").rlike(_END + r"|…")) | F.col("_last").rlike(r"^\p{Lu}{4,}: ")
    named = F.col("_shape").rlike(r"[^Aa ]") & (F.size(F.split("_shape", " ")) <= CLOSING_WORDS) & ~marked
    ending = (
        F.when(lone, "broken")
        .when(F.col("_bare").endswith("…") | F.col("_bare").endswith("..."), "trail")
        .when(marked, "whole")
        .when(F.col("_one") & title & ~F.col("_last").rlike(_END + r"\s"), "headline")
        .when(F.col("_bare").rlike(_UNMARKED + r"\p{M}*$"), "unmarked")
        .otherwise("open")
    )
    letters = rf"\p{{L}}{{1,{ABBREVIATION_LETTERS}}}\."
    seen = settle(
        df.select(
            "doc_id", "source", ending.alias("ending"), F.when(named, F.col("_shape")).alias("named"),
            F.nullif(F.regexp_extract("_tail", rf"(?:^|[\s(«„“])({letters})$", 1), F.lit("")).alias("word"),
            F.regexp_extract_all("text", F.lit(rf"(?<![^\s(«„“]){letters}(?:[\r\n]|[^\S\r\n]|$)"), F.lit(0)).alias("hits"),
            F.length("text").cast("long").alias("n"), F.octet_length("text").cast("long").alias("b"), F.xxhash64("text").alias("h"),
        ),
        "texts-seen",
    )
    often = max(3.0, CLOSING_SHARE * seen.count())
    closing = [r.named for r in seen.where("named is not null").groupBy("named").count().where(F.col("count") >= often).collect()]
    short = settle(abbreviations(seen.select(F.explode("hits").alias("h"))).select(F.col("tok").alias("word"), F.lit(True).alias("short")), "abbreviations")
    few = short.count() <= BROADCAST_ROWS
    last = seen.select("doc_id", "source", "ending", "named", "word", "n", "b", "h").join(F.broadcast(short) if few else short, "word", "left")
    late = F.col("ending").isin("whole", "headline", "open", "unmarked")
    is_closing = F.col("named").isin(closing) if closing else F.lit(False)
    final = F.when((F.col("ending") != "broken") & is_closing, "closing").when(late & F.coalesce("short", F.lit(False)), "short").otherwise(F.col("ending"))
    return last.select("doc_id", "source", final.alias("ending"), "n", "b", "h")


def censored_fit(n: float, s1: float, s2: float, at: float, limit: float, steps: int = 60) -> tuple[float, float]:
    """Mean and deviation of log-length by maximum likelihood (EM), from the ``n`` values below the limit (sums ``s1``
    and ``s2`` of the logarithms and their squares) and ``at`` values known only to reach it."""
    mu = s1 / n if n else math.log(limit)
    sd = math.sqrt(max(s2 / n - mu * mu, 0.01)) if n else 1.0
    c = math.log(limit)
    for _ in range(steps):
        z = (c - mu) / sd
        tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
        mills = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        e1 = mu + sd * mills
        e2 = mu * mu + sd * sd + sd * (c + mu) * mills
        m = n + at
        mu, sd = (s1 + at * e1) / m, math.sqrt(max((s2 + at * e2) / m - ((s1 + at * e1) / m) ** 2, 0.01))
    return mu, sd


def _by_unit(df: DataFrame) -> DataFrame:
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("size")) for u in ("n", "b"))))
    return df.select("source", "k", "texts", units.alias("x")).select("source", "x.*", "k", "texts")


def _surprising(k: Column) -> Column:
    """Whether ``k`` different texts of one length are beyond chance among ``span`` lengths with ``usual`` each (Chernoff
    bound of the Poisson tail, with all counts divided by ``clumps``, the texts that come at once)."""
    return (k > F.col("usual")) & (k * F.log(k / F.col("usual")) - k + F.col("usual") > F.col("clumps") * F.log(F.col("span") / F.lit(CHANCE)))


def candidates(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(source, unit, size)`` of the lengths that hold more different texts than their neighbours let expect.

    A text whose length is a candidate in both units, or is within three bytes of several, speaks for the one with the
    greatest excess only: texts cut at 480 characters pile up at a few lengths in bytes too. Where the neighbours' texts
    share lengths more than chance lets them, as forms do, a candidate must stand out from that.
    """
    part = F.floor(F.log("size") * NEIGHBOURS)
    long = sizes.where("size > 20").withColumn("part", part)
    parts = long.groupBy("source", "unit", "part").agg(F.sum("texts").alias("texts"), F.sum(F.col("texts") * (F.col("texts") - 1)).alias("twice"))
    around = parts.select("source", "unit", "texts", "twice", F.explode(F.array(*(F.col("part") + d for d in (-1, 0, 1)))).alias("part"))
    around = around.groupBy("source", "unit", "part").agg(F.sum("texts").alias("around"), F.sum("twice").alias("twice"))
    spans = long.groupBy("source", "unit").agg((F.max("size") - F.min("size") + 1).alias("span"))
    width = F.ceil(F.exp((F.col("part") + 2) / NEIGHBOURS)) - F.ceil(F.exp((F.col("part") - 1) / NEIGHBOURS)) - 1
    first = long.join(around, ["source", "unit", "part"]).join(spans, ["source", "unit"])
    first = first.withColumn("usual", (F.col("around") - F.col("texts") + 1) / F.greatest(width, F.lit(1)))
    shared = (F.col("twice") - F.col("texts") * (F.col("texts") - 1)) / F.greatest(F.col("around") - F.col("texts"), F.lit(1))
    first = first.withColumn("clumps", F.greatest(F.lit(1.0), 1 + shared - F.col("usual")))
    first = first.where(_surprising(F.col("texts"))).select("source", "unit", "size", "usual", "span", "clumps", (F.col("texts") - F.col("usual")).alias("excess"))
    first = settle(first, "candidates")
    by_n = first.where("unit = 'n'").select("source", F.col("size").alias("n"), F.struct("excess", "unit", "size").alias("cn"))
    by_b = first.where("unit = 'b'").select("source", F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3)).alias("b"), F.struct("excess", "unit", "size").alias("c"))
    by_b = by_b.groupBy("source", "b").agg(F.max("c").alias("cb"))
    own = pairs.join(by_n, ["source", "n"], "left").join(by_b, ["source", "b"], "left").where("cn is not null or cb is not null")
    own = own.select("source", "n", "b", "texts", F.greatest("cn", "cb").alias("c")).where(F.when(F.col("c.unit") == "n", F.col("n")).otherwise(F.col("b")) == F.col("c.size"))
    own = own.groupBy("source", F.col("c.unit").alias("unit"), F.col("c.size").alias("size")).agg(F.sum("texts").alias("own"))
    return first.join(own, ["source", "unit", "size"]).where(_surprising(F.col("own"))).select("source", "unit", "size")


def limits(docs: DataFrame) -> DataFrame:
    """Candidate limits with their posterior: ``(source, unit, size, posterior)``.

    ``docs`` has ``source, n, b`` and the text's hash ``h``. Copies of a text count once for its length to be a candidate.
    In bytes, values up to three bytes around count as at the limit, for a character cut in two or replaced.
    """
    texts = docs.groupBy("source", "n", "b", "h").agg(F.count("*").alias("k"))
    pairs = settle(texts.groupBy("source", "n", "b").agg(F.sum("k").alias("k"), F.count("*").alias("texts")), "lengths")
    sizes = settle(_by_unit(pairs).groupBy("source", "unit", "size").agg(F.sum("k").alias("at"), F.sum("texts").alias("texts")), "sizes")
    whole = sizes.groupBy("source", "unit").agg(F.sum("at").alias("total"))
    cand = candidates(pairs, sizes).join(whole, ["source", "unit"])
    near = F.when(F.col("unit") == "b", 3).otherwise(0)
    other = sizes.select("source", "unit", F.col("size").alias("x"), F.col("at").alias("k"))
    lx = F.log(F.greatest("x", F.lit(1)))
    stat = cand.join(other, ["source", "unit"]).groupBy("source", "unit", "size", "total").agg(
        F.sum(F.when(F.abs(F.col("x") - F.col("size")) <= near, F.col("k")).otherwise(0)).alias("at"),
        F.sum(F.when(F.col("x") < F.col("size") - near, F.col("k")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") > F.col("size") + near, F.col("k")).otherwise(0)).alias("above"),
        F.sum(F.when(F.col("x") < F.col("size") - near, F.col("k") * lx).otherwise(0)).alias("s1"),
        F.sum(F.when(F.col("x") < F.col("size") - near, F.col("k") * lx * lx).otherwise(0)).alias("s2"),
    )

    @F.pandas_udf("posterior double, mu double, sd double")
    def fitted(unit: pd.Series, size: pd.Series, at: pd.Series, below: pd.Series, above: pd.Series, s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        out = []
        for u, c, k, lo, hi, a, b in zip(unit, size, at, below, above, s1, s2):
            mu, sd = censored_fit(float(lo), float(a), float(b), float(k), float(c))
            z = (math.log(c) - mu) / sd
            tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
            density = math.exp(-0.5 * z * z) / (sd * c * math.sqrt(2 * math.pi)) * (7 if u == "b" else 1)
            held = max(0.0, k - (lo + k + hi) * density) / max(1.0, max(0.0, k - (lo + k + hi) * density) + hi)
            out.append((held * tail / (held * tail + density) if held > 0 else 0.0, mu, sd))
        return pd.DataFrame(out, columns=["posterior", "mu", "sd"])

    return stat.select("source", "unit", "size", fitted("unit", "size", "at", "below", "above", "s1", "s2").alias("f")).select("source", "unit", "size", "f.*")


def lengths(docs: DataFrame, lim: DataFrame) -> DataFrame:
    """``(source, mu, sd)`` of each source's whole lengths in characters: the censored fit at its likeliest limit where it
    has one, else mean and deviation of the logarithms."""
    lx = F.log(F.greatest("n", F.lit(1)))
    plain = docs.groupBy("source").agg(F.avg(lx).alias("m"), F.sqrt(F.greatest(F.var_pop(lx), F.lit(0.01))).alias("d"))
    best = lim.where("unit = 'n' and posterior > 0.5").groupBy("source").agg(F.max(F.struct("posterior", "size", "mu", "sd")).alias("f"))
    return plain.join(best, "source", "left").select("source", F.coalesce("f.mu", "m").alias("mu"), F.coalesce("f.sd", "d").alias("sd"))


def length_odds(n: str = "n") -> Column:
    """Logarithm of how much likelier a length is for a text cut at a random place than for a whole one of its source,
    from the source's ``mu`` and ``sd`` (normal tails by the logistic function), within LENGTH_SAYS."""
    x = F.log(F.greatest(n, F.lit(1)))
    z = (x - F.col("mu")) / F.col("sd")
    cut = -F.col("mu") + F.col("sd") * F.col("sd") / 2 - F.log1p(F.exp(F.least(1.702 * (z + F.col("sd")), F.lit(500.0))))
    whole = -z * z / 2 - x - F.log(F.col("sd")) - 0.5 * math.log(2 * math.pi)
    most = math.log(LENGTH_SAYS)
    return F.greatest(F.least(cut - whole, F.lit(most)), F.lit(-most))


class Evidence:
    """Shares of endings among texts cut at a limit, cut in transfer, and whole, and the share of cuts in transfer.

    Learnt by expectation and maximisation from ``cells``: ``(ending, posterior at a limit, odds of the length) -> texts``.
    A text that ends as complete ones do is complete whatever cut it, but for MISREAD of them; an ellipsis, and writing
    without sentence marks, say nothing of a cut in transfer. Whether texts that end inside a sentence away from any
    limit were cut, or are of that kind, is told by their lengths, against the expectation that few are of that kind.
    """

    def __init__(self, cells: dict[tuple[str, float, float], float], steps: int = 60) -> None:
        kinds = {k: i for i, k in enumerate(ENDINGS)}
        keys = list(cells)
        e = np.array([kinds[k[0]] for k in keys], dtype=np.int64)
        n = np.array([cells[k] for k in keys], dtype=float)
        q = np.clip(np.array([k[1] for k in keys], dtype=float), 0, 1 - FIT_ERROR)
        odds = np.exp(np.array([k[2] for k in keys], dtype=float))
        complete = [kinds[k] for k in ("whole", "closing")]
        silent = [kinds[k] for k in ("trail", "unmarked")]
        few = np.full(len(ENDINGS), 0.5)
        start = few.copy()
        start[[kinds["broken"], kinds["open"]]] += 5.0
        start[kinds["short"]] += 1.0
        self.rate = 0.05
        self.whole = np.bincount(e, n * (q <= 0.9), len(ENDINGS)) + few
        for k, share in UNFINISHED.items():
            self.whole[kinds[k]] = share * self.whole.sum()
        self.whole /= self.whole.sum()
        expected = EXPECTED_WEIGHT * self.whole
        self.limit = self.transfer = np.bincount(e, n * (q > 0.9), len(ENDINGS)) + start
        self._share(complete, silent, kinds["headline"])
        for _ in range(steps):
            parts = self._parts(e, q, odds)
            r_limit, r_transfer, r_whole = (n * p / sum(parts) for p in parts)
            self.limit = np.bincount(e, r_limit, len(ENDINGS)) + 0.1 * start
            self.transfer = np.bincount(e, r_transfer, len(ENDINGS)) + start  # at first as at limits
            self.whole = np.bincount(e, r_whole, len(ENDINGS)) + expected * r_whole.sum() + 1e-9
            self.whole /= self.whole.sum()
            self._share(complete, silent, kinds["headline"])
            self.rate = float(np.clip(r_transfer.sum() / max(1e-9, (r_transfer + r_whole).sum()), 1e-4, 0.5))

    def _share(self, complete: list[int], silent: list[int], headline: int) -> None:
        """Counts of endings as shares, some of which are given by what complete texts do."""
        for name, fixed in (("limit", complete), ("transfer", [*complete, headline, *silent])):
            p = np.array(getattr(self, name))
            given = self.whole[fixed] * np.array([1.0 if i in silent else MISREAD for i in fixed])
            p[fixed] = 0
            p *= (1 - given.sum()) / p.sum()
            p[fixed] = given
            setattr(self, name, p)

    def _parts(self, e: np.ndarray, q: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rate = self.rate * odds / (1 - self.rate + self.rate * odds)
        return q * self.limit[e], (1 - q) * rate * self.transfer[e], (1 - q) * (1 - rate) * self.whole[e]

    def column(self) -> Column:
        """Posterior probability of a cut, from the columns ``ending``, ``posterior`` and ``odds``."""

        def of(p: np.ndarray) -> Column:
            out = F.lit(0.0)
            for k, v in zip(ENDINGS, p):
                out = F.when(F.col("ending") == k, F.lit(float(v))).otherwise(out)
            return out

        q = F.least(F.col("posterior"), F.lit(1 - FIT_ERROR))
        rate = self.rate * F.exp("odds") / (1 - self.rate + self.rate * F.exp("odds"))
        cut = q * of(self.limit) + (1 - q) * rate * of(self.transfer)
        return cut / (cut + (1 - q) * (1 - rate) * of(self.whole))


def judged(df: DataFrame) -> DataFrame:
    """``(doc_id, source, ending, posterior, odds, chance, cut)`` of every non-blank text of ``df(doc_id, source, text)``.

    ``posterior`` is the fit's, that the value was censored at a limit; ``odds`` what the source's fit says of its length;
    ``chance`` combines both with the ending into the probability of a cut, and ``cut`` is whether it is over one half.
    """
    docs = settle(with_endings(df), "endings")
    lim = settle(limits(docs), "limits")
    by_n = lim.where("unit = 'n'").select("source", F.col("size").alias("n"), F.col("posterior").alias("pn"))
    by_b = lim.where("unit = 'b'").select("source", F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3)).alias("b"), F.col("posterior").alias("pb"))
    by_b = by_b.groupBy("source", "b").agg(F.max("pb").alias("pb"))
    fits = settle(lengths(docs, lim), "lengths")
    if fits.count() <= BROADCAST_ROWS:
        fits = F.broadcast(fits)
    known = docs.join(fits, "source").join(by_n, ["source", "n"], "left").join(by_b, ["source", "b"], "left")
    known = known.select("doc_id", "source", "ending", F.greatest(F.coalesce("pn", F.lit(0.0)), F.coalesce("pb", F.lit(0.0))).alias("posterior"), length_odds().alias("odds"))
    known = settle(known, "known")
    cells = known.groupBy("ending", F.round("posterior", 2).alias("q"), F.round(F.col("odds") * 2).alias("o")).count().collect()  # at most 8 x 101 x 13
    evidence = Evidence({(r.ending, r.q, r.o / 2): r["count"] for r in cells})
    return known.withColumn("chance", evidence.column()).withColumn("cut", F.col("chance") > 0.5)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: its documents, those that were cut, and their share. Blank and null texts are never cut."""
    docs = table(spark, sf_dir, "documents")
    cut = judged(docs.select("doc_id", "source", "text")).groupBy("source").agg(F.sum(F.col("cut").cast("long")).alias("n_cut"))
    every = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_docs"))
    return every.join(cut, "source", "left").select("source", "n_docs", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_docs")).alias("share"))


QUERIES = {"p8_found": p8_found, "p8_sources": p8_sources}
ORACLES: dict = {}
