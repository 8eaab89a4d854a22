"""Problem 3: sentence boundaries in many languages and scripts.

Candidate boundaries are closing punctuation of any script (with the closing quotes and brackets that follow), and
white space after Thai letters. A maximum-entropy model classifies each by its neighbouring tokens, case, length,
digits, script and quotation. It is trained on reliable boundaries: a paragraph's end joined to another paragraph's
start is a boundary for certain, while candidates inside paragraphs are unlabelled. A score learnt that way is
proportional to the probability of a boundary, and the factor is its mean over held-out reliable boundaries. The
labels that follow, each made by a model that did not see the paragraph, train the final model.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.sample import sampled
from textloom.session import table

Model = tuple[np.ndarray, float]

#: Bounds of the training sample, in lines and in characters.
TRAIN_LINES, TRAIN_CHARS = 12_000, 8_000_000
DIM = 1 << 18
#: Cross-fitting folds, rounds of labelling, rows a feature needs (fewer in small samples), and the shares from which a
#: candidate counts as a boundary after the first and after later rounds.
FOLDS, ROUNDS, LEAST_SEEN, FIRST, NEXT = 3, 6, 20, 0.07, 0.1
#: Steps of a fit from zero, and of one that goes on from the round before.
FIRST_STEPS, LATER_STEPS = 100, 30

# Sentence-final marks, closing marks, and pairs of quotation marks and brackets.
ENDERS = ".!?\u2026\u3002\uff0e\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u0589;\u037e"
WIDE_ENDERS = "\u3002\uff0e\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u0589"
CLOSERS = "\"'”’»›)]}」』）】》〉〕］｝“"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "”": "“", "»": "«"}
_THIN = "\u0020\u00a0\u202f\u2009"

_CAND = re.compile(
    rf"[{re.escape(ENDERS)}]+(?:[{re.escape(CLOSERS)}]|[{_THIN}](?=»))*"
    r"|(?<=[\u0e00-\u0e7f])(?=\s)"
)
_QUOTES = re.compile(r'[“”„«»‹›「」『』()（）\[\]【】《》〈〉"]')
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """Coarse script of a letter from its Unicode name; '' for anything else."""
    if not ch or not ch.isalpha():
        return ""
    if ch.isascii():
        return "LATIN"
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0].split("-", 1)[0]


def quoted_spans(line: str) -> list[tuple[int, int]]:
    """``[open, close]`` positions of matched quotation marks and brackets; a mark without its partner is ignored."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTES.finditer(line):
        i, ch = m.start(), m.group()
        at = next((k for k in range(len(stack) - 1, -1, -1) if ch in (PAIRS.get(stack[k][0], "") if stack[k][0] != '"' else '"')), None)
        if at is not None and not (ch == "»" and stack[at][0] == "”"):
            out.append((stack[at][1], i))
            del stack[at:]
        elif ch == '"' or ch in PAIRS:
            stack.append((ch, i))
    return sorted(out)


def candidates(line: str) -> list[tuple[int, int, int]]:
    """``(start of the mark, end of the boundary, opening position of a quotation closed by it or -1)`` in order.

    Marks inside a quotation or bracket that goes on are no candidates: speech belongs to the sentence around it.
    """
    n = len(line.rstrip())
    spans = quoted_spans(line)
    found: list[tuple[int, int, int]] = []
    k = 0
    open_spans: list[tuple[int, int]] = []
    for m in _CAND.finditer(line):
        start, end = m.start(), m.end()
        if end >= n or (start == end and start == 0):
            continue
        while k < len(spans) and spans[k][0] < end:
            open_spans.append(spans[k])
            k += 1
        open_spans = [s for s in open_spans if s[1] >= start]
        while end > start and any(s[0] < end <= s[1] and line[end - 1] in CLOSERS and s[0] == end - 1 for s in open_spans):
            end -= 1  # the last mark opens a quotation instead
        if any(s[0] < start and s[1] >= end for s in open_spans):
            continue
        closed = min((s[0] for s in open_spans if s[0] < start <= s[1] < end), default=-1)
        mark = line[start] if end > start else ""
        nxt = line[end]
        if mark and not nxt.isspace():
            wide = mark in WIDE_ENDERS or (mark == "…" and script(nxt) in ("CJK", "HIRAGANA", "KATAKANA")) or script(nxt) in ("CJK", "HIRAGANA", "KATAKANA")
            opens = nxt in "“„«「『(（\"¿¡" and script(line[start - 1] if start else "") != ""
            joined = nxt.isupper() and start and line[start - 1].islower() and mark in ".!?…"
            if not (wide or opens or joined) or nxt in ENDERS:
                continue
        if mark in (";", ";") and script(_last_letter(line, start)) != "GREEK":
            continue
        found.append((start, end, closed))
    return found


def _last_letter(line: str, end: int) -> str:
    for i in range(end - 1, max(-1, end - 12), -1):
        if line[i].isalpha():
            return line[i]
    return ""


def _kind(tok: str) -> str:
    """Case and shape of a token's first character that matters."""
    c = tok[:1]
    if not c:
        return "none"
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper" if len(tok) > 1 else "initial"
    if c.islower():
        return "lower"
    if c.isalpha():
        return "letter"
    if c in "–—-":
        return "dash"
    return c


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


@lru_cache(maxsize=1 << 16)
def _clip(tok: str, most: int) -> str:
    return _DIGITS.sub("0", tok.lower())[:most]


@lru_cache(maxsize=1 << 16)
def _left_token(tok: str) -> tuple[int, int, int, str]:
    """Of the token before a boundary: its hash, hashes of its length and dots and of its kind, and its last character if a digit."""
    clip = _clip(tok.lstrip("“„«\"'("), 24)
    core = clip.rstrip(".")
    return _hash(clip), _hash(f"{min(len(core), 6)}{'.' in core}"), _hash(f"{_kind(tok)}{core.isalpha()}"), core[-1:] if core[-1:].isdigit() else ""


@lru_cache(maxsize=1 << 16)
def _right_token(tok: str) -> tuple[int, int, int, str]:
    """Of the token after a boundary: its hash, hashes of its kind and of kind and length, and its script."""
    bare = tok.lstrip("“„«\"'(¿¡「『（")
    kind = _kind(bare if bare else tok)
    return _hash(_clip(tok, 16)), _hash(kind + ("o" if bare != tok else "")), _hash(f"{kind}{min(len(bare), 5)}{'.' in bare}"), script(bare[:1])


@lru_cache(maxsize=1 << 16)
def _token(tok: str) -> int:
    return _hash(_clip(tok, 24))


@lru_cache(maxsize=1 << 12)
def _small(text: str) -> int:
    return _hash(text)


_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI")

#: What is observed at a boundary, in the order of a row of ``observed``.
_OBSERVED = ("mark", "quote", "script", "context", "t1", "t2", "size", "form", "spaced", "digit", "left2", "left4", "left7", "r1", "r2", "r3", "kind", "length", "right1", "right2", "right3", "right5")
#: Features: the observations that each combines, all of them hashed together with the feature's number.
FEATURES = (
    ("mark", "quote", "script"), ("script", "mark", "context"), ("mark", "t1"), ("mark", "t1", "t2"), ("mark", "script", "size", "spaced"), ("mark", "form"),
    ("mark", "script", "digit", "t2"), ("left2", "mark"), ("left4", "mark"), ("left7", "mark"),
    ("r1",), ("kind", "script", "mark", "quote", "context"), ("r1", "r2"), ("length",), ("right1",), ("right2",), ("right3",), ("right5",),
    ("right3", "script", "mark", "quote", "context"), ("r1", "script", "mark", "quote", "context"), ("r1", "r2", "r3", "script", "mark", "quote", "context"), ("mark", "t1", "kind"),
)
#: Features of writing without spaces, which stand only where an observation of that kind does.
_ONLY_IF_SEEN = {"left2", "left4", "left7", "right1", "right2", "right3", "right5"}


def observed(line: str, start: int, end: int, closed: int, right_line: str | None = None) -> list[int]:
    """Numbers of what stands at a boundary, in the order of ``_OBSERVED``; 0 for what does not apply.

    The right side may come from another line (a reliable boundary): then ``right_line`` is all that follows.
    """
    before = line[max(0, start - 60) : start]
    toks = before.rsplit(None, 2)
    h1, size, form, digit = _left_token(toks[-1] if toks else "")
    h2 = _token(toks[-2]) if len(toks) > 1 else 1
    sc = script(_last_letter(line, start)) or "none"
    mark = "space" if end == start else "..." if line.startswith("...", start) else line[start]
    quote = "q" if closed >= 0 else ("c" if end - start > 1 and line[end - 1] in CLOSERS else "-")
    ctx = "-"
    if closed >= 0:
        pre = line[:closed].rstrip()
        ctx = line[closed] + ("^" if not pre else ("end" if pre[-1] in ENDERS + CLOSERS else pre[-1] if not pre[-1].isalnum() else "w"))
    left = [0, 0, 0]
    if sc in _UNSPACED or sc == "none":
        left = [_hash(before[-n:]) | 1 for n in (2, 4, 7)]
    rest = (line[end : end + 60] if right_line is None else right_line[:60]).lstrip()
    after = rest.split(None, 3)
    r1, kind, length, rs = _right_token(after[0] if after else "")
    right = [0, 0, 0, 0]
    if rs in _UNSPACED:
        right = [_hash(rest[:n]) | 1 for n in (1, 2, 3, 5)]
    return [
        _small(mark), _small(quote), _small(sc), _small(ctx), h1, h2, size, form, 2 if before[-1:].isspace() else 1, _small(digit), *left,
        r1, _token(after[1]) if len(after) > 1 else 1, _token(after[2]) if len(after) > 2 else 1, kind, length, *right,
    ]


def matrix(rows: list[list[int]]) -> np.ndarray:
    """Feature numbers of observed boundaries, one row each; DIM is padding with weight 0."""
    x = np.array(rows, dtype=np.uint64).reshape(len(rows), len(_OBSERVED))
    at = {name: i for i, name in enumerate(_OBSERVED)}
    out = np.empty((len(rows), len(FEATURES)), dtype=np.int32)
    for k, parts in enumerate(FEATURES):
        h = np.full(len(rows), k + 1, dtype=np.uint64)
        for p in parts:
            h = (h ^ x[:, at[p]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        number = (h >> np.uint64(20)).astype(np.int64) & (DIM - 1)
        for p in _ONLY_IF_SEEN.intersection(parts):
            number = np.where(x[:, at[p]] == 0, DIM, number)
        out[:, k] = number
    return out


class Fit:
    """Maximum-entropy (logistic) weights of ``x``'s features by full-batch Adam.

    Features seen in too few rows get no weight; entry DIM is the padding's zero. ``of`` some rows starts where the
    last call with the same ``name`` ended, so that later rounds need fewer steps.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.kept = x, {}

    def of(self, rows: np.ndarray, y: np.ndarray, name: object = None, l2: float = 1e-5, steps: int = FIRST_STEPS, later: int = LATER_STEPS, rate: float = 0.3) -> np.ndarray:
        if (name, "plan") not in self.kept:
            x = self.x[rows]
            count = np.bincount(x.ravel(), minlength=DIM + 1)
            count[DIM] = 0
            used = np.flatnonzero(count >= min(LEAST_SEEN, max(2, len(x) // 2000)))
            dense = np.full(DIM + 1, len(used), dtype=np.int32)
            dense[used] = np.arange(len(used), dtype=np.int32)
            z = dense[x]
            order = np.argsort(z.ravel(), kind="stable")
            owner = (order // z.shape[1]).astype(np.int32)
            starts = np.searchsorted(z.ravel()[order], np.arange(len(used)))
            self.kept[name, "plan"] = (used, z, owner[: int(count[used].sum())], starts)
        used, z, owner, starts = self.kept[name, "plan"]
        w = self.kept.get((name, "w"))
        if w is None:
            w = np.zeros(len(used) + 1, np.float32)
        else:
            steps = later
        m, v = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32)
        y = y.astype(np.float32)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(w[z].sum(axis=1), -30, 30)))
            g = np.add.reduceat(((p - y) / np.float32(len(y)))[owner], starts) + np.float32(l2) * w[:-1] if len(used) else m
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w[:-1] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.kept[name, "w"] = w
        out = np.zeros(DIM + 1, np.float32)
        out[used] = w[:-1]
        return out


def final_mark(line: str) -> tuple[int, int, int] | None:
    """The mark that ends a line, in the form of ``candidates``."""
    s = line.rstrip()
    i = len(s)
    while i > 0 and (s[i - 1] in CLOSERS or (s[i - 1] in _THIN and i < len(s) and s[i] == "»")):
        i -= 1
    j = i
    while j > 0 and s[j - 1] in ENDERS:
        j -= 1
    if j == i:
        return (len(s), len(s), -1) if script(s[-1:]) == "THAI" or "\u0e00" <= s[-1:] <= "\u0e7f" else None
    closed = min((a for a, b in quoted_spans(s) if a < j <= b), default=-1)
    return j, len(s), closed


def train(lines: list[str]) -> tuple[np.ndarray, float]:
    """Weights and the threshold for the score, from a bounded sample of paragraphs."""
    by_script: dict[str, list[str]] = {}
    for ln in lines:
        first = next((c for c in ln if c.isalpha()), "")
        sc = script(first)
        by_script.setdefault("CJK" if sc in ("HIRAGANA", "KATAKANA") else sc, []).append(ln)
    pos: list[list[int]] = []
    unl: list[list[int]] = []
    owner: list[int] = []
    for group in by_script.values():
        for i, ln in enumerate(group):
            mine = [observed(ln, *c) for c in candidates(ln)]
            unl += mine
            owner += [_hash(ln)] * len(mine)
            end = final_mark(ln)
            if end is None or len(group) < 2:
                continue
            for step in (1, 2, 5):
                nxt = group[(i + step) % len(group)]
                wide = line_end_is_wide(ln, end)
                pos.append(observed(ln + " ", *end, right_line=nxt if wide else " " + nxt))
    if not pos or not unl:
        return np.zeros(DIM + 1, np.float32), -1.0  # nothing to learn from: every candidate counts
    n = len(pos)
    x = matrix(pos + unl)
    xp, xu = x[:n], x[n:]
    fold = np.concatenate([np.arange(n) // 3 % FOLDS, np.array(owner) % FOLDS])
    fp, fu = fold[:n], fold[n:]
    fits = Fit(x)
    share = np.zeros(len(xu))
    for k in range(FOLDS):  # reliable boundaries against unlabelled candidates, each scored by a model that did not see it
        rows = np.flatnonzero(fold != k)
        w = fits.of(rows, (rows < n).astype(float), ("first", k), l2=2e-5)
        level = _score(w, xp[fp == k]).mean() if (fp == k).any() else 0.5
        share[fu == k] = np.clip(_score(w, xu[fu == k]) / max(level, 1e-6), 0, 1)
    y = np.ones(len(x))
    for r in range(ROUNDS):  # then as labelled: the label of a candidate is what the others say of it
        y[n:] = share > FIRST if r == 0 else share > NEXT
        for k in range(FOLDS):
            rows = np.flatnonzero(fold != k)
            w = fits.of(rows, y[rows], ("then", k))
            share[fu == k] = _score(w, xu[fu == k])
    y[n:] = share > NEXT
    return fits.of(np.arange(len(x)), y, "all"), 0.5


def _score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Probability of a boundary for each row of feature numbers."""
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))


def line_end_is_wide(line: str, end: tuple[int, int, int]) -> bool:
    return end[1] > end[0] and line[end[0]] in WIDE_ENDERS and script(_last_letter(line, end[0])) in ("CJK", "HIRAGANA", "KATAKANA")


def boundaries(lines: list[str | None], w: np.ndarray, threshold: float) -> list[list[int]]:
    """End positions, in code points, of every sentence of every line; none for null and blank lines."""
    rows: list[list[int]] = []
    where: list[tuple[int, int]] = []
    out: list[list[int]] = [[] for _ in lines]
    for i, ln in enumerate(lines):
        if ln is None or not ln.strip():
            continue
        for c in candidates(ln):
            rows.append(observed(ln, *c))
            where.append((i, c[1]))
    if rows:
        score = _score(w, matrix(rows))
        for (i, end), s in zip(where, score):
            if s > threshold:
                out[i].append(end)
    for i, ln in enumerate(lines):
        if ln is not None and ln.strip():
            last = len(ln.rstrip())
            out[i] = [e for e in out[i] if e < last] + [last]
    return out


def learn(df: DataFrame, col: str = "line", id_col: str = "line_id", bound: int = TRAIN_LINES, chars: int = TRAIN_CHARS) -> Model:
    """Train on about ``bound`` lines of at most about ``chars`` characters, every script among them."""
    return train(sampled(df, col, id_col, bound, 17, chars))


def save(spark: SparkSession, model: Model, path: str) -> None:
    """The model as one small table in a shared folder."""
    w, threshold = model
    used = np.flatnonzero(w)
    rows = pd.DataFrame({"feature": np.append(used, -1), "weight": np.append(w[used], threshold).astype(float)})
    spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).toPandas()  # at most DIM + 1 rows
    w = np.zeros(DIM + 1, np.float32)
    known = rows[rows.feature >= 0]
    w[known.feature.to_numpy()] = known.weight.to_numpy()
    return w, float(rows[rows.feature < 0].weight.iloc[0])


def with_ends(df: DataFrame, col: str = "line", id_col: str = "line_id", model: Model | None = None) -> DataFrame:
    """``df`` with ``ends array<long>``: the end of each sentence of ``col`` in code points.

    Null and blank texts get an empty array; the last sentence ends at the last character that isn't white space.
    Without a ``model`` one is trained on ``df``.
    """
    w, threshold = learn(df, col, id_col) if model is None else model
    held = df.sparkSession.sparkContext.broadcast((w.astype(np.float32), threshold))

    @F.arrow_udf("array<bigint>")
    def ends(s: pa.Array) -> pa.Array:
        weights, limit = held.value
        got = boundaries(s.to_pylist(), weights, limit)
        offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([e for g in got for e in g], pa.int64()))

    # else the filter that is inferred for an explode would run the function a second time
    return df.withColumn("ends", ends.asNondeterministic()(F.col(col)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "split_lines").select("line_id", "line")
    return with_ends(df).select("line_id", F.explode("ends").alias("end_pos"))


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences themselves: ``(line_id, sent_no, sentence)``, leading and trailing white space removed."""
    df = with_ends(table(spark, sf_dir, "split_lines").select("line_id", "line"))
    one = df.select("line_id", "line", "ends", F.posexplode("ends").alias("sent_no", "end_pos"))
    start = F.when(F.col("sent_no") == 0, F.lit(0)).otherwise(F.get("ends", F.col("sent_no") - 1))
    piece = F.col("line").substr((start + 1).cast("int"), (F.col("end_pos") - start).cast("int"))
    return one.select("line_id", "sent_no", F.regexp_replace(piece, r"(?U)^\s+|\s+$", "").alias("sentence"))


QUERIES = {"p3_found": p3_found, "p3_sentences": p3_sentences}
ORACLES: dict = {}
