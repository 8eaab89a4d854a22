"""Problem 1: text decoded with the wrong character encoding.

A smoothed character trigram model of clean lines scores each line and everything it turns into when it is encoded
with one encoding and decoded with another: the whole line, the longest stretches that the first encoding can hold,
and single sequences of valid UTF-8 bytes inside it; the winner is tried again, for text that was garbled twice. The
likeliest is accepted if it beats the line by a margin, which is set on clean lines, each judged by a model that has not
seen it, and on the same lines garbled on purpose. Model, margin and all else come from every row. A replacement character stands for lost bytes: the model says by how much the characters it expects there are
likelier, and the line is reported as not recoverable.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.sample import shares, stratum
from textloom.session import discard, settle, table

#: Sizes (powers of two) of the look-up tables, at least, and the code points told apart (all planes in use).
_B3, _B2, _CODES = 22, 21, 1 << 18
#: Lines and characters that all rows together count as: the smoothing constants are for about so many.
MASS_LINES, MASS_CHARS = 20_000, 8_000_000
#: Parts of all lines, each of which is judged by a model of the others.
FOLDS = 5
#: Values that the driver sorts at once to find a quantile; of more it first counts which are near it.
HELD_VALUES = 100_000
#: Characters that are scored at once.
BLOCK_CHARS = 300_000

#: Log-probability of the oddest trigram from which a line is tried, at first and at least.
FIRST_ODD, LAST_ODD = -7.0, -9.0
#: Where the margin lies between what clean lines gain by chance (at 0) and what garbled lines gain (at 1); the margin, in
#: nats, of samples with fewer garbled lines than VALIDATED, and the gain from which readings word by word are not tried too.
MARGIN_AT, FEW_MARGIN, VALIDATED, SURE = 0.4, 5.0, 100, 5.0
#: Characters that a replacement character may stand for: the most frequent ones.
FILLS = 96

# Fixed values: (encoding read by mistake, encoding the bytes were in).
_WRONG_FOR_UTF8 = ("w1252", "latin-1", "cp1251", "cp1250", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8-r", "iso8859-15", "iso8859-2", "iso8859-5", "cp1254", "cp1253", "mac_cyrillic", "gb18030", "cp932", "big5", "cp949", "euc_jp")
_LATIN = ("w1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp1254", "cp852", "cp866", "iso8859-15", "mac_cyrillic", "iso8859-5")
_CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
_WIDE = ("cp932", "euc_jp", "gb18030", "big5", "cp949")
CHAINS = (
    [(w, "utf-8") for w in _WRONG_FOR_UTF8]
    + [(w, t) for t in _CYRILLIC for w in ("w1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", *_CYRILLIC) if w != t]
    + [(w, t) for t in ("latin-1", "w1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp852", "iso8859-15") for w in _LATIN if w != t]
    + [(w, t) for t in _WIDE for w in ("w1252", "latin-1", "cp437", "mac_roman", "cp1251", "koi8-r", *_WIDE) if w != t]
)


def _w1252_encode(text: str, errors: str = "strict") -> tuple[bytes, int]:
    """Windows-1252 with its five unused bytes as control characters, as lenient readers have it."""
    return codecs.charmap_encode(text, errors, _W1252_OUT)


_W1252_TABLE = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256))
_W1252_OUT = codecs.charmap_build(_W1252_TABLE)


_ENTITY = re.compile(r"&#(?:(1[2-9]\d|[2-9]\d\d|\d{4,6})|[xX]([89a-fA-F][0-9a-fA-F]|[0-9a-fA-F]{3,5}));")


def without_entities(line: str) -> str:
    """Numeric entities of characters beyond ASCII as these characters: a garbled line may have been escaped later."""

    def char(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(char, line) if "&#" in line else line


def encode(text: str, enc: str) -> bytes:
    return _w1252_encode(text)[0] if enc == "w1252" else text.encode(enc)


def decode(raw: bytes, enc: str, errors: str = "strict") -> str:
    return codecs.charmap_decode(raw, errors, _W1252_TABLE)[0] if enc == "w1252" else raw.decode(enc, errors)


_UTF8_SEQ = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_REPLACED = re.compile("\ufffd+")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_LOST = re.compile("�|[^\\W\\d_]\\?[^\\W\\d_]")


def _repertoire(enc: str) -> re.Pattern:
    """Pattern of the longest stretches of characters that a single-byte encoding can hold."""
    chars = "".join(c for c in (decode(bytes([b]), enc, "ignore") for b in range(128, 256)) if c)
    return re.compile(f"[\\x00-\\x7f{re.escape(chars)}]+")


def _bytes_of(enc: str) -> dict[str, int]:
    """The byte beyond ASCII of each character of a single-byte encoding."""
    return {decode(bytes([b]), enc): b for b in range(128, 256) if decode(bytes([b]), enc, "ignore")}


_BY_WRONG = {w: [t for v, t in CHAINS if v == w] for w, _ in CHAINS}
_STRETCH = {w: _repertoire(w) for w in _BY_WRONG if w not in _WIDE}
_BYTES = {w: _bytes_of(w) for w in _STRETCH}
#: Two characters that stand for the first two bytes of a UTF-8 sequence: without them nothing can be one.
_PAIR = {w: re.compile("[" + re.escape("".join(c for c, b in m.items() if 0xC2 <= b <= 0xF4)) + "][" + re.escape("".join(c for c, b in m.items() if b < 0xC0)) + "]") for w, m in _BYTES.items()}


def _sequences(run: str, raw: bytes) -> str | None:
    """``run`` with every valid UTF-8 sequence of its bytes ``raw`` decoded and all else left alone; None if there is none."""
    out, at = [], 0
    for m in _UTF8_SEQ.finditer(raw.decode("latin-1")):
        try:
            good = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out.append(run[at : m.start()] + good)
        at = m.end()
    return "".join(out) + run[at:] if out else None


def changes(high: str) -> list[str]:
    """Every other reading, by a chain of two single-byte encodings, of the different characters ``high`` beyond ASCII.

    Such a chain changes single characters, so a reading is told by what becomes of each; a character that the first
    encoding lacks, or whose byte the second one lacks, stays.
    """
    out: dict[str, None] = {}
    for wrong, byte in _BYTES.items():
        held = [i for i, c in enumerate(high) if c in byte]
        raw = bytes(byte[high[i]] for i in held)
        for true in _BY_WRONG[wrong] if held else ():
            if true != "utf-8" and true not in _WIDE:
                new = list(high)
                for i, c in zip(held, decode(raw, true, "replace")):
                    if c != "\ufffd":
                        new[i] = c
                out["".join(new)] = None
    out.pop(high, None)
    return list(out)


def decoded(line: str) -> list[str]:
    """Every other reading of ``line`` by a chain in which several bytes are one character.

    The stretches that the first encoding can hold are decoded, once for encodings that write them with the same bytes.
    """
    out: dict[str, None] = {}
    high = "".join(dict.fromkeys(_NON_ASCII.findall(line)))
    seen: set[tuple] = set()
    for wrong, trues in _BY_WRONG.items() if high else ():
        stretch = _STRETCH.get(wrong)
        if stretch is None:
            try:
                raw = encode(line, wrong)
            except UnicodeEncodeError:
                continue
            for true in trues:
                try:
                    out[decode(raw, true)] = None
                except UnicodeDecodeError:
                    pass
            continue
        several = [t for t in trues if t in _WIDE or (t == "utf-8" and _PAIR[wrong].search(line))]
        held = sum(c in _BYTES[wrong] for c in high) if several else 0
        if not held:
            continue
        runs = [(0, len(line))] if held == len(high) else [m.span() for m in stretch.finditer(line) if not m.group().isascii()]
        raws = [encode(line[a:b], wrong) for a, b in runs]
        for true in several:
            if (true, tuple(runs), tuple(raws)) in seen:
                continue
            seen.add((true, tuple(runs), tuple(raws)))
            new, at = [], 0
            goods: list[str | None] = []
            for (a, b), raw in zip(runs, raws):
                if true == "utf-8" and not _PAIR[wrong].search(line, a, b):
                    goods.append(None)
                    continue
                try:
                    goods.append(decode(raw, true))
                except UnicodeDecodeError:
                    goods.append(_sequences(line[a:b], raw) if true == "utf-8" else None)
            if all(g is None for g in goods):  # some bytes are lost
                goods = [decode(raw, true, "replace") for raw in raws]
            for (a, b), good in zip(runs, goods):
                if good is not None and good != line[a:b]:
                    new += [line[at:a], good]
                    at = b
            if new:
                out["".join(new) + line[at:]] = None
    for wrong in ("w1252", "latin-1", "cp1251", "cp1250") if high else ():  # garbled several times the same way
        text = line
        for depth in range(3):
            try:
                text = decode(encode(text, wrong), "utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                break
            if depth:
                out[text] = None
    out.pop(line, None)
    return list(out)


class TrigramModel:
    """Character trigrams with smoothed back-off to bigrams and single characters.

    Counts are kept by exact n-gram; dense hashed tables for fast look-up are made where the model is used.
    """

    def __init__(self) -> None:
        self.ids3 = self.ids2 = np.zeros(0, np.int64)
        self.n3 = self.n2 = np.zeros(0, np.float32)
        self.c1, self.n, self._dense, self._seen = np.zeros(_CODES, np.float32), 0.0, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None, "_seen": None}

    @staticmethod
    def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, each after two starting marks and before an end mark; digits count as one
        character, control characters as spaces."""
        joined = "\x02\x02" + "\x03\x02\x02".join(texts) + "\x03"
        x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 3 for t in texts])
        starts = np.cumsum(sizes) - sizes
        x = np.where((x >= 48) & (x <= 57), 48, x)
        x = np.where(x < 32, 32, np.minimum(x, _CODES - 1))
        x[starts] = x[starts + 1] = 2
        x[starts + sizes - 1] = 3
        return x, starts

    @staticmethod
    def _ids(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (x[:-2] << 36) | (x[1:-1] << 18) | x[2:], (x[:-1] << 18) | x[1:]

    @staticmethod
    def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def of(cls, counts: pd.DataFrame) -> TrigramModel:
        """The model of counted n-grams (``counted``); an n-gram that is there several times counts with the sum."""
        out = cls()
        sums = {k: g.groupby("id")["n"].sum() for k, g in counts.groupby("kind")}
        get = lambda k: (sums[k].index.to_numpy(np.int64), sums[k].to_numpy(np.float64)) if k in sums else (np.zeros(0, np.int64), np.zeros(0))
        (out.ids3, n3), (out.ids2, n2), (ids, n) = ((i[n > 0], n[n > 0]) for i, n in map(get, "321"))
        out.n3, out.n2 = n3.astype(np.float32), n2.astype(np.float32)
        out.c1[ids], out.n = n, float(n.sum())
        return out

    def _tables(self) -> tuple[np.ndarray, np.ndarray, int, int]:
        if self._dense is None:
            # at most a quarter of the places is taken, however many n-grams there are
            b3, b2 = (max(b, (4 * len(ids)).bit_length()) for b, ids in ((_B3, self.ids3), (_B2, self.ids2)))
            t3, t2 = np.zeros(1 << b3, np.float32), np.zeros(1 << b2, np.float32)
            np.add.at(t3, self._slot(self.ids3, b3), self.n3)
            np.add.at(t2, self._slot(self.ids2, b2), self.n2)
            self._dense = (t3, t2, b3, b2)
        return self._dense

    def _logs(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of each character from the third on."""
        t3, t2, b3, b2 = self._tables()
        i3, i2 = self._ids(x)
        n2 = t2[self._slot(i2, b2)]
        p1 = (self.c1[x[2:]] + 0.02) / (self.n + 0.02 * _CODES)
        p2 = (n2[1:] + 3.0 * p1) / (self.c1[x[1:-1]] + 3.0)
        p3 = (t3[self._slot(i3, b3)] + 2.0 * p2) / (n2[:-1] + 2.0)
        return np.log(np.minimum(p3, 1.0))

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text."""
        if not texts:
            return np.zeros(0)
        if len(texts) > 1 and sum(map(len, texts)) > BLOCK_CHARS:
            half = len(texts) // 2
            return np.concatenate([self.score(texts[:half]), self.score(texts[half:])])
        return self._sums(*self.codes(texts))

    def _sums(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        logs = self._logs(x)
        inside = np.ones(len(logs), bool)
        inside[starts[1:] - 2] = inside[starts[1:] - 1] = False  # the starting marks of the next text
        return np.add.reduceat(np.where(inside, logs, 0.0), starts)

    def score_changes(self, line: str, high: str, news: list[str]) -> np.ndarray:
        """Log-likelihood of ``line`` with its characters ``high`` become each of ``news``; -inf for more unknown characters."""
        out = np.full(len(news), -np.inf)
        chars = np.frombuffer("".join(news).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(news), len(high))
        chars = np.minimum(chars, _CODES - 1)
        fit = np.flatnonzero((self.c1[chars] == 0).sum(axis=1) <= (self.c1[np.minimum([ord(c) for c in high], _CODES - 1)] == 0).sum())
        x = self.codes([line])[0]
        place = {c: i for i, c in enumerate(high)}
        at = np.array([i + 2 for i, c in enumerate(line) if c in place], np.int64)
        which = np.array([place[c] for c in line if c in place], np.int64)
        step = max(1, BLOCK_CHARS // len(x))
        for i in range(0, len(fit), step):
            some = fit[i : i + step]
            block = np.tile(x, (len(some), 1))
            block[:, at] = chars[some][:, which]
            out[some] = self._sums(block.ravel(), np.arange(len(some)) * len(x))
        return out

    def oddest(self, texts: list[str]) -> np.ndarray:
        """The lowest log-probability in each text of a trigram that holds a character beyond ASCII; 0 if none does."""
        if not texts:
            return np.zeros(0)
        if len(texts) > 2000:
            return np.concatenate([self.oddest(texts[i : i + 2000]) for i in range(0, len(texts), 2000)])
        x, starts = self.codes(texts)
        high = x > 127
        logs = np.where(high[:-2] | high[1:-1] | high[2:], self._logs(x), 0.0)
        inside = np.ones(len(logs), bool)
        inside[starts[1:] - 2] = inside[starts[1:] - 1] = False
        return np.minimum.reduceat(np.where(inside, logs, 0.0), starts)

    def common(self) -> list[str]:
        """The FILLS most frequent characters."""
        top = np.argsort(-self.c1, kind="stable")[: FILLS + 2]
        return [chr(i) for i in top if self.c1[i] and i > 3][:FILLS]

    def known(self, text: str) -> int:
        """How many of the text's different characters beyond ASCII the model has not seen."""
        if self._seen is None:
            self._seen = {chr(i) for i in np.flatnonzero(self.c1) if not 0xD800 <= i < 0xE000} | {chr(i) for i in range(128)}
        return len(set(text) - self._seen)


def mixed(line: str, model: TrigramModel) -> list[str]:
    """Readings in which only some words were garbled: under each single-byte chain, every word takes the likelier form."""
    parts = re.split("( +)", line)
    odd = [i for i, p in enumerate(parts) if _NON_ASCII.search(p)]
    texts, plans = [parts[i] for i in odd], []
    seen: set[tuple] = set()
    for wrong, byte in _BYTES.items():
        raws = [bytes(byte.get(c, ord(c) & 127) for c in p) if all(c < "\x80" or c in byte for c in p) else None for p in texts[: len(odd)]]
        if not any(raws):
            continue
        for true in _BY_WRONG[wrong]:
            if true in _WIDE or (true, tuple(raws)) in seen or (true == "utf-8" and not _PAIR[wrong].search(line)):
                continue
            seen.add((true, tuple(raws)))
            held = [i for i, raw in enumerate(raws) if raw is not None]
            other = texts[: len(odd)]
            try:  # words hold no spaces
                for i, new in zip(held, decode(b" ".join(raws[i] for i in held), true).split(" ")):
                    other[i] = new
            except UnicodeDecodeError:
                for i in held:
                    try:
                        other[i] = decode(raws[i], true)
                    except UnicodeDecodeError:
                        other[i] = (_sequences(texts[i], raws[i]) if true == "utf-8" else None) or texts[i]
            if other != texts[: len(odd)] and tuple(other) not in seen:
                seen.add(tuple(other))
                plans.append((len(texts), other))
                texts += other
    s = model.score(texts)
    out = set()
    for at, other in plans:
        new = list(parts)
        for k, i in enumerate(odd):
            if s[at + k] > s[k]:
                new[i] = other[k]
        out.add("".join(new))
    return [t for t in out if t != line]


def _try(fresh: list[str], make: Callable[[str], list[str]], model: TrigramModel, tried: dict[str, tuple[str, float]], single: bool = True) -> None:
    """Note in ``tried`` each text's likeliest reading so far, of those without more unknown characters; scored in blocks
    of bounded size. ``single``: also under the chains of single-byte encodings."""
    texts: list[str] = []
    spans: list[tuple[str, int, int]] = []
    size = 0
    for n, t in enumerate(fresh):
        own = model.known(t)
        c = [x for x in make(t) if model.known(x) <= own]
        high = "".join(dict.fromkeys(_NON_ASCII.findall(t))) if single else ""
        if news := changes(high) if high else []:
            s = model.score_changes(t, high, news)
            if np.isfinite(s).any():
                c.append(t.translate(str.maketrans(high, news[int(np.argmax(s))])))
        spans.append((t, len(texts), len(texts) + 1 + len(c)))
        texts += [t, *c]
        size += (1 + len(c)) * len(t)
        if size > BLOCK_CHARS or n == len(fresh) - 1:
            s = model.score(texts)
            for src, a, b in spans:
                k = a + int(np.argmax(s[a:b]))
                if src not in tried or s[k] - s[a] > tried[src][1]:
                    tried[src] = (texts[k], float(s[k] - s[a]))
            texts, spans, size = [], [], 0


def lost_gain(texts: list[str], model: TrigramModel) -> np.ndarray:
    """By how much each text would be likelier if its replacement characters were what the model expects there.

    A replacement character stands for bytes that a decoder could not read: each run of them is a wildcard, for any of
    the model's common characters or none.
    """
    fills = ["", *model.common()]
    places: dict[tuple[str, str, str], int] = {}
    own: list[list[int]] = []
    for t in texts:
        here = [(t[max(0, m.start() - 2) : m.start()], m.group(), t[m.end() : m.end() + 2]) for m in _REPLACED.finditer(t)]
        own.append([places.setdefault(p, len(places)) for p in here])
    gains = np.zeros(len(places))
    step = max(1, BLOCK_CHARS // (8 * (len(fills) + 1)))
    every = list(places)
    for i in range(0, len(every), step):
        block = every[i : i + step]
        s = model.score([a + f + b for a, lost, b in block for f in (lost, *fills)]).reshape(len(block), -1)
        gains[i : i + step] = np.maximum(s[:, 1:].max(axis=1) - s[:, 0], 0)
    return np.array([gains[o].sum() for o in own])


def best(lines: list[str], model: TrigramModel, odd: float = 0.0, rounds: int = 2, enough: float = np.inf) -> tuple[list[str], np.ndarray]:
    """The likeliest reading of each line and by how much it is likelier than the line (its entities resolved).

    Lines whose oddest trigram is likelier than ``odd`` have nothing in them that another reading could explain
    better; they are not tried. A line that gains more than ``enough`` is not tried further. What a reading still has lost counts with what it may have been (``lost_gain``).
    """
    once = list(dict.fromkeys(lines))
    plain = [without_entities(ln) for ln in once]
    now, gain = list(plain), np.zeros(len(once))
    todo = [i for i, ln in enumerate(plain) if _NON_ASCII.search(ln)]
    if odd < 0 and todo:
        strange = model.oddest([plain[i] for i in todo]) < odd
        todo = [i for i, s in zip(todo, strange) if s]
    every = list(todo)
    tried: dict[str, tuple[str, float]] = {}
    for r in range(rounds):
        fresh = [t for t in dict.fromkeys(now[i] for i in todo) if t not in tried]
        _try(fresh, decoded, model, tried)
        if r == 0:
            left = model.oddest([tried[t][0] for t in fresh]) < min(odd, LAST_ODD)
            _try([t for t, x in zip(fresh, left) if (x or tried[t][1] < SURE) and tried[t][1] <= enough], lambda t: mixed(t, model), model, tried, single=False)
        again = []
        for i in todo:
            new, more = tried[now[i]]
            if more > 0:
                gain[i] += more
                now[i] = new
                again.append(i)
        left = model.oddest([now[i] for i in again]) < min(odd, LAST_ODD)
        todo = [i for i, x in zip(again, left) if x and gain[i] <= enough]  # garbled twice, perhaps
        if not todo:
            break
    lost = [i for i in every if "\ufffd" in now[i]]
    gain[lost] += lost_gain([now[i] for i in lost], model)
    at = {ln: i for i, ln in enumerate(once)}
    rows = [at[ln] for ln in lines]
    return [now[i] if gain[i] > 0 and now[i] != plain[i] else ln for i, ln in zip(rows, lines)], gain[rows]


def garble(lines: list[str], seed: int = 5) -> tuple[list[str], list[str], list[bool]]:
    """Lines garbled on purpose by the chains backwards, what they were, and whether the chain leads back to that.

    A line's chain depends on the line alone.
    """
    bad, good, back = [], [], []
    for ln in lines:
        step, at = divmod(zlib.crc32(ln.encode("utf-8", "surrogatepass"), seed), len(CHAINS))
        step = step % (len(CHAINS) - 1) + 1
        for k in range(12):
            wrong, true = CHAINS[(at + k * step) % len(CHAINS)]
            try:
                raw = encode(ln, true)
                g = decode(raw, wrong)
            except (UnicodeDecodeError, UnicodeEncodeError, LookupError):
                continue
            if g != ln and "�" not in g:
                bad.append(g)
                good.append(ln)
                try:
                    back.append(encode(g, wrong) == raw and decode(raw, true) == ln)
                except (UnicodeDecodeError, UnicodeEncodeError):
                    back.append(False)
                break
    return bad, good, back


def _fold(line: str) -> int:
    """Which of the FOLDS parts of all lines a line is in, by itself alone."""
    return zlib.crc32(line.encode("utf-8", "surrogatepass"), 11) % FOLDS


_AS_UTF8 = _WRONG_FOR_UTF8[:12]
#: What each pair that stands for the start of a UTF-8 sequence looks like, whatever the encoding.
_ANY_PAIR = re.compile("[{}][{}]".format(*(re.escape("".join({c for w in _AS_UTF8 for c, b in _BYTES[w].items() if a <= b < z})) for a, z in ((0xC2, 0xF5), (0x80, 0xC0)))))


#: Two characters that may start a UTF-8 sequence, in the encodings that readers fall back to; in others ordinary words
#: hold such pairs.
_DOUBT = re.compile("|".join(_PAIR[w].pattern for w in ("w1252", "latin-1")))


def doubtful(line: str) -> bool:
    """Whether a line holds what may be UTF-8 of something else, or its entities do."""
    line = without_entities(line)
    return not line.isascii() and _DOUBT.search(line) is not None


def plainly_garbled(line: str) -> bool:
    """Whether a line lost characters or its bytes are UTF-8 of something else."""
    if ("?" in line or "\ufffd" in line) and _LOST.search(line):
        return True
    for w in _AS_UTF8 if _ANY_PAIR.search(line) else ():
        try:
            if decode(encode(line, w), "utf-8") != line:
                return True
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
    return False


def counted(texts: list[str]) -> pd.DataFrame:
    """How often each n-gram occurs inside the texts: its kind ("1" to "3" characters), id and number."""
    if not texts:
        return pd.DataFrame({"kind": pd.Series(dtype=str), "id": pd.Series(dtype=np.int64), "n": pd.Series(dtype=np.int64)})
    x, starts = TrigramModel.codes(texts)
    i3, i2 = TrigramModel._ids(x)
    edge = starts[1:]
    parts = []
    for kind, ids in (("3", np.delete(i3, np.concatenate([edge - 2, edge - 1]))), ("2", np.delete(i2, edge - 1)), ("1", x)):
        u, n = np.unique(ids, return_counts=True)
        parts.append(pd.DataFrame({"kind": kind, "id": u, "n": n}))
    return pd.concat(parts)


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in blocks of about BLOCK_CHARS characters."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def unseen(counts: pd.DataFrame) -> list[TrigramModel]:
    """The model that judges each fold's lines, which is that of all other folds, from counts with their ``fold``."""
    return [TrigramModel.of(counts[counts["fold"] != k]) for k in range(FOLDS)]


def crossed(lines: list[str], models: list[TrigramModel], folds: list[int], odd: float, enough: float = np.inf) -> tuple[list[str], np.ndarray]:
    """``best`` for lines of the given folds, each by the model of the other folds."""
    read, gain = list(lines), np.zeros(len(lines))
    for k in range(FOLDS):
        idx = [i for i, f in enumerate(folds) if f == k]
        new, gain[idx] = best([lines[i] for i in idx], models[k], odd, enough=enough)
        for i, r in zip(idx, new):
            read[i] = r
    return read, gain


def stay(lines: list[str], models: list[TrigramModel]) -> np.ndarray:
    """Which lines no other reading explains better by more than FEW_MARGIN."""
    return crossed(lines, models, [_fold(ln) for ln in lines], FIRST_ODD, FEW_MARGIN)[1] <= FEW_MARGIN


def crossed_odd(lines: list[str], models: list[TrigramModel]) -> tuple[list[int], np.ndarray]:
    """Fold of each line and its oddness by the model of the other folds."""
    fold, odd = np.array([_fold(ln) for ln in lines], int), np.zeros(len(lines))
    for k in range(FOLDS):
        idx = np.flatnonzero(fold == k)
        odd[idx] = models[k].oddest([without_entities(lines[i]) for i in idx])
    return fold.tolist(), odd


def crossed_garbled(lines: list[str], models: list[TrigramModel]) -> tuple[list[str], list[str], list[int], np.ndarray, np.ndarray]:
    """The lines garbled, what they were, and of each the fold, the oddness, and what its gain is at least.

    What the line was is one of the readings that are tried, so the gain isn't less than that of this reading, unless
    no chain leads back to it or the model doesn't know its characters: then it is at least 0.
    """
    bad, was, back = garble(lines)
    fold = np.array([_fold(ln) for ln in was], int)
    odd, least = np.zeros(len(bad)), np.zeros(len(bad))
    for k in range(FOLDS):
        idx = np.flatnonzero(fold == k)
        here, before = [without_entities(bad[i]) for i in idx], [was[i] for i in idx]
        odd[idx] = models[k].oddest(here)
        same = np.array([back[i] and h == bad[i] and not models[k].known(w) for i, h, w in zip(idx, here, before)], bool)
        least[idx] = np.where(same, np.maximum(models[k].score(before) - models[k].score(here), 0.0), 0.0)
    return bad, was, fold.tolist(), odd, least


def odd_from(quantile: float | None) -> float:
    """From which oddness lines are tried, by the 99.9 % quantile of the oddness of garbled lines."""
    return FIRST_ODD if quantile is None else min(FIRST_ODD, max(LAST_ODD, quantile + 0.5))


def margin_from(floor: float, low: float, garbled: int) -> float:
    """Above what clean lines gain by chance, below what garbled lines gain."""
    return floor + MARGIN_AT * max(0.0, low - floor) if garbled >= VALIDATED else floor + FEW_MARGIN


def train(lines: list[str], rounds: int = 2) -> tuple[TrigramModel, float, float, dict]:
    """Model, margin, oddness from which lines are tried, and figures, from lines in memory with garbled ones among them.

    Lines with replacement characters and lines whose bytes are UTF-8 of something else are never clean. Doubtful lines
    are judged in the first round by models that have not seen one of them: as often as they come, they would look
    likely. After each round those that another reading explains better, by the model of the other folds, leave the clean lines too.
    """
    every = sorted({ln for ln in lines if ln.strip()})
    clean = [ln for ln in every if not plainly_garbled(ln)]
    both = lambda lines: pd.concat([counted([ln for ln in lines if _fold(ln) == k]).assign(fold=k) for k in range(FOLDS)])
    for r in range(rounds):
        models = unseen(both(clean if r else [ln for ln in clean if not doubtful(ln)]))
        clean = [ln for ln, s in zip(clean, stay(clean, models)) if s]
    models = unseen(both(clean))
    own = [ln for ln in clean if _NON_ASCII.search(ln)]
    bad, was, fold, strange, _ = crossed_garbled(own, models)
    odd = odd_from(float(np.quantile(strange, 0.999)) if bad else None)
    good_gain = crossed(own, models, [_fold(ln) for ln in own], odd)[1]
    read, bad_gain = crossed(bad, models, fold, odd)
    floor = float(np.quantile(good_gain, 0.999)) if own else 0.0
    low = float(np.quantile(bad_gain, 0.01)) if bad else 0.0
    margin = margin_from(floor, low, len(bad))
    info = {
        "clean": len(clean), "lines": len(every), "margin": margin, "odd": odd, "floor": floor, "low": low,
        "found": float((bad_gain > margin).mean()) if bad else 1.0, "restored": float(np.mean([a == b for a, b in zip(read, was)])) if bad else 1.0,
    }
    return TrigramModel.of(both(clean)), margin, odd, info


def at_rank(df: DataFrame, col: str, rank: int, held: int = HELD_VALUES) -> tuple[float, float]:
    """The values of ``col`` at ``rank`` (0: the smallest) and the next rank, or the last rank if there is none beyond.

    Exact: counts in a thousand equal steps tell between which values the rank lies, until ``held`` or fewer are left.
    """
    df = df.select(F.col(col).alias("v"))
    n, low, high = df.agg(F.count("*"), F.min("v"), F.max("v")).first()
    while n > held and low < high:
        inside = df.where(F.col("v").between(low, high))
        step = F.least(F.lit(999), F.floor((F.col("v") - low) / ((high - low) / 1000)))
        steps = inside.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("s").toPandas()
        upto = steps["n"].cumsum().to_numpy()
        k = int(np.searchsorted(upto, rank, side="right"))
        if rank + 1 == upto[k]:  # the last of its step: the next one is the first of the step that follows
            return float(steps["b"][k]), float(steps["a"][min(k + 1, len(steps) - 1)] if k + 1 < len(steps) else steps["b"][k])
        rank, n, low, high = rank - int(upto[k] - steps["n"][k]), int(steps["n"][k]), float(steps["a"][k]), float(steps["b"][k])
    if low == high:
        return float(low), float(low)
    v = np.sort(df.where(F.col("v").between(low, high)).toPandas()["v"].to_numpy())
    return float(v[rank]), float(v[min(rank + 1, len(v) - 1)])


def quantile(df: DataFrame, col: str, q: float, n: int, held: int = HELD_VALUES) -> float:
    """The exact quantile of all ``n`` values, as numpy has it; of a ``df`` that lacks large ones too, if it holds the ranks needed."""
    at = q * (n - 1)
    a, b = at_rank(df, col, int(at), held)
    return a + (at - int(at)) * (b - a)


Judge = tuple[TrigramModel, float, float]
_COUNTS = pa.schema([("fold", pa.int64()), ("script", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64())])


def learn(df: DataFrame, col: str = "line", rounds: int = 2) -> Judge:
    """Model, margin and oddness, trained as by ``train`` on all lines of a table.

    Each script's counts are weighed, so that all weigh as much as MASS_LINES lines, half of it dealt out evenly over
    scripts: else the n-grams of garbled lines, of which a larger table has more, would become likely ones, and a rare
    script's unlikely. The driver holds the counts of n-grams and no lines. The result does not depend on partitions or
    row order.
    """
    share = df.sparkSession.sparkContext.broadcast
    keys = ["fold", "script", "kind", "id"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column(0).to_pylist()
            clean = b.filter(pa.array([ln.strip() != "" and not plainly_garbled(ln) for ln in lines], pa.bool_()))
            lines = clean.column(0).to_pylist()
            hard = [not ln.isascii() or "&#" in ln for ln in lines]
            doubt = [h and doubtful(ln) for h, ln in zip(hard, lines)]
            yield pa.RecordBatch.from_arrays([*clean.columns, pa.array(hard, pa.bool_()), pa.array(doubt, pa.bool_())], ["line", "script", "hard", "doubt"])

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple[int, str], list[str]] = {}
            for ln, script in zip(*(c.to_pylist() for c in b.columns)):
                groups.setdefault((_fold(ln), script), []).append(ln)
            for (k, script), lines in groups.items():
                for block in blocks(lines):
                    yield pa.RecordBatch.from_pandas(counted(block).assign(fold=k, script=script), _COUNTS, preserve_index=False)

    def both(d: DataFrame) -> pd.DataFrame:
        sums = d.select("line", "script").mapInArrow(ngrams, "fold long, script string, kind string, id long, n long").groupBy(*keys).agg(F.sum("n").alias("n"))
        return sums.toPandas().sort_values(keys)

    def weighed(counts: pd.DataFrame) -> pd.DataFrame:
        return counts.assign(n=counts["n"] * counts["script"].map(weight).astype(float))

    distinct = df.select(F.col(col).alias("line")).where(F.col(col).isNotNull()).distinct().withColumn("script", stratum("line", r"[^\x00-\x7F\P{L}]"))
    clean = settle(distinct.mapInArrow(start, "line string, script string, hard boolean, doubt boolean"), "p1-lines", ["hard"])
    sizes = clean.groupBy("script").agg(F.count("*").alias("n"), F.sum(F.length("line").cast("long")).alias("c")).collect()
    weight = shares({r.script: (r.n, r.c) for r in sizes}, MASS_LINES, MASS_CHARS)
    sure, old = both(clean.where("not doubt")), clean
    counts = pd.concat([sure, both(clean.where("doubt"))]).groupby(keys, as_index=False)["n"].sum()
    clean = clean.where("hard").select("line", "script")  # no other line has another reading
    for r in range(rounds):
        models = share(unseen(weighed(counts if r else sure)))

        def judge(batches: Iterator[pa.RecordBatch], models=models) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stay(b.column(0).to_pylist(), models.value))], ["line", "script", "stays"])

        new = settle(clean.mapInArrow(judge, "line string, script string, stays boolean"), "p1-clean", ["stays"])
        discard(old)
        gone = both(new.where("not stays"))
        counts = pd.concat([counts, gone.assign(n=-gone["n"])]).groupby(keys, as_index=False)["n"].sum()
        clean, old = new.where("stays").select("line", "script"), new
        models.unpersist()
    models = share(unseen(weighed(counts)))

    def validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [ln for ln in b.column(0).to_pylist() if _NON_ASCII.search(ln)]
            bad, _, fold, strange, least = crossed_garbled(own, models.value)
            for kind, *columns in (("good", own, *crossed_odd(own, models.value), np.zeros(len(own))), ("bad", bad, fold, strange, least)):
                arrays = [pa.array([kind] * len(columns[0]), pa.string()), *map(pa.array, columns, (pa.string(), pa.int32(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["kind", "line", "fold", "odd", "least"])

    seen = settle(clean.mapInArrow(validate, "kind string, line string, fold int, odd double, least double"), "p1-seen", ["kind"])
    discard(old)
    good, bad = seen.where("kind = 'good'"), seen.where("kind = 'bad'")
    n = {r.kind: r["count"] for r in seen.groupBy("kind").count().collect()}
    odd = odd_from(quantile(bad, "odd", 0.999, n["bad"]) if n.get("bad") else None)

    def regain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(crossed(b.column(0).to_pylist(), models.value, b.column(1).to_pylist(), odd)[1])], ["gain"])

    def gains(d: DataFrame) -> DataFrame:
        """What each row gains: 0 if it is not tried."""
        tried = d.where(F.col("odd") < odd).select("line", "fold").mapInArrow(regain, "gain double")
        return settle(d.where(F.col("odd") >= odd).select(F.lit(0.0).alias("gain")).unionAll(tried), "p1-gains")

    floor = 0.0
    if n.get("good"):
        gained = gains(good)
        floor = quantile(gained, "gain", 0.999, n["good"])
        discard(gained)
    low, size = 0.0, n.get("bad", 0)
    if size >= VALIDATED:
        # only what may gain least is tried: who gains at least more than the quantile can't change it
        bad = bad.withColumn("least", F.when(F.col("odd") < odd, F.col("least")).otherwise(0.0))
        first = int(0.01 * (size - 1))
        rank = 2 * first + 20
        while True:
            ceiling = at_rank(bad, "least", rank)[0] if rank < size else float("inf")
            gained = gains(bad.where(F.col("least") <= ceiling))
            if rank >= size or gained.where(F.col("gain") <= ceiling).count() >= first + 2:
                break
            discard(gained)
            rank *= 2
        low = quantile(gained, "gain", 0.01, size)
        discard(gained)
    discard(seen)
    models.unpersist()
    return TrigramModel.of(weighed(counts)), margin_from(floor, low, size), odd


def save(spark: SparkSession, judge: Judge, path: str) -> None:
    """The trained model as one small table in a shared folder."""
    model, margin, odd = judge
    parts = [("3", model.ids3, model.n3), ("2", model.ids2, model.n2), ("1", np.flatnonzero(model.c1), model.c1[model.c1 > 0]), ("margin", [0], [margin]), ("odd", [0], [odd])]
    rows = pd.concat([pd.DataFrame({"kind": k, "id": np.asarray(i, np.int64), "n": np.asarray(n, np.float64)}) for k, i, n in parts])
    spark.createDataFrame(rows, "kind string, id long, n double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Judge:
    rows = spark.read.parquet(path).toPandas()  # the different n-grams
    value = lambda k: float(rows.loc[rows["kind"] == k, "n"].iloc[0])
    return TrigramModel.of(rows), value("margin"), value("odd")


def repaired(df: DataFrame, col: str = "line", judge: Judge | None = None) -> DataFrame:
    """``df`` with ``garbled boolean``, ``restored string`` (null where nothing was restored) and ``gain double``: by how
    much, in nats, the likeliest reading is likelier than the line.

    Null, empty and pure ASCII lines are not garbled, unless numeric entities stand for garbled characters: a letter
    that was replaced by a question mark can't be told from one that stands there rightly. Lines with replacement
    characters are judged like all others, each lost character as a wildcard, and never count as restored. Without a
    ``judge`` one is trained on ``df``.
    """
    model, margin, odd = learn(df, col) if judge is None else judge
    held = df.sparkSession.sparkContext.broadcast((model, margin, odd))

    @F.arrow_udf("struct<garbled:boolean,restored:string,gain:double>")
    def repair(s: pa.Array) -> pa.Array:
        m, least, strange = held.value
        read, gain = best([x if x is not None else "" for x in s.to_pylist()], m, strange)
        good = gain > least
        kept = [r if g and "\ufffd" not in r else None for g, r in zip(good, read)]
        return pa.StructArray.from_arrays([pa.array(good), pa.array(kept, pa.string()), pa.array(gain)], ["garbled", "restored", "gain"])

    hard = F.col(col).rlike("[^\\x00-\\x7F]|&#")  # nothing else can change
    part = df.withColumn("_r", F.when(hard, repair.asNondeterministic()(F.when(hard, F.col(col)))))
    return part.select(*df.columns, F.coalesce("_r.garbled", F.lit(False)).alias("garbled"), F.col("_r.restored").alias("restored"), F.coalesce("_r.gain", F.lit(0.0)).alias("gain"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "crawl_lines").select("line_id", "line")).where("garbled").select("line_id")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled line with what it was, null where that is lost."""
    return repaired(table(spark, sf_dir, "crawl_lines").select("line_id", "line")).where("garbled").select("line_id", "line", "restored")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
ORACLES: dict = {}
