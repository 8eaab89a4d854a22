"""Problem 6: token ids of every document by a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. Each distinct word is merged once per worker: its parts'
boundaries and the ranks of neighbouring pairs stand in two short lists; the lowest rank is found by a scan, the
boundary between its parts is deleted and the two ranks beside it are looked up again. Words longer than SHORT_WORD
bytes use a heap over linked parts, so that a very long unbroken text takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import table

#: Folder of the vocabulary files; the environment variable lets a cluster keep them elsewhere.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Longest word, in bytes, that is merged by scanning.
SHORT_WORD = 96
#: Distinct words a worker remembers; beyond it the memory starts anew, which changes no result.
REMEMBERED = 300_000
#: Fixed value: the pattern by which this vocabulary's texts are cut into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (ln.split() for ln in content.splitlines() if ln.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by repeated scans for the lowest rank; the leftmost of equal ranks goes first."""
    big = 1 << 60
    at = list(range(len(word) + 1))
    get = ranks.get
    pair = [get(word[i : i + 2], big) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == big:
            break
        i = pair.index(low)
        del at[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(word[at[i] : at[i + 2]], big)
        if i:
            pair[i - 1] = get(word[at[i - 1] : at[i + 1]], big)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as ``merge_short``, for long words."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i:
            j = before[i]
            if (r := ranks.get(word[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of texts by one vocabulary. Strings that look like special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.words, self.known = ranks, regex.compile(pattern).findall, {}

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        if (whole := self.ranks.get(raw)) is not None:
            ids = [whole]
        else:
            ids = merge_short(raw, self.ranks) if len(raw) <= SHORT_WORD else merge_long(raw, self.ranks)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(raw) <= SHORT_WORD:
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, extend = self.known, out.extend
            for w in self.words(text):
                ids = known.get(w)
                extend(self.word(w) if ids is None else ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def token_ids(col: str, path: str | None = None):
    """Column of token ids; null and empty texts have the empty list.

    The vocabulary is read by the driver, which fails at once if it is missing or broken, and goes once to every worker.
    """
    with open(path or f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        content = f.read()
    if len(parse_ranks(content)) < 256:
        raise ValueError("a byte-level vocabulary has an entry for every byte")
    name = hashlib.sha256(content).hexdigest()
    held = SparkSession.builder.getOrCreate().sparkContext.broadcast(content)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        if name not in _ENCODERS:  # one encoder in each worker process
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(parse_ranks(held.value))
        enc = _ENCODERS[name]
        offsets, flat = [0], []
        for t in texts:
            flat += enc.encode(t.as_py())
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return ids(F.col(col))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids("text").alias("ids"))


QUERIES = {"p6_ids": p6_ids}
ORACLES: dict = {}
