"""Problem 7: passages of evaluation items inside training documents.

Items and documents are sequences of words (runs of letters and digits, lower case). Each window of WINDOW words is
hashed under fixed masks that leave out some positions, so that a window with a word exchanged still meets its
counterpart under the mask that ignores it. Hashes of items and documents are joined, and around every hit the two
word sequences are compared along their common offset, which gives the overlap with up to a number of substitutions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import BROADCAST_ROWS, settle, table

WINDOW = 12
#: Items whose texts are larger together are not broadcast for the comparison, however few they are.
BROADCAST_BYTES = 64 << 20
#: Positions that count under each mask. Together they leave out every position at least once but the first and last, where an overlap can't have a substitution.
MASKS = ((0, 2, 3, 5, 6, 8, 9, 10, 11), (0, 1, 3, 4, 5, 7, 8, 9, 11), (0, 1, 2, 4, 5, 6, 7, 8, 10, 11), (0, 1, 2, 3, 4, 6, 7, 9, 10, 11))

_WORD = re.compile(r"[^\W_]+")
_HITS = "array<struct<seed:bigint,at:int>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@lru_cache(maxsize=400_000)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def _factors() -> np.ndarray:
    """One odd 64-bit factor for each mask and position, the same everywhere."""
    return np.array([[xxhash.xxh3_64_intdigest(f"{m}/{k}") | 1 for k in range(WINDOW)] for m in range(len(MASKS))], dtype=np.uint64)


def seeds_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, position, seed)`` of every window of every text under every mask."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter((_hash(w) for ws in words for w in ws), dtype=np.uint64, count=int(sizes.sum()))
    total = max(0, len(h) - WINDOW + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = owner[:total] == owner[WINDOW - 1 : WINDOW - 1 + total]
    at = (np.arange(total) - first[:total])[inside]
    own = owner[:total][inside]
    factors, out = _factors(), []
    for m, mask in enumerate(MASKS):
        s = np.zeros(total, dtype=np.uint64)
        for k in mask:
            s += h[k : k + total] * factors[m, k]
        s ^= s >> np.uint64(29)
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
        out.append(s[inside].view(np.int64))
    n = len(MASKS)
    return np.tile(own, n), np.tile(at, n), np.concatenate(out) if out else np.zeros(0, np.int64)


def seeded(df: DataFrame, id_col: str, keep: np.ndarray | None = None) -> DataFrame:
    """``(id, text, hits)`` for each text of ``df(id, text)`` with windows; with ``keep`` (sorted), only hits on those seeds."""
    held = None if keep is None else df.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if held is None else held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            own, at, seed = seeds_of(texts)
            if wanted is not None:
                i = np.searchsorted(wanted, seed)
                hit = wanted[np.minimum(i, len(wanted) - 1)] == seed if len(wanted) else np.zeros(len(seed), bool)
                own, at, seed = own[hit], at[hit], seed[hit]
            order = np.argsort(own, kind="stable")
            own, at, seed = own[order], at[order], seed[order]
            rows, counts = np.unique(own, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            hits = pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays([pa.array(seed, pa.int64()), pa.array(at.astype(np.int32), pa.int32())], ["seed", "at"])
            )
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), hits], ["id", "text", "hits"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string")).mapInArrow(run, f"id long, text string, hits {_HITS}")


def _overlap(a: list[str], b: list[str], i: int, j: int, most: int) -> tuple[int, int, int]:
    """Around a hit of ``a[i:]`` on ``b[j:]``: words of the longest overlap along this offset with at most ``most``
    substitutions, its substitutions, and the longest run without any."""
    lo = -min(i, j)
    hi = min(len(a) - i, len(b) - j)
    best_exact = run = 0
    best, subs = 0, 0
    miss: list[int] = []
    start = lo
    for k in range(lo, hi):
        if a[i + k] == b[j + k]:
            run += 1
            best_exact = max(best_exact, run)
        else:
            run = 0
            miss.append(k)
            if len(miss) > most:
                start = miss.pop(0) + 1
        left, right = start, k
        used = [m for m in miss if left <= m <= right]
        while used and used[0] == left:
            left += 1
            used.pop(0)
        while used and used[-1] == right:
            right -= 1
            used.pop()
        if right - left + 1 > best:
            best, subs = right - left + 1, len(used)
    return best, subs, best_exact


def overlaps(docs: DataFrame, items: DataFrame, most_subs: int = 1) -> DataFrame:
    """``(doc_id, item_id, words, substitutions, exact_words)`` for each document and item that share an overlap.

    ``docs(doc_id, text)``, ``items(item_id, text)``. One row per pair: its longest overlap. Null texts and texts
    shorter than a window have none. Item seeds go to the workers only while they are at most BROADCAST_ROWS rows, and
    item texts only while they are at most so many and BROADCAST_BYTES large; beyond that both sides are shuffled.
    """
    item_seeds = settle(seeded(items, "item_id").select(F.col("id").alias("item_id"), F.explode("hits").alias("h")).select("item_id", "h.seed", F.col("h.at").alias("item_at")), "item-seeds")
    few = item_seeds.count() <= BROADCAST_ROWS
    if few:  # bounded: the documents are searched where they are read, and only those with a hit go on
        keep = np.sort(np.array([r.seed for r in item_seeds.select("seed").distinct().toLocalIterator()], dtype=np.int64))
        near = settle(seeded(docs, "doc_id", keep), "near-documents")
        texts = near.select(F.col("id").alias("doc_id"), F.col("text").alias("doc_text"))
        hits = near.select(F.col("id").alias("doc_id"), F.explode("hits").alias("h"))
    else:
        texts = docs.select("doc_id", F.col("text").alias("doc_text"))
        hits = seeded(docs, "doc_id").select(F.col("id").alias("doc_id"), F.explode("hits").alias("h"))
    hits = hits.select("doc_id", "h.seed", "h.at")
    pairs = (
        hits.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
        .withColumn("offset", F.col("at") - F.col("item_at"))
        .groupBy("doc_id", "item_id", "offset")
        .agg(F.min(F.struct("at", "item_at")).alias("hit"))
        .groupBy("doc_id", "item_id")
        .agg(F.collect_list(F.struct("hit.at", "hit.item_at")).alias("hits"))
    )
    item_texts = items.select("item_id", F.col("text").alias("item_text"))
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    small = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    found = pairs.join(texts, "doc_id").join(F.broadcast(item_texts) if small else item_texts, "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, it, hs, dt, itxt in zip(b.doc_id, b.item_id, b.hits, b.doc_text, b.item_text):
                dw, iw = words_of(dt), words_of(itxt)
                got = [_overlap(dw, iw, h["at"], h["item_at"], most_subs) for h in hs]
                n, s, _ = max(got)
                rows.append((d, it, n, s, max(g[2] for g in got)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "substitutions", "exact_words"])

    out = found.select("doc_id", "item_id", "hits", "doc_text", "item_text").mapInPandas(
        verify, "doc_id long, item_id long, words int, substitutions int, exact_words int"
    )
    return out.where(F.col("words") >= WINDOW)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "test_items").select("item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least twelve successive words of an item, unchanged."""
    return overlaps(*_inputs(spark, sf_dir)).where(F.col("exact_words") >= WINDOW).select("doc_id", "item_id")


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of twelve words or more with at most one word exchanged."""
    return overlaps(*_inputs(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_overlaps": p7_overlaps}
ORACLES = {
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items),
dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
