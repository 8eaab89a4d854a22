"""64-bit Murmur hashes of lines, vectorised over Arrow batches, and order-independent corpus hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.text import files_of, open_stream

# Multiplier and shift of the 64-bit Murmur2 variant.
_M, _R = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)


def murmur64(items: list[bytes], seeds: np.ndarray | int = 0) -> np.ndarray:
    """Unsigned 64-bit hash of each byte string, eight bytes of all strings at a time."""
    n = len(items)
    size = np.array([len(x) for x in items], dtype=np.uint64)
    blocks = (size >> np.uint64(3)).astype(np.int64)
    start = np.zeros(n, dtype=np.int64)
    padded = b"".join(x + b"\0" * (-len(x) % 8) for x in items)
    words = np.frombuffer(padded, dtype="<u8") if padded else np.zeros(0, np.uint64)
    total = blocks + (size % np.uint64(8) > 0)
    start[1:] = np.cumsum(total)[:-1]
    h = np.broadcast_to(np.asarray(seeds, dtype=np.uint64), (n,)) ^ (size * _M)
    for i in range(int(blocks.max()) if n else 0):
        on = np.flatnonzero(blocks > i)
        k = words[start[on] + i] * _M
        k ^= k >> _R
        h[on] = (h[on] ^ (k * _M)) * _M
    tail = np.flatnonzero(size % np.uint64(8) > 0)
    h[tail] = (h[tail] ^ words[start[tail] + blocks[tail]]) * _M
    h ^= h >> _R
    h *= _M
    return h ^ (h >> _R)


def murmur64_column(c: Column, seed: int = 0) -> Column:
    """Hash of a line as a signed long; null for null."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        h = murmur64([b"" if x is None else x.encode("utf-8") for x in s], seed).view(np.int64)
        return pd.Series(h).astype("Int64").mask(s.isna())

    return run(c)


def chained_murmur64(ranges: Column, seed: int = 0) -> Column:
    """Hash of an array of strings: each element's hash seeds the next."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        rows = [list(x) if x is not None else [] for x in s]
        h = np.full(len(rows), seed, dtype=np.uint64)
        for k in range(max(map(len, rows), default=0)):  # the k-th element of all rows at once
            on = np.array([i for i, r in enumerate(rows) if len(r) > k], dtype=np.int64)
            h[on] = murmur64([rows[i][k].encode("utf-8") for i in on], h[on])
        return pd.Series(h.view(np.int64)).astype("Int64").mask(s.isna().to_numpy())

    return run(ranges)


def corpus_hash(df: DataFrame, line: str = "line") -> DataFrame:
    """``(hash)``: the sum of all lines' hashes modulo 2^64, the same for any order. Null lines are left out."""
    h = murmur64_column(F.col(line))
    unsigned = F.when(F.col("_h") < 0, F.col("_h").cast("decimal(38,0)") + F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(F.col("_h").cast("decimal(38,0)"))
    total = F.pmod(F.coalesce(F.sum(unsigned), F.lit(0).cast("decimal(38,0)")), F.lit("18446744073709551616").cast("decimal(38,0)"))
    return df.select(h.alias("_h")).where("_h is not null").agg(total.cast("decimal(20,0)").alias("hash"))


def stream_hash(f: BinaryIO, block: int = 1 << 20, seed: int = 0) -> int:
    """Hash of a whole stream, its blocks chained; depends on the order and the block size."""
    h = seed
    while data := f.read(block):
        h = int(murmur64([data], h)[0])
    return h


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, hash)``: the stream hash of each file's bytes in hexadecimal, a block in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = []
            for p in b.path:
                with open_stream(p, plain=False) as f:
                    hashes.append(f"{stream_hash(f):x}")
            yield pd.DataFrame({"path": b.path, "hash": hashes})

    return files_of(spark, path).mapInPandas(run, "path string, hash string")
