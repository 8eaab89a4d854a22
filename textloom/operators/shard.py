"""Hash shards of keyed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import chained_murmur64
from textloom.operators.fields import range_key

#: Fixed value: the seed of the shard hash.
SHARD_SEED = 47849374332489


def shard_number(line: Column, n: int, spec: str = "1-", delim: str = "\t", exact: bool = False) -> Column:
    """Shard 0..n-1 of a line by its key. The built-in hash by default; ``exact`` takes 64-bit Murmur with its seed."""
    key = range_key(line, spec, delim)
    if exact:
        h = chained_murmur64(key, SHARD_SEED)
        # the hash is unsigned: the remainder of its signed form moves by 2^64 mod n
        return F.when(h >= 0, F.pmod(h, F.lit(n))).otherwise(F.pmod(F.pmod(h, F.lit(n)) + F.lit((1 << 64) % n), F.lit(n))).cast("int")
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def shard_names(prefix: str, n: int) -> list[str]:
    """Prefix and zero-padded index, as wide as the last index."""
    return [f"{prefix}{i:0{len(str(n - 1))}d}" for i in range(n)]


def write_shards(df: DataFrame, path: str, n: int, line: str = "line", order: list[str] | None = None, spec: str = "1-", delim: str = "\t", compression: str = "none") -> None:
    """Text files below ``path/shard=<i>``, in the order of their names and with lines in order inside each; a large shard
    is several files, so that no task holds it all."""
    out = df.withColumn("shard", shard_number(F.col(line), n, spec, delim))
    out.repartitionByRange("shard", *(order or ["pos"])).sortWithinPartitions("shard", *(order or ["pos"])).select("shard", line).write.partitionBy("shard").option("compression", compression).mode("overwrite").text(path)
