"""Problem 2: records that are the same but for their formatting.

A record's canonical key is the sorted collection of its fields plus the sorted collection of its key entries,
each reduced to lower-case words. ``CopyLedger`` keeps, per canonical key, the number of copies and the earliest
record, in hash buckets on shared storage. A batch is aggregated first (so a key that holds a third of all rows
reaches the shuffle as one row per task), then full-outer-joined with the buckets its keys fall into, and only those
buckets are written again. A batch that was added is known by its name and not added twice.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import scratch_dir, settle, table

#: Share of all rows from which a key counts as hot. There are at most 1 / HOT_SHARE such keys, so they may be broadcast.
HOT_SHARE = 0.001
#: Records for which a new ledger has one bucket; a bucket is written by one task.
BUCKET_ROWS = 2_000_000
#: What counts as white space or punctuation: all but letters, digits, marks and symbols, and of ASCII's signs all. Other
#: symbols, as currencies, tell records apart.
_APART = r"[^\p{L}\p{N}\p{M}\p{S}%s]+|[$+<=>^`|~]+"


def fold_case(c: Column) -> Column:
    """Lower case in which sharp s and final sigma are like their upper case. (Catalyst drops an inner ``upper``.)"""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def canonical_text(c: Column) -> Column:
    """Words of ``c`` without their case, one space between them."""
    return F.btrim(F.regexp_replace(F.regexp_replace(fold_case(c), _APART % "", " "), " +", " "))


def record_key(line: str = "line", delim: str = "delim", key: str = "key") -> Column:
    """128-bit canonical key of a delimited record; null for a line that is null or holds no letter or digit.

    Fields count as an unordered collection with repeats. A null or empty delimiter makes the line one field.
    A null key differs from an empty one; a null entry of a key differs from an empty entry.
    """
    sep = "\u001f"
    fields = F.when(
        F.coalesce(F.col(delim), F.lit("")) == "", F.translate(F.col(line), sep, " ")
    ).otherwise(F.expr(f"replace(translate(`{line}`, '{sep}', ' '), `{delim}`, '{sep}')"))
    flat = F.regexp_replace(fold_case(fields), _APART % sep, " ")
    flat = F.regexp_replace(F.regexp_replace(flat, " +", " "), f" ?{sep} ?", sep)
    line_part = F.array_join(F.array_sort(F.split(F.btrim(flat), sep, -1)), sep)
    entries = F.array_sort(F.transform(F.col(key), lambda x: F.coalesce(canonical_text(x), F.lit("\u001e"))))
    key_part = F.coalesce(F.concat(F.size(F.col(key)).cast("string"), F.lit(sep), F.array_join(entries, sep)), F.lit("\u0000"))
    whole = F.concat(line_part, F.lit("\u001d"), key_part)
    return F.when(F.col(line).rlike(r"[\p{L}\p{N}]"), F.unhex(F.md5(whole.cast("binary"))))


class CopyLedger:
    """Bucketed counts of canonical keys that grow batch by batch.

    Each update writes the buckets its keys fall into below ``<path>/step=<n>,<batch>/bucket=<b>``; the newest step of a
    bucket is its state. An update that failed half-way leaves a step without ``_SUCCESS``, which is ignored and
    overwritten. Buckets follow the hash by which Spark shuffles a join on the key, so that with a multiple of
    ``spark.sql.shuffle.partitions`` buckets the joined rows are written where they are, one file a bucket.
    """

    SCHEMA = "key binary, n long, first_id long"

    def __init__(self, spark: SparkSession, path: str | None = None, n_buckets: int | None = None, rows: int = 0):
        self.spark, self.path = spark, path or scratch_dir(spark, "ledger")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.n_buckets = n_buckets or tasks * max(1, math.ceil(rows / (BUCKET_ROWS * tasks)))

    def _listing(self) -> tuple[dict[int, tuple[int, str]], dict[str, int], list[str]]:
        """Newest step and folder of each bucket, the step of each finished batch, and folders that newer ones replace."""
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hpath(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest: dict[int, tuple[int, str]] = {}
        batches: dict[str, int] = {}
        old: list[str] = []
        for step in fs.listStatus(hpath(self.path)) if fs.exists(hpath(self.path)) else []:
            m = re.fullmatch(r"step=(\d+),(.*)", step.getPath().getName())
            if not m or not fs.exists(hpath(step.getPath(), "_SUCCESS")):
                continue
            no = int(m[1])
            batches[m[2]] = no
            for part in fs.listStatus(step.getPath()):
                leaf = part.getPath().getName()
                if leaf.startswith("bucket="):
                    b, at = int(leaf[7:]), part.getPath().toString()
                    if b in newest:
                        old.append(min(newest[b], (no, at))[1])
                        newest[b] = max(newest[b], (no, at))
                    else:
                        newest[b] = (no, at)
        return newest, batches, old

    def bucket(self) -> Column:
        return F.pmod(F.hash("key"), F.lit(self.n_buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """``(key, n, first_id)``: the state, of all or of some buckets; good until the next ``vacuum``."""
        paths = [at for b, (_, at) in sorted(self._listing()[0].items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*paths)

    def update(self, batch: DataFrame, name: str | None = None) -> bool:
        """Add ``batch(key binary, rec_id long)``; rows with a null key are left out. False, and nothing is done, if a
        batch of this ``name`` (letters, digits, ``_`` and ``-``) was added before."""
        _, batches, _ = self._listing()
        step = max(batches.values(), default=-1) + 1
        name = name if name is not None else f"batch-{step}"
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"bad name of a batch: {name!r}")
        if name in batches:
            return False
        fresh = settle(batch.where("key is not null").groupBy("key").agg(F.count("*").alias("m"), F.min("rec_id").alias("id2")), "batch")
        touched = {r.b for r in fresh.select(self.bucket().alias("b")).distinct().collect()}  # at most n_buckets
        joined = self.read(touched).join(fresh, "key", "full_outer").select(
            "key", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.least("first_id", "id2").alias("first_id"), self.bucket().alias("bucket")
        )
        joined.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/step={step},{name}")
        return True

    def vacuum(self) -> int:
        """Remove buckets that newer ones replace; their steps stay as the record of what was added."""
        old = self._listing()[2]
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path
        for at in old:
            hpath(at).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath(at), True)
        return len(old)


def keyed(df: DataFrame, id_col: str = "rec_id") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("rec_id"), record_key().alias("key"), "loaded_at")


def build_ledger(recs: DataFrame, batches: int = 3, n_buckets: int | None = None) -> CopyLedger:
    """Feed ``recs(rec_id, key, loaded_at)``, best a written table, to a new ledger in ``batches`` spans of loading time
    (null times first)."""
    lo, hi, rows = recs.select(F.min("loaded_at").cast("double"), F.max("loaded_at").cast("double"), F.count("key")).first()
    ledger = CopyLedger(recs.sparkSession, n_buckets=n_buckets, rows=rows)
    at = F.coalesce(F.col("loaded_at").cast("double"), F.lit(lo if lo is not None else 0.0))
    cuts = [lo + (hi - lo) * k / batches for k in range(1, batches)] if lo is not None and hi > lo else []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = recs if low is None else recs.where(at >= low)
        ledger.update(part if high is None else part.where(at < high), f"span-{k}")
        ledger.vacuum()
    return ledger


def copies_found(df: DataFrame, batches: int = 3, n_buckets: int | None = None) -> DataFrame:
    """``(first_id, rec_id)``: one row for every record that is a copy of an earlier one.

    Ties of equal ``rec_id`` are one record. The records are read and keyed once. Hot keys (above HOT_SHARE of all rows,
    so at most 1 / HOT_SHARE of them) are looked up by broadcast; all others by a shuffled join on the key.
    """
    recs = settle(keyed(df), "keyed-records")
    ledger = build_ledger(recs, batches, n_buckets).read().where("n > 1")
    total = ledger.agg(F.sum("n")).first()[0] or 0
    hot_n = max(1000, int(total * HOT_SHARE))
    some = recs.where("key is not null").select("rec_id", "key")
    hot = ledger.where(F.col("n") > hot_n).select("key", F.col("first_id").alias("hot_id"))
    rest = ledger.where(F.col("n") <= hot_n).select("key", "first_id")
    marked = some.join(F.broadcast(hot), "key", "left")
    from_hot = marked.where("hot_id is not null").select(F.col("hot_id").alias("first_id"), "rec_id")
    from_rest = marked.where("hot_id is null").select("rec_id", "key").join(rest, "key").select("first_id", "rec_id")
    return from_hot.unionByName(from_rest).where("first_id <> rec_id")


def collapsed(df: DataFrame, batches: int = 3, n_buckets: int | None = None) -> DataFrame:
    """One row per group of copies: ``(first_id, n_copies)`` from the ledger, without a second pass over the records."""
    return build_ledger(settle(keyed(df), "keyed-records"), batches, n_buckets).read().select("first_id", F.col("n").alias("n_copies"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_found(table(spark, sf_dir, "keyed_lines"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "keyed_lines"))


_SQL_KEYS = r"""
WITH c AS (
  SELECT rec_id,
    list_sort(list_transform(string_split(line, delim), lambda x: trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '([^\p{L}\p{N}\p{M}\p{S}]|[$+<=>^`|~])+', ' ', 'g')))) AS fs,
    list_sort(list_transform(key, lambda x: trim(regexp_replace(replace(lower(x), 'ß', 'ss'), '([^\p{L}\p{N}\p{M}\p{S}]|[$+<=>^`|~])+', ' ', 'g')))) AS ks
  FROM keyed_lines WHERE regexp_matches(line, '[\p{L}\p{N}]')),
g AS (SELECT min(rec_id) AS first_id, count(*) AS n_copies, list(rec_id) AS ids FROM c GROUP BY fs, ks)
"""

QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
ORACLES = {
    "p2_found": _SQL_KEYS + "SELECT first_id, u.rec_id FROM (SELECT first_id, unnest(ids) AS rec_id FROM g) u WHERE u.rec_id <> first_id",
    "p2_groups": _SQL_KEYS + "SELECT first_id, n_copies FROM g",
}
