"""First row of each key, look-ups by key, and dense numbering, all without one task holding a whole hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from textloom.session import settle

#: Share of all rows from which a key is hot; at most 1 / HOT_SHARE keys are, so these few rows may be broadcast.
HOT_SHARE = 0.001


def first_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The first row by ``order`` for each distinct value of ``keys`` (nulls are one value), with ``keep`` columns.

    An aggregation with map-side combining, not a window: a key that holds most rows shuffles one row per task.
    Ties of ``order`` go to the smaller remaining columns, so the result is the same on every run.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in keys and c not in order]
    if not df.columns:
        return df
    if len(order) == 1 and not set(keep) - set(order) and isinstance(df.schema[order[0]].dataType, NumericType):
        # numbers only in the buffer: a hash aggregation, without the sorts that a struct in it would need
        at = F.when(~F.bool_or(F.col(order[0]).isNull()), F.min(order[0]))  # a null comes first, as in a struct
        return df.groupBy(*keys).agg(at.alias("_at"), F.count("*").alias("_n")).select(*keys, F.col("_at").alias(order[0]), "_n")
    got = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_f"), F.count("*").alias("_n"))
    return got.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in dict.fromkeys([*order, *keep])], "_n")


def lookup(df: DataFrame, firsts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with the column ``value`` of its key's row in ``firsts(keys, value, _n)``; null keys match null keys.

    Hot keys, of which there are at most 1 / HOT_SHARE, are looked up by broadcast, the others by a shuffle on the key.
    """
    firsts = settle(firsts.select(*keys, value, "_n"), "firsts")
    total = firsts.agg(F.sum("_n")).first()[0] or 0
    limit = max(1000, int(total * HOT_SHARE))
    hot = firsts.where(F.col("_n") > limit).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_hot"), F.lit(True).alias("_is"))
    rest = firsts.where(F.col("_n") <= limit).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias(value))

    def same(right: DataFrame) -> Column:
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & df[k].eqNullSafe(right[f"_k{i}"]) if right is hot else cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return cond

    names = [f"_k{i}" for i in range(len(keys))]
    marked = df.join(F.broadcast(hot), same(hot), "left").drop(*names)
    from_hot = marked.where("_is").withColumn(value, F.col("_hot")).drop("_hot", "_is")
    from_rest = marked.where("_is is null").drop("_hot", "_is").join(rest, same(rest)).drop(*names)
    return from_hot.unionByName(from_rest)


def running_sum(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group before each row, in order, and the row itself.

    Range partitions of group and order, so that a group that holds a third of all rows is many tasks: each sums its own
    rows, and the sums of the partitions before it, at most one row for each partition and group in it, are added.
    """
    ranged = df.withColumn("_v", value).repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_p", F.spark_partition_id())
    ranged = settle(ranged, "ranged")
    parts = ranged.groupBy(group, "_p").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), before.alias("_o"))
    inside = F.sum("_v").over(Window.partitionBy(group, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    got = ranged.withColumn("_i", inside).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return got.withColumn(name, F.col("_i") + F.col("_o")).drop("_v", "_p", "_i", "_g", "_q", "_o")


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Dense numbers in the order of ``order``, by range partitions and their counts instead of one global window."""
    spark = df.sparkSession
    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    counts = {r._p: r.n for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    rows, at = [], start
    for p in sorted(counts):
        rows.append((p, at))
        at += counts[p]
    if not rows:
        return df.withColumn(name, F.lit(None).cast("long"))
    offsets = F.broadcast(spark.createDataFrame(rows, "_p int, _o long"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_r", inside).join(offsets, "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")
