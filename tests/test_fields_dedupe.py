from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import dedupe as D
from textloom.operators.fields import OPEN, parse_spec, range_key, selected_fields
from textloom.operators.keyed import numbered


def lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos long, line string")


def texts(df):
    return [r.line for r in df.orderBy("pos").collect()]


def test_parse_spec():
    assert parse_spec("1-") == [(0, OPEN)]
    assert parse_spec("3,1-2") == [(0, 3)]
    assert parse_spec("-2,5") == [(0, 2), (4, 5)]
    for bad in ("", "0", "2-1", "a", "1-2,2", "1,,2"):
        with pytest.raises(ValueError):
            parse_spec(bad)


def test_range_key(spark):
    df = lines(spark, ["a\tb\tc", "a", "a\t", "a\t\tc", None, ""])
    got = [r.k for r in df.select("pos", range_key(F.col("line"), "1").alias("k")).orderBy("pos").collect()]
    assert got == [["a"], ["a"], ["a\t"], ["a"], None, []]
    got = [r.k for r in df.select("pos", range_key(F.col("line"), "2-3").alias("k")).orderBy("pos").collect()]
    assert got == [["b\tc"], [], [], ["\tc"], None, []]
    got = [r.k for r in df.select("pos", selected_fields(F.col("line"), "1,3").alias("k")).orderBy("pos").collect()]
    assert got == [["a", "c"], ["a"], ["a"], ["a", "c"], None, []]


def test_dedupe_keeps_first(spark):
    df = lines(spark, ["b", "a", "b", None, "", "a", None, ""])
    assert texts(D.dedupe(df)) == ["b", "a", None, ""]
    assert D.dedupe(df.where("pos < 0")).count() == 0
    assert texts(D.dedupe(D.dedupe(df))) == texts(D.dedupe(df))


def test_dedupe_keyed_columns(spark):
    df = lines(spark, ["1 a", "2 a", "3 b", "4 a", "5 a", "6 b", "7 b"])
    assert texts(D.dedupe(df, spec="2", delim=" ")) == ["1 a", "3 b"]


def test_dedupe_parallel_is_sequential(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "y"), (3, "c", "x")], "pos long, line0 string, line1 string")
    assert [r.pos for r in D.dedupe_parallel(df).orderBy("pos").collect()] == [0, 2]


def test_commoncrawl(spark):
    df = lines(spark, [" x ", "x", D.MAGIC + " y", "", "\t", "gone", "z"])
    got = texts(D.commoncrawl_dedupe(df, lines(spark, [" gone"])))
    assert got == ["x", "", "z"]


def test_subtract_keeps_repeats(spark):
    df = lines(spark, ["a", "b", "a", "c", None])
    assert texts(D.subtract_lines(df, lines(spark, ["b", None]))) == ["a", "a", "c", None]
    assert D.subtract_lines(df, lines(spark, ["b"]).where("pos < 0")).count() == 5


def test_memoize_and_substitute(spark):
    df = lines(spark, ["k one", "k two", "m three", None])
    got = D.memoize(df, F.upper, spec="1", delim=" ").orderBy("pos").collect()
    assert [r.mapped for r in got] == ["K ONE", "K ONE", "M THREE", None]
    rows = lines(spark, ["1\t2\tk\tl\tfirst\t6", "1\t2\tk\tl\tsecond\t6", "1\t2\tk\tm\tthird\t6\t7"])
    assert texts(D.substitute(rows)) == ["1\t2\tk\tl\tfirst\t6", "1\t2\tk\tl\tfirst\t6", "1\t2\tk\tm\tthird\t6\t7"]
    with pytest.raises(Exception, match="fewer than six"):
        D.substitute(lines(spark, ["a\tb"])).collect()


def test_hot_key_lookup(spark):
    df = spark.range(5000).selectExpr("id as pos", "case when id % 3 = 0 then 'hot' else cast(id as string) end as line")
    got = D.memoize(df, F.upper)
    assert got.count() == 5000
    assert got.where("mapped <> upper(line)").count() == 0


def test_vocab_order(spark):
    got = {r.word: r.id for r in D.vocab(lines(spark, ["b a b", None, "", "c\ta"])).collect()}
    assert got == {"b": 1, "a": 2, "c": 3}


def test_numbered_is_dense(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    rows = numbered(df, ["v"], "n").orderBy("v").collect()
    assert [r.n for r in rows] == list(range(1000))
