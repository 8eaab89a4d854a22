from __future__ import annotations

import io
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions.hashing import corpus_hash, murmur64, stream_hash
from textloom.operators import clean as C
from textloom.operators import docs64 as B
from textloom.operators.shard import shard_names, shard_number
from textloom.operators.stats import best_forms, case_counts, idf


def check(spark, text, **rules):
    df = spark.createDataFrame([(text,)], "line string")
    return df.select(C.simple_cleaning(F.col("line"), **rules).alias("k")).first().k


def test_cleaning_rules(spark):
    good = "The quick brown fox jumps over the dog"
    assert check(spark, good)
    assert not check(spark, None)
    assert not check(spark, good[:29]) and check(spark, good[:30])
    assert not check(spark, good + "aaaaa") and check(spark, good + "aaaa")
    assert not check(spark, good + "\x07") and check(spark, good + "\x7f")
    assert not check(spark, good + " 1234567890")
    words = "word and more words then "
    assert check(spark, (words * 9)[:200]) and not check(spark, (words * 9)[:201])
    assert not check(spark, "хорошая строка для проверки письма тут", scripts=["Latin"])
    assert check(spark, "хорошая строка для проверки письма тут", scripts=["Cyrillic"])
    assert check(spark, good + "\t" + good) and not check(spark, good + "\tshort")


def test_filter_parallel(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "long"), (None, "b")], "line0 string, line1 string")
    assert C.filter_parallel(df, lambda c: C.short_enough(c, 1)).count() == 1


def test_idf(spark):
    df = spark.createDataFrame([("a b a",), ("a",), ("",), (None,)], "line string")
    got = {r.token: r.idf for r in idf(df).collect()}
    assert got == pytest.approx({"a": math.log(4 / 2), "b": math.log(4)}, abs=1e-15)


def test_case_model_ties(spark):
    df = spark.createDataFrame([("s", "Ab"), ("s", "aB"), ("s", "aB"), ("t", "X"), ("t", "x")], "source string, target string")
    got = {(r.source, r.lower_target): r.form for r in best_forms(case_counts(df)).collect()}
    assert got == {("s", "ab"): "aB", ("t", "x"): "X"}


def test_murmur_reference_values():
    # plain definition, one string at a time
    def plain(data: bytes, seed: int = 0) -> int:
        m, r, mask = 0xC6A4A7935BD1E995, 47, (1 << 64) - 1
        h = seed ^ (len(data) * m & mask)
        for i in range(0, len(data) // 8 * 8, 8):
            k = int.from_bytes(data[i : i + 8], "little") * m & mask
            k = (k ^ k >> r) * m & mask
            h = (h ^ k) * m & mask
        tail = data[len(data) // 8 * 8 :]
        if tail:
            h = (h ^ int.from_bytes(tail, "little")) * m & mask
        h = (h ^ h >> r) * m & mask
        return h ^ h >> r

    items = [b"", b"a", b"12345678", b"123456789", "ünï".encode() * 20]
    assert [int(x) for x in murmur64(items, 1)] == [plain(x, 1) for x in items]
    assert stream_hash(io.BytesIO(b"abc" * 10), 8) != stream_hash(io.BytesIO(b"abc" * 10), 16)


def test_corpus_hash_order_and_shards(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "line string")
    one = corpus_hash(df).first()[0]
    assert one == corpus_hash(df.orderBy("line")).first()[0]
    assert int(one) == (2 * int(murmur64([b"a"])[0]) + int(murmur64([b"b"])[0])) % (1 << 64)
    assert shard_names("p", 10)[-1] == "p9" and shard_names("p", 11)[0] == "p00"
    got = df.where("line is not null").select("line", shard_number(F.col("line"), 3, exact=True).alias("s")).collect()
    assert all(0 <= r.s < 3 for r in got) and len({r.s for r in got if r.line == "a"}) == 1


def test_base64(spark):
    long = "x" * 300
    df = spark.createDataFrame([(0, "a\nb\n"), (1, ""), (2, "no end"), (3, long), (4, None)], "doc_no long, t string")
    enc = df.select("doc_no", B.encode(F.col("t")).alias("b64"))
    assert "\n" not in enc.where("doc_no = 3").first().b64 and len(enc.where("doc_no = 3").first().b64) == 400
    assert [r.t for r in enc.select("doc_no", B.text(F.col("b64")).alias("t")).orderBy("doc_no").collect()] == ["a\nb\n", "", "no end", long, None]
    same = B.map_lines(enc, lambda x: x)
    assert {r.doc_no: r.b64 for r in same.collect()} == {r.doc_no: r.b64 for r in enc.collect()}
    with pytest.raises(Exception, match="changed"):
        B.map_lines(enc, lambda x: x.where("line_no = 0")).collect()
    bad = spark.createDataFrame([("YQ",), ("YQ==",), ("Y*",)], "b string")
    assert [r[0] for r in bad.select(B.decode(F.col("b"), strict=False).cast("string")).collect()] == ["a", "a", None]
    assert [(r.doc_no, r.line_no, r.line) for r in B.docdec(enc.where("doc_no = 0"), number=True).collect()] == [(0, 0, "1\ta"), (0, 1, "1\tb"), (0, 2, "1\t")]


def test_docenc(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(["a", "b", "", "", "c"])], "stream string, pos long, line string")
    got = B.docenc(df).withColumn("t", B.text(F.col("b64"))).orderBy("doc_no").collect()
    assert [r.t for r in got] == ["a\nb\n", "", "c\n"]
