from __future__ import annotations

import bz2
import gzip
import lzma

import pytest

import __spark_entry__ as entry
from textloom.sources import text as T
from textloom.sources import warc as W


def test_decompress_members():
    data = b"".join(i.to_bytes(4, "little") for i in range(25000))
    for c in (gzip.compress, bz2.compress, lzma.compress):
        assert T.decompress(c(data[:5000]) + c(data[5000:])) == data
    assert T.decompress(data) == data
    assert T.lines_of(b"a\r\nb\n\nc\r") == [b"a", b"b", b"", b"c\r"]


def test_read_any_and_write(spark, tmp_path):
    (tmp_path / "x").write_bytes(lzma.compress(b"one\r\ntwo\n"))
    (tmp_path / "y").write_bytes(b"three")
    got = sorted((r.path[-1], r.pos, r.line) for r in T.read_any(spark, str(tmp_path)).collect())
    assert got == [("x", 0, "one"), ("x", 1, "two"), ("y", 0, "three")]
    T.write_lines(T.read_any(spark, str(tmp_path)), str(tmp_path / "out"), compression="gzip")
    assert sorted(r.line for r in T.read_lines(spark, str(tmp_path / "out")).collect()) == ["one", "three", "two"]
    assert [r.line for r in T.cat(spark, [str(tmp_path / "y"), str(tmp_path / "x")]).orderBy("file_no", "pos").collect()] == ["three", "one", "two"]


def test_warc(spark, tmp_path):
    raw = W.dump({"WARC-Type": "x"}, b"hello\r\n\r\nworld", True) + W.dump({"WARC-Type": "y"}, b"", True)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    got = W.read_warc(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [(r.record_no, r.headers["warc-type"], bytes(r.payload)) for r in got] == [(0, "x", b"hello\r\n\r\nworld"), (1, "y", b"")]
    up = W.map_records(W.read_warc(spark, str(tmp_path)), bytes.upper, 2).orderBy("record_no").collect()
    assert bytes(up[0].payload) == b"HELLO\r\n\r\nWORLD"
    good = W.dump({}, b"x")
    for bad in (b"WARC/0.9" + good[8:], good.replace(b"Content-Length: 1", b"X: 1"), good.replace(b"Content-Length: 1", b"Content-Length: 1\r\ncontent-length: 1"), good[:-2]):
        with pytest.raises(ValueError):
            list(W.parse(bad))


def test_every_query_has_stable_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "pos", "line"] and df.limit(3).count() == 3


def test_stream_dedupe(spark):
    q = entry.queries()["stream_dedupe"](spark, "/root/testdata/sf0.001")
    assert q.count() == q.distinct().count() > 0
