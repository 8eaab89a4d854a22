"""Every query over empty tables, tables of nulls, and tables with further columns whose names clash with inner ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["crawl_lines", "keyed_lines", "split_lines", "fold_items", "unicode_text", "glossary", "documents", "test_items"]
FOUND = ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_found", "p8_found"]
CLASHING = ["n", "b", "key2", "bucket", "ends", "pieces", "forced", "canon", "hits", "seed", "at", "ending", "posterior", "cut", "garbled", "restored", "first_id", "_t", "_w", "_r", "_b", "_p"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{t}.parquet")
        ids = df.columns[0]
        nulls = df.limit(5).select(ids, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != ids])
        nulls.write.parquet(f"{root}/nulls/{t}.parquet")
        extra = [c for c in CLASHING if c not in df.columns]
        df.select("*", *[F.lit("x").alias(c) for c in extra]).write.parquet(f"{root}/clash/{t}.parquet")
    return str(root)


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, f"{folders}/empty").collect() == []


@pytest.mark.parametrize("name", FOUND)
def test_tables_of_nulls(spark, folders, name):
    got = queries.QUERIES[name](spark, f"{folders}/nulls").collect()
    assert [r.ids for r in got] == [[]] * 5 if name == "p6_ids" else got == []


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p5_found", "p7_found", "p8_found"])
def test_clashing_columns(spark, folders, name):
    rows = lambda d: sorted(map(tuple, queries.QUERIES[name](spark, d).collect()))
    assert rows(f"{folders}/clash") == rows(SF)
