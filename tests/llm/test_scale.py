"""Samples, plans and storage: what has to hold at any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import sample, sentences

SF = "/root/testdata/sf0.001"


def python_nodes(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_shares_draw_the_bound_at_any_size():
    for rows in (10, 10**5, 10**9, 10**12, 10**15):
        sizes = {"latin": (rows, 80 * rows), "thai": (max(1, rows // 10**6), 50), "cjk": (rows // 7 + 1, rows)}
        keep = sample.shares(sizes, 12_000, 10**9)
        drawn = sum(sizes[s][0] * k for s, k in keep.items())
        assert abs(drawn - min(12_000, sum(n for n, _ in sizes.values()))) < 1e-6 * drawn + 1
        assert all(0 < k <= 1 and int(k * sample._SPAN) >= 1 for k in keep.values())
        assert sizes["thai"][0] * keep["thai"] >= min(sizes["thai"][0], 1999)


def test_shares_bound_characters():
    keep = sample.shares({"latin": (100, 10**12), "cjk": (100, 1000)}, 1000, 10**6)
    assert keep["latin"] * 10**12 <= 10**6 and keep["cjk"] == 1


def test_sample_is_even_and_complete(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 100 = 0 then 'ไทย' when id % 7 = 0 then null when id % 11 = 0 then '  ' else 'plain' end as line")
    every = sample.sampled(df, "line", "id", 10**6, 1, 10**9)
    assert len(every) == df.where("line is not null and trim(line) <> ''").count()
    some = sample.sampled(df, "line", "id", 200, 1, 10**9)
    assert 140 < len(some) < 260 and some.count("ไทย") == 30
    assert some == sample.sampled(df.repartition(7), "line", "id", 200, 1, 10**9)
    assert sample.sampled(df.where("id < 0"), "line", "id", 200, 1, 10**9) == []


def test_sentences_run_once_and_models_are_kept(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/split_lines.parquet").select("line_id", "line")
    model = sentences.learn(df)
    sentences.save(spark, model, str(tmp_path / "m"))
    again = sentences.load(spark, str(tmp_path / "m"))
    assert np.allclose(model[0], again[0]) and model[1] == again[1]
    got = sentences.with_ends(df, model=again).select("line_id", F.explode("ends").alias("end_pos"))
    assert python_nodes(got) == 1
    assert got.count() == sentences.with_ends(df, model=model).select(F.explode("ends")).count()


def test_garbled_lines_come_through_the_model(spark, tmp_path):
    from textloom.llm import mojibake

    df = spark.read.parquet(f"{SF}/crawl_lines.parquet").select("line_id", "line")
    judge = mojibake.learn(df)
    mojibake.save(spark, judge, str(tmp_path / "m"))
    again = mojibake.load(spark, str(tmp_path / "m"))
    rows = lambda j: sorted((r.line_id, r.restored) for r in mojibake.repaired(df, judge=j).where("garbled").collect() if r.restored is not None)
    assert rows(judge) == rows(again) and judge[1:] == again[1:]
    got = mojibake.repaired(df, judge=judge)
    assert python_nodes(got.where("garbled")) == 1
    lost = got.where("line like '%�%'").collect()
    assert lost and all(r.garbled and r.gain > judge[1] and r.restored is None for r in lost)
    # a higher margin refuses them like all others: nothing is garbled for the character alone
    strict = (judge[0], 1e9, judge[2])
    assert mojibake.repaired(df, judge=strict).where("garbled").count() == 0


def test_lookalikes_run_once(spark):
    from textloom.llm import lookalikes

    df = lookalikes.p5_found(spark, SF)
    assert python_nodes(df) == 4  # texts and glossary forms of two fields


def test_fit_decides_what_an_open_end_means(spark):
    from textloom.llm import truncation as T

    def chance(evidence, ending, posterior, odds):
        df = spark.createDataFrame([(ending, posterior, odds)], "ending string, posterior double, odds double")
        return df.select(evidence.column().alias("p")).first().p

    base = {("whole", 0.0, 0.0): 9000.0, ("closing", 0.0, 0.0): 900.0, ("open", 0.99, 0.0): 200.0}
    cut = T.Evidence(base | {("open", 0.0, 1.0): 300.0})  # as short as texts cut in transfer
    kind = T.Evidence(base | {("open", 0.0, -3.0): 300.0})  # as long as whole texts: they are of that kind
    assert chance(cut, "open", 0.0, 1.0) > 0.9 and chance(kind, "open", 0.0, -3.0) < 0.1
    assert chance(kind, "open", 0.99, 0.0) > 0.9  # at a limit all the same
    assert chance(cut, "whole", 0.999, 0.0) < 0.5 and chance(cut, "trail", 0.0, 0.0) < 0.5
    assert chance(cut, "broken", 0.0, 0.0) > 0.5


def test_texts_are_read_once(spark):
    from textloom.llm import truncation as T

    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    seen = T.with_endings(df)
    assert "documents.parquet" not in seen._jdf.queryExecution().executedPlan().toString()
    assert not set(r.ending for r in seen.collect()) - set(T.ENDINGS)


def test_encoding_model_comes_from_all_lines(spark):
    from textloom.llm import mojibake

    lines = [f"line {i} of the text" for i in range(30_000)] + [f"once q{chr(97 + i // 6)}{chr(97 + i % 6)}z" for i in range(36)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(-1, lines[0]), (-2, None), (-3, " ")], "line_id long, line string")
    model, margin, odd = mojibake.learn(df)
    every = mojibake.TrigramModel.of(mojibake.counted(lines))
    assert model.ids3.tolist() == every.ids3.tolist() and model.ids2.tolist() == every.ids2.tolist()
    weight = mojibake.MASS_LINES / len(lines)  # all count, as much as so many lines
    assert np.allclose(model.n3, every.n3 * weight, rtol=1e-5) and np.isclose(model.n, every.n * weight)
    assert margin == mojibake.FEW_MARGIN and odd == mojibake.FIRST_ODD


def test_encoding_model_of_a_table_is_that_of_its_lines(spark):
    from textloom import session
    from textloom.llm import mojibake

    df = spark.read.parquet(f"{SF}/crawl_lines.parquet").select("line_id", "line")
    model, margin, odd = mojibake.learn(df.repartition(5))
    same, least, strange, _ = mojibake.train([r.line for r in df.collect() if r.line is not None])
    assert (margin, odd) == (least, strange) and (model.ids3 == same.ids3).all() and (model.n3 == same.n3).all() and (model.c1 == same.c1).all()
    assert not [at for at in session._WRITTEN if "/p1-" in at]


def test_quantiles_are_exact(spark):
    from textloom.llm import mojibake

    v = np.append(np.random.default_rng(1).normal(size=3000).round(2), [1e9, -1e9, 0.0])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    for q in (0.0, 0.01, 0.5, 0.999, 1.0):
        assert np.isclose(mojibake.quantile(df, "v", q, len(v), held=7), np.quantile(v, q), rtol=1e-12)


def test_garbled_words_that_come_often_are_not_learned():
    import random

    from textloom.llm import mojibake

    rng = random.Random(1)
    words = "la biblioteca guardó el índice de pueblos pequeños según las normas después niño año über größe straße schön für müde".split()
    clean = [" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(2000)]
    bad = [x.replace("niño", "niÃ±o") for x in clean[:400] if "niño" in x and not x.replace("niño", "").isascii()]
    model, margin, odd, _ = mojibake.train(clean[400:] + bad)
    assert len(bad) > 100 and (mojibake.best(bad, model, odd)[1] > margin).mean() > 0.99
    assert not (mojibake.best(clean[400:800], model, odd)[1] > margin).any()


def test_garbled_lines_gain_at_least_what_they_were(spark):
    from textloom.llm import mojibake

    df = spark.read.parquet(f"{SF}/crawl_lines.parquet")
    lines = [r.line for r in df.collect() if r.line and not r.line.isascii() and not mojibake.plainly_garbled(r.line)]
    every = mojibake.TrigramModel.of(mojibake.counted(lines))
    bad, _, fold, odd, least = mojibake.crossed_garbled(lines, [every] * mojibake.FOLDS)
    gain = mojibake.crossed(bad, [every] * mojibake.FOLDS, fold, mojibake.FIRST_ODD)[1]
    tried = odd < mojibake.FIRST_ODD
    assert tried.sum() > 300 and (gain[tried] >= least[tried] - 1e-6).all() and (least > 0).mean() > 0.9
