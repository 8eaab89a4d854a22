"""Single results that a wrong rule would change."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom import session
from textloom.functions import rules, truecase
from textloom.functions.hashing import murmur64_column
from textloom.functions.prefixes import load_folder
from textloom.functions.tokenizer import detokenize_line, tokenize
from textloom.operators import clean, dedupe, docs64, shard, stats
from textloom.plans.pipelines import resplit
from textloom.sources import newswire
from textloom.sources import text as T
from textloom.sources import warc as W

SF = "/root/testdata/sf0.001"


def one(spark, text, f, kind="string"):
    return spark.createDataFrame([(text,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("I shouldn't've gone.", "I should n&apos;t &apos;ve gone ."),
        ("They'll say we've won", "They &apos;ll say we &apos;ve won"),
        ("I CAN'T", "I CA N&apos;T"),
        ("'Tis (not) 5,300", "` Tis -LRB- not -RRB- 5,300"),
        ("and/or", "and @/@ or"),
        ("wait...", "wait ..."),
    ],
)
def test_treebank_rules_in_order(spark, line, want):
    assert one(spark, line, lambda c: tokenize(c, "en", penn=True)) == want


def test_heuristics_examples(spark):
    h = lambda s, *a: one(spark, s, lambda c: rules.apply_heuristics(c, *a))
    assert h("full - time !! can 't do . . . x") == "full-time ! can't do ... x"
    assert h("mon -- avis") == "mon - avis"
    assert h("a" * 60, "en", "intended") == "-" and h("a" * 60) == "a" * 60


def test_escaping_a_whole_line(spark):
    assert one(spark, "  a \x01 <b>  [c] ", rules.tidy_escape) == "a &lt;b&gt; &#91;c&#93;"
    assert one(spark, '<n translation="x y"> z </n>', rules.tidy_escape) == '<n translation="x y"> z </n>'
    assert one(spark, None, rules.tidy_escape) is None


def test_newswire_blocks():
    assert newswire.blocks(["<P>", "a", "", "b"]) == ["a b "]
    assert newswire.blocks(["<P>", "a (MORE) b(AT)c", "</P>", "<TEXT>", "", "</TEXT>", "<TEXT>", "x-", "y"]) == ["a  b@c ", "x-y "]
    assert newswire.blocks(["out", "<HEADLINE>", "<x>", "t (BC-ANY THING) u (OTHER)", "</HEADLINE>"]) == ["t  u (OTHER) "]
    assert newswire.clean("``a'' &lt;&AMP;lt;") == '"a" <&lt;'
    assert newswire.blocks([]) == []


def test_both_readers_take_one_carriage_return(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"abc\r\r\nx\r\ny\n\nz")
    want = ["", "abc\r", "x", "y", "z"]
    assert sorted(r.line for r in T.read_lines(spark, str(tmp_path)).collect()) == want
    assert sorted(r.line for r in T.read_any(spark, str(tmp_path)).collect()) == want


def test_truecase_words_and_model(spark):
    m = truecase.load_model(["Paris x (2/2)", "the (3/3)"])
    assert truecase.truecase_line("the a  b\tparis x", m) == "the a b Paris x"
    df = spark.createDataFrame([("a Paris paris Paris",), ("b Rome",), (None,), ("",)], "line string")
    model = truecase.train_model(df)
    assert truecase.truecase_line("rome , paris", model) == "Rome , paris" and truecase.truecase_line("paris", model) == "Paris"


def test_links_beyond_the_words_are_errors(spark):
    df = spark.createDataFrame([(1, ["a"], ["b"], [(0, 1)])], "sent long, source array<string>, target array<string>, links array<struct<i:int,j:int>>")
    with pytest.raises(Exception, match="beyond the words"):
        truecase.train_case(df).collect()
    with pytest.raises(Exception, match="beyond the words"):
        truecase.apply_case(df, spark.createDataFrame([("a", "b", "B", 1)], "source string, lower_target string, form string, cnt long")).collect()


def test_giza_sentences(spark):
    rows = [(1, "# sentence pair (1) source length 3 target length 2 alignment score : 0.1", "x y", "NULL ({ }) a ({ 1 }) b ({ 2 }) c ({ })"), (2, "# sentence pair (2) source length 9 target length 2 alignment score : 1", "x y", "NULL ({ 1 }) a ({ 2 })")]
    triples = spark.createDataFrame(rows, "sent long, comment string, target_line string, alignment string")
    texts = spark.createDataFrame([(1, ["a", "b", "c"], ["X", "Y"]), (2, ["a"], ["X", "Y"])], "sent long, source array<string>, target array<string>")
    good, bad = truecase.giza_sentences(triples, texts)
    assert [[(x.i, x.j) for x in r.links] for r in good.collect()] == [[(0, 0), (1, 1)]] and [r.sent for r in bad.collect()] == [2]
    counts = spark.createDataFrame([("a", "x", "X", 2), ("a", "x", "x", 5)], "source string, lower_target string, form string, cnt long")
    assert truecase.model_lines(counts).first().line == "x 5\tX 2"


def test_idf_is_not_rounded(spark):
    got = {r.token: r.idf for r in stats.idf(spark.createDataFrame([("a b",), ("a",), ("c c",)], "line string")).collect()}
    assert abs(got["b"] - 1.0986122886681098) < 1e-15 and abs(got["a"] - 0.4054651081081644) < 1e-15


def test_invalid_bytes_are_seen(spark):
    bad = b"ab\xffc"
    df = spark.createDataFrame([(1, b"good"), (2, bad), (3, None)], "i long, raw binary").withColumn("line", F.col("raw").cast("string"))
    assert [r.i for r in df.where(clean.valid_utf8(F.col("line"))).collect()] == [1]
    docs = df.select("i", docs64.encode(F.col("raw")).alias("b64"))
    assert [r.x for r in docs.orderBy("i").select(docs64.drop_invalid(F.col("b64")).alias("x")).collect()] == ["Z29vZA==", "", None]


def test_document_ranges(spark):
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(6)], "doc_no long, t string").select("doc_no", docs64.encode(F.col("t")).alias("b64"))
    assert sorted(r.doc_no for r in docs64.docdec(docs, only="1,3-4,6-").collect()) == [0, 2, 3, 5]
    assert sorted(r.doc_no for r in docs64.docdec(docs, only=[2, 2, 9]).collect()) == [1]


def test_shards_follow_the_hash(spark):
    df = spark.createDataFrame([("",), ("a",), ("some line",), (None,)], "line string")
    rows = df.select("line", murmur64_column(F.col("line"), shard.SHARD_SEED).alias("h"), shard.shard_number(F.col("line"), 7, exact=True).alias("s")).collect()
    for r in rows:
        assert r.s is None if r.line is None else r.s == (r.h % (1 << 64)) % 7


def test_archives_on_disk(spark, tmp_path):
    docs = [f"text {i}\r\n\r\nä".encode() for i in range(20)]
    for k in range(2):
        raw = b"".join(W.dump({"WARC-Type": "conversion", "X-No": str(i)}, d, k == 1) for i, d in enumerate(docs))
        (tmp_path / f"{k}.warc{'.gz' if k else ''}").write_bytes(raw)
    got = W.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.path[-3:], int(r.headers["x-no"]), bytes(r.payload)) for r in got) == sorted((p, i, d) for p in ("arc", ".gz") for i, d in enumerate(docs))
    assert gzip.decompress((tmp_path / "1.warc.gz").read_bytes()) == (tmp_path / "0.warc").read_bytes()


def test_lists_in_a_folder(spark, tmp_path):
    (tmp_path / "list.xx").write_text("# c\nAbk\nNum #NUMERIC_ONLY#\n")
    (tmp_path / "list.en").write_text("Zyx\n")
    lists = load_folder(spark, str(tmp_path))
    assert lists == {"xx": {"Abk": 1, "Num": 2}, "en": {"Zyx": 1}}
    df = spark.createDataFrame([(1, "en", "See Zyx. Then Mr. Go."), (2, "zh", "好。走。"), (3, None, "A. B")], "i long, lang string, line string")
    got = {}
    for r in resplit(df, lang_col="lang", prefixes=lists).orderBy("i", "n").collect():
        got.setdefault(r.i, []).append(r.sentence)
    assert got == {1: ["See Zyx. Then Mr.", "Go."], 2: ["好。", "走。"], 3: ["A.", "B"]}


def test_detokenised_stands():
    assert detokenize_line("e - mail je", "cs") == "e-mail je" and detokenize_line("3 , 5", "cs") == "3,5"
    assert detokenize_line("漢 字 x", "zh") == "漢字 x" and detokenize_line("漢 字", "ko") == "漢 字"
    assert detokenize_line("the boys ' &quot; house &quot; ! ( 5 $ 3 )") == "the boys' \"house\"! (5 $3)"
    assert detokenize_line("quoi ? ( oui )", "fr") == "quoi ? (oui)"


def test_dedupe_is_a_hash_aggregation(spark):
    df = spark.read.parquet(f"{SF}/crawl_lines.parquet").select("line_id", "line")
    plan = dedupe.dedupe(df, order=["line_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan and plan.count("Exchange") == 1
    small = spark.createDataFrame([(None, "a"), (3, "a"), (2, "b"), (1, None), (4, None)], "line_id long, line string")
    assert sorted(map(str, dedupe.dedupe(small, order=["line_id"]).collect())) == sorted(map(str, spark.createDataFrame([(None, "a"), (2, "b"), (1, None)], small.schema).collect()))


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Cluster:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: None)})()

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Cluster(), "x")


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    df = session.settle(spark.range(5).toDF("i"), "probe")
    path = df.inputFiles()[0].removeprefix("file://")
    import os

    assert df.count() == 5 and os.path.exists(path) and session.clear_scratch(spark) == 1 and not os.path.exists(path)


def test_entry_lists_queries():
    assert {"truecased", "escape_tidy", "stream_token_counts"} <= set(entry.oracle_sql()) <= set(entry.queries())


def test_archives_through_a_program(spark):
    docs = [(i, f"text {i}".encode()) for i in range(30)]
    df = spark.createDataFrame([("", i, "WARC/1.0", {"warc-type": "x", "content-length": str(len(p))}, bytearray(p)) for i, p in docs], W.SCHEMA)
    got = W.pipe_warc(df, ["sed", "s/text/TEXT/"], 3).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted(p.replace(b"text", b"TEXT") for _, p in docs)
    with pytest.raises(Exception, match="status"):
        W.pipe_warc(df, ["false"]).collect()
    assert W.pipe_warc(df.where("record_no < 0"), ["cat"]).count() == 0


def test_running_sums_of_a_long_group(spark):
    from textloom.operators.keyed import running_sum

    df = spark.range(4000).selectExpr("if(id % 3 = 0, 'a', if(id % 50 = 1, null, 'b')) as g", "id as pos", "cast(id % 7 = 0 as int) as v")
    got = {r.pos: r.n for r in running_sum(df, "g", "pos", F.col("v"), "n").collect()}
    sums: dict = {}
    for r in df.orderBy("pos").collect():
        sums[r.g] = sums.get(r.g, 0) + r.v
        assert got[r.pos] == sums[r.g]
    assert len(got) == 4000


def test_file_hashes(spark, tmp_path):
    from textloom.functions.hashing import file_hashes, murmur64

    (tmp_path / "a").write_bytes(b"x" * (1 << 20) + b"tail")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"y"))
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in file_hashes(spark, str(tmp_path)).collect()}
    first = int(murmur64([b"x" * (1 << 20)])[0])
    assert got["a"] == f"{int(murmur64([b'tail'], first)[0]):x}"
    assert got["b.gz"] == f"{int(murmur64([(tmp_path / 'b.gz').read_bytes()])[0]):x}"


def test_documents_between_nuls(spark):
    df = spark.createDataFrame([("s", "a\nb\0\0c"), ("t", ""), ("u", "x\0"), ("v", None)], "stream string, content string")
    docs = docs64.split_documents(df)
    got = [(r.stream, r.doc_no, r.t) for r in docs.select("stream", "doc_no", docs64.text(F.col("b64")).alias("t")).orderBy("stream", "doc_no").collect()]
    assert got == [("s", 0, "a\nb"), ("s", 1, ""), ("s", 2, "c"), ("u", 0, "x")]
    assert docs64.join_documents(docs, nul=True).where("stream = 's'").orderBy("doc_no").first().document == "a\nb\0"
    assert [tuple(r) for r in docs64.counts(docs, delimiter="\n").orderBy("stream").collect()] == [("s", 3, 1), ("u", 1, 0)]


def test_commands_fail_loudly(spark):
    from textloom.operators.pipe import pipe_lines

    df = spark.range(5000).selectExpr("id", "concat('l', id) as line")
    assert pipe_lines(df, ["sed", "s/l/L/"]).where("line <> concat('L', id)").count() == 0
    for argv, word in ((["head", "-n", "3"], "wrote"), (["sed", "p"], "wrote"), (["false"], "status|wrote")):
        with pytest.raises(Exception, match=word):
            pipe_lines(df, argv).collect()
    assert pipe_lines(df.where("id < 0"), ["cat"]).count() == 0
    got = dedupe.memoize(spark.createDataFrame([(1, "a x"), (2, "a y"), (3, None)], "pos long, line string"), ["tr", "a-z", "A-Z"], spec="1", delim=" ")
    assert sorted((r.pos, r.mapped) for r in got.collect()) == [(1, "A X"), (2, "A X"), (3, None)]


def test_shards_are_written_in_order(spark, tmp_path):
    df = spark.range(2000).selectExpr("id as pos", "concat(id % 7, '\t', id) as line")
    shard.write_shards(df, str(tmp_path / "s"), 3, spec="1")
    seen = 0
    for i in range(3):
        folder = tmp_path / "s" / f"shard={i}"
        lines = [x for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()] if folder.exists() else []
        assert [int(x.split("\t")[1]) for x in lines] == sorted(int(x.split("\t")[1]) for x in lines)
        seen += len(lines)
    assert seen == 2000
