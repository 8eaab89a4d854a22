from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import rules
from textloom.functions.prefixes import parse
from textloom.functions.splitter import split_stream, split_text
from textloom.functions.tokenizer import detokenize_line, tokenize
from textloom.functions.truecase import apply_case, load_model, train_case, truecase_line
from textloom.functions.unicode import process_text, process_unicode, tokens, unescape_html
from textloom.operators.fold import fold_line, fold_map
from textloom.operators.pipe import pipe_lines
from textloom.plans.pipelines import newswire_extract, text_pipeline


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("r")).first().r


def test_unicode(spark):
    assert process_text("ôÆÐØ", "en", True, False, False) == "ôæðø"
    assert process_text("ﬁ⁵æ", "en", False, False, True) == "fi5æ"
    assert process_text("«foo bar» '", "en", False, True, False) == "\"foo bar\" '"
    assert process_text(" ``foo bar'' ", "fr", False, True, False) == " «foo bar» "
    for a, b in (("' s", "'s"), ("' s ", "'s "), ("a' s", "a's"), ("' sfoo", "' sfoo")):
        assert process_text(a, "en", False, True, False) == b
    with pytest.raises(ValueError):
        process_unicode(F.lit("a"), "ru", flatten=True)
    assert one(spark, None, lambda c: process_unicode(c, normalize=True)) is None
    assert one(spark, "a &eacute;&#233;&lt; ﻿b", unescape_html) == "a éé<  b"
    assert one(spark, "|||", lambda c: tokens(c, "|||")) == ["", ""]
    assert one(spark, "|||", lambda c: tokens(c, "|||", False)) == []


def test_escape_round_trip(spark):
    s = "a & b | <c> 'd' \"e\" [f]"
    assert one(spark, s, lambda c: rules.deescape(rules.escape(c))) == s
    assert one(spark, "&bar;&bra;&ket;&amp;lt;", rules.deescape) == "|[]&lt;"


def test_punctuation_and_heuristics(spark):
    assert one(spark, "„Hi” ( x ) – 5 % : a’b…", rules.normalize_punctuation) == "\"Hi\" (x) - 5%: a'b..."
    assert one(spark, 'say "so."', lambda c: rules.normalize_punctuation(c, "de")) == 'say "so".'
    assert one(spark, "he said \"so\".", rules.normalize_punctuation) == 'he said "so."'
    assert one(spark, "a dlrs b", rules.apply_heuristics) == "a $ b"


def test_tokenizer(spark):
    tok = lambda s, lang="en", **k: one(spark, s, lambda c: tokenize(c, lang, **k))
    assert tok("Mr. Smith paid 5,300, didn't he?") == "Mr. Smith paid 5,300 , didn &apos;t he ?"
    assert tok("l'eau", "fr") == "l&apos; eau"
    assert tok("USA:n on", "fi") == "USA:n on"
    assert tok("wait... [x] a|b") == "wait ... &#91; x &#93; a &#124; b"
    assert tok("a-b", aggressive=True) == "a @-@ b"
    assert tok("see http://x.y/z now.", protected=[r"http://\S+"]) == "see http://x.y/z now ."
    assert tok("   ") == "   " and tok(None) is None
    assert tok("<P>", skip_xml=True) == "<P>"
    assert tok("\"I can't,\" he said.", penn=True) == "`` I ca n&apos;t , &apos;&apos; he said ."
    assert tok("A.B,C,D") == "A.B , C , D"


def test_detokenizer():
    assert detokenize_line("didn &apos;t ( he ) say &quot; yes &quot; ?") == "didn't (he) say \"yes\"?"
    assert detokenize_line("l&apos; eau ?", "fr") == "l'eau ?"
    assert detokenize_line("EU: N", "fi") == "EU:n"
    assert detokenize_line("a @-@ b .", upper=True) == "A-b."
    assert detokenize_line("`` I ca n't , '' he said", penn=True) == "\"I can't,\" he said"
    assert detokenize_line("") == "" and detokenize_line("<P>") == "<P>"


def test_splitter(spark):
    sp = lambda s, lang="en", **k: one(spark, s, lambda c: split_text(c, lang, **k))
    assert sp("Mr. Smith left. He ran! \"Why?\" (No.) Then it ended.") == ["Mr. Smith left.", "He ran!", '"Why?"', "(No.)", "Then it ended."]
    assert sp("See No. 5 here. No. Really.") == ["See No. 5 here.", "No.", "Really."]
    assert sp("U.S.A. Today is fine.") == ["U.S.A. Today is fine."]
    assert sp("你好。再见！", "zh") == ["你好。", "再见！"]
    assert sp("") == [] and sp(None) is None
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(["A b", "c. D e.", "", "F.", "<X>"])], "stream string, pos long, line string")
    got = [r.sentence for r in split_stream(df).orderBy("at", "n").collect()]
    assert got == ["A b c.", "D e.", "<P>", "F.", "<X>"]


def test_prefix_files():
    assert parse(["# c", "", "Dr", "No #NUMERIC_ONLY#"]) == {"Dr": 1, "No": 2}


def test_truecase(spark):
    m = load_model(["The (5/6) the (1)", "the (9/9)", "Paris (3/3)"])
    assert truecase_line("the end . the ( paris", m) == "The end . The ( Paris"
    df = spark.createDataFrame(
        [(1, ["x", "paris", "y"], ["a", "Paris", "b"], [(0, 0), (1, 1)]), (2, ["x", "paris"], ["a", "PARIS"], [(1, 1)]), (3, ["x", "paris"], ["a", "Paris"], [(1, 1)]), (4, ["q"], [], [])],
        "sent long, source array<string>, target array<string>, links array<struct<i:int,j:int>>",
    )
    counts = train_case(df)
    assert {(r.form, r.cnt) for r in counts.collect()} == {("Paris", 2), ("PARIS", 1)}
    got = {r.sent: r.text for r in apply_case(df, counts).collect()}
    assert got == {1: "a Paris b", 2: "a Paris", 3: "a Paris", 4: ""}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ,-:é漢", max_size=60), st.integers(3, 12), st.booleans())
def test_fold_joins_to_line(line, width, skip):
    pieces, gaps = fold_line(line, width, skip=skip)
    assert "".join(p + g for p, g in zip(pieces, gaps)) == line
    assert all(len(p.encode()) <= width + 2 for p in pieces)


def test_fold_examples(spark):
    assert fold_line("", 10) == ([""], [""])
    assert fold_line("hello wide world", 10)[0] == ["hello ", "wide ", "world"]
    df = spark.createDataFrame([(1, "some words, to fold"), (2, ""), (3, None)], "id long, line string")
    got = {r.id: r.line for r in fold_map(df, lambda x: x.withColumn("line", F.upper("line")), "id", width=6).collect()}
    assert got == {1: "SOME WORDS, TO FOLD", 2: "", 3: None}


def test_pipe(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "pos long, line string")
    got = [r.up for r in pipe_lines(df, ["tr", "a-z", "A-Z"], out="up").orderBy("pos").collect()]
    assert got == ["B", None, "A"]
    with pytest.raises(Exception, match="wrote"):
        pipe_lines(df, ["head", "-n", "0"]).collect()


def test_pipelines(spark):
    assert one(spark, "« Ça va ? » Mr. X said.", lambda c: text_pipeline(c, "en")) == "&quot; ça va ? &quot; mr. x said ."
    with pytest.raises(ValueError):
        text_pipeline(F.lit("a"), "eng")
    rows = ["<TEXT>", "<P>", "One &amp;lt; (MORE) two.", "One &amp;lt; (MORE) two.", "</P>", "Three (AT)x.", "</TEXT>", "out", "<HEADLINE>", "Big-", "News", "</HEADLINE>"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)], "stream string, pos long, line string")
    got = [r.sentence for r in newswire_extract(df).orderBy("at", "n").collect()]
    assert got == ["One &lt; two.", "Three @x.", "Big-News"]
