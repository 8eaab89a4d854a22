from __future__ import annotations

import base64
import math
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import copies, leaks, lookalikes, mojibake, pieces, queries, sentences, tokenize, truncation

SF = "/root/testdata/sf0.001"


# --- wrong encodings --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clean_lines():
    rng = random.Random(1)
    words = "la biblioteca guardó el índice de pueblos pequeños según las normas después niño año über größe straße schön für müde café déjà élève".split()
    return [" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(1500)]


def test_mojibake_found_and_restored(clean_lines):
    model, margin, odd, info = mojibake.train(clean_lines)
    assert info["found"] > 0.97 and info["restored"] > 0.95
    was = [x for x in clean_lines[:60] if not x.isascii()]
    bad = [x.encode().decode("cp1252", "ignore") if i % 2 else mojibake.decode(x.encode(), "w1252") for i, x in enumerate(was)]
    twice = [mojibake.decode(mojibake.decode(x.encode(), "w1252").encode(), "w1252") for x in was]
    read, gain = mojibake.best(twice, model, odd)
    assert np.mean(gain > margin) == 1 and np.mean([a == b for a, b in zip(read, was)]) > 0.9
    assert np.mean(mojibake.best(bad, model, odd)[1] > margin) > 0.95
    assert not (mojibake.best(was, model, odd)[1] > margin).any()


def test_mojibake_entities_and_edges(clean_lines):
    assert mojibake.without_entities("caf&#195;&#169; &amp; &#65;") == "cafÃ© &amp; &#65;"
    assert mojibake.decoded("plain") == [] and mojibake.decoded("") == [] and mojibake.changes("") == []
    model, margin, odd, _ = mojibake.train(clean_lines)
    assert mojibake.best(["", "plain ascii", "é" * 5000], model, odd)[1].tolist()[:2] == [0, 0]


def test_mojibake_columns(spark):
    df = spark.createDataFrame([(1, "ok", 5), (2, None, 6), (3, "bro�ken", 7), (4, "", 8)], "line_id long, line string, garbled_x int")
    got = {r.line_id: r.garbled for r in mojibake.repaired(df).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


# --- copies -----------------------------------------------------------------------------------------------------


def records(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, line string, delim string, key array<string>, loaded_at timestamp").withColumn("n", F.lit(1)).withColumn("bucket", F.lit("x"))


def test_copies(spark):
    rows = [
        (5, "Ab c\tX-1", "\t", ["k"], None),
        (2, "x 1 | AB  C!", "|", ["K."], None),
        (3, "ab c\tx 1", "\t", None, None),
        (4, "AB C;X.1", ";", None, None),
        (6, "c ab\tx 1", "\t", None, None),
        (7, None, "\t", None, None),
        (8, " - ", "\t", ["a"], None),
        (9, "straße", "", [None], None),
        (10, "STRASSE", None, [None], None),
        (11, "áb c\tx 1", "\t", None, None),
    ]
    got = sorted((r.first_id, r.rec_id) for r in copies.copies_found(records(spark, rows)).collect())
    assert got == [(2, 5), (3, 4), (9, 10)]
    assert copies.copies_found(records(spark, rows).where("rec_id < 0")).count() == 0


def test_ledger_equals_one_batch_and_touches_only_its_buckets(spark):
    df = copies.keyed(spark.read.parquet(f"{SF}/keyed_lines.parquet"))
    one = {(r.first_id, r.n) for r in copies.build_ledger(df, batches=1).read().collect()}
    many = copies.build_ledger(df, batches=4, n_buckets=32)
    assert {(r.first_id, r.n) for r in many.read().collect()} == one
    before = many._listing()[0]
    row = df.where("key is not null").limit(1).select("key", many.bucket().alias("b")).first()
    again = df.where(F.col("key") == F.lit(bytes(row.key)))
    assert many.update(again, "more")
    after = many._listing()[0]
    assert {b for b in after if after[b] != before[b]} == {row.b}
    state = {bytes(r.key): r.n for r in many.read().collect()}
    assert state[bytes(row.key)] == 2 * again.count() and sum(state.values()) == sum(n for _, n in one) + again.count()


def test_ledger_adds_a_batch_once_and_drops_what_is_replaced(spark):
    df = copies.keyed(spark.read.parquet(f"{SF}/keyed_lines.parquet"))
    ledger = copies.CopyLedger(spark, rows=df.count())
    assert ledger.update(df, "a") and not ledger.update(df, "a")
    n = ledger.read().agg(F.sum("n")).first()[0]
    assert n == df.where("key is not null").count()
    assert ledger.update(df, "b") and ledger.vacuum() > 0 and ledger.vacuum() == 0
    assert ledger.read().agg(F.sum("n")).first()[0] == 2 * n and not ledger.update(df, "a")
    files = [f for f in ledger.read().inputFiles()]
    assert len(files) == len(ledger._listing()[0])  # one a bucket, without a second shuffle
    with pytest.raises(ValueError):
        ledger.update(df, "a/b")


def test_symbols_tell_records_apart(spark):
    rows = [(1, "5 €", "\t", None, None), (2, "5 £", "\t", None, None), (3, "5€", "\t", None, None), (4, "5 €!", "\t", None, None), (5, "a+b", "\t", None, None), (6, "A b", "\t", None, None)]
    got = sorted((r.first_id, r.rec_id) for r in copies.copies_found(records(spark, rows)).collect())
    assert got == [(1, 4), (5, 6)]


def test_hot_group_of_copies(spark):
    df = spark.range(9000).selectExpr("id as rec_id", "case when id % 3 = 0 then 'Same  Line' else concat('l', id) end as line", "'\t' as delim", "cast(null as array<string>) as key", "timestamp'2030-01-01' as loaded_at")
    got = copies.copies_found(df)
    assert got.count() == 2999 and got.where("first_id <> 0").count() == 0


# --- sentences --------------------------------------------------------------------------------------------------


def paragraphs(n, seed):
    rng = random.Random(seed)
    towns = ["Belmar", "Torin", "Galo", "Wesel", "Maron"]
    kinds = [
        lambda: f"The council of {rng.choice(towns)} kept {rng.randint(1, 900)} pages.",
        lambda: f"Dr. {rng.choice(towns)} met Mr. {rng.choice(towns)} at 9 a.m. on Friday.",
        lambda: f"The price rose by {rng.randint(1, 9)}.{rng.randint(1, 9)} percent!",
        lambda: f'"Is it late?" asked {rng.choice(towns)}.',
        lambda: "Well ... it was never signed.",
        lambda: f"See Fig. {rng.randint(1, 9)} and pp. 4 ff. for details.",
    ]
    out, ends = [], []
    for _ in range(n):
        parts = [rng.choice(kinds)() for _ in range(rng.randint(1, 6))]
        text, at = "", []
        for p in parts:
            text += (" " if text else "") + p
            at.append(len(text))
        out.append(text)
        ends.append(at)
    return out, ends


def test_sentences_held_out_accuracy():
    lines, _ = paragraphs(1500, 1)
    w, threshold = sentences.train(lines)
    test, ends = paragraphs(300, 2)
    got = sentences.boundaries(test, w, threshold)
    right = sum(len(set(a) & set(b)) for a, b in zip(got, ends))
    assert right / sum(map(len, got)) > 0.97 and right / sum(map(len, ends)) > 0.97


def test_sentences_edges():
    w = np.zeros(sentences.DIM + 1)
    assert sentences.boundaries([None, "", "   ", " a b ", "no end"], w, 2.0) == [[], [], [], [4], [6]]
    assert sentences.train([]) [1] == -1.0
    assert [c[1] for c in sentences.candidates("他说：“走吧。我们走。”好。完")] == [12, 14]


def test_sentence_pieces_cover_lines(spark):
    got = queries.QUERIES["p3_sentences"](spark, SF).groupBy("line_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x["sentence"])).alias("t"))
    src = spark.read.parquet(f"{SF}/split_lines.parquet")
    bare = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    assert src.join(got, "line_id").where(bare(F.col("line")) != bare(F.col("t"))).count() == 0


# --- pieces -----------------------------------------------------------------------------------------------------

ITEM = "item_id long, line string, column_width int, delimiters string, overlap int"


def brute_kind(line, width, delims):
    longest = run = 0
    for c in line:
        run = 0 if c in delims else run + len(c.encode())
        longest = max(longest, run)
    return "forced" if longest > width else "natural"


def test_pieces_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = "abcdé漢़ç ,.-/|😀"
    rows = []
    for i in range(400):
        line = "".join(rng.choices(alphabet, k=rng.randint(0, 90)))
        rows.append((i, line, rng.choice([None, 4, 8, 16, 30]), rng.choice([None, "", " ", ", ", "|", "\\E]", "漢"]), rng.choice([None, 0, 3, 9])))
    rows += [(1000, None, 8, " ", 0), (1001, "x" * 50_000, 100, None, 10), (1002, "", 1, None, 0)]
    df = spark.createDataFrame(rows, ITEM).withColumn("pieces_x", F.lit(1))
    got = {r.item_id: r for r in pieces.with_pieces(df).collect()}
    for i, line, width, delims, over in rows:
        w, d, o = width or 80, delims if delims is not None else pieces.DELIMITERS, over or 0
        p = got[i].pieces
        if line is None or len(line.encode()) <= w:
            assert p is None
            continue
        raw = [x.piece.encode() for x in p]
        assert b"".join(r[len(r) - x.new_bytes :] for r, x in zip(raw, p)) == line.encode()
        assert all(len(r) <= w for r in raw)
        assert ("forced" if any(x.forced for x in p) else "natural") == brute_kind(line, w, d)
        assert all(len(r) - x.new_bytes <= o for r, x in zip(raw, p))


@pytest.mark.parametrize("unit", ["কি", "கொ", "తె", "ភ្នំ", "မြ", "שָׁ", "é", "👩‍🚀", "👍🏽", "🇩🇪", "❤️", "x⃝"])
def test_characters_are_not_cut_from_their_marks(spark, unit):
    n = len(unit.encode())
    df = spark.createDataFrame([(1, "a" + unit * 9 if unit != "🇩🇪" else "a" + (unit + "b") * 9, n + 3, "", 0)], ITEM)
    for p in pieces.with_pieces(df).first().pieces[1:]:
        assert unicodedata.category(p.piece[0])[0] != "M" and p.piece[0] not in "\u200d\U0001f680\U0001f3fd\U0001f1ea"


def test_marks_are_those_of_unicode():
    text = "".join(chr(c) for c in range(0x20, 0xE01F0) if not 0xD800 <= c < 0xE000)
    raw = text.encode().decode("latin-1")
    import re as _re

    for pat, to in pieces._mark_rules()[:-3]:
        raw = _re.sub(pat, to, raw)
    got = {m.group().translate({ord(a): b for a, b in zip(pieces._MOVED_LEADS, pieces._LEADS)}).encode("latin-1").decode() for m in _re.finditer(pieces._MARK + "[\x80-\xbf]*", raw)}
    want = {c for c in text if unicodedata.category(c)[0] == "M" or c in "\u200c\u200d" or "\U0001f3fb" <= c <= "\U0001f3ff" or "\U000e0020" <= c <= "\U000e007f"}
    assert got == want


def test_wide_overlap(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnop", 10, "", 8), (2, "漢字漢字漢字", 9, "", 8), (3, "a b c d e f g h", 6, " ", 99)], ITEM)
    got = {r.item_id: [p.piece for p in r.pieces] for r in pieces.with_pieces(df).collect()}
    # the rest fits as a whole, which goes before the overlap
    assert got[1] == ["ab", "abcd", "abcdef", "ghijklmnop"]
    assert got[2][0] == "漢" and "".join(got[2])[-1] == "字"
    assert all(len(p.encode()) <= w for i, w in ((1, 10), (2, 9), (3, 6)) for p in got[i])


# --- look-alikes ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reps():
    from collections import Counter

    return {flat: lookalikes.automaton(lookalikes.representatives(Counter(), flat)) for flat in (False, True)}


@pytest.mark.parametrize(
    ("a", "b", "flat"),
    [("ｆｕｌｌ　ｗｉｄｔｈ", "full width", False), ("café", "café", False), ("Аrdat⁠idal", "Ardatidal", False), ("ﬁle", "file", False), ("データ", "ﾃﾞｰﾀ", False),
     ("khảo", "khảo", False), ("ữ", "ữ", False), ("한글", "한글", False), ("𝐛𝐨𝐥𝐝", "bold", False), ("a b", "a b", False),
     ("it’s “so” — œuvre…", "it's \"so\" -- oeuvre...", True), ("й", "й", False)],
)
def test_same_look(reps, a, b, flat):
    assert lookalikes.rewrite(a, reps[flat]) == lookalikes.rewrite(b, reps[flat])


@pytest.mark.parametrize(("a", "b"), [("cafe", "café"), ("Abc", "abc"), ("a1", "al"), ("O", "0"), ("x²", "x2"), ("it’s", "it's"), ("a?", "a"), ("I", "l"), ("テ", "デ")])
def test_other_look(reps, a, b):
    assert lookalikes.rewrite(a, reps[False]) != lookalikes.rewrite(b, reps[False])


@pytest.mark.parametrize(
    ("a", "b"),
    [("ρort", "port"), ("υnit", "unit"), ("օne", "one"), ("հat", "hat"), ("ոot", "not"), ("Ꮪea", "Sea"), ("ꓡamp", "Lamp"), ("Ⲏat", "Hat"), ("ⲟne", "one"), ("ҽnd", "end"),
     ("τ", "т"), ("κ", "к"), ("ab\U000e0041c", "abc"), ("a\U000e0100b", "ab"), ("ﬁ\u200bn\u00ada", "fina")],
)
def test_same_look_across_scripts(reps, a, b):
    assert lookalikes.rewrite(a, reps[False]) == lookalikes.rewrite(b, reps[False])


def test_members_of_a_class_hold_no_other():
    for flat in (False, True):
        for ms in lookalikes.classes(flat).values():
            assert not any(m and m != k and m in k for m in ms for k in ms)


def test_rewriting_in_circles_ends():
    a = lookalikes.automaton({"ab": "ba", "ba": "ab"})
    assert lookalikes.rewrite("ab", a) == lookalikes.rewrite("ba", a) == "ab"


def test_pruned_representatives_rewrite_alike():
    from collections import Counter

    texts = ["caf\u0065\u200d\u0301 \uff41bc", "dеlta ﬁne", "Ω\u0300 tе\u0301st"]
    for flat in (False, True):
        seen = Counter(c for t in texts for c in t)
        few, every = lookalikes.representatives(seen, flat), lookalikes.representatives(Counter({**{chr(i): 0 for i in range(0x30000) if not 0xD800 <= i < 0xE000}, **seen}), flat)
        assert len(few) < len(every) // 10
        assert [lookalikes.rewrite(t, lookalikes.automaton(few)) for t in texts] == [lookalikes.rewrite(t, lookalikes.automaton(every)) for t in texts]


def test_no_two_ascii_letters_share_a_class():
    for flat in (False, True):
        for ms in lookalikes.classes(flat).values():
            assert len([m for m in ms if len(m) == 1 and m.isascii() and m.isalnum()]) <= 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_rewrite_is_stable(text):
    from collections import Counter

    a = lookalikes.automaton(lookalikes.representatives(Counter(), False))
    once = lookalikes.rewrite(text, a)
    assert lookalikes.rewrite(once, a) == once


def test_lookalikes_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("ａ" * 20000,)], "t string")
    got = [r[0] for r in df.select(lookalikes.canonical(F.col("t"), {"ａ": "a"}, spark)).collect()]
    assert got == [None, "", "a" * 20000]


# --- token ids --------------------------------------------------------------------------------------------------


def test_ids_against_public_library(spark):
    import tiktoken

    ranks = tokenize.load_ranks(f"{tokenize.TOKENIZERS}/{tokenize.VOCABULARY}")
    assert all(base64.b64decode(base64.b64encode(k)) == k for k in list(ranks)[:10])
    lib = tiktoken.Encoding("t", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", "<|endoftext|> a", "  \n\t x", "aaaa" * 3000, "漢字" * 700, "\u0000é😀"] + ["".join(rng.choices("abc é漢 \n'01.😀", k=60)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9999, None)]
    got = {r.i: r.ids for r in spark.createDataFrame(rows, "i long, t string").select("i", tokenize.token_ids("t").alias("ids")).collect()}
    assert got[9999] == [] and got[0] == []
    assert all(got[i] == lib.encode_ordinary(t) for i, t in enumerate(texts))
    assert all(lib.decode(got[i]) == t for i, t in enumerate(texts))
    for w in (b"abcabc" * 30, "漢字é".encode() * 30):
        assert tokenize.merge_long(w, ranks) == tokenize.merge_short(w, ranks)


# --- leaks ------------------------------------------------------------------------------------------------------


def brute_run(a, b):
    best, old = 0, defaultdict(int)
    for x in a:
        new = defaultdict(int)
        for j, y in enumerate(b):
            if x == y:
                new[j] = old[j - 1] + 1
                best = max(best, new[j])
        old = new
    return best


@pytest.mark.parametrize("bound", [10**9, 0])
def test_leaks_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", bound)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=25))) for i in range(12)] + [(90, None), (91, "too short")]
    docs = []
    for i in range(60):
        ws = rng.choices(vocab, k=50)
        src = rng.choice(items[:12])[1].upper().split()
        n, a = rng.randint(8, 20), rng.randint(0, 5)
        part = src[a : a + n]
        if i % 3 == 0 and len(part) > 12:
            part[6] = "other"
        docs.append((i, ", ".join(ws[:20] + part + ws[20:])))
    docs += [(100, None), (101, ""), (102, items[0][1])]
    got = {(r.doc_id, r.item_id): r for r in leaks.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, dt in docs:
        for i, it in items:
            n = brute_run(leaks.words_of(dt), leaks.words_of(it))
            assert ((d, i) in got and got[d, i].exact_words >= 12) == (n >= 12)
            if n >= 12:
                assert got[d, i].exact_words == n
    assert any(r.substitutions == 1 for r in got.values())


def test_leaks_with_a_word_exchanged_anywhere(spark):
    words = [f"w{k}" for k in range(13)]
    docs, want = [], {}
    for n in (12, 13):
        for k in range(1, n - 1):
            want[100 * n + k] = n
            docs.append((100 * n + k, " ".join(["before", *words[:k], "other", *words[k + 1 : n], "after"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r.doc_id: r.words for r in leaks.overlaps(df, items).collect()} == want


# --- truncation -------------------------------------------------------------------------------------------------


def test_censored_fit_recovers_distribution():
    rng = np.random.default_rng(6)
    x = np.exp(rng.normal(6, 0.8, 20000))
    limit = 600
    below = np.log(x[x < limit])
    mu, sd = truncation.censored_fit(len(below), below.sum(), (below**2).sum(), (x >= limit).sum(), limit, 400)
    assert abs(mu - 6) < 0.05 and abs(sd - 0.8) < 0.05


def test_truncation(spark):
    rng = random.Random(7)
    rows, cut = [], set()
    for i in range(3000):
        text = " ".join(f"The council of town {rng.randint(1, 99)} kept the old index of names." for _ in range(rng.randint(1, 9)))
        source = "short" if i % 3 == 0 else "long"
        if source == "short" and len(text) > 300:
            if not text[:300].endswith("."):
                cut.add(i)
            text = text[:300]
        elif i % 50 == 1:
            text = text[: rng.randint(20, 40)] + "�"
            cut.add(i)
        elif i % 50 == 2:
            text += "\n— Wesel"
        rows.append((i, source, text))
    rows += [(5000, None, None), (5001, "long", ""), (5002, "long", " \n"), (5003, None, "Title Of This Piece Only")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(1))
    got = {r.doc_id for r in truncation.judged(df.select("doc_id", "source", "text")).where("cut").collect()}
    assert len(got & cut) / len(cut) > 0.98 and len(got - cut) <= 2
    assert math.isfinite(truncation.censored_fit(0, 0, 0, 5, 100)[0])


def test_rarely_reached_limit(spark):
    rng, most = random.Random(11), 700
    rows, cut = [], set()
    for i in range(most):
        town = rng.choice(["Wesel", "Köln", "Düren"])
        text = " ".join(f"The council of {town} kept the {'very ' * rng.randint(0, 9)}old {'x' * rng.randint(1, 9)} index." for _ in range(max(1, round(math.exp(rng.gauss(1.35, 0.6))))))
        if len(text) > 1000:
            text = text[:999].rstrip(". ") + "…"
            text = text + "…" * (1000 - len(text))
            cut.add(i)
        rows.append((i, "crawl", text))
    rows += [(most + i, "crawl", "Copies of one text have the same length by their nature, which is no limit of any kind, so") for i in range(30)]
    assert 5 < len(cut) < 0.02 * most
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [(r.unit, r.size) for r in truncation.limits(truncation.with_endings(df)).collect()] == [("n", 1000)]
    got = {r.doc_id for r in truncation.judged(df).where("cut").collect()}
    assert cut <= got and not got & ({*range(most)} - cut)


# --- the queries ------------------------------------------------------------------------------------------------

COLUMNS = {
    "p1_found": ["line_id"], "p2_found": ["first_id", "rec_id"], "p3_found": ["line_id", "end_pos"], "p4_found": ["item_id", "kind"],
    "p5_found": ["text_id", "field", "term_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_columns(spark, name):
    assert queries.QUERIES[name](spark, SF).columns == COLUMNS[name]
