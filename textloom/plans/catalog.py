"""Every core query by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules, truecase
from textloom.functions.hashing import corpus_hash, murmur64_column
from textloom.functions.splitter import split_text
from textloom.functions.tokenizer import detokenize_lines, tokenize, tokenize_sql
from textloom.functions.unicode import process_unicode, unescape_html
from textloom.operators import clean, dedupe, docs64, fold, pipe, shard, stats
from textloom.operators.fields import selected_fields
from textloom.plans.pipelines import newswire_extract, resplit, text_pipeline
from textloom.session import scratch_dir, table
from textloom.sources import newswire, warc
from textloom.sources.text import decompress
from textloom.streaming import streams

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def crawl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_lines").select("line_id", "line")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parallel_lines").select("pair_id", "line0", "line1")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


# --- deduplication, sets, keyed state ---------------------------------------------------------------------------


@query("SELECT min(line_id) AS line_id, line FROM crawl_lines GROUP BY line")
def dedupe_lines(spark, d):
    return dedupe.dedupe(crawl(spark, d), order=["line_id"])


_KEY2 = """SELECT rec_id, line, CASE WHEN n > 1 THEN f[2] || CASE WHEN len(f) > n AND n = 2 THEN chr(9) ELSE '' END END AS k
FROM (SELECT rec_id, line, f, CASE WHEN f[-1] = '' THEN len(f) - 1 ELSE len(f) END AS n
      FROM (SELECT rec_id, line, string_split(line, chr(9)) AS f FROM keyed_lines))"""


@query(f"SELECT l.rec_id, l.line FROM keyed_lines l JOIN (SELECT min(rec_id) AS rec_id FROM ({_KEY2}) GROUP BY line IS NULL, k) m USING (rec_id)")
def dedupe_keyed(spark, d):
    return dedupe.dedupe(table(spark, d, "keyed_lines").select("rec_id", "line"), order=["rec_id"], spec="2")


@query("""SELECT rec_id, list_transform(list_filter(string_split(line, chr(9)), lambda x, i: i IN (1, 3, 4) AND NOT (x = '' AND i = len(string_split(line, chr(9))))), lambda x: x) AS fields
FROM keyed_lines WHERE line IS NOT NULL""")
def select_fields(spark, d):
    df = table(spark, d, "keyed_lines").where("line is not null")
    return df.select("rec_id", selected_fields(F.col("line"), "1,3-4").alias("fields"))


@query("""WITH a AS (SELECT * FROM parallel_lines WHERE pair_id IN (SELECT min(pair_id) FROM parallel_lines GROUP BY line0))
SELECT pair_id, line0, line1 FROM a WHERE pair_id IN (SELECT min(pair_id) FROM a GROUP BY line1)""")
def dedupe_parallel(spark, d):
    return dedupe.dedupe_parallel(pairs(spark, d), order=["pair_id"])


_STRIP = "trim({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"


@query(f"""SELECT min(line_id) AS line_id, line FROM (SELECT line_id, {_STRIP.format('line')} AS line FROM crawl_lines WHERE line IS NOT NULL)
WHERE NOT starts_with(line, '{dedupe.MAGIC}') AND line NOT IN (SELECT {_STRIP.format('line0')} FROM parallel_lines WHERE line0 IS NOT NULL) GROUP BY line""")
def commoncrawl_dedupe(spark, d):
    gone = table(spark, d, "parallel_lines").select(F.col("line0").alias("line"))
    return dedupe.commoncrawl_dedupe(crawl(spark, d), gone, order=["line_id"])


@query("SELECT line_id, line FROM crawl_lines c WHERE NOT EXISTS (SELECT 1 FROM parallel_lines p WHERE p.line0 = c.line)")
def subtract_lines(spark, d):
    return dedupe.subtract_lines(crawl(spark, d), table(spark, d, "parallel_lines").select(F.col("line0").alias("line")))


_KEY1 = """SELECT line_id, line, line IS NULL AS none, CASE WHEN n >= 1 THEN f[1] || CASE WHEN len(f) > n AND n = 1 THEN ' ' ELSE '' END END AS k
FROM (SELECT line_id, line, f, CASE WHEN f[-1] = '' THEN len(f) - 1 ELSE len(f) END AS n FROM (SELECT line_id, line, string_split(line, ' ') AS f FROM crawl_lines))"""


@query(f"""WITH k AS ({_KEY1}), m AS (SELECT none, k, min(line_id) AS id FROM k GROUP BY none, k)
SELECT k.line_id, k.line, md5(l.line) AS mapped FROM k JOIN m ON k.none = m.none AND k.k IS NOT DISTINCT FROM m.k JOIN crawl_lines l ON l.line_id = m.id""")
def cache_map(spark, d):
    return dedupe.memoize(crawl(spark, d), lambda c: F.md5(c.cast("binary")), order=["line_id"], spec="1", delim=" ")


_SIX = "concat_ws(chr(9), pair_id, pos, corpus, lang1, replace(coalesce(line0, ''), chr(9), ' '), replace(coalesce(line1, ''), chr(9), ' '))"


@query(f"""WITH t AS (SELECT pair_id, string_split({_SIX}, chr(9)) AS f FROM parallel_lines),
m AS (SELECT f[3] AS a, f[4] AS b, arg_min(f[5], pair_id) AS v FROM t GROUP BY ALL)
SELECT pair_id, array_to_string(f[1:4] || [v] || f[6:], chr(9)) AS line FROM t JOIN m ON f[3] = a AND f[4] = b""")
def substitute(spark, d):
    flat = lambda c: F.translate(F.coalesce(c, F.lit("")), "\t", " ")
    df = table(spark, d, "parallel_lines").withColumn("lang1", F.col("lang1"))
    df = df.select("pair_id", F.concat_ws("\t", F.col("pair_id").cast("string"), F.col("pos").cast("string"), "corpus", "lang1", flat(F.col("line0")), flat(F.col("line1"))).alias("line"))
    return dedupe.substitute(df, order=["pair_id"])


@query("""WITH w AS (SELECT line_id, string_split_regex(line, '[\\x00\\t\\r\\n ]+') AS l FROM crawl_lines WHERE line IS NOT NULL),
t AS (SELECT line_id, i, l[i] AS word FROM (SELECT line_id, l, unnest(range(1, len(l) + 1)) AS i FROM w)),
m AS (SELECT word, min({'a': line_id, 'b': i}) AS spot FROM t WHERE word <> '' GROUP BY word)
SELECT word, row_number() OVER (ORDER BY spot) AS id FROM m""")
def vocab(spark, d):
    return dedupe.vocab(crawl(spark, d), order=["line_id"])


# --- filters ----------------------------------------------------------------------------------------------------


@query("SELECT line_id, line FROM crawl_lines WHERE strlen(line) <= 2000")
def remove_long_lines(spark, d):
    return crawl(spark, d).where(clean.short_enough(F.col("line")))


@query("SELECT line_id, line FROM crawl_lines WHERE line IS NOT NULL")
def remove_invalid_utf8(spark, d):
    return crawl(spark, d).where(clean.valid_utf8(F.col("line")))


_SPACES = "[\\t\\n\\v\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _clean_sql(scripts: str = "") -> str:
    common = "length(regexp_replace({0}, '[^\\p{{Common}}\\p{{Inherited}}]', '', 'g'))"
    field = f"""(NOT regexp_matches({{0}}, '[\\x00-\\x08\\x0A-\\x0C\\x0E-\\x1F]') AND length({{0}}) >= 30
      AND NOT (({common} - len(regexp_extract_all({{0}}, '{_SPACES.replace('{', '{{').replace('}', '}}')}')))::FLOAT > 0.2::FLOAT * length({{0}})::FLOAT)
      AND NOT (length({{0}}) > 200 AND len(regexp_extract_all({{0}}, '\\p{{{{P}}}}'))::FLOAT < 0.01::FLOAT * length({{0}})::FLOAT)
      AND len(list_filter(range(1, greatest(length({{0}}) - 3, 1)), lambda i: {{0}}[i:i+4] = repeat({{0}}[i:i], 5) AND NOT regexp_matches({{0}}[i:i], '{_SPACES.replace('{', '{{').replace('}', '}}')}'))) = 0"""
    if scripts:
        field += f"\n AND (length({{0}}) = {common} OR NOT (length(regexp_replace({{0}}, '[^{scripts.replace('{', '{{').replace('}', '}}')}]', '', 'g'))::FLOAT / (length({{0}}) - {common})::FLOAT < 0.9::FLOAT))"
    field += ")"
    field = field.replace("{{{{", "{{").replace("}}}}", "}}").format("f")
    return f"""WITH s AS (SELECT line_id, line, unnest(string_split(line, chr(9))) AS f, unnest(range(1, len(string_split(line, chr(9))) + 1)) AS k, len(string_split(line, chr(9))) AS n FROM crawl_lines WHERE line IS NOT NULL)
SELECT line_id, any_value(line) AS line FROM s GROUP BY line_id HAVING bool_and(CASE WHEN k = n AND f = '' THEN true ELSE {field} END)"""


@query(_clean_sql())
def simple_cleaning(spark, d):
    return crawl(spark, d).where(clean.simple_cleaning(F.col("line")))


@query(_clean_sql("\\p{Latin}"))
def simple_cleaning_latin(spark, d):
    return crawl(spark, d).where(clean.simple_cleaning(F.col("line"), scripts=["Latin"]))


@query("SELECT pair_id, line0, line1 FROM parallel_lines WHERE strlen(line0) <= 120 AND strlen(line1) <= 120")
def filter_parallel(spark, d):
    return clean.filter_parallel(pairs(spark, d), lambda c: clean.short_enough(c, 120))


@query("SELECT count(*) FILTER (strlen(line) <= 120) AS kept, count(*) AS total, count(*) FILTER (strlen(line) <= 120) / count(*) AS ratio FROM crawl_lines")
def kept_ratio(spark, d):
    return clean.kept_ratio(crawl(spark, d), clean.short_enough(F.col("line"), 120))


# --- statistics, hashes, shards ---------------------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT line_id, unnest(string_split_regex(line, '[\\t-\\r ]+')) AS token FROM crawl_lines),
n AS (SELECT count(*) AS n FROM crawl_lines)
SELECT token, round(ln(n) - ln(count(*)), 9) AS idf FROM t, n WHERE token <> '' GROUP BY token, n""")
def idf(spark, d):
    return stats.idf(crawl(spark, d)).withColumn("idf", F.round("idf", 9))


@query()
def order_independent_hash(spark, d):
    return corpus_hash(crawl(spark, d))


@query()
def line_hashes(spark, d):
    return crawl(spark, d).select("line_id", murmur64_column(F.col("line")).alias("hash"))


@query()
def shard_sizes(spark, d):
    n = shard.shard_number(F.col("line"), 4, exact=True)
    return crawl(spark, d).where("line is not null").groupBy(n.alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT line, 1::BIGINT AS shards FROM crawl_lines WHERE line IS NOT NULL")
def shard_once(spark, d):
    """Each distinct line and the number of shards that hold it: always one."""
    df = crawl(spark, d).where("line is not null").withColumn("shard", shard.shard_number(F.col("line"), 8))
    return df.groupBy("line").agg(F.count_distinct("shard").alias("shards"))


# --- base64 documents -------------------------------------------------------------------------------------------


def encoded(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc_no"), docs64.encode(F.col("text")).alias("b64"))


@query("SELECT doc_id AS doc_no, to_base64(encode(text)) AS b64 FROM documents")
def base64_encode(spark, d):
    return encoded(spark, d)


@query("SELECT doc_id AS doc_no, text FROM documents")
def base64_decode(spark, d):
    return encoded(spark, d).select("doc_no", docs64.text(F.col("b64")).alias("text"))


@query("""SELECT doc_no, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT doc_no, l, unnest(range(1, len(l) + 1)) AS i FROM
(SELECT doc_id AS doc_no, list_filter(string_split(replace(text, chr(9), ' '), chr(10)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL))""")
def base64_number(spark, d):
    return docs64.number_lines(encoded(spark, d))


@query("SELECT doc_id AS doc_no, to_base64(encode(text)) AS b64 FROM documents")
def base64_drop_invalid(spark, d):
    return encoded(spark, d).select("doc_no", docs64.drop_invalid(F.col("b64")).alias("b64"))


@query("""SELECT doc_id AS doc_no, CASE WHEN text = '' THEN '' ELSE to_base64(encode(
  'x' || replace(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10), chr(10) || 'x') || CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END)) END AS b64
FROM documents""")
def base64_filter(spark, d):
    return docs64.map_lines(encoded(spark, d), lambda lines: lines.withColumn("line", F.concat(F.lit("x"), "line")))


@query("""WITH w AS (SELECT site AS stream, line_id AS pos, coalesce(line, '') = '' AS blank, line,
  sum((coalesce(line, '') = '')::INT) OVER (PARTITION BY site ORDER BY line_id) - (coalesce(line, '') = '')::INT AS doc_no FROM crawl_lines)
SELECT stream, doc_no::BIGINT AS doc_no, to_base64(encode(coalesce(string_agg(CASE WHEN NOT blank THEN line || chr(10) END, '' ORDER BY pos), ''))) AS b64 FROM w GROUP BY stream, doc_no""")
def docenc(spark, d):
    return docs64.docenc(table(spark, d, "crawl_lines").select(F.col("site").alias("stream"), F.col("line_id").alias("pos"), "line"))


@query("""SELECT doc_no, (i - 1)::INT AS line_no, (doc_no + 1)::VARCHAR || chr(9) || l[i] AS line FROM
(SELECT doc_id AS doc_no, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)""")
def docdec(spark, d):
    return docs64.docdec(encoded(spark, d), number=True)


# --- string functions -------------------------------------------------------------------------------------------


@query(f"SELECT line_id, {rules.escape_sql('line')} AS line FROM crawl_lines")
def escape(spark, d):
    return crawl(spark, d).withColumn("line", rules.escape(F.col("line")))


@query(f"SELECT line_id, {rules.escape_sql('line', undo=True)} AS line FROM crawl_lines")
def deescape(spark, d):
    return crawl(spark, d).withColumn("line", rules.deescape(F.col("line")))


@query(f"SELECT pair_id, {rules.normalize_punctuation_sql('line0')} AS line0, {rules.normalize_punctuation_sql('line1', 'fr')} AS line1 FROM parallel_lines")
def normalize_punctuation(spark, d):
    df = pairs(spark, d)
    return df.select("pair_id", rules.normalize_punctuation(F.col("line0")).alias("line0"), rules.normalize_punctuation(F.col("line1"), "fr").alias("line1"))


@query(f"SELECT pair_id, {rules.heuristics_sql('line0')} AS line0, {rules.heuristics_sql('line1', 'fr', 'intended')} AS line1 FROM parallel_lines")
def heuristics(spark, d):
    df = pairs(spark, d)
    return df.select("pair_id", rules.apply_heuristics(F.col("line0")).alias("line0"), rules.apply_heuristics(F.col("line1"), "fr", "intended").alias("line1"))


@query("SELECT line_id, lower(line) AS line FROM crawl_lines")
def lowercase(spark, d):
    return crawl(spark, d).select("line_id", F.lower("line").alias("line"))


@query()
def unicode_normalized(spark, d):
    return table(spark, d, "unicode_text").select("text_id", process_unicode(F.col("normalize"), normalize=True).alias("normalize"), process_unicode(F.col("flatten"), "en", flatten=True).alias("flatten"))


# What the numbers 128 to 159 stand for in HTML.
_HTML_128 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_NUMBER = f"CASE WHEN {{0}} BETWEEN 128 AND 159 THEN substring('{_HTML_128}', {{0}} - 127, 1) ELSE chr({{0}}) END"


@query(f"""SELECT line_id, replace(array_to_string(list_transform(regexp_extract_all(line, '&#?\\w+;|&|[^&]+'), lambda t:
  CASE WHEN regexp_matches(t, '^&#[0-9]+;$') THEN {_NUMBER.format("t[3:-2]::INT")} WHEN regexp_matches(t, '^&#[xX][0-9a-fA-F]+;$') THEN {_NUMBER.format("('0x' || t[4:-2])::INT")}
  ELSE CASE t WHEN '&quot;' THEN '"' WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&apos;' THEN chr(39) WHEN '&nbsp;' THEN chr(160) WHEN '&eacute;' THEN 'é' ELSE t END END), ''), chr(65279), ' ') AS line
FROM crawl_lines""")
def html_unescaped(spark, d):
    return crawl(spark, d).withColumn("line", unescape_html(F.col("line")))


# --- linguistic operators ---------------------------------------------------------------------------------------


@query(f"SELECT pair_id, {tokenize_sql('line0', 'en')} AS line0, {tokenize_sql('line1', 'fr')} AS line1 FROM parallel_lines")
def tokenized(spark, d):
    return pairs(spark, d).select("pair_id", tokenize(F.col("line0"), "en").alias("line0"), tokenize(F.col("line1"), "fr").alias("line1"))


@query()
def tokenized_penn(spark, d):
    return pairs(spark, d).select("pair_id", tokenize(F.col("line0"), "en", penn=True).alias("line0"))


@query()
def detokenized(spark, d):
    toks = pairs(spark, d).select("pair_id", tokenize(F.col("line0"), "en").alias("line0"))
    return detokenize_lines(toks, "line0")


@query()
def sentences_by_rule(spark, d):
    """Every paragraph by the rules of its language."""
    df = table(spark, d, "split_lines").select("line_id", "lang", "line")
    return resplit(df, lang_col="lang").drop("lang")


_ENDS, _DELAYS = ("(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ws)) + ")" for ws in (truecase.ENDS, truecase.DELAYS))


@query(f"""WITH s AS (SELECT pair_id, line0, list_filter(string_split_regex(line0, '[\t\n\v\f\r ]+'), lambda x: x <> '') AS l FROM parallel_lines),
f AS (SELECT lower(form) AS low, form, count(*) AS n FROM (SELECT unnest(l[2:]) AS form FROM s) GROUP BY ALL),
b AS (SELECT low, arg_min(form, (-n, form)) AS best, bool_or(form = low) AS known FROM f GROUP BY low),
w AS (SELECT pair_id, i, lower(l[i]) AS word FROM (SELECT pair_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
t AS (SELECT *, coalesce(last_value(CASE WHEN word NOT IN {_DELAYS} THEN word IN {_ENDS} END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS start FROM w),
o AS (SELECT pair_id, string_agg(CASE WHEN word IN {_ENDS} OR word IN {_DELAYS} OR (b.known AND NOT start) THEN word ELSE coalesce(b.best, word) END, ' ' ORDER BY i) AS text FROM t LEFT JOIN b ON b.low = t.word GROUP BY pair_id)
SELECT s.pair_id, CASE WHEN line0 IS NOT NULL THEN coalesce(text, '') END AS line0 FROM s LEFT JOIN o USING (pair_id)""")
def truecased(spark, d):
    """Lines in lower case get their case back from a model of all lines."""
    df = pairs(spark, d)
    return df.select("pair_id", truecase.truecase(F.lower("line0"), truecase.train_model(df, "line0")).alias("line0"))


@query("""SELECT line_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  trim(regexp_replace(regexp_replace(line, '[\x00-\x1f]', '', 'g'), ' +', ' ', 'g'), ' '),
  '&', '&amp;'), '|', '&#124;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&apos;'), '"', '&quot;'), '[', '&#91;'), ']', '&#93;'),
  '&lt;([^ ]+) translation=&quot;(.+?)&quot;&gt; (.+?) &lt;/([^ ]+)&gt;', '<\1 translation="\2"> \3 </\4>', 'g') AS line FROM crawl_lines""")
def escape_tidy(spark, d):
    return crawl(spark, d).withColumn("line", rules.tidy_escape(F.col("line")))


def aligned(spark, d) -> DataFrame:
    df = pairs(spark, d).where("line0 is not null and line1 is not null").select(F.col("pair_id").alias("sent"), F.split("line0", " ").alias("source"), F.split("line1", " ").alias("target"))
    n = F.least(F.size("source"), F.size("target"))
    return df.withColumn("links", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), i.alias("j"))))


@query("""WITH a AS (SELECT string_split(line0, ' ') AS s, string_split(line1, ' ') AS t FROM parallel_lines WHERE line0 IS NOT NULL AND line1 IS NOT NULL),
l AS (SELECT s[i] AS source, t[i] AS form FROM (SELECT s, t, unnest(range(2, least(len(s), len(t)) + 1)) AS i FROM a))
SELECT source, lower(form) AS lower_target, form, count(*) AS cnt FROM l GROUP BY ALL""")
def train_case(spark, d):
    return truecase.train_case(aligned(spark, d))


@query("""WITH a AS (SELECT pair_id AS sent, string_split(line0, ' ') AS s, string_split(line1, ' ') AS t FROM parallel_lines WHERE line0 IS NOT NULL AND line1 IS NOT NULL),
w AS (SELECT sent, j, t[j] AS word, CASE WHEN j <= len(s) THEN s[j] END AS source FROM (SELECT sent, s, t, unnest(range(1, len(t) + 1)) AS j FROM a)),
b AS (SELECT source, lower(word) AS low, word AS form, row_number() OVER (PARTITION BY source, lower(word) ORDER BY count(*) DESC, word) AS rn FROM w WHERE j > 1 AND source IS NOT NULL GROUP BY source, word)
SELECT sent, string_agg(coalesce(b.form, word), ' ' ORDER BY j) AS text FROM w LEFT JOIN b ON b.source = w.source AND b.low = lower(w.word) AND rn = 1 GROUP BY sent""")
def apply_case(spark, d):
    df = aligned(spark, d)
    return truecase.apply_case(df, truecase.train_case(df))


_FOLD_SQL = """WITH RECURSIVE b AS (
  SELECT item_id, line, length(line) AS n, list_transform(range(1, length(line) + 1), lambda i: substring(line, i, 1)) AS c,
    list_transform(range(0, length(line) + 1), lambda i: strlen(left(line, i))) AS e
  FROM fold_items WHERE line IS NOT NULL),
d AS (SELECT *, list_transform(c, lambda x: contains(':, -./', x)) AS dl FROM b),
f AS (SELECT *, list_transform(range(1, n + 2), lambda i: CASE WHEN i <= n AND dl[i] THEN i + length(regexp_extract(substring(line, i), '^[-:, ./]+')) ELSE i END) AS stop,
    list_transform(range(1, n + 1), lambda i: CASE WHEN dl[i] THEN i - length(regexp_extract(left(line, i), '[-:, ./]+$')) + 1 ELSE i END) AS start FROM d),
r AS (
  SELECT item_id, 0 AS k, 1 AS s, NULL::VARCHAR AS piece FROM f
  UNION ALL
  SELECT item_id, k + 1, CASE WHEN reach IS NULL THEN n + 2 ELSE after END, substring(line, s, CASE WHEN reach IS NULL THEN n + 1 ELSE after END - s) FROM (
    SELECT *, greatest(cut, least(stop[cut], reach)) AS after FROM (
      SELECT *, coalesce(list_filter(list_transform(string_split(':|,| |-|.|/', '|'), lambda x: start[list_max(list_filter(range(s, reach), lambda i: c[i] = x))]), lambda a: a > s)[1], reach) AS cut FROM (
        SELECT f.*, r.k, r.s, list_min(list_filter(range(r.s + 1, n + 2), lambda i: e[i] >= e[r.s] + 80)) AS reach FROM r JOIN f USING (item_id) WHERE r.s <= n OR (n = 0 AND r.s = 1))))
)
SELECT item_id, (k - 1)::INT AS piece_no, piece FROM r WHERE k > 0"""


@query(_FOLD_SQL)
def folded(spark, d):
    return table(spark, d, "fold_items").select("item_id", F.posexplode(fold.fold(F.col("line")).getField("pieces")).alias("piece_no", "piece"))


@query("SELECT item_id, line FROM fold_items")
def fold_round_trip(spark, d):
    return fold.fold_map(table(spark, d, "fold_items").select("item_id", "line"), lambda x: x, "item_id", skip=True, width=20)


@query("SELECT line_id, translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS line FROM crawl_lines")
def piped(spark, d):
    """Lines through an external program; inner line ends would break the count, so they are none."""
    return pipe.pipe_lines(crawl(spark, d), ["tr", "a-z", "A-Z"])


@query(f"""WITH k AS ({_KEY1}), m AS (SELECT none, k, min(line_id) AS id FROM k GROUP BY none, k)
SELECT k.line_id, k.line, translate(l.line, 'aeiou', 'AEIOU') AS mapped FROM k JOIN m ON k.none = m.none AND k.k IS NOT DISTINCT FROM m.k JOIN crawl_lines l ON l.line_id = m.id""")
def cache_command(spark, d):
    """A command that is asked once for each first field of a line."""
    return dedupe.memoize(crawl(spark, d), ["tr", "aeiou", "AEIOU"], order=["line_id"], spec="1", delim=" ")


@query("""SELECT stream, count(DISTINCT doc_no) AS documents, 0::BIGINT AS with_delimiter FROM
(SELECT site AS stream, sum((coalesce(line, '') = '')::INT) OVER (PARTITION BY site ORDER BY line_id) - (coalesce(line, '') = '')::INT AS doc_no FROM crawl_lines) GROUP BY stream""")
def document_counts(spark, d):
    return docs64.counts(docenc(spark, d))


# --- sources and pipelines --------------------------------------------------------------------------------------


@query("SELECT doc_id AS record_no, text FROM documents WHERE text IS NOT NULL")
def warc_round_trip(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.lit("x").alias("path"), F.col("doc_id").alias("record_no"), F.create_map(F.lit("WARC-Type"), F.lit("conversion")).alias("headers"), F.col("text").cast("binary").alias("payload"))

    @F.pandas_udf("binary")
    def body(s):
        return s.map(lambda raw: next(warc.parse(decompress(bytes(raw))))[2])

    return warc.as_bytes(docs, compress=True).select("record_no", body("record").cast("string").alias("text"))


def newswire_lines(spark, d) -> DataFrame:
    tagged = F.concat(F.array(F.lit("<TEXT>")), F.split(F.translate("text", "\r", ""), "\n", -1), F.array(F.lit("</TEXT>")))
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("stream"), F.posexplode(tagged).alias("pos", "line"))


def _newswire_sql() -> str:
    """Blocks of the documents, each of which is one; none of them closes itself or holds a line that opens one."""
    c = "x"
    for mark, sign in {**dict.fromkeys(newswire.MARKS, ""), **newswire.SIGNS}.items():
        c = f"replace({c}, '{mark}', '{sign}')"
    c = f"replace(replace(regexp_replace({c}, '\\(BC-[^)]*\\)', '', 'g'), '``', '\"'), chr(39) || chr(39), '\"')"
    for name, sign in (("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'"), ("apos", "chr(39)"), ("quot", "chr(34)")):
        c = f"regexp_replace({c}, '&{name};', {sign}, 'gi')"
    return f"""WITH l AS (SELECT doc_id AS stream, list_transform(list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: NOT (x LIKE '<%' AND x LIKE '%>')), lambda x: {c}) AS c
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT stream, c, array_to_string(list_transform(c, lambda x, i: CASE WHEN i > 1 AND c[i - 1] = x THEN '' ELSE x END || CASE WHEN x <> '' AND NOT ends_with(x, '-') THEN ' ' ELSE '' END), '') AS text FROM l)
SELECT stream, 0 AS block_no, text FROM t WHERE len(list_filter(c, lambda x: x <> '')) > 0"""


@query(_newswire_sql())
def newswire_blocks(spark, d):
    return newswire.unwrap(newswire_lines(spark, d))


@query()
def newswire_sentences(spark, d):
    return newswire_extract(newswire_lines(spark, d))


@query(name="text_pipeline")
def text_pipeline_query(spark, d):
    return doc_lines(spark, d).withColumn("line", text_pipeline(F.col("line")))


#: Rows may come so late; keys and windows older than that leave the state.
STREAM_DELAY = "90 days"


@query("""SELECT strftime(loaded_at, '%Y-%m-%d') AS day, token, count(*) AS lines FROM
(SELECT DISTINCT line_id, loaded_at, unnest(string_split_regex(line, '[\t-\r ]+')) AS token FROM crawl_lines WHERE loaded_at IS NOT NULL) WHERE token <> '' GROUP BY ALL""")
def stream_token_counts(spark, d):
    """Lines that hold each token by day of loading, from the crawl as a stream: each micro-batch writes the counts that
    it changed, and the last state of each stands."""
    schema = "line_id long, line string, loaded_at timestamp"
    src = streams.read_line_stream(spark, f"{d}/crawl_lines.parquet*", schema)
    out, mark = scratch_dir(spark, "counts-out"), scratch_dir(spark, "counts-mark")
    counts = streams.token_counts_stream(src, delay=STREAM_DELAY)

    def keep(batch: DataFrame, no: int) -> None:
        batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "token", "lines").write.mode("overwrite").parquet(f"{out}/batch={no}")

    counts.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema("day string, token string, lines long, batch long").parquet(out)
    return written.groupBy("day", "token").agg(F.max_by("lines", "batch").alias("lines"))


@query("SELECT DISTINCT line FROM crawl_lines WHERE strlen(line) <= 2000")
def stream_dedupe(spark, d):
    """The crawl as a stream of files: cleaned, then each line once."""
    schema = "line_id long, site string, file_no int, pos long, lang string, line string, fetched_at timestamp, loaded_at timestamp"
    src = streams.read_line_stream(spark, f"{d}/crawl_lines.parquet*", schema)
    out, mark = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-mark")
    lines = streams.dedupe_stream(streams.clean_stream(src), delay=STREAM_DELAY).select("line")
    lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("line string").parquet(out)
