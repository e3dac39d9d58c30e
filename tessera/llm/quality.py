"""Quality rules, lines first: lines that fail are removed, then documents that lose too much text are rejected.

A line with a word fails if one of these holds, each a share of its own length:
- punctuation: it has no sentence mark at all, or runs of marks ('!!', '??') are too many
- navigation: three or more menu separators, close together
- boilerplate: a short line holding a stock phrase of web pages
- symbols: too many of # * $ % & | < >
A document is rejected outright if it has under 10 words or over a fifth of its words lie in repeated 5-word windows;
else if over LOST_PERCENT of its words stood in removed lines.

Nulls: a null text has no words and is rejected; a null doc_id is kept. Empty texts: rejected. Repeated rows and ties:
each row is judged alone. Very long texts: everything is linear but for one sort of a text's window hashes, made
only where a window repeats. No shuffle. Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, table, words

MIN_WORDS, REPEAT_PERCENT, LOST_PERCENT = 10, 20, 30
SYMBOLS = "#*$%&|<>"
#: Stock phrases of web pages, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies",
    "enable javascript", "lorem ipsum", "click here", "read more", "sign up", "log in", "skip to content", "subscribe to our",
    "share on facebook", "share on twitter", "follow us on", "back to top",
)
#: Menu separators, and marks that a sentence holds.
SEPARATORS, MARKS = "|»›", ".!?…,;:。！？、，；：؟।"
BOILERPLATE_CHARS = 200


def count_of(text: Column, chars: str) -> Column:
    """How many of these characters the text has; texts without any cost one search."""
    return F.when(text.rlike(f"[{chars}]"), F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def line_fails(line: Column) -> Column:
    n = F.length(line)
    pairs = lambda mark: F.when(F.contains(line, F.lit(mark)), n - F.length(F.replace(line, F.lit(mark), F.lit("")))).otherwise(0)
    runs, menu, odd = (pairs("!!") + pairs("??")) / 2, count_of(line, SEPARATORS), count_of(line, SYMBOLS)
    stock = F.exists(F.array(lower_ascii(line)), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in BOILERPLATE)))
    return has_word(line) & (
        ~line.rlike(f"[{MARKS}]") | ((runs >= 3) & (runs * 25 >= n)) | ((menu >= 3) & (menu * 25 >= n))
        | ((odd > 0) & (odd * 20 >= n)) | ((n <= BOILERPLATE_CHARS) & stock)
    )


def repeated_words(hashes: str) -> Column:
    """Words under a 5-word window whose hash comes twice or more, given the windows' hashes in order."""
    return F.expr(f"""
      CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0 ELSE
        aggregate(array(sort_array(transform({hashes}, (h, i) -> struct(h, i)))), 0, (z, s) ->
          aggregate(array(sort_array(filter(transform(s, (x, k) ->
              if(coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false), x.i, -1)), i -> i >= 0))), 0, (y, p) ->
            aggregate(transform(p, (i, k) -> least(5, coalesce(get(p, k + 1) - i, 5))), 0, (a, b) -> a + b)))
      END""")


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base figures, base_failed, n_lost, kept and clean_text; columns of docs of these names give way."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost", "kept", "clean_text"]
    body = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c not in made]
    own = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_own")
    split = docs.select(own, body.alias("_t"), words(body).alias("_w"), F.split(body, "\n").alias("_lines"))
    hashed = split.select(
        "*",
        # bound to a variable: a filter pushed down to here would otherwise split the text again for each window
        F.expr("transform(array(_w), w -> CASE WHEN size(w) < 5 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END)[0]").alias("_h"),
        F.filter("_lines", line_fails).alias("_bad"),
        F.filter("_lines", has_word).alias("_full"),
    )
    lost = F.aggregate("_bad", F.lit(0), lambda n, line: n + F.size(words(line)))
    figures = hashed.select(
        "_own", "_lines", "_bad",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count_of(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeated_words("_h").cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("n_lost"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    clean = F.when(F.size("_bad") == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(F.filter("_lines", lambda x: ~line_fails(x)), "\n"))
    return figures.select(
        *(F.col(f"_own.`{c}`") for c in rest), *made[:5], failed.alias("base_failed"), "n_lost",
        (~failed & (100 * F.col("n_lost") <= LOST_PERCENT * F.col("n_words"))).alias("kept"), clean.alias("clean_text"),
    )


def cleaned(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, without the lines that fail."""
    # the row number keeps the filter above the figures: pushed below, it would compute the words again for each use
    out = judged(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(text).alias("text")))
    out = out.withColumn("_row", F.monotonically_increasing_id()).where("kept AND _row >= 0")
    made = {text: F.col("clean_text"), n_chars: F.length("clean_text").cast("long")}
    return out.select(*(made.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text", "clean_text")


_HAS_WORD = "regexp_matches(l, '[^\\x20\\x09-\\x0D]')"
_STOCK = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
ORACLE_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n FROM r GROUP BY rid),
l AS (SELECT rid, l, length(l) AS n, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
lf AS (SELECT *, {_HAS_WORD} AND (
    NOT regexp_matches(l, '[{MARKS}]')
    OR ((2 * n - length(replace(l, '!!', '')) - length(replace(l, '??', ''))) / 2 >= 3 AND (2 * n - length(replace(l, '!!', '')) - length(replace(l, '??', ''))) / 2 * 25 >= n)
    OR (n - length(regexp_replace(l, '[{SEPARATORS}]', '', 'g')) >= 3 AND (n - length(regexp_replace(l, '[{SEPARATORS}]', '', 'g'))) * 25 >= n)
    OR (n - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) * 20 >= n
    OR (n <= {BOILERPLATE_CHARS} AND ({_STOCK}))) AS bad FROM l),
x AS (SELECT rid, coalesce(sum(nw) FILTER (bad), 0) AS lost, count(*) FILTER ({_HAS_WORD}) - count(DISTINCT l) FILTER ({_HAS_WORD}) AS dup FROM lf GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS n_lost
  FROM d JOIN w USING (rid) JOIN x USING (rid) LEFT JOIN n USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * n_lost <= {LOST_PERCENT} * n_words AS kept FROM f
"""
