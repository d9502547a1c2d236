"""Line-first quality rules: judge every line, drop failures, then reject documents that lost too much. DataFrame functions only.

Nulls: a null text has no word and fails the base rules. Empty and very long texts go the same way; nothing is cut.
Repeated rows are judged each for itself. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.llm.common import SPACE, WORD, words

SYMBOLS = r"[#*$%&|<>]"
#: A line that names one of these, and is short, is boilerplate or navigation.
BOILERPLATE = r"all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie policy|enable javascript|subscribe to|click here|copyright \(c\)|lorem ipsum"
NAVIGATION = r"^(home|menu|login|log in|sign in|sign up|next|previous|read more|share this|back to top|skip to content|sitemap)\b"
SHORT_LINE = 20
#: Symbols for each 10 words from which a line fails, and shouted words (ending in two or more exclamation marks).
SYMBOLS_IN_10, SHOUTS_IN_10 = 5, 3
#: How a line of prose ends: with a mark, after which only quotes, brackets and the like may come.
ENDING = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}][^A-Za-z0-9]*$"
#: What sets entries of a menu apart, and what begins a link; a line fails with as many for each 10 words.
SEPARATORS, LINKS = r"[|\x{00B7}\x{00BB}\x{203A}\x{2022}\x{2192}]", r"https?://|www\."
SEPARATORS_IN_10, LINKS_IN_10 = 2, 2
#: Percent of words that a document may lose.
MAY_LOSE = 40
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where the body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(ws: Column) -> Column:
    """Words in windows of eight words that occur twice or more in the array, the first occurrence included."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), x - F.coalesce(F.get(p, j - 1), x - WINDOW))), F.lit(0), lambda a, x: a + x))

        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(in_order, of_sorted))

    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(ws) < WINDOW, 0).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda w: let(hashes(w), covered)))


def line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words fails a rule: symbols, shouting, no end of a sentence, a row of links or entries, navigation, boilerplate."""
    low = F.lower(line)
    return (
        (F.regexp_count(line, F.lit(SYMBOLS)) * 10 > n * SYMBOLS_IN_10)
        | (F.regexp_count(line, F.lit("!!")) * 10 > n * SHOUTS_IN_10)
        | ~line.rlike(ENDING)
        | (F.regexp_count(line, F.lit(SEPARATORS)) * 10 > n * SEPARATORS_IN_10)
        | (F.regexp_count(line, F.lit(LINKS)) * 10 > n * LINKS_IN_10)
        | ((n <= SHORT_LINE) & (low.rlike(BOILERPLATE) | low.rlike(NAVIGATION)))
    )


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``n_lines``, ``n_failed_lines``, ``n_lost_words``, ``base_failed``, ``kept``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    sized = F.transform(lines, lambda x: let(line_words(x), lambda n: F.struct(n.alias("n"), line_fails(x, n).alias("f"))))
    lost = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + F.when(x["f"], x["n"]).otherwise(0))
    per_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    per_word = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("rep")))
    verdicts = let(sized, lambda s: F.struct(F.size(F.filter(s, lambda x: x["f"])).alias("failed"), lost(s).alias("lost")))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.explode(F.array(F.struct(per_word.alias("w"), per_line.alias("l"), verdicts.alias("v"), (F.length("text") - F.regexp_count("text", F.lit(SPACE))).alias("c"), F.regexp_count("text", F.lit(SYMBOLS)).alias("s")))).alias("x"),
    )
    long = lambda c, name: F.col(c).cast("long").alias(name)
    counts = found.select("doc_id", long("x.w.n", "n_words"), long("x.c", "word_chars"), long("x.s", "n_symbols"), long("x.l.dup", "n_dup_lines"), long("x.w.rep", "n_repeat_words"), long("x.l.n", "n_lines"), long("x.v.failed", "n_failed_lines"), long("x.v.lost", "n_lost_words"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counts.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAY_LOSE * F.col("n_words")))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the failing lines of each text removed; blank lines stay. A null text stays null."""
    keep = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(let(line_words(x), lambda n: (n > 0) & line_fails(x, n)), F.lit(False)))
    return docs.withColumn("text", F.array_join(keep, "\n"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, [x FOR x IN regexp_split_to_array(text, '{SPACE}+') IF x <> ''] AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}')),
m AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS n FROM l),
f AS (SELECT r, line, n, len(regexp_extract_all(line, '{SYMBOLS}')) * 10 > n * {SYMBOLS_IN_10} OR len(regexp_extract_all(line, '!!')) * 10 > n * {SHOUTS_IN_10}
        OR NOT regexp_matches(line, '{ENDING}') OR len(regexp_extract_all(line, '{SEPARATORS}')) * 10 > n * {SEPARATORS_IN_10} OR len(regexp_extract_all(line, '{LINKS}')) * 10 > n * {LINKS_IN_10}
        OR (n <= {SHORT_LINE} AND (regexp_matches(lower(line), '{BOILERPLATE}') OR regexp_matches(lower(line), '{NAVIGATION}'))) AS f FROM m),
x AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE f) AS failed, coalesce(sum(n) FILTER (WHERE f), 0) AS lost FROM f GROUP BY r),
y AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(text) - len(regexp_extract_all(text, '{SPACE}')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(coalesce(x.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(x.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(x.lost, 0) AS BIGINT) AS n_lost_words
      FROM d JOIN w USING (r) LEFT JOIN x USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost_words <= {MAY_LOSE} * n_words AS kept
FROM y
"""
