"""Line-first quality rules, in DataFrame functions only.

Every line is judged by a punctuation, a navigation and a boilerplate rule; failing lines go, and a document that
loses too much of its words with them is rejected.  All work happens inside the row: there is no shuffle.

Defined cases: a null text counts as empty and fails the base rule; a text of whitespace has no words; lines without
a word are neither judged nor counted; repeated rows are judged alike; all input columns are kept, and columns named
like a result are replaced.  Windows of five words are compared by a 64-bit hash.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the rules, in a syntax that Java and RE2 read alike
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "[|»•·>]"
SHORT = r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){0,2}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$"
TERMINAL = r"[.!?…。！？;:\"'”’»)\]]\s*$"
NAVIGATION = (r"(?i)^[\s>|»•·-]*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|"
              r"skip to content|about us|contact us|site ?map|read more|share|subscribe)[\s>|»•·:.-]*$")
NAVIGATION_BAR = r"^\s*[^|»•·>]{1,30}(\s*[|»•·>]\s*[^|»•·>]{1,30}){2,}\s*$"
BOILERPLATE = ["all rights reserved", "copyright (c)", "©", "terms of use", "terms of service", "privacy policy",
               "cookie policy", "use of cookies", "enable javascript", "lorem ipsum", "licensed under",
               "permission is hereby granted", "without warranty of any kind", "spdx-license-identifier"]

MAX_LOST_PERCENT = 50


def words_of(text: Column) -> Column:
    plain = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.translate(text, SPACES, " " * len(SPACES))).otherwise(
        F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " "), "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def line_fails(line: Column, symbols: Column, separators: Column, phrases: Column) -> Column:
    """A line of at most three words fails without an end mark or as a navigation word; any line fails with more
    symbols than words, as a navigation bar or with a boilerplate phrase.  The flags say, for the whole text,
    whether it holds such characters or phrases at all, and so spare most lines the test."""
    return (line.rlike(SHORT) & (~line.rlike(TERMINAL) | line.rlike(NAVIGATION))
            | symbols & (n_symbols(line) > F.size(words_of(line)))
            | separators & line.rlike(NAVIGATION_BAR) | phrases & boilerplate(line))


def line_clean(docs: DataFrame, text_col: str = "text",
               max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """``docs`` with the base counts, ``n_lost_words``, ``clean_text``, ``base_failed`` and ``kept``."""
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lost_lines",
               "n_lost_words", "clean_text", "base_failed", "kept"]
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(*carried, text.alias("__t"), words_of(text).alias("__w"), F.split(text, "\n", -1).alias("__l"),
                      # one number, read three times below: so it is computed once a text and not in every line
                      (text.rlike(f"[{SYMBOLS}]").cast("int") + 2 * text.rlike(SEPARATORS).cast("int")
                       + 4 * boilerplate(text).cast("int")).alias("__flags"))
    # windows of 2, 4 and 5 words from word hashes; most documents have no repeated window and stop there
    two = one.select("*", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    after = lambda a, k: F.slice(a, F.lit(k + 1), F.size(a))
    joined = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    h = F.col("__h")
    two = two.select("*", joined(h, after(h, 1)).alias("__h2"))
    two = two.select("*", joined(F.col("__h2"), after(F.col("__h2"), 2)).alias("__h4"))
    windows = F.slice(joined(F.col("__h4"), after(h, 4)), F.lit(1), F.size(h) - 4)
    has = lambda bit: F.col("__flags").bitwiseAND(bit) > 0
    fails = lambda x: line_fails(x, has(1), has(2), has(4))
    three = two.select("*", F.when(F.size(h) >= 5, windows).otherwise(F.array().cast("array<bigint>")).alias("__g"),
                       F.filter("__l", has_word).alias("__full"), F.filter("__l", lambda x: has_word(x) & fails(x)).alias("__bad"))
    g = F.col("__g")
    four = three.select("*", F.when(F.size(F.array_distinct(g)) == F.size(g), F.array().cast("array<struct<g:bigint,i:int>>"))
                        .otherwise(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).alias("__s"))
    s = F.col("__s")
    n = F.size(s)
    twice = F.filter(s, lambda x, i: x["g"].isNotNull())  # a copy that keeps the sorted array materialised
    same = lambda i, j: F.get(s, i)["g"].eqNullSafe(F.get(s, j)["g"])
    places = F.transform(F.filter(F.transform(twice, lambda x, i: F.struct(
        x["i"].alias("i"), ((i > 0) & same(i, i - 1) | (i < n - 1) & same(i, i + 1)).alias("r"))), lambda x: x["r"]),
        lambda x: x["i"])
    five = four.select("*", F.sort_array(places).alias("__p"))
    covered = F.aggregate("__p", F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")),
                          lambda a: a["n"])
    count = lambda c: F.size(c).cast("bigint")
    six = five.select(
        *carried, "__l", "__bad", "__flags", count("__w").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.when(has(1), n_symbols(F.col("__t"))).otherwise(0).cast("bigint").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), count("__full").alias("n_lines"), count("__bad").alias("n_lost_lines"),
        F.aggregate("__bad", F.lit(0).cast("bigint"), lambda a, x: a + F.size(words_of(x))).alias("n_lost_words"))
    clean = F.when(F.size("__bad") == 0, F.array_join("__l", "\n")).otherwise(
        F.array_join(F.filter("__l", lambda x: ~has_word(x) | ~fails(x)), "\n"))
    seven = six.select("*", clean.alias("clean_text"),
                       ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))
    return seven.select("*", (~F.col("base_failed")
                              & (100 * F.col("n_lost_words") <= max_lost_percent * F.col("n_words"))).alias("kept")).drop("__l", "__bad", "__flags")


def kept_only(judged: DataFrame) -> DataFrame:
    """The rows that are kept.  The random column keeps the optimizer from moving the filter below the judgement, where
    it would compute every array of it again for each element; it drops no row."""
    return judged.withColumn("__any", F.rand(0)).filter("kept and __any >= 0").drop("__any")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9_quality_rules(spark, sf_dir) -> DataFrame:
    return line_clean(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def _sql_re(pattern: str) -> str:
    return pattern.replace("'", "''")


_FAILS = f"""((regexp_matches(x, '{SHORT}') and (not regexp_matches(x, '{_sql_re(TERMINAL)}') or regexp_matches(x, '{NAVIGATION}')))
   or length(x) - length(translate(x, '{SYMBOLS}', '')) > len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))
   or regexp_matches(x, '{NAVIGATION_BAR}') or {" or ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)})"""

ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls, row_number() over () as k from d),
g as (select k, unnest(range(1, greatest(len(ws) - 3, 1))) as i, ws from w),
gs as (select k, i, array_to_string(ws[i:i+4], ' ') as gram from g),
r as (select k, i from (select *, count(*) over (partition by k, gram) as n from gs) where n > 1),
c as (select k, count(distinct i + o) as n_repeat_words from r, (select unnest(range(0, 5)) as o) group by k),
f as (select w.*, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        list_filter(ls, lambda x: {_FAILS}) as bad from w left join c using (k)),
s as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, n_repeat_words,
        coalesce(list_sum(list_transform(bad, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))), 0)::bigint as lost from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost <= {MAX_LOST_PERCENT} * n_words) as kept from s
"""
