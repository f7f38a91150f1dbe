"""Whole-text statistics as Column expressions, shared by the quality operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from framegrain.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once and bound, so that lambdas inside don't compute it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def _covered(hashes: Column) -> Column:
    """Words that lie in windows whose hash repeats; hashes are the windows' in order, five words each."""
    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        at = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.array_compact(at))

    start = F.struct(F.lit(-5).alias("p"), F.lit(0).alias("n"))
    total = F.aggregate(let(tagged, positions), start, lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(5), p - a["p"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0))


def _word_stats(w: Column) -> Column:
    n = F.size(w)
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(n - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)),
    )
    repeated = F.when(n > 5, let(windows, _covered)).otherwise(F.lit(0))
    return F.struct(n.cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"))


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def text_stats(text: Column) -> Column:
    """A struct of counts over the whole text; null counts as empty.

    n_words, word_chars (code points in words), n_symbols, n_upper (A-Z), n_lines and n_dup_lines (lines
    that have a word; those equal to an earlier one), n_repeat_words (words in windows of five words that
    occur twice or more), n_distinct_words. Windows are compared by a 64-bit hash within their text.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, BLANKS) > 0)
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    chars = F.length(text)
    plain = F.struct(
        without(text, BLANKS).cast("long").alias("word_chars"),
        (chars - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (chars - without(text, string.ascii_uppercase)).cast("long").alias("n_upper"),
    )
    return F.struct(plain.alias("plain"), lined.alias("lined"), let(words_of(text), _word_stats).alias("worded"))


STATS = {"n_words": "worded", "word_chars": "plain", "n_symbols": "plain", "n_upper": "plain", "n_lines": "lined", "n_dup_lines": "lined", "n_repeat_words": "worded", "n_distinct_words": "worded"}


def with_stats(df, text_col: str, columns: list[Column]):
    """columns of df and the statistics of text_col."""
    held = df.select(*columns, text_stats(F.col(text_col)).alias("_s"))
    return held.select(*[c for c in held.columns if c != "_s"], *[F.col(f"_s.{part}.{name}").alias(name) for name, part in STATS.items()])
