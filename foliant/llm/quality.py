"""Line-first cleaning with built-in functions only.

Each line of a text is judged by punctuation, navigation and boilerplate rules; failing lines and
repeats of earlier lines go, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, fixed, free_name, text_of, words_of

# What the contract calls symbols, and phrases that mark boilerplate.
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy", "terms of service",
    "terms of use", "click here", "subscribe to", "sign up for", "enable javascript", "lorem ipsum",
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the line rules and of the document verdict."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: symbols in a line, in percent of the characters of its words
    max_symbol_percent: int = 10
    #: separators in a line, in percent of its words, and how many at least
    max_separator_percent: int = 20
    min_separators: int = 3
    #: words that end in two or more exclamation marks, in percent of the words
    max_shout_percent: int = 30
    #: a line of so many words without any punctuation mark fails
    unpunctuated_words: int = 12
    #: boilerplate phrases count in lines of so many words at most
    boilerplate_words: int = 30
    #: characters of words that lines may lose, in percent
    max_lost_percent: int = 50


def _n(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def measured(line: Column) -> Column:
    """Struct of a line and its counts, so that no rule counts again."""
    n = lambda pattern: _n(line, pattern)
    return F.struct(line.alias("line"), n(r"[^\x20\x09-\x0D]+").alias("words"), (F.length(line) - n(SPACE)).alias("chars"), n(SYMBOLS).alias("symbols"), n(r"[|»›•]").alias("separators"))


def line_fails(m: Column, rules: QualityRules = QualityRules()) -> Column:
    """Whether a measured line breaks one of the punctuation, navigation or boilerplate rules; a line without words doesn't."""
    line, n_words = m["line"], m["words"]
    symbols = m["symbols"] * 100 > m["chars"] * rules.max_symbol_percent
    navigation = (m["separators"] >= rules.min_separators) & (m["separators"] * 100 > n_words * rules.max_separator_percent)
    shouting = line.contains("!!") & (_n(line, r"!!+(?:[\x20\x09-\x0D]|$)") * 100 > n_words * rules.max_shout_percent)
    bare = (n_words >= rules.unpunctuated_words) & ~line.rlike(r"[.,;:!?…。，]")
    boilerplate = (n_words <= rules.boilerplate_words) & line.rlike("(?i)(?:" + "|".join(BOILERPLATE) + ")")
    return symbols | navigation | shouting | bare | boilerplate


def _repeat_words(windows: str, size: int) -> Column:
    """Words in windows whose hash occurs twice or more: sorts (hash, position) only where a hash repeats."""
    return F.expr(f"""
        CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
          aggregate(
            transform(array(sort_array(transform(array(sort_array(transform({windows}, (h, i) -> struct(h, i)))),
              s -> filter(transform(s, (x, j) -> CASE WHEN get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h THEN x.i END), p -> p IS NOT NULL))[0])),
              p -> aggregate(transform(p, (x, k) -> CAST(least({size}, coalesce(get(p, k + 1) - x, {size})) AS BIGINT)), 0L, (a, b) -> a + b)),
            0L, (a, b) -> a + b) END""")


def quality_verdict(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """Adds struct ``quality``, with underscores in front where ``docs`` has that name, to every row; no row is dropped and no shuffle is needed.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    kept, clean_text (the lines that stay). Null and empty texts have no words and fail the base rule.
    Repeated rows and ties get equal verdicts. Extra columns stay.
    Windows are compared by their 64-bit hashes within one text.
    """
    t, w, h, ls = (free_name(docs, x) for x in ("q_text", "q_words", "q_windows", "q_lines"))
    out = docs.withColumn(t, text_of(text_col)).withColumn(w, fixed(words_of(F.col(t))))
    at = ", ".join(f"get({w}, i + {k})" for k in range(1, 8))
    out = out.withColumn(h, fixed(F.expr(f"CASE WHEN size({w}) < 8 THEN CAST(array() AS ARRAY<BIGINT>) ELSE slice(transform({w}, (x, i) -> xxhash64(x, {at})), 1, size({w}) - 7) END")))
    out = out.withColumn(ls, fixed(F.filter(F.split(F.col(t), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))))
    out = out.withColumn(ls, fixed(F.struct(F.size(ls).alias("n"), F.array_distinct(ls).alias("lines"))))
    clean = F.filter(F.transform(f"{ls}.lines", measured), lambda m: ~line_fails(m, rules))
    out = out.withColumn(ls, fixed(F.struct(F.col(f"{ls}.n").alias("n"), F.size(f"{ls}.lines").alias("d"), clean.alias("clean"))))
    n_chars = F.length(t) - _n(F.col(t), SPACE)
    kept_chars = F.aggregate(f"{ls}.clean", F.lit(0), lambda total, m: total + m["chars"])
    q = free_name(docs, "q_base")
    out = out.withColumn(
        q,
        fixed(F.struct(
            F.size(w).cast("long").alias("n_words"), n_chars.cast("long").alias("word_chars"), _n(F.col(t), SYMBOLS).cast("long").alias("n_symbols"),
            (F.col(f"{ls}.n") - F.col(f"{ls}.d")).cast("long").alias("n_dup_lines"), _repeat_words(h, 8).alias("n_repeat_words"),
            (n_chars - kept_chars).cast("long").alias("lost_chars"), F.array_join(f"{ls}.clean.line", "\n").alias("clean_text"),
        )),
    )
    c = lambda name: F.col(f"{q}.{name}")
    failed = (c("n_words") < rules.min_words) | (c("n_repeat_words") * 100 > c("n_words") * rules.max_repeat_percent)
    kept = ~failed & (c("lost_chars") * 100 <= c("word_chars") * rules.max_lost_percent)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = out.withColumn(free_name(docs, "quality"), F.struct(*[c(n).alias(n) for n in names], failed.alias("base_failed"), c("lost_chars").alias("lost_chars"), kept.alias("kept"), c("clean_text").alias("clean_text")))
    return out.drop(t, w, h, ls, q)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", clean: bool = False) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, with their columns as they were; ``clean`` leaves the lines that stay of their texts."""
    v = free_name(docs, "q_verdict")
    judged = quality_verdict(docs.select(F.struct("*").alias(v), F.col(text_col).alias("text")), rules).filter("quality.kept")
    return judged.select(*[F.col("quality.clean_text").alias(c) if clean and c == text_col else F.col(f"{v}.`{c}`").alias(c) for c in docs.columns])
