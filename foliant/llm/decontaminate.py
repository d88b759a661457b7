"""Benchmark decontamination with built-in functions only: a prefix-filtered set join of word windows.

An item's windows are sets of shingles (three words in a row, or the whole window if it is shorter).
A document span can only contain a window if it has all of its shingles, so at containment 1 a single
shingle is a sufficient prefix: the window's rarest, by the counts over the corpus. Documents join on
these prefix shingles alone; the shingle's place gives the one span that can match (positional bound),
which must fit into the document (length bound) and equal the window word by word (verification).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.llm.common import cut, fixed, free_name, lower_ascii, text_of

#: What stands between words: every ASCII character but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    """Length of a window and of a shingle, in words."""

    window: int = 10
    shingle: int = 3
    #: with so many windows at most (some 25 MB) the item side is broadcast, else both sides are shuffled
    broadcast_windows: int = 50_000
    #: tasks that a shingle's places are dealt out to where both sides are shuffled
    salts: int = 16


def match_words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def item_windows(items: DataFrame, p: Decontamination = Decontamination(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: window_id, words, item_ids; items of fewer words are one window, without words none."""
    words = items.select(F.col(id_col).cast("string").alias("item"), match_words(text_of(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (p.window - 1))))
    spans = words.select("item", "w", at.alias("i")).select("item", F.slice("w", F.col("i"), p.window).alias("words"))
    return spans.groupBy("words").agg(F.collect_set("item").alias("item_ids")).withColumn("window_id", F.xxhash64("words"))


def _shingle(n: int, words: str = "w", at: str = "i") -> str:
    """SQL for the hash of the n words from place ``at``."""
    return "xxhash64(" + ", ".join(f"get({words}, {at} + {k})" for k in range(n)) + f", {n})"


def _doc_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Explodes the documents' shingles: the columns of ``docs``, place i (from 0) and hash s."""
    one = lambda n: f"slice(transform(w, (x, i) -> {_shingle(n)}), 1, greatest(size(w) - {n - 1}, 0))"
    if len(sizes) == 1:
        return docs.withColumn("hs", fixed(F.expr(one(sizes[0])))).select(*docs.columns, F.posexplode_outer("hs").alias("i", "s")).where("s IS NOT NULL")
    parts = ", ".join(f"transform({one(n)}, (s, i) -> struct(i, s))" for n in sizes)
    return docs.withColumn("hs", fixed(F.expr(f"concat({parts})"))).select(*docs.columns, F.inline_outer("hs")).where("s IS NOT NULL")


def find_windows(docs: DataFrame, windows: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(key columns of ``docs``, first, last, item_ids) for each place where a window occurs; ``docs`` has an array ``w`` and keys."""
    keys = [c for c in docs.columns if c != "w"]
    windows = cut(windows.withColumn("size", F.least(F.size("words"), F.lit(p.shingle))))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most p.shingle values
    if not sizes:
        return docs.select(*keys, F.lit(0).alias("first"), F.lit(0).alias("last"), F.array().cast("array<string>").alias("item_ids")).where("false")
    by_size = " ".join(f"WHEN {n} THEN transform(sequence(0, size(words) - {n}), i -> struct(i, {_shingle(n, 'words')} AS s))" for n in sizes)
    tokens = windows.select("window_id", "words", "item_ids", F.inline(F.expr(f"CASE size {by_size} END")))
    # Rarity over the whole corpus: only shingles of windows are counted, and partly before the shuffle.
    small = windows.limit(p.broadcast_windows + 1).count() <= p.broadcast_windows
    side = F.broadcast if small else (lambda df: df.hint("shuffle_merge"))
    known = tokens.select("s").distinct()
    counts = _doc_shingles(docs.select("w"), sizes).select("s").join(side(known), "s", "left_semi").groupBy("s").count()
    order = W.partitionBy("window_id", "words").orderBy("n", "s", "i")
    prefix = tokens.join(counts, "s", "left").withColumn("n", F.coalesce("count", F.lit(0))).withColumn("rank", F.row_number().over(order))
    prefix = prefix.where("rank = 1 AND n > 0").select("s", F.col("i").alias("off"), "words", "item_ids")
    first, last = F.col("i") - F.col("off"), F.col("i") - F.col("off") + F.size("words")
    if small:  # the words stay with their row, as nothing is shuffled before the last test
        spans = _doc_shingles(docs, sizes).join(side(prefix), "s").where((first >= 0) & (last <= F.size("w")))
    else:  # only places and hashes are shuffled, and candidates meet their document's words again
        # A shingle may be very common: its rows go to several tasks, and the item side to each of them.
        salt = F.pmod(F.xxhash64("i", *keys), F.lit(p.salts)).cast("int")
        spread = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        spans = _doc_shingles(docs, sizes).drop("w").withColumn("salt", salt).join(side(spread), ["s", "salt"]).where(first >= 0)
        own = docs.select("w", *[F.col(k).alias(f"own_{k}") for k in keys]).dropDuplicates([f"own_{k}" for k in keys])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"own_{k}"))
        spans = spans.join(own, on).where(last <= F.size("w"))
    exact = F.slice("w", first + 1, F.size("words")) == F.col("words")
    return spans.where(exact).select(*keys, first.alias("first"), (last - 1).alias("last"), "item_ids")


def contamination(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted), contaminated.

    Null and empty texts have no words. Rows that agree in id and text get equal results; tied items all
    count. Without documents no row comes out, without items no document is hit. Extra columns are not read.
    The item side is broadcast only where its number of windows, which is counted, is small.
    """
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("t"))
    words = keyed.select("doc_id", "text_hash", fixed(match_words(F.col("t"))).alias("w"))
    spans = find_windows(words, item_windows(items, p), p)
    hit = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    # Words under the union of the spans: what each adds beyond the furthest end so far.
    covered = F.expr("aggregate(at, struct(-1 AS e, 0L AS n), (a, x) -> struct(greatest(a.e, x.last) AS e, a.n + greatest(0, x.last - greatest(a.e, x.first - 1)) AS n), a -> a.n)")
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), covered.alias("n_hit"), "item_ids")
    count = F.regexp_count(lower_ascii(F.col("t")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    out = keyed.select("doc_id", "text_hash", count.alias("n_words"))
    out = out.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left").drop("hit_id", "hit_hash")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """The rows of ``docs`` without any window of an item."""
    bad = contamination(docs, items, p).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    h = free_name(docs, "own_hash")
    out = docs.withColumn(h, F.xxhash64(text_of("text")))
    return out.join(bad, out["doc_id"].eqNullSafe(bad["bad_id"]) & (out[h] == bad["bad_hash"]), "left_anti").drop(h)
