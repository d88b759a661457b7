"""Operators on pages and their recognition: whether to recognize, whom to trust, which candidate to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.layout import PAGE


def needs_recognition(mode: str, n_blocks: Column, n_chars: Column, coverage: Column, bad_source: Column | None = None, hybrid: bool = False, blocks: int = 1, chars: int = 24, share: float = 0.002) -> Column:
    """Whether a page is recognized: never if off, always if forced or required, else if its text is sparse, or in hybrid mode if it is bad."""
    if mode == "off":
        return F.lit(False)
    if mode in ("force", "required"):
        return F.lit(True)
    sparse = (n_blocks <= blocks) | (n_chars <= chars) | (coverage <= share)
    return sparse | F.coalesce(bad_source, F.lit(False)) if hybrid and bad_source is not None else sparse


def bad_sources(blocks: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc_id, page_number, bad_source): a font that hides recognized text, a trace of a scan, or on three blocks or more a ``share`` of failed tokens."""
    trace = T.is_ocr_font(F.col("font_name")) | T.has_scan_artifact(F.col("text"))
    tokens = F.filter(F.split("text", r"\s+"), lambda t: F.length(t) >= 2)
    by = blocks.withColumns({"n": F.size(tokens), "bad": F.size(F.filter(tokens, T.is_garbage_token))}).groupBy(*PAGE).agg(F.count("*").alias("n_blocks"), F.max(trace).alias("trace"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return by.select(*PAGE, (F.col("trace") | ((F.col("n_blocks") >= 3) & (F.col("n") > 0) & (F.col("bad") >= share * F.col("n")))).alias("bad_source"))


def best_of(candidates: DataFrame, *keys: str) -> DataFrame:
    """The best candidate for each of ``keys``: final (or score where that is zero or missing), score, chars, words, confidence; the first (seq) of equals."""
    final = F.coalesce(F.nullif(F.col("final"), F.lit(0)), F.col("score"))
    w = W.partitionBy(*keys).orderBy(final.desc(), F.desc("score"), F.desc("chars"), F.desc("words"), F.desc("confidence"), "seq")
    return candidates.withColumn("best_rank", F.row_number().over(w)).where("best_rank = 1").drop("best_rank")


def sampled_operators(operators: DataFrame, most: int = 500, chars: int = 200) -> DataFrame:
    """(doc_id, sample): texts of every n-th operator (seq) of a document, about ``most`` of them, cut to ``chars``, which is the rule for telling scripts."""
    w = W.partitionBy("doc_id")
    o = operators.withColumn("i", F.row_number().over(w.orderBy("seq")) - 1).withColumn("n", F.count("*").over(w))
    o = o.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / most))).withColumn("t", F.substring(F.coalesce("text", F.lit("")), 1, chars))
    o = o.where((F.col("i") % F.col("stride") == 0) & (F.col("t") != "")).withColumn("k", F.row_number().over(w.orderBy("seq"))).where(F.col("k") <= most)
    return o.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda s: s["t"]), " ").alias("sample"))
