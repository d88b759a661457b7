"""Scores and verdicts over reports: quality metrics, weighted means, comparisons, repair health, font plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of metrics and of comparison categories.
METRIC_WEIGHTS = {"vera_findings": 0.4, "font_coverage": 0.2, "inversions": 0.15, "ocr_confidence": 0.15, "paragraph_quality": 0.1}
CATEGORY_WEIGHTS = {"compliance": 1.0, "metadata": 0.6, "structure": 0.9, "fonts": 0.7, "tags": 0.8}


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def paragraph_quality(paragraphs: DataFrame, key: str) -> DataFrame:
    """Per key: quality of paragraphs (text, page_number) by mean length, number a page and evenness of lengths."""
    n = F.length("text")
    by = paragraphs.groupBy(key).agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd"), F.count("*").alias("n"), F.countDistinct("page_number").alias("pages"))
    m = F.col("mean")
    length = (
        F.when(m < 20, m / 20 * 0.3).when(m < 80, 0.5 + 0.5 * (m - 20) / 60).when(m <= 500, F.lit(1.0))
        .when(m <= 2000, 0.5 + 0.5 * (2000 - m) / 1500).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 - (m - 2000) / 2000)))
    )
    each = F.col("n") / F.greatest("pages", F.lit(1))
    crowd = F.when(each <= 30, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (each - 30) / 70))
    even = F.when((m > 0) & (F.col("n") > 1), F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("sd"), m) / 2)).otherwise(1.0)
    return by.select(key, unit(length * 0.45 + crowd * 0.35 + even * 0.2).alias("paragraph_quality"))


def native_quality(per_page: Column, fonts: Column, text_share: Column) -> Column:
    ops = F.when(per_page < 50, per_page / 50).when(per_page <= 500, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (per_page - 500) / 1500))
    font = F.when(fonts == 0, 0.2).when(fonts <= 10, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (fonts - 10) / 30))
    text = F.when(text_share < 0.15, text_share / 0.15).when(text_share <= 0.85, 1.0).otherwise(0.8)
    return unit(ops * 0.35 + font * 0.25 + text * 0.4)


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the values that are there; null if none is."""
    there = {k: v.isNotNull().cast("int") * weights[k] for k, v in values.items()}
    total = sum((F.coalesce(v, F.lit(0.0)) * weights[k] for k, v in values.items()), F.lit(0.0))
    return F.try_divide(total, sum(there.values(), F.lit(0.0)))


def aggregate_score(vera: Column, font: Column, inversions: Column, ocr: Column, paragraph: Column) -> Column:
    scaled = {"vera_findings": 1 / (1 + vera), "font_coverage": font, "inversions": 1 / (1 + inversions), "ocr_confidence": ocr / 100, "paragraph_quality": paragraph}
    return weighted_mean(scaled, METRIC_WEIGHTS)


def compliance_score(compliant: Column, rules: Column, checks: Column) -> Column:
    zero = F.lit(0)
    loss = F.least(F.coalesce(rules, zero) / 20, F.lit(1.0)) * 0.6 + F.least(F.coalesce(checks, zero) / 50, F.lit(1.0)) * 0.4
    return F.when(compliant, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - loss))


def structure_score(tree: Column, nodes: Column, marked: Column) -> Column:
    part = lambda c, full: F.when(c > 0, F.least(c / full, F.lit(1.0)) * 0.3).otherwise(0.0)
    return F.least(F.when(tree, 0.4).otherwise(0.0) + part(nodes, 100) + part(marked, 200), F.lit(1.0))


def font_score(grade: Column, issues: Column) -> Column:
    return F.coalesce(grade * 0.7 + F.greatest(F.lit(0.0), 1 - issues / 10) * 0.3, F.lit(0.5))


def tag_score(match_rate: Column, native_ratio: Column, findings: Column) -> Column:
    return F.least(F.coalesce(match_rate * 0.5, F.lit(0.0)) + F.coalesce(native_ratio * 0.3, F.lit(0.0)) + F.greatest(F.lit(0.0), 1 - findings / 10) * 0.2, F.lit(1.0))


def verdict(preserved: Column, fidelity: Column, size_ratio: Column, selectable: Column) -> Column:
    """Struct verdict, confidence of native over raster output."""
    step = lambda c, high, a, low, b: F.when(c > high, a).when(c > low, b).otherwise(0.0)
    sure = step(preserved, 0.9, 0.4, 0.7, 0.2) + step(fidelity, 0.85, 0.25, 0.6, 0.1) + F.when(size_ratio < 0.5, 0.2).when(size_ratio < 1, 0.1).otherwise(0.0) + F.when(selectable, 0.15).otherwise(0.0)
    name = F.when((preserved > 0.9) & (fidelity >= 0.85), "native-recommended").otherwise("raster-preferred")
    return F.struct(name.alias("verdict"), F.round(F.least(sure, F.lit(1.0)), 2).alias("confidence"))


def repair_health(errors: Column, warnings: Column, open_errors: Column, open_warnings: Column, total: Column) -> Column:
    loss = open_errors * 0.25 + open_warnings * 0.1 + (errors - open_errors) * 0.05 + (warnings - open_warnings) * 0.02
    return F.when(total == 0, F.lit(1.0)).otherwise(unit(F.round(1 - loss, 3)))


def repair_risk(health: Column, open_errors: Column) -> Column:
    return F.when(health == 1, "clean").when(open_errors >= 3, "critical").when(open_errors >= 1, "high").when(health >= 0.8, "low").otherwise("medium")


def writer_mode(match_rate: Column, marked_share: Column, tagged: Column) -> Column:
    return F.when((marked_share >= 0.5) & tagged, "passthrough").when(match_rate >= 0.8, "native").otherwise("raster")


def fs_type_class(bits: Column) -> Column:
    """Embedding licence of a font by its first matching bit."""
    has = lambda m: bits.bitwiseAND(F.lit(m)) != 0
    return (
        F.when(bits.isNull() | (bits < 0), "unknown").when(has(2), "restricted").when(has(512), "no-subsetting").when(has(256), "bitmap-only")
        .when(has(8), "editable").when(has(4), "preview-print").when(bits == 0, "installable").otherwise("unknown")
    )


def font_plan(standard: Column, embedded: Column, symbolic: Column, differences: Column, subtype: Column, has_map: Column, coverage: Column, repair: Column) -> Column:
    lacking = ~has_map | (coverage < 1)
    return (
        F.when(standard, "substitute-fallback").when(~embedded, "subset-and-embed").when(symbolic & ~differences, "rewrite-encoding")
        .when((subtype == "Type1") & lacking, "synthesize-type0-wrapper").when(lacking & (repair != "impossible"), "inject-to-unicode").when(lacking, "substitute-fallback").otherwise("embed-as-is")
    )


def batch_status(total: Column, queued: Column, running: Column, failed: Column, completed: Column, missing: Column) -> Column:
    return (
        F.when(total == 0, "empty").when((queued > 0) | (running > 0), "processing").when((failed > 0) & (completed > 0), "completed_with_failures")
        .when(failed > 0, "failed").when(missing > 0, "incomplete").otherwise("completed")
    )


def stale_window_ms(heartbeat_ms: Column, check_in_ms: Column, grace_ms: int = 30_000) -> Column:
    return F.greatest(F.coalesce(heartbeat_ms, F.lit(0)) * 3, F.coalesce(check_in_ms, F.lit(0)) * 3, F.lit(grace_ms))


def merge_score(reduction: Column, coherent: Column, over: Column, under: Column, explained: Column, errors: Column, warnings: Column) -> Column:
    """Score of a paragraph merge from its rates, less a penalty for what validators found."""
    total = reduction * 0.15 + coherent * 0.25 + (1 - over) * 0.35 + (1 - under) * 0.15 + explained * 0.10
    return F.greatest(F.lit(0.0), total - (errors * 0.05 + warnings * 0.01))

