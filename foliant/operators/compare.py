"""Comparison of documents by their reports: metrics out of JSON, category scores, winners.

A report is a JSON string per document: validation, writer, tag_delta and font. Absent reports and fields are null; the
first of several names of a field that is there counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The categories with their weights, and grades from the best to the worst.
WEIGHTS = {"pdfua-compliance": 1.0, "metadata-quality": 0.6, "structure-tree": 0.9, "font-health": 0.7, "tag-coverage": 0.8}
GRADES = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D+", "D", "D-", "F"]


def _get(report: str, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(report, f"$.{p}") for p in paths])


def _number(report: str, *paths: str) -> Column:
    return _get(report, *paths).try_cast("double")


def _truth(report: str, path: str) -> Column:
    """Whether a field holds something other than false, null, zero and the empty string."""
    return ~F.coalesce(_get(report, path), F.lit("")).isin("", "false", "null", "0")


def _size(report: str, *paths: str) -> Column:
    return F.coalesce(*[F.json_array_length(F.get_json_object(report, f"$.{p}")) for p in paths])


def document_metrics(docs: DataFrame) -> DataFrame:
    """(id, compliance, metadata, structure, font, coverage): a struct of metrics per category, null where its report is absent."""
    v, w, d, f = "validation", "writer", "tag_delta", "font"
    findings = F.from_json(F.get_json_object(v, "$.findings"), "array<struct<code: string, description: string>>")
    compliance = F.struct(
        _truth(v, "isCompliant").alias("is_compliant"), _number(v, "summary.failedRules").alias("failed_rules"), _number(v, "summary.failedChecks").alias("failed_checks"),
        _get(v, "engine.name").alias("engine"), F.slice(F.transform(F.coalesce(findings, F.array().cast(findings_type())), lambda x: x["code"]), 1, 12).alias("codes"),
    )
    parts = ("metadataPresent", "dcTitleDetected", "pdfUaIdentificationDetected", "infoMatchesXmp")
    passed = sum((_truth(v, f"metadataDiagnostics.{p}").cast("int") for p in parts), F.lit(0))
    metadata = F.struct((passed / len(parts)).alias("score"), _truth(v, "metadataDiagnostics.suspectedVeraPdfMetadataMismatch").alias("suspected_mismatch"))
    typed = _number(d, "delta.totalTypedNodesDelta")
    tree = F.when(_get(d, "delta.structTreeAdded").isNotNull(), _truth(d, "delta.structTreeAdded") | (F.coalesce(typed, F.lit(0.0)) > 0)).otherwise(_truth(v, "metadataDiagnostics.structTreePresent"))
    structure = F.struct(
        tree.alias("has_tree"), _number(d, "delta.totalTypedNodesDelta", "delta.totalTypedNodes").alias("typed_nodes"),
        _number(d, "delta.markedContentOperatorCountDelta", "delta.markedContentOperators").alias("marked_operators"), _number(d, "delta.tableAttributeNodeCountDelta", "delta.tableAttributeNodes").alias("table_nodes"),
    )
    grade = F.coalesce(F.nullif(_get(f, "grade"), F.lit("")), F.nullif(_get(f, "fontGrade"), F.lit("")))
    place = F.array_position(F.array(*map(F.lit, GRADES)), F.upper(grade))
    font = F.struct(
        grade.alias("grade"), F.when(place > 0, (len(GRADES) + 1 - place) / len(GRADES)).otherwise(0.0).alias("grade_score"), F.coalesce(_size(f, "issues", "findings"), F.lit(0)).alias("n_issues"),
        F.coalesce(_size(f, "fonts").cast("double"), _number(f, "fontCount")).alias("n_fonts"), _number(f, "embeddedCount").alias("n_embedded"),
    )
    native, raster = F.coalesce(_number(w, "pagesNative", "pagesRewritten"), F.lit(0.0)), F.coalesce(_number(w, "pagesRaster"), F.lit(0.0))
    about_tags = F.filter(F.coalesce(findings, F.array().cast(findings_type())), lambda x: F.coalesce(x["code"], F.lit("")).rlike("(?i)tag|struct|mark") | F.coalesce(x["description"], F.lit("")).rlike("(?i)tag|struct|mark"))
    coverage = F.struct(
        F.size(about_tags).alias("n_findings"), F.when(F.col(w).isNotNull(), _number(w, "matchRate", "operatorMatchRate")).alias("match_rate"),
        F.when(F.col(w).isNotNull() & (native + raster > 0), native / F.nullif(native + raster, F.lit(0.0))).alias("native_share"), _get(w, "writerMode").alias("mode"), (native + raster).alias("n_pages"),
    )
    present = lambda cond, c: F.when(cond, c)
    return docs.select(
        "id", present(F.col(v).isNotNull(), compliance).alias("compliance"), present(F.get_json_object(v, "$.metadataDiagnostics").isNotNull(), metadata).alias("metadata"), structure.alias("structure"),
        present(F.col(f).isNotNull(), font).alias("font"), coverage.alias("coverage"),
    )


def findings_type() -> str:
    return "array<struct<code: string, description: string>>"


def category_scores(metrics: DataFrame) -> DataFrame:
    """(id, category, score) for every document and category, from 0 to 1."""
    unit = lambda c, by: F.least(F.coalesce(c, F.lit(0.0)) / by, F.lit(1.0))
    m = lambda name: F.col(name)
    rules = F.greatest(F.lit(0.0), 1 - (unit(m("compliance.failed_rules"), 20) * 0.6 + unit(m("compliance.failed_checks"), 50) * 0.4))
    positive = lambda c: F.when(c > 0, c)
    tree = F.when(m("structure.has_tree"), 0.4).otherwise(0.0) + unit(positive(m("structure.typed_nodes")), 100) * 0.3 + unit(positive(m("structure.marked_operators")), 200) * 0.3
    few = lambda n: F.greatest(F.lit(0.0), 1 - n / 10)
    tags = F.coalesce(m("coverage.match_rate"), F.lit(0.0)) * 0.5 + F.coalesce(m("coverage.native_share"), F.lit(0.0)) * 0.3 + few(m("coverage.n_findings")) * 0.2
    scores = {
        "pdfua-compliance": F.when(m("compliance").isNull(), 0.0).when(m("compliance.is_compliant"), 1.0).otherwise(rules), "metadata-quality": F.coalesce("metadata.score", F.lit(0.0)),
        "structure-tree": F.least(tree, F.lit(1.0)), "font-health": F.when(m("font").isNull(), 0.5).otherwise(m("font.grade_score") * 0.7 + few(m("font.n_issues")) * 0.3), "tag-coverage": F.least(tags, F.lit(1.0)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("category"), c.cast("double").alias("score")) for k, c in scores.items()])
    return metrics.select("id", F.inline(rows))


def category_results(scores: DataFrame) -> DataFrame:
    """(category, best, winner, tied): the winner is the only best document with more than 0, else those are tied."""
    best = F.max("score").over(W.partitionBy("category"))
    top = F.collect_list(F.when((F.col("score") == F.col("best")) & (F.col("best") > 0), F.col("id")))
    by = scores.withColumn("best", best).groupBy("category", "best").agg(F.array_sort(top).alias("ids"))
    return by.select("category", "best", F.when(F.size("ids") == 1, F.col("ids")[0]).alias("winner"), F.when(F.size("ids") > 1, F.col("ids")).alias("tied"))


def overall_scores(scores: DataFrame, order: DataFrame) -> DataFrame:
    """(id, total, wins): weighted means over all categories; the first document in ``order`` (id, seq) of the highest total wins.

    Scores are summed as decimals of nine digits, so that a total does not depend on the order of its categories.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("category")]
    totals = scores.groupBy("id").agg((F.sum(F.round(F.col("score") * weight, 9).cast("decimal(20,9)")).cast("double") / F.sum(weight.cast("decimal(9,2)")).cast("double")).alias("total")).join(order, "id")
    first = totals.agg(F.max_by("id", F.struct("total", (-F.col("seq")).alias("s"))).alias("winner"))
    return totals.crossJoin(F.broadcast(first)).select("id", "total", (F.col("id") == F.col("winner")).alias("wins"))
