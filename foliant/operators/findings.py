"""Findings out of a writer's manifest and a validator's report, both JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import finding_code

_RULES = "array<struct<status: string, ruleStatus: string, clause: string, testNumber: string, description: string, failedChecks: int>>"


def manifest_findings(manifests: DataFrame) -> DataFrame:
    """(id, severity, code) of manifests (id, manifest, tagging_valid): an invalid tree, a root that is no document, tagging that the writer does not claim."""
    get = lambda p: F.get_json_object("manifest", f"$.{p}")
    bad = get("tagging").isNull() | ~F.coalesce("tagging_valid", F.lit(False))
    found = F.array(
        F.when(bad, F.struct(F.lit("error").alias("severity"), F.lit("INVALID_TAGGING_MANIFEST").alias("code"))),
        F.when(~get("tagging.root.type").eqNullSafe(F.lit("Document")), F.struct(F.lit("error").alias("severity"), F.lit("MISSING_DOCUMENT_ROOT").alias("code"))),
        F.when(~get("nativeTaggingApplied").eqNullSafe(F.lit("true")), F.struct(F.lit("warning").alias("severity"), F.lit("NATIVE_TAGGING_NOT_APPLIED").alias("code"))),
    )
    return manifests.select("id", F.inline(F.array_compact(found)))


def report_findings(reports: DataFrame) -> DataFrame:
    """(id, severity, code, clause, description, failed_checks) of validator reports (id, report): a crash of its task, and each failed rule."""
    rules = F.from_json(F.get_json_object("report", "$.details.ruleSummaries"), _RULES)
    failed = F.filter(rules, lambda r: (r["status"] == "failed") | F.coalesce(r["ruleStatus"] == "FAILED", F.lit(False)))
    one = lambda code, clause, text, n: F.struct(F.lit("error").alias("severity"), code.alias("code"), clause.alias("clause"), text.alias("description"), n.alias("failed_checks"))
    crash = F.when(F.get_json_object("report", "$.taskException").isNotNull(), F.array(one(F.lit("VERAPDF_TASK_EXCEPTION"), F.lit(None).cast("string"), F.get_json_object("report", "$.taskException.message"), F.lit(0))))
    each = F.transform(failed, lambda r: one(F.concat(F.lit("VERAPDF_"), finding_code(F.coalesce(r["clause"], F.lit(""))), F.lit("_"), F.coalesce(r["testNumber"], F.lit("RULE"))), r["clause"], r["description"], F.coalesce(r["failedChecks"], F.lit(0))))
    empty = F.array().cast("array<struct<severity: string, code: string, clause: string, description: string, failed_checks: int>>")
    return reports.select("id", F.inline(F.concat(F.coalesce(crash, empty), F.coalesce(each, empty))))
