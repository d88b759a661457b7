"""Queries over features, mergers, classifier figures and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import bayes, compare, features, layout, splits
from foliant.plans.registry import Registry
from foliant.plans.report_queries import _NB, _examples
from foliant.sources.blocks import BLOCKS_SQL, PAGE_H, PAGE_W, blocks_from_documents
from foliant.sources.tables import read_table

MODELS = Registry()


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(read_table(spark, d, "documents"))


_LEGAL = " + ".join(f"regexp_matches(head, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in features.LEGAL)
_FEATURES = f"""WITH {BLOCKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, seq) AS rank FROM blocks),
f AS (SELECT doc_id, count(*) AS n_nodes, count(DISTINCT page_number) AS n_pages, max(column_hint) AS max_column, count(*) FILTER (role IN ('H1', 'H2')) / count(*) AS heading_ratio, count(*) FILTER (role = 'P') / count(*) AS paragraph_ratio,
  coalesce(avg(length(text)) FILTER (role = 'P'), 0.0) AS mean_length, sum(length(text)) / count(DISTINCT page_number) AS density, coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (rank <= 50), '') AS head FROM r GROUP BY doc_id),
g AS (SELECT *, max_column >= 1 AS has_columns, {_LEGAL} >= 2 AS is_legal FROM f)"""


@MODELS.query("document_features", f"{_FEATURES} SELECT doc_id, n_nodes, n_pages, max_column, round(heading_ratio, 6) AS heading_ratio, round(paragraph_ratio, 6) AS paragraph_ratio, round(mean_length, 6) AS mean_length, round(density, 6) AS density, has_columns, is_legal FROM g")
def document_features(spark: SparkSession, d: str) -> DataFrame:
    """Operator 87: features of every document."""
    f = features.document_features(_blocks(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("heading_ratio", "paragraph_ratio", "mean_length", "density")]
    return f.select("doc_id", "n_nodes", "n_pages", "max_column", *rounded, "has_columns", "is_legal")


_AVAILABLE = ["v1-conservative", "v3-aggressive", "v4-legal-tuned", "v6-hybrid", "v7-refined", "v8-precision"]


@MODELS.query("selected_mergers", f"""{_FEATURES} SELECT doc_id, CASE WHEN n_nodes < 20 THEN 'v1-conservative' WHEN is_legal THEN 'v7-refined' WHEN has_columns THEN 'v8-precision' WHEN heading_ratio > 0.15 THEN 'v4-legal-tuned' ELSE 'v7-refined' END AS version,
(CASE WHEN n_nodes < 20 THEN 0.9 WHEN is_legal THEN 0.85 WHEN has_columns THEN 0.8 WHEN heading_ratio > 0.15 THEN 0.75 WHEN density > 5000 THEN 0.75 ELSE 0.6 END)::DOUBLE AS version_confidence,
CASE WHEN n_nodes < 20 THEN 'few-nodes' WHEN is_legal THEN 'legal' WHEN has_columns THEN 'columns' WHEN heading_ratio > 0.15 THEN 'headings' WHEN density > 5000 THEN 'dense' ELSE 'default' END AS rule FROM g""")
def selected_mergers(spark: SparkSession, d: str) -> DataFrame:
    """Operator 178: the merger that the seven rules choose for every document."""
    return features.select_merger(features.document_features(_blocks(spark, d)), _AVAILABLE).select("doc_id", "version", "version_confidence", "rule")


_PER_ROLE = f"""{_NB}, a AS (SELECT actual AS role, count(*) AS support, count(*) FILTER (actual = label) AS tp FROM p GROUP BY 1), l AS (SELECT label AS role, count(*) AS n FROM p GROUP BY 1),
m AS (SELECT role, coalesce(support, 0) AS support, coalesce(tp, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS pr, coalesce(tp, 0) / greatest(coalesce(support, 0), 1)::DOUBLE AS re FROM a FULL JOIN l USING (role)),
q AS (SELECT role, support, round(pr, 6) AS "precision", round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM m)"""


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    held = e.where("doc_id % 5 = 0")
    return bayes.predict(held, *bayes.train(e.where("doc_id % 5 > 0"))).join(held.select("id", "role"), "id")


@MODELS.query("role_metrics", f'{_PER_ROLE} SELECT role, support, "precision", recall, f1 FROM q')
def role_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Operator 211: precision, recall and f1 of every role over the held-out fold."""
    return features.role_metrics(_predicted(spark, d))


@MODELS.query("overall_metrics", f"""{_PER_ROLE} SELECT sum(support)::BIGINT AS n, round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (support > 0), 6) AS supported_macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
round(sum(recall * support) / sum(support), 6) AS accuracy, round(max(support) / sum(support), 6) AS baseline_accuracy FROM q""")
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Operator 211: macro figures, balanced accuracy and the majority baseline over the held-out fold."""
    return features.overall_metrics(_predicted(spark, d))


@MODELS.query("role_feature_totals")
def role_feature_totals(spark: SparkSession, d: str) -> DataFrame:
    """Operators 47, 208: all features of all blocks as nodes, counted by role; nodes meet blocks and pages."""
    b = _blocks(spark, d)
    nodes = layout.simple_order(b).withColumn("source_block_id", F.col("block_id"))
    pages = b.select("doc_id", "page_number").distinct().withColumns({"width": F.lit(PAGE_W), "height": F.lit(PAGE_H)})
    typed = layout.classify(b).select("doc_id", "block_id", "page_number", "font_size", "font_name", "block_type", "heading_level")
    f = features.role_features(nodes, typed, pages)
    return f.select("role", F.explode("features").alias("feature")).groupBy("role", "feature").agg(F.count("*").alias("n"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as documents with reports in JSON; some lack some."""
    k = F.col("s_suppkey")
    js = lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    nested = lambda **c: F.struct(*[v.alias(n) for n, v in c.items()])
    finding = nested(code=F.lit("TAG-1"), description=F.lit("a role"))
    diag = nested(metadataPresent=F.lit(True), dcTitleDetected=k % 2 == 0, pdfUaIdentificationDetected=k % 5 == 0, infoMatchesXmp=F.lit(False), structTreePresent=k % 3 == 0)
    grades = F.array(*map(F.lit, compare.GRADES))
    return read_table(spark, d, "supplier").select(
        k.alias("id"),
        F.when(k % 9 != 0, js(isCompliant=k % 4 == 0, summary=nested(failedRules=k % 30, failedChecks=k % 70), findings=F.array_repeat(finding, (k % 3).cast("int")), metadataDiagnostics=diag)).alias("validation"),
        F.when(k % 5 != 0, js(pagesNative=k % 7, pagesRaster=k % 3, matchRate=(k % 10) / 10)).alias("writer"),
        F.when(k % 6 != 0, js(delta=nested(structTreeAdded=k % 2 == 1, totalTypedNodesDelta=k % 150, markedContentOperatorCountDelta=k % 300))).alias("tag_delta"),
        F.when(k % 8 != 0, js(grade=F.get(grades, (k % 13).cast("int")), issues=F.array_repeat(F.lit("x"), (k % 4).cast("int")))).alias("font"),
    )


_SCORES = """WITH s AS (SELECT s_suppkey AS id FROM supplier), c AS (
SELECT id, 'pdfua-compliance' AS category, CASE WHEN id % 9 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 ELSE greatest(0, 1 - (least((id % 30) / 20::DOUBLE, 1) * 0.6::DOUBLE + least((id % 70) / 50::DOUBLE, 1) * 0.4::DOUBLE)) END AS score FROM s
UNION ALL SELECT id, 'metadata-quality', CASE WHEN id % 9 = 0 THEN 0 ELSE (1 + (id % 2 = 0)::INT + (id % 5 = 0)::INT) / 4::DOUBLE END FROM s
UNION ALL SELECT id, 'structure-tree', least(1, CASE WHEN id % 6 = 0 THEN CASE WHEN id % 9 <> 0 AND id % 3 = 0 THEN 0.4::DOUBLE ELSE 0 END ELSE CASE WHEN id % 2 = 1 OR id % 150 > 0 THEN 0.4::DOUBLE ELSE 0 END + least((id % 150) / 100::DOUBLE, 1) * 0.3::DOUBLE + least((id % 300) / 200::DOUBLE, 1) * 0.3::DOUBLE END) FROM s
UNION ALL SELECT id, 'font-health', CASE WHEN id % 8 = 0 THEN 0.5::DOUBLE ELSE (13 - id % 13) / 13::DOUBLE * 0.7::DOUBLE + (1 - (id % 4) / 10::DOUBLE) * 0.3::DOUBLE END FROM s
UNION ALL SELECT id, 'tag-coverage', least(1, CASE WHEN id % 5 = 0 THEN 0 ELSE (id % 10) / 10::DOUBLE * 0.5::DOUBLE + CASE WHEN id % 7 + id % 3 > 0 THEN (id % 7) / (id % 7 + id % 3)::DOUBLE * 0.3::DOUBLE ELSE 0 END END + (1 - CASE WHEN id % 9 = 0 THEN 0 ELSE id % 3 END / 10::DOUBLE) * 0.2::DOUBLE) FROM s)"""


@MODELS.query("report_scores", f"{_SCORES} SELECT id, category, round(score, 6)::DOUBLE AS score FROM c")
def report_scores(spark: SparkSession, d: str) -> DataFrame:
    """Operators 82, 83: metrics out of JSON reports and all five category scores."""
    return compare.category_scores(compare.document_metrics(_reports(spark, d))).withColumn("score", F.round("score", 6))


@MODELS.query("report_winners", f"""{_SCORES}, r AS (SELECT id, category, round(score, 9) AS score FROM c), b AS (SELECT *, max(score) OVER (PARTITION BY category) AS best FROM r),
w AS (SELECT category, list(id ORDER BY id) FILTER (score = best AND best > 0) AS ids FROM b GROUP BY category)
SELECT category, CASE WHEN len(ids) = 1 THEN ids[1] END AS winner, CASE WHEN len(ids) > 1 THEN array_to_string(ids, ',') END AS tied FROM w""")
def report_winners(spark: SparkSession, d: str) -> DataFrame:
    """Operator 84: the winner of every category, or who is tied."""
    s = compare.category_scores(compare.document_metrics(_reports(spark, d))).withColumn("score", F.round("score", 9))
    return compare.category_results(s).select("category", "winner", F.array_join("tied", ",").alias("tied"))


@MODELS.query("report_totals", f"""{_SCORES}, t AS (SELECT id, sum(round(score * CASE category WHEN 'pdfua-compliance' THEN 1.0::DOUBLE WHEN 'metadata-quality' THEN 0.6::DOUBLE WHEN 'structure-tree' THEN 0.9::DOUBLE WHEN 'font-health' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END, 9)::DECIMAL(20, 9))::DOUBLE / 4.0::DOUBLE AS total FROM c GROUP BY id)
SELECT id, total, id = (SELECT arg_max(id, (total, -id)) FROM t) AS wins FROM t""")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Operator 84: weighted totals and the overall winner, the first of equal ones."""
    r = _reports(spark, d)
    s = compare.category_scores(compare.document_metrics(r))
    totals = compare.overall_scores(s, r.select("id", F.col("id").alias("seq")))
    best = totals.agg(F.max_by("id", F.struct("total", (-F.col("id")).alias("s"))).alias("w"))
    return totals.crossJoin(F.broadcast(best)).select("id", "total", (F.col("id") == F.col("w")).alias("wins"))


@MODELS.query("stratified_split")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Operators 173, 213: a fifth of the documents held out so that every role is covered, rare ones first."""
    roles = _blocks(spark, d).groupBy("doc_id", "role").agg(F.count("*").alias("n"))
    return splits.stratified_split(roles)
