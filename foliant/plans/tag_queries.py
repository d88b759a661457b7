"""Queries over tags, tables' sections, fonts, inline runs, findings and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import features, fonts, tags
from foliant.plans.model_queries import _blocks
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL
from foliant.sources.tables import read_table

TAGS = Registry()


_OPEN = f"""WITH {BLOCKS_SQL}, lv AS (SELECT *, CASE role WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 END AS level, lag(role) OVER o AS prev, last_value(CASE WHEN role = 'H1' THEN seq END IGNORE NULLS) OVER p AS l1, last_value(CASE WHEN role = 'H2' THEN seq END IGNORE NULLS) OVER p AS l2
  FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY seq), p AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN level = 1 THEN 0 ELSE (l1 IS NOT NULL)::INT END + CASE WHEN level IS NULL AND l2 > coalesce(l1, -1) THEN 1 ELSE 0 END AS k FROM lv),
mk AS (SELECT *, coalesce(nullif(regexp_extract(text, '^([•◦▪▸‣–—]|\\*|-)\\s+', 1), ''), nullif(rtrim(regexp_extract(text, '(?i)^(\\d+[.)]\\s*|[a-z][.)]\\s*|[ivxlcdm]+[.)]\\s*)', 1)), '')) AS marker FROM k),
pt AS (SELECT *, role = 'LI' AND marker IS NOT NULL AND length(trim(substr(text, length(marker) + 1))) > 0 AS parted FROM mk)"""


@TAGS.query("tag_tree", f"""{_OPEN}, t AS (SELECT doc_id, 'Sect' AS type, k + 1 AS depth FROM pt WHERE level IS NOT NULL UNION ALL SELECT doc_id, role, k + 2 FROM pt WHERE level IS NOT NULL UNION ALL SELECT doc_id, 'Span', k + 3 FROM pt WHERE level IS NOT NULL
UNION ALL SELECT doc_id, 'P', k + 1 FROM pt WHERE role = 'P' UNION ALL SELECT doc_id, 'Span', k + 2 FROM pt WHERE role = 'P' UNION ALL SELECT doc_id, 'L', k + 1 FROM pt WHERE role = 'LI' AND coalesce(prev, '') <> 'LI' UNION ALL SELECT doc_id, 'LI', k + 2 FROM pt WHERE role = 'LI'
UNION ALL SELECT doc_id, 'Lbl', k + 3 FROM pt WHERE parted UNION ALL SELECT doc_id, 'LBody', k + 3 FROM pt WHERE parted) SELECT doc_id, type, depth::INT AS depth, count(*) AS n FROM t GROUP BY ALL""")
def tag_tree(spark: SparkSession, d: str) -> DataFrame:
    """Operators 152, 153: the tags of every document by type and depth."""
    return tags.tag_tree(_blocks(spark, d)).groupBy("doc_id", "type", "depth").agg(F.count("*").alias("n"))


@TAGS.query("section_depths", f"{_OPEN} SELECT doc_id, k::INT AS depth, count(*) AS n_nodes FROM k GROUP BY ALL")
def section_depths(spark: SparkSession, d: str) -> DataFrame:
    """Operator 164: nodes by the number of sections that they stand in, at any of six levels."""
    return tags.open_sections(_blocks(spark, d)).groupBy("doc_id", F.size("sections").alias("depth")).agg(F.count("*").alias("n_nodes"))


@TAGS.query("map_repairs", """WITH g AS (SELECT l_partkey AS font_id, CASE WHEN l_orderkey % 3 = 0 THEN 65 + l_linenumber WHEN l_orderkey % 3 = 1 THEN 57344 END AS u, l_suppkey % 200 AS code, l_partkey AS k FROM lineitem),
m AS (SELECT *, u IS NULL OR u = 57344 AS missing FROM g), b AS (SELECT font_id, any_value(k) AS k, count(*) AS n, count(*) FILTER (missing) AS nm, count(*) FILTER (missing AND code > 0) AS ros, count(*) FILTER (missing AND code BETWEEN 32 AND 126) AS syn FROM m GROUP BY font_id)
SELECT font_id, round((n - nm) / n, 6) AS coverage, nm AS n_missing, CASE WHEN nm = 0 THEN NULL WHEN k % 5 = 0 THEN 'from-cmap-table' WHEN k % 7 = 0 THEN 'from-differences' WHEN k % 11 = 0 THEN 'from-agl' WHEN k % 13 = 0 AND ros > 0 THEN 'from-cid-ros' WHEN syn > 0 THEN 'synthesized' ELSE 'impossible' END AS strategy,
CASE WHEN nm = 0 THEN 0 WHEN k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 THEN nm WHEN k % 13 = 0 AND ros > 0 THEN ros ELSE syn END AS n_rebuilt FROM b""")
def map_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Operators 190 to 192: coverage of maps and the strategy that rebuilds them; line items as glyphs of parts."""
    k = F.col("l_partkey")
    g = read_table(spark, d, "lineitem").select(
        k.alias("font_id"), F.when(F.col("l_orderkey") % 3 == 0, 65 + F.col("l_linenumber")).when(F.col("l_orderkey") % 3 == 1, 0xE000).alias("unicode"), (F.col("l_suppkey") % 200).alias("code"),
        F.when(k % 5 == 0, 0x41).otherwise(0xE001).alias("cmap_code"), F.when(k % 7 == 0, "uni0041").otherwise("nosuch").alias("difference"), F.when(k % 11 == 0, "space").alias("glyph_name"), F.when(k % 13 == 0, "Adobe-Identity").alias("ordering"),
    )
    return fonts.map_repairs(g).withColumn("coverage", F.round("coverage", 6))


@TAGS.query("inline_runs", f"""WITH {BLOCKS_SQL}, r AS (SELECT doc_id, page_number, seq, length(text) AS n, font_name LIKE '%Bold%' AS b, sum(CASE WHEN font_name LIKE '%Bold%' THEN length(text) ELSE 0 END) OVER p / sum(length(text)) OVER p AS share, sum(length(text)) OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS e
  FROM blocks WINDOW p AS (PARTITION BY doc_id, page_number)) SELECT doc_id, page_number, seq, (e - n)::BIGINT AS start, e::BIGINT AS "end", 'Strong' AS inline_role FROM r WHERE b AND share < 0.9""")
def inline_runs(spark: SparkSession, d: str) -> DataFrame:
    """Operator 150: runs that stand out; lines as runs of pages."""
    r = _blocks(spark, d).select("doc_id", F.col("page_number").alias("block_id"), "seq", "text", "font_name")
    return features.inline_runs(r).select("doc_id", F.col("block_id").alias("page_number"), "seq", "start", "end", "inline_role")


@TAGS.query("sampled_documents", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') ORDER BY sha256(doc_id || ':17'), doc_id LIMIT 25")
def sampled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Operator 174: a random sample of 25 of the documents in some languages; the draw is a hash of the id and a seed."""
    docs = read_table(spark, d, "documents").where(F.col("lang").isin("en", "de"))
    return docs.orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":17")), 256), "doc_id").limit(25).select("doc_id", "lang")


@TAGS.query("tag_containment", f"""{_OPEN}, e AS (SELECT CASE WHEN k = 0 THEN 'Document' ELSE 'Sect' END AS parent, 'Sect' AS type FROM pt WHERE level IS NOT NULL UNION ALL SELECT 'Sect', role FROM pt WHERE level IS NOT NULL UNION ALL SELECT role, 'Span' FROM pt WHERE level IS NOT NULL OR role = 'P'
UNION ALL SELECT CASE WHEN k = 0 THEN 'Document' ELSE 'Sect' END, 'P' FROM pt WHERE role = 'P' UNION ALL SELECT CASE WHEN k = 0 THEN 'Document' ELSE 'Sect' END, 'L' FROM pt WHERE role = 'LI' AND coalesce(prev, '') <> 'LI' UNION ALL SELECT 'L', 'LI' FROM pt WHERE role = 'LI'
UNION ALL SELECT 'LI', unnest(['Lbl', 'LBody']) FROM pt WHERE parted) SELECT parent, type, count(*) AS n, parent <> 'LI' AS allowed FROM e GROUP BY ALL""")
def tag_containment(spark: SparkSession, d: str) -> DataFrame:
    """Operator 230: tags of all documents by what they stand in, and whether that is allowed; the parts of a list item are not among what it may hold."""
    return tags.containment(tags.tag_tree(_blocks(spark, d))).groupBy("parent", "type", "allowed").agg(F.count("*").alias("n"))
