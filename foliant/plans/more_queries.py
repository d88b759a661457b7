"""Queries for matching, geometry, writer choices, predictions and lookups, on the driver's tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import layout as O
from foliant.operators import scores as S
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL, blocks_from_documents
from foliant.sources.tables import read_table as t

MORE = Registry()


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(t(spark, d, "documents"))


_MT = r"lower(trim(regexp_replace(text, '[\s]+', ' ', 'g')))"


@MORE.query("match_similarity", f"""WITH b AS (SELECT item_id, item_id // 4 AS page, {_MT} AS t FROM benchmark), p AS (SELECT a.item_id AS left_id, b.item_id AS right_id, a.t AS ta, b.t AS tb FROM b a JOIN b ON a.page = b.page AND a.item_id < b.item_id),
g AS (SELECT left_id, right_id, 'l' AS side, substr(ta, i, 2) AS g FROM (SELECT *, unnest(generate_series(1, length(ta) - 1)) AS i FROM p) UNION ALL SELECT left_id, right_id, 'r', substr(tb, i, 2) FROM (SELECT *, unnest(generate_series(1, length(tb) - 1)) AS i FROM p)),
n AS (SELECT left_id, right_id, g, count(*) FILTER (side = 'l') AS l, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL) SELECT left_id, right_id, round(sum(least(l, r))::DOUBLE / sum(greatest(l, r)), 6) AS similarity FROM n GROUP BY ALL""")
def match_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Operators 184, 185: texts of a page compared by pairs of characters, repeats counted."""
    b = t(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 4).alias("page"), T.bigram_list(T.match_text(F.col("text"))).alias("g"))
    other = b.select(F.col("item_id").alias("right_id"), F.col("page").alias("p"), F.col("g").alias("h"))
    pairs = b.join(other, (F.col("page") == F.col("p")) & (F.col("item_id") < F.col("right_id")))
    return pairs.select(F.col("item_id").alias("left_id"), "right_id", F.round(T.multiset_jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


@MORE.query("rotated_boxes", f"""WITH {BLOCKS_SQL} SELECT doc_id, block_id, CASE seq % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 612 - x - w ELSE 792 - y - h END AS x, CASE seq % 4 WHEN 0 THEN y WHEN 1 THEN 612 - x - w WHEN 2 THEN 792 - y - h ELSE x END AS y FROM blocks""")
def rotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 187: boxes of pages turned by quarters, turned back."""
    q, x, y, w, h = (F.col(c) for c in ("seq", "x", "y", "w", "h"))
    left = F.when(q % 4 == 0, x).when(q % 4 == 1, y).when(q % 4 == 2, 612 - x - w).otherwise(792 - y - h)
    top = F.when(q % 4 == 0, y).when(q % 4 == 1, 612 - x - w).when(q % 4 == 2, 792 - y - h).otherwise(x)
    return _blocks(spark, d).select("doc_id", "block_id", left.alias("x"), top.alias("y"))


@MORE.query("screen_boxes", f"WITH {BLOCKS_SQL} SELECT doc_id, block_id, round(x * 1.5, 3)::DOUBLE AS x, round((792 - y - h) * 1.5, 3)::DOUBLE AS y, round(w * 1.5, 3)::DOUBLE AS w FROM blocks")
def screen_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 188: boxes scaled and flipped to a screen."""
    return _blocks(spark, d).select("doc_id", "block_id", F.round(F.col("x") * 1.5, 3).alias("x"), F.round((792 - F.col("y") - F.col("h")) * 1.5, 3).alias("y"), F.round(F.col("w") * 1.5, 3).alias("w"))


@MORE.query("text_direction", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\\x{590}-\\x{6ff}\\x{750}-\\x{77f}]')) AS n_rtl, max(md5(reverse(text))) AS reversed FROM documents GROUP BY 1")
def text_direction(spark: SparkSession, d: str) -> DataFrame:
    """Operator 186: texts that run from right to left, and reversal."""
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_rtl(F.col("text"))).alias("n_rtl"), F.max(F.md5(F.reverse("text"))).alias("reversed"))


@MORE.query("writer_modes", "WITH o AS (SELECT l_orderkey, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END) AS marked, avg(CASE WHEN l_tax < 0.07 THEN 1.0 ELSE 0 END) AS matched, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN marked >= 0.5 AND l_orderkey % 2 = 0 THEN 'passthrough' WHEN matched >= 0.8 THEN 'native' ELSE 'raster' END AS mode, count(*) AS n_documents, sum(n)::BIGINT AS n_operators FROM o GROUP BY 1")
def writer_modes(spark: SparkSession, d: str) -> DataFrame:
    """Operators 203, 205: the writer's mode from shares of matched and of marked operators."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    o = t(spark, d, "lineitem").groupBy("l_orderkey").agg(share(F.col("l_linestatus") == "O").alias("marked"), share(F.col("l_tax") < 0.07).alias("matched"), F.count("*").alias("n"))
    mode = S.writer_mode(F.col("matched"), F.col("marked"), F.col("l_orderkey") % 2 == 0)
    return o.groupBy(mode.alias("mode")).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_operators"))


@MORE.query("native_estimates", "WITH e AS (SELECT doc_id, greatest(1, ceil(length(text) / 20.0::DOUBLE))::BIGINT AS ops, greatest(1, ceil(n_chars / 25.0::DOUBLE))::BIGINT AS kept FROM documents) SELECT doc_id, ops AS n_operators, round(least(kept::DOUBLE / ops, 1), 6) AS preserved FROM e")
def native_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Operators 92, 232: estimated operators and the share that is preserved."""
    ops, kept = F.greatest(F.lit(1), F.ceil(F.length("text") / 20)), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 25))
    return t(spark, d, "documents").select("doc_id", ops.cast("long").alias("n_operators"), F.round(F.least(kept / ops, F.lit(1.0)), 6).alias("preserved"))


@MORE.query("captions", rf"""WITH {BLOCKS_SQL}, c AS (SELECT doc_id, seq, role, CASE WHEN role = 'P' AND seq % 6 = 5 THEN 'Table ' || seq || ': ' || text ELSE text END AS text FROM blocks),
k AS (SELECT *, last_value(CASE WHEN role = 'LI' THEN seq END IGNORE NULLS) OVER o AS target, count(*) FILTER (role = 'P') OVER o AS np FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT doc_id, seq AS s, np AS np0 FROM k WHERE role = 'LI') SELECT k.doc_id, k.seq, target::INT AS target FROM k JOIN a ON a.doc_id = k.doc_id AND s = target WHERE role = 'P' AND regexp_matches(text, '^(?i:Figure|Table|Fig\.|Tab\.)\s+[0-9]+[.:]?\s') AND np - np0 <= 3""")
def captions(spark: SparkSession, d: str) -> DataFrame:
    """Operator 159: captions and the nearest target before them within three paragraphs; list items stand for tables."""
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    b = _blocks(spark, d).withColumn("text", F.when((F.col("role") == "P") & (F.col("seq") % 6 == 5), F.concat(F.lit("Table "), "seq", F.lit(": "), "text")).otherwise(F.col("text")))
    k = b.withColumn("n", F.count_if(F.col("role") == "P").over(w)).withColumn("mark", F.when(F.col("role") == "LI", F.struct("seq", F.col("n").alias("at"))))
    k = k.withColumn("last", F.last("mark", ignorenulls=True).over(w))
    found = (F.col("role") == "P") & F.col("text").rlike(r"(?i)^(Figure|Table|Fig\.|Tab\.)\s+\d+[.:]?\s") & (F.col("n") - F.col("last.at") <= 3)
    return k.where(found).select("doc_id", "seq", F.col("last.seq").alias("target"))


_KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in T.ABBREVIATIONS.items())


@MORE.query("abbreviations", f"""WITH k AS (SELECT * FROM (VALUES {_KNOWN}) AS t(abbreviation, expansion)), w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS abbreviation FROM documents)
SELECT abbreviation, expansion, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM w LEFT JOIN k USING (abbreviation) WHERE expansion IS NOT NULL OR regexp_full_match(abbreviation, '[A-Z]{{2,6}}') GROUP BY ALL""")
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Operator 151: abbreviations that stand alone in whole texts, with their expansions where they are known."""
    w = t(spark, d, "documents").select("doc_id", F.explode(T.abbreviation_spans(F.col("text"), known_only=False)).alias("a"))
    return w.groupBy(F.col("a.token").alias("abbreviation"), F.col("a.expansion").alias("expansion")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@MORE.query("finding_remediation", "SELECT l_returnflag AS code, CASE l_returnflag WHEN 'R' THEN 'retag' WHEN 'A' THEN 'add metadata' END AS remedy, count(*) AS n, count(DISTINCT l_orderkey) AS n_documents FROM lineitem GROUP BY ALL")
def finding_remediation(spark: SparkSession, d: str) -> DataFrame:
    """Operator 62: findings with their remedy, where the catalogue has one."""
    remedies = spark.createDataFrame([("R", "retag"), ("A", "add metadata")], "code string, remedy string")
    f = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_documents"))
    return f.join(F.broadcast(remedies), "code", "left")


@MORE.query("overflow_and_retries", """WITH q AS (SELECT o_orderpriority AS workload, count(*) FILTER (o_orderstatus = 'O') AS depth, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 3 = 0) AS transient FROM orders GROUP BY 1)
SELECT workload, depth > 1450 AS runs_locally, failed, transient AS n_retried, failed - transient AS n_given_up FROM q""")
def overflow_and_retries(spark: SparkSession, d: str) -> DataFrame:
    """Operators 220, 221: local runs only beyond the remote capacity; only transient failures are tried again."""
    failed = F.col("o_orderstatus") == "P"
    q = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("workload")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("depth"), F.count_if(failed).alias("failed"), F.count_if(failed & (F.col("o_orderkey") % 3 == 0)).alias("n_retried"))
    return q.select("workload", (F.col("depth") > 1450).alias("runs_locally"), "failed", "n_retried", (F.col("failed") - F.col("n_retried")).alias("n_given_up"))


@MORE.query("model_distribution", "SELECT p_brand AS model, substr(sha256(p_brand), 1, 16) AS model_hash, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, model")
def model_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Operators 172, 235: items by model and hash."""
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.substring(F.sha2("p_brand", 256), 1, 16).alias("model_hash")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model")


@MORE.query("distribution_shift", "WITH k AS (SELECT l_orderkey, round(1 - avg(l_quantity / 50.0::DOUBLE), 6) AS ood FROM lineitem GROUP BY 1) SELECT l_orderkey, ood, CASE WHEN ood > 0.65 THEN 'out-of-distribution' WHEN ood > 0.35 THEN 'near-boundary' ELSE 'in-distribution' END AS decision FROM k")
def distribution_shift(spark: SparkSession, d: str) -> DataFrame:
    """Operator 214: how far predictions of a document are from what the model knows."""
    k = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(1 - F.avg(F.col("l_quantity") / 50.0), 6).alias("ood"))
    return k.withColumn("decision", F.when(F.col("ood") > 0.65, "out-of-distribution").when(F.col("ood") > 0.35, "near-boundary").otherwise("in-distribution"))


@MORE.query("corpus_kpis", """SELECT count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, count(*) FILTER (n_chars < 500) AS n_short, count(*) FILTER (n_chars > 5000) AS n_long, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_languages, round(avg(n_chars), 4) AS mean_chars, round(avg(quality), 6) AS mean_quality, count(toxic) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id)""")
def corpus_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Operators 64, 66: key figures of a corpus in one pass."""
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return j.agg(
        F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("n_chars") < 500).alias("n_short"), F.count_if(F.col("n_chars") > 5000).alias("n_long"), F.countDistinct("source").alias("n_sources"),
        F.countDistinct("lang").alias("n_languages"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.count("toxic").alias("n_labelled"),
    )


@MORE.query("low_confidence_profiles", """WITH p AS (SELECT doc_id, lang AS profile, (doc_id % 50 + 50) / 100.0::DOUBLE AS sure FROM documents) SELECT profile, count(*) AS n, count(*) FILTER (sure < 0.75) AS n_low, round(min(sure), 6) AS least FROM p GROUP BY 1""")
def low_confidence_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Operators 87, 88: histogram of profiles with those of low confidence."""
    p = t(spark, d, "documents").select(F.col("lang").alias("profile"), ((F.col("doc_id") % 50 + 50) / 100).alias("sure"))
    return p.groupBy("profile").agg(F.count("*").alias("n"), F.count_if(F.col("sure") < 0.75).alias("n_low"), F.round(F.min("sure"), 6).alias("least"))


@MORE.query("segment_boxes", """SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 4 WHEN 0 THEN 100 WHEN 1 THEN 100 - 10 WHEN 2 THEN 100 - l_quantity ELSE 100 END, 6)::DOUBLE AS x,
 round(792 - CASE l_linenumber % 4 WHEN 0 THEN 310 WHEN 1 THEN 300 + l_quantity WHEN 2 THEN 300 ELSE 300 END, 6)::DOUBLE AS y, round(CASE l_linenumber % 2 WHEN 0 THEN l_quantity ELSE 10 END, 6)::DOUBLE AS w, round(CASE l_linenumber % 2 WHEN 0 THEN 10 ELSE l_quantity END, 6)::DOUBLE AS h FROM lineitem""")
def segment_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 4: upright boxes of texts turned by quarters, ten high and as wide as the quantity."""
    turn = F.radians((F.col("l_linenumber") % 4 * 90).cast("double"))
    cos, sin, ten = F.cos(turn), F.sin(turn), F.lit(10.0)
    box = O.axis_box(ten * cos, ten * sin, -ten * sin, ten * cos, F.lit(100.0), F.lit(300.0), F.col("l_quantity"), ten, F.lit(792.0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@MORE.query("band_overlaps", f"WITH {BLOCKS_SQL} SELECT doc_id, count(*) AS n FROM blocks WHERE (y < 100 AND y + h > 60) OR (y < 780 AND y + h > 740) GROUP BY 1")
def band_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Operator 63: blocks of all pages in the bands of header and footer."""
    b = _blocks(spark, d)
    pages = b.select("doc_id", "page_number").distinct()
    bands = pages.select("doc_id", "page_number", F.inline(F.array(F.struct(F.lit(60.0).alias("top"), F.lit(100.0).alias("bottom")), F.struct(F.lit(740.0).alias("top"), F.lit(780.0).alias("bottom")))))
    return O.in_bands(b, bands).groupBy("doc_id").agg(F.count("*").alias("n"))
