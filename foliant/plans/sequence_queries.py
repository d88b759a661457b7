"""Queries for order-dependent operators, geometry of segments and the rest of the page model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import layout as O
from foliant.operators import matching
from foliant.operators import scores as S
from foliant.operators import sequences as Q
from foliant.operators import tables as B
from foliant.plans.layout_queries import _PARAS
from foliant.operators.lines import split_numeric
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL, blocks_from_documents
from foliant.sources.tables import read_table

SEQUENCES = Registry()


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(read_table(spark, d, "documents"))


@SEQUENCES.query("pairwise_paragraphs")
def pairwise_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Operators 110, 111, 114: each line against the paragraph merged so far."""
    return Q.pairwise_merge(_blocks(spark, d)).withColumn("merged_from", F.array_join("merged_from", ","))


@SEQUENCES.query("continued_tables")
def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operators 119, 120: short lines as cells, bold ones as headers."""
    cells = _blocks(spark, d).withColumn("is_cell", F.length("text") <= 90).withColumn("is_header", F.col("font_name").contains("Bold"))
    return Q.continued_tables(cells)


@SEQUENCES.query("heading_levels", f"""WITH {BLOCKS_SQL}, h AS (SELECT doc_id, seq, CASE role WHEN 'H1' THEN 1 ELSE 2 END AS level, first_value(role) OVER (PARTITION BY doc_id ORDER BY page_number, seq) AS f FROM blocks WHERE role IN ('H1', 'H2'))
SELECT doc_id, seq, level, CASE WHEN f = 'H1' THEN level ELSE 1 END AS normalized FROM h""")
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Operator 125: levels normalized by first appearance."""
    return Q.heading_levels(_blocks(spark, d))


@SEQUENCES.query("merge_warnings", f"""WITH {_PARAS}, m AS (SELECT doc_id, page_number, paragraph, string_agg(trim(text), ' ' ORDER BY rw, x, seq) AS t, count(*) AS n, count(DISTINCT column_hint) AS cols FROM pg GROUP BY ALL),
ord AS (SELECT doc_id, page_number, paragraph, seq < lag(seq) OVER (PARTITION BY doc_id, page_number, paragraph ORDER BY rw, x, seq) AS back FROM pg), gp AS (SELECT doc_id, page_number, paragraph, y - lag(y + h) OVER (PARTITION BY doc_id, page_number, paragraph ORDER BY y, seq) AS g FROM pg),
sd AS (SELECT doc_id, page_number, paragraph FROM gp JOIN m USING (doc_id, page_number, paragraph) WHERE n >= 3 AND g >= 0 GROUP BY ALL HAVING count(*) >= 2 AND avg(g) > 0 AND stddev_pop(g) > avg(g) * 0.5)
SELECT kind, count(*) AS n FROM (SELECT 'cross-column' AS kind FROM m WHERE n > 1 AND cols > 1 UNION ALL SELECT 'excessive-length' FROM m WHERE length(t) > 4000 UNION ALL SELECT 'long' FROM m WHERE length(t) > 2000 AND length(t) <= 4000 UNION ALL SELECT 'short' FROM m WHERE n > 1 AND length(t) < 15
UNION ALL SELECT 'order' FROM (SELECT DISTINCT doc_id, page_number, paragraph FROM ord WHERE back) UNION ALL SELECT 'spacing' FROM sd) GROUP BY kind""")
def merge_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Operators 117, 234: what validators find in merged paragraphs, by kind."""
    g = O.paragraph_groups(_blocks(spark, d))
    key = ["doc_id", "page_number", "paragraph"]
    by = W.partitionBy(*key)
    back = F.col("seq") < F.lag("seq").over(by.orderBy("row", "x", "seq"))
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(by.orderBy("y", "seq"))
    g = g.withColumn("back", back).withColumn("step", gap)
    step = F.when(F.col("step") >= 0, F.col("step"))
    m = g.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("column_hint").alias("cols"), (F.sum(F.length(F.btrim("text")) + 1) - 1).alias("len"), F.max("back").alias("back"), F.count(step).alias("steps"), F.avg(step).alias("mean"), F.stddev_pop(step).alias("sd"))
    n = F.col("len")
    kinds = F.array(
        F.when((F.col("n") > 1) & (F.col("cols") > 1), "cross-column"), F.when(n > 4000, "excessive-length").when(n > 2000, "long"), F.when((F.col("n") > 1) & (n < 15), "short"),
        F.when(F.col("back"), "order"), F.when((F.col("n") >= 3) & (F.col("steps") >= 2) & (F.col("mean") > 0) & (F.col("sd") > F.col("mean") * 0.5), "spacing"),
    )
    return m.select(F.explode(F.array_compact(kinds)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@SEQUENCES.query("document_titles", f"""WITH {BLOCKS_SQL}, h AS (SELECT * FROM blocks WHERE page_number = 1 AND role IN ('H1', 'H2')) SELECT doc_id, arg_min(text, seq) AS title FROM h GROUP BY doc_id HAVING arg_min(font_size, seq) >= max(font_size) AND len(string_split(arg_min(text, seq), ' ')) <= 12""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    """Operator 158: the first heading of the first page, if it is the largest and short."""
    h = _blocks(spark, d).where("page_number = 1 AND role IN ('H1', 'H2')").groupBy("doc_id").agg(F.min_by(F.struct("text", "font_size"), "seq").alias("f"), F.max("font_size").alias("top"))
    return h.where((F.col("f.font_size") >= F.col("top")) & (F.size(F.split("f.text", " ")) <= 12)).select("doc_id", F.col("f.text").alias("title"))


@SEQUENCES.query("header_cells", """WITH c AS (SELECT l_orderkey AS t, l_linenumber AS r, l_suppkey % 3 AS c, l_linenumber = 1 AS head, 1 + (l_quantity::INT % 2) AS span FROM lineitem), e AS (SELECT t, r, head, c + unnest(generate_series(0, span - 1)) AS c FROM c)
SELECT d.t AS table_id, count(DISTINCT (d.r, d.c)) AS n_data, count(*) AS n_links FROM e d JOIN (SELECT DISTINCT t, c FROM e WHERE head) h ON d.t = h.t AND d.c = h.c WHERE NOT d.head GROUP BY 1""")
def header_cells(spark: SparkSession, d: str) -> DataFrame:
    """Operators 60, 162: data cells and the header of their column, with spans spread out."""
    span = F.sequence(F.lit(0).cast("long"), F.col("l_quantity").cast("int") % 2 + F.lit(0).cast("long"))
    c = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("r"), (F.col("l_linenumber") == 1).alias("head"), F.explode(F.transform(span, lambda k: F.col("l_suppkey") % 3 + k)).alias("c"))
    heads = c.where("head").select("table_id", "c").distinct()
    return c.where("NOT head").join(heads, ["table_id", "c"]).groupBy("table_id").agg(F.countDistinct("r", "c").alias("n_data"), F.count("*").alias("n_links"))


@SEQUENCES.query("numeric_segments", """WITH s AS (SELECT o_orderkey, o_custkey || '  ' || round(o_totalprice)::BIGINT || ' ' || (o_orderkey % 90) || '%' AS t FROM orders), k AS (SELECT o_orderkey, t, unnest(regexp_split_to_array(t, ' +')) AS token, unnest(generate_series(1, 3)) AS i FROM s)
SELECT o_orderkey, i::INT AS i, token, round(72 + 240.0::DOUBLE / length(t) * CASE i WHEN 1 THEN 0 WHEN 2 THEN strpos(t, '  ') + 1 ELSE length(t) - length(token) END, 6) AS x, round(greatest(length(token) * 240.0::DOUBLE / length(t), 1), 6) AS w FROM k""")
def numeric_segments(spark: SparkSession, d: str) -> DataFrame:
    """Operator 6: a segment of numbers split in place; each token starts where the tokens before it end."""
    t = F.concat("o_custkey", F.lit("  "), F.round("o_totalprice").cast("long"), F.lit(" "), F.col("o_orderkey") % 90, F.lit("%"))
    one = {"page_number": 1, "seq": 0, "part": 0, "x": 72.0, "y": 0.0, "w": 240.0, "h": 10.0, "font_size": 10.0, "font_name": "F", "rotation": 0, "mode": "horizontal", "has_eol": False, "forced": False}
    s = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"), *[F.lit(v).alias(c) for c, v in one.items()])
    return split_numeric(s).select(F.col("doc_id").alias("o_orderkey"), (F.col("part") + 1).alias("i"), F.col("text").alias("token"), F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@SEQUENCES.query("segment_geometry", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 270 END AS rotation, CASE WHEN l_linenumber % 2 = 1 THEN 'vertical' ELSE 'horizontal' END AS mode, greatest(l_quantity, 1) AS font_size FROM lineitem""")
def segment_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Operators 3, 5: rotation, writing mode and font size of text matrices."""
    turn = F.radians((F.col("l_linenumber") % 4 * 90).cast("double"))
    s = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.cos(turn)).alias("a"), (F.col("l_quantity") * F.sin(turn)).alias("b"))
    angle = T.rotation(F.col("a"), F.col("b"))
    return s.select("l_orderkey", "l_linenumber", angle.alias("rotation"), F.when(angle.isin(90, 270), "vertical").otherwise("horizontal").alias("mode"), F.round(F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0)), 6).alias("font_size"))


@SEQUENCES.query("match_boxes", f"WITH {BLOCKS_SQL}, m AS (SELECT *, strpos(text, ' ') - 1 AS i FROM blocks WHERE strpos(text, ' ') > 0), b AS (SELECT *, x + w * least(1, 0::DOUBLE / length(text)) AS bx, greatest(8, w * greatest(i / length(text)::DOUBLE, 0.06)) AS bw, greatest(2, least(w * 0.015::DOUBLE, 6)) AS px, greatest(1, least(h * 0.2::DOUBLE, 4)) AS py FROM m) SELECT doc_id, block_id, round(greatest(0, least(612, bx - px)), 3) AS x, round(greatest(0, least(792, y - py)), 3) AS y, round(greatest(8, least(greatest(8, 612 - bx), bw + px * 2)), 3) AS w, round(greatest(8, least(792 - y + py, h + py * 2)), 3) AS h FROM b")
def match_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 181: boxes of the first word of each block, in proportion to its characters."""
    b = _blocks(spark, d).withColumn("i", F.locate(" ", F.col("text")) - 1).where("i >= 0")
    n = F.length("text")
    bw = F.greatest(F.lit(8.0), F.col("w") * F.greatest(F.col("i") / n, F.lit(0.06)))
    px, py = F.greatest(F.lit(2.0), F.least(F.col("w") * 0.015, F.lit(6.0))), F.greatest(F.lit(1.0), F.least(F.col("h") * 0.2, F.lit(4.0)))
    fit = lambda v, low, high: F.round(F.greatest(F.lit(low), F.least(high, v)), 3)
    return b.select(
        "doc_id", "block_id", fit(F.col("x") - px, 0.0, F.lit(612.0)).alias("x"), fit(F.col("y") - py, 0.0, F.lit(792.0)).alias("y"),
        fit(bw + px * 2, 8.0, F.greatest(F.lit(8.0), 612 - F.col("x"))).alias("w"), fit(F.col("h") + py * 2, 8.0, 792 - F.col("y") + py).alias("h"),
    )


@SEQUENCES.query("source_text_map")
def source_text_map(spark: SparkSession, d: str) -> DataFrame:
    """Operators 50, 51, 147: blocks against one to four runs of their whole page, a run being a line without its letters e; text before place, greedy."""
    b = _blocks(spark, d)
    runs = b.select("doc_id", "page_number", F.col("seq").cast("string").alias("run_id"), "seq", F.regexp_replace("text", "e", "").alias("text"), "x", "y", "w", "h")
    m = matching.source_mappings(b.withColumn("block_id", F.col("seq").cast("string")), runs)
    return m.select("doc_id", "page_number", F.col("block_id").cast("int").alias("seq"), F.get("run_ids", F.lit(0)).cast("int").alias("start"), F.size("run_ids").alias("length"), F.col("confidence").alias("score"))


@SEQUENCES.query("recognition_outcomes", f"""WITH {BLOCKS_SQL}, p AS (SELECT doc_id, page_number, count(*) AS nb, sum(length(replace(text, ' ', '')))::BIGINT AS nc FROM blocks GROUP BY ALL), o AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN nc + (doc_id % 80) END AS oc, (doc_id % 10) / 10.0 AS score FROM p)
SELECT CASE WHEN oc IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'no-text-detected' END WHEN score < 0.4 THEN 'ignored-low-confidence' WHEN nb = 0 OR nc = 0 OR (oc >= nc + 24 AND oc >= nc * 1.5) THEN 'applied' ELSE 'retained-native-text' END AS status, count(*) AS n_pages, sum(CASE WHEN oc IS NULL THEN nc ELSE oc END)::BIGINT AS n_chars FROM o GROUP BY 1""")
def recognition_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Operators 18 to 20: native and recognized text of a page compared, five outcomes."""
    p = _blocks(spark, d).groupBy("doc_id", "page_number").agg(F.count("*").alias("nb"), F.sum(F.length(T.without_space(F.col("text")))).alias("nc"))
    ocr = p.where("doc_id % 3 > 0").select("doc_id", "page_number", (F.col("nc") + F.col("doc_id") % 80).alias("oc"))
    o = p.join(ocr, ["doc_id", "page_number"], "left")
    more = (F.col("nb") == 0) | (F.col("nc") == 0) | ((F.col("oc") >= F.col("nc") + 24) & (F.col("oc") >= F.col("nc") * 1.5))
    status = F.when(F.col("oc").isNull(), F.when(F.col("doc_id") % 2 == 0, "failed").otherwise("no-text-detected")).when(F.col("doc_id") % 10 / 10 < 0.4, "ignored-low-confidence").when(more, "applied").otherwise("retained-native-text")
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("n_pages"), F.sum(F.coalesce("oc", "nc")).alias("n_chars"))


@SEQUENCES.query("map_coverage", """SELECT p_brand, count(*) AS n_glyphs, count(DISTINCT p_size) AS n_codes, round(avg(CASE WHEN p_size % 6 > 0 AND NOT (p_partkey % 9 = 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM part GROUP BY 1""")
def map_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Operators 191, 240: glyphs of a font that map to text; brands as fonts, private-use codes don't count."""
    mapped = (F.col("p_size") % 6 > 0) & ~(F.col("p_partkey") % 9 == 0)
    return read_table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n_glyphs"), F.countDistinct("p_size").alias("n_codes"), F.round(F.avg(F.when(mapped, 1.0).otherwise(0.0)), 6).alias("coverage"))


@SEQUENCES.query("corpus_pass", """WITH o AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (errors = 0) AS n_passed, bool_and(errors = 0) AS passed, count(*) FILTER (errors > 0) AS n_failed FROM o""")
def corpus_pass(spark: SparkSession, d: str) -> DataFrame:
    """Operators 99 to 101: documents without errors, and whether all are."""
    o = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    ok = F.col("errors") == 0
    return o.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_passed"), F.bool_and(ok).alias("passed"), F.count_if(~ok).alias("n_failed"))


@SEQUENCES.query("version_regret", """WITH s AS (SELECT l_orderkey AS doc, l_returnflag AS version, round(avg(l_discount), 9) AS score FROM lineitem GROUP BY ALL), b AS (SELECT *, max(score) OVER (PARTITION BY doc) AS best FROM s)
SELECT version, count(*) AS n, round(avg(score), 6) AS mean, count(*) FILTER (score = best) AS n_best, round(avg(best - score), 6) AS mean_regret, round(max(best - score), 6) AS max_regret FROM b GROUP BY 1""")
def version_regret(spark: SparkSession, d: str) -> DataFrame:
    """Operators 86, 178: versions of a merger over a corpus: means, wins, regret."""
    s = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("version")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    b = s.withColumn("best", F.max("score").over(W.partitionBy("doc")))
    loss = F.col("best") - F.col("score")
    return b.groupBy("version").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(loss == 0).alias("n_best"), F.round(F.avg(loss), 6).alias("mean_regret"), F.round(F.max(loss), 6).alias("max_regret"))


@SEQUENCES.query("text_grid_tables")
def text_grid_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operators 127, 131 to 136, 139: tables of orders' line items, laid out as a page each."""
    cell = F.posexplode(F.array(F.col("l_partkey").cast("string"), F.round("l_quantity").cast("string"), F.round("l_extendedprice", 2).cast("string"), F.col("l_returnflag")))
    # Lines are dealt out before they are taken apart, so that an order's cells lie together and a quarter of the rows is moved.
    li = read_table(spark, d, "lineitem").repartition("l_orderkey").select("l_orderkey", "l_linenumber", cell.alias("c", "text"))
    head = F.col("l_linenumber") == 1
    blocks = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("l_linenumber") * 4 + F.col("c")).alias("seq"), F.concat("l_linenumber", F.lit(":"), "c").alias("block_id"), "text",
        (72.0 + 110 * F.col("c")).alias("x"), (72.0 + 16 * F.col("l_linenumber")).alias("y"), (6.0 * F.length("text")).alias("w"), F.lit(12.0).alias("h"), F.lit(12.0).alias("font_size"),
        F.when(head, "Times-Bold").otherwise("Times-Roman").alias("font_name"),
    )
    return B.text_grid_tables(blocks).groupBy("doc_id", "table_id").agg(F.count("*").alias("n_cells"), (F.max("table_row") + 1).alias("n_rows"), F.count_if(F.col("table_role") == "header").alias("n_headers"), F.max("confidence").alias("confidence"))


@SEQUENCES.query("margin_paragraphs")
def margin_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Operator 113: lines merged until something speaks against it."""
    return Q.margin_groups(_blocks(spark, d))


@SEQUENCES.query("merge_scores", f"""WITH {_PARAS}, m AS (SELECT doc_id, page_number, paragraph, string_agg(trim(text), ' ' ORDER BY rw, x, seq) AS t, count(*) AS n FROM pg GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS n_in, count(*) AS n_out, count(*) FILTER (length(t) >= 10 AND (regexp_matches(t, '[.!?;:)\\]”’]\\s*$') OR regexp_matches(t, '^[A-ZÀ-Ö0-9(\\["“‘]'))) AS ok, count(*) FILTER (n > 1) AS merged, count(*) FILTER (n > 1 AND length(t) > 800) AS long FROM m GROUP BY 1)
SELECT doc_id, round((1 - n_out / n_in::DOUBLE) * 0.15 + ok / n_out::DOUBLE * 0.25 + (1 - CASE WHEN merged > 0 THEN long / merged::DOUBLE ELSE 0 END) * 0.35 + 0.25::DOUBLE, 6) AS score FROM s""")
def merge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Operator 85: score of the merge of each document by reduction, coherence and overlong paragraphs."""
    m = O.merge_paragraphs(O.paragraph_groups(_blocks(spark, d))).withColumn("n", F.size("merged_from"))
    ok = (F.length("text") >= 10) & (F.col("text").rlike(r"[.!?;:)\]”’]\s*$") | F.col("text").rlike(r'^[A-ZÀ-Ö0-9(\["“‘]'))
    many = F.col("n") > 1
    s = m.groupBy("doc_id").agg(F.sum("n").alias("n_in"), F.count("*").alias("n_out"), F.count_if(ok).alias("ok"), F.count_if(many).alias("merged"), F.count_if(many & (F.length("text") > 800)).alias("long"))
    over = F.coalesce(F.try_divide(F.col("long"), F.col("merged")), F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    return s.select("doc_id", F.round(S.merge_score(1 - F.col("n_out") / F.col("n_in"), F.col("ok") / F.col("n_out"), over, zero, one, zero, zero), 6).alias("score"))
