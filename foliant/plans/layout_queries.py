"""Queries over blocks and nodes: lines, columns, order, paragraphs, roles, lists, sections, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import layout as O
from foliant.operators.tags import open_sections
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL, blocks_from_documents
from foliant.sources.tables import read_table

LAYOUT = Registry()


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(read_table(spark, d, "documents"))


# Blocks in two columns side by side, for queries about lines: every other block stands to the right of the one before it.
PAIRED = f"""{BLOCKS_SQL}, paired AS (SELECT * REPLACE (72.0::DOUBLE + 6 * (length(text) % 5) + CASE WHEN seq % 2 = 1 THEN 250 ELSE 0 END AS x, 72.0::DOUBLE + 14 * ((seq % 50) // 2) AS y, least(w, 200.0::DOUBLE) AS w) FROM blocks)"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    right = F.when(F.col("seq") % 2 == 1, 250).otherwise(0)
    return _blocks(spark, d).withColumns({"x": F.col("x") + right, "y": 72.0 + 14 * F.floor((F.col("seq") % 50) / 2), "w": F.least("w", F.lit(200.0))})


_LINES = f"""{PAIRED}, lg AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph, lag(font_size) OVER o AS pf FROM paired WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y, x, seq)),
br AS (SELECT *, CASE WHEN px IS NULL OR abs((py + ph / 2) - (y + h / 2)) > greatest(2.0, least(font_size, pf) * 0.45) OR least(py + ph, y + h) - greatest(py, y) < least(ph, h) * 0.35 OR x - (px + pw) > greatest(24.0, pf * 2.5) OR x < px - greatest(pf, font_size) THEN 1 ELSE 0 END AS b FROM lg),
li AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, seq ROWS UNBOUNDED PRECEDING) AS line_id FROM br)"""


@LAYOUT.query("line_groups", f"WITH {_LINES} SELECT doc_id, page_number, block_id, line_id::BIGINT AS line_id FROM li")
def line_groups(spark: SparkSession, d: str) -> DataFrame:
    """Operators 8 to 10: segments to lines."""
    return O.line_groups(_paired(spark, d)).select("doc_id", "page_number", "block_id", "line_id")


@LAYOUT.query("merged_lines", f"WITH {_LINES}, f AS (SELECT doc_id, page_number, line_id, font_name, count(*) AS n, min((x, seq)) AS p FROM li GROUP BY ALL), m AS (SELECT doc_id, page_number, line_id, font_name FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, line_id ORDER BY n DESC, p) = 1) SELECT doc_id, page_number, line_id::BIGINT AS line_id, count(*) AS n_segments, string_agg(text, ' ' ORDER BY x, seq) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, max(li.font_size) AS font_size, max(m.font_name) AS font_name FROM li JOIN m USING (doc_id, page_number, line_id) GROUP BY ALL")
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Operators 11 to 13: lines with text, box and fonts."""
    return O.merge_lines(O.line_groups(_paired(spark, d)))


@LAYOUT.query("page_columns", f"""WITH {PAIRED}, c AS (SELECT *, x + w / 2 AS cx FROM paired), g AS (SELECT *, lead(cx) OVER o - cx AS gap, row_number() OVER o AS r FROM c WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY cx, seq)),
b AS (SELECT doc_id, page_number, count(*) AS n, median(w) AS mid FROM g GROUP BY ALL), t AS (SELECT doc_id, page_number, gap, r, cx FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY gap DESC, r) = 1),
j AS (SELECT b.*, gap, r, cx, n >= 4 AND gap >= greatest(612 * 0.16::DOUBLE, mid * 1.9::DOUBLE, 48) AND r >= 2 AND n - r >= 2 AS two FROM b LEFT JOIN t USING (doc_id, page_number))
SELECT doc_id, page_number, CASE WHEN two THEN 2 ELSE 1 END AS n_columns, round(CASE WHEN two THEN cx + gap / 2 ELSE 306.0 END, 6)::DOUBLE AS split_x, CASE WHEN n >= 4 THEN round(gap, 6) ELSE 0 END::DOUBLE AS gutter FROM j""")
def page_columns(spark: SparkSession, d: str) -> DataFrame:
    """Operator 104: one or two columns by the largest gap of centres."""
    c = O.page_columns(_paired(spark, d))
    return c.select("doc_id", "page_number", "n_columns", F.round("split_x", 6).alias("split_x"), F.round("gutter", 6).alias("gutter"))


@LAYOUT.query("column_bands", f"""WITH {PAIRED}, s AS (SELECT *, max(x) OVER p - min(x) OVER p AS span, lag(x) OVER o AS px FROM paired WINDOW p AS (PARTITION BY doc_id, page_number), o AS (PARTITION BY doc_id, page_number ORDER BY x, seq))
SELECT doc_id, page_number, block_id, sum(CASE WHEN x - px > greatest(64.0, span * 0.18) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY x, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS band FROM s""")
def column_bands(spark: SparkSession, d: str) -> DataFrame:
    """Operator 105: bands of left edges."""
    return O.column_bands(_paired(spark, d)).select("doc_id", "page_number", "block_id", "band")


@LAYOUT.query("simple_reading_order", f"WITH {PAIRED} SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, column_hint, y, x, seq) - 1 AS reading_order FROM paired")
def simple_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Operator 109: the deterministic order."""
    return O.simple_order(_paired(spark, d)).select("doc_id", "block_id", F.col("reading_order").cast("long").alias("reading_order"))


@LAYOUT.query("reading_order", f"WITH {PAIRED} SELECT doc_id, page_number, block_id, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY column_hint, y, x, seq) - 1)::INT AS reading_order FROM paired")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Operators 106 to 108: the tolerant order, by comparison sort."""
    return O.reading_order(_paired(spark, d))


@LAYOUT.query("reading_inversions", f"WITH {PAIRED}, o AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM paired WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY column_hint, y, x, seq)) SELECT doc_id, count(*) FILTER (abs(y - ny) <= 6 AND nx < x) AS n_inversions FROM o GROUP BY doc_id")
def reading_inversions(spark: SparkSession, d: str) -> DataFrame:
    """Operator 75: inversions of the deterministic order."""
    return O.inversions(O.simple_order(_paired(spark, d)))


_OPEN = ", ".join(f"'{w}'" for w in O.OPEN_WORDS)
_PARAS = f"""{BLOCKS_SQL}, p AS (SELECT *, floor(y / 6)::BIGINT AS rw, floor(x + 0.5)::BIGINT AS lf FROM blocks WHERE role = 'P'),
pp AS (SELECT *, row_number() OVER o AS pos, y - lag(y + h) OVER o AS gap FROM p WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY rw, x, seq)),
mg AS (SELECT doc_id, page_number, lf AS margin FROM (SELECT doc_id, page_number, lf, count(*) AS n, min(pos) AS f FROM pp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY n DESC, f) = 1),
sp AS (SELECT doc_id, page_number, list_sort(list(gap) FILTER (gap > 0 AND gap < 200)) AS g FROM pp GROUP BY ALL),
pv AS (SELECT pp.*, margin, coalesce(g[len(g) // 2 + 1], 20.0) AS spacing, lag(rw) OVER o AS prw, lag(y + h) OVER o AS pb, lag(x) OVER o AS ppx, lag(column_hint) OVER o AS pc, lag(text) OVER o AS pt FROM pp JOIN mg USING (doc_id, page_number) JOIN sp USING (doc_id, page_number) WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY rw, x, seq)),
bk AS (SELECT *, CASE WHEN prw IS NULL OR (prw <> rw AND y - pb > spacing * 2.2::DOUBLE) OR pc <> column_hint OR (prw <> rw AND x - margin > 20 AND abs(ppx - margin) <= 8 AND NOT (regexp_matches(rtrim(pt), '[,;\\-—–a-z]$') OR lower(string_split(rtrim(pt), ' ')[-1]) IN ({_OPEN}))) THEN 1 ELSE 0 END AS b FROM pv),
pg AS (SELECT *, (sum(b) OVER (PARTITION BY doc_id, page_number ORDER BY rw, x, seq ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS paragraph FROM bk)"""


@LAYOUT.query("paragraph_margins", f"WITH {_PARAS} SELECT DISTINCT doc_id, page_number, margin, spacing FROM pg")
def paragraph_margins(spark: SparkSession, d: str) -> DataFrame:
    """Operator 115: body margin and line spacing of every page."""
    return O.page_margins(_blocks(spark, d).where("role = 'P'")).select("doc_id", "page_number", "margin", "spacing").distinct()


@LAYOUT.query("merged_paragraphs", f"WITH {_PARAS} SELECT doc_id, page_number, paragraph, string_agg(trim(text), ' ' ORDER BY rw, x, seq) AS text, string_agg(block_id, ',' ORDER BY rw, x, seq) AS merged_from, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM pg GROUP BY doc_id, page_number, paragraph")
def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Operators 112, 114, 116: paragraphs from lines by text structure."""
    m = O.merge_paragraphs(O.paragraph_groups(_blocks(spark, d)))
    return m.withColumn("merged_from", F.array_join("merged_from", ","))


@LAYOUT.query("merge_coverage", f"WITH {_PARAS} SELECT doc_id, count(*) AS n_in, count(DISTINCT (page_number, paragraph)) AS n_out, round(100.0::DOUBLE * (count(*) - count(DISTINCT (page_number, paragraph))) / count(*), 6) AS reduction FROM pg GROUP BY doc_id")
def merge_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Operators 59, 85: merged blocks joined back to the blocks they came from."""
    b = _blocks(spark, d)
    m = O.merge_paragraphs(O.paragraph_groups(b)).select("doc_id", "page_number", "paragraph", F.explode("merged_from").alias("block_id"))
    j = b.where("role = 'P'").select("doc_id", "block_id").join(m, ["doc_id", "block_id"], "left")
    by = j.groupBy("doc_id").agg(F.count("*").alias("n_in"), F.countDistinct("page_number", "paragraph").alias("n_out"))
    return by.withColumn("reduction", F.round(100.0 * (F.col("n_in") - F.col("n_out")) / F.col("n_in"), 6))


_CLASS = f"""{BLOCKS_SQL}, bl AS (SELECT *, median(font_size) OVER (PARTITION BY doc_id, page_number) AS base FROM blocks),
cl AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]+[.)]\\s+') OR regexp_matches(text, '^([-*]|•)\\s+') THEN 'list-item' WHEN font_size / base >= 1.55 OR (font_size / base >= 1.3 AND font_name LIKE '%Bold%' AND length(text) <= 80) THEN 'heading' ELSE 'paragraph' END AS kind FROM bl)"""


@LAYOUT.query("block_types", f"WITH {_CLASS} SELECT doc_id, block_id, base AS baseline, kind AS block_type, CASE WHEN kind = 'heading' THEN CASE WHEN font_size / base >= 1.9 THEN 1 WHEN font_size / base >= 1.55 THEN 2 ELSE 3 END END AS heading_level FROM cl")
def block_types(spark: SparkSession, d: str) -> DataFrame:
    """Operators 128 to 130: block types against the page's font size."""
    return O.classify(_blocks(spark, d)).select("doc_id", "block_id", "baseline", "block_type", "heading_level")


@LAYOUT.query("inferred_roles", f"WITH {_CLASS} SELECT CASE kind WHEN 'heading' THEN 'H' || CASE WHEN font_size / base >= 1.9 THEN 1 WHEN font_size / base >= 1.55 THEN 2 ELSE 3 END WHEN 'list-item' THEN 'LI' ELSE 'P' END AS role, CASE kind WHEN 'heading' THEN 0.93 WHEN 'list-item' THEN 0.94 ELSE 0.88 END::DOUBLE AS confidence, count(*) AS n FROM cl GROUP BY ALL")
def inferred_roles(spark: SparkSession, d: str) -> DataFrame:
    """Operators 148, 149: roles and confidences."""
    r = O.roles(O.classify(_blocks(spark, d)))
    return r.groupBy(F.col("inferred_role").alias("role"), F.col("role_confidence").alias("confidence")).agg(F.count("*").alias("n"))


@LAYOUT.query("list_groups", f"""WITH {BLOCKS_SQL}, l AS (SELECT *, floor(x / 18 + 0.5) AS ind, lag(role) OVER o AS pr, lag(column_hint) OVER o AS pc, lag(floor(x / 18 + 0.5)) OVER o AS pi, lag(y) OVER o AS py FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY page_number, seq)),
g AS (SELECT *, sum(CASE WHEN role = 'LI' AND pr = 'LI' AND pc = column_hint AND pi = ind AND abs(y - py) <= 28 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_number, seq ROWS UNBOUNDED PRECEDING) AS lg FROM l)
SELECT doc_id, block_id, lg::BIGINT AS list_group, row_number() OVER (PARTITION BY doc_id, lg ORDER BY page_number, seq) - 1 AS item_index FROM g WHERE role = 'LI'""")
def list_groups(spark: SparkSession, d: str) -> DataFrame:
    """Operator 118: list items to lists, across pages."""
    return O.list_groups(_blocks(spark, d)).select("doc_id", "block_id", "list_group", F.col("item_index").cast("long").alias("item_index"))


@LAYOUT.query("block_quotes", f"""WITH {BLOCKS_SQL}, p AS (SELECT *, CASE WHEN role = 'P' THEN floor(x + 0.5) END AS lf FROM blocks),
m AS (SELECT doc_id, page_number, lf AS best, n FROM (SELECT doc_id, page_number, lf, count(*) AS n, min(seq) AS f FROM p WHERE lf IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY n DESC, f) = 1),
t AS (SELECT doc_id, page_number, count(lf) AS np FROM p GROUP BY ALL), q AS (SELECT p.*, coalesce(role = 'P' AND np >= 3 AND n >= 2 AND x >= greatest(best * 1.1::DOUBLE, best + 12), false) AS quoted FROM p LEFT JOIN m USING (doc_id, page_number) LEFT JOIN t USING (doc_id, page_number)),
r AS (SELECT *, sum(CASE WHEN quoted AND NOT coalesce(pq, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(quoted) OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS pq FROM q))
SELECT doc_id, page_number, block_id, g::BIGINT AS quote_group FROM r WHERE quoted""")
def block_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 121: indented runs of paragraphs."""
    return O.block_quotes(_blocks(spark, d)).select("doc_id", "page_number", "block_id", "quote_group")


@LAYOUT.query("bibliography_entries", f"""WITH {BLOCKS_SQL}, h AS (SELECT *, last_value(CASE WHEN role LIKE 'H%' THEN length(text) % 3 = 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, seq ROWS UNBOUNDED PRECEDING) AS ins FROM blocks) SELECT doc_id, count(*) AS n_entries FROM h WHERE ins AND role = 'P' GROUP BY doc_id""")
def bibliography_entries(spark: SparkSession, d: str) -> DataFrame:
    """Operator 122: paragraphs under a references heading; here headings of a length divisible by three are called so."""
    b = _blocks(spark, d)
    b = b.withColumn("text", F.when(F.col("role").startswith("H") & (F.length("text") % 3 == 0), "References").otherwise(F.concat("text", F.lit("."))))
    return O.bibliography(b).groupBy("doc_id").agg(F.count("*").alias("n_entries"))


@LAYOUT.query("section_parents", f"""WITH {BLOCKS_SQL}, l AS (SELECT *, CASE role WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 END AS lv FROM blocks),
a AS (SELECT *, last_value(CASE WHEN lv = 1 THEN seq END IGNORE NULLS) OVER o AS l1, last_value(CASE WHEN lv = 2 THEN seq END IGNORE NULLS) OVER o AS l2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY page_number, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, block_id, lv AS level, greatest(CASE WHEN coalesce(lv, 7) > 1 THEN l1 END, CASE WHEN coalesce(lv, 7) > 2 THEN l2 END)::INT AS parent_seq FROM a""")
def section_parents(spark: SparkSession, d: str) -> DataFrame:
    """Operators 152, 161: the heading that a node belongs to."""
    return O.sections(_blocks(spark, d)).select("doc_id", "block_id", "level", "parent_seq")


@LAYOUT.query("section_tree", f"""WITH RECURSIVE {BLOCKS_SQL}, l AS (SELECT *, CASE role WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 END AS lv FROM blocks),
a AS (SELECT doc_id, seq, greatest(CASE WHEN coalesce(lv, 7) > 1 THEN l1 END, CASE WHEN coalesce(lv, 7) > 2 THEN l2 END) AS parent FROM (SELECT *, last_value(CASE WHEN lv = 1 THEN seq END IGNORE NULLS) OVER o AS l1, last_value(CASE WHEN lv = 2 THEN seq END IGNORE NULLS) OVER o AS l2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY page_number, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
r AS (SELECT doc_id, seq, 0 AS depth FROM a WHERE parent IS NULL UNION ALL SELECT a.doc_id, a.seq, depth + 1 FROM a JOIN r ON a.doc_id = r.doc_id AND a.parent = r.seq)
SELECT doc_id, depth, count(*) AS n_nodes FROM r GROUP BY ALL""")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    """Operators 164, 189: nodes by depth of the section tree, at any of six levels."""
    return open_sections(_blocks(spark, d)).groupBy("doc_id", F.size("sections").alias("depth")).agg(F.count("*").alias("n_nodes"))


@LAYOUT.query("neighbour_nodes", f"WITH {BLOCKS_SQL} SELECT doc_id, block_id, lag(role) OVER o AS previous_role, lead(role) OVER o AS next_role, round(abs(y - lag(y + h) OVER o), 6) AS previous_gap FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY page_number, seq)")
def neighbour_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 124: previous and next node in reading order."""
    w = W.partitionBy("doc_id").orderBy("page_number", "seq")
    gap = F.round(F.abs(F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)), 6)
    return _blocks(spark, d).select("doc_id", "block_id", F.lag("role").over(w).alias("previous_role"), F.lead("role").over(w).alias("next_role"), gap.alias("previous_gap"))


@LAYOUT.query("drifting_clusters")
def drifting_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Operators 102, 103, 134: left edges of every page in clusters around a running mean."""
    b = _paired(spark, d).groupBy("doc_id", "page_number").agg(F.collect_list("x").alias("xs"))
    c = b.select("doc_id", "page_number", F.posexplode(O.drifting_clusters(F.col("xs"), 6.0)).alias("cluster", "c"))
    return c.select("doc_id", "page_number", "cluster", F.col("c.n").alias("n"), F.round(F.col("c.total") / F.col("c.n"), 6).alias("centre"), "c.low", "c.high")


@LAYOUT.query("merged_segments", f"""WITH {BLOCKS_SQL}, s AS (SELECT doc_id, page_number, seq, x AS st, x + w / 4 AS en FROM blocks), m AS (SELECT *, max(en) OVER (PARTITION BY doc_id, page_number ORDER BY st, en, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR st - pe > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY st, en, seq ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT doc_id, page_number, run::BIGINT AS run, min(st) AS "start", max(en) AS "end" FROM g GROUP BY doc_id, page_number, run HAVING max(en) - min(st) >= 24""")
def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """Operators 126, 143: intervals of a page merged from their running end."""
    s = _blocks(spark, d).select("doc_id", "page_number", F.col("x").alias("start"), (F.col("x") + F.col("w") / 4).alias("end"))
    return O.coalesce_segments(s, ("doc_id", "page_number"), gap=2)


@LAYOUT.query("ruled_tables")
def ruled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operators 53, 144: crossing rules; every block gives a horizontal rule below and a vertical one at its left."""
    b = _blocks(spark, d)
    h = b.select("doc_id", "page_number", (F.col("seq") * 2).cast("long").alias("segment_id"), F.lit("h").alias("orient"), (F.col("y") + F.col("h")).alias("at"), F.col("x").alias("start"), (F.col("x") + F.col("w")).alias("end"))
    v = b.select("doc_id", "page_number", (F.col("seq") * 2 + 1).cast("long").alias("segment_id"), F.lit("v").alias("orient"), F.col("x").alias("at"), F.col("y").alias("start"), (F.col("y") + F.col("h")).alias("end"))
    return O.ruled_tables(h.unionByName(v))


_CELLS = "SELECT r.r AS row_index, c.c AS column_index, 72.0 + c.c * 120 AS cx, 72.0 + r.r * 100 AS cy, 120.0 AS cw, 100.0 AS ch FROM range(8) r(r), range(4) c(c)"


@LAYOUT.query("blocks_in_cells", f"WITH {BLOCKS_SQL}, cells AS ({_CELLS}) SELECT doc_id, page_number, row_index, column_index, count(*) AS n_blocks FROM blocks JOIN cells ON x + w / 2 >= cx - 2 AND x + w / 2 < cx + cw - 2 AND y + h / 2 >= cy - 2 AND y + h / 2 < cy + ch - 2 GROUP BY ALL")
def blocks_in_cells(spark: SparkSession, d: str) -> DataFrame:
    """Operators 42, 52, 145: block centres in the cells of a grid; the cell follows from the place, so nothing is paired."""
    b = _blocks(spark, d)
    column, row = F.floor((F.col("x") + F.col("w") / 2 - 70) / 120), F.floor((F.col("y") + F.col("h") / 2 - 70) / 100)
    c = b.select("doc_id", "page_number", row.alias("row_index"), column.alias("column_index"))
    return c.where("row_index BETWEEN 0 AND 7 AND column_index BETWEEN 0 AND 3").groupBy("doc_id", "page_number", "row_index", "column_index").agg(F.count("*").alias("n_blocks"))


@LAYOUT.query("smallest_box_hit", f"""WITH {BLOCKS_SQL}, q AS (SELECT doc_id, page_number, min(seq) AS s FROM blocks GROUP BY ALL), pt AS (SELECT doc_id, page_number, x + 5 AS qx, y + 5 AS qy FROM q JOIN blocks USING (doc_id, page_number) WHERE seq = s)
SELECT doc_id, page_number, arg_min(block_id, (w * h, seq)) AS block_id FROM pt JOIN blocks USING (doc_id, page_number) WHERE qx BETWEEN x AND x + w AND qy BETWEEN y AND y + h GROUP BY ALL""")
def smallest_box_hit(spark: SparkSession, d: str) -> DataFrame:
    """Operator 61: the smallest box that holds a point of the page."""
    b = _blocks(spark, d)
    point = b.groupBy("doc_id", "page_number").agg(F.min_by(F.struct((F.col("x") + 5).alias("qx"), (F.col("y") + 5).alias("qy")), "seq").alias("q")).select("doc_id", "page_number", "q.*")
    inside = F.col("qx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("qy").between(F.col("y"), F.col("y") + F.col("h"))
    hit = b.join(point, ["doc_id", "page_number"]).where(inside)
    return hit.groupBy("doc_id", "page_number").agg(F.min_by("block_id", F.struct(F.col("w") * F.col("h"), "seq")).alias("block_id"))


@LAYOUT.query("distinct_boxes")
def distinct_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Operators 26, 27: greedy removal of equal texts at nearly the same place."""
    b = _blocks(spark, d).select("doc_id", "page_number", "seq", T.comparable(F.col("text")).alias("comparable"), "x", (F.floor(F.col("y") / 60) * 60).alias("y"), "w", "h")
    return O.distinct_boxes(b).groupBy("doc_id", "page_number").agg(F.count("*").alias("n_kept"))
