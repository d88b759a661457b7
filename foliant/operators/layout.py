"""Operators on blocks and nodes of a page: lines, columns, order, merging, lists, islands, sections.

All take flat rows keyed by doc_id and page_number and keep to one window or aggregation each, so that a single
shuffle by page (or by document, where state crosses pages) serves the chain.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.grouped import map_groups

PAGE = ("doc_id", "page_number")


def _page(*order: str | Column) -> W:
    return W.partitionBy(*PAGE).orderBy(*order)


def islands(df: DataFrame, window: W, starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows from 1: a new one begins where ``starts`` holds."""
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(window.rowsBetween(W.unboundedPreceding, 0)))


def line_groups(blocks: DataFrame) -> DataFrame:
    """Adds line_id: segments in (top, left) order continue a line if they are level with it, near it and not behind it."""
    w = _page("y", "x", "seq")
    prev = lambda c: F.lag(c).over(w)
    b = blocks.select("*", *[prev(c).alias(f"p_{c}") for c in ("x", "y", "w", "h", "font_size")])
    small = F.least("font_size", "p_font_size")
    level = F.abs((F.col("p_y") + F.col("p_h") / 2) - (F.col("y") + F.col("h") / 2)) <= F.greatest(F.lit(2.0), small * 0.45)
    overlap = F.least(F.col("p_y") + F.col("p_h"), F.col("y") + F.col("h")) - F.greatest("p_y", "y")
    same = level & (overlap >= F.least("p_h", "h") * 0.35)
    gap = F.col("x") - (F.col("p_x") + F.col("p_w")) > F.greatest(F.lit(24.0), F.col("p_font_size") * 2.5)
    behind = F.col("x") < F.col("p_x") - F.greatest("p_font_size", "font_size")
    b = islands(b, w, ~same | gap | behind, "line_id")
    return b.drop(*[c for c in b.columns if c.startswith("p_")])


def merge_lines(lines: DataFrame) -> DataFrame:
    """One row per line: texts from left to right, the box around them, largest font, most frequent font name (first of equals)."""
    parts = F.array_sort(F.collect_list(F.struct("x", "seq", "text", "font_name")))
    right, bottom = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    by = lines.groupBy(*PAGE, "line_id").agg(parts.alias("parts"), F.min("x").alias("left"), F.min("y").alias("top"), right.alias("right"), bottom.alias("bottom"), F.max("font_size").alias("font_size"))
    names = F.transform("parts", lambda s: s["font_name"])
    mode = F.aggregate(names, F.struct(F.lit(0).alias("n"), F.lit("").alias("name")), lambda best, name: _more(best, names, name))
    return by.select(
        *PAGE, "line_id", F.array_join("parts.text", " ").alias("text"), F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("w"),
        (F.col("bottom") - F.col("top")).alias("h"), "font_size", F.size("parts").cast("long").alias("n_segments"), mode["name"].alias("font_name"),
    )


def _more(best: Column, names: Column, name: Column) -> Column:
    n = F.size(F.filter(names, lambda o: o == name))
    return F.when(n > best["n"], F.struct(n.alias("n"), name.alias("name"))).otherwise(best)


def page_columns(blocks: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Per page: n_columns, split_x, gutter; two columns if the largest gap between block centres is wide and both sides have blocks."""
    c = blocks.withColumn("cx", F.col("x") + F.col("w") / 2)
    w = _page("cx", "seq")
    c = c.withColumn("gap", F.lead("cx").over(w) - F.col("cx")).withColumn("rank", F.row_number().over(w))
    by = c.groupBy(*PAGE).agg(F.count("*").alias("n"), F.max(F.struct("gap", (-F.col("rank")).alias("r"), "cx")).alias("top"), F.expr("percentile(w, 0.5)").alias("mid"))
    need = F.greatest(F.lit(page_width * 0.16), F.col("mid") * 1.9, F.lit(48.0))
    left = -F.col("top.r")
    two = (F.col("n") >= 4) & (F.col("top.gap") >= need) & (left >= 2) & (F.col("n") - left >= 2)
    split = F.when(two, F.col("top.cx") + F.col("top.gap") / 2).otherwise(page_width / 2)
    gutter = F.when(F.col("n") >= 4, F.coalesce("top.gap", F.lit(0.0))).otherwise(0.0)
    return by.select(*PAGE, F.when(two, 2).otherwise(1).alias("n_columns"), split.alias("split_x"), gutter.alias("gutter"))


def column_bands(blocks: DataFrame) -> DataFrame:
    """Adds band: left edges in sessions that a gap wider than 64 or 18 % of their span parts."""
    w = _page("x", "seq")
    all_ = W.partitionBy(*PAGE)
    wide = F.col("x") - F.lag("x").over(w) > F.greatest(F.lit(64.0), (F.max("x").over(all_) - F.min("x").over(all_)) * 0.18)
    return islands(blocks, w, wide, "band").withColumn("band", F.col("band") - 1)


def simple_order(nodes: DataFrame) -> DataFrame:
    """Adds reading_order from 0: page, column, top, left; a total order, unlike the tolerant one."""
    w = W.partitionBy("doc_id").orderBy("page_number", "column_hint", "y", "x", "seq")
    return nodes.withColumn("reading_order", F.row_number().over(w) - 1)


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def reading_units(nodes: DataFrame) -> DataFrame:
    """Units that are read as one, one row each: doc_id, page_number, unit, phase, column, top, left, priority, sort_key, members.

    Headers have phase 0, footers 2, all else 1. Cells of one table and items of one list are a unit; every other node is
    one of its own. A unit's column is the first hint of its members; without one it is the nearest of the bands that
    the page's left edges form, or the first column where other units have hints. Columns that ``nodes`` does not have
    count as null: artifact_type, table_id, table_row_index, table_column_index, list_group_id, list_item_index.
    """
    kind = F.lower(_or_null(nodes, "artifact_type", "string"))
    table, group = _or_null(nodes, "table_id", "string"), _or_null(nodes, "list_group_id", "string")
    row, col, item = (_or_null(nodes, c, "int") for c in ("table_row_index", "table_column_index", "list_item_index"))
    in_table = F.col("role").isin("Table", "TH", "TD") | table.isNotNull() | row.isNotNull() | col.isNotNull()
    in_list = (F.col("role") == "LI") | group.isNotNull()
    phase = F.when(kind == "header", 0).when(kind == "footer", 2).otherwise(1)
    unit = (
        F.when(phase != 1, F.concat(F.lit("node:"), "block_id"))
        .when(in_table, F.concat(F.lit("table:"), F.coalesce(table, F.concat(F.col("page_number").cast("string"), F.lit(":"), "block_id"))))
        .when(in_list, F.concat(F.lit("list:"), F.coalesce(group, F.col("block_id")))).otherwise(F.concat(F.lit("node:"), "block_id"))
    )
    role = F.when(F.col("role").rlike("^H[0-9]$"), 0).when(F.col("role") == "LI", 1).when(F.col("role") == "P", 2).when(F.col("role").isin("TH", "TD"), 3).when(F.col("role") == "Table", 4).otherwise(5)
    priority = F.when(phase != 1, 0).when(unit.startswith("table:"), 3).when(unit.startswith("list:"), 1).otherwise(role)
    first, second = F.when(unit.startswith("table:"), row).otherwise(item), F.when(unit.startswith("table:"), col)
    n = nodes.withColumns({
        "phase": phase, "unit": F.when(unit.startswith("node:"), F.concat(unit, F.lit(":"), "seq")).otherwise(unit), "priority": priority,
        "rank": F.struct(F.coalesce(first, F.lit(0)), F.coalesce(second, F.lit(0)), "y", "x", "block_id", "seq"), "sort_key": F.when(unit.startswith("node:"), F.col("block_id")).otherwise(unit),
        "hint": F.when(phase == 1, F.col("column_hint")),
    })
    member = F.struct("rank", "hint", "block_id", "seq")
    units = n.groupBy(*PAGE, "phase", "unit", "priority", "sort_key").agg(
        F.min("y").alias("top"), F.min("x").alias("left"), F.array_sort(F.collect_list(member)).alias("members"), F.min("seq").alias("first_seq"))
    hint = F.get(F.filter(F.transform("members", lambda m: m["hint"]), lambda h: h.isNotNull()), F.lit(0))
    hints = F.array_sort(F.collect_set("hint")).alias("hints")
    # Bands of left edges, of all nodes between headers and footers.
    body = n.where("phase = 1")
    bands = column_bands(body.select(*PAGE, "x", "seq")).groupBy(*PAGE, "band").agg(((F.min("x") + F.max("x")) / 2).alias("middle"))
    bands = bands.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("band", "middle"))).alias("bands"))
    pages = bands.join(body.groupBy(*PAGE).agg(hints), list(PAGE))
    away = lambda b: F.abs(F.col("left") - b["middle"])
    nearest = F.aggregate("bands", F.get("bands", F.lit(0)), lambda best, b: F.when(away(b) < away(best), b).otherwise(best))["band"]
    other = F.when(F.size("hints") > 0, F.when(F.size("hints") > 1, F.col("hints")[0]).otherwise(0)).when(F.size("bands") > 1, nearest).otherwise(0)
    units = units.join(pages, list(PAGE), "left")
    return units.withColumn("column", F.when(F.col("phase") != 1, 0).otherwise(F.coalesce(hint, other, F.lit(0))).cast("int")).drop("bands", "hints")


def reading_order(nodes: DataFrame, epsilon: float = 6.0) -> DataFrame:
    """(doc_id, page_number, block_id, reading_order): page, phase, column; then left edges on one visual line, else tops.

    Two tops nearer than ``epsilon`` are on one line. That relation is not transitive, so pages with tops that are near
    but not equal take a comparison sort of their units, in the order of the nodes; on all other pages the order is one
    by keys, and Spark sorts them.
    """
    units = reading_units(nodes)
    w = W.partitionBy(*PAGE, "phase", "column").orderBy("top")
    gap = F.col("top") - F.lag("top").over(w)
    units = units.withColumn("step", F.coalesce((gap > 0) & (gap < epsilon), F.lit(False))).withColumn("near", F.max("step").over(W.partitionBy(*PAGE)))

    def compare(a: tuple, b: tuple) -> float:
        if a[:2] != b[:2]:
            return -1 if a[:2] < b[:2] else 1
        if abs(a[2] - b[2]) >= epsilon:
            return a[2] - b[2]
        return (a[3:] > b[3:]) - (a[3:] < b[3:])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["phase", "first_seq"], kind="stable")
        keys = list(zip(pdf["phase"], pdf["column"], pdf["top"], pdf["left"], pdf["priority"], pdf["sort_key"], range(len(pdf))))
        at = [k[-1] for k in sorted(keys, key=cmp_to_key(compare))]
        out = pdf.iloc[at][[*PAGE, "unit"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    kinds = dict(nodes.dtypes)
    keys = units.select(*PAGE, "unit", "phase", "column", "top", "left", "priority", "sort_key", "first_seq", "near")
    sorted_ = keys.where("NOT near").withColumn("rank", F.row_number().over(W.partitionBy(*PAGE).orderBy("phase", "column", "top", "left", "priority", "sort_key", "first_seq"))).select(*PAGE, "unit", "rank")
    compared = keys.where("near").groupBy(*PAGE).applyInPandas(order, f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, unit string, rank int")
    ranks = sorted_.unionByName(compared)
    rows = units.select(*PAGE, "unit", F.posexplode("members").alias("k", "m")).join(ranks, [*PAGE, "unit"])
    at = F.row_number().over(W.partitionBy(*PAGE).orderBy("rank", "k")) - 1
    return rows.select(*PAGE, F.col("m.block_id").alias("block_id"), at.alias("reading_order"))


def inversions(nodes: DataFrame, epsilon: float = 6.0) -> DataFrame:
    """Per document: neighbours on one visual line of which the next starts further left."""
    w = _page("reading_order")
    back = (F.abs(F.col("y") - F.lead("y").over(w)) <= epsilon) & (F.lead("x").over(w) < F.col("x"))
    return nodes.select("doc_id", back.alias("back")).groupBy("doc_id").agg(F.count_if("back").alias("n_inversions"))


def page_margins(nodes: DataFrame) -> DataFrame:
    """Adds margin (most frequent rounded left edge, first of equals) and spacing (upper median gap between lines, 20 without one)."""
    w = W.partitionBy(*PAGE)
    order = _page("row", "x", "seq")
    n = nodes.withColumn("row", F.floor(F.col("y") / 6)).withColumn("left", F.floor(F.col("x") + 0.5)).withColumn("pos", F.row_number().over(order))
    n = n.withColumn("n_left", F.count("*").over(W.partitionBy(*PAGE, "left"))).withColumn("first_left", F.min("pos").over(W.partitionBy(*PAGE, "left")))
    n = n.withColumn("margin", F.max_by("left", F.struct("n_left", -F.col("first_left"))).over(w))
    n = n.withColumn("gap", F.col("y") - F.lag(F.col("y") + F.col("h")).over(order))
    gaps = F.array_sort(F.collect_list(F.when((F.col("gap") > 0) & (F.col("gap") < 200), F.col("gap"))).over(w))
    n = n.withColumn("spacing", F.coalesce(F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")), F.lit(20.0)))
    return n.drop("n_left", "first_left", "left")


# Fixed value: words that leave a line open.
OPEN_WORDS = "the a an of in to for and or but that which who with by from as at on is was be are were not this its their his her".split()


def ends_open(text: Column) -> Column:
    """Whether a line's text goes on: a comma or dash, a lower-case letter, or an open word at its end."""
    t = F.rtrim(text)
    return t.rlike("[,;\\-—–a-z]$") | F.lower(F.element_at(F.split(t, " "), -1)).isin(*OPEN_WORDS)


def paragraph_groups(nodes: DataFrame, gap_factor: float = 2.2, tolerance: float = 8, indent: float = 20) -> DataFrame:
    """Adds paragraph (from 0 on a page) to nodes of role P, compared with the previous raw node.

    A paragraph breaks at a gap over ``gap_factor`` times the usual one, at a change of column, and at an indented
    line after a complete line at the margin.
    """
    n = page_margins(nodes.where("role = 'P'"))
    w = _page("row", "x", "seq")
    prev = lambda c: F.lag(c).over(w)
    moved = prev("row") != F.col("row")
    far = moved & (F.col("y") - prev(F.col("y") + F.col("h")) > F.col("spacing") * gap_factor)
    column = (prev("column_hint") != F.col("column_hint")) & (prev("column_hint") >= 0) & (F.col("column_hint") >= 0)
    inset = moved & (F.col("x") - F.col("margin") > indent) & (F.abs(prev("x") - F.col("margin")) <= tolerance) & ~ends_open(prev("text"))
    n = islands(n, w, far | column | inset, "paragraph")
    return n.withColumn("paragraph", F.col("paragraph") - 1)


def merge_paragraphs(grouped: DataFrame) -> DataFrame:
    """One row per paragraph: text, box, the merged blocks in order."""
    parts = F.array_sort(F.collect_list(F.struct("row", "x", "seq", "block_id", F.btrim("text").alias("text"))))
    return grouped.groupBy(*PAGE, "paragraph").agg(
        F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("text"), F.transform(parts, lambda s: s["block_id"]).alias("merged_from"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )


def classify(blocks: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Adds baseline (median font size of the page), block_type, heading_level and is_artifact."""
    b = blocks.withColumn("baseline", F.expr("percentile(font_size, 0.5)").over(W.partitionBy(*PAGE)))
    score = F.col("font_size") / F.col("baseline")
    bold = F.col("font_name").rlike("(?i)bold")
    stamp = (F.length("text") <= 40) & (F.col("font_size") >= F.col("baseline") * 5) & (F.col("w") >= page_width * 0.35) & (F.col("h") >= page_height * 0.08)
    heading = (score >= 1.55) | ((score >= 1.3) & bold & (F.length("text") <= 80))
    listed = F.col("text").rlike(r"^[0-9]+[.)]\s+") | F.col("text").rlike(r"^([-*]|•)\s+")
    kind = F.when(stamp, "paragraph").when(listed, "list-item").when(heading, "heading").otherwise("paragraph")
    level = F.when(kind == "heading", F.when(score >= 1.9, 1).when(score >= 1.55, 2).otherwise(3))
    return b.select("*", kind.alias("block_type"), level.alias("heading_level"), stamp.alias("is_artifact"))


def roles(blocks: DataFrame) -> DataFrame:
    """Adds inferred role and confidence to classified blocks (with table_role where there is one)."""
    table = F.col("table_role") if "table_role" in blocks.columns else F.lit(None).cast("string")
    role = (
        F.when(F.col("is_artifact"), "Artifact").when(F.col("block_type") == "heading", F.concat(F.lit("H"), F.least(F.coalesce("heading_level", F.lit(2)), F.lit(3))))
        .when(table.isNotNull(), F.when(F.lower(table) == "header", "TH").otherwise("TD")).when(F.col("block_type") == "list-item", "LI").otherwise("P")
    )
    sure = F.when(role == "Artifact", 0.99).when(role.isin("TH", "TD"), 0.96).when(role == "LI", 0.94).when(role.startswith("H"), 0.93).when(F.col("block_type") == "unknown", 0.4).otherwise(0.88)
    return blocks.select("*", role.alias("inferred_role"), sure.alias("role_confidence"))


def list_groups(nodes: DataFrame) -> DataFrame:
    """Adds list_group and item_index to list items; a list goes on over pages while column, indent and distance allow."""
    w = W.partitionBy("doc_id").orderBy("page_number", "seq")
    n = nodes.withColumn("is_item", F.col("role") == "LI").withColumn("indent", F.floor(F.col("x") / 18 + 0.5))
    prev = lambda c: F.lag(c).over(w)
    goes_on = prev("is_item") & (prev("column_hint") == F.col("column_hint")) & (prev("indent") == F.col("indent")) & (F.abs(F.col("y") - prev("y")) <= 28)
    n = islands(n, w, ~goes_on | ~F.col("is_item"), "list_group").where("is_item")
    return n.withColumn("item_index", F.row_number().over(W.partitionBy("doc_id", "list_group").orderBy("page_number", "seq")) - 1).drop("is_item")


def block_quotes(nodes: DataFrame, ratio: float = 0.1) -> DataFrame:
    """Adds quote_group to paragraphs indented from the page's usual left edge; runs of them share a group."""
    w = W.partitionBy(*PAGE)
    order = _page("seq")
    is_p = F.col("role") == "P"
    n = nodes.withColumn("left", F.when(is_p, F.floor(F.col("x") + 0.5)))
    n = n.withColumn("n_p", F.count("left").over(w)).withColumn("n_left", F.count("left").over(W.partitionBy(*PAGE, "left"))).withColumn("first_left", F.min("seq").over(W.partitionBy(*PAGE, "left")))
    best = F.max(F.when(F.col("left").isNotNull(), F.struct("n_left", (-F.col("first_left")).alias("f"), "left"))).over(w)
    n = n.withColumn("best", best).withColumn("limit", F.greatest(F.col("best.left") * (1 + ratio), F.col("best.left") + 12))
    quoted = is_p & (F.col("n_p") >= 3) & (F.col("best.n_left") >= 2) & (F.col("x") >= F.col("limit"))
    n = n.withColumn("quoted", F.coalesce(quoted, F.lit(False)))
    n = islands(n, order, F.col("quoted") & ~F.coalesce(F.lag("quoted").over(order), F.lit(False)), "quote_group")
    return n.where("quoted").drop("left", "n_p", "n_left", "first_left", "best", "limit", "quoted")


def bibliography(nodes: DataFrame, pattern: str = r"(?i)^\s*(References|Bibliography|Works Cited|Literature Cited)\s*$") -> DataFrame:
    """Paragraphs that follow a references heading before any other heading."""
    w = W.partitionBy("doc_id").orderBy("page_number", "seq").rowsBetween(W.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("role").startswith("H"), F.col("text").rlike(pattern)), ignorenulls=True).over(w)
    return nodes.withColumn("inside", inside).where("inside AND role = 'P'").drop("inside")


def sections(nodes: DataFrame) -> DataFrame:
    """Adds parent_seq: the nearest heading above of a smaller level; content belongs to the nearest heading."""
    w = W.partitionBy("doc_id").orderBy("page_number", "seq").rowsBetween(W.unboundedPreceding, -1)
    level = F.when(F.col("role").rlike("^H[1-6]$"), F.substring("role", 2, 1).cast("int"))
    n = nodes.withColumn("level", level)
    above = [F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(w).alias(f"last_{k}") for k in range(1, 7)]
    n = n.select("*", *above)
    parent = F.greatest(*[F.when(F.coalesce("level", F.lit(7)) > k, F.col(f"last_{k}")) for k in range(1, 7)])
    return n.withColumn("parent_seq", parent).drop(*[f"last_{k}" for k in range(1, 7)])


def footnotes(nodes: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Footnote paragraphs low on a page in small type, with footnote group and marker: each belongs to the latest marker."""
    w = W.partitionBy(*PAGE)
    p = nodes.where("role = 'P'")
    sizes = F.array_sort(F.collect_list("font_size").over(w))
    p = p.withColumn("n", F.count("*").over(w)).withColumn("body", F.get(sizes, F.least(F.size(sizes) - 1, F.floor(F.size(sizes) * 0.75).cast("int")))).withColumn("left", F.min("x").over(w))
    p = p.where((F.col("n") >= 2) & (F.col("y") >= page_height * 0.72) & (F.col("font_size") <= F.col("body") * 0.9))
    alone = F.col("text").rlike(r"^\s*[0-9]{1,3}\s*$") & (F.col("x") <= F.col("left") + F.greatest(F.lit(18.0), F.col("body") * 1.8)) & (F.col("w") <= F.greatest(F.lit(18.0), F.col("body") * 2))
    prefix = F.regexp_extract("text", r"^\s*([0-9]{1,3})\s+\S", 1)
    p = p.withColumn("marker", F.when(alone, F.btrim("text")).when(prefix != "", prefix))
    p = p.withColumn("top", F.min(F.when(F.col("marker").isNotNull(), F.col("y"))).over(w) - 4).where("y >= top")
    order = _page(F.floor(F.col("y") / 6), "x", "seq").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("footnote", F.count("marker").over(order)).withColumn("marker", F.last("marker", ignorenulls=True).over(order))
    return p.where("footnote > 0").drop("n", "body", "left", "top")


def drifting_clusters(values: Column, tolerance: float) -> Column:
    """Clusters of a sorted array: a value joins the last one if it is within ``tolerance`` of its running mean.

    Returns an array of (total, n, low, high). The mean drifts, so gaps between values don't decide.
    """
    one = lambda v: F.struct(v.alias("total"), F.lit(1).alias("n"), v.alias("low"), v.alias("high"))
    start = F.slice(F.array(one(F.lit(0.0))), 1, 0)

    def add(clusters: Column, v: Column) -> Column:
        last = F.element_at(clusters, -1)
        grown = F.struct((last["total"] + v).alias("total"), (last["n"] + 1).alias("n"), last["low"].alias("low"), v.alias("high"))
        joins = (F.size(clusters) > 0) & (F.abs(v - F.try_divide(last["total"], last["n"])) <= tolerance)
        kept = F.slice(clusters, 1, F.greatest(F.size(clusters) - 1, F.lit(0)))
        return F.when(joins, F.concat(kept, F.array(grown))).otherwise(F.concat(clusters, F.array(one(v))))

    return F.aggregate(F.array_sort(values), start, add)


def coalesce_segments(segments: DataFrame, keys: tuple[str, ...], gap: float = 14, least: float = 24) -> DataFrame:
    """Merges intervals (start, end) on the same line that lie within ``gap`` of the furthest end so far; short ones go."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    far = F.col("start") - F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)) > gap
    runs = islands(segments, w, far, "run").groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least)


def crossing_rules(segments: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds table_id to rules: one for all horizontal and vertical rules of a page that cross, directly or over others.

    Rows: doc_id, page_number, segment_id, orient ('h' or 'v'), at, start, end. The smallest segment_id of a group is
    its table_id. A page's rules are one group of rows: a horizontal one meets the upright ones over its length, in order of place; union-find joins what crosses.
    """

    def group(rules: list) -> list[tuple]:
        parent = {r.segment_id: r.segment_id for r in rules}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        up = sorted((r for r in rules if r.orient == "v"), key=lambda r: r.at)
        places = [r.at for r in up]
        for h in (r for r in rules if r.orient == "h"):
            for v in up[bisect_left(places, h.start - tolerance) : bisect_right(places, h.end + tolerance)]:
                if v.start - tolerance <= h.at <= v.end + tolerance:
                    a, b = sorted((root(h.segment_id), root(v.segment_id)))
                    parent[b] = a
        return [(*r, root(r.segment_id)) for r in rules]

    own = segments.select(*PAGE, F.col("segment_id").cast("long"), "orient", *[F.col(c).cast("double") for c in ("at", "start", "end")])
    return map_groups(own, list(PAGE), ["segment_id"], group, "doc_id long, page_number int, segment_id long, orient string, at double, start double, end double, table_id long")


def ruled_tables(segments: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page_number, segment_id, table_id) of ``crossing_rules``."""
    return crossing_rules(segments, tolerance).select(*PAGE, "segment_id", "table_id")


def distinct_boxes(blocks: DataFrame, overlap: float = 0.55) -> DataFrame:
    """Drops a block whose comparable text and place equal those of a block kept before it (in seq order)."""

    same = F.coalesce("comparable", F.lit("")) == ""
    by = blocks.groupBy(*PAGE, "comparable").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*blocks.columns).alias("b")))).alias("own"))
    keep = lambda kept, s: F.when(F.exists(kept, lambda k: _iou(s["b"], k["b"]) >= overlap), kept).otherwise(F.concat(kept, F.array(s)))
    # Most texts occur once on a page; only equal ones are folded.
    kept = F.when((F.size("own") == 1) | same, F.col("own")).otherwise(F.aggregate("own", F.filter("own", lambda s: F.lit(False)), keep))
    return by.select(F.explode(kept).alias("s")).select("s.b.*")


def _iou(a: Column, b: Column) -> Column:
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    both = side("x", "w") * side("y", "h")
    return F.when(both == 0, 0.0).otherwise(both / F.greatest(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(1.0)))


def common_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence of two role sequences."""
    row = [0] * (len(right) + 1)
    for a in left:
        before = 0
        for k, b in enumerate(right, 1):
            before, row[k] = row[k], before + 1 if a == b else max(row[k], row[k - 1])
    return row[-1]


def axis_box(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, width: Column, height: Column, page_height: Column) -> Column:
    """Struct x, y, w, h from the top: the upright box around a text placed by the matrix (a b c d e f)."""
    along, up = F.greatest(F.hypot(a, b), F.lit(1e-9)), F.greatest(F.hypot(c, d), F.lit(1e-9))
    dx, dy, ux, uy = a / along * width, b / along * width, c / up * height, d / up * height
    xs, ys = [e, e + dx, e + ux, e + dx + ux], [f, f + dy, f + uy, f + dy + uy]
    left, top = F.least(*xs), F.greatest(*ys)
    return F.struct(left.alias("x"), (page_height - top).alias("y"), (F.greatest(*xs) - left).alias("w"), (top - F.least(*ys)).alias("h"))


def in_bands(nodes: DataFrame, bands: DataFrame) -> DataFrame:
    """Nodes that overlap a header or footer band (doc_id, page_number, top, bottom) of their page."""
    b = bands.select(*[F.col(k).alias(f"b_{k}") for k in (*PAGE, "top", "bottom")])
    same = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page_number") == F.col("b_page_number"))
    return nodes.join(b, same & (F.col("y") < F.col("b_bottom")) & (F.col("y") + F.col("h") > F.col("b_top")), "left_semi")
