"""From placed text items to blocks: segments, numeric cells, lines, joined text, page ids.

Items have doc_id, page_number, page_height, seq, str, the text matrix a to f, width, height, font_name and has_eol.
Whether a segment starts a line depends on the segment before it alone, so lines are one window and one sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.layout import PAGE, axis_box, islands


def text_segments(items: DataFrame) -> DataFrame:
    """Items with any text as segments: text, upright box, font size and name, quarter turn, writing mode, has_eol."""
    a, b, c, d, e, f = (F.coalesce(F.col(k), F.lit(0.0)) for k in "abcdef")
    size = F.greatest(F.coalesce("height", F.lit(0.0)), F.abs(a), F.abs(b), F.abs(c), F.abs(d), F.lit(1.0))
    tall = F.when(F.coalesce("height", F.lit(0.0)) > 0, F.col("height")).otherwise(size)
    box = axis_box(a, b, c, d, e, f, F.coalesce("width", F.lit(0.0)), tall, F.col("page_height"))
    turn = T.rotation(a, b)
    return items.where(T.normalize_text(F.col("str")) != "").select(
        *PAGE, "seq", F.lit(0).alias("part"), F.col("str").alias("text"), box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"), size.alias("font_size"),
        F.coalesce("font_name", F.lit("unknown")).alias("font_name"), turn.alias("rotation"), F.when(turn.isin(90, 270), "vertical").otherwise("horizontal").alias("mode"),
        F.coalesce("has_eol", F.lit(False)).alias("has_eol"), F.lit(False).alias("forced"),
    )


def split_numeric(segments: DataFrame) -> DataFrame:
    """A horizontal segment of several compact numbers and nothing else becomes one segment per number, each a block of its own.

    A number's place is where it stands in the text: a cursor goes from one to the next, and every character has the
    same width.
    """
    t = F.regexp_replace(F.col("text"), f"^{T.SPACE}+|{T.SPACE}+$", "")
    s = segments.withColumn("t", t).withColumn("tokens", F.split("t", T.SPACE + "+")).withColumn("lead", F.length("text") - F.length(F.regexp_replace("text", f"^{T.SPACE}+", "")))
    cells = (F.col("mode") == "horizontal") & (F.size("tokens") > 1) & F.forall("tokens", lambda x: x.rlike(T.NUMERIC))
    placed = F.expr(
        "aggregate(tokens, struct(CAST(array() AS ARRAY<STRUCT<token: STRING, at: INT>>) AS done, 1 AS cursor), "
        "(s, x) -> struct(concat(s.done, array(struct(x AS token, locate(x, t, s.cursor) - 1 AS at))) AS done, locate(x, t, s.cursor) + length(x) AS cursor), s -> s.done)"
    )
    whole = F.array(F.struct(F.col("text").alias("token"), F.lit(None).cast("int").alias("at")))
    s = s.select("*", F.posexplode(F.when(cells, placed).otherwise(whole)).alias("k", "cell"))
    step, is_cell, last = F.col("w") / F.greatest(F.length("t"), F.lit(1)), F.col("cell.at").isNotNull(), F.col("k") == F.size("tokens") - 1
    return s.select(
        *PAGE, "seq", F.col("k").alias("part"), F.col("cell.token").alias("text"), F.when(is_cell, F.col("x") + (F.col("cell.at") + F.col("lead")) * step).otherwise(F.col("x")).alias("x"), "y",
        F.when(is_cell, F.greatest(F.length("cell.token") * step, F.lit(1.0))).otherwise(F.col("w")).alias("w"), "h", "font_size", "font_name", "rotation", "mode",
        (F.col("has_eol") & (~is_cell | last)).alias("has_eol"), (is_cell & ~last).alias("forced"),
    )


def same_line(p, n) -> Column:
    """Whether segment ``n`` is level with ``p``; both give a segment's columns by name. Vertical text is judged turned, and by its gap, too."""
    small = F.least(p("font_size"), n("font_size"))
    reach = F.greatest(F.lit(2.0), small * 0.45)

    def level(at: str, size: str) -> Column:
        overlap = F.least(p(at) + p(size), n(at) + n(size)) - F.greatest(p(at), n(at))
        return (F.abs((p(at) + p(size) / 2) - (n(at) + n(size) / 2)) <= reach) & (overlap >= F.least(p(size), n(size)) * 0.35)

    near = n("y") - (p("y") + p("h")) <= F.greatest(F.lit(2.0), small * 0.5)
    return (p("mode") == n("mode")) & F.when(p("mode") == "vertical", level("x", "w") & near).otherwise(level("y", "h"))


def large_gap(p, n) -> Column:
    """Whether the space between two horizontal segments parts them; less is enough between two numbers."""
    gap = n("x") - (p("x") + p("w"))
    numbers = T.is_numeric_token(p("text")) & T.is_numeric_token(n("text"))
    wide = F.when(numbers, gap >= F.greatest(F.lit(3.0), F.least(p("font_size"), n("font_size")) * 0.55)).otherwise(gap > F.greatest(F.lit(24.0), p("font_size") * 2.5))
    return (p("mode") == "horizontal") & (n("mode") == "horizontal") & wide


def needs_space(p: Column, n: Column) -> Column:
    """Whether a space goes between two neighbours of a line (structs): a gap, no space there yet, no hyphen, bracket or mark in the way."""
    gap = n["x"] - (p["x"] + p["w"]) > F.greatest(F.lit(1.5), p["font_size"] * 0.18)
    there = p["text"].rlike(T.SPACE + "$") | n["text"].rlike("^" + T.SPACE)
    return (p["mode"] == n["mode"]) & gap & ~there & ~p["text"].rlike("[-(]$") & ~n["text"].rlike("^[,.;:!?)]")


def segment_lines(segments: DataFrame) -> DataFrame:
    """Adds line_id, from 1 on a page: in order of tops and left edges, a segment continues the line of the one before it or starts one."""
    w = W.partitionBy(*PAGE).orderBy("y", "x", "seq", "part")
    before = F.lag(F.struct(*segments.columns)).over(w)
    s = segments.withColumn("before", before)
    p, n = (lambda c: F.col(f"before.{c}")), F.col
    back = n("x") < p("x") - F.greatest(p("font_size"), n("font_size"))
    starts = F.col("before").isNull() | p("has_eol") | p("forced") | ~same_line(p, n) | large_gap(p, n) | back
    return islands(s, w, starts, "line_id").drop("before")


def _usual(values: Column) -> Column:
    """The most frequent value of an array, the first seen of equals."""
    n = lambda v: F.size(F.filter(values, lambda o: o == v))
    return F.aggregate(values, values[0], lambda best, v: F.when(n(v) > n(best), v).otherwise(best))


def line_blocks(lines: DataFrame) -> DataFrame:
    """One row per line with text: joined text, box, largest font size, usual font, mode and rotation, and the page's block ids.

    Ids follow tops and left edges and read p<page>-b<number>; texts have single spaces.
    """
    parts = F.array_sort(F.collect_list(F.struct("x", "y", "seq", "part", "w", "text", "font_size", "font_name", "mode", "rotation")))
    by = lines.groupBy(*PAGE, "line_id").agg(
        parts.alias("parts"), F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.max("font_size").alias("font_size"),
    )
    joined = F.array_join(F.transform("parts", lambda s, i: F.concat(F.when((i > 0) & needs_space(F.get(F.col("parts"), i - 1), s), " ").otherwise(""), s["text"])), "")
    usual = lambda name: _usual(F.transform("parts", lambda s: s[name])).alias(name)
    out = by.select(
        *PAGE, "line_id", T.normalize_text(joined).alias("text"), F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"),
        "font_size", usual("font_name"), usual("mode"), usual("rotation"),
    ).where("text <> ''")
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("y", "x", "line_id"))
    return out.withColumn("block_id", F.concat(F.lit("p"), F.col("page_number"), F.lit("-b"), number)).drop("line_id")


def text_blocks(items: DataFrame) -> DataFrame:
    """Items to blocks in one go."""
    return line_blocks(segment_lines(split_numeric(text_segments(items))))
