"""Tables in the text of a page: rows of short blocks whose left edges line up.

Detection is sequential (bands of rows grow while the summary of the grown band stays sound), so one page is one
group of rows in Python. A page holds some hundred blocks.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise
from operator import attrgetter, itemgetter
from statistics import fmean, median

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.grouped import map_groups
from foliant.operators.layout import PAGE

NUMERIC = re.compile(r"[0-9$£€¥%]")
LETTER = re.compile("[A-Za-z\u0080-￿]")


@dataclass(frozen=True)
class Grid:
    """Page size and limits of the text-grid test."""

    width: float = 612.0
    row_tolerance: float = 6.0
    longest: int = 64


@dataclass
class Line:
    """A row of blocks, from left to right."""

    items: list
    number: int = 0
    cells: list = field(default_factory=list)

    def share(self, test) -> float:
        return sum(map(test, self.items)) / len(self.items)

    @cached_property
    def numeric(self) -> float:
        return self.share(lambda b: bool(NUMERIC.search(b.text)))

    @cached_property
    def headers(self) -> float:
        return self.share(lambda b: len(b.text) <= 48 and bool(LETTER.search(b.text)) and not NUMERIC.search(b.text))

    @cached_property
    def size(self) -> float:
        return fmean(b.font_size for b in self.items)

    @cached_property
    def span(self) -> float:
        return self.items[-1].x + self.items[-1].w - self.items[0].x


def running_clusters(items: list, value, tolerance: float) -> list[list]:
    """Items in the order of ``value``, in clusters around a running mean."""
    out: list[list] = []
    last: list = []
    total = 0.0
    for item in sorted(items, key=value):
        v = value(item)
        if last and abs(v - total / len(last)) <= tolerance:
            last.append(item)
            total += v
        else:
            out.append(last := [item])
            total = v
    return out


def nearest_pairs(left: list[float], right: list[float], tolerance: float) -> list[tuple[int, int]]:
    """Each value of ``left`` in turn takes the nearest value of ``right`` that is free, within ``tolerance``."""
    free, out = dict(enumerate(right)), []
    for i, v in enumerate(left):
        nearest, least = None, tolerance
        for k, r in free.items():
            d = abs(v - r)
            if d < least or d == least and nearest is None:
                nearest, least = k, d
        if nearest is not None:
            del free[nearest]
            out.append((i, nearest))
    return out


def table_rows(blocks: list, base: float, g: Grid) -> list[Line]:
    """Rows of at least two short blocks that are spread out and have a real gap."""
    wide, high, apart, least = g.width * 0.68, max(24, base * 2.4), max(14, base * 0.8), max(g.width * 0.16, 72)
    short = [b for b in blocks if 0 < len(b.text) <= g.longest and b.w <= wide and b.h <= high]
    rows = []
    for k, items in enumerate(running_clusters(short, lambda b: b.y + b.h / 2, max(g.row_tolerance, base * 0.9))):
        if len(items) > 1:
            row = Line(sorted(items, key=attrgetter("x")), k)
            if row.span >= least and any(b.x - (a.x + a.w) >= apart for a, b in pairwise(row.items)):
                rows.append(row)
    return rows


def has_header(rows: list[Line]) -> bool:
    """Whether the first row heads the others: bold, or labels over numbers, larger type or a font of its own."""
    if len(rows) < 2:
        return False
    first, rest = rows[0], rows[1:]
    if first.share(lambda b: "bold" in b.font_name.lower()) >= 0.5:
        return True
    labels = first.headers >= 0.75 and (fmean(r.numeric for r in rest) >= 0.3 or first.size >= fmean(r.size for r in rest) * 1.03)
    own = {b.font_name for b in first.items} - {b.font_name for r in rest for b in r.items}
    return labels or bool(own) and first.headers >= 0.5


@dataclass
class Band:
    """Rows with the columns that most of them share."""

    rows: list[Line]
    base: float
    g: Grid

    def __post_init__(self) -> None:
        items = [(b.x, r.number) for r in self.rows for b in r.items]
        self.reach = max(12, median([b.w for r in self.rows for b in r.items]) * 0.65, self.g.width * 0.025, self.base * 1.1)
        least = max(2, math.ceil(len(self.rows) * 0.6))
        found = [c for c in running_clusters(items, itemgetter(0), self.reach) if len({n for _, n in c}) >= least]
        self.anchors = sorted(fmean([x for x, _ in c]) for c in found)

    def places(self, row: Line) -> list[tuple]:
        """(column, block) of the blocks of ``row`` that are in a column."""
        return sorted((k, row.items[i]) for i, k in nearest_pairs([b.x for b in row.items], self.anchors, self.reach))

    # A band that is only tried needs its columns; the rest is asked for once, of the bands that stay.
    @cached_property
    def cells(self) -> dict[int, list[tuple]]:
        return {r.number: self.places(r) for r in self.rows}

    @cached_property
    def stable(self) -> list[Line]:
        return [r for r in self.rows if len(self.cells[r.number]) >= 2]

    @cached_property
    def header(self) -> bool:
        return has_header(self.stable)

    @property
    def sure(self) -> bool:
        """Whether the band is a table: enough stable rows and columns, wide enough, headed or numeric throughout."""
        n, c = len(self.stable), len(self.anchors)
        if n < 2 or c < 2:
            return False
        full = sum(len(self.cells[r.number]) >= max(2, c - 1) for r in self.stable)
        span = max(self.anchors[-1] - self.anchors[0], max(r.span for r in self.rows))
        numbers = c >= 4 and fmean(r.numeric for r in self.stable) >= 0.72
        filled = sum(len(self.cells[r.number]) for r in self.stable)
        return (
            filled >= 4 and n / len(self.rows) >= 0.67 and span >= max(self.g.width * 0.14, 64) and full >= max(2, math.ceil(n * 0.6))
            and (self.header or numbers) and (c > 2 or self.header)
        )

    @property
    def loose(self) -> bool:
        """Whether a band without any rules is a table: three fifths of its rows stable, headed or numeric throughout, and more than labels with values."""
        n, c = len(self.stable), len(self.anchors)
        if n < 2 or c < 2:
            return False
        span = max(self.anchors[-1] - self.anchors[0], max(r.span for r in self.rows))
        numbers = c >= 4 and fmean(r.numeric for r in self.stable) >= 0.72
        return sum(len(self.cells[r.number]) for r in self.stable) >= 4 and n / len(self.rows) >= 0.6 and span >= max(self.g.width * 0.14, 64) and (self.header or numbers) and (c > 2 or self.header)

    @property
    def loose_confidence(self) -> float:
        return round(min(0.95, 0.72 + len(self.stable) * 0.03 + len(self.anchors) * 0.01 + (len(self.stable) / len(self.rows) - 0.6) * 0.1), 2)

    @property
    def confidence(self) -> float:
        return round(min(0.98, 0.88 + len(self.stable) * 0.02 + len(self.anchors) * 0.01), 2)


def page_bands(rows: list[Line], base: float, g: Grid) -> list[Band]:
    """Bands of consecutive rows: a row joins if it is near, shares two edges, is of like length and fits the columns."""
    bands: list[Band] = []
    for row in rows:
        if bands:
            last = bands[-1].rows[-1]
            gap = min([b.y for b in row.items]) - max([b.y + b.h for b in last.items])
            if gap <= max(22, base * 3.2) and abs(len(last.items) - len(row.items)) <= 1:
                shared = len(nearest_pairs([b.x for b in last.items], [b.x for b in row.items], max(12, g.width * 0.03, base * 1.2)))
                if shared >= 2 and len((grown := Band([*bands[-1].rows, row], base, g)).places(row)) >= 2:
                    bands[-1] = grown
                    continue
        bands.append(Band([row], base, g))
    return [b for b in bands if len(b.rows) > 1]


def loose_bands(blocks: list, base: float, g: Grid) -> list[Band]:
    """Bands of rows that line up without rules: consecutive rows that share two edges, a row with one above it that heads it, and wide single blocks beside them."""
    short = [b for b in blocks if 0 < len(b.text) <= g.longest and b.h <= max(24, base * 2.4)]
    found = running_clusters(short, lambda b: b.y + b.h / 2, max(g.row_tolerance, base * 0.9))
    rows = [Line(sorted(items, key=lambda b: b.x), k) for k, items in enumerate(found)]
    top, bottom = (lambda r: min(b.y for b in r.items)), (lambda r: max(b.y + b.h for b in r.items))
    shared = lambda a, b: len(nearest_pairs([x.x for x in a.items], [x.x for x in b.items], max(12, g.width * 0.03, base * 1.2)))
    near = max(22, base * 3.2)
    several = [r for r in rows if len(r.items) > 1]
    bands: list[list[Line]] = []
    for r in several:
        if bands and top(r) - bottom(bands[-1][-1]) <= near and shared(bands[-1][-1], r) >= 2:
            bands[-1].append(r)
        else:
            bands.append([r])
    bands = [b for b in bands if len(b) > 1]
    taken = {r.number for b in bands for r in b}
    for r in several:
        if r.number not in taken:
            above = [h for h in several if h.number != r.number and 0 <= top(r) - bottom(h) <= near and shared(h, r) >= 2]
            if above and above[-1].number not in taken:
                bands.append([above[-1], r])
                taken |= {above[-1].number, r.number}
    for band in bands:
        high, low = min(map(top, band)), max(map(bottom, band))
        for r in rows:
            inside = top(r) >= high - base and bottom(r) <= low + base
            if len(r.items) == 1 and r.span >= g.width * 0.14 and (inside or abs(bottom(r) - high) <= near or abs(top(r) - low) <= near):
                band.append(r)
        band.sort(key=top)
    return [Band(b, base, g) for b in bands]


OUT = "doc_id long, page_number int, block_id string, table_id string, table_role string, table_row int, table_column int, confidence double"


def text_grid_tables(blocks: DataFrame, g: Grid = Grid()) -> DataFrame:
    """(doc_id, page_number, block_id, table_id, table_role, table_row, table_column, confidence) of cells in text-grid tables."""

    def detect(items: list) -> list[tuple]:
        base = median([b.font_size for b in items])
        out = []
        for k, band in enumerate((b for b in page_bands(table_rows(items, base, g), base, g) if b.sure), 1):
            doc, page, sure, name = items[0].doc_id, items[0].page_number, band.confidence, f"table:{items[0].page_number}:{k}"
            for i, row in enumerate(band.stable):
                role = "header" if band.header and i == 0 else "cell"
                out += [(doc, page, b.block_id, name, role, i, column, sure) for column, b in band.cells[row.number]]
        return out

    return map_groups(blocks.select(*_BLOCK), PAGE, ["seq"], detect, OUT)


_BLOCK = [*PAGE, "seq", "block_id", "text", "x", "y", "w", "h", "font_size", "font_name"]


def borderless_tables(blocks: DataFrame, g: Grid = Grid()) -> DataFrame:
    """Like ``text_grid_tables``, for rows that merely line up; ids say borderless."""

    def detect(items: list) -> list[tuple]:
        base = median([b.font_size for b in items])
        out = []
        for k, band in enumerate((b for b in loose_bands(items, base, g) if b.loose), 1):
            doc, page, sure, name = items[0].doc_id, items[0].page_number, band.loose_confidence, f"table:{items[0].page_number}:borderless:{k}"
            for i, row in enumerate(band.stable):
                role = "header" if band.header and i == 0 else "cell"
                out += [(doc, page, b.block_id, name, role, i, column, sure) for column, b in band.cells[row.number]]
        return out

    return map_groups(blocks.select(*_BLOCK), PAGE, ["seq"], detect, OUT)


def ruled_table_cells(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """The columns of OUT, row_span and column_span for blocks in cells of ruled tables.

    ``cells``: doc_id, page_number, table_id, row, col, row_span, column_span, confidence, block_ids. Rows from the first on
    are headers while they are bold, labels rather than numbers, larger at the top, or at the top with a merged cell.
    """
    page = W.partitionBy(*PAGE)
    b = blocks.select(*PAGE, "block_id", "text", "font_size", "font_name", F.expr("percentile(font_size, 0.5)").over(page).alias("base"))
    own = cells.select(*PAGE, "table_id", "row", "col", "confidence", F.coalesce("row_span", F.lit(1)).alias("row_span"), F.coalesce("column_span", F.lit(1)).alias("column_span"), F.explode_outer("block_ids").alias("block_id"))
    j = own.join(b, [*PAGE, "block_id"], "left")
    there = F.col("text").isNotNull()
    share = lambda c: F.coalesce(F.avg(F.when(there, F.coalesce(c, F.lit(False)).cast("int"))), F.lit(0.0))
    rows = j.groupBy(*PAGE, "table_id", "row").agg(
        share(F.col("font_name").rlike("(?i)bold")).alias("bold"), share(T.looks_header(F.col("text"))).alias("labels"), share(T.looks_numeric(F.col("text"))).alias("numbers"),
        F.avg("font_size").alias("size"), F.max("base").alias("base"), F.max((F.col("row_span") > 1) | (F.col("column_span") > 1)).alias("merged"),
    )
    first = F.col("row") == 0
    larger = F.coalesce("size", F.col("base")) >= F.col("base") * 1.04
    heads = (first & F.col("merged")) | (F.col("bold") >= 0.6) | ((F.col("labels") >= 0.75) & (F.col("numbers") <= 0.5)) | (first & (F.col("labels") >= 0.6) & F.coalesce(larger, F.lit(False)))
    w = W.partitionBy(*PAGE, "table_id").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.min(heads).over(w)).select(*PAGE, "table_id", "row", "head")
    out = j.where(there).join(rows, [*PAGE, "table_id", "row"])
    return out.select(*PAGE, "block_id", "table_id", F.when(F.col("head"), "header").otherwise("cell").alias("table_role"), F.col("row").alias("table_row"), F.col("col").alias("table_column"), "confidence", "row_span", "column_span")


def detected_tables(blocks: DataFrame, cells: DataFrame | None = None, g: Grid = Grid()) -> DataFrame:
    """The columns of OUT and method: ruled tables first, then text grids among the rest, then what lines up without rules; a block is in one table."""
    names = [c.split()[0] for c in OUT.split(", ")]
    key = [*PAGE, "block_id"]
    found, rest = [], blocks
    if cells is not None:
        ruled = ruled_table_cells(cells, blocks).select(*names).dropDuplicates(key)
        found.append(ruled.withColumn("method", F.lit("vector-grid")))
        rest = rest.join(ruled.select(*key), key, "left_anti")
    for detect, method in ((text_grid_tables, "text-grid"), (borderless_tables, "borderless-alignment")):
        some = detect(rest, g)
        found.append(some.withColumn("method", F.lit(method)))
        rest = rest.join(some.select(*key), key, "left_anti")
    out = found[0]
    for some in found[1:]:
        out = out.unionByName(some)
    return out
