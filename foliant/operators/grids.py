"""Ruled grids: lines of a table, dividers that are missing, cells that span them, and which grids are tables.

A table's rules are one row from the second step on, so that all that follows is narrow: what a join of edges with rules would
find is looked up in that row, which holds some hundred rules.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.grouped import map_groups, map_rows, once
from foliant.operators.layout import PAGE, coalesce_segments, crossing_rules, drifting_clusters

TABLE = [*PAGE, "table_id"]


def merged_rules(segments: DataFrame, tolerance: float = 2.0, gap: float = 14.0, least: float = 24.0) -> DataFrame:
    """Segments (doc_id, page_number, orient, at, start, end) put on common lines and joined over gaps, with a segment_id and the table_id of what they cross."""
    key = [*PAGE, "orient"]
    lines = segments.groupBy(*key).agg(F.collect_list(F.col("at").cast("double")).alias("ats")).select(*key, once(drifting_clusters(F.col("ats"), tolerance)).alias("c")).select(*key, F.explode("c").alias("c"))
    on = segments.join(lines, key).where("at BETWEEN c.low AND c.high").select(*key, F.round(F.col("c.total") / F.col("c.n"), 3).alias("at"), "start", "end")
    runs = coalesce_segments(on, (*key, "at"), gap, least).drop("run")
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("orient", "at", "start"))
    return crossing_rules(runs.withColumn("segment_id", number))


def merge_signals(rules: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Per table: arrays ``ys`` and ``xs`` of its lines and ``signals`` of (kind, row, col): an inner divider that no rule covers between two lines.

    Two cells side by side without a divider are a colspan, two above each other a rowspan. Tables of fewer than three lines either way are none.
    """
    by = rules.groupBy(*TABLE).agg(F.collect_list(F.struct("orient", "at", "start", "end")).alias("rules"))
    lines = lambda o: drifting_clusters(F.transform(F.filter("rules", lambda r: r["orient"] == o), lambda r: r["at"]), tolerance)
    places = lambda c: F.transform(c, lambda x: F.round(x["total"] / x["n"], 3))
    g = by.withColumns({"h": once(lines("h")), "v": once(lines("v"))}).withColumns({"ys": once(places("h")), "xs": once(places("v"))}).where("size(ys) >= 3 AND size(xs) >= 3")

    def missing(divider: str, bands: str, kind: str) -> Column:
        """Stretches of inner dividers between neighbouring lines of the other way that no rule covers."""

        def edge(line: Column, band: Column) -> Column:
            at, low, high = F.get(divider, line), F.get(bands, band), F.get(bands, band + 1)
            covered = F.exists("rules", lambda r: (r["orient"] == divider) & r["at"].between(at["low"], at["high"]) & (r["start"] <= low + tolerance) & (r["end"] >= high - tolerance))
            row, col = (band, line - 1) if kind == "colspan" else (line - 1, band)
            return F.when(~covered, F.struct(F.lit(kind).alias("kind"), row.cast("int").alias("row"), col.cast("int").alias("col")))

        count = F.size(bands) - 2
        each = F.transform(F.sequence(F.lit(1), F.size(divider) - 2), lambda line: F.transform(F.sequence(F.lit(0), count), lambda band: edge(line, band)))
        return F.array_compact(F.flatten(each))

    return g.select(*TABLE, "ys", "xs", F.concat(missing("v", "ys", "colspan"), missing("h", "xs", "rowspan")).alias("signals"))


_PARTS = ("row", "col", "row_span", "column_span")
#: Between the ids of a cell's blocks while they are one text.
PARTED = "\x1f"


def _grown(n: int, m: int, signals: list[tuple]) -> list[tuple]:
    """(row, col, row_span, column_span) of the cells of a grid of ``n`` by ``m`` places with ``signals`` (kind, row, col)."""
    right = {(r, c) for k, r, c in signals if k == "colspan"}
    down = {(r, c) for k, r, c in signals if k == "rowspan"}
    taken, cells = set(), []
    for r in range(n):
        for c in range(m):
            if (r, c) in taken:
                continue
            last = c
            while last + 1 < m and (r, last) in right:
                last += 1
            low = r
            while low + 1 < n and all((low, k) in down for k in range(c, last + 1)):
                low += 1
            taken |= {(i, k) for i in range(r, low + 1) for k in range(c, last + 1)}
            cells.append((r, c, low - r + 1, last - c + 1))
    return cells


def _held(ys: list[float], xs: list[float], cells: list[tuple], points: list[tuple]) -> tuple[int, list[list]]:
    """How many ``points`` (block_id, cx, cy) are in a table or four off, and the sorted ids per cell of those in it or two off."""
    ids: list[list] = [[] for _ in cells]
    over: dict[tuple, list] = {}
    for k, (r, c, below, right) in enumerate(cells):
        for i in range(r, r + below):
            for j in range(c, c + right):
                over.setdefault((i, j), []).append(k)
    n = 0

    def places(at: list[float], v: float) -> range:
        """The bands between lines ``at`` that reach ``v``, two off at most."""
        return range(max(0, bisect_left(at, v - 2) - 1), min(len(at) - 1, bisect_right(at, v + 2)))

    for name, x, y in points:
        if not (xs[0] - 4 <= x <= xs[-1] + 4 and ys[0] - 4 <= y <= ys[-1] + 4):
            continue
        n += 1
        for k in {k for i in places(ys, y) if ys[i] - 2 <= y <= ys[i + 1] + 2 for j in places(xs, x) if xs[j] - 2 <= x <= xs[j + 1] + 2 for k in over.get((i, j), ())}:
            ids[k].append(name)
    for some in ids:
        some.sort()
    return n, ids


def grid_cells(grids: DataFrame) -> DataFrame:
    """Grids of ``merge_signals`` with n_blocks and ``cells`` (row, col, row_span, column_span, x, y, w, h, block_ids): from the top left, a free
    place grows right over missing dividers, then down where all its columns allow it.

    Where there is an array ``points`` (block_id, cx, cy), a cell has the ids of those in it or two points off, if they are in the table or four off.
    """

    def grow(table: list) -> list[tuple]:
        out = []
        for t in table:
            cells = _grown(len(t.ys) - 1, len(t.xs) - 1, list(zip(t.kinds, t.rows, t.cols)))
            n, ids = _held(t.ys, t.xs, cells, [(p["block_id"], p["cx"], p["cy"]) for p in t.points or ()])
            out.append((t.doc_id, t.page_number, t.table_id, t.ys, t.xs, t.kinds, t.rows, t.cols, n, [PARTED.join(i) for i in ids], *map(list, zip(*cells))))
        return out

    each = [F.col(f"signals.{k}").alias(name) for k, name in (("kind", "kinds"), ("row", "rows"), ("col", "cols"))]
    arrays = "ys array<double>, xs array<double>, kinds array<string>, rows array<int>, cols array<int>"
    points = F.col("points") if "points" in grids.columns else F.lit(None).cast("array<struct<block_id:string,cx:double,cy:double>>")
    found = map_groups(grids.select(*TABLE, "ys", "xs", *each, points.alias("points")), TABLE, [], grow, f"doc_id long, page_number int, table_id long, {arrays}, n_blocks long, _ids array<string>, " + ", ".join(f"_{p} array<int>" for p in _PARTS))

    def cell(z: Column) -> Column:
        row, col, down, right = (z[f"_{p}"] for p in _PARTS)
        x, y = F.get("xs", col), F.get("ys", row)
        return F.struct(row.alias("row"), col.alias("col"), down.alias("row_span"), right.alias("column_span"), x.alias("x"), y.alias("y"), F.round(F.get("xs", col + right) - x, 3).alias("w"), F.round(F.get("ys", row + down) - y, 3).alias("h"), F.filter(F.split(z["_ids"], PARTED), lambda i: i != "").alias("block_ids"))

    signals = F.transform(F.arrays_zip("kinds", "rows", "cols"), lambda z: F.struct(z["kinds"].alias("kind"), z["rows"].alias("row"), z["cols"].alias("col")))
    return found.select(*TABLE, "ys", "xs", "n_blocks", signals.alias("signals"), F.transform(F.arrays_zip(*[f"_{p}" for p in _PARTS], "_ids"), cell).alias("cells"))


def table_candidates(grids: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tables among ``grids`` (``merge_signals``): table_id, x, y, w, h, n_rows, n_columns, n_signals, n_blocks, confidence and cells with the block_ids in them.

    A table is at least 64 wide and 36 high and holds two blocks; two fifths of its cells have text, or it holds many blocks. Its confidence
    grows with rows, columns, blocks and signals. Tables of a page are numbered by their first segment.
    """
    points = blocks.groupBy(*PAGE).agg(F.collect_list(F.struct("block_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))).alias("points"))
    x, y = F.get("xs", F.lit(0)), F.get("ys", F.lit(0))
    box = F.struct(x.alias("x"), y.alias("y"), (F.element_at("xs", -1) - x).alias("w"), (F.element_at("ys", -1) - y).alias("h"))
    g = grid_cells(grids.withColumn("box", box).where("box.w >= 64 AND box.h >= 36").join(points, list(PAGE)))
    g = g.withColumns({"box": box, "n_rows": F.size("ys") - 1, "n_columns": F.size("xs") - 1, "n_signals": F.size("signals"), "cells": once(F.col("cells"))})
    size = F.col("n_rows") * F.col("n_columns")
    filled = F.size(F.filter("cells", lambda c: F.size(c["block_ids"]) > 0))
    held = F.size(F.array_distinct(F.flatten(F.transform("cells", lambda c: c["block_ids"]))))
    enough = (filled / F.size("cells") >= 0.4) | (held >= F.greatest(F.lit(8), F.ceil(size * 0.35)))
    sure = F.lit(0.62) + F.least(F.lit(0.18), F.col("n_rows") * 0.03) + F.least(F.lit(0.12), F.col("n_columns") * 0.03) + F.least(F.lit(0.08), F.col("n_blocks") / size * 0.08) + F.least(F.lit(0.06), F.col("n_signals") * 0.02)
    name = F.concat(F.lit("vector-table:"), "page_number", F.lit(":"), F.row_number().over(W.partitionBy(*PAGE).orderBy("table_id")))
    kept = g.where(enough & (F.col("n_blocks") >= 2)).withColumn("name", name)
    return kept.select(*PAGE, F.col("name").alias("table_id"), "box.*", "n_rows", "n_columns", "n_signals", "n_blocks", F.round(F.least(sure, F.lit(0.97)), 3).alias("confidence"), "cells")


def candidate_cells(tables: DataFrame) -> DataFrame:
    """A row per cell of ``table_candidates``, with its table's confidence."""
    return tables.select(*TABLE, "confidence", F.inline("cells"))


_ROUNDED: dict[float, float] = {}


def _round3(v: float) -> float:
    """``v`` with three decimals as Spark's round gives them."""
    if v not in _ROUNDED:
        if len(_ROUNDED) > 100_000:
            _ROUNDED.clear()
        _ROUNDED[v] = float(Decimal(repr(v)).quantize(Decimal("0.001"), ROUND_HALF_UP))
    return _ROUNDED[v]


def _clusters(values: list[float], tolerance: float) -> list[list]:
    """``drifting_clusters`` of plain values: [total, n, low, high] each."""
    out: list[list] = []
    for v in sorted(values):
        if out and abs(v - out[-1][0] / out[-1][1]) <= tolerance:
            out[-1][0] += v
            out[-1][1] += 1
            out[-1][3] = v
        else:
            out.append([v, 1, v, v])
    return out


def _merged(rules: list[tuple], tolerance: float, gap: float, least: float) -> list[tuple]:
    """(orient, at, start, end) of ``merged_rules`` for the segments of a page, in order."""
    out = []
    for orient in sorted({r[0] for r in rules}):
        own = [r for r in rules if r[0] == orient]
        lines: dict[float, list] = {}
        found = _clusters([r[1] for r in own], tolerance)
        highs = [c[3] for c in found]
        for _, at, start, end in own:
            c = found[bisect_left(highs, at)]
            lines.setdefault(_round3(c[0] / c[1]), []).append((start, end))
        for at in sorted(lines):
            runs: list[list] = []
            far = None
            for start, end in sorted(lines[at]):
                if far is not None and start - far <= gap:
                    runs[-1][1] = far = max(far, end)
                else:
                    runs.append([start, end])
                    far = end if far is None else max(far, end)
            out += [(orient, at, start, end) for start, end in runs if end - start >= least]
    return out


def _page_grids(rules: list[tuple], tolerance: float, gap: float, least: float, crossing: float) -> list[tuple]:
    """(table_id, ys, xs, signals, cells, boxes) of the grids of a page: what ``merged_rules``, ``merge_signals`` and ``grid_cells`` find."""
    merged = _merged(rules, tolerance, gap, least)
    parent = list(range(len(merged)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    up = sorted((r[1], k) for k, r in enumerate(merged) if r[0] == "v")
    for i, (orient, at, start, end) in enumerate(merged):
        if orient == "h":
            for _, k in up[bisect_left(up, (start - crossing,)) : bisect_right(up, (end + crossing, len(merged)))]:
                if merged[k][2] - crossing <= at <= merged[k][3] + crossing:
                    a, b = sorted((root(i), root(k)))
                    parent[b] = a
    tables: dict[int, list] = {}
    for k, r in enumerate(merged):
        tables.setdefault(root(k), []).append(r)
    out = []
    for first, own in sorted(tables.items()):
        lines = {o: _clusters([r[1] for r in own if r[0] == o], tolerance) for o in "hv"}
        at = {o: [_round3(c[0] / c[1]) for c in lines[o]] for o in "hv"}
        if len(at["h"]) < 3 or len(at["v"]) < 3:
            continue
        signals = []
        for kind, divider, other in (("colspan", "v", "h"), ("rowspan", "h", "v")):
            for line in range(1, len(lines[divider]) - 1):
                over = [r for r in own if r[0] == divider and lines[divider][line][2] <= r[1] <= lines[divider][line][3]]
                for band, (low, high) in enumerate(zip(at[other], at[other][1:])):
                    if not any(r[2] <= low + tolerance and r[3] >= high - tolerance for r in over):
                        signals.append((kind, band, line - 1) if kind == "colspan" else (kind, line - 1, band))
        ys, xs = at["h"], at["v"]
        cells = _grown(len(ys) - 1, len(xs) - 1, signals)
        boxes = [(r, c, down, right, xs[c], ys[r], _round3(xs[c + right] - xs[c]), _round3(ys[r + down] - ys[r])) for r, c, down, right in cells]
        out.append((first + 1, ys, xs, signals, cells, boxes))
    return out


#: Forms of ruled pages that a worker remembers, as many pages are ruled alike.
FORMS = 20_000
_forms: dict[tuple, list] = {}


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in which a page, two keys and arrays, is one row: rows of one that follow each other become one."""
    rest = None
    for b in batches:
        b = b if rest is None else pa.concat_batches([rest, b])
        keys = [c.to_numpy(zero_copy_only=False) for c in b.columns[:2]]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, b.num_rows), bool), (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))))
        if not len(starts):
            continue
        if starts[-1]:
            yield _joined(b, starts)
        rest = b.slice(starts[-1])
    if rest is not None:
        yield _joined(rest, np.array([0, rest.num_rows]))


def _joined(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Rows from one of ``starts`` to the next as one, without those from the last on."""
    at, ends = pa.array(starts[:-1]), pa.array(starts)
    lists = [pa.ListArray.from_arrays(c.offsets.take(ends), c.values) for c in b.columns[2:]]
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:2]), *lists], names=b.schema.names)


def _grids_of_pages(column: pa.ListArray, how: tuple[float, ...]) -> list[list]:
    """``_page_grids`` of every page of a batch by its array of rules; pages with the same rules are worked out once while the worker remembers them."""
    at, parts = column.offsets.to_pylist(), column.values
    orients, ends = parts.field("orient"), [parts.field(c) for c in ("at", "start", "end")]
    codes = pc.index_in(orients, value_set=pa.array(["h", "v"])).fill_null(-1)
    columns = [codes, *(pc.fill_null(c, 0.0) for c in ends), *(pc.is_null(c).cast(pa.int8()) for c in (orients, *ends) if parts.null_count or c.null_count)]
    # What is missing adds columns; these are not mistaken for others, as their number is in the key.
    signs = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
    out = []
    for i, j in zip(at, at[1:]):
        key = signs[i:j].tobytes(), len(columns), tuple(orients[i:j].to_pylist()) if (signs[i:j, 0] < 0).any() else (), how
        found = _forms.get(key)
        if found is None:
            if len(_forms) >= FORMS:
                _forms.clear()
            rules = zip(*(c[i:j].to_pylist() for c in (orients, *ends)))
            found = _forms[key] = _page_grids([r for r in rules if None not in r], *how)
        out.append(found)
    return out


def _rules(pages: DataFrame) -> Column:
    """The array ``rules`` as texts and doubles, as it stands if it holds them."""
    names = ("orient", "at", "start", "end")
    if [(f.name, f.dataType.simpleString()) for f in pages.schema["rules"].dataType.elementType] == [(n, "string" if n == "orient" else "double") for n in names]:
        return F.col("rules")
    return F.transform("rules", lambda r: F.struct(r["orient"].alias("orient"), *[r[c].cast("double").alias(c) for c in names[1:]]))


_SIGNALS = "signals array<struct<kind:string,row:int,col:int>>"
_CELLS = "cells array<struct<row:int,col:int,row_span:int,column_span:int,x:double,y:double,w:double,h:double,block_ids:array<string>>>"


def page_grids(pages: DataFrame, tolerance: float = 2.0, gap: float = 14.0, least: float = 24.0, crossing: float = 3.0) -> DataFrame:
    """(doc_id, page_number, table_id, ys, xs, signals, cells): ``grid_cells`` without blocks of ``merge_signals`` of ``merged_rules``, in one pass.

    ``pages``: doc_id, page_number and an array ``rules`` of (orient, at, start, end); a page is one row, or some that follow each other, and nothing is dealt out anew.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in _whole_pages(batches):
            for doc, number, grids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _grids_of_pages(b.column(2), (tolerance, gap, least, crossing))):
                for name, ys, xs, signals, _, boxes in grids:
                    yield doc, number, name, ys, xs, signals, [(*x, ()) for x in boxes]

    return map_rows(pages.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), _rules(pages).alias("rules")), go, f"doc_id long, page_number int, table_id long, ys array<double>, xs array<double>, {_SIGNALS}, {_CELLS}")


class _Tables:
    """Grids of a batch's pages that are large enough, one a row: ``page`` and, for each different grid, its lines, cells and which cell covers a place."""

    def __init__(self, pages: list[list]) -> None:
        kinds: dict[int, int] = {}
        self.kinds: list[tuple] = []
        page, kind = [], []
        for k, grids in enumerate(pages):
            for g in grids:
                ys, xs = g[1], g[2]
                if xs[-1] - xs[0] < 64 or ys[-1] - ys[0] < 36:
                    continue
                if id(g) not in kinds:
                    kinds[id(g)] = len(self.kinds)
                    self.kinds.append(g)
                page.append(k)
                kind.append(kinds[id(g)])
        self.page, self.kind = np.array(page, int), np.array(kind, int)
        self.n_cells = np.array([len(g[4]) for g in self.kinds], int)

    def held(self, chosen: np.ndarray, starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tables ``chosen``, whose pages' points begin at ``starts``: the number of points in each or four off, and pairs of cell (numbered from the first table's on) and point in it or two off."""
        kind = self.kind[chosen]
        used, of = np.unique(kind, return_inverse=True)
        lines = [self._padded([self.kinds[u][k] for u in used]) for k in (1, 2)]
        first, size = starts[self.page[chosen]], starts[self.page[chosen] + 1] - starts[self.page[chosen]]
        table = np.repeat(np.arange(len(chosen)), size)
        point = np.arange(len(table)) + np.repeat(first - np.cumsum(size) + size, size)
        form = of[table]
        near, bands = np.ones(len(point), bool), []
        for at, v in zip(lines, (y[point], x[point])):
            low, high = np.nanmin(at, axis=1)[form], np.nanmax(at, axis=1)[form]
            near &= (low - 4 <= v) & (v <= high + 4)
            bands.append((at[form, :-1] - 2 <= v[:, None]) & (v[:, None] <= at[form, 1:] + 2))
        # Where a point is near a line it is in two bands; every pair of bands is a place.
        counts = [b.sum(axis=1) * near for b in bands]
        flat = [np.nonzero(b & near[:, None])[1] for b in bands]
        begin = [np.cumsum(c) - c for c in counts]
        every = counts[0] * counts[1]
        p = np.repeat(np.arange(len(point)), every)
        t = np.arange(len(p)) - np.repeat(np.cumsum(every) - every, every)
        row, col = (flat[k][begin[k][p] + i] for k, i in enumerate(np.divmod(t, counts[1][p]))) if len(p) else (t, t)
        base = np.cumsum(self.n_cells[kind]) - self.n_cells[kind]
        cells, hits = [], []
        for layer in self._covers(used, lines):
            cell = layer[form[p], row, col]
            there = cell >= 0
            cells.append((base[table[p]] + cell)[there])
            hits.append(point[p][there])
        return np.bincount(table[near], minlength=len(chosen)), np.concatenate(cells), np.concatenate(hits)

    @staticmethod
    def _padded(rows: list[list[float]]) -> np.ndarray:
        out = np.full((len(rows), max(map(len, rows))), np.nan)
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
        return out

    def _covers(self, used: np.ndarray, lines: list[np.ndarray]) -> list[np.ndarray]:
        """By grid and place the number of the cell over it or -1, as often as cells overlap."""
        layers: list[np.ndarray] = []
        for g, u in enumerate(used):
            for k, (r, c, below, right) in enumerate(self.kinds[u][4]):
                for i in range(r, r + below):
                    for j in range(c, c + right):
                        free = next((layer for layer in layers if layer[g, i, j] < 0), None)
                        if free is None:
                            layers.append(free := np.full((len(used), lines[0].shape[1], lines[1].shape[1]), -1))
                        free[g, i, j] = k
        return layers


#: Points times lines of a grid that are compared at once.
AT_ONCE = 4_000_000


def _found_tables(b: pa.RecordBatch, how: tuple[float, ...], heads: bool) -> Iterator[pa.RecordBatch]:
    """``page_candidates`` of a batch of pages."""
    tables = _Tables(_grids_of_pages(b.column(2), how))
    starts, points = b.column(3).offsets.to_numpy(), b.column(3).values
    sizes = np.diff(starts)[tables.page] * np.array([len(g[1]) + len(g[2]) for g in tables.kinds], int)[tables.kind] if len(tables.page) else np.zeros(0, int)
    # Tables of a page stay together.
    parts = (np.cumsum(sizes) // AT_ONCE)[np.searchsorted(tables.page, tables.page)]
    for part in np.unique(parts):
        yield from _tables_of(b, tables, np.flatnonzero(parts == part), starts, points, heads)


def _tables_of(b: pa.RecordBatch, tables: _Tables, chosen: np.ndarray, starts: np.ndarray, points: pa.StructArray, heads: bool) -> Iterator[pa.RecordBatch]:
    names = points.field("block_id")
    n, cell, point = tables.held(chosen, starts, *(points.field(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy")))
    words = names.dictionary_encode()
    order = {w: k for k, w in enumerate(sorted(words.dictionary.to_pylist()))}
    rank = np.array([order[w] for w in words.dictionary.to_pylist()], int)[words.indices.to_numpy(zero_copy_only=False)]
    by = np.lexsort((point, rank[point], cell))
    cell, point = cell[by], point[by]
    once_each = np.ones(len(cell), bool)
    once_each[1:] = (cell[1:] != cell[:-1]) | (point[1:] != point[:-1])
    cell, point = cell[once_each], point[once_each]

    kind, page = tables.kind[chosen], tables.page[chosen]
    count = tables.n_cells[kind]
    table = np.repeat(np.arange(len(chosen)), count)
    ids = np.bincount(cell, minlength=len(table))
    shape = np.array([(len(g[1]) - 1, len(g[2]) - 1, len(g[3])) for g in tables.kinds], int)[kind]
    rows, cols, signals = shape.T
    size = rows * cols
    filled = np.bincount(table[ids > 0], minlength=len(chosen))
    enough = filled / count >= 0.4
    for k in np.flatnonzero(~enough):
        own = slice(*np.searchsorted(table[cell], (k, k + 1)))
        enough[k] = len(set(rank[point[own]].tolist())) >= max(8, -(-int(size[k]) * 35 // 100))
    kept = np.flatnonzero(enough & (n >= 2))
    if not len(kept):
        return
    sure = 0.62 + np.minimum(0.18, rows * 0.03) + np.minimum(0.12, cols * 0.03) + np.minimum(0.08, n / size * 0.08) + np.minimum(0.06, signals * 0.02)
    own = np.isin(table, kept)
    boxes = [np.concatenate([_box_columns(tables.kinds[k])[i] for k in kind[kept]]) for i in range(8)]
    fields = [pa.array(v, pa.int32()) for v in boxes[:4]] + [pa.array(v) for v in boxes[4:]]
    if heads:
        fields.append(pa.array(_head_flags(tables, chosen, table, cell, point, starts, points)[own]))
    fields.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ids[own]))).astype(np.int32)), names.take(pa.array(point[own[cell]]))))
    labels = ["row", "col", "row_span", "column_span", "x", "y", "w", "h", *(["header"] if heads else []), "block_ids"]
    cells = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[kept]))).astype(np.int32)), pa.StructArray.from_arrays(fields, names=labels))
    of = page[kept]
    numbers = b.column(1).take(pa.array(of)).to_pylist()
    # A page's tables lie together.
    new = np.concatenate(([True], of[1:] != of[:-1]))
    number = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0)) + 1
    frame = np.array([(g[2][0], g[1][0], g[2][-1] - g[2][0], g[1][-1] - g[1][0]) for g in tables.kinds])[kind[kept]]
    columns = [
        b.column(0).take(pa.array(of)), pa.array(numbers, pa.int32()), pa.array([f"vector-table:{p}:{k}" for p, k in zip(numbers, number.tolist())]), *map(pa.array, np.ascontiguousarray(frame.T)),
        *(pa.array(v[kept], pa.int32()) for v in (rows, cols, signals)), pa.array(n[kept], pa.int64()), pa.array([_round3(v) for v in np.minimum(sure[kept], 0.97).tolist()]), cells,
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page_number", "table_id", "x", "y", "w", "h", "n_rows", "n_columns", "n_signals", "n_blocks", "confidence", "cells"])


def _box_columns(grid: tuple) -> list[np.ndarray]:
    """row, col, row_span, column_span, x, y, w, h of a grid's cells."""
    return list(np.array(grid[5], float).T)


def _head_flags(tables: _Tables, chosen: np.ndarray, table: np.ndarray, cell: np.ndarray, point: np.ndarray, starts: np.ndarray, points: pa.StructArray) -> np.ndarray:
    """Which cells are in the rows from the first on that are headers, as ``tables.ruled_table_cells`` tells them; ``mark`` of a point: bold (1), label (2), number (4)."""
    kind = tables.kind[chosen]
    at = np.concatenate([np.array([c[0] for c in tables.kinds[k][4]]) for k in kind])
    wide = np.concatenate([np.array([c[2] > 1 or c[3] > 1 for c in tables.kinds[k][4]]) for k in kind])
    # Cells of a row lie together.
    row = np.cumsum(np.concatenate(([True], (at[1:] != at[:-1]) | (table[1:] != table[:-1])))) - 1
    marks, sizes = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("mark", "size"))
    told = ~np.isnan(marks[point])
    own, mark, size = row[cell][told], marks[point][told].astype(int), sizes[point][told]
    total = row[-1] + 1
    n = np.bincount(own, minlength=total)
    bold, labels, numbers = (np.bincount(own, (mark & bit > 0).astype(float), minlength=total) / np.maximum(n, 1) for bit in (1, 2, 4))
    known = ~np.isnan(size)
    n_sizes, sum_sizes = np.bincount(own[known], minlength=total), np.bincount(own[known], size[known], minlength=total)
    merged = np.bincount(row, wide, minlength=total) > 0
    of_row, row_at = np.zeros(total, int), np.zeros(total, int)
    of_row[row], row_at[row] = table, at
    head = (bold >= 0.6) | (labels >= 0.75) & (numbers <= 0.5) | (row_at == 0) & merged
    for r in np.flatnonzero(~head & (row_at == 0) & (labels >= 0.6)):
        k = tables.page[chosen[of_row[r]]]
        page = sizes[starts[k] : starts[k + 1]]
        page = page[~np.isnan(page)]
        if len(page):
            base = median(page.tolist())
            head[r] = (sum_sizes[r] / n_sizes[r] if n_sizes[r] else base) >= base * 1.04
    # A row is one if all rows of its table before it are.
    begin = np.concatenate(([True], of_row[1:] != of_row[:-1]))
    since = np.maximum.accumulate(np.where(begin, np.arange(total), 0))
    misses = np.cumsum(~head)
    return (misses - (misses - ~head)[since] == 0)[row]


def page_candidates(pages: DataFrame, tolerance: float = 2.0, gap: float = 14.0, least: float = 24.0, crossing: float = 3.0, heads: bool = False) -> DataFrame:
    """The columns of ``table_candidates`` in one pass over ``pages`` as in ``page_grids`` with arrays ``rules`` and ``blocks`` (block_id, text, x, y, w, h, ...).

    With ``heads`` cells say whether their row is a header; blocks then have font_size and font_name, and ids of their own on a page.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_pages(batches):
            yield from _found_tables(b, (tolerance, gap, least, crossing), heads)

    text = lambda p: F.coalesce(p["font_name"].rlike("(?i)bold"), F.lit(False)), lambda p: F.coalesce(T.looks_header(p["text"]), F.lit(False)), lambda p: F.coalesce(T.looks_numeric(p["text"]), F.lit(False))
    mark = lambda p: F.when(p["text"].isNotNull(), sum((t(p).cast("int") * 2**k for k, t in enumerate(text)), F.lit(0)))
    signs = lambda p: [mark(p).alias("mark"), p["font_size"].cast("double").alias("size")] if heads else []
    points = F.transform("blocks", lambda p: F.struct(p["block_id"].alias("block_id"), (p["x"] + p["w"] / 2).alias("cx"), (p["y"] + p["h"] / 2).alias("cy"), *signs(p)))
    own = pages.select(F.col("doc_id").cast("long"), F.col("page_number").cast("int"), _rules(pages).alias("rules"), points.alias("points"))
    cells = _CELLS.replace("block_ids:", "header:boolean,block_ids:") if heads else _CELLS
    return own.mapInArrow(go, f"doc_id long, page_number int, table_id string, x double, y double, w double, h double, n_rows int, n_columns int, n_signals int, n_blocks long, confidence double, {cells}")
