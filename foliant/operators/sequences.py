"""Operators whose next step depends on what was decided before: one group of rows per page or document in Python.

A group is what one page or document holds; pages are independent, so a huge document only weighs on the
operators that cross pages (table continuation, heading levels).
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.grouped import map_groups
from foliant.operators.layout import OPEN_WORDS, PAGE


def _real(*names: str) -> list:
    """Columns as doubles in which a missing value is no number, so that it compares as false."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names]


@dataclass(frozen=True)
class Pairwise:
    """Costs of the pairwise paragraph merge."""

    gap: float = 1.8
    x_tolerance: float = 12
    height: float = 0.3
    least: float = 0.5
    sentence: float = 0.3


def pair_confidence(a: dict, b: dict, p: Pairwise = Pairwise()) -> float:
    """Confidence from 0 to 1 that ``b`` continues ``a``: gap, overlap, shift, height, sentence end, open end."""
    line = max(a["h"], b["h"], 1)
    gap, most = b["y"] - (a["y"] + a["h"]), line * p.gap
    sure = 1.0
    if gap > most:
        sure -= min(0.8, (gap - most) / most * 0.6)
    if gap < 0:
        sure -= 0.4
    shift = abs(b["x"] - a["x"])
    if shift > p.x_tolerance:
        cost = min(0.4, (shift - p.x_tolerance) / 60)
        sure -= cost * (0.4 if 8 < shift < 60 else 1)
    if a["h"] > 0 and b["h"] > 0 and abs(a["h"] - b["h"]) / max(a["h"], b["h"]) > p.height:
        sure -= 0.3
    left, right = a["text"].rstrip(), b["text"].lstrip()
    if left[-1:] in {".", "!", "?"} and right[:1].isupper():
        sure -= p.sentence
    if left and (left[-1] in ",;-—–" or left[-1].islower() and left[-1].isascii() or left.rsplit(None, 1)[-1].lower() in OPEN_WORDS):
        sure += 0.15
    return max(0.0, min(1.0, sure))


def pairwise_merge(nodes: DataFrame, p: Pairwise = Pairwise()) -> DataFrame:
    """(doc_id, page_number, paragraph, text, merged_from, x, y, w, h): each node is compared with what was merged so far."""

    def merge(page: list) -> list[tuple]:
        out: list[dict] = []
        for r in (r._asdict() for r in page):
            last = out[-1] if out else None
            if last and pair_confidence(last, r, p) >= p.least:
                right, bottom = max(last["x"] + last["w"], r["x"] + r["w"]), max(last["y"] + last["h"], r["y"] + r["h"])
                last["x"], last["y"] = min(last["x"], r["x"]), min(last["y"], r["y"])
                last |= {"w": right - last["x"], "h": bottom - last["y"], "text": f"{last['text']} {r['text']}".strip()}
                last["merged_from"].append(r["block_id"])
            else:
                out.append(r | {"merged_from": [r["block_id"]], "paragraph": len(out)})
        return [tuple(o[k] for k in (*PAGE, "paragraph", "text", "merged_from", "x", "y", "w", "h")) for o in out]

    own = nodes.where("role = 'P'").select(*PAGE, "seq", "block_id", "text", *_real("x", "y", "w", "h"))
    return map_groups(own, list(PAGE), ["y", "x", "seq"], merge, "doc_id long, page_number int, paragraph int, text string, merged_from array<string>, x double, y double, w double, h double")


def continued_tables(cells: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Adds table_id and repeated_header to rows (doc_id, page_number, seq, text, x, y, is_cell, is_header).

    A cell goes on with the open table near the last cell of the page, at one of its column anchors, or on the next
    page if two of its anchors occur there; anything that is no cell closes the table. A header text that the table
    has had before, on a page it went on to, is a repeated header.
    """
    near = max(15.0, page_width * 0.05)

    def go(document: list) -> list[tuple]:
        lead: dict[int, list[float]] = {}
        stopped = set()
        for r in document:  # left edges of the cells that open a page
            if not r.is_cell:
                stopped.add(r.page_number)
            elif r.page_number not in stopped:
                lead.setdefault(r.page_number, []).append(r.x)
        table, n, rows = None, 0, []
        for r in document:
            if not r.is_cell:
                table = None
                rows.append((r.doc_id, r.page_number, r.seq, None, False))
                continue
            crossed = by_anchor = False
            same = table is not None and table["page"] == r.page_number and abs(r.y - table["y"]) <= 48
            if same and abs(r.x - table["x"]) > 160:
                same = by_anchor = len(table["anchors"]) >= 2 and any(abs(a - r.x) <= near for a in table["anchors"])
            if table is not None and not same and table["page"] == r.page_number - 1:
                edges = [*lead.get(r.page_number, []), r.x]
                crossed = sum(any(abs(a - x) <= near for x in edges) for a in table["anchors"]) >= 2
            if not same and not crossed:
                n += 1
                table = {"id": f"table:{r.page_number}:{n}", "anchors": [], "headers": [], "came": None}
            if crossed:
                table["came"] = r.page_number
            table |= {"page": r.page_number, "x": r.x, "y": r.y}
            if r.x not in table["anchors"]:
                table["anchors"].append(r.x)
            again = r.is_header and r.text.strip() in table["headers"] and (crossed or by_anchor and table["came"] == r.page_number)
            if r.is_header and len(table["headers"]) < 20:
                table["headers"].append(r.text.strip())
            rows.append((r.doc_id, r.page_number, r.seq, table["id"], again))
        return rows

    own = cells.select(*PAGE, "seq", "text", *_real("x", "y"), "is_cell", "is_header")
    return map_groups(own, ["doc_id"], ["page_number", "seq"], go, "doc_id long, page_number int, seq int, table_id string, repeated_header boolean")


def next_level(level: int, known: dict[int, int]) -> int:
    """The level that a heading level not met before is given, from the nearest ones that were."""
    below, above = [k for k in known if k < level], [k for k in known if k > level]
    low = known[max(below)] + 1 if below else None
    if low is not None and above:
        low = min(low, known[min(above)])
    elif low is None:
        low = known[min(above)] - 1 if above else 1
    return min(6, max(1, low))


def heading_levels(nodes: DataFrame) -> DataFrame:
    """(doc_id, seq, level, normalized): levels in the order of first appearance, without gaps."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, int] = {}
        pdf = pdf.sort_values(["page_number", "seq"], kind="stable")
        for level in pdf["level"]:
            if level not in known:
                known[level] = next_level(level, known)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "seq": pdf["seq"], "level": pdf["level"], "normalized": [known[k] for k in pdf["level"]]})

    heads = nodes.where(F.col("role").rlike("^H[1-6]$")).select("doc_id", "page_number", "seq", F.substring("role", 2, 1).cast("int").alias("level"))
    return heads.groupBy("doc_id").applyInPandas(go, "doc_id long, seq int, level int, normalized int")


def claimed_runs(candidates: DataFrame, accept: float = 0.7) -> DataFrame:
    """Greedy one-to-one choice on every page from rows (doc_id, page_number, seq, start, length, score).

    Blocks in order take their best candidate whose runs are all free, by score, then fewer runs, then the first.
    """

    def go(page: list) -> list[tuple]:
        used: set[int] = set()
        taken = []
        for r in sorted(page, key=lambda r: (r.seq, -r.score, r.length, r.start)):
            runs = range(r.start, r.start + r.length)
            if r.score < accept or (taken and taken[-1][2] == r.seq) or any(k in used for k in runs):
                continue
            used.update(runs)
            taken.append((r.doc_id, r.page_number, r.seq, r.start, r.length, r.score))
        return taken

    own = candidates.where(F.col("score") >= accept).select(*PAGE, "seq", "start", "length", "score")
    return map_groups(own, list(PAGE), ["seq"], go, "doc_id long, page_number int, seq int, start int, length int, score double")


@dataclass(frozen=True)
class Margin:
    """Limits of the merge against a running margin."""

    gap: float = 2.5
    indent: float = 15
    height: float = 0.3
    listed: str = r"^\s*(?:[-*\u2022]|\(?\d+[.)]|\(?[a-zA-Z][.)])\s+"


def margin_groups(nodes: DataFrame, p: Margin = Margin()) -> DataFrame:
    """(doc_id, page_number, block_id, paragraph): lines stay together until something speaks against it.

    Against it speak a wide gap or an overlap, an indent from the group's leftmost edge so far, the end of an indented
    stretch, another height or column, and a list marker. The margin starts anew with every group.
    """
    import re

    marker = re.compile(p.listed)

    def parts(a: tuple, b: tuple, margin: float) -> bool:
        line = max(a.h, b.h, 1)
        gap = b.y - (a.y + a.h)
        return (
            gap > line * p.gap or gap < -line * 0.5 or b.x - margin > p.indent or (a.x - b.x > p.indent and a.x > margin + p.indent)
            or (min(a.h, b.h) > 0 and abs(a.h - b.h) / max(a.h, b.h) > p.height) or bool(marker.match(b.text)) or a.column_hint != b.column_hint
        )

    def group(page: list) -> list[tuple]:
        rows = sorted(page, key=lambda r: (r.y // 6, r.x, r.seq))
        out, margin, n = [], 0.0, -1
        for k, r in enumerate(rows):
            if k == 0 or parts(rows[k - 1], r, margin):
                n, margin = n + 1, r.x
            margin = min(margin, r.x)
            out.append((r.doc_id, r.page_number, r.block_id, n))
        return out

    own = nodes.where("role = 'P'").select(*PAGE, "seq", "block_id", "text", *_real("x", "y", "w", "h"), "column_hint")
    return map_groups(own, list(PAGE), ["seq"], group, "doc_id long, page_number int, block_id string, paragraph int")
