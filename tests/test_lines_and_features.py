"""Line assembly, reading order and node features against plain versions on random rows."""

import math
import random
import re
from functools import cmp_to_key

from pyspark.sql import functions as F

from foliant.operators import features, layout, lines
from tests.cases.model_cases import _ITEM, _NODE, _item

NUMBER = re.compile(r"^-?(?:[$£€¥])?(?:\d+(?:[.,]\d+)*|\d*\.\d+)(?:%)?$|^n/a$", re.I)


def plain_blocks(items):
    segments = []
    for _, _, page_h, seq, text, a, b, c, d, e, f, width, height, font, eol in items:
        if not text.strip():
            continue
        size = max(height, abs(a), abs(b), abs(c), abs(d), 1)
        turn = round(math.degrees(math.atan2(b, a)) % 360 / 90) * 90 % 360
        ux, uy, vx, vy = (v / n for v, n in zip((a, b, c, d), [math.hypot(a, b)] * 2 + [math.hypot(c, d)] * 2))
        xs, ys = zip(*((e + i * ux * width + j * vx * height, f + i * uy * width + j * vy * height) for i in (0, 1) for j in (0, 1)))
        base = {"y": page_h - max(ys), "h": max(ys) - min(ys), "size": size, "font": font, "mode": "vertical" if turn in (90, 270) else "horizontal", "turn": turn}
        x, w, tokens = min(xs), max(xs) - min(xs), text.split()
        if base["mode"] == "horizontal" and len(tokens) > 1 and all(map(NUMBER.match, tokens)):
            step, at = w / len(text.strip()), 0
            for k, t in enumerate(tokens):
                at = text.index(t, at)
                segments.append(base | {"x": x + at * step, "w": max(len(t) * step, 1), "text": t, "eol": eol and k == len(tokens) - 1, "forced": k < len(tokens) - 1, "key": (seq, k)})
                at += len(t)
        else:
            segments.append(base | {"x": x, "w": w, "text": text, "eol": eol, "forced": False, "key": (seq, 0)})
    segments.sort(key=lambda s: (s["y"], s["x"], s["key"]))

    def level(p, n, at, size):
        small = max(2, min(p["size"], n["size"]) * 0.45)
        over = min(p[at] + p[size], n[at] + n[size]) - max(p[at], n[at])
        return abs(p[at] + p[size] / 2 - n[at] - n[size] / 2) <= small and over >= min(p[size], n[size]) * 0.35

    def same(p, n):
        if p["mode"] != n["mode"]:
            return False
        if p["mode"] == "vertical":
            return level(p, n, "x", "w") and n["y"] - p["y"] - p["h"] <= max(2, min(p["size"], n["size"]) * 0.5)
        return level(p, n, "y", "h")

    def wide(p, n):
        if "vertical" in (p["mode"], n["mode"]):
            return False
        gap = n["x"] - (p["x"] + p["w"])
        if NUMBER.match(p["text"].strip()) and NUMBER.match(n["text"].strip()):
            return gap >= max(3, min(p["size"], n["size"]) * 0.55)
        return gap > max(24, p["size"] * 2.5)

    rows = []
    for s in segments:
        p = rows[-1][-1] if rows else None
        if not p or p["eol"] or p["forced"] or not same(p, s) or wide(p, s) or s["x"] < p["x"] - max(p["size"], s["size"]):
            rows.append([])
        rows[-1].append(s)
    out = []
    for k, row in enumerate(rows):
        row = sorted(row, key=lambda s: s["x"])
        text = row[0]["text"]
        for p, n in zip(row, row[1:]):
            a, b = p["text"], n["text"]
            space = p["mode"] == n["mode"] and not a[-1:].isspace() and not b[:1].isspace() and not a.endswith(("-", "(")) and b[:1] not in ",.;:!?)" and n["x"] - p["x"] - p["w"] > max(1.5, p["size"] * 0.18)
            text += " " * space + b
        first = lambda name: max([s[name] for s in row], key=[s[name] for s in row].count)
        out.append((min(s["y"] for s in row), min(s["x"] for s in row), k, " ".join(text.split()), first("font"), first("mode"), first("turn"), max(s["size"] for s in row)))
    return [(f"p1-b{i + 1}", *b[3:], round(b[1], 6), round(b[0], 6)) for i, b in enumerate(sorted(out))]


def test_blocks_against_a_plain_version(spark):
    r, items = random.Random(5), []
    words = ["alpha", "beta-", "(", ")", ", and", "12", "3.5%", "n/a", "$4 17", "1 2 3", " lead", "trail ", "x", "7,5  8"]
    for doc in range(120):
        for seq in range(r.randint(0, 14)):
            text = r.choice(words)
            items.append(_item(doc, seq, text, 72.0 + r.choice([0, 8, 20, 40, 60, 100]) + 3 * seq, 600.0 + r.choice([0, 0, 1, 4, 20]), 6.0 * len(text) + r.choice([0, 1]), r.choice([8.0, 12.0, 20.0]), r.choice(["A", "B"]), r.random() < 0.1, r.random() < 0.85))
    got = {}
    for b in lines.text_blocks(spark.createDataFrame(items, _ITEM).repartition(5)).collect():
        got.setdefault(b.doc_id, []).append((b.block_id, b.text, b.font_name, b["mode"], b.rotation, b.font_size, round(b.x, 6), round(b.y, 6)))
    number = lambda b: int(b[0].split("b")[1])
    for doc in range(120):
        assert sorted(got.get(doc, []), key=number) == plain_blocks([i for i in items if i[0] == doc]), doc
    assert lines.text_blocks(spark.createDataFrame([], _ITEM)).count() == 0


def plain_order(nodes):
    """One page: units, their columns, then a comparison sort in the order of phases and nodes."""
    units = {}
    for _, _, seq, i, role, x, y, hint, art, table, row, col, group, item in nodes:
        phase = {"header": 0, "footer": 2}.get(art, 1)
        if phase == 1 and (role in ("Table", "TH", "TD") or table or row is not None or col is not None):
            key, rank, pr, name = ("t", table or f"1:{i}"), (row or 0, col or 0), 3, f"table:{table or f'1:{i}'}"
        elif phase == 1 and (role == "LI" or group):
            key, rank, pr, name = ("l", group or i), (item or 0, 0), 1, f"list:{group or i}"
        else:
            key, rank, pr, name = ("n", seq), (0, 0), 0 if phase != 1 else {"H1": 0, "LI": 1, "P": 2, "TH": 3, "TD": 3, "Table": 4}.get(role, 5), i
        units.setdefault(key, {"phase": phase, "pr": pr, "name": name, "m": [], "seq": seq})["m"].append((*rank, y, x, i, seq, hint if phase == 1 else None))
    body = [m for u in units.values() if u["phase"] == 1 for m in u["m"]]
    hints = sorted({m[6] for m in body if m[6] is not None})
    xs, bands = sorted(m[3] for m in body), []
    for x in xs:
        if bands and x - bands[-1][1] <= max(64, (xs[-1] - xs[0]) * 0.18):
            bands[-1][1] = x
        else:
            bands.append([x, x])
    for u in units.values():
        u["m"].sort(key=lambda m: m[:6])
        u["top"], u["left"] = min(m[2] for m in u["m"]), min(m[3] for m in u["m"])
        own = [m[6] for m in u["m"] if m[6] is not None]
        if u["phase"] != 1:
            u["col"] = 0
        elif own:
            u["col"] = own[0]
        elif hints:
            u["col"] = hints[0] if len(hints) > 1 else 0
        else:
            u["col"] = min(range(len(bands)), key=lambda k: abs(u["left"] - sum(bands[k]) / 2)) if len(bands) > 1 else 0

    def compare(a, b):
        for k in ("phase", "col"):
            if a[k] != b[k]:
                return a[k] - b[k]
        if abs(a["top"] - b["top"]) >= 6:
            return a["top"] - b["top"]
        x, y = ((u["left"], u["pr"], u["name"]) for u in (a, b))
        return (x > y) - (x < y)

    rows = sorted(sorted(units.values(), key=lambda u: (u["phase"], u["seq"])), key=cmp_to_key(compare))
    return [m[4] for u in rows for m in u["m"]]


def test_reading_order_against_a_plain_version(spark):
    r, nodes = random.Random(9), []
    for doc in range(150):
        hinted = r.random() < 0.4
        for seq in range(r.randint(1, 12)):
            kind = r.choice(["P", "P", "H1", "LI", "TD", "Artifact"])
            nodes.append((
                doc, 1, seq, f"n{r.randint(0, 99)}-{seq}", kind, float(r.choice([60, 70, 200, 330, 400])), float(r.choice([20, 40, 60, 62, 100, 200])), r.choice([None, 0, 1]) if hinted else None,
                r.choice(["header", "footer", None]) if kind == "Artifact" else None, r.choice(["t1", None]) if kind == "TD" else None, r.choice([0, 1, None]) if kind == "TD" else None, None, r.choice(["g", None]) if kind == "LI" else None, r.choice([0, 1]) if kind == "LI" else None,
            ))
    got = {}
    for x in layout.reading_order(spark.createDataFrame(nodes, _NODE).repartition(4)).orderBy("doc_id", "reading_order").collect():
        got.setdefault(x.doc_id, []).append(x.block_id)
    for doc in range(150):
        assert got[doc] == plain_order([n for n in nodes if n[0] == doc]), doc


def test_features_of_a_node(spark):
    nodes = spark.createDataFrame([
        (1, 1, 0, "n0", "b0", "H1", "TOTAL REPORT:", 50.0, 40.0, 300.0, 24.0, 0, 0, 1, 0.95), (1, 1, 1, "n1", "b1", "P", "• see https://x.org 50% $3", 60.0, 80.0, 100.0, 10.0, None, 1, None, None), (1, 1, 2, "n2", "none", "P", "", 300.0, 760.0, 5.0, 5.0, 1, 2, None, 0.2),
    ], "doc_id long, page_number int, seq int, node_id string, source_block_id string, role string, text string, x double, y double, w double, h double, column_hint int, reading_order int, heading_level int, confidence double")
    blocks = spark.createDataFrame([(1, 1, "b0", 24.0, "Times-Bold", "heading", 1, None), (1, 1, "b1", 12.0, "Courier", None, None, 3), (1, 1, "b2", 12.0, "", None, None, None)], "doc_id long, page_number int, block_id string, font_size double, font_name string, block_type string, heading_level int, table_row_index int")
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0)], "doc_id long, page_number int, width double, height double")
    got = {x.node_id: dict(f.rsplit(":", 1) for f in x.features) for x in features.role_features(nodes, blocks, pages).collect()}
    assert {len(f) for f in got.values()} == {50}
    want = {"page:xq": "0", "page:w": "3", "page:h": "2", "page:top": "yes", "text:upper": "3", "text:ends-colon": "yes", "text:table-markers": "yes", "text:first-token": "upper", "text:last-token": "label", "layout:block-type": "heading", "layout:font-class": "serif", "layout:font-ratio": "5", "node:heading-level": "1", "node:confidence": "4", "node:order": "0", "neighbor:prev-gap": "none", "neighbor:next-gap": "3", "neighbor:next-x": "indented", "neighbor:next-words": "2"}
    assert {k: got["n0"][k] for k in want} == want
    want = {"text:bullet": "yes", "text:contains-url": "yes", "text:percent": "yes", "text:currency": "yes", "layout:font-class": "mono", "layout:table-row": "2", "layout:block-type": "unknown", "node:column": "none", "node:confidence": "0", "node:order": "2", "neighbor:prev-x": "indented", "neighbor:next-words": "0"}
    assert {k: got["n1"][k] for k in want} == want
    want = {"page:bottom": "yes", "text:empty": "yes", "text:chars": "0", "text:first-token": "none", "layout:font-class": "unknown", "layout:font-ratio": "0", "neighbor:next-gap": "none"}
    assert {k: got["n2"][k] for k in want} == want


def test_merger_rules(spark):
    rows = [(1, 10, False, 0, 0.0, 1.0, 10.0), (2, 30, True, 0, 0.0, 1.0, 10.0), (3, 30, False, 1, 0.5, 1.0, 10.0), (4, 30, False, 0, 0.2, 0.5, 10.0), (5, 30, False, 0, 0.0, 0.5, 10.0), (6, 30, False, 0, 0.0, 1.0, 6000.0), (7, 30, False, 0, 0.0, 1.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, n_nodes long, is_legal boolean, max_column int, heading_ratio double, mean_confidence double, density double").withColumns({"has_columns": F.col("max_column") >= 1, "is_scanned": F.col("mean_confidence") < 0.75})
    pick = lambda available: [(x.rule, x.version) for x in features.select_merger(df, available).orderBy("doc_id").collect()]
    assert pick(["v1-conservative", "v2-balanced", "v6-hybrid", "v7-refined", "v8-precision"]) == [("few-nodes", "v1-conservative"), ("legal", "v7-refined"), ("columns", "v8-precision"), ("headings", "v2-balanced"), ("scanned", "v6-hybrid"), ("dense", "v7-refined"), ("default", "v7-refined")]
    assert pick(["v3-aggressive"])[4:] == [("scanned", "v3-aggressive"), ("dense", "v3-aggressive"), ("none", "v3-aggressive")] and pick([])[0] == ("none", "v2-balanced")
