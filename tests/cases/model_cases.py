"""Known cases of text blocks and reading units, inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import layout, lines
from foliant.plans.registry import Registry

MODEL_CASES = Registry()


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of plain values."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


_ITEM = "doc_id long, page_number int, page_height double, seq int, str string, a double, b double, c double, d double, e double, f double, width double, height double, font_name string, has_eol boolean"


def _item(doc: int, seq: int, text: str, x: float, y: float, width: float, size: float = 12.0, font: str = "Helvetica", eol: bool = False, upright: bool = True) -> tuple:
    turn = (size, 0.0, 0.0, size) if upright else (0.0, size, -size, 0.0)
    return doc, 1, 792.0, seq, text, *turn, x, y, width, size, font, eol


#: Fragments of a line; a wide gap; a turned label; numbers in one item; ends of lines; hyphens, marks and brackets.
ITEMS = [
    _item(1, 0, "Hello", 72.0, 680.0, 30.0), _item(1, 1, "world", 110.0, 680.0, 32.0), _item(1, 2, "Next line", 72.0, 650.0, 50.0),
    _item(2, 0, "Left paragraph", 72.0, 680.0, 90.0), _item(2, 1, "Right note", 330.0, 680.0, 60.0),
    _item(3, 0, "60", 82.75, 503.25, 7.5, 6.75), _item(3, 1, "Inverse usage", 73.0, 503.75, 44.75, 6.75, "Helvetica-Bold", upright=False),
    _item(4, 0, "12.5 40% n/a", 100.0, 600.0, 120.0), _item(4, 1, " ", 300.0, 600.0, 5.0), _item(4, 2, "$7", 240.0, 600.0, 20.0),
    _item(5, 0, "end", 72.0, 500.0, 20.0, eol=True), _item(5, 1, "start", 95.0, 500.0, 30.0), _item(5, 2, "inter-", 72.0, 400.0, 40.0), _item(5, 3, "national", 120.0, 400.0, 50.0, 14.0, "Times"),
    _item(5, 4, ", (", 175.0, 400.0, 10.0, 14.0, "Times"), _item(5, 5, "note)", 190.0, 400.0, 30.0),
]
_TEXT_BLOCKS = [
    (1, "p1-b1", "Hello world", 72.0, 100.0, 70.0, 12.0, "Helvetica", "horizontal", 0), (1, "p1-b2", "Next line", 72.0, 130.0, 50.0, 12.0, "Helvetica", "horizontal", 0),
    (2, "p1-b1", "Left paragraph", 72.0, 100.0, 90.0, 12.0, "Helvetica", "horizontal", 0), (2, "p1-b2", "Right note", 330.0, 100.0, 60.0, 12.0, "Helvetica", "horizontal", 0),
    (3, "p1-b1", "Inverse usage", 66.25, 243.5, 6.75, 44.75, "Helvetica-Bold", "vertical", 90), (3, "p1-b2", "60", 82.75, 282.0, 7.5, 6.75, "Helvetica", "horizontal", 0),
    (4, "p1-b1", "12.5", 100.0, 180.0, 40.0, 12.0, "Helvetica", "horizontal", 0), (4, "p1-b2", "40%", 150.0, 180.0, 30.0, 12.0, "Helvetica", "horizontal", 0), (4, "p1-b3", "n/a", 190.0, 180.0, 30.0, 12.0, "Helvetica", "horizontal", 0),
    (4, "p1-b4", "$7", 240.0, 180.0, 20.0, 12.0, "Helvetica", "horizontal", 0), (5, "p1-b1", "end", 72.0, 280.0, 20.0, 12.0, "Helvetica", "horizontal", 0), (5, "p1-b2", "start", 95.0, 280.0, 30.0, 12.0, "Helvetica", "horizontal", 0),
    (5, "p1-b3", "national, (", 120.0, 378.0, 65.0, 14.0, "Times", "horizontal", 0), (5, "p1-b4", "inter-", 72.0, 380.0, 40.0, 12.0, "Helvetica", "horizontal", 0), (5, "p1-b5", "note)", 190.0, 380.0, 30.0, 12.0, "Helvetica", "horizontal", 0),
]


@MODEL_CASES.query("case_text_blocks", _values("doc_id, block_id, text, x, y, w, h, font_name, mode, rotation", _TEXT_BLOCKS))
def case_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Operators 3 to 13: items to blocks on the known cases."""
    b = lines.text_blocks(spark.createDataFrame(ITEMS, _ITEM))
    return b.select("doc_id", "block_id", "text", *[F.round(c, 6).alias(c) for c in "xywh"], "font_name", "mode", "rotation")


_NODE = "doc_id long, page_number int, seq int, block_id string, role string, x double, y double, column_hint int, artifact_type string, table_id string, table_row_index int, table_column_index int, list_group_id string, list_item_index int"
#: A page with header, list, table and footer; three columns by hints; a line with a jittering top; bands without hints; a late hint.
NODES = [
    (1, 1, 0, "header", "Artifact", 72.0, 12.0, None, "header", None, None, None, None, None), (1, 1, 1, "list-2", "LI", 72.0, 88.0, None, None, None, None, None, "list-a", 1), (1, 1, 2, "list-1", "LI", 72.0, 70.0, None, None, None, None, None, "list-a", 0),
    (1, 1, 3, "cell-2", "TH", 220.0, 120.0, 0, None, "tbl-1", 0, 1, None, None), (1, 1, 4, "cell-1", "TH", 72.0, 120.0, 0, None, "tbl-1", 0, 0, None, None), (1, 1, 5, "cell-3", "TD", 72.0, 140.0, 0, None, "tbl-1", 1, 0, None, None),
    (1, 1, 6, "footer", "Artifact", 72.0, 700.0, None, "footer", None, None, None, None, None), (1, 1, 7, "closing", "P", 72.0, 710.0, 0, None, None, None, None, None, None),
    (2, 1, 0, "a", "P", 72.0, 100.0, 0, None, None, None, None, None, None), (2, 1, 1, "b", "P", 330.0, 20.0, 1, None, None, None, None, None, None), (2, 1, 2, "c", "P", 72.0, 200.0, 0, None, None, None, None, None, None),
    (3, 1, 0, "paul", "P", 70.0, 141.0, None, None, None, None, None, None, None), (3, 1, 1, "amp", "P", 119.0, 141.0, None, None, None, None, None, None, None), (3, 1, 2, "dec", "P", 98.0, 142.0, None, None, None, None, None, None, None),
    (4, 1, 0, "right-1", "P", 400.0, 50.0, None, None, None, None, None, None, None), (4, 1, 1, "left-1", "H1", 60.0, 300.0, None, None, None, None, None, None, None), (4, 1, 2, "left-2", "P", 70.0, 320.0, None, None, None, None, None, None, None), (4, 1, 3, "right-2", "P", 410.0, 90.0, None, None, None, None, None, None, None),
]
_ORDERS = {1: "header list-1 list-2 cell-1 cell-2 cell-3 closing footer", 2: "a c b", 3: "paul dec amp", 4: "left-1 left-2 right-1 right-2"}


@MODEL_CASES.query("case_reading_units", _values("doc_id, block_id, reading_order", [(d, b, k) for d, ids in _ORDERS.items() for k, b in enumerate(ids.split())]))
def case_reading_units(spark: SparkSession, d: str) -> DataFrame:
    """Operators 105 to 108: phases, list and table units and computed columns on the known cases."""
    return layout.reading_order(spark.createDataFrame(NODES, _NODE)).select("doc_id", "block_id", "reading_order")
