"""Known cases of tags, tables' sections, fonts, abbreviations, findings and tables, inline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import findings, fonts, tables, tags
from foliant.plans.registry import Registry
from tests.cases.model_cases import _values

TAG_CASES = Registry()


_NODES = "doc_id long, page_number int, seq int, role string, text string, table_id string, table_row_index int"
#: Six levels of headings, lists that an artifact parts, items with markers, tables of two ids, a row that is taken up again.
NODES = [
    (1, 1, 0, "H1", "One", None, None), (1, 1, 1, "P", "text", None, None), (1, 1, 2, "H3", "Deep", None, None), (1, 1, 3, "H2", "Two", None, None), (1, 1, 4, "LI", "1. first", None, None), (1, 1, 5, "LI", "plain", None, None),
    (1, 1, 6, "Artifact", "3", None, None), (1, 2, 7, "LI", "• dot", None, None), (1, 2, 8, "TH", "Name", "t1", 0), (1, 2, 9, "TD", "x", "t1", 1), (1, 2, 10, "TH", "Size", "t1", 0), (1, 2, 11, "TD", "y", "t2", 0), (1, 2, 12, "H1", "End", None, None), (1, 2, 13, "Figure", "pic", None, None),
]
_TREE = [
    ("tag:section:0", "Sect", 1, None, None), ("tag:0", "H1", 2, "One", 0), ("tag:0:span", "Span", 3, "One", 0), ("tag:1", "P", 2, "text", 1), ("tag:1:span", "Span", 3, "text", 1), ("tag:section:2", "Sect", 2, None, None), ("tag:2", "H3", 3, "Deep", 2), ("tag:2:span", "Span", 4, "Deep", 2),
    ("tag:section:3", "Sect", 2, None, None), ("tag:3", "H2", 3, "Two", 3), ("tag:3:span", "Span", 4, "Two", 3), ("tag:list:4", "L", 3, None, None), ("tag:4", "LI", 4, None, 4), ("tag:4:lbl", "Lbl", 5, "1.", None), ("tag:4:lbody", "LBody", 5, "first", 4), ("tag:5", "LI", 4, None, 5),
    ("tag:list:7", "L", 3, None, None), ("tag:7", "LI", 4, None, 7), ("tag:7:lbl", "Lbl", 5, "•", None), ("tag:7:lbody", "LBody", 5, "dot", 7), ("tag:table:t1", "Table", 3, None, None), ("tag:table:t1:row:0", "TR", 4, None, None), ("tag:8", "TH", 5, "Name", 8), ("tag:10", "TH", 5, "Size", 10),
    ("tag:table:t1:row:1", "TR", 4, None, None), ("tag:9", "TD", 5, "x", 9), ("tag:table:t2", "Table", 3, None, None), ("tag:table:t2:row:0", "TR", 4, None, None), ("tag:11", "TD", 5, "y", 11), ("tag:section:12", "Sect", 1, None, None), ("tag:12", "H1", 2, "End", 12), ("tag:12:span", "Span", 3, "End", 12),
    ("tag:13", "Figure", 2, "pic", 13),
]
#: The node of a tag whose span or body has it stands there alone.
_OWN = {i for i, kind, *_ in _TREE if kind in ("Span", "LBody", "TH", "TD")} | {"tag:5", "tag:13"}


@TAG_CASES.query("case_tag_tree", _values("position, tag_id, type, depth, label, source_role", [(k, i, t, d, label, NODES[s][3] if s is not None and i in _OWN else None) for k, (i, t, d, label, s) in enumerate(_TREE)]))
def case_tag_tree(spark: SparkSession, d: str) -> DataFrame:
    """Operators 49, 152, 153, 164: the tree of the known nodes in preorder, with the roles they come from."""
    n = spark.createDataFrame(NODES, _NODES)
    return tags.with_source(tags.preorder(tags.tag_tree(n)), n).select("position", "tag_id", "type", "depth", "label", "source_role")


_CELLS = "doc_id long, table_id string, row int, col int, type string, text string, table_section string"


def _table(doc: int, name: str, *rows: str) -> list[tuple]:
    """Cells of a table: * marks a header cell, a row may begin with its section and a colon."""
    out = []
    for r, line in enumerate(rows):
        section, _, cells = line.rpartition("::")
        out += [(doc, name, r, c, "TH" if v.startswith("*") else "TD", v.lstrip("*"), section or None) for c, v in enumerate(cells.split("|"))]
    return out


#: Tables: a plain header, capitals in the first row, headers of rows, a foot, a head alone, a second header row with one plain cell, prose, figures.
CELLS = [
    *_table(1, "plain", "*Name|*Size", "a|b", "c|d"), *_table(1, "capitals", "NAME|SIZE", "a|b"), *_table(1, "by-rows", "*a|b", "*c|d"), *_table(1, "foot", "*A|*B", "x|y", "foot::sum|z"), *_table(1, "alone", "*A|*B"),
    *_table(1, "second", "*A|*B|*C|*D", "*1|*2|*3|x", "a|b|c|d"), *_table(1, "prose", "Filed|by the clerk", "of court"), *_table(1, "figures", "apples|12 kg", "pears|3"), *_table(1, "said", "head::a|b", "c|d"),
]
_SECTIONS = {"plain": "head body body", "capitals": "head body", "by-rows": "body body", "foot": "head body foot", "alone": "body", "second": "head head body", "prose": "body body", "figures": "body body", "said": "head body"}


@TAG_CASES.query("case_table_sections", _values("table_id, row, section", [(t, k, s) for t, v in _SECTIONS.items() for k, s in enumerate(v.split())]))
def case_table_sections(spark: SparkSession, d: str) -> DataFrame:
    """Operator 154: head, body and foot of the known tables."""
    return tags.table_sections(spark.createDataFrame(CELLS, _CELLS)).select("table_id", "row", "section")


@TAG_CASES.query("case_spurious_tables", _values("table_id, demoted, text", [(t, t in ("capitals", "prose", "said"), {"capitals": "NAME SIZE a b", "prose": "Filed by the clerk of court", "said": "a b c d"}.get(t)) for t in _SECTIONS]))
def case_spurious_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operator 160: small tables without a header or figures are prose."""
    return tags.spurious_tables(spark.createDataFrame(CELLS, _CELLS)).select("table_id", "demoted", "text")


_FONTS = [
    ("ABCDEF+Arial-BoldMT", "Helvetica-Bold", "NotoSans-Bold"), ("TimesNewRomanPSMT", "Times-Roman", "NotoSerif-Regular"), ("Courier-BoldOblique", "Courier-BoldOblique", "NotoSansMono-MonoBold"), ("Symbol", "Symbol", "NotoSansSymbols-Regular"),
    ("ZapfDingbats", "ZapfDingbats", "NotoSansSymbols2-Regular"), ("Garamond", "Garamond", None), (None, "", None), ("ABCDE+Arial", "ABCDE+Arial", None), ("Helvetica-BoldOblique", "Helvetica-BoldOblique", "NotoSans-BoldItalic"),
]


@TAG_CASES.query("case_font_names", _values("name, canonical, fallback", _FONTS))
def case_font_names(spark: SparkSession, d: str) -> DataFrame:
    """Operator 194: standard fonts by whatever name, and what stands in for them."""
    f = spark.createDataFrame([(n,) for n, _, _ in _FONTS], "name string")
    return f.select("name", fonts.canonical_font(F.col("name")).alias("canonical"), fonts.fallback_font(F.col("name")).alias("fallback"))


_GLYPHS = [("A", 65), ("z", 122), ("space", 32), ("quoteleft", 0x2018), ("uni20AC", 0x20AC), ("u1F600", 0x1F600), ("uni20ac", None), ("u12", None), (".notdef", 0), ("nosuch", None), ("divide", 0xF7), ("nine", 0x39)]


@TAG_CASES.query("case_glyph_names", _values("name, code", _GLYPHS))
def case_glyph_names(spark: SparkSession, d: str) -> DataFrame:
    """Operator 190: code points of glyph names."""
    return spark.createDataFrame([(n,) for n, _ in _GLYPHS], "name string").select("name", fonts.glyph_code(F.col("name")).alias("code"))


_SPANS = [("The PDF, an ISO norm (HTML5) by the UN.", "PDF:4-7 ISO:12-15 UN:36-38"), ("W3C W3Cx xUN HTTPS", "W3C:0-3 HTTPS:13-18"), ("", ""), ("ABC É UK", "UK:6-8")]


@TAG_CASES.query("case_abbreviations", _values("text, spans", _SPANS))
def case_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    """Operator 151: known abbreviations with their places."""
    s = T.abbreviation_spans(F.col("text"))
    line = F.array_join(F.transform(s, lambda x: F.concat(x["token"], F.lit(":"), x["start"], F.lit("-"), x["end"])), " ")
    return spark.createDataFrame([(t,) for t, _ in _SPANS], "text string").select("text", line.alias("spans"))


_REPORT = '{"taskException": {"message": "boom"}, "details": {"ruleSummaries": [{"status": "failed", "clause": "7.1", "testNumber": 3, "failedChecks": 2}, {"ruleStatus": "FAILED", "clause": "6.2-b"}, {"status": "passed", "clause": "1"}]}}'


@TAG_CASES.query("case_findings", _values("id, severity, code, failed_checks", [
    (1, "error", "VERAPDF_TASK_EXCEPTION", 0), (1, "error", "VERAPDF_7_1_3", 2), (1, "error", "VERAPDF_6_2_B_RULE", 0), (3, "error", "INVALID_TAGGING_MANIFEST", None), (3, "error", "MISSING_DOCUMENT_ROOT", None), (3, "warning", "NATIVE_TAGGING_NOT_APPLIED", None), (5, "warning", "NATIVE_TAGGING_NOT_APPLIED", None),
]))
def case_findings(spark: SparkSession, d: str) -> DataFrame:
    """Operator 197: findings of reports and manifests."""
    reports = spark.createDataFrame([(1, _REPORT), (2, '{"details": {}}')], "id long, report string")
    manifests = spark.createDataFrame([(3, "{}", True), (4, '{"tagging": {"root": {"type": "Document"}}, "nativeTaggingApplied": true}', True), (5, '{"tagging": {"root": {"type": "Document"}}}', True)], "id long, manifest string, tagging_valid boolean")
    found = findings.report_findings(reports).select("id", "severity", "code", "failed_checks")
    return found.unionByName(findings.manifest_findings(manifests).withColumn("failed_checks", F.lit(None).cast("int")))


_BOX = "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, font_size double, font_name string"


def _grid(doc: int, font: str, top: float, rows: list[str], columns: tuple[float, ...] = (72.0, 200.0, 330.0), step: float = 18.0, head: str = "Helvetica-Bold") -> list[tuple]:
    """Blocks of lines of cells that | parts, the first line in the font ``head``."""
    return [
        (doc, 1, 10 * r + c, f"b{10 * r + c}", t, columns[c], top + step * r, 7.0 * len(t), 12.0, 10.0, head if r == 0 else font) for r, line in enumerate(rows) for c, t in enumerate(line.split("|"))
    ]


#: A wide grid; a tight one, whose blocks stand without real gaps; labels with values, which are no table; ruled cells.
BLOCKS = [
    *_grid(1, "Helvetica", 100.0, ["Name|Size|Cost", "apples|12|3.50", "pears|7|1.25"]), *_grid(2, "Helvetica", 100.0, ["alpha|betas|gamma", "aaaaa|bbbbb|ccccc", "ddddd|eeeee|fffff"], (72.0, 117.0, 162.0)),
    *_grid(3, "Helvetica", 100.0, ["Name:|Jo", "Place:|Rome"], (72.0, 300.0), head="Helvetica"), *_grid(4, "Helvetica", 100.0, ["Total|x|y", "one|1|2", "two|3|4"], head="Helvetica"),
]
_CELL = "doc_id long, page_number int, table_id string, row int, col int, row_span int, column_span int, confidence double, block_ids array<string>"
RULED = [(4, 1, "ruled", r, c, None, 2 if (r, c) == (0, 0) else None, 0.9, [f"b{10 * r + c}"]) for r in range(3) for c in range(3)]


def _cells_of(doc: int, table: str, method: str, confidence: float, n_rows: int = 3, n_cols: int = 3) -> list[tuple]:
    return [(doc, f"b{10 * r + c}", table, "header" if r == 0 else "cell", r, c, confidence, method) for r in range(n_rows) for c in range(n_cols)]


@TAG_CASES.query("case_detected_tables", _values("doc_id, block_id, table_id, table_role, table_row, table_column, confidence, method", [
    *_cells_of(1, "table:1:1", "text-grid", 0.97), *_cells_of(2, "table:1:borderless:1", "borderless-alignment", 0.88), *_cells_of(4, "ruled", "vector-grid", 0.9),
]))
def case_detected_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operators 43 to 45, 137, 139, 140, 142: the detectors one after another on the known pages."""
    out = tables.detected_tables(spark.createDataFrame(BLOCKS, _BOX), spark.createDataFrame(RULED, _CELL))
    return out.drop("page_number")


_LINKED = "doc_id long, table_id string, cell_id string, type string, section string, row int, col int, row_span int, column_span int"
#: A head of two rows with a merged cell, headers of rows, one of them over two rows; a table whose first row heads it.
LINKED = [
    (1, "t", "all", "TH", "head", 0, 0, 2, 1), (1, "t", "both", "TH", "head", 0, 1, 1, 2), (1, "t", "a", "TH", "head", 1, 1, None, None), (1, "t", "b", "TH", "head", 1, 2, None, None),
    (1, "t", "r1", "TH", "body", 2, 0, 2, None), (1, "t", "x", "TD", "body", 2, 1, None, None), (1, "t", "y", "TD", "body", 2, 2, None, None), (1, "t", "z", "TD", "body", 3, 1, 1, 2),
    (2, "u", "h", "TH", None, 0, 0, None, None), (2, "u", "v", "TD", None, 1, 0, None, None), (2, "u", "w", "TD", None, 1, 1, None, None),
]


@TAG_CASES.query("case_header_links", _values("table_id, cell_id, headers", [("t", "x", "both a r1"), ("t", "y", "both b r1"), ("t", "z", "both a b r1"), ("u", "v", "h"), ("u", "w", "")]))
def case_header_links(spark: SparkSession, d: str) -> DataFrame:
    """Operators 60, 162: data cells and their headers, by column and by row, spans spread out."""
    return tags.header_links(spark.createDataFrame(LINKED, _LINKED)).select("table_id", "cell_id", F.array_join("headers", " ").alias("headers"))


_FIELDS = [("Radio", "RB"), ("checkbox", "CB"), ("btn", "PB"), ("pushbutton", "PB"), ("Text", "TV"), (None, "TV"), ("Sig", "TV")]


@TAG_CASES.query("case_field_roles", _values("subtype, role", _FIELDS))
def case_field_roles(spark: SparkSession, d: str) -> DataFrame:
    """Operator 163: roles of form fields in print."""
    return spark.createDataFrame([(s,) for s, _ in _FIELDS], "subtype string").select("subtype", tags.field_role(F.col("subtype")).alias("role"))
