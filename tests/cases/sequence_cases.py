"""Known cases, inline, of operators that SQL cannot state: greedy, comparison-based and running ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import layout, sequences, tables
from foliant.plans.registry import Registry
from tests.cases.model_cases import _values

CASES = Registry()

_CELL = "doc_id long, page_number int, seq int, text string, x double, y double, is_cell boolean, is_header boolean"
#: A table that goes on over a page where its columns line up, with its header again; one whose columns have moved; one that text ends.
CELLS = [
    (1, 1, 0, "A", 72.0, 700.0, True, True), (1, 1, 1, "B", 200.0, 700.0, True, True), (1, 2, 2, "A", 72.0, 72.0, True, True), (1, 2, 3, "B", 200.0, 72.0, True, True),
    (2, 1, 0, "A", 72.0, 700.0, True, True), (2, 1, 1, "B", 200.0, 700.0, True, True), (2, 2, 2, "A", 320.0, 72.0, True, True), (2, 2, 3, "B", 450.0, 72.0, True, True),
    (3, 1, 0, "A", 72.0, 100.0, True, False), (3, 1, 1, "prose", 72.0, 112.0, False, False), (3, 1, 2, "B", 72.0, 124.0, True, False),
]


@CASES.query("case_continued_tables", _values("doc_id, seq, part, repeated", [(1, 0, 1, False), (1, 1, 1, False), (1, 2, 1, True), (1, 3, 1, False), (2, 0, 1, False), (2, 1, 1, False), (2, 2, 2, False), (2, 3, 2, False), (3, 0, 1, False), (3, 1, None, False), (3, 2, 2, False)]))
def case_continued_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operators 119, 120: tables over pages and headers that are repeated; a document's tables are numbered as they come."""
    c = sequences.continued_tables(spark.createDataFrame(CELLS, _CELL))
    first = c.where("table_id IS NOT NULL").groupBy("doc_id", "table_id").agg(F.min("seq").alias("first"))
    j = c.join(first, ["doc_id", "table_id"], "left")
    part = F.when(F.col("table_id").isNotNull(), F.when(F.col("first") == 0, 1).otherwise(2))
    return j.select("doc_id", "seq", part.alias("part"), F.coalesce("repeated_header", F.lit(False)).alias("repeated"))


_RULE = "doc_id long, page_number int, segment_id long, orient string, at double, start double, end double"


@CASES.query("case_ruled_tables", _values("segment_id, table_id", [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]))
def case_ruled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Operators 53, 144: rules that cross within 3 points are one table; one that crosses none stands alone."""
    rows = [(1, 1, 1, "h", 100.0, 0.0, 50.0), (1, 1, 2, "v", 49.0, 98.0, 200.0), (1, 1, 3, "h", 300.0, 0.0, 50.0), (1, 1, 4, "v", 20.0, 301.0, 400.0), (1, 1, 5, "h", 600.0, 0.0, 50.0)]
    return layout.ruled_tables(spark.createDataFrame(rows, _RULE)).select("segment_id", "table_id")


@CASES.query("case_distinct_boxes", _values("seq", [(0,), (2,), (3,), (4,)]))
def case_distinct_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Operators 26, 27: a box goes if it overlaps a kept one of equal text, not if only a dropped one; empty texts stay."""
    rows = [(1, 1, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "a", 2.0, 0.0, 10.0, 10.0), (1, 1, 2, "a", 4.0, 0.0, 10.0, 10.0), (1, 1, 3, "", 0.0, 0.0, 10.0, 10.0), (1, 1, 4, "", 0.0, 0.0, 10.0, 10.0)]
    return layout.distinct_boxes(spark.createDataFrame(rows, "doc_id long, page_number int, seq int, comparable string, x double, y double, w double, h double")).select("seq")


@CASES.query("case_claimed_runs", _values("seq, start, length", [(0, 0, 1), (1, 1, 1)]))
def case_claimed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Operators 50, 147: blocks claim runs in turn, and a run is claimed once."""
    rows = [(1, 1, 0, 0, 2, 0.9), (1, 1, 0, 0, 1, 0.9), (1, 1, 1, 0, 1, 0.95), (1, 1, 1, 1, 1, 0.8), (1, 1, 2, 2, 1, 0.6)]
    return sequences.claimed_runs(spark.createDataFrame(rows, "doc_id long, page_number int, seq int, start int, length int, score double")).select("seq", "start", "length")


_LINE = "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, column_hint int, role string"


@CASES.query("case_margin_paragraphs", _values("block_id, paragraph", [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2), ("f", 3)]))
def case_margin_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Operator 113: lines against a running margin: an indent, a list item and a gap begin a paragraph."""
    lines = [("a", 72, 100), ("b", 72, 114), ("c", 90, 128), ("d", 72, 142), ("- e", 72, 156), ("f", 72, 230)]
    rows = [(1, 1, k, t[-1], t, float(x), float(y), 200.0, 12.0, 0, "P") for k, (t, x, y) in enumerate(lines)]
    return sequences.margin_groups(spark.createDataFrame(rows, _LINE)).select("block_id", "paragraph")


@CASES.query("case_drifting_clusters", _values("name, cluster, n, low, high", [("drift", 0, 2, 0.0, 5.0), ("drift", 1, 3, 9.0, 17.0), ("one", 0, 1, 4.0, 4.0), ("equal", 0, 3, 7.0, 7.0)]))
def case_drifting_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Operators 102, 103: clusters around a running mean, which decides rather than the gaps."""
    rows = spark.createDataFrame([("drift", [17.0, 0.0, 13.0, 5.0, 9.0]), ("one", [4.0]), ("equal", [7.0, 7.0, 7.0]), ("none", [])], "name string, xs array<double>")
    c = rows.select("name", F.posexplode(layout.drifting_clusters(F.col("xs"), 6.0)).alias("cluster", "c"))
    return c.select("name", "cluster", "c.n", "c.low", "c.high")


_TREES = [("same", "H1 P P LI", "H1 P P LI", 1.0), ("both empty", "", "", 1.0), ("one empty", "P", "", 0.0), ("half", "H1 P", "H2 P", 0.5), ("moved", "H1 P LI P", "P H1 LI", 0.5)]


@CASES.query("case_structure_fidelity", _values("name, fidelity", [(n, v) for n, _, _, v in _TREES]))
def case_structure_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Operator 93: longest common subsequence of roles over the longer sequence; two empty trees are equal."""
    rows = spark.createDataFrame([(n, a.split(), b.split()) for n, a, b, _ in _TREES], "name string, a array<string>, b array<string>")

    @F.pandas_udf("double")
    def common(a, b):
        return a.combine(b, lambda x, y: layout.common_length(list(x), list(y))).astype(float)

    longer = F.greatest(F.size("a"), F.size("b"))
    return rows.select("name", F.when(longer == 0, 1.0).otherwise(common("a", "b") / F.nullif(longer, F.lit(0))).alias("fidelity"))


_TABLE = [["Item", "Count", "Price"], ["Bolt", "12", "$3.50"], ["Nut", "7", "$1.25"], ["Pin", "3", "$0.40"]]


@CASES.query("case_text_grid", _values("block_id, table_role, table_row, table_column, confidence", [(f"{r}:{c}", "header" if r == 0 else "cell", r, c, 0.98) for r in range(4) for c in range(3)]))
def case_text_grid(spark: SparkSession, d: str) -> DataFrame:
    """Operators 127, 132 to 136, 139: a headed table of numbers is one, labels with values are none."""
    box = "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, font_size double, font_name string"
    grid = lambda doc, texts: [(doc, 1, r * 10 + c, f"{r}:{c}", t, 72.0 + 120 * c, 72.0 + 18 * r, 6.0 * len(t), 12.0, 12.0, "Times") for r, line in enumerate(texts) for c, t in enumerate(line)]
    rows = grid(1, _TABLE) + grid(2, [["Name", "Ada"], ["Role", "Lead"], ["Team", "Core"]])
    return tables.text_grid_tables(spark.createDataFrame(rows, box)).select("block_id", "table_role", "table_row", "table_column", "confidence")
