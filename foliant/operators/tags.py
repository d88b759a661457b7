"""The tag tree as a flat table: sections, lists, tables with rows and sections, leaves; and tests on tables.

A tag's place is its path, an array of numbers from the root down, so that sorting by path is the preorder of the tree
and no recursion is needed. Nodes come in reading order (doc_id, seq) with role and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import normalize_text
from foliant.operators.layout import _or_null, islands

# Markers of list items, what makes a cell's text tabular, and roles whose text stands in a span.
MARKERS = (r"^([•◦▪▸‣–—]|\*|-)\s+", r"(?i)^(\d+[.)]\s*|[a-z][.)]\s*|[ivxlcdm]+[.)]\s*)")
TABULAR = (
    r"\b\d{2,}\b", r"\$\s*\d", r"\b\d+(?:\.\d+)?\s?%", r"(?i)\b\d+\s*(?:kg|lb|oz|mm|cm|in|ft|m|km|hr|min|sec|USD|EUR|GBP)\b", r"\b\w+:\s*\S", r"\b\d{1,2}\/\d{1,2}\/\d{2,4}\b",
)
SPANNED = ("P", "H1", "H2", "H3", "H4", "H5", "H6", "Caption", "Title", "Code")

# Which tags may stand right below which.
FLOW = ("Sect", "Title", "H1", "H2", "H3", "H4", "H5", "H6", "P", "L", "Figure", "Aside", "BlockQuote", "Span", "Form", "Table", "Caption")
ALLOWED = {
    "Document": FLOW, "Sect": FLOW, "Aside": FLOW, "BlockQuote": FLOW, "Form": FLOW, "L": ("LI",), "LI": FLOW, "Table": ("Caption", "THead", "TBody", "TFoot", "TR"), "THead": ("TR",), "TBody": ("TR",), "TFoot": ("TR",),
    "TR": ("TH", "TD"), "TH": FLOW, "TD": FLOW, "Figure": ("Caption",), "P": ("Span",), "Span": ("Span",), **{k: ("Span",) for k in ("Title", "H1", "H2", "H3", "H4", "H5", "H6", "Caption")},
}


def open_sections(nodes: DataFrame) -> DataFrame:
    """Adds level of a heading (or null) and sections: the seqs of the headings that a node stands under, outermost first.

    A heading is open until the next of its level or a smaller one, at whatever of the six levels.
    """
    w = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    level = F.when(F.col("role").rlike("^H[1-6]$"), F.substring("role", 2, 1).cast("int"))
    n = nodes.withColumn("level", level)
    n = n.select("*", *[F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(w).alias(f"last_{k}") for k in range(1, 7)])
    found = []
    for k in range(1, 7):
        at = F.col(f"last_{k}")
        after = F.coalesce(at > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"last_{j}", F.lit(-1)) for j in range(1, k)]), F.lit(False))
        found.append(F.when(after & (F.coalesce("level", F.lit(7)) > k), at))
    return n.withColumn("sections", F.array_sort(F.array_compact(F.array(*found)))).drop(*[f"last_{k}" for k in range(1, 7)])


def list_marker(text: Column) -> Column:
    """The bullet or number that a list item begins with, or null."""
    t = F.regexp_replace(text, r"^\s+", "")
    bullet, number = F.regexp_extract(t, MARKERS[0], 1), F.regexp_replace(F.regexp_extract(t, MARKERS[1], 1), r"\s+$", "")
    return F.when(bullet != "", bullet).when(number != "", number)


def tag_tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, path, depth, tag_id, type, label, actual_text, source_seq), one row per tag below the document's root.

    A heading opens a section that holds it; consecutive list items share a list, where a marker and a body part an
    item; cells share a table until something else comes or their table_id changes, and a row with their
    table_row_index. Artifacts give no tag and end lists and tables. Texts of paragraphs and headings stand in a span.
    """
    w = W.partitionBy("doc_id").orderBy("seq")
    n = open_sections(nodes.withColumns({"table_id": _or_null(nodes, "table_id", "string"), "row": F.coalesce(_or_null(nodes, "table_row_index", "int"), F.lit(0))}))
    cell, head = F.col("role").isin("TH", "TD"), F.col("level").isNotNull()
    group = F.coalesce("table_id", F.when(cell, F.concat(F.lit("page-"), F.col("page_number"), F.lit("-table"))).otherwise(F.concat(F.lit("n"), F.col("seq"))))
    n = n.withColumn("group", F.when(cell | (F.col("role") == "Table"), group))
    before, before_group = F.lag("role").over(w), F.lag("group").over(w)
    n = islands(n, w, (F.col("role") != "LI") | (before != "LI"), "list_no")
    n = islands(n, w, F.col("group").isNull() | (F.col("role") == "Table") | before_group.isNull() | (before_group != F.col("group")), "table_no")
    n = n.withColumn("list_seq", F.min("seq").over(W.partitionBy("doc_id", "list_no"))).withColumn("table_seq", F.min("seq").over(W.partitionBy("doc_id", "table_no")))
    n = n.withColumn("row_seq", F.min(F.when(cell, F.col("seq"))).over(W.partitionBy("doc_id", "table_no", "row"))).where("role <> 'Artifact'")
    long = lambda *parts: F.array(*[F.lit(p).cast("long") if isinstance(p, int) else F.col(p).cast("long") if isinstance(p, str) else p.cast("long") for p in parts])
    up = F.transform("sections", lambda s: s.cast("long"))
    name = lambda prefix, seq, suffix="": F.concat(F.lit(prefix), F.col(seq).cast("string"), F.lit(suffix))
    none = F.lit(None).cast("string")

    def tag(when: Column, below: Column, tag_id: Column, kind: Column, label: Column = none, actual: Column = none, own: Column | None = None) -> Column:
        source = F.when(F.lit(False) if own is None else own, F.col("seq").cast("long"))
        return F.when(when, F.struct(F.concat(up, below).alias("path"), tag_id.alias("tag_id"), kind.alias("type"), label.alias("label"), actual.alias("actual_text"), source.alias("source_seq")))

    text = F.col("text")
    item, in_table = F.col("role") == "LI", F.col("group").isNotNull()
    kind = F.when(head, F.concat(F.lit("H"), F.col("level"))).otherwise(F.col("role"))
    plain = ~item & ~in_table
    marker = list_marker(text)
    body = F.btrim(F.substring(F.regexp_replace(text, r"^\s+", ""), F.length(marker) + 1, F.length(text)))
    parted = item & marker.isNotNull() & (F.length(body) > 0) & (body != text) & text.rlike(r"^\S")
    spanned = plain & kind.isin(*SPANNED)
    # A leaf's place: a heading below its own section, anything else below the sections it stands under.
    place = F.when(head, long("seq", 0)).otherwise(long("seq"))
    tags = F.array(
        tag(head, long("seq"), name("tag:section:", "seq"), F.lit("Sect")),
        tag(plain, place, name("tag:", "seq"), kind, text, own=~spanned),
        tag(spanned, F.concat(place, long(0)), name("tag:", "seq", ":span"), F.lit("Span"), text, text, own=F.lit(True)),
        tag(item & (F.col("seq") == F.col("list_seq")), long("list_seq"), name("tag:list:", "list_seq"), F.lit("L")),
        tag(item, long("list_seq", "seq"), name("tag:", "seq"), F.lit("LI"), none, F.when(~parted & (F.btrim(text) != ""), text), own=F.coalesce(~parted, F.lit(True))),
        tag(parted, long("list_seq", "seq", 0), name("tag:", "seq", ":lbl"), F.lit("Lbl"), marker, marker), tag(parted, long("list_seq", "seq", 1), name("tag:", "seq", ":lbody"), F.lit("LBody"), body, body, own=F.lit(True)),
        tag(in_table & (F.col("seq") == F.col("table_seq")), long("table_seq"), F.concat(F.lit("tag:table:"), "group"), F.lit("Table")),
        tag(cell & (F.col("seq") == F.col("row_seq")), long("table_seq", "row_seq"), F.concat(F.lit("tag:table:"), "group", F.lit(":row:"), "row"), F.lit("TR")),
        tag(cell, long("table_seq", "row_seq", "seq"), name("tag:", "seq"), F.col("role"), text, F.when(F.btrim(text) != "", text), own=F.lit(True)),
    )
    tags = n.select("doc_id", F.inline(F.array_compact(tags)))
    return tags.select("doc_id", "path", F.size("path").alias("depth"), "tag_id", "type", "label", "actual_text", "source_seq")


def preorder(tags: DataFrame) -> DataFrame:
    """Adds position, from 0: the order in which a walk of the tree meets the tags."""
    return tags.withColumn("position", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1)


def containment(tags: DataFrame) -> DataFrame:
    """(doc_id, tag_id, type, parent, allowed) of every tag: the type of the tag right above it, Document at the top, and whether it may stand there."""
    up = tags.select("doc_id", F.col("path").alias("above"), F.col("type").alias("parent_type"))
    below = tags.select("doc_id", "tag_id", "type", F.slice("path", 1, F.size("path") - 1).alias("above"))
    rules = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parent = F.when(F.size("above") == 0, "Document").otherwise(F.col("parent_type"))
    # What the path has no tag for in between is a step of a tree that is broken there.
    found = below.join(up, ["doc_id", "above"], "left").select("doc_id", "tag_id", "type", parent.alias("parent"))
    return found.withColumn("allowed", F.coalesce(F.array_contains(F.try_element_at(rules, F.col("parent")), F.col("type")), F.lit(False)))


def with_source(tags: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tags with role and page_number of the node that they come from, null where there is none."""
    s = nodes.select("doc_id", F.col("seq").cast("long").alias("source_seq"), F.col("role").alias("source_role"), F.col("page_number").alias("source_page"))
    return tags.join(s, ["doc_id", "source_seq"], "left")


def table_rows(cells: DataFrame, real: Column | None = None, *more: Column) -> DataFrame:
    """(doc_id, table_id, row, counts, rank, n_cells, n_th, header_like, body_like, hint, first_th) per row of (doc_id, table_id, row, col, type, text, table_section).

    Where ``real`` tells which cells count, rows without any have n_cells 0 and no rank. ``more`` are aggregates of all cells of a row.
    """
    real = F.lit(True) if real is None else real
    th = F.col("type") == "TH"
    letters = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(real, F.struct("col", "text")))), lambda s: s["text"]), " "), "[^a-zA-Z]", "")
    hint = F.collect_set(F.when(real & F.col("table_section").isin("head", "body", "foot"), F.col("table_section")))
    by = cells.groupBy("doc_id", "table_id", "row").agg(F.count_if(real).alias("n_cells"), F.count_if(real & th).alias("n_th"), letters.alias("letters"), hint.alias("hints"), F.max(real & (F.col("type") == "TD")).alias("has_td"), F.min_by(th, F.when(real, F.col("col"))).alias("first_th"), *more)
    others = by.columns[9:]
    # One column for all windows, so that they share one sort.
    by = by.withColumn("counts", F.col("n_cells") > 0)
    upper = (F.length("letters") > 0) & (F.col("letters") == F.upper("letters"))
    rank = F.row_number().over(W.partitionBy("doc_id", "table_id", "counts").orderBy("row")) - 1
    like = (F.col("n_th") == F.col("n_cells")) | ((F.col("row") < 2) & (F.col("n_th") / F.nullif("n_cells", F.lit(0)) >= 0.75)) | ((F.col("row") == 0) & upper)
    has = lambda s: F.array_contains("hints", s)
    section = F.when(has("foot"), "foot").when(has("head") & ~has("body"), "head").otherwise("body")
    return by.select("doc_id", "table_id", "row", "counts", rank.alias("rank"), "n_cells", "n_th", like.alias("header_like"), (~like & F.col("has_td")).alias("body_like"), section.alias("hint"), "first_th", *others)


def row_sections(r: DataFrame) -> DataFrame:
    """Rows of ``table_rows`` with their section: head, body, foot, or none for rows right below the table; null where no cell counts."""
    own = W.partitionBy("doc_id", "table_id", "counts")
    upto = own.orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("by_rows", (F.count("*").over(own) >= 2) & F.min((F.col("n_cells") >= 2) & (F.col("n_th") == 1) & F.col("first_th")).over(own))
    r = r.withColumn("first_body", F.min(F.when(F.col("body_like"), F.col("rank"))).over(own))
    fits = (F.col("hint") != "foot") & (F.col("header_like") | (F.col("hint") == "head"))
    r = r.withColumn("run", F.min(fits).over(upto))
    head = (F.col("rank") < F.col("first_body")) & ~F.col("by_rows") & F.col("run")
    r = r.withColumn("section", F.when(F.coalesce(head, F.lit(False)), "head").otherwise(F.col("hint")))
    no_body = F.count_if(F.col("section") == "body").over(own) == 0
    section = F.when((F.col("section") == "head") & no_body, "none").otherwise(F.col("section"))
    return r.drop("by_rows", "first_body", "run").withColumn("section", F.when(F.col("counts"), section))


def table_sections(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, section): head, body, foot, or none for rows right below the table.

    Rows that look like headers, or are said to be, form the head up to the first that looks like body, unless every row
    begins with its own header. A head without a body is taken apart, so that its rows stand below the table.
    """
    return row_sections(table_rows(cells)).select("doc_id", "table_id", "row", "section")


def spurious_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, demoted, text): whether a table is prose: up to 4 rows and 16 cells, all short, no header, nothing tabular; then its text as one paragraph."""
    t = normalize_text(F.col("text"))
    tabular = F.lit(False)
    for p in TABULAR:
        tabular = tabular | t.rlike(p)
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", t.alias("t")))), lambda s: s["t"]), lambda v: v != ""), " ")
    by = cells.groupBy("doc_id", "table_id").agg(F.countDistinct("row").alias("n_rows"), F.count("*").alias("n"), F.max((F.col("type") == "TH") | (F.length(t) >= 30) | tabular).alias("sure"), joined.alias("joined"))
    prose = (F.col("n_rows") <= 4) & (F.col("n") <= 16) & ~F.col("sure")
    return by.select("doc_id", "table_id", prose.alias("demoted"), F.when(prose, F.col("joined")).alias("text"))


def header_links(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, cell_id, headers): the ids of the header cells of every data cell, by column first, each once.

    ``cells``: doc_id, table_id, cell_id, type, section, row, col, row_span, column_span. A header in a head section, or one
    without a section in the table's first row, heads its columns; any other heads its rows. Cells reach as far as their spans.
    """
    key = ["doc_id", "table_id"]
    end = lambda at, span: F.col(at) + F.greatest(F.lit(1), F.coalesce(span, F.lit(1))) - 1
    c = cells.select(*key, "cell_id", "type", "section", "row", "col", end("row", "row_span").alias("row_end"), end("col", "column_span").alias("col_end"))
    table = W.partitionBy(*key)
    over = (F.col("section") == "head") | (F.col("section").isNull() & (F.col("row") == F.min("row").over(table)))
    c = c.withColumn("over", F.coalesce(over, F.lit(False)))
    th = F.col("type") == "TH"
    head = F.struct(F.when(F.col("over"), 0).otherwise(1).alias("kind"), "row", "col", F.col("cell_id").alias("head"), "col_end")
    # Heads of columns are few; those of rows meet the cells row by row, so that no cell sees those of the whole table.
    c = c.withColumn("tops", F.collect_list(F.when(th & F.col("over"), head)).over(table))
    c = c.withColumn("at", F.explode_outer(F.sequence("row", "row_end")))
    c = c.withColumn("sides", F.collect_list(F.when(th & ~F.col("over") & F.col("at").isNotNull(), head)).over(W.partitionBy(*key, "at")))
    td = c.where("type = 'TD'").withColumn("sides", F.flatten(F.collect_list("sides").over(W.partitionBy(*key, "cell_id")))).where(F.col("at").eqNullSafe(F.col("row")))
    tops = F.filter("tops", lambda h: (h["col"] <= F.col("col_end")) & (h["col_end"] >= F.col("col")))
    place = lambda h: h.dropFields("col_end")
    return td.select(*key, "cell_id", F.transform(F.array_sort(F.array_distinct(F.transform(F.concat(tops, "sides"), place))), lambda h: h["head"]).alias("headers"))


def field_role(subtype: Column) -> Column:
    """The role of a form field in print: radio button, check box, push button, else text."""
    s = F.lower(F.coalesce(subtype, F.lit("")))
    return F.when(s.contains("radio"), "RB").when(s.contains("check"), "CB").when(s.contains("push") | s.isin("btn", "button"), "PB").otherwise("TV")
