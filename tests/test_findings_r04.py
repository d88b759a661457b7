"""Findings of round 4, each by a case that failed before."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators import grids, matching, regular, sparse, tags
from foliant.plans.catalog import REGISTRY
from foliant.sources import sheets
from foliant.sources.blocks import blocks_from_documents
from foliant.sources.sheets import sheet_block_pages
from tests.test_findings_r03 import _claims, _Drawn


def test_source_text_map_looks_at_the_whole_page(spark, tmp_path):
    """Every block takes its best one to four runs of the page, however far they are: as brute force says."""
    draw, words = random.Random(3), ["tree", "ee", "a", "be", "bee", "cat", "e", "dog"]
    docs = [(d, "\n".join(" ".join(draw.choices(words, k=draw.randint(0, 4))) for _ in range(draw.randint(1, 70)))) for d in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pages: dict[tuple, list] = {}
    for r in blocks_from_documents(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect():
        page = pages.setdefault((r.doc_id, r.page_number), [])
        box = r.x, r.y, r.w, r.h
        page += [_Drawn(r.doc_id, r.page_number, str(r.seq), None, None, r.text, *box), _Drawn(r.doc_id, r.page_number, None, str(r.seq), r.seq, " ".join(r.text.replace("e", "").split()), *box)]
    want = [(m[0], m[1], int(m[2]), int(m[3][0]), len(m[3]), m[4]) for page in pages.values() for m in _claims(page)]
    got = [tuple(r) for r in REGISTRY.queries["source_text_map"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert any(abs(seq - start) > 1 for _, _, seq, start, *_ in got) and any(r[4] > 1 for r in got)


def _ruled_pages(draw: random.Random, pages: int) -> list[tuple]:
    """Pages (doc_id, page_number, rules, blocks) of one or two grids with missing rules, so that cells also overlap."""
    out = []
    for page in range(pages):
        rules, blocks = [], []
        for grid in range(draw.randint(0, 2)):
            x0, n, m = 50.0 + 300 * grid, draw.randint(2, 5), draw.randint(2, 4)
            rules += [("h", 60.0 + 20 * r, x0 + 40 * c, x0 + 40 * c + 40) for r in range(n + 1) for c in range(m) if draw.random() < 0.8]
            rules += [("v", x0 + 40 * c, 60.0 + 20 * r, 80.0 + 20 * r) for c in range(m + 1) for r in range(n) if draw.random() < 0.8]
            blocks += [(f"b{grid}-{k}", x0 + draw.randint(-6, 40 * m + 6), 60.0 + draw.randint(-6, 20 * n + 6), 0.0, 0.0) for k in range(draw.randint(0, 12))]
        out.append((page, 1, rules, blocks))
    return out


_RULED = "doc_id long, page_number int, rules array<struct<orient:string,at:double,start:double,end:double>>, blocks array<struct<block_id:string,x:double,y:double,w:double,h:double>>"


def test_rows_of_a_page_are_one_page(spark):
    """Pages need not be put together before their tables are looked for (F3, F4, F5)."""
    whole = _ruled_pages(random.Random(4), 80)
    parted = [(d, p, rules[k::3], blocks[len(blocks) * k // 3 : len(blocks) * (k + 1) // 3]) for d, p, rules, blocks in whole for k in range(3)]
    flat = lambda rows: [str(r) for r in grids.page_candidates(spark.createDataFrame(rows, _RULED).coalesce(1), least=12.0).toJSON().collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = flat(parted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == flat(whole) and len(got) > 20


def test_tables_do_not_depend_on_what_is_compared_at_once(monkeypatch):
    how = 2.0, 14.0, 12.0, 3.0
    pages = [(d, p, [dict(zip(("orient", "at", "start", "end"), r)) for r in rules], [{"block_id": b, "cx": x, "cy": y} for b, x, y, *_ in blocks]) for d, p, rules, blocks in _ruled_pages(random.Random(6), 60)]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pages)], names=["doc_id", "page_number", "rules", "points"])
    found = lambda: [r for x in grids._found_tables(b, how, False) for r in x.to_pylist()]
    want = found()
    monkeypatch.setattr(grids, "AT_ONCE", 100)
    assert found() == want and len(want) > 15
    # What a page holds is told from each cell by itself.
    for r in want:
        own = next(p for p in pages if p[0] == r["doc_id"])
        _, ys, xs, _, cells, _ = next(g for g in grids._page_grids([tuple(x.values()) for x in own[2]], *how) if g[2][0] == r["x"] and g[1][0] == r["y"])
        n, ids = grids._held(ys, xs, cells, [tuple(x.values()) for x in own[3]])
        assert (r["n_blocks"], [c["block_ids"] for c in r["cells"]]) == (n, ids)


def test_orphans_are_found_by_form(spark, monkeypatch):
    """Pages of one form are worked out once, orphans included (F6), and give what each gives by itself."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    pages = sheet_block_pages(lines).select(F.col("doc_id"), F.col("page_number"), "blocks").toArrow().to_batches()
    want = {(c[0], c[1], c[2]): c for b in pages for r in b.to_pylist() for c in sparse._page_cells([sparse.Block(r["doc_id"], r["page_number"], *(x[n] for n in sparse.PARTS)) for x in r["blocks"]], sparse.Grid(), True)}
    worked = []
    adopted = sparse._adopted
    monkeypatch.setattr(sparse, "_adopted", lambda *args: worked.append(1) or adopted(*args))
    got = {(c["doc_id"], c["page_number"], c["block_id"]): tuple(c[n] for n in sparse.NAMES) for b in sparse._cells_of_pages(iter(pages), sparse.Grid(), True, StructType.fromDDL(sparse.CELL)) for c in b.to_pylist()}
    assert got == want and len(worked) < sum(b.num_rows for b in pages)
    assert {"orphan-above", "orphan-same-row"} <= {c[9] for c in got.values()}


def test_pages_that_their_form_leaves_open(spark):
    """A page whose form does not tell its cells is worked out in the worker, where no session is at hand (F6)."""
    row = lambda k: [(f"b{k}-{i}", str(10 + i), x, 100.0 + 14 * k, 12.0, 10.0, 10.0) for i, x in enumerate((100.0, 110.0, 130.0, 150.0))]
    pages = spark.createDataFrame([(1, 1, [b for k in range(4) for b in row(k)])], "doc_id long, page_number int, blocks array<struct<block_id:string,text:string,x:double,y:double,w:double,h:double,font_size:double>>")
    assert sparse.sparse_page_tables(pages).count() == 0


def test_tables_split_in_one_pass_equal_the_steps(spark):
    """Regular tables and their amounts need no sort of cells (F7); what they hold is that of the two steps."""
    draw, rows = random.Random(9), []
    for doc in range(60):
        for r in range(draw.randint(1, 4)):
            for k in range(draw.randint(1, 4)):
                span = draw.choice((None, 0, 1, 1, 2, 3))
                text = draw.choice(("a $5", "total 7%", "$5", "", None, "b", " of 3 million", "x 12"))
                rows.append((doc // 2, f"t{doc % 2}", k, f"c{r}-{k}", draw.choice(("TD", "TD", "TH", None)), draw.choice(("head", "body", None)), r * draw.choice((1, 1, 2)), draw.choice((None, k, k + 2, 40, -1)), draw.choice((None, 1, 1, 2, 3)), span, text))
    rows = sorted(rows, key=lambda r: (r[0], r[1], draw.random()))
    df = spark.createDataFrame(rows, "doc_id long, table_id string, seq int, cell_id string, type string, section string, row int, col int, row_span int, column_span int, text string").coalesce(1)
    steps = regular.split_merged_cells(regular.regular_tables(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        found = regular.split_tables(df)
        got = sorted(map(str, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == steps.columns and got == sorted(map(str, steps.collect()))
    assert "Sort" not in plan and "Exchange" not in plan and sum("split_from='" in g for g in got) > 5


def test_sections_tags_and_links_in_one_pass_equal_the_steps(spark):
    """What is made of repaired tables a batch at a time (F2, F8, F9) is what the operators on cells make of them."""
    draw, rows = random.Random(12), []
    for table in range(150):
        for r in range(draw.randint(1, 6)):
            head, first = draw.random() < 0.4, draw.random() < 0.3
            said = draw.choice(("head", "body", "body", "foot")) if draw.random() < 0.4 else "head" if head else "body"
            for k in range(draw.randint(1, 3)):
                kind = "TH" if head or first and k == 0 else draw.choice(("TD", "TD", "TD", "TH"))
                rows.append((table // 2, f"t{table % 2}", f"c{r}-{k}", kind, said, r, k, draw.choice((1, 1, 2)), draw.choice((1, 1, 2)), draw.choice(("A", "B", "a", " ", "", None)), draw.random() < 0.2, False, None))
    df = spark.createDataFrame(rows, "doc_id long, table_id string, cell_id string, type string, section string, row int, col int, row_span int, column_span int, text string, synthetic boolean, shifted boolean, split_from string").coalesce(1)
    steps = regular.validated_sections(df)
    (b,) = df.toArrow().combine_chunks().to_batches()
    v = regular.validated_batch(b)
    flat = lambda names, rows: sorted(str([r[n] for n in names]) for r in rows)
    for want, got in ((steps, v), (regular.table_tags(steps), regular.tags_batch(v)), (tags.header_links(steps), regular.links_batch(v))):
        assert flat(want.columns, [r.asDict() for r in want.collect()]) == flat(want.columns, got.to_pylist())
    assert any(v.column("repeated_header").to_pylist()) and any(v.column("promoted").to_pylist()) and None in v.column("section").to_pylist()


def test_what_follows_on_repaired_tables_needs_no_sort_of_cells(spark):
    for name in ("split_cells", "validated_sections", "table_tags", "data_cell_headers"):
        plan = REGISTRY.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") <= 2 and "collect_list" not in plan, name


def test_marks_of_a_batch_are_those_of_cells(spark):
    cells = regular.split_tables(sheets.sheet_cells(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))).coalesce(1).cache()
    want = sorted(str(r.asDict()) for r in sheets.marked_cells(cells).select(*cells.columns).collect())
    (b,) = cells.toArrow().combine_chunks().to_batches()
    assert sorted(map(str, sheets.marked_batch(b).to_pylist())) == want


def test_matched_tags_need_one_join(spark):
    """Texts come along with the matches, so that operators and tags are not read and joined again (F10)."""
    plan = REGISTRY.queries["matched_tags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MergeJoin") + plan.count("HashJoin") == 1 and plan.count("FileScan") == 2


def test_matched_tags_with_texts_equal_the_joins(spark):
    b = blocks_from_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    tags_, ops = b.withColumn("tag_order", F.col("seq")), b.select("doc_id", "page_number", F.col("seq").alias("op_seq"), "text", "x", "y")
    found = lambda m: sorted(map(str, m.collect()))
    got = found(matching.matched_tags(matching.match_operators(ops, tags_, texts=True)))
    assert got and got == found(matching.matched_tags(matching.match_operators(ops, tags_), ops, tags_))
