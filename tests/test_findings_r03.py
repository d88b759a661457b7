"""Findings of round 3, each by a case that failed before."""

from __future__ import annotations

import math
import random
from collections import Counter, namedtuple

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.llm import secrets
from foliant.operators import grids, layout, matching, tables
from foliant.plans.catalog import REGISTRY
from foliant.sources.blocks import blocks_from_documents
from foliant.streaming.leases import lease_expiries, rocksdb_state
from foliant.streaming.runs import streamed


def test_run_difference_counts_ties_as_unchanged(spark, tmp_path):
    # Means 0.05 and 0.051, whose doubles are farther apart than 0.001, and 0.07 and 0.071, whose doubles are nearer.
    rows = []
    for part, low in ((1, 0.05), (2, 0.07), (3, 0.01), (4, 0.03)):
        rows += [(part, 1, low)] + [(part, 4, low)] * 9 + [(part, 4, round(low + 0.01, 2))]
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_discount double").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    r = REGISTRY.queries["run_difference"](spark, str(tmp_path)).first()
    assert (r.n, r.n_improved, r.n_regressed, r.n_unchanged, r.mean_delta) == (4, 0, 0, 4, 0.001)


def test_unknown_abbreviations_are_counted(spark):
    df = spark.createDataFrame([("The PDF by ACME, W3C; xABC Q9Z TOOLONGS",)], "text string")
    spans = df.select(T.abbreviation_spans(F.col("text"), known_only=False).alias("s")).first().s
    assert [(s.token, s.start, s.end, s.expansion is None) for s in spans] == [("PDF", 4, 7, False), ("ACME", 11, 15, True), ("W3C", 17, 20, False)]


def test_context_words_are_counted_over_all_tasks(spark):
    # A task's own words come first in it; the shared one is third in every task and first over all.
    own = [("alpha", "bravo"), ("charlie", "delta"), ("echo", "foxtrot"), ("golf", "hotel")]
    texts = [x for a, b in own for x in [f"token {a} {b}"] * 4 + ["token shared"] * 3]
    whole = spark.createDataFrame(spark.sparkContext.parallelize([(x,) for x in texts], 4), "text string")
    p = secrets.SecretScan(words=2)
    counts = Counter(w for x in texts for w in set(secrets._PART.findall(x)))
    assert counts.most_common(2) == [("token", 28), ("shared", 12)]
    assert secrets.context_words(whole, p).split() == ["shared", "token"]


def test_ruled_pages_in_one_pass_equal_the_steps(spark):
    """Pages of broken and shifted rules, some without a table, with points on and beside them."""
    draw = random.Random(3)
    rules, blocks = [], []
    for page in range(60):
        for grid in range(draw.randint(1, 2)):
            x0, y0, n, m = 50.0 + 300 * grid, 60.0, draw.randint(1, 5), draw.randint(1, 4)
            for r in range(n + 1):
                rules += [(page, 1, "h", y0 + 20 * r + draw.choice((0, 0.5, 1.3)), x0 + 40 * c, x0 + 40 * c + draw.choice((40, 35, 20))) for c in range(m) if draw.random() < 0.85]
            for c in range(m + 1):
                rules += [(page, 1, "v", x0 + 40 * c + draw.choice((0, 0.25)), y0 + 20 * r, y0 + 20 * r + 20) for r in range(n) if draw.random() < 0.85]
            blocks += [(page, 1, f"b{grid}-{k}", x0 + draw.randint(-6, 40 * m + 6), y0 + draw.randint(-6, 20 * n + 6), 0.0, 0.0) for k in range(draw.randint(0, 12))]
    rules = spark.createDataFrame(rules, "doc_id long, page_number int, orient string, at double, start double, end double")
    blocks = spark.createDataFrame(blocks, "doc_id long, page_number int, block_id string, x double, y double, w double, h double")
    steps = grids.merge_signals(grids.merged_rules(rules, least=12.0))
    by = lambda df, name, *cols: df.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct(*cols)).alias(name))
    pages = by(rules, "rules", "orient", "at", "start", "end").join(by(blocks, "blocks", "block_id", "x", "y", "w", "h"), ["doc_id", "page_number"], "left")
    pages = pages.withColumn("blocks", F.coalesce("blocks", F.expr("filter(array(named_struct('block_id', '', 'x', 0D, 'y', 0D, 'w', 0D, 'h', 0D)), b -> false)")))
    flat = lambda df: sorted(str(r) for r in df.toJSON().collect())
    found = grids.page_grids(pages, least=12.0)
    cells = lambda df: df.select("doc_id", "page_number", "table_id", "ys", "xs", F.array_sort("signals").alias("signals"), "cells")
    assert found.count() > 20
    assert flat(cells(found)) == flat(cells(grids.grid_cells(steps)))
    tables = grids.page_candidates(pages, least=12.0)
    assert tables.count() > 5
    assert flat(tables) == flat(grids.table_candidates(steps, blocks))


def test_orphans_in_one_pass_equal_the_join(spark):
    from foliant.operators import sparse
    from foliant.sources.sheets import sheet_blocks

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    b = sheet_blocks(lines).withColumn("block_type", F.when(F.col("block_id") == "title", "heading").otherwise("paragraph"))
    names = [n for n in sparse.NAMES if n != "sources"]
    rows = lambda df: sorted(str(r) for r in df.select(*names, F.array_join("sources", ",").alias("s")).collect())
    found = sparse.sparse_tables_with_orphans(b)
    assert "Exchange" in found._jdf.queryExecution().executedPlan().toString() and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(sparse.adopt_orphans(b, sparse.sparse_tables(b)))


def test_repaired_tables_are_worked_out_once(spark):
    """Tables are read once, however many sections, tags and headers are made of them (F7, F9, F11), and cells need no join with blocks (F8)."""
    for name in ("validated_sections", "table_tags", "data_cell_headers", "vector_table_cells"):
        plan = REGISTRY.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan, name


def test_head_rows_of_pages_equal_the_join(spark):
    """Headers told within a page are those of ``ruled_table_cells``: bold ones, labels, larger ones, merged cells."""
    draw = random.Random(8)
    rules, blocks = [], []
    for page in range(80):
        n, m = draw.randint(2, 4), draw.randint(2, 3)
        for r in range(n + 1):
            rules += [(page, 1, "h", 60.0 + 20 * r, 50.0 + 40 * c, 90.0 + 40 * c) for c in range(m) if draw.random() < 0.9]
        for c in range(m + 1):
            rules += [(page, 1, "v", 50.0 + 40 * c, 60.0 + 20 * r, 80.0 + 20 * r) for r in range(n) if draw.random() < 0.9]
        for r in range(n):
            bold, word = draw.random() < 0.4, draw.random() < 0.5
            blocks += [(page, 1, f"b{r}-{c}", draw.choice(("Net", "Sum of all")) if word else draw.choice(("12", None)), 60.0 + 40 * c, 65.0 + 20 * r, 10.0, 10.0, draw.choice((10.0, 12.0)), "Times-Bold" if bold else "Times") for c in range(m) if draw.random() < 0.9]
    rules = spark.createDataFrame(rules, "doc_id long, page_number int, orient string, at double, start double, end double")
    blocks = spark.createDataFrame(blocks, "doc_id long, page_number int, block_id string, text string, x double, y double, w double, h double, font_size double, font_name string")
    by = lambda df, name: df.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct(*df.columns[2:])).alias(name))
    found = grids.candidate_cells(grids.page_candidates(by(rules, "rules").join(by(blocks, "blocks"), ["doc_id", "page_number"]), least=12.0, heads=True))
    key = ["doc_id", "page_number", "block_id", "table_id", "table_row", "table_column"]
    texts = blocks.where("text IS NOT NULL").select("doc_id", "page_number", "block_id")
    got = found.select("doc_id", "page_number", F.explode("block_ids").alias("block_id"), "table_id", F.col("row").alias("table_row"), F.col("col").alias("table_column"), F.when(F.col("header"), "header").otherwise("cell").alias("table_role"))
    got = sorted(got.join(texts, ["doc_id", "page_number", "block_id"], "left_semi").select(*key, "table_role").collect())
    want = sorted(tables.ruled_table_cells(found, blocks).select(*key, "table_role").collect())
    assert got == want and {r.table_role for r in got} == {"header", "cell"}


def test_leases_are_sessions_without_python(spark, tmp_path):
    """A heartbeat a whole lease after the last begins a new one, one a millisecond sooner does not; no row goes to Python (F10)."""
    rows = [(1, 0.0), (1, 30.0), (1, 59.999), (1, 89.9995), (2, 400.0)]
    df = spark.createDataFrame(rows, "agent_id long, s double").selectExpr("agent_id", "timestamp_micros(cast(round(s * 1000000) AS bigint)) AS ts")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lease_expiries(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 10, "60 seconds")
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    with rocksdb_state(spark):
        streamed(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(180)
    got = {(r.agent_id, r.beats, r.b, r.e) for r in spark.read.parquet(f"{tmp_path}/out").selectExpr("*", "unix_millis(last_beat) AS b", "unix_millis(expired_at) AS e").collect()}
    assert got == {(1, 1, 0, 30000), (1, 2, 59999, 89999), (1, 1, 89999, 119999)}


def test_texts_are_read_once_for_every_figure(spark):
    """No pattern is searched again where a figure is used again (F12, F17)."""
    for name, most in (("profile_route", {"regexp_extract_all": 17}), ("recognition_score", {"regexp_extract_all": 2, "regexp_replace": 3})):
        plan = REGISTRY.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
        for f, n in most.items():
            assert 0 < plan.count(f + "(") <= n, (name, f, plan.count(f + "("))


def _claims(page, accept=0.7):
    """Every sequence of one to four runs that are left against every block."""
    own, left = sorted((r for r in page if r.run_id is None), key=lambda b: (b.y, b.x, b.block_id)), sorted((r for r in page if r.run_id), key=lambda r: r.seq)
    out = []
    for b in own:
        best = None
        for start in range(len(left)):
            for n in range(1, min(4, len(left) - start) + 1):
                runs = left[start : start + n]
                x, y, right, bottom = min(r.x for r in runs), min(r.y for r in runs), max(r.x + r.w for r in runs), max(r.y + r.h for r in runs)
                w, h = right - x, bottom - y
                wide, high = min(b.x + b.w, x + w) - max(b.x, x), min(b.y + b.h, y + h) - max(b.y, y)
                place = max(wide * high / max(1, min(b.w * b.h, w * h)) if min(wide, high) > 0 else 0, 0.6 / (1 + math.hypot(b.x + b.w / 2 - x - w / 2, b.y + b.h / 2 - y - h / 2) / 24))
                least = (accept - 0.3 * place) / 0.7
                texts = {" ".join(glue.join(r.text for r in runs).split()) for glue in ("", " ")}
                text = 1.0 if b.text and b.text in texts else 0.0
                for t in texts if b.text and not text and least <= 0.97 else ():
                    one, two = set(t.lower().split(" ")), set(b.text.lower().split(" "))
                    held = 0.97 if t.replace(" ", "") == b.text.replace(" ", "") else 0.93 if t in b.text or b.text in t else len(one & two) / len(one | two)
                    text = max(text, held if t else 0.0)
                rank = (-(text * 0.7 + place * 0.3), n, start)
                if text >= least and (best is None or rank < best[0]):
                    best = rank, runs, text, place
        if best:
            left = [r for r in left if r not in best[1]]
            out.append((b.doc_id, b.page_number, b.block_id, [r.run_id for r in best[1]], round(-best[0][0], 6), best[2], round(best[3], 6)))
    return out


_Drawn = namedtuple("_Drawn", "doc_id page_number block_id run_id seq text x y w h")


def test_claims_equal_brute_force():
    draw, words = random.Random(5), ["a", "b", "B", "cc", "dd", "A b", "ee f"]
    for _ in range(300):
        far = draw.choice((1.0, 30.0, 100.0))
        page = [_Drawn(1, 1, f"b{k}", None, None, " ".join(draw.choices(words, k=draw.randint(0, 4))), draw.randint(0, 5) * far, draw.randint(0, 6) * far, draw.choice((0.0, 20.0, 60.0)), 12.0) for k in range(draw.randint(1, 8))]
        for k in range(draw.randint(0, 14)):
            b = draw.choice(page)
            cut = draw.randint(0, len(b.text))
            text = draw.choice((b.text, b.text[:cut].strip(), b.text[cut:].strip(), b.text.upper(), draw.choice(words)))
            page.append(_Drawn(1, 1, None, f"r{k}", k, text, b.x + draw.choice((0, 3, 9)), b.y + draw.choice((0, 3, 14)), b.w * draw.choice((1, 0.5)), b.h))
        draw.shuffle(page)
        assert matching.claimed_sequences(page) == _claims(page)


def test_claims_compare_only_what_can_win(monkeypatch):
    """A page of 50 lines, each drawn by two runs: some comparisons a line, not one with every sequence of the page."""
    seen = []
    nearness = matching._Sequence.nearness
    monkeypatch.setattr(matching._Sequence, "nearness", lambda s, b: seen.append(1) or nearness(s, b))
    page = []
    for k in range(50):
        page.append(_Drawn(1, 1, f"b{k:02}", None, None, f"line {k} of the page", 72.0, 72.0 + 14 * k, 120.0, 12.0))
        page += [_Drawn(1, 1, None, f"r{k}-{i}", 2 * k + i, text, 72.0 + 60 * i, 72.0 + 14 * k, 60.0, 12.0) for i, text in enumerate((f"line {k}", "of the page"))]
    found = matching.claimed_sequences(page)
    assert [f[3] for f in found] == [[f"r{k}-0", f"r{k}-1"] for k in range(50)]
    assert len(seen) < 50 * 25


def test_role_features_read_a_text_once(spark, capsys):
    REGISTRY.queries["role_feature_totals"](spark, "/root/testdata/sf0.001").explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # Four scans normalize lines; the trimmed text, its tokens and its figures are worked out once.
    assert plan.count("regexp_replace(") <= 5 and plan.count("split(") <= 9 and plan.count("RLIKE") <= 30


def test_plain_texts_give_the_same_lines(spark):
    texts = ["one\n two  three \n\n four", "a b\n c \nd", "tab\there\n\r\n x y \n　", "", "\x0b\n \n-", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "raw")).select("doc_id", "seq", T.normalize_text(F.col("raw")).alias("text")).where("text <> ''")
    got = blocks_from_documents(docs).select("doc_id", "seq", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 9


@pytest.mark.parametrize("name", ["continued_tables", "pairwise_paragraphs", "margin_paragraphs", "distinct_boxes", "source_text_map"])
def test_groups_are_not_frames(spark, capsys, name):
    """A pandas frame for every page or document cost a hundred times what its rows do."""
    REGISTRY.queries[name](spark, "/root/testdata/sf0.001").explain()
    assert "InPandas" not in capsys.readouterr().out


def test_distinct_boxes_keep_empty_texts_and_equal_greedy(spark):
    draw = random.Random(7)
    rows = [(d, 1, k, draw.choice(("a", "b", "", None)), float(draw.randint(0, 3) * 4), float(draw.randint(0, 3) * 4), draw.choice((0.0, 10.0, 12.0)), 10.0) for d in range(12) for k in range(14)]
    want, kept = [], {}
    for d, p, k, text, *box in rows:
        seen = kept.setdefault((d, text), [])
        over = lambda o: max(0, min(box[0] + box[2], o[0] + o[2]) - max(box[0], o[0])) * max(0, min(box[1] + box[3], o[1] + o[3]) - max(box[1], o[1]))  # noqa: B023, E731
        if not text or not any(over(o) and over(o) / max(box[2] * box[3] + o[2] * o[3] - over(o), 1) >= 0.55 for o in seen):
            seen.append(box)
            want.append((d, k))
    got = layout.distinct_boxes(spark.createDataFrame(rows, "doc_id long, page_number int, seq int, comparable string, x double, y double, w double, h double"))
    assert sorted((r.doc_id, r.seq) for r in got.collect()) == sorted(want) and len(want) < len(rows)


def test_operators_meet_tags_once(spark, capsys):
    """One join of operators and tags, and no row for each pair of characters."""
    REGISTRY.queries["tags_of_operators"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("MergeJoin") + plan.count("HashJoin") == 1 and plan.count("Generate explode") <= 2


def test_operators_whose_text_is_nearly_that_of_a_tag(spark):
    texts = [("abcdefghij", "abcdefghiX"), ("abcdefghij", "abcdXfghij"), ("aaaaaaaaaa", "aaaaaaaaab"), ("abcde", "fghij"), ("a", "b"), ("ab", "ba"), ("the cat sat on it", "the cat sat on if")]
    ops = spark.createDataFrame([(k, 1, 0, a, 10.0, 10.0) for k, (a, _) in enumerate(texts)], "doc_id long, page_number int, op_seq int, text string, x double, y double")
    tags = spark.createDataFrame([(k, 1, 0, b, 5.0, 5.0, 50.0, 12.0) for k, (_, b) in enumerate(texts)], "doc_id long, page_number int, tag_order int, text string, x double, y double, w double, h double")
    # Shared of all pairs: 8/10, 7/11, 8/10, 0/8, none, 0/2, 15/17.
    assert sorted(r.doc_id for r in matching.match_operators(ops, tags).collect()) == [0, 2, 6]


def test_sparse_pages_of_one_form_are_worked_out_once(monkeypatch):
    """figures do not tell pages apart; where a width or a made header's text decides, a page is worked out by itself."""
    import pyarrow as pa

    from foliant.operators import sparse
    from foliant.operators.tables import Grid

    kind = pa.struct([(n, pa.string() if k < 2 else pa.float64()) for k, n in enumerate(sparse.PARTS)])

    def page(figure: int, last: tuple = (430.0, None), above: tuple = ("Qty", "Price", "Disc", "Tax", "Part")) -> list[tuple]:
        out = [("spanner", "Amounts", 180.0, 168.0, 180.0, 10.0, 10.0)] + [(f"h{k}", t, x, 184.0, 6.0 * len(t), 10.0, 10.0) for k, (t, x) in enumerate(zip(above, (100.0, 180.0, 270.0, 340.0, 430.0)))]
        for line in range(3):
            for k, x in enumerate((100.0, 180.0, 270.0, 340.0, last[0])):
                text = str(figure * 10 ** (k % 3)) + "%" * (k > 2)
                out.append((f"l{line}-{k}", text, x, 200.0 + 16 * line, last[1] if k == 4 and last[1] is not None else 6.0 * len(text), 10.0, 10.0))
        return out

    close = [(i, t, 100.0 + (x - 100) * 0.15, y, w, h, f) for i, t, x, y, w, h, f in page(3, (430.0, 50.0))]
    pages = [page(7), page(44), page(812), close, page(5, above=("RF", "AF", "NO", "NF", "RA")), [], [("a", None, 1.0, 1.0, 1.0, 1.0, 1.0)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array([1, 2, 3, 1, 1, 1, 1], pa.int32()), pa.array([[dict(zip(sparse.PARTS, b)) for b in p] for p in pages], pa.list_(kind))], names=["doc_id", "page_number", "blocks"])
    plain = sparse._detected
    calls = []
    monkeypatch.setattr(sparse, "_forms", {})
    monkeypatch.setattr(sparse, "_detected", lambda p, g: calls.append(len(p)) or plain(p, g))
    got = [tuple(r.values()) for b in sparse._cells_of_pages(iter([batch]), Grid()) for r in b.to_pylist()]
    expected = [r for k, p in enumerate(pages) for r in plain([sparse.Block(k, batch.column("page_number")[k].as_py(), *b) for b in p], Grid())]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) > 60
    assert len(calls) == 7  # one for three alike pages, two each for those that a form leaves open, one each for the empty ones
    assert sum(v is None for v in sparse._forms.values()) == 2


def test_bands_ask_for_headers_once(monkeypatch):
    """a band that is only tried for the next row needs its columns, not its header or the places of all its rows."""
    from types import SimpleNamespace as Block

    from foliant.operators import tables

    asked = []
    plain = tables.has_header
    monkeypatch.setattr(tables, "has_header", lambda rows: asked.append(len(rows)) or plain(rows))
    block = lambda r, c: Block(text=str(r * 10 + c) if r else "abcd"[c], x=72.0 + 110 * c, y=72.0 + 16 * r, w=24.0, h=12.0, font_size=12.0, font_name="Times-Bold" if r == 0 else "Times-Roman")
    rows = tables.table_rows([block(r, c) for r in range(9) for c in range(4)], 12.0, tables.Grid())
    bands = tables.page_bands(rows, 12.0, tables.Grid())
    assert [len(b.rows) for b in bands] == [9] and bands[0].sure and bands[0].header and bands[0].confidence == 0.98
    assert asked == [9]


def test_text_grid_lines_are_dealt_out_before_their_cells(spark):
    """cells are not dealt out, only the lines by order and, at the end, the counts by table."""
    from foliant.plans import sequence_queries

    plan = sequence_queries.text_grid_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan[: plan.index("Generate")], plan[plan.index("Generate") :]
    assert "hashpartitioning(l_orderkey" in below and above.count("hashpartitioning") == 1 and "hashpartitioning(doc_id" in above.split("MapInArrow")[0]


def test_scripts_are_counted_without_a_match_a_character(spark):
    """characters are counted by what runs of them leave, with the counts of a plain look at each."""
    from pyspark.sql import functions as F

    from foliant.functions import language

    texts = [None, "", " \t\n", "plain words, 12\x7f", "é\x80\x9f\xa0ɏɐ", "漢字かなカナ한글Ａ　", "عربيݐ", "שלום", "приветԯ", "a😀𝒳b 漢", "\x00x y", "mixed é приве́т 漢 ع ש 😀 end"]
    spans = {"cjk": "　-ヿ㐀-䶿一-鿿가-힯＀-￯", "arabic": "؀-ۿݐ-ݿ", "hebrew": "֐-׿", "cyrillic": "Ѐ-ԯ", "latin": "\x21-\x7f\xa0-ɏ"}

    def plain(t: str | None) -> dict | None:
        if t is None:
            return dict.fromkeys(["latin", "cjk", "arabic", "hebrew", "cyrillic", "other"])
        import re

        n = {k: len(re.findall(f"[{v}]", t)) for k, v in spans.items()}
        return n | {"other": len(re.findall("[^\x00-\x20\x80-\x9f]", t)) - sum(n.values())}

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", language.script_counts(F.col("text")).alias("c"))
    assert {r.id: r.c.asDict() for r in df.collect()} == {k: plain(t) for k, t in enumerate(texts)}
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString() and "regexp_count" not in df._jdf.queryExecution().optimizedPlan().toString()
