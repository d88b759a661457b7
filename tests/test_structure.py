"""Table structure, matching, splits, sources and timers against plain versions and known cases."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import grids, matching, regular, sparse, splits
from foliant.sources import files
from foliant.streaming.leases import lease_expiries, rocksdb_state
from foliant.streaming.runs import streamed

rng = random.Random(5)
BLOCK = "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, font_size double"


def sheet(doc, lines, top=100.0):
    """Blocks of lines of (x, text), 16 points apart."""
    return [(doc, 1, 20 * r + k, f"{r}-{k}", t, float(x), top + 16.0 * r, 6.0 * len(t), 10.0, 10.0) for r, line in enumerate(lines) for k, (x, t) in enumerate(line)]


def numbers(k):
    return [(100, str(k)), (180, str(20 + k)), (260, f"{k}%"), (340, f"${k}.50")]


def test_sparse_tables(spark):
    xs = (100, 180, 260, 340)
    two = [[(100, "Table 3 shows what the shops sold.")], [(180, "Amounts"), (340, "Net")], list(zip(xs, ("Shop", "May", "June", "Sum"))), *map(numbers, (1, 2, 3))]
    few = [[*numbers(1)], [*numbers(2)], [(100, "3"), (180, "4")]]
    prose = [[(100, "sold by the shops of the town, as before (see above)")], *map(numbers, (1, 2, 3, 4))]
    rows = spark.createDataFrame(sheet(1, two) + sheet(2, few) + sheet(3, prose) + [(4, 1, 0, "a", None, 1.0, 1.0, 1.0, 1.0, 10.0)], BLOCK)
    got = sparse.sparse_tables(rows).collect()
    assert {r.doc_id for r in got} == {1, 3}
    heads = {r.table_column: (r.text, r.sources) for r in got if r.doc_id == 1 and r.table_role == "header"}
    assert {k: v[0] for k, v in heads.items()} == {0: "Shop", 1: "Amounts May", 2: "Amounts June", 3: "Net Sum"} and heads[1][1] == ["1-0", "2-1"]
    assert {r.block_id for r in got if r.table_role == "replaced"} == {"1-0", "1-1", "2-0", "2-1", "2-2", "2-3"}
    assert sorted({r.table_row for r in got if r.table_role == "cell" and r.doc_id == 1}) == [1, 2, 3]
    assert all(r.table_role == "cell" for r in got if r.doc_id == 3) and len([r for r in got if r.doc_id == 3]) == 16
    assert sparse.sparse_tables(rows.limit(0)).count() == 0


def test_orphans(spark):
    lines = [[(180, "Spring")], list(zip((100, 180, 260, 340), ("Shop", "May", "June", "Sum"))), *map(numbers, (1, 2, 3))]
    blocks = [b if b[4] != "Spring" else (*b[:6], 76.0, *b[7:]) for b in sheet(1, lines)]
    blocks += [(1, 1, 99, "label", "Bern", 50.0, 132.0, 24.0, 10.0, 10.0), (1, 1, 98, "far", "x", 5.0, 132.0, 6.0, 10.0, 10.0), (1, 1, 97, "lower", "below it", 180.0, 76.0, 40.0, 10.0, 10.0)]
    df = spark.createDataFrame(blocks, BLOCK)
    cells = sparse.sparse_tables(df)
    got = {r.block_id: r for r in sparse.adopt_orphans(df, cells).collect()}
    assert got["0-0"].method == "orphan-above" and (got["0-0"].table_row, got["0-0"].table_column, got["0-0"].table_role) == (0, 1, "header")
    assert (got["label"].table_row, got["label"].table_column, got["label"].table_role) == (2, 0, "cell") and not got.keys() & {"far", "lower"}
    assert got["1-0"].table_row == 1 and got["4-3"].table_row == 4 and len(got) == cells.count() + 2


def test_grid_cells_cover_the_grid(spark):
    rows = []
    for k in range(60):
        n, m = rng.randint(2, 6), rng.randint(2, 6)
        signals = [("colspan", r, c) for r in range(n) for c in range(m - 1) if rng.random() < 0.3] + [("rowspan", r, c) for r in range(n - 1) for c in range(m) if rng.random() < 0.4]
        rows.append((k, 1, 0, [float(y) for y in range(n + 1)], [float(x) for x in range(m + 1)], signals))
    df = spark.createDataFrame(rows, "doc_id long, page_number int, table_id long, ys array<double>, xs array<double>, signals array<struct<kind:string,row:int,col:int>>")
    for r in grids.grid_cells(df).collect():
        _, _, _, ys, xs, signals = rows[r.doc_id]
        seen = [(i, k) for c in r.cells for i in range(c.row, c.row + c.row_span) for k in range(c.col, c.col + c.column_span)]
        assert set(seen) == {(i, k) for i in range(len(ys) - 1) for k in range(len(xs) - 1)}
        first = r.cells[0]
        assert (first.column_span > 1) == (("colspan", 0, 0) in signals)


def test_regular_tables_are_rectangles(spark):
    rows = []
    for k in range(120):
        for r in range(rng.randint(1, 5)):
            for c in range(rng.randint(1, 4)):
                rows.append((k, "t", c, f"{r}-{c}", rng.choice(["TH", "TD"]), "head" if r == 0 else "body", r, rng.choice([None, c, c + 1, 99]), rng.choice([None, 1, 1, 2, 3]), rng.choice([None, 1, 1, 2]), "x"))
    df = spark.createDataFrame(rows, "doc_id long, table_id string, seq int, cell_id string, type string, section string, row int, col int, row_span int, column_span int, text string")
    tables = {}
    for c in regular.regular_tables(df).collect():
        tables.setdefault(c.doc_id, []).append(c)
    assert sum(not c.synthetic for t in tables.values() for c in t) == len(rows)
    for t in tables.values():
        seen = [(r, k) for c in t for r in range(c.row, c.row + c.row_span) for k in range(c.col, c.col + c.column_span)]
        assert len(seen) == len(set(seen)) == (max(r for r, _ in seen) + 1) * (max(k for _, k in seen) + 1)


def test_trailing_values(spark):
    texts = ["Sales in May $1,200.50", "Share 12 %", "Growth 3 million", "Year 2024", "$5", "a  b -€3", None, "12 $3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(regular.trailing_value(F.col("t")).alias("v"))
    assert [tuple(r.v) if r.v else None for r in df.collect()] == [("Sales in May", "$1,200.50"), ("Share", "12 %"), ("Growth", "3 million"), None, None, ("a b", "-€3"), None, None]


def test_source_mappings_take_the_nearest(spark):
    b = [(1, 1, "a", "one two", 0.0, 0.0, 40.0, 10.0), (1, 1, "b", "one two", 0.0, 50.0, 40.0, 10.0), (1, 1, "c", "lost", 0.0, 90.0, 40.0, 10.0)]
    r = [(1, 1, "r0", 0, "one two", 0.0, 52.0, 40.0, 10.0), (1, 1, "r1", 1, "one", 1.0, 0.0, 18.0, 10.0), (1, 1, "r2", 2, "two", 22.0, 0.0, 18.0, 10.0), (1, 1, "r3", 3, "other", 0.0, 90.0, 40.0, 10.0)]
    m = matching.source_mappings(spark.createDataFrame(b, "doc_id long, page_number int, block_id string, text string, x double, y double, w double, h double"), spark.createDataFrame(r, "doc_id long, page_number int, run_id string, seq int, text string, x double, y double, w double, h double"))
    got = {x.block_id: x for x in m.collect()}
    assert {k: v.run_ids for k, v in got.items()} == {"a": ["r1", "r2"], "b": ["r0"]} and got["a"].confidence == 1.0 and got["b"].geometry_score == 0.8


def test_operators_go_to_the_first_tag(spark):
    tags = spark.createDataFrame([(1, 1, 0, "The quick fox", 0.0, 0.0, 100.0, 10.0), (1, 1, 1, "quick words", 0.0, 8.0, 100.0, 10.0)], "doc_id long, page_number int, tag_order int, text string, x double, y double, w double, h double")
    ops = spark.createDataFrame([(1, 1, 0, "quick", 5.0, 9.0), (1, 1, 1, "quickwords", 5.0, 9.0), (1, 1, 2, "words", 5.0, 26.0), (1, 1, 3, "words", 5.0, 40.0), (1, 1, 4, " ", 5.0, 9.0)], "doc_id long, page_number int, op_seq int, text string, x double, y double")
    got = {(r.op_seq, r.tag_order, r.confidence) for r in matching.match_operators(ops, tags).collect()}
    assert got == {(0, 0, 1.0), (1, 1, 1.0), (2, 1, 0.8)}


def test_stratified_split(spark):
    roles = [(d, r, n) for d in range(60) for r, n in {"P": 5 + d % 3, **({"H1": 1} if d % 7 == 0 else {}), **({"LI": 2} if d in (3, 41) else {}), **({"TH": 1} if d == 17 else {})}.items()]
    df = spark.createDataFrame(roles, "doc_id long, role string, n long")
    got = {r.doc_id for r in splits.stratified_split(df).where("held_out").collect()}
    import hashlib

    h = {d: int(hashlib.sha256(str(d).encode()).hexdigest()[:8], 16) for d in range(60)}
    mine = {d: {r: n for x, r, n in roles if x == d} for d in range(60)}
    corpus = {r: sum(m.get(r, 0) for m in mine.values()) for r in ("P", "H1", "LI", "TH")}
    taken, held = [], dict.fromkeys(corpus, 0)
    while len(taken) < 12:
        gain = lambda d: round(sum(min(n, min(3, corpus[r]) - held[r]) / corpus[r] for r, n in mine[d].items() if held[r] < min(3, corpus[r])), 12)  # noqa: B023, E731
        best = max((d for d in mine if d not in taken), key=lambda d: (gain(d), h[d]))
        taken.append(best)
        for r, n in mine[best].items():
            held[r] += n
    assert got == set(taken) and {17, 3, 41} & got >= {17}
    assert splits.stratified_split(df.limit(0)).count() == 0 and splits.stratified_split(df.where("doc_id = 1")).where("held_out").count() == 0


def test_contracts_and_logs(spark, tmp_path):
    good = {"id": "a", "n": 2}
    (tmp_path / "c/sub").mkdir(parents=True)
    (tmp_path / "c/a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "c/sub/b.json").write_text(json.dumps([{"id": "b", "n": None}, {"id": "c", "n": 3, "more": 1}], indent=1))
    (tmp_path / "c/x.json").write_text('{"id": "x", ')
    got = {(r.id, r.n, r.problem) for r in files.read_contract(spark, f"file://{tmp_path}/c", "id string, n int", ["id", "n"]).collect()}
    assert got == {("a", 2, None), ("b", None, "missing n"), ("c", 3, None), (None, None, "corrupt")}
    assert {r.name for r in files.inventory(spark, f"file://{tmp_path}/c", "*.json").collect()} == {"a.json", "b.json", "x.json"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l/1.jsonl").write_text('{"k": 1, "v": "old"}\n\n{"k": 2, "v": "x"}\nbroken\n{"k": 1, "v": "new"}\n')
    (tmp_path / "l/2.jsonl").write_text('{"k": 2, "v": "y"}\n{"k": null, "v": "z"}\n')
    log = files.read_log(spark, f"file://{tmp_path}/l", "k bigint, v string")
    assert log.where("problem IS NOT NULL").count() == 1
    assert {(r.k, r.v) for r in files.last_appended(log, "k").collect()} == {(1, "new"), (2, "y")}


@pytest.mark.parametrize("n_files", [1, 3])
def test_silence_ends_leases(spark, tmp_path, n_files):
    """Whatever the batches and the order within the delay, the leases of a replay run out."""
    start = pd.Timestamp("2024-01-01")
    at = lambda s: (start + pd.Timedelta(seconds=s)).to_pydatetime()
    beats = [(1, 0), (1, 20), (1, 90), (2, 10), (1, 70), (3, 95), (2, 200), (3, 210), (None, 5), (1, 260), (4, 400)]
    schema = "agent_id long, ts timestamp"
    size = -(-len(beats) // n_files)
    for k in range(n_files):
        spark.createDataFrame([(a, at(s)) for a, s in beats[k * size : (k + 1) * size]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with rocksdb_state(spark):
        streamed(lease_expiries(stream, 10, "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(180)
    got = {(r.agent_id, r.beats, (r.expired_at - start.to_pydatetime()).total_seconds()) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 2, 50), (1, 2, 120), (1, 1, 290), (2, 1, 40), (2, 1, 230), (3, 1, 125), (3, 1, 240)}
