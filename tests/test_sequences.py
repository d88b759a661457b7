"""Order-dependent operators, profiles and the lease stream."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import layout as O
from foliant.operators import profiles as P
from foliant.operators import sequences as Q
from foliant.operators import tables as B
from foliant.streaming.leases import agent_leases, lease_ms


def cell(page, seq, text, x, y, header=False, is_cell=True):
    return (1, page, seq, text, x, y, is_cell, header)


CELLS = "doc_id long, page_number int, seq int, text string, x double, y double, is_cell boolean, is_header boolean"


@pytest.mark.parametrize("x2,same", [((72.0, 200.0), True), ((320.0, 450.0), False)])
def test_table_goes_on_where_anchors_match(spark, x2, same):
    rows = [cell(1, 0, "A", 72.0, 700.0, True), cell(1, 1, "B", 200.0, 700.0, True), cell(2, 2, "A", x2[0], 72.0, True), cell(2, 3, "B", x2[1], 72.0, True)]
    got = {r.seq: r for r in Q.continued_tables(spark.createDataFrame(rows, CELLS)).collect()}
    assert (got[0].table_id == got[2].table_id) is same and got[2].repeated_header is same


def test_text_closes_a_table(spark):
    rows = [cell(1, 0, "A", 72.0, 100.0), cell(1, 1, "prose", 72.0, 112.0, is_cell=False), cell(1, 2, "B", 72.0, 124.0)]
    got = {r.seq: r.table_id for r in Q.continued_tables(spark.createDataFrame(rows, CELLS)).collect()}
    assert got[1] is None and got[0] != got[2]


def test_heading_levels(spark):
    assert [Q.next_level(3, {}), Q.next_level(4, {3: 1}), Q.next_level(2, {3: 2, 1: 1}), Q.next_level(1, {2: 1})] == [1, 2, 2, 1]
    df = spark.createDataFrame([(1, 1, k, f"H{v}") for k, v in enumerate((2, 4, 2, 3, 6))], "doc_id long, page_number int, seq int, role string")
    assert [r.normalized for r in sorted(Q.heading_levels(df).collect(), key=lambda r: r.seq)] == [1, 2, 1, 2, 3]


def test_pairs():
    a = {"x": 72.0, "y": 100.0, "w": 300.0, "h": 12.0, "text": "A line that goes on"}
    assert Q.pair_confidence(a, a | {"y": 114.0, "text": "and ends."}) == 1.0
    assert Q.pair_confidence(a | {"text": "It ends."}, a | {"y": 190.0, "text": "New one"}) < 0.5
    assert Q.pair_confidence(a, a | {"y": 105.0, "text": "overlaps"}) == pytest.approx(0.75)


def test_runs_are_claimed_once(spark):
    rows = [(1, 1, 0, 0, 2, 0.9), (1, 1, 0, 0, 1, 0.9), (1, 1, 1, 0, 1, 0.95), (1, 1, 1, 1, 1, 0.8), (1, 1, 2, 2, 1, 0.6)]
    got = Q.claimed_runs(spark.createDataFrame(rows, "doc_id long, page_number int, seq int, start int, length int, score double")).collect()
    assert {(r.seq, r.start, r.length) for r in got} == {(0, 0, 1), (1, 1, 1)}


def test_rules_that_cross_are_one_table(spark):
    rows = [(1, 1, 1, "h", 100.0, 0.0, 50.0), (1, 1, 2, "v", 49.0, 98.0, 200.0), (1, 1, 3, "h", 300.0, 0.0, 50.0), (1, 1, 4, "v", 20.0, 301.0, 400.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, segment_id long, orient string, at double, start double, end double")
    assert {r.segment_id: r.table_id for r in O.ruled_tables(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_equal_boxes_are_kept_once(spark):
    schema = "doc_id long, page_number int, seq int, comparable string, x double, y double, w double, h double"
    rows = [(1, 1, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "a", 2.0, 0.0, 10.0, 10.0), (1, 1, 2, "a", 4.0, 0.0, 10.0, 10.0), (1, 1, 3, "", 0.0, 0.0, 10.0, 10.0), (1, 1, 4, "", 0.0, 0.0, 10.0, 10.0)]
    assert {r.seq for r in O.distinct_boxes(spark.createDataFrame(rows, schema)).collect()} == {0, 2, 3, 4}


def test_segments_merge_from_their_furthest_end(spark):
    rows = [(1, 0.0, 100.0), (1, 10.0, 20.0), (1, 110.0, 130.0), (1, 200.0, 210.0)]
    got = O.coalesce_segments(spark.createDataFrame(rows, "k long, start double, end double"), ("k",)).collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 130.0)]


def test_profiles():
    profiles = {"default": {"ocr": {"mode": "auto", "dpi": 200}, "a": 1}, "legal": {"extends": "default", "ocr": {"dpi": 300}}, "x": {"extends": "y"}, "y": {"extends": "x"}}
    assert P.resolve_profile("legal", profiles) == {"ocr": {"mode": "auto", "dpi": 300}, "a": 1}
    for bad, error in (("x", ValueError), ("none", KeyError)):
        with pytest.raises(error):
            P.resolve_profile(bad, profiles)
    assert len(P.settings_grid(alpha=[0.5, 1, 2], exponent=[0, 0.35, 1], least=[1, 2])) == 18
    roles = {"a": {"P"}, "b": {"P", "H1"}, "c": {"LI"}, "d": {"P"}, "e": {"P"}}
    assert P.held_out_documents(roles, 0.4) == {"b", "c"} and P.held_out_documents({"a": {"P"}}) == set()


def test_leases_over_a_stream(spark, tmp_path):
    assert (lease_ms(10), lease_ms(20_000)) == (30_000, 60_000)
    start = pd.Timestamp("2024-01-01")
    at = lambda s: (start + pd.Timedelta(seconds=s)).to_pydatetime()
    beats = [(1, at(0), "idle"), (1, at(20), "busy"), (1, at(50), "busy"), (1, at(200), "busy"), (1, at(10), "late"), (2, at(0), "idle")]
    spark.createDataFrame(beats, "agent_id long, ts timestamp, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("agent_id long, ts timestamp, state string").parquet(str(tmp_path / "in"))
    query = agent_leases(stream).writeStream.outputMode("update").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.agent_id: r for r in spark.table("leases").withColumn("since", F.unix_timestamp("state_since") - F.unix_timestamp(F.lit(at(0)))).collect()}
    assert (last[1].beats, last[1].expired, last[1].state, last[1].since) == (5, 1, "busy", 20) and last[2].expired == 0


def grid(texts, font=lambda row: "Times"):
    rows = [(1, 1, r * 10 + c, f"{r}:{c}", t, 72.0 + 120 * c, 72.0 + 18 * r, 6.0 * len(t), 12.0, 12.0, font(r)) for r, line in enumerate(texts) for c, t in enumerate(line)]
    return rows, "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, font_size double, font_name string"


def test_text_grid_tables(spark):
    table = [["Item", "Count", "Price"], ["Bolt", "12", "$3.50"], ["Nut", "7", "$1.25"], ["Pin", "3", "$0.40"]]
    got = {r.block_id: r for r in B.text_grid_tables(spark.createDataFrame(*grid(table))).collect()}
    assert len(got) == 12 and got["0:0"].table_role == "header" and (got["2:1"].table_row, got["2:1"].table_column, got["2:1"].table_role) == (2, 1, "cell")
    assert got["0:0"].confidence == 0.98
    labels = [["Name", "Ada"], ["Role", "Lead"], ["Team", "Core"]]
    assert B.text_grid_tables(spark.createDataFrame(*grid(labels))).count() == 0


def test_nearest_values_are_taken_once():
    assert B.nearest_pairs([0.0, 1.0, 9.0], [1.0, 10.0], 3) == [(0, 0), (2, 1)]
    assert [len(c) for c in B.running_clusters([0, 5, 9, 13, 17], float, 6)] == [2, 3]


def test_groups_against_a_running_margin(spark):
    schema = "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, column_hint int, role string"
    lines = [("a", 72, 100), ("b", 72, 114), ("c", 90, 128), ("d", 72, 142), ("- e", 72, 156), ("f", 72, 230)]
    df = spark.createDataFrame([(1, 1, k, t[-1], t, float(x), float(y), 200.0, 12.0, 0, "P") for k, (t, x, y) in enumerate(lines)], schema)
    assert {r.block_id: r.paragraph for r in Q.margin_groups(df).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 2, "f": 3}
