"""Queries that match blocks with runs of the source and operators with tags; runs and operators are made from the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import matching
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL, blocks_from_documents
from foliant.sources.tables import read_table

MATCHES = Registry()


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(read_table(spark, d, "documents"))


def _runs(b: DataFrame) -> DataFrame:
    """Every third line whole, in two at a space, or in two within a word."""
    n, kind = F.length("text"), F.col("seq") % 3
    half = F.floor(n / 2)
    space = F.locate(" ", F.col("text"))
    cut = F.when((kind == 1) & (space > 0), space).when((kind == 2) & (n > 1), half).otherwise(n).cast("int")
    part = lambda k, start, size: F.struct(F.lit(k).alias("k"), F.substring("text", start, size).alias("text"), (F.col("x") + F.col("w") * (start - 1) / n).alias("x"), (F.col("w") * size / n).alias("w"))
    parts = F.array(part(0, F.lit(1), F.col("cut")), F.when(F.col("cut") < n, part(1, F.col("cut") + 1, n - F.col("cut"))))
    r = b.withColumn("cut", cut).select("doc_id", "page_number", "seq", "y", "h", F.explode(F.array_compact(parts)).alias("p"))
    return r.select("doc_id", "page_number", F.concat(F.lit("r"), "seq", F.lit("-"), "p.k").alias("run_id"), (F.col("seq") * 2 + F.col("p.k")).alias("seq"), "p.text", "p.x", "y", "p.w", "h")


@MATCHES.query("source_mappings", f"""WITH {BLOCKS_SQL}, c AS (SELECT *, CASE WHEN seq % 3 = 1 AND strpos(text, ' ') > 0 OR seq % 3 = 2 AND length(text) > 1 THEN 2 ELSE 1 END AS n_runs FROM blocks)
SELECT doc_id, page_number, block_id, CASE n_runs WHEN 1 THEN 'r' || seq || '-0' ELSE 'r' || seq || '-0,r' || seq || '-1' END AS run_ids, 1.0::DOUBLE AS confidence FROM c""")
def source_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Operators 50, 147: every line and the runs that it was drawn by, one or two in a row."""
    b = _blocks(spark, d)
    m = matching.source_mappings(b, _runs(b))
    return m.select("doc_id", "page_number", "block_id", F.array_join("run_ids", ",").alias("run_ids"), F.round("confidence", 5).alias("confidence"))


def _ops(b: DataFrame) -> DataFrame:
    """Two operators a line: its first word at its left, more or less, and the rest without spaces at its middle."""
    first, rest = F.substring_index("text", " ", 1), F.regexp_replace(F.expr("substring(text, length(substring_index(text, ' ', 1)) + 1)"), " ", "")
    at = lambda k, text, x: F.struct(F.lit(k).alias("k"), text.alias("text"), x.alias("x"))
    ops = F.array(at(0, first, F.col("x") - F.col("seq") % 5 * 3.0), at(1, rest, F.col("x") + F.col("w") / 2))
    o = b.select("doc_id", "page_number", "seq", (F.col("y") + 6.0).alias("y"), F.explode(ops).alias("p"))
    return o.select("doc_id", "page_number", (F.col("seq") * 2 + F.col("p.k")).alias("op_seq"), "p.text", "p.x", "y")


_OPS = f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, page_number, seq, lower(text) AS node, x, y, w, h, text FROM blocks),
o AS (SELECT doc_id, page_number, seq * 2 AS op_seq, lower(string_split(text, ' ')[1]) AS op, x - seq % 5 * 3.0 AS ox, y + 6.0 AS oy FROM blocks
  UNION ALL SELECT doc_id, page_number, seq * 2 + 1, lower(replace(substr(text, length(string_split(text, ' ')[1]) + 1), ' ', '')), x + w / 2, y + 6.0 FROM blocks WHERE strpos(text, ' ') > 0),
near AS (SELECT row_number() OVER () AS pair, o.doc_id, o.page_number, op_seq, op, seq, node, greatest(x - ox, ox - x - w, 0) AS dx, greatest(y - oy, oy - y - h, 0) AS dy FROM o JOIN t ON o.doc_id = t.doc_id AND o.page_number = t.page_number
  AND ox BETWEEN x - 10 AND x + w + 10 AND oy BETWEEN y - 10 AND y + h + 10 ),
sure AS (SELECT pair FROM near WHERE node = op OR contains(node, op) OR contains(op, node) AND length(node) >= 0.8 * length(op) OR length(op) >= 5 AND contains(replace(node, ' ', ''), op)),
odd AS (SELECT pair, op, node FROM near WHERE NOT contains(node, op) AND NOT contains(op, node) AND least(length(op), length(node)) - 1 >= 0.8 * (greatest(length(op), length(node)) - 1)),
g AS (SELECT pair, g, sum(a) AS a, sum(b) AS b FROM (SELECT pair, substr(op, i, 2) AS g, 1 AS a, 0 AS b FROM (SELECT *, unnest(generate_series(1, length(op) - 1)) AS i FROM odd) UNION ALL SELECT pair, substr(node, i, 2), 0, 1 FROM (SELECT *, unnest(generate_series(1, length(node) - 1)) AS i FROM odd)) GROUP BY ALL),
m AS (SELECT * FROM near WHERE pair IN (FROM sure) OR pair IN (SELECT pair FROM g GROUP BY pair HAVING sum(least(a, b)) >= 0.8 * sum(greatest(a, b)))),
k AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) <= 2 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM m WHERE sqrt(dx * dx + dy * dy) <= 10),
best AS (SELECT doc_id, page_number, op_seq, min(seq) AS tag_order, arg_min(confidence, seq) AS confidence, any_value(op) AS op FROM k GROUP BY ALL)"""


def _matched(spark: SparkSession, d: str, texts: bool = False) -> DataFrame:
    b = _blocks(spark, d)
    return matching.match_operators(_ops(b), b.withColumn("tag_order", F.col("seq")), texts=texts)


@MATCHES.query("tags_of_operators", f"{_OPS} SELECT doc_id, page_number, op_seq, tag_order, confidence FROM best")
def tags_of_operators(spark: SparkSession, d: str) -> DataFrame:
    """Operator 51: text operators and the tags in whose boxes they lie."""
    return _matched(spark, d)


@MATCHES.query("matched_tags", f"""{_OPS}, drawn AS (SELECT b.doc_id, b.page_number, tag_order, count(*) AS n_ops, avg(confidence) AS confidence, length(trim(string_agg(op, '' ORDER BY op_seq))) AS n FROM best b GROUP BY ALL)
SELECT d.doc_id, d.page_number, tag_order, row_number() OVER (PARTITION BY d.doc_id, d.page_number ORDER BY tag_order) - 1 AS mcid, n_ops, round(confidence, 6) AS confidence, round(least(1, n / length(node)), 6) AS coverage
FROM drawn d JOIN t ON t.doc_id = d.doc_id AND t.page_number = d.page_number AND t.seq = tag_order""")
def matched_tags(spark: SparkSession, d: str) -> DataFrame:
    """Operator 51: tags with their operators, numbered by page, and how much of their text these draw."""
    return matching.matched_tags(_matched(spark, d, texts=True))
