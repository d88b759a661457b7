"""Ranks within groups of any size: DuckDB windows over buckets of a group's pairs, offset by the totals of earlier buckets.

Spark deals the rows to buckets by ranges of group and pair, and of what orders equal pairs, so a group or pair of a third of
all rows is many buckets and small groups share one. DuckDB ranks the rows of a bucket and may put them on disk. Only the
first and the last group of a bucket can go on in others; their totals, two rows for each, give what their ranks are off by.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.llm.common import cut, free_name


@dataclass(frozen=True)
class Ranking:
    """Groups by ``group``, in order of ``pair``; ``ties`` put the rows of one pair in order. All ascending, nulls first in ``group`` and ``pair``, last in ``ties``."""

    group: tuple[str, ...]
    pair: tuple[str, ...]
    ties: tuple[str, ...] = ()
    at_most: int | None = None  # rows with a larger pos are left out
    memory: str = "256MB"  # of DuckDB in a task; beyond it, rows go to disk
    batch: int = 20_000  # rows handed back at once


def _bucket_sql(g: list[str], p: list[str], t: list[str], at_most: int | None) -> tuple[str, str]:
    """Statements over the rows ``lines`` of a bucket: the totals ``ends`` of its first and last group, and its ranked rows with these."""
    first = lambda names: ", ".join(f"{x} NULLS FIRST" for x in names)
    group, pair = ", ".join(g), ", ".join(p)
    alike = " AND ".join(f"r.{x} IS NOT DISTINCT FROM e.{x}" for x in g)
    ends = f"""CREATE TABLE ends AS
WITH pairs AS (SELECT {group}, {pair}, count(*) AS n FROM lines GROUP BY ALL),
f AS (SELECT {group}, 1 AS e FROM pairs ORDER BY {first(g)} LIMIT 1), l AS (SELECT {group}, 2 AS e FROM pairs ORDER BY {", ".join(f"{x} DESC NULLS LAST" for x in g)} LIMIT 1),
own AS (SELECT {group}, min(e)::INT AS e FROM (FROM f UNION ALL FROM l) GROUP BY ALL),
k AS (SELECT r.*, e.e, row_number() OVER (PARTITION BY e.e ORDER BY {first(f"r.{x}" for x in p)}) AS k, sum(n) OVER (PARTITION BY e.e)::BIGINT AS n_rows, count(*) OVER (PARTITION BY e.e) AS n_pairs FROM pairs r JOIN own e ON {alike})
SELECT e, {group}, {pair}, n, n_rows, n_pairs, k FROM k WHERE k = 1 OR k = n_pairs"""
    order = ", ".join([first(p), *(f"{x} NULLS LAST" for x in t)])
    rows = f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS pos, rank() OVER v AS rank, dense_rank() OVER v AS dense, count(*) OVER (PARTITION BY {group}, {pair}) AS tied
  FROM lines WINDOW v AS (PARTITION BY {group} ORDER BY {first(p)}))
SELECT r.*, coalesce(e.e, 0)::INT AS e, NULL::BIGINT AS n, NULL::BIGINT AS n_rows, NULL::BIGINT AS n_pairs FROM ranked r LEFT JOIN (SELECT DISTINCT e, {group} FROM ends) e ON {alike} {f"WHERE pos <= {at_most}" if at_most is not None else ""}
UNION ALL BY NAME SELECT {group}, {pair}, e, n, n_rows, n_pairs, k AS pos FROM ends"""
    return ends, rows


def rank_ties(rows: DataFrame, p: Ranking) -> DataFrame:
    """``rows`` with pos (from 1, no two alike), rank, dense (equal pairs alike) and tied (rows of the group with the pair), all long.

    A new name that ``rows`` has already gets underscores in front. Nulls in ``group`` are a group, nulls in ``pair`` are equal; rows that
    agree in everything are ranked separately. Rows beyond ``at_most`` go after their bucket is ranked, as pos only grows by
    earlier buckets, but count in tied. An empty table gives no rows. Other columns pass through.
    """
    keys = {c: f"{kind}{k}" for kind, names in (("g", p.group), ("p", p.pair), ("t", p.ties)) for k, c in enumerate(names)}
    names = keys | {c: f"x{k}" for k, c in enumerate(c for c in rows.columns if c not in keys)}
    g, pairs, t = ([names[c] for c in cs] for cs in (p.group, p.pair, p.ties))
    own = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("salt", F.monotonically_increasing_id())
    # Rows that agree in all keys may lie on both sides of a bound, for which their number decides.
    dealt = own.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*g, *pairs)], *[F.col(c).asc_nulls_last() for c in t], "salt").drop("salt")
    made = ["pos", "rank", "dense", "tied", "n", "n_rows", "n_pairs"]
    schema = ", ".join([*(f"{c} {kind}" for c, kind in dealt.dtypes), *(f"{c} long" for c in made), "e int", "bucket int"])
    order = [*dealt.columns, *made, "e"]
    ends_sql, rows_sql = _bucket_sql(g, pairs, t, p.at_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        one = next((b for b in batches if b.num_rows), None)
        if one is None:
            return
        folder = tempfile.mkdtemp()
        con = duckdb.connect(config={"threads": 1, "memory_limit": p.memory, "temp_directory": folder})
        try:
            con.register("dealt", pa.RecordBatchReader.from_batches(one.schema, chain([one], batches)))
            con.execute("CREATE TABLE lines AS FROM dealt")
            con.execute(ends_sql)
            here = TaskContext.get().partitionId()
            for b in con.sql(rows_sql).to_arrow_reader(p.batch):
                cols = [b.column(b.schema.get_field_index(c)) for c in order]
                cols = [c.cast(one.schema.field(n).type) if n in one.schema.names else c for n, c in zip(order, cols)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([here] * b.num_rows, pa.int32())], names=[*order, "bucket"])
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    found = cut(dealt.mapInArrow(run, schema))
    off = _offsets(found.where("n IS NOT NULL"), g, pairs)
    lines = found.where("n IS NULL")
    at = lambda side: F.struct(*pairs).eqNullSafe(F.col(f"{side}.pair"))
    ends = lines.where("e > 0").join(off, ["bucket", "e"]).withColumns(
        {
            "rank": F.col("rank") + F.col("rows_before") - F.when(at("head"), F.col("head.before")).otherwise(0),
            "tied": F.when(at("head"), F.col("head.total")).when(at("tail"), F.col("tail.total")).otherwise(F.col("tied")),
            "pos": F.col("pos") + F.col("rows_before"), "dense": F.col("dense") + F.col("pairs_before"),
        }
    )
    every = lines.where("e = 0").select(*dealt.columns, *made[:4]).unionByName(ends.select(*dealt.columns, *made[:4]))
    every = every if p.at_most is None else every.where(F.col("pos") <= p.at_most)
    return every.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c).alias(free_name(rows, c)) for c in made[:4]])


def _offsets(ends: DataFrame, g: list[str], pairs: list[str]) -> DataFrame:
    """Per bucket and end: rows and distinct pairs of its group in earlier buckets, and for the group's first (``head``) and last pair here
    (``tail``) the rows that earlier buckets and all buckets have of it."""
    earlier = lambda w: w.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    of_pair = W.partitionBy(*g, *pairs)
    known = ends.select("bucket", "e", *g, F.struct(*pairs).alias("pair"), "n_rows", "n_pairs", "pos", zero(F.sum("n").over(earlier(of_pair))).alias("before"), F.sum("n").over(of_pair).alias("total"))
    side = F.struct("pair", "before", "total")
    each = known.groupBy("bucket", "e", *g).agg(F.first("n_rows").alias("n_rows"), F.first("n_pairs").alias("n_pairs"), F.min_by(side, "pos").alias("head"), F.max_by(side, "pos").alias("tail"))
    goes_on = (F.col("head.before") > 0).cast("long")
    w = earlier(W.partitionBy(*g))
    return each.select("bucket", "e", "head", "tail", zero(F.sum("n_rows").over(w)).alias("rows_before"), (zero(F.sum(F.col("n_pairs") - goes_on).over(w)) - goes_on).alias("pairs_before"))


def pair_keys(quantity: Column, discount: Column) -> tuple[Column, Column]:
    """Keys that put larger tens of a quantity first and then smaller percents of a discount, nulls before all."""
    return -F.floor(quantity / 10), F.floor(100 * discount + 0.5)
