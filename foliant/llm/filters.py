"""Filter interaction audit: what every filter removes in every order, from additive counters of failure masks.

A document's failures are bits of one mask. The bit for copies comes from a range sort by fingerprint, whole text and id:
a row fails if the run of equal texts that it lies in began with a smaller id. A task knows this for all rows but those that
equal the first text of its range, whose run may have begun in an earlier range; these wait for the ranges' edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, text_of, words_of

#: Filters of which all orders are listed; 120 orders of five, 720 of six.
MOST_FILTERS = 6


def default_rules(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, few distinct words, many capitals, a symbol."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


Rules = Callable[[Column, Column], dict[str, Column]]


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a range sorted by fp, text and doc_id (nulls last): rows with ``copy``, and the texts at the range's ends.

    A row is (doc_id, part, mask, copy, range, edge, fp, text); ``edge`` numbers the texts of the range's first fingerprint and
    is set where earlier ranges decide. A row with a text has the first id of that text in this range, at its first or last
    fingerprint; several texts have one fingerprint only where it collides.
    """
    here = TaskContext.get().partitionId()
    names = ["doc_id", "part", "mask", "copy", "range", "edge", "fp", "text"]
    first_fp, heads = None, 0
    held: list[tuple] = []  # (fp, text, first id) of the texts with the fingerprint at hand

    def ends(id_type: pa.DataType) -> pa.RecordBatch:
        n = len(held)
        ids, texts = pa.array([r[2] for r in held], id_type), pa.array([r[1] for r in held], pa.binary())
        edge = range(n) if held[0][0] == first_fp else [-1] * n
        cols = [ids, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array([here] * n, pa.int32()), pa.array(edge, pa.int32()), pa.array([r[0] for r in held], pa.int64()), texts]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ids, fp, text = b.column(0), b.column(3).to_numpy(), b.column(4)
        first_fp = int(fp[0]) if first_fp is None else first_fp
        new = np.ones(n, bool)
        alike = np.flatnonzero(fp[1:] == fp[:-1]) + 1
        if len(alike):
            new[alike] = ~pc.equal(text.take(pa.array(alike)), text.take(pa.array(alike - 1))).to_numpy(zero_copy_only=False)
        new[0] = not (held and held[-1][0] == fp[0] and held[-1][1] == text[0].as_py())
        # The first id of every row's run: that of an earlier batch at place 0, those of this batch from 1 on.
        starts = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
        firsts = pa.concat_arrays([pa.array([held[-1][2] if held else None], ids.type), ids]).take(pa.array(starts))
        copy = pc.fill_null(pc.greater(ids, firsts), False)
        for k in np.flatnonzero(new & ((fp == first_fp) | (fp == fp[-1]))).tolist():
            if held and held[0][0] != fp[k]:
                if held[0][0] == first_fp:
                    yield ends(ids.type)
                held = []
            held.append((int(fp[k]), text[k].as_py(), ids[k].as_py()))
        leading = fp == first_fp
        edge = heads - 1 + np.cumsum(new & leading)
        heads += int((new & leading).sum())
        waits = leading & ids.is_valid().to_numpy(zero_copy_only=False) & ~copy.to_numpy(zero_copy_only=False)
        cols = [ids, b.column(1), b.column(2), copy, pa.array(np.full(n, here, np.int32)), pa.array(edge.astype(np.int32), mask=~waits), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)
    if held:
        yield ends(ids.type)


def failure_masks(docs: DataFrame, rules: Rules = default_rules, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, mask) per row of ``docs``: bit k is the k-th rule's failure, the last bit that of a copy of a smaller id's text.

    Null texts are empty, a null part is the empty string. A row without an id is no copy and makes none; rows that agree in
    id and text are copies of smaller ids only, not of each other. Empty tables give no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    # The range bounds are sampled on short keys; equal fingerprints are in order of id over ranges, and of text within them.
    dealt = own.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", F.col("doc_id").asc_nulls_last())
    counted = dealt.withColumn("words", words_of(F.col("text")))
    bits = rules(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(bits.values())), F.lit(0))
    ready = counted.select("doc_id", "part", mask.cast("int").alias("mask"), "fp", F.col("text").cast("binary").alias("text")).sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    found = cut(ready.mapInArrow(_copies, f"doc_id {dict(own.dtypes)['doc_id']}, part string, mask int, copy boolean, range int, edge int, fp long, text binary"))
    ends = found.where("text IS NOT NULL AND doc_id IS NOT NULL")
    lows = ends.groupBy("fp", "text").agg(F.min("doc_id").alias("low"))
    heads = ends.where("edge >= 0").join(lows, ["fp", "text"]).select("range", "edge", "low")
    rows = found.where("text IS NULL")
    bit = 1 << len(bits)
    with_copy = lambda c: (F.col("mask") + F.when(c, bit).otherwise(0)).alias("mask")
    settled = rows.where("edge IS NULL").select("doc_id", "part", with_copy(F.col("copy")))
    waiting = rows.where("edge IS NOT NULL").join(heads, ["range", "edge"], "left").select("doc_id", "part", with_copy(F.col("low") < F.col("doc_id")))
    return settled.unionByName(waiting)


def audit_filters(docs: DataFrame, labels: DataFrame, rules: Rules = default_rules, copies: str = "E", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per part, order of all filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The filters are those of ``rules`` and, as the last letter, ``copies``. A label counts for all rows of its doc_id (quality
    or toxic is 1 in any of its rows); rows without an id have none. Every figure is a sum over counters by part, mask and label, so
    texts are read once. An empty table has no parts.
    """
    names = [*rules(F.lit(""), F.array(F.lit(""))), copies]
    if len(names) > MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"up to {MOST_FILTERS} filters with one letter each")
    masks = failure_masks(docs, rules, part_col, id_col, text_col).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    none = F.lit(False)
    cells = (
        masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.coalesce("good", none), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.coalesce("toxic", none), F.col("n")).otherwise(0)).alias("toxic"))
        .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    )
    orders = ["".join(x) for x in permutations(names)]
    bits = F.create_map(*[x for k, c in enumerate(names) for x in (F.lit(c), F.lit(1 << k))])
    letters = F.split("filter_order", "")
    steps = (
        cells.select("part", "cells", F.explode(F.split(F.lit(" ".join(orders)), " ")).alias("filter_order")).select("*", F.posexplode(letters).alias("at", "letter"))
        .withColumn("own", bits[F.col("letter")]).withColumn("before", F.aggregate(F.slice(letters, 1, F.col("at")), F.lit(0), lambda a, x: a + bits[x]))
    )
    own, prior = F.col("own"), F.col("before")

    def total(name: str, holds: Callable[[Column], Column], value: Callable[[Column], Column] = lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(holds(c["mask"]), value(c)).otherwise(F.lit(0).cast("long"))).alias(name)

    fails, earlier = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(prior) != 0)
    removed = lambda m: fails(m) & ~earlier(m)
    share = lambda c: (F.lit(len(orders)) / F.bit_count(c["mask"])).cast("long") * c["n"]
    return steps.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), total("kept", lambda m: ~fails(m) & ~earlier(m)), total("removed", removed), total("redundant", lambda m: fails(m) & earlier(m)),
        total("unique_fails", lambda m: m == own), total("good_lost", removed, lambda c: c["good"]), total("toxic_lost", removed, lambda c: c["toxic"]), total("shapley", fails, share),
    )
