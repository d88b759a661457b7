"""Mixing sources to target weights by balanced sampling with the cube method.

A source with target t and size s is taken t / s times: every document a whole number of times, and once
more with the fractional part as inclusion probability. Which documents get the extra copy is drawn by the
flight phase of the cube method: probabilities move along the null space of the balancing constraints
(number of documents, number of tokens) until all but two are 0 or 1. Blocks of documents fly on their own,
large ones first; what they leave undecided flies by source, together with documents that were kept back for it, and
two documents per source remain to be landed. Documents that were kept back then mend what the landing is off by.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliant.llm.common import WORD, cut, free_name, text_of


@dataclass(frozen=True)
class Mixing:
    """Weights repeat over the sources in order; a document is taken ``cap`` times at most."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    cap: int = 3
    seed: int = 17
    #: documents of a source that fly together; bounds the rows of a task
    block: int = 4096
    #: documents of a source, about, that fly last
    spare: int = 1000


def source_targets(sizes: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """(source, source_size, n_docs, target) from rows of (source, size).

    Sources stand in code point order, null last. The targets share the sum of all sizes by weight, but stop
    at ``cap`` times the source's size; what is left over is shared again, so there is one level per unit of
    weight that all open sources get. It is found by sorting sources by cap over weight. One row per source
    goes through one task here, after the documents have been summed.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    by = by.withColumn("weight", F.get(weights, rank % len(p.weights))).withColumn("cap", (F.col("source_size") * p.cap).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    by = by.withColumn("level", level)
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    by = by.withColumn("level", F.first(reached, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return by.select("source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def fly(prob: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Flight phase: returns probabilities of which two at most lie strictly between 0 and 1.

    Their sum and the sum of size times probability stay as they are.
    """
    prob, eps = list(prob), 1e-9
    open_ = [i for i, q in enumerate(prob) if eps < q < 1 - eps][::-1]
    pool: list[int] = []
    while True:
        while len(pool) < 3 and open_:
            pool.append(open_.pop())
        if len(pool) < 3:
            return prob
        a, b, c = pool
        move = [size[b] - size[c], size[c] - size[a], size[a] - size[b]]
        if not any(move):
            move = [1.0, -1.0, 0.0]
        most = max(abs(m) for m in move)
        move = [m / most for m in move]
        up = min(((1 - prob[i]) / m if m > 0 else prob[i] / -m) for i, m in zip(pool, move) if m)
        down = min((prob[i] / m if m > 0 else (1 - prob[i]) / -m) for i, m in zip(pool, move) if m)
        step = up if rng.random() * (up + down) < down else -down
        for i, m in zip(pool, move):
            q = prob[i] + step * m
            prob[i] = 0.0 if q < eps else 1.0 if q > 1 - eps else q
        pool = [i for i in pool if 0.0 < prob[i] < 1.0]


def settle(prob: list[float], size: list[float]) -> list[float]:
    """Landing, first part: gives up the number of documents and trades tokens between the last two open ones."""
    prob = list(prob)
    at = [i for i, q in enumerate(prob) if 0.0 < q < 1.0]
    while len(at) > 1 and size[at[0]] and size[at[1]]:
        a, b = sorted(at[:2], key=lambda i: -size[i])
        give = min(prob[a] * size[a], (1 - prob[b]) * size[b]) if prob[a] < 0.5 else -min((1 - prob[a]) * size[a], prob[b] * size[b])
        prob[a], prob[b] = prob[a] - give / size[a], prob[b] + give / size[b]
        for i in (a, b):
            prob[i] = 0.0 if prob[i] < 1e-9 else 1.0 if prob[i] > 1 - 1e-9 else prob[i]
        at = [i for i in at if 0.0 < prob[i] < 1.0]
    return prob


def land(prob: list[float], size: list[float], spare: list[bool]) -> list[float]:
    """Rounds the open probabilities, two at most after the last flight, so that the sum of sizes moves least.

    What the sum is off by after each way to round is mended with the ``spare`` documents: from the largest to the
    smallest, one is taken in or left out where that does not go too far, and at last the one that brings the sum
    nearest. The way that ends nearest is kept, of equal ones that with the fewest documents changed.
    """
    goal = sum(q * s for q, s in zip(prob, size))
    prob = settle(prob, size)
    at = [i for i, q in enumerate(prob) if 0.0 < q < 1.0]
    order = sorted((i for i, free in enumerate(spare) if free and i not in at), key=lambda i: -size[i])
    best = None
    for bits in range(1 << len(at)):
        tried = list(prob)
        for k, i in enumerate(at):
            tried[i] = float(bits >> k & 1)
        error, changed = sum(q * s for q, s in zip(tried, size)) - goal, 0
        for i in order:  # without going too far
            change = size[i] * (1 - 2 * tried[i])
            if abs(error + change) < abs(error) and error * (error + change) >= 0:
                tried[i], error, changed = 1 - tried[i], error + change, changed + 1
        for i in sorted(order, key=lambda i: abs(error + size[i] * (1 - 2 * tried[i])))[:1]:  # one more that brings it nearest
            change = size[i] * (1 - 2 * tried[i])
            if abs(error + change) < abs(error):
                tried[i], error, changed = 1 - tried[i], error + change, changed + 1
        if best is None or (abs(error), changed) < best[0]:
            best = ((abs(error), changed), tried)
    return best[1]


_ITEM = ["doc_id", "source", "own", "n", "size", "h", "source_size", "target", "whole", "prob"]


def mixed_items(docs: DataFrame, p: Mixing = Mixing(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", own: Column | None = None) -> DataFrame:
    """(doc_id, source, own, n, size, source_size, target, copies): how many copies the mix takes of ``n`` equal rows together.

    ``own``: hash by which rows of one id and source are told apart, that of the text if none is given.
    """
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.xxhash64(text_of(text_col)) if own is None else own).alias("own"), size.alias("size"))
    # Equal rows fly as one, so that no block has more than one of them.
    rows = cut(rows.groupBy("doc_id", "source", "own", "size").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "own", F.lit(p.seed))))
    targets = cut(source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), p))
    s = targets.select(F.col("source").alias("s"), "source_size", "n_docs", "target")
    rows = rows.join(F.broadcast(s) if targets.count() <= 10_000 else s, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n")
    whole = F.floor(rate + 1e-12)
    rows = rows.withColumn("whole", whole).withColumn("prob", F.greatest(rate - whole, F.lit(0.0)))
    # Some documents of a source, all of a small one, fly last and mend what the others leave.
    spare = F.pmod(F.xxhash64("h"), F.col("n_docs")) < p.spare
    blocks = F.ceil(F.col("n_docs") / p.block)
    rows = rows.withColumn("block", F.when(F.col("size") == 0, F.lit(-1).cast("long")).when(spare, F.lit(-2).cast("long")).otherwise(F.pmod("h", blocks)))
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in _ITEM)
    seed = p.seed

    def flown(pdf: pd.DataFrame, key: object, last: bool) -> pd.DataFrame:
        # Large documents fly first, so that small ones are left to land.
        pdf = pdf.sort_values(["size", "h", "doc_id", "prob"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["size"].astype(float).tolist()
        prob = fly(pdf["prob"].tolist(), sizes, random.Random(f"{seed}:{last}:{key}"))
        if last:
            moves = (pdf["spare"] & (pdf["prob"] > 0)).tolist()
            prob = land(prob, sizes, moves)
        return pdf[_ITEM].assign(prob=prob)

    first = cut(rows.where("block >= 0").groupBy("source", "block").applyInPandas(lambda key, pdf: flown(pdf, key, False), schema))
    open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
    late = first.where(open_).withColumn("spare", F.lit(False)).unionByName(rows.where("block = -2").select(*_ITEM).withColumn("spare", F.lit(True)))
    rest = late.groupBy("source").applyInPandas(lambda key, pdf: flown(pdf, key, True), schema)
    out = first.where(~open_).unionByName(rest).unionByName(rows.where("block = -1").select(*_ITEM).withColumn("prob", F.lit(0.0)))
    return out.select("doc_id", "source", "own", "n", "size", "source_size", "target", (F.col("whole") + F.round("prob").cast("long")).cast("long").alias("copies"))


def _each(items: DataFrame) -> DataFrame:
    """A row for each of the equal rows of an item, with its share of the copies."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    rows = items.withColumn("k", k).withColumn("copies", F.floor(F.col("copies") / F.col("n")) + (F.col("k") < F.col("copies") % F.col("n")).cast("long"))
    return rows.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("k", "n")


def mix_sources(docs: DataFrame, p: Mixing = Mixing(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and nothing is taken of them. A null source is a source of its own.
    Repeated rows are separate documents; which of several equal ones is taken makes no difference, and they share
    their copies evenly. Reruns agree: blocks, order and random draws follow from ids, texts and the seed. A source's
    taken words differ from its target by less than its smallest spare document, where those reach. Extra columns are
    not read.
    """
    return _each(mixed_items(docs, p, id_col, text_col, source_col)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mix_corpus(docs: DataFrame, p: Mixing = Mixing(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, copies and taken as further columns, as ``mix_sources`` has them.

    Further columns get underscores in front where ``docs`` has their names.
    """
    more = {c: free_name(docs, c) for c in ("size", "source_size", "target", "copies", "taken")}
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    own = free_name(docs, "own_row")
    items = cut(mixed_items(docs, p, id_col, text_col, source_col, whole))
    rows = docs.withColumn(own, whole)
    if items.where("n > 1").limit(1).count():
        rows = rows.dropDuplicates([own])
    # Rows with one hash have one id and source, so the hash alone is the key.
    names = [F.col("own").alias(own), *[F.col(c).alias(f"mix_{k}") for k, c in enumerate(more)]]
    items = _each(items).select(*names)
    return rows.join(items, own).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"mix_{k}").alias(name) for k, name in enumerate(more.values())])
