"""A held-out share of documents that covers all roles: a distributed maximum per step while roles are lacking, then the rest by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A role counts as covered with so many examples, or with all that there are.
ENOUGH = 3


def hash_number(key: Column) -> Column:
    """The first 32 bits of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")


def _largest(docs: DataFrame, n: int) -> Column:
    """A condition for the ``n`` rows of (doc_id, h) with the largest h, from counts by its bits, twelve, twelve and eight at a time; equal ones by doc_id."""
    low, left = 0, n
    for shift, bits in ((20, 12), (8, 12), (0, 8)):
        part = F.shiftright("h", shift)
        prefix = low >> (shift + bits)
        counts = docs.where(F.shiftright("h", shift + bits) == prefix).groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy(F.desc("part")).collect()
        for r in counts:
            if r["n"] >= left:
                low = r["part"] << shift
                break
            left -= r["n"]
    same = [r["doc_id"] for r in docs.where(F.col("h") == low).orderBy("doc_id").limit(left).collect()]
    return (F.col("h") > low) | ((F.col("h") == low) & F.col("doc_id").isin(same))


def stratified_split(roles: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """(doc_id, held_out) from rows (doc_id, role, n): the examples of each role in a document.

    While a role has fewer than three held-out examples (or all it has), the document is taken that adds most of such, each counted by how rare its
    role is; equal ones by their hash, the largest first. So there are some steps per role, whatever the number of documents, and the driver holds counts by
    role. The rest of the share are the documents with the largest hashes. One document alone is not held out.
    """
    every = roles.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("counts")).withColumn("h", hash_number(F.col("doc_id"))).persist()
    total = every.count()
    ratio = min(0.95, max(0.05, train_ratio))
    wanted = 0 if total <= 1 else total - min(total - 1, max(1, int(total * ratio + 0.5)))
    corpus = {r["role"]: r["n"] for r in every.select(F.explode("counts").alias("role", "n")).groupBy("role").agg(F.sum("n").alias("n")).collect()}
    held: dict[str, int] = {}
    taken: list = []
    while len(taken) < wanted:
        lacking = {r: min(ENOUGH, n) - held.get(r, 0) for r, n in sorted(corpus.items()) if held.get(r, 0) < min(ENOUGH, n)}
        if not lacking:
            break
        gain = sum((F.least(F.coalesce(F.col("counts")[r], F.lit(0)), F.lit(k)) / corpus[r] for r, k in lacking.items()), F.lit(0.0))
        rest = every.where(~F.col("doc_id").isin(taken)) if taken else every
        best = rest.agg(F.max(F.struct(F.round(gain, 12).alias("gain"), "h", (-F.col("doc_id")).alias("last"), "doc_id")).alias("b")).first()["b"]
        if best is None or best["gain"] == 0:
            break
        taken.append(best["doc_id"])
        for r in every.where(F.col("doc_id") == best["doc_id"]).select(F.explode("counts").alias("role", "n")).collect():
            held[r["role"]] = held.get(r["role"], 0) + r["n"]
    rest = every.where(~F.col("doc_id").isin(taken)) if taken else every
    more = wanted - len(taken)
    chosen = F.col("doc_id").isin(taken) if taken else F.lit(False)
    if more > 0:
        chosen = chosen | (~chosen & _largest(rest.select("doc_id", "h"), more))
    return every.select("doc_id", chosen.alias("held_out"))
