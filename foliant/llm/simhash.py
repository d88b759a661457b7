"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits that differ in 4 bits or fewer differ in 2 or fewer in one half. In each half the
anchors are the words of a covering code: Hamming's (31, 26) code beside one free bit, whose covering radius
is 1. Two halves at distance 2 have a point between them at distance 1 from both, and an anchor within 1 of
that point; so each fingerprint is replicated to every anchor within 1 + 1 of its halves (17 of 2**27), and
each linked pair meets at one of them. Per anchor, fingerprints are compared without listing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, free_name, skewed_join, text_of, with_key
from foliant.llm.components import connected_components


@dataclass(frozen=True)
class SimHash:
    """Words of a shingle, seed of its hash, bits that linked fingerprints differ in at most."""

    words: int = 4
    seed: int = 42
    bits: int = 4
    #: fingerprints that are compared at an anchor in one task; larger groups are dealt out in blocks
    block: int = 8192
    #: so many crowded anchors at most are broadcast
    broadcast_anchors: int = 100_000


def fingerprint(text: str, p: SimHash = SimHash()) -> int:
    """The fingerprint of a text: each bit is 1 if over half of its shingles' hashes have it; without words zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - p.words + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, p.seed)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        cuts = map(slice, starts[:n].tolist(), ends[p.words - 1 :].tolist())
        hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(p.seed))
    h = np.fromiter(hashes, np.uint64, max(n, 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """(doc_id, text_hash, fp) for rows of (doc_id, text, text_hash); fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, p) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


# Hamming's code of 31 bits: a word's syndrome is the exclusive or of the places of its ones.
_PARITY = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)], np.uint32)
_PAIRS = np.zeros((32, 15), np.uint32)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < i ^ _s and i != _s]
_FREE = np.uint32(1 << 31)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all anchors within 2 of each 32-bit half."""
    code = half & np.uint32((1 << 31) - 1)
    syndrome = np.zeros(len(half), np.int64)
    for k in range(5):
        syndrome |= (np.bitwise_count(code & _PARITY[k]).astype(np.int64) & 1) << k
    on, off = np.flatnonzero(syndrome == 0), np.flatnonzero(syndrome)
    s, x = syndrome[off], half[off]
    near = x ^ np.left_shift(np.uint32(1), (s - 1).astype(np.uint32))
    rows = [on, on, off, off, np.repeat(off, 15)]
    at = [half[on], half[on] ^ _FREE, near, near ^ _FREE, (x[:, None] ^ _PAIRS[s]).ravel()]
    return np.concatenate(rows), np.concatenate(at)


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what threshold links connect: a search that compares each row with those not reached yet."""
    left, edges = fp[1:], []
    stack = [fp[0]]
    while len(left):
        if not stack:
            stack.append(left[0])
            left = left[1:]
            continue
        x = stack.pop()
        near = np.bitwise_count(left ^ x) <= bits
        if near.any():
            found = left[near]
            edges += [(x, y) for y in found]
            stack.extend(found)
            left = left[~near]
    return edges


def _compare(keys: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: neighbours in small runs at once, a forest in larger ones."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(new, len(keys)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat(size, size) <= 6
    for lag in range(1, 6):
        i = np.flatnonzero((keys[:-lag] == keys[lag:]) & small[:-lag]) if len(keys) > lag else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= bits]
        a.append(fp[i])
        b.append(fp[i + lag])
    for at, n in zip(new[size > 6].tolist(), size[size > 6].tolist()):
        edges = _forest(np.unique(fp[at : at + n]), bits)
        if edges:
            e = np.array(edges, np.uint64)
            a.append(e[:, 0])
            b.append(e[:, 1])
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose closure is that of all links."""
    if not 0 <= p.bits <= 4:
        raise ValueError("two halves and anchors within 2 cover thresholds up to 4")
    bits = p.bits

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):  # 33 rows for each
                x = whole.column(0).slice(at, 20_000).to_numpy().view(np.uint64)
                for k, half in enumerate((x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32))):
                    row, anchor = anchors(half)
                    key = (anchor.astype(np.int64) << 1) | k
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[row].view(np.int64))], names=["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros((0, 3), np.int64)]
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            if not len(rows):
                continue
            last = np.all(rows[:, :2] == rows[-1, :2], axis=1)
            if last.all() and len(rest[-1]) and np.array_equal(rest[-1][-1, :2], rows[-1, :2]):
                rest.append(rows)
                continue
            done = np.concatenate([*rest, rows[~last]])
            same = np.all(done[:, :2] == rows[-1, :2], axis=1)
            rest = [done[same], rows[last]]
            yield from _edges(done[~same])
        yield from _edges(np.concatenate(rest))

    def _edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            key = np.cumsum(np.concatenate([[0], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)]))
            a, b = _compare(key, np.ascontiguousarray(rows[:, 2]).view(np.uint64), bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rows = fps.select("fp").mapInArrow(replicate, "key long, fp long")
    crowded = cut(rows.groupBy("key").count().where(F.col("count") > p.block))
    n = crowded.limit(p.broadcast_anchors + 1).count()
    part = F.lit(0).cast("long")
    if n:
        # A crowded anchor's rows go to blocks by hash; each pair of blocks is compared by a task of its own.
        side = F.broadcast(crowded) if n <= p.broadcast_anchors else crowded
        rows = rows.join(side, "key", "left").withColumn("g", F.coalesce(F.ceil(F.col("count") / p.block), F.lit(1)).cast("int"))
        rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        part = F.least("c", "j").cast("long") * F.lit(1 << 31) + F.greatest("c", "j")
    rows = rows.select("key", part.alias("part"), "fp").repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id (smallest doc_id reachable, itself included).

    Equal fingerprints are merged before anything is compared, so groups of exact copies cost one row.
    Null and empty texts have fingerprint zero, which links like any other. A text of fewer words than a shingle
    is one shingle. Repeated rows share a component; a null doc_id is never the smallest. Extra columns are not read.
    """
    own = cut(fingerprints(with_key(docs, id_col, text_col), p))
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = connected_components(links(classes, p))
    roots = cut(classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root")))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    # One root may hold most fingerprints, and one fingerprint most rows.
    by_fp = cut(skewed_join(roots.select("fp", "root"), lows, "root").select("fp", "component_id"))
    return skewed_join(own, by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, p: SimHash = SimHash()) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest doc_id, one of several equal rows."""
    found = cut(near_duplicates(docs, p))
    keys = found.groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    pick = keys.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("k"))
    pick = cut(pick.select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"), "k.n"))
    h = free_name(docs, "own_hash")
    out = docs.withColumn(h, F.xxhash64(text_of("text")))

    def kept(side: DataFrame) -> DataFrame:
        return out.join(side, out["doc_id"].eqNullSafe(side["keep_id"]) & (out[h] == side["keep_hash"]), "left_semi")

    return kept(pick.where("n = 1")).unionByName(kept(pick.where("n > 1")).dropDuplicates(["doc_id", h])).drop(h)
