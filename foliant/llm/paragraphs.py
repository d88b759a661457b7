"""Substring dedup by MinHash banding over paragraphs.

Paragraphs are the text's lines from five words on, which is one shingle, and, up to 31 words, its blocks between blank
lines and the text as a whole. Beside them stand runs of 12 words at content-chosen starts: every 24 words in a row have
the run whose hash is smallest among their 13 runs, so equal stretches of 24 words share a run wherever they stand and
however they are wrapped. Equal paragraphs and runs need no comparison. Different paragraphs that share a band are
compared by the exact Jaccard similarity of their five-word shingles, and similar ones form components.

What is sure to be found: equal lines of five words, equal texts of any length, and every shared stretch of 24 words.
A near copy with k words replaced among n, well inside, has a similarity of 0.8 only if n is 45 k or more, and its longest
stretch in between then has n / (k + 1) words less one: from 50 words on it holds a run, so near copies are found in
passages without lines of their own, too. Shared stretches of 12 to 23 words are found where their run is chosen.
Equality is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, skewed_join, text_of
from foliant.llm.components import connected_components


@dataclass(frozen=True)
class Paragraphs:
    """Words of a run and starts to choose from, of a shingle, from which blocks and texts are left to runs, similarity, and bands.

    A pair of paragraphs of similarity 0.8 is missed by all bands with probability (1 - 0.8 ** 2) ** 6, which is 0.2 %.
    """

    words: int = 12
    starts: int = 13
    shingle: int = 5
    whole: int = 32
    similarity: float = 0.8
    bands: int = 6
    rows: int = 2
    #: paragraphs that occur twice, and bands of different lines, of which so many are broadcast at most (16 and 8 bytes each)
    broadcast_keys: int = 4_000_000
    #: different lines that a task compares in one band; more are dealt out in blocks
    block: int = 4096
    #: words that a worker takes at once
    chunk: int = 250_000


_MUL = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MUL[by % 5])
    return h ^ (h >> np.uint64(29))


def _rolled(word: np.ndarray, n: int, by: int) -> np.ndarray:
    """Hash of every n words in a row."""
    size = max(0, len(word) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(_MUL[by]) + word[k : k + size]
    return _mix(out, by + 1)


@dataclass
class Found:
    """Paragraphs of some texts: row of the text, hash of the words, first word and number of words.

    The first len(bands) are lines and short texts with their band keys and their stretch of ``shingles``; runs follow.
    """

    row: np.ndarray
    content: np.ndarray
    place: np.ndarray
    size: np.ndarray
    bands: np.ndarray
    stretch: np.ndarray
    shingles: np.ndarray

    def shingle_set(self, i: int) -> bytes:
        return np.unique(self.shingles[self.stretch[i, 0] : self.stretch[i, 1]]).tobytes()


def _chosen(run: np.ndarray, start: np.ndarray, n_words: np.ndarray, p: Paragraphs) -> np.ndarray:
    """Places of chosen runs: the smallest of every ``p.starts`` runs in a row, and of all runs of a text that has fewer.

    ``run`` has a hash for every word; a text's words begin at ``start``. Texts stand apart by ``p.starts`` places that
    hold no run, so that no choice spans two texts.
    """
    has = n_words >= p.words
    start, n_runs = start[has], n_words[has] - p.words + 1
    if not len(start):
        return np.zeros(0, np.int64)
    wide = n_runs + p.starts
    base = np.cumsum(wide) - wide
    inside = np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    at, word = np.repeat(base, n_runs) + inside, np.repeat(start, n_runs) + inside
    # The place stands in the low bits, so that the smallest value names the leftmost of the smallest hashes.
    bits = max(1, int(wide.sum()).bit_length())
    low = np.full(wide.sum(), np.iinfo(np.uint64).max)
    low[at] = (_mix(run[word], 3) >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    owner = np.full(len(low), -1)
    owner[at] = word
    size = 1
    while 2 * size <= p.starts:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (p.starts - size)], low[p.starts - size :])
    windows = np.maximum(n_runs - p.starts, 0) + 1
    first = np.repeat(base, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return owner[np.unique(low[first] & np.uint64((1 << bits) - 1)).astype(np.int64)]


def paragraphs_of(texts: list[bytes], p: Paragraphs) -> Found:
    """The different paragraphs of each text."""
    words: list[bytes] = []
    spans, ends = [], []
    for t in texts:
        begin = block = len(words)
        own = set()
        for line in t.lower().split(b"\n"):
            at = len(words)
            words += line.split()
            if len(words) > at:
                own.add((at, len(words)))
            else:
                if at - block < p.whole:
                    own.add((block, at))
                block = at
        if len(words) - block < p.whole:
            own.add((block, len(words)))
        own = {x for x in own if x[1] - x[0] >= p.shingle}
        if 0 < len(words) - begin < p.whole:
            own.add((begin, len(words)))
        spans += [(len(ends), *x) for x in sorted(own)]
        ends.append(len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    end = np.array(ends, np.int64)
    start = np.concatenate([[0], end[:-1]])
    row, a, b = np.array(spans, np.int64).reshape(-1, 3).T.copy()
    view = memoryview(h).cast("B") if len(h) else b""
    own = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * x : 8 * y]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
    # A paragraph of fewer words than a shingle has itself as its only one, after those of the words.
    inner = _rolled(np.append(h, np.zeros(p.shingle - 1, np.uint64)), p.shingle, 2)
    few = b - a < p.shingle
    shingles = np.concatenate([inner, own[few], np.zeros(1, np.uint64)])
    stretch = np.stack([a, b - p.shingle + 1], axis=1)
    stretch[few] = (len(inner) + np.arange(few.sum()))[:, None] + [0, 1]
    keys = np.zeros((len(a), p.bands), np.uint64)
    for k in range(p.bands if len(a) else 0):
        key = np.full(len(a), k, np.uint64)
        for j in range(k * p.rows, (k + 1) * p.rows):
            # Hashes times an odd number stand in a new order; what lies between two stretches is left out.
            low = np.minimum.reduceat(shingles * (_mix(np.array([j + 1], np.uint64), 3)[0] | np.uint64(1)), stretch.ravel())[::2]
            key = _mix(_mix(key, k) + low, j)
        keys[:, k] = key
    # A run at every word; those that leave their text are never chosen.
    run = _rolled(np.append(h, np.zeros(p.words - 1, np.uint64)), p.words, 0)
    at = _chosen(run, start, end - start, p)
    doc = np.searchsorted(end, at, side="right")
    content = _mix(run[at], 1)
    order = np.lexsort((at, content, doc))
    once = np.ones(len(order), bool)
    once[1:] = (np.diff(doc[order]) != 0) | (np.diff(content[order]) != 0)
    order = order[once]
    place = np.concatenate([a, at[order]])
    row = np.concatenate([row, doc[order]])
    return Found(row, np.concatenate([own, content[order]]).view(np.int64), place - start[row], np.concatenate([b - a, np.full(len(order), p.words)]), keys.view(np.int64), stretch, shingles)


def _chunks(column: pa.Array, p: Paragraphs) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of some rows at a time, by their bytes."""
    part, at, size = [], 0, 0
    for i, t in enumerate(column.cast(pa.large_binary()).to_pylist()):
        part.append(t)
        size += len(t)
        if size >= 6 * p.chunk:
            yield at, part
            part, at, size = [], i + 1, 0
    if part:
        yield at, part


def similar_edges(content: np.ndarray, shingles: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what pairs of exact Jaccard similarity connect, from sorted different shingles: a search over rows that are not reached yet."""
    left, edges, stack = np.arange(1, len(content)), [], [0]
    held, flat, start = left[:0], shingles[0], left[:0]
    while len(left):
        if not stack:
            stack.append(int(left[0]))
            left = left[1:]
            continue
        x = stack.pop()
        if not len(held) or 2 * len(left) < len(held):
            held = left
            size = np.array([len(shingles[i]) for i in held])
            flat, start = np.concatenate([shingles[i] for i in held]), np.cumsum(size) - size
        at = np.searchsorted(held, left)
        own = shingles[x]
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, start, dtype=np.int64)[at]
        near = both >= similarity * (size[at] + len(own) - both)
        found = left[near]
        edges += [(int(content[x]), int(content[y])) for y in found]
        stack.extend(found.tolist())
        left = left[~near]
    return edges


def _keys(rows: DataFrame, p: Paragraphs) -> DataFrame:
    """(key, doc, line) of every paragraph, with line 0, and of every band of a line, with the line's hash."""
    id_type = dict(rows.dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column(1), p):
                f = paragraphs_of(texts, p)
                n = len(f.bands)
                key = np.concatenate([f.content, f.bands.ravel()])
                line = np.concatenate([np.zeros(len(f.content), np.int64), np.repeat(f.content[:n], p.bands)])
                doc = batch.column(0).take(pa.array(at + np.concatenate([f.row, np.repeat(f.row[:n], p.bands)])))
                yield pa.RecordBatch.from_arrays([pa.array(key), doc, pa.array(line)], names=["key", "doc", "line"])

    return rows.select("doc", "text").mapInArrow(run, f"key long, doc {id_type}, line long")


def _edges(kinds: DataFrame, p: Paragraphs) -> DataFrame:
    """(a, b) between lines that are similar, from rows of (content, keys, shingles) of different lines."""
    rows = kinds.select(F.explode("keys").alias("key"), "content", "shingles")
    crowded = kinds.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > p.block)
    part = F.lit(0).cast("long")
    if (crowded := cut(crowded)).limit(1).count():
        # The lines of a crowded band go to blocks by content; each pair of blocks is compared on its own.
        rows = rows.join(crowded, "key", "left").withColumn("g", F.coalesce(F.ceil(F.col("count") / p.block), F.lit(1)).cast("int"))
        rows = rows.withColumn("c", F.pmod("content", F.col("g")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        part = F.least("c", "j").cast("long") * F.lit(1 << 31) + F.greatest("c", "j")
    rows = rows.select("key", part.alias("part"), "content", "shingles").repartition("key", "part").sortWithinPartitions("key", "part")
    similarity = p.similarity

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def edges() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            return similar_edges(np.array([r[2] for r in group], np.int64), [np.frombuffer(r[3], np.uint64) for r in group], similarity)

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in map(list, zip(*out))], names=["a", "b"])

        out: list[tuple[int, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][:2] != row[:2]:
                    out += edges()
                    group.clear()
                group.append(row)
            if out:
                yield batch(out)
                out = []
        if out := edges():
            yield batch(out)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _wanted(again: DataFrame, p: Paragraphs):
    """(paragraphs, their first documents, bands) as arrays to be broadcast, or None where there are too many."""
    if again.limit(p.broadcast_keys + 1).count() > p.broadcast_keys:
        return None
    t = again.where("first IS NOT NULL").select("key", "first").orderBy("key").toArrow()
    bands = np.sort(again.where("first IS NULL").select("key").toArrow().column("key").to_numpy())
    return t.column("key").to_numpy(), t.column("first").combine_chunks(), bands


def _in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys are in the sorted table, their places)."""
    if not len(table):
        return np.zeros(keys.shape, bool), np.zeros(keys.shape, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


_ROW = ("doc", "label", "content", "place", "size", "keys", "shingles")


def _placed(rows: DataFrame, again: DataFrame, p: Paragraphs) -> DataFrame:
    """Paragraphs that occur in several documents or share a band with a different line.

    Columns as in _ROW: label is the first document of equal paragraphs; keys and shingles are there for lines in shared
    bands, the shingles once per task.
    """
    id_type = dict(rows.dtypes)["doc"]
    schema = f"doc {id_type}, label {id_type}, content long, place int, size int, keys array<long>, shingles binary"
    wanted = _wanted(again, p)
    few = wanted is not None
    table = rows.sparkSession.sparkContext.broadcast(wanted)

    def emit(docs: pa.Array, labels: pa.Array, f: Found, which: np.ndarray, hit: np.ndarray | None, told: set) -> pa.RecordBatch:
        """Rows of the paragraphs ``which``; ``hit``: their bands that are shared."""
        keys, shingles = [], []
        for i in which.tolist():
            shared = f.bands[i][hit[i]] if i < len(f.bands) else ()
            keys.append(list(shared) if len(shared) else None)
            c = int(f.content[i])
            shingles.append(f.shingle_set(i) if len(shared) and c not in told else None)
            if len(shared):
                told.add(c)
        if len(told) > 1_000_000:
            told.clear()
        columns = [docs, labels, pa.array(f.content[which]), pa.array(f.place[which].astype(np.int32)), pa.array(f.size[which].astype(np.int32)), pa.array(keys, pa.list_(pa.int64())), pa.array(shingles, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=list(_ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, first, bands = table.value
        told: set = set()
        for batch in batches:
            for at, texts in _chunks(batch.column(1), p):
                f = paragraphs_of(texts, p)
                known, label = _in(content, f.content)
                hit, _ = _in(bands, f.bands)
                some = known.copy()
                some[: len(hit)] |= hit.any(axis=1)
                which = np.flatnonzero(some)
                label = pa.array(label[which], mask=~known[which])
                yield emit(batch.column(0).take(pa.array(at + f.row[which])), first.take(label), f, which, hit, told)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column(1), p):
                f = paragraphs_of(texts, p)
                docs = batch.column(0).take(pa.array(at + f.row))
                yield emit(docs, pa.nulls(len(docs), docs.type), f, np.arange(len(docs)), np.ones(f.bands.shape, bool), set())

    if few:
        return rows.select("doc", "text").mapInArrow(run, schema)
    # Too many for a broadcast: all paragraphs meet the table by shuffles, and lines keep the bands that are shared.
    found = rows.select("doc", "text").mapInArrow(every, schema)
    firsts = again.where("first IS NOT NULL").select(F.col("key").alias("content"), "first")
    bands = again.where("first IS NULL").select(F.col("key").alias("band"))
    lines = found.select("content", F.explode("keys").alias("band")).distinct().join(bands, "band", "left_semi")
    lines = lines.groupBy("content").agg(F.collect_list("band").alias("shared"))
    found = found.join(firsts, "content", "left").join(lines, "content", "left").where("first IS NOT NULL OR shared IS NOT NULL")
    return found.select("doc", F.col("first").alias("label"), "content", "place", "size", F.col("shared").alias("keys"), F.when(F.col("shared").isNotNull(), F.col("shingles")).alias("shingles"))


def repeated_paragraphs(docs: DataFrame, p: Paragraphs = Paragraphs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, n_paragraphs, n_words, first_words, removed) for documents that share paragraphs with others.

    component_id is the smallest doc_id that has a paragraph of the component; that document keeps it, others lose it
    (removed). n_words counts the words that its paragraphs cover together, first_words says where they start, in
    words. Texts are taken whole; null and empty ones have no paragraph. Rows of one id are one document, whose
    repeats within itself are not reported; rows without an id are one document, too, and never give a component its
    name. Ties go to the smallest id. Extra columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    several = (F.col("first") < F.col("last")) | (F.col("unnamed") & F.col("first").isNotNull())
    keys = _keys(rows, p).groupBy("key").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("unnamed"), F.min("line").alias("low"), F.max("line").alias("high"),
    )
    line = F.col("low") != F.col("high")
    again = cut(keys.where(line | ((F.col("low") == 0) & several)).select("key", F.when(~line, F.col("first")).alias("first")))
    found = cut(_placed(rows, again, p))
    lines = found.where("keys IS NOT NULL")
    kinds = lines.groupBy("content").agg(F.max("keys").alias("keys"), F.max("shingles").alias("shingles"))
    near = cut(connected_components(_edges(kinds, p)))
    # The first document of a component, from all rows of its lines.
    owners = lines.select("doc", "content").join(near, F.col("content") == F.col("node")).groupBy("component").agg(F.min("doc").alias("label"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("unnamed"))
    owners = owners.where((F.col("label") < F.col("last")) | (F.col("unnamed") & F.col("label").isNotNull()))
    labels = near.join(owners.select("component", F.col("label").alias("whole")), "component").select(F.col("node").alias("content"), "whole")
    lines = skewed_join(lines.select("doc", "label", "content", "place", "size"), labels, "content", "left")
    lines = lines.select("doc", F.coalesce("whole", "label").alias("label"), "place", "size")
    placed = found.where("keys IS NULL").select("doc", "label", "place", "size").unionByName(lines).where("label IS NOT NULL")
    out = placed.groupBy("doc", "label").agg(F.array_sort(F.collect_set(F.struct("place", "size"))).alias("at"))
    covered = F.expr("aggregate(at, struct(0 AS n, 0 AS e), (a, x) -> struct(a.n + greatest(x.place + x.size - greatest(a.e, x.place), 0) AS n, greatest(a.e, x.place + x.size) AS e), a -> a.n)")
    first_words = F.array_distinct("at.place")
    return out.select(
        F.col("doc").alias("doc_id"), F.col("label").alias("component_id"), F.size(first_words).cast("long").alias("n_paragraphs"), covered.cast("long").alias("n_words"), first_words.alias("first_words"),
        (~F.col("doc").eqNullSafe(F.col("label"))).alias("removed"),
    )
