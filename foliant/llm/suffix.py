"""Removal of repeated byte strings with an enhanced suffix array, sampled at anchors.

Every window of ``length`` bytes is assigned to the place of its smallest k-gram hash, its anchor. Equal windows
have equal anchors at equal places, so a string of ``length`` bytes that starts twice shows among the suffixes that
start at equal anchors, and anchors without an equal drop out by their hashes alone: a first pass counts them, and a
second one takes only those that occur twice. What stands around an anchor
is cut to the windows assigned to it (its span). Equal spans are settled by their hashes. The others' suffixes are
sorted: common prefixes of neighbours give the interval tree, which a stack scan walks from the inside out. Each
interval is tested for left extensions: its members stand in the order of what precedes them, so that neighbours
in that order are the maximal repeats of the interval, and their content ties all occurrences together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, with_key
from foliant.llm.minima import leftmost_minima


@dataclass(frozen=True)
class Repeats:
    """Bytes that a repeat has at least, and bytes of the k-grams that anchors are chosen by (a power of two)."""

    length: int = 400
    gram: int = 64
    #: bytes of shorter repeats, whose bytes are counted and stay; as many as ``length`` for none
    shorter: int = 256
    #: anchors that occur twice of which so many are broadcast at most, 8 bytes each; beyond them all are dealt out
    broadcast_anchors: int = 4_000_000
    #: different spans at one anchor that a task sorts; where there are more, windows are compared by hash
    crowd: int = 20_000
    #: keys of documents with places to look at that are broadcast at most, 8 bytes each, so that other texts stay where they are
    broadcast_places: int = 1_000_000


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every k-gram, by doubling: a gram's hash from those of its halves."""
    mask, base, n = (1 << 64) - 1, 0x9E3779B97F4A7C15, 1
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    while n < gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base & mask, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors_of(h: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, end) of the anchors of a text of ``n`` bytes with gram hashes ``h``: [first, end) is the union of the windows assigned to each."""
    place, first = leftmost_minima(h, length - gram + 1)
    return place, first, np.append(first[1:] - 1, n - length)[: len(place)] + length


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, as lists of Python objects take many times a batch's room."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            yield b.slice(at, 500)


def _twice(docs: DataFrame, p: Repeats) -> DataFrame:
    """(anchor) of those that occur at several places. Anchors of long windows are anchors of shorter ones, too."""
    least = min(p.length, p.shorter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b.column(0).cast(pa.large_binary()).to_pylist():
                if len(text) >= least:
                    h = gram_hashes(np.frombuffer(text, np.uint8), p.gram)
                    found.append(h[leftmost_minima(h, least - p.gram + 1)[0]])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])

    found = docs.select("text").mapInArrow(run, "anchor long")
    return cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))


def _occurrences(docs: DataFrame, p: Repeats) -> DataFrame:
    """(anchor, span, length, doc_id, text_hash, place, left, right) of every anchor that occurs twice, for windows of each length.

    span hashes what the windows hold and the anchor's place in it; left and right say how far they reach.
    """
    twice = _twice(docs, p)
    few = twice.limit(p.broadcast_anchors + 1).count() <= p.broadcast_anchors
    table = docs.sparkSession.sparkContext.broadcast(np.sort(twice.toArrow().column("anchor").to_numpy()) if few else None)
    lengths = sorted({p.length, p.shorter}, reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for b in _slices(batches):
            parts, span = [], []
            for i, text in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
                if len(text) < lengths[-1]:
                    continue
                h = gram_hashes(np.frombuffer(text, np.uint8), p.gram)
                for length in lengths:
                    place, first, end = anchors_of(h, len(text), length, p.gram)
                    anchor = h[place].view(np.int64)
                    if known is not None and len(known):
                        on = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
                        place, first, end, anchor = place[on], first[on], end[on], anchor[on]
                    elif known is not None:
                        continue
                    if len(place):
                        parts.append((anchor, np.full(len(place), length, np.int32), place, place - first, end - place, np.full(len(place), i)))
                        view = memoryview(text)
                        span += [xxhash.xxh3_64_intdigest(view[f:e], c - f) for c, f, e in zip(place.tolist(), first.tolist(), end.tolist())]
            if parts:
                anchor, length, place, left, right, at = (np.concatenate(c) for c in zip(*parts))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.array(span, np.uint64).view(np.int64)), pa.array(length), b.column(0).take(at), b.column(2).take(at), *[pa.array(c.astype(np.int32)) for c in (place, left, right)]],
                    names=["anchor", "span", "length", "doc_id", "text_hash", "place", "left", "right"],
                )

    found = docs.select("doc_id", "text", "text_hash").mapInArrow(run, f"anchor long, span long, length int, doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, place int, left int, right int")
    if not few:
        found = found.join(twice, "anchor", "left_semi")
    # The length goes with the anchor, and the three places into one number, as rows are many.
    where = F.shiftleft(F.col("place").cast("long"), 32) + F.shiftleft(F.col("left").cast("long"), 16) + F.col("right")
    return found.select(F.col("anchor").bitwiseXOR(F.col("length").cast("long")).alias("anchor"), "span", "doc_id", "text_hash", "length", where.alias("where"))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def maximal_repeats(contexts: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, left, right): rows that agree on so many bytes before and after their anchors, together ``length`` or more.

    ``contexts`` are (left context reversed, right context). Each interval of the sorted right contexts is met when
    it closes, as the join of two smaller ones at its common prefix; rows of the smaller one are put among those of
    the larger in the order of their left contexts. A pair that is not next to each other there lies between pairs
    that agree on more to both sides, so neighbours are all that is needed; a row moves a logarithmic number of times.
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    stack: list[tuple[int, list[tuple[bytes, int]]]] = []  # (common prefix with the interval below, members in left order)

    def close() -> Iterator[tuple[int, int, int, int]]:
        depth, upper = stack.pop()
        below, lower = stack.pop()
        small, large = sorted((upper, lower), key=len)
        for x in small:
            k = bisect_left(large, x)
            for y in large[max(0, k - 1) : k + 1]:
                left = _common(x[0], y[0])
                if left + depth >= length:
                    yield x[1], y[1], left, depth
            large.insert(k, x)
        stack.append((below, large))

    for k, i in enumerate(order):
        depth = _common(contexts[order[k - 1]][1], contexts[i][1]) if k else 0
        while len(stack) > 1 and stack[-1][0] > depth:
            yield from close()
        stack.append((depth, [(contexts[i][0], i)]))
    while len(stack) > 1:
        yield from close()


def _contexts(listed: DataFrame) -> DataFrame:
    """For rows of (text, doc_id, text_hash, at): a row with both contexts per place, or one per window where a crowd is."""
    id_type = dict(listed.dtypes)["doc_id"]
    names = ["key", "length", "doc_id", "text_hash", "place", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = []
            for text, doc, own, at in zip(b.column(0).cast(pa.large_binary()).to_pylist(), *(b.column(k).to_pylist() for k in (1, 2, 3))):
                for x in at:
                    c, n = x["where"] >> 32, x["length"]
                    f, e = c - (x["where"] >> 16 & 0xFFFF), c + (x["where"] & 0xFFFF)
                    if x["crowd"]:
                        rows += [(xxhash.xxh3_64_intdigest(text[s : s + n], c - s) - (1 << 63), n, doc, own, s, None, None) for s in range(f, e - n + 1)]
                    else:
                        rows.append((x["anchor"], n, doc, own, c, text[f:c][::-1], text[c:e]))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [pa.int64(), pa.int32(), to_arrow_type(listed.schema["doc_id"].dataType), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return listed.select("text", "doc_id", "text_hash", "at").mapInArrow(run, f"key long, length int, doc_id {id_type}, text_hash long, place int, before binary, after binary")


_FOUND = ["length", "doc_id", "text_hash", "start", "end", "repeat_id"]


def _scan(contexts: DataFrame) -> DataFrame:
    """Columns _FOUND from rows that are sorted by key within their partition."""
    id_type = dict(contexts.dtypes)["doc_id"]

    def found(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) > 1:
            length = rows[0][1]
            for i, j, left, right in maximal_repeats([(r[5], r[6]) for r in rows], length):
                content = xxhash.xxh3_64_intdigest(rows[i][5][:left][::-1] + rows[i][6][:right]) - (1 << 63)
                for r in (rows[i], rows[j]):
                    yield length, r[2], r[3], r[4] - left, r[4] + right, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: set[tuple] = set()

        def batch() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=_FOUND)
            out.clear()
            return part

        def close() -> Iterator[pa.RecordBatch]:
            # A large group finds far more than it has rows.
            for x in found(group):
                out.add(x)
                if len(out) >= 20_000:
                    yield batch()
            group.clear()

        for b in _slices(batches):
            types = [pa.int32(), b.schema.field(2).type, pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][0] != row[0]:
                    yield from close()
                group.append(row)
            if out:
                yield batch()
        yield from close()
        if out:
            yield batch()

    return contexts.mapInArrow(run, f"length int, doc_id {id_type}, text_hash long, start int, end int, repeat_id long")


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _at_places(docs: DataFrame, places: DataFrame, p: Repeats, all_docs: bool) -> DataFrame:
    """(doc_id, text, text_hash, at) of rows of ``docs`` with their structs ``x`` of ``places`` (doc_id, text_hash, x).

    Only texts that have places are dealt out, by their keys, which are broadcast while they are few; ``all_docs`` keeps
    the others, too, with no list.
    """
    key = F.xxhash64("doc_id", "text_hash")
    lists = cut(places.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("x")).alias("at")))
    keyed, rest = docs, None
    if lists.limit(p.broadcast_places + 1).count() <= p.broadcast_places:
        keys = F.broadcast(lists.select(key.alias("has_places")))
        keyed = docs.join(keys, key == F.col("has_places"), "left_semi")
        rest = docs.join(keys, key == F.col("has_places"), "left_anti") if all_docs else None
    out = keyed.join(lists.hint("shuffle_merge"), _same_doc(keyed, lists), "left" if all_docs else "inner").select(keyed["doc_id"], "text", keyed["text_hash"], "at")
    return out if rest is None else out.unionByName(rest.select("doc_id", "text", "text_hash", F.lit(None).cast(lists.schema["at"].dataType).alias("at")))


def repeat_occurrences(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(length, doc_id, text_hash, start, end, repeat_id): byte spans of repeats in rows of (doc_id, text, text_hash).

    Repeats of ``p.length`` bytes or more, and on their own those of ``p.shorter``. Occurrences of one maximal string have
    one repeat_id; a string cut by the span of its anchor continues in the next.
    """
    if max(p.length, p.shorter) >= 1 << 16:
        raise ValueError("repeats are of less than 65,536 bytes")
    occ = cut(_occurrences(docs, p))
    spans = cut(occ.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "where", "length")).alias("one")))
    twice = spans.where("n > 1").select("anchor", "span")
    place, left, right = F.shiftright("where", 32), F.shiftright("where", 16).bitwiseAND(0xFFFF), F.col("where").bitwiseAND(0xFFFF)
    full = occ.join(twice, ["anchor", "span"], "left_semi").select("length", "doc_id", "text_hash", (place - left).cast("int").alias("start"), (place + right).cast("int").alias("end"), F.col("span").alias("repeat_id"))
    several = spans.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1")
    ones = spans.join(several, "anchor").select("one.doc_id", "one.text_hash", F.struct("anchor", "one.where", "one.length", (F.col("d") > p.crowd).alias("crowd")).alias("x"))
    around = cut(_contexts(_at_places(docs, ones, p, False)))
    part = _scan(around.where("after IS NOT NULL").repartition("key").sortWithinPartitions("key"))
    crowd = around.where("after IS NULL")
    again = crowd.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    windows = crowd.join(again, "key", "left_semi").select("length", "doc_id", "text_hash", F.col("place").alias("start"), (F.col("place") + F.col("length")).alias("end"), F.col("key").alias("repeat_id"))
    return full.unionByName(part).unionByName(windows)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, n_repeated, kept_sha256, kept (the remaining bytes).

    n_repeated counts the bytes of strings of ``p.shorter`` bytes that start elsewhere, too; what is not in one of
    ``p.length`` stays. Null and empty texts have no bytes, texts shorter than a repeat lose none. Texts are taken whole.
    Repeated rows are repeats of each other, and every copy goes. Extra columns are not read.
    """
    own = with_key(docs, id_col, text_col)
    spans = repeat_occurrences(own, p)
    rows = _at_places(own, spans.select("doc_id", "text_hash", F.struct("start", "end", "length").alias("x")), p, True).select("doc_id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = []
            for text, at in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist()):
                gone, seen = (_union([(x["start"], x["end"]) for x in at or () if x["length"] == n]) for n in (p.length, p.shorter))
                ends = [0, *(e for _, e in gone)]
                kept = b"".join(text[a:s] for a, (s, _) in zip(ends, [*gone, (len(text), 0)]))
                out.append((len(text), len(text) - len(kept), len(gone), sum(e - s for s, e in seen), hashlib.sha256(kept).hexdigest(), kept))
            cols = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=names)

    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256", "kept"]
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, n_repeated long, kept_sha256 string, kept binary")
