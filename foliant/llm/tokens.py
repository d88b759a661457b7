"""Token counts by a map-side two-tier lookup, without shuffling a single pre-token.

A first pass counts pre-tokens in every task and writes each task's most frequent ones as one block of bytes; blocks
are merged in a tree, always to blocks of the same bounded size, so that no pre-token is a row of a shuffle. The last
block gives a table with the number of tokens of each, which is broadcast. The second pass looks pre-tokens up there,
encodes what is missing with the tokenizer library and keeps it in a bounded cache per worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, text_of


@dataclass(frozen=True)
class TokenCount:
    """The tokenizer's file, the bounds of the tables, and the limit that documents are held against."""

    path: str
    limit: int = 1024
    #: pre-tokens in the broadcast table
    frequent: int = 50_000
    #: pre-tokens that a block holds, how many a task counts at once, and blocks that are merged by one task
    task_report: int = 50_000
    task_counter: int = 200_000
    fan_in: int = 32
    #: pre-tokens that a worker's cache holds
    cache: int = 300_000


# Fixed value: the pattern that byte-level BPE splits text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN)
#: Texts of these characters only are split here; any Unicode version agrees on them. Others go to the library whole.
_PLAIN = regex.compile(r"[\t\n\r -~¡-ɏΑ-Ωα-ωА-я–—‘-„•…€]*+")
#: Between a visible ASCII character and white space no pre-token goes on, whatever stands around.
_SAFE = regex.compile(r"(?<=[!-~])(?=[\t\n\r ])")
_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


class Lengths(dict):
    """Tokens by pre-token: encodes what is missing, and forgets what it learned when it holds too much."""

    def __init__(self, path: str, known: dict[str, int], bound: int) -> None:
        super().__init__(known)
        self.known, self.bound, self.encode = known, len(known) + bound, _tokenizer(path).encode
        self.special = tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())

    def __missing__(self, piece: str) -> int:
        if len(self) > self.bound:
            self.clear()
            self.update(self.known)
        n = self[piece] = len(self.encode(piece, add_special_tokens=False))
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if any(s in text for s in self.special):
            return len(self.encode(text, add_special_tokens=False))
        if _PLAIN.fullmatch(text):
            return sum(map(self.__getitem__, _SPLIT.findall(text)))
        # Parts with other characters go to the library, the rest through the table.
        return sum(sum(map(self.__getitem__, _SPLIT.findall(part))) if _PLAIN.fullmatch(part) else len(self.encode(part, add_special_tokens=False)) for part in _SAFE.split(text))


def frequent_lengths(docs: DataFrame, p: TokenCount, text_col: str = "text") -> dict[str, int]:
    """The most frequent pre-tokens with their number of tokens, ``p.frequent`` at most.

    A pre-token that a task had to drop for want of room is encoded when it is met, so counts stay exact.
    """
    report, room, fan_in = p.task_report, p.task_counter, p.fan_in

    def block(seen: Counter) -> pa.RecordBatch:
        top = seen.most_common(report)
        table = pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_SPLIT.findall(text))
                if len(seen) > room:
                    seen = Counter(dict(seen.most_common(room // 2)))
        if seen:
            yield block(seen)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for b in batch.column(0).to_pylist():
                for t in pa.ipc.open_stream(b):
                    seen.update(dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist())))
                if len(seen) > room:
                    seen = Counter(dict(seen.most_common(room // 2)))
        if seen:
            yield block(seen)

    found = cut(docs.select(text_of(text_col).alias("text")).mapInArrow(count, "block binary"))
    blocks = found.count()
    while blocks > fan_in:
        blocks = -(-blocks // fan_in)
        found = found.repartition(blocks).mapInArrow(merge, "block binary")
    last = found.repartition(1).mapInArrow(merge, "block binary").first()
    encode, known = _tokenizer(p.path).encode, []
    for t in pa.ipc.open_stream(bytes(last.block)) if last else ():
        known += zip(t.column(0).to_pylist(), t.column(1).to_pylist())
    return {w: len(encode(w, add_special_tokens=False)) for w, _ in known[: p.frequent]}


def count_tokens(docs: DataFrame, p: TokenCount, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, in one pass without a shuffle.

    Null and empty texts have no tokens. Texts are taken whole, however long; special strings inside them are
    single tokens, as the library has them by default. Repeated rows stay; extra columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, p, text_col))
    path, bound, limit = p.path, p.cache, p.limit

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, known.value, bound)
        for batch in batches:
            n = [lengths.count(t) for t in batch.column(1).to_pylist()]
            size = pa.array([len(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
