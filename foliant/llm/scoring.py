"""Scores of whole documents under the recurrent model and under word counts.

Word counts of all training documents are summed by a shuffle of per-task tables. The most frequent words form a
broadcast table of bounded size, by which every text is written once as a list of short numbers; other words of a
document are shuffled to their counts. Training deals the numbers out to groups by a hash of the document, each group
learns from common parameters, long texts first and then in the order of that hash, and the results are averaged by tokens in the order of the
groups, so that a model depends on the documents and not on the files that they stand in.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, most_frequent, with_key
from foliant.llm.gru import Gru, Layout, Params, from_vector, init, to_bytes


@dataclass(frozen=True)
class Scoring:
    """Held-out documents, the broadcast table, and how training is dealt out."""

    fold: int = 2
    folds: int = 7
    #: words in the broadcast table
    table: int = 262_144
    #: words that a task counts before it passes them on
    task_words: int = 400_000
    #: rounds of training; each takes documents of its own, so that every training document is learnt from once
    rounds: int = 2
    #: tokens of a group in a round, as long as there are no more than so many groups
    group_tokens: int = 2_000_000
    groups: int = 16_384
    #: groups that average parameters before the last one
    merge_tasks: int = 16
    layout: Layout = field(default_factory=Layout)


END = b""


class Vocabulary:
    """What a word is to the model, and its count: arrays by place in the broadcast table."""

    def __init__(self, words: list[tuple[bytes, int]], layout: Layout) -> None:
        """``words``: the most frequent ones with their counts, most frequent first."""
        self.layout = layout
        self.index = {w: i for i, (w, _) in enumerate(words)}
        count = np.array([c for _, c in words], np.int64).reshape(-1)
        head, bins = layout.head, (layout.tail_classes - 2) // 2
        rank = np.arange(len(words))
        plain = np.array([w.isascii() for w, _ in words], bool)
        # Head words fill classes in turn, so that each class has words of all frequencies; others share classes by mass.
        mass = np.cumsum(np.where(rank < head, 0, count))
        bin_ = np.minimum(mass * bins // (mass[-1] + 1 if len(mass) else 1), bins - 1)
        self.number = np.where(rank < head, rank, head + 2 * bin_ + ~plain)
        cls, slot = layout.parts(self.number)
        total = np.bincount(cls, count, layout.classes)
        # Rare words, by alphabet, are left to their counts; an unknown word of each alphabet counts as one more.
        self.rare = layout.classes - 2
        self.within = np.where(rank < head, 0.0, np.log(np.maximum(count, 1)) - np.log(np.maximum(total[cls], 1)))
        self.log_count = np.log10(count + 1.0)
        self.class_mass = total
        self.slot_count = np.zeros((layout.head_classes, layout.slots))
        self.slot_count[cls[rank < head], slot[rank < head]] = count[rank < head]
        self.type = np.uint16 if layout.inputs < 1 << 16 else np.uint32

    def encode(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(numbers, places in the table or -1, which are rare) of all words of some texts, an end after each text, and the words themselves."""
        words: list[bytes] = []
        for t in texts:
            words += t
            words.append(END)
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(at < 0)
        number = self.number[at] if len(self.number) else np.zeros(len(at), np.int64)
        number[rare] = [self.layout.head + self.rare - self.layout.head_classes + (not words[i].isascii()) for i in rare.tolist()]
        return number.astype(self.type), at, rare, words


def word_counts(train: DataFrame, p: Scoring) -> DataFrame:
    """(word, n) over all rows of (text): words in bytes with A-Z in lower case, and the end as the empty word."""
    room = p.task_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).cast(pa.large_binary()).to_pylist():
                seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > room:
                    yield flush()
        yield flush()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(rows: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, text_hash, numbers, n, known, base, within, rare, times) of every row of (doc_id, text, text_hash).

    known counts tokens in the table, base sums the logarithms of their counts and within those of their shares of their
    classes; rare and times are the other words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        log_count, within = np.append(voc.log_count, 0.0), np.append(voc.within, 0.0)
        for b in batches:
            out: list[list] = [[] for _ in types]
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            for first in range(0, len(texts), 500):
                split = [t.lower().split() for t in texts[first : first + 500]]
                size = np.array([len(w) + 1 for w in split])
                numbers, at, rare, words = voc.encode(split)
                ends = np.cumsum(size)
                starts = ends - size
                out[0] += [numbers[a:e].tobytes() for a, e in zip(starts.tolist(), ends.tolist())]
                out[1] += size.tolist()
                for k, values in enumerate((at >= 0, log_count[at], within[at])):
                    out[2 + k] += np.add.reduceat(values, starts, dtype=values.dtype if k else np.int64).tolist()
                cuts = np.searchsorted(rare, np.append(starts, ends[-1])).tolist()
                rare = rare.tolist()
                for a, e in zip(cuts, cuts[1:]):
                    seen = Counter([words[i] for i in rare[a:e]])
                    out[5].append(list(seen))
                    out[6].append(list(seen.values()))
            if texts:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, t) for c, t in zip(out, types)]], names=names)

    types = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = ["doc_id", "text_hash", "numbers", "n", "known", "base", "within", "rare", "times"]
    return rows.select("doc_id", "text", "text_hash").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, numbers binary, n long, known long, base double, within double, rare array<binary>, times array<long>"
    )


def learn(train: DataFrame, n: int, kind: type, params: Params, p: Scoring) -> Params:
    """Rounds of training on encoded rows: each group its own documents, then the mean of parameters by tokens.

    ``n``: tokens of all rows; ``kind``: the type of their numbers.
    """
    layout = p.layout
    sc = train.sparkSession.sparkContext
    groups = min(p.groups, max(1, round(n / p.rounds / p.group_tokens)))
    # Groups and the order within them follow from documents alone.
    h = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups * p.rounds).cast("long"))
    # Long texts come first, by their size, so that no lane still has one when the others have ended.
    long = F.when(F.col("n") > 1024, F.floor(F.log2("n"))).otherwise(0)
    train = train.select((h % p.rounds).cast("int").alias("round"), F.floor(h / p.rounds).cast("int").alias("g"), long.alias("long"), "text_hash", "numbers", "doc_id")
    schema = "g int, weight long, params binary"

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, weight, total = None, 0, None
        for b in batches:
            for g, w, v in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(v, np.float32).astype(np.float64) * w
                first = g if first is None else first
                weight, total = weight + w, part if total is None else total + part
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([weight], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["g", "weight", "params"])

    for k in range(p.rounds):
        now = sc.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            group = None

            def texts() -> Iterator[np.ndarray]:
                nonlocal group
                for b in batches:
                    for g, numbers in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        group = g
                        yield np.frombuffer(numbers, kind)

            model = Gru(layout, dict(now.value))
            if seen := model.train(texts()):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([to_bytes(model.p)], pa.binary())], names=["g", "weight", "params"])

        dealt = train.where(F.col("round") == k).repartitionById(groups, F.col("g")).sortWithinPartitions(F.desc("long"), "text_hash", F.col("doc_id").cast("string"))
        parts = dealt.select("g", "numbers").mapInArrow(run, schema)
        some = parts.repartitionById(p.merge_tasks, F.col("g") % p.merge_tasks).sortWithinPartitions("g").mapInArrow(mean, schema)
        row = some.repartition(1).sortWithinPartitions("g").mapInArrow(mean, schema).first()
        now.unpersist()
        if row is not None:
            params = from_vector(np.frombuffer(row.params, np.float32), params)
    return params


def score_documents(docs: DataFrame, p: Scoring = Scoring(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Held out are documents whose crc32 of the id as text has remainder ``fold``; a null id counts as empty text.
    Texts are scored whole with the state carried from window to window; null and empty texts have the end as
    their only token. Repeated rows get equal scores. Without training documents every word is unknown. Scores do not
    depend on how rows are dealt out to files. Extra columns are not read.
    """
    own = with_key(docs, id_col, text_col)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % p.folds == p.fold
    counts = cut(word_counts(own.where(~held_out), p))
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    top = most_frequent(counts, p.table)
    known = Vocabulary([(bytes(r.word), r.n) for r in top], p.layout)
    sc = docs.sparkSession.sparkContext
    # What rare words and one unknown word of either alphabet weigh together, from all counts.
    plain = ~F.decode("word", "UTF-8").rlike(r"[^\x00-\x7F]")
    cutoff = counts.agg(F.sum(F.when(plain, F.col("n") + 1)).alias("a"), F.sum(F.when(~plain, F.col("n") + 1)).alias("b")).first()
    table = [sum(r.n + 1 for r in top if bytes(r.word).isascii() == is_plain) for is_plain in (True, False)]
    weight = [(x or 0) - t + 1 for x, t in zip(cutoff, table)]
    known.class_mass[-2:] = weight
    texts = cut(encoded(own, sc.broadcast(known)))
    kind, layout, ln10 = known.type, p.layout, math.log(10)
    params = sc.broadcast(learn(texts.where(~held_out), n, kind, init(layout, known.class_mass, known.slot_count), p))
    names = ["doc_id", "text_hash", "n", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts = [], []
        for b in batches:
            kept.append(b.select([c for c in b.schema.names if c != "numbers"]))
            texts += [np.frombuffer(x, kind) for x in b.column("numbers").to_pylist()]
        # The longest first, so that the lanes end together; a partition's numbers take two bytes a token.
        order = np.argsort([-len(x) for x in texts], kind="stable") if texts else np.zeros(0, np.int64)
        logs, at = np.zeros(len(texts)), 0
        logs[order] = Gru(layout, params.value).score(texts[i] for i in order.tolist())
        for b in kept:
            score = (logs[at : at + b.num_rows] + b.column("within").to_numpy()) / ln10
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-1]], pa.array(score)], names=names)

    schema = f"doc_id {dict(own.dtypes)['doc_id']}, text_hash long, n long, known long, base double, score double"
    rows = texts.select(*names[:-1], "within", "numbers").mapInArrow(run, schema).withColumn("rows", F.lit(1).cast("long"))
    # Rare words meet their counts; the others are the table's.
    words = texts.select("doc_id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("doc_id", "text_hash", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    words = words.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c1 = F.coalesce("c", F.lit(0)) + 1
    total = F.when(F.decode("word", "UTF-8").rlike(r"[^\x00-\x7F]"), F.lit(float(weight[1]))).otherwise(F.lit(float(weight[0])))
    zero = F.lit(0).cast("long")
    words = words.select(
        "doc_id", "text_hash", zero.alias("n"), F.when(F.col("c").isNotNull(), F.col("times")).otherwise(zero).alias("known"),
        (F.col("times") * F.log10(c1)).alias("base"), (F.col("times") * F.log10(c1 / total)).alias("score"), zero.alias("rows"),
    )
    by = rows.unionByName(words).groupBy("doc_id", "text_hash").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "known", "base", "score")])
    # Rows that agree in id and text were summed together.
    by = by.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    tokens = (F.col("n") / F.col("rows")).cast("long")
    return by.select(
        "doc_id", held_out.alias("held_out"), tokens.alias("n_tokens"), (F.col("known") / F.col("rows")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") - tokens * F.lit(math.log10(n + v + 1))).alias("base_score"), (F.col("score") / F.col("rows")).alias("score"),
    )
