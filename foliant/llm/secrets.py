"""Secret scans: fixed patterns, and strings that compress badly against their surroundings.

The novelty of a candidate is what it adds to the size of its surrounding text under zstandard, which is primed with a
dictionary: words of code and configuration, and the parts of identifiers that stand near sensitive words in all
documents of the corpus, by the number of documents that have them. A string near a sensitive word that adds nearly its
own length is not made of known words and is reported. Candidates have eight characters or more, a letter, and a digit
or capitals inside; whatever consists of lower-case letters alone is taken for a word. The spans of the fixed patterns
are measured alike, and stay whatever they measure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import cut, free_name, most_frequent, text_of

# The base patterns, in the order in which kinds are listed.
BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
KINDS = (*BASE, "novel")
_KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_SENSITIVE = re.compile(r"passw|pwd|secret|token|api[_-]?key|credential|private|auth|bearer|access[_-]?key|signature", re.I | re.A)
# From the length on that the base rule asks of a value.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_INSIDE = re.compile(r"[A-Za-z0-9+/_=-]+")
# Words of code, configuration and identifiers that prime the dictionary.
PRIMER = (
    "password passwd secret token api_key apikey access_key client_secret private public key credential credentials authorization bearer "
    "username user admin root login session cookie header request response config settings environment export import include require return "
    "function class const static void string integer boolean value name default none null true false self this new delete update insert select "
    "from where table database connection host port server client service endpoint url https http www com org net path file folder directory "
    "read write open close print format length index array object list dict map set get put post data json yaml xml html text content type "
    "license licensed under version apache general copyright rights reserved release created modified date time zone example test sample "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ the and for with that this are was not you have"
)


@dataclass(frozen=True)
class SecretScan:
    """What counts as novel: characters around a candidate that it is measured against, and its size added per character.

    Candidates are looked for within twice ``around`` of a sensitive word. The dictionary takes parts of identifiers that
    ``min_docs`` documents have near such a word, the most frequent first, up to ``words``.
    """

    around: int = 64
    min_added: float = 0.72
    words: int = 4096
    min_docs: int = 3


_COMPRESSORS: dict = {}


def _packed(data: bytes, words: str) -> int:
    import zstandard

    if words not in _COMPRESSORS:
        _COMPRESSORS.clear()
        known = zstandard.ZstdCompressionDict((words + " " + PRIMER).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # The fast strategy leaves literals as they are, so that a size counts what no match covers, to the byte.
        how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=4, hash_log=17, chain_log=16, window_log=17, search_log=1, write_content_size=False)
        _COMPRESSORS[words] = zstandard.ZstdCompressor(compression_params=how, dict_data=known)
    return len(_COMPRESSORS[words].compress(data))


def added_bytes(before: str, candidate: str, after: str, words: str = "") -> int:
    """Marginal compressed size of a candidate between its surroundings, with ``words`` beside the fixed ones in the dictionary."""
    return _packed((before + candidate + after).encode(), words) - _packed((before + after).encode(), words)


#: Parts of identifiers: a random string falls into pieces that are shorter.
_PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")


def context_words(docs: DataFrame, p: SecretScan = SecretScan(), text_col: str = "text") -> str:
    """The parts of identifiers near sensitive words of all documents, the most frequent last, where a match is cheapest.

    Counts are exact: a task hands on what it has counted whenever that grows large, and sums are taken over all tasks.
    """
    reach, most = 2 * p.around, p.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                near = [text[max(0, m.start() - reach) : m.end() + reach] for m in _SENSITIVE.finditer(text)]
                if near:
                    seen.update({w for t in near for w in _PART.findall(t)})
                    if len(seen) > 50 * most:
                        yield counted()
                        seen.clear()
        yield counted()

    found = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return " ".join(r.word for r in most_frequent(cut(found.where(F.col("n") >= p.min_docs)), most)[::-1])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = []
    if _KEYWORDS.search(text):
        found += [(m.start(), m.end(), "assign") for m in BASE["assign"].finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in BASE["access"].finditer(text)]
    # A cheap test for a long run first: most texts have none.
    if b"0" * 32 in text.encode().translate(_HEX):
        found += [(m.start(), m.end(), "hex") for m in BASE["hex"].finditer(text)]
    return sorted(found, key=_order)


_HEX = bytes(48 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def _candidate(c: str) -> bool:
    """Whether a string is shaped like more than a word: a letter with a digit, or capitals behind lower-case letters."""
    return bool(re.search(r"[A-Za-z]", c) and re.search(r"\d|[a-z].*[A-Z]", c))


def novelty(text: str, a: int, b: int, p: SecretScan = SecretScan(), words: str = "") -> float:
    """Compressed bytes that text[a:b] adds to its surroundings, per character."""
    return added_bytes(text[max(0, a - p.around) : a], text[a:b], text[b : b + p.around], words) / (b - a)


def novel_spans(text: str, taken: list[tuple[int, int, str]], p: SecretScan = SecretScan(), words: str = "") -> list[tuple[int, int, str]]:
    """Novel candidates before or after a sensitive word that no other span overlaps."""
    found, last = [], 0
    for s in _SENSITIVE.finditer(text):
        first = max(0, s.start() - 2 * p.around)
        while first > last and _INSIDE.match(text, first - 1):  # whole, where the search starts inside it
            first -= 1
        for m in _CANDIDATE.finditer(text, max(first, last), min(len(text), s.end() + 2 * p.around)):
            a, b = m.span()
            b = _INSIDE.match(text, a).end()  # whole, where the search ended inside it
            if a < last:
                continue
            last = b
            if not any(x < b and a < y for x, y, _ in taken) and _candidate(text[a:b]) and novelty(text, a, b, p, words) >= p.min_added:
                found.append((a, b, "novel"))
    return found


def scan_secrets(docs: DataFrame, p: SecretScan = SecretScan(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one more column ``secrets``: array of (start, end, kind, novelty), in code points, end exclusive.

    Texts are scanned whole; null and empty texts have no spans. Spans stand by start, then kind as listed; novelty is
    the compressed size that a span adds, per character. Repeated rows get equal spans. Where ``docs`` has a column
    ``secrets``, the new one has underscores in front. No state but the dictionary: a lost task is simply run again.
    """
    name = free_name(docs, "secrets")
    words = docs.sparkSession.sparkContext.broadcast(context_words(docs, p, text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("novelty", pa.float64())]))
        for batch in batches:
            spans = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                base = base_spans(text)
                more = novel_spans(text, base, p, known) if _SENSITIVE.search(text) else []
                spans.append([{"start": a, "end": b, "kind": k, "novelty": novelty(text, a, b, p, known)} for a, b, k in sorted(base + more, key=_order)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], names=[*batch.schema.names[:-1], name])

    t = free_name(docs, "scan_text")
    rows = docs.withColumn(t, text_of(text_col))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("novelty", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(span))])
    return rows.mapInArrow(scan, schema)


def mask_secrets(docs: DataFrame, p: SecretScan = SecretScan(), text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``, overlapping spans together; a null text stays null."""
    name = free_name(docs, "secrets")
    found = scan_secrets(docs, p, text_col)
    # Pieces between the spans: each starts at the furthest end so far.
    pieces = F.expr(f"""aggregate(`{name}`, struct(0 AS e, CAST('' AS STRING) AS s),
        (a, x) -> struct(greatest(a.e, x.end) AS e,
                         CASE WHEN x.start >= a.e THEN concat(a.s, substr(`{text_col}`, a.e + 1, x.start - a.e), '{mark}') ELSE a.s END AS s),
        a -> concat(a.s, substr(`{text_col}`, a.e + 1)))""")
    clean = F.when(F.size(name) > 0, pieces).otherwise(F.col(text_col))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
