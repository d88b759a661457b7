"""WARC archives of pages: written as text tables of records, read back in splits through verified chains of records.

Writing: equal payloads are one response and revisits of it. Texts are moved only where another row may be equal.

Reading: a split's rows are what lies between places that look like a record's start, which a payload can hold, too. Tasks
emit every such candidate with its successor, the place where the record that it claims ends; where that lies in the split,
too, they follow it to the first place beyond. Pointer jumping from the start of every file then keeps the places that are
reached, so that a second pass knows where a split's first record begins and parses from there. A record that goes on in
later splits is put together from its pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from foliant.llm.common import checkpoint_dir, cut, skewed_join, text_of

#: Fixed values of the format: the start of a record, the end of a record and of a header, fields and values.
MAGIC, GAP = "WARC/1.", "\r\n\r\n"
#: What rows of an archive are parted by. No two of its characters are alike, so that no match hides another and every split finds the same.
BETWEEN = "\n" + MAGIC
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Payloads that may be equal are told by this many classes of their digests, a table of so many rows at most.
CLASSES = 1 << 20


@dataclass(frozen=True)
class Reading:
    max_rounds: int = 40  # of pointer jumping, each of which doubles the splits that a file may have
    max_splits: int = 4_000_000
    payloads: bool = True  # false: the column payload is null


def sha1_base32(data: Column) -> Column:
    """The SHA-1 digest in base32: each 5 hexadecimal digits are 4 digits of base32."""
    hexa = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str, name: Column, url: Column, digest: Column, size: Column, refers: Column | None, html: Column | None) -> Column:
    """A record without the gap after it; a revisit has the HTTP header only."""
    http = F.concat(F.lit(HTTP), size.cast("string"), F.lit(GAP))
    block = F.concat(http, html) if html is not None else http
    fields = [
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", name), ("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.replace(F.replace(F.coalesce(url.cast("string"), F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), *([("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers)] if refers is not None else []),
        ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.lit(MAGIC + "1\r\n"), *[F.concat(F.lit(f"{field}: "), value, F.lit("\r\n")) for field, value in fields], F.lit("\r\n"), block).alias("value")


def _name(page_id: Column, url: Column, key: Column, copy: Column) -> Column:
    """A record's name: its page and what else tells rows of one page apart."""
    rest = F.md5(F.to_json(F.struct(url.alias("u"), key.alias("k"))))
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), rest, F.lit(":"), copy.cast("string"), F.lit(">"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per row of ``pages`` to ``folder``, uncompressed archives in a store that Spark sees.

    Null payloads are empty. Of rows with equal payloads that with the smallest id (nulls last, then by URL) is a response, all
    others are revisits of it, repeated rows included. An empty table gives an empty folder. Other columns are not read.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    own = own.withColumn("key", F.sha2("html", 256))
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    ids = own.select("page_id", "url", "key", sha1_base32(F.col("html")).alias("digest"), F.octet_length("html").alias("size"))
    distinct = cut(ids.groupBy("page_id", "url", "key", "digest", "size").agg(F.count("*").alias("n")))
    several = cut(distinct.groupBy("key").agg(F.min(first).alias("low"), F.sum("n").alias("rows")).where("rows > 1").select("key", "low"))
    # Only texts whose digest is in the class of a repeated one are dealt out; one of each key is left before they move.
    of_class = F.pmod(F.xxhash64("key"), F.lit(CLASSES))
    classes = F.broadcast(several.select(of_class.alias("class")).distinct())
    moved = own.withColumn("class", of_class).join(classes, "class", "left_semi").groupBy("key").agg(F.min(first).alias("low"), F.first("html").alias("html"))
    lone = own.withColumn("class", of_class).join(classes, "class", "left_anti").select("page_id", "url", "key", "html")
    zero, html = F.lit(0), F.col("html")
    name = _name(F.col("page_id"), F.col("url"), F.col("key"), zero)
    responses = lone.unionByName(moved.select("low.page_id", "low.url", "key", "html")).select(_record("response", name, F.col("url"), sha1_base32(html), F.octet_length(html), None, html))
    again = skewed_join(distinct, several, "key")
    is_low = F.col("low").eqNullSafe(first)
    again = again.withColumn("from", is_low.cast("long")).where(F.col("n") > F.col("from")).withColumn("copy", F.explode(F.sequence(F.col("from"), F.col("n") - 1)))
    name = _name(F.col("page_id"), F.col("url"), F.col("key"), F.col("copy"))
    target = _name(F.col("low.page_id"), F.col("low.url"), F.col("key"), zero)
    revisits = again.select(_record("revisit", name, F.col("url"), F.col("digest"), F.col("size"), target, None))
    responses.unionByName(revisits).write.mode("overwrite").option("lineSep", GAP).text(folder)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, size, value): what lies between places that look like a record's start, in order within a split."""
    at = F.col("_metadata")
    return spark.read.option("lineSep", BETWEEN).text(folder).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), at["file_size"].alias("size"), "value")


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*$", re.I | re.M)


def _claimed(head: bytes) -> int | None:
    """Bytes from the end of ``head`` (magic cut off) to the next record, if this is the header of a record."""
    found = _LENGTH.search(head.replace(b"\r\n", b"\n"))
    return int(found[1]) + 2 * len(GAP) if found and head[:1].isdigit() and head[1:3] == b"\r\n" else None


def _exits(starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """(start, exit) of a split's candidates: the first place beyond the split's last candidate that the chain from start reaches."""
    known: dict[int, int] = {}
    for s, e in zip(reversed(starts), reversed(ends)):
        if e > starts[-1]:
            known[s] = e
        elif e in known:
            known[s] = known[e]
    return iter(known.items())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, start, exit) of every candidate, from the split's first row on, and a row without a start with the split's bytes."""
    at, here, starts, ends = 0, None, [], []

    def close() -> pa.RecordBatch:
        out = [*_exits(starts, ends), (None, at)]
        cols = [pa.array([here[0]] * len(out), pa.string()), pa.array([here[1]] * len(out), pa.int64()), *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)), pa.array([here[2]] * len(out), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["file", "block", "start", "exit", "size"])

    for b in batches:
        for file, block, size, n, head in zip(*(c.to_pylist() for c in b.columns)):
            if here is None or here[:2] != (file, block):
                if here:
                    yield close()
                at, here, starts, ends = 0, (file, block, size), [], []
            whole = block == 0 and at == 0  # only a file's first row holds its own magic
            own = head[len(MAGIC) :] if whole and head.startswith(MAGIC.encode()) else b"" if whole else head
            if (rest := _claimed(own)) is not None:
                starts.append(at if whole else at - len(MAGIC))
                ends.append(at + len(head) + rest)
            at += n + len(BETWEEN)
    if here:
        yield close()


def _verified(found: DataFrame, max_rounds: int) -> DataFrame:
    """(file, block, base, next): the place of a split's first row and that of the first record that starts there or later.

    A file whose chain of records does not end at its end is an error.
    """
    in_file = W.partitionBy("file").orderBy("block")
    splits = cut(found.where("start IS NULL").select("file", "block", "size", F.coalesce(F.sum("exit").over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    rows = cut(found.where("start IS NOT NULL").select("file", "block", "start", "exit").join(splits, ["file", "block"]).select("file", "block", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("exit")).alias("exit")))
    jumps, marks, n = rows.drop("block"), splits.select("file", F.lit(0).cast("long").alias("start")).distinct(), -1
    for _ in range(max_rounds):
        # After k rounds a jump leads over 2^k splits, and all places are marked that so many jumps reach.
        marks = cut(marks.unionByName(marks.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start"))).distinct())
        if (now := marks.count()) == n:
            break
        n, then = now, jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("then"))
        jumps = cut(jumps.join(then, ["file", "exit"]).select("file", "start", F.col("then").alias("exit")))
    else:
        raise RuntimeError(f"chains are not final after {max_rounds} rounds")
    broken = splits.select("file", F.col("size").alias("start")).distinct().join(marks, ["file", "start"], "left_anti").count()
    if broken:
        raise ValueError(f"{broken} archives do not end with the end of a record")
    entries = rows.join(marks, ["file", "start"], "left_semi").groupBy("file", "block").agg(F.min("start").alias("entry"))
    later = in_file.rowsBetween(W.currentRow, W.unboundedFollowing)
    return splits.join(entries, ["file", "block"], "left").select("file", "block", "base", F.coalesce(F.min("entry").over(later), "size").alias("next"))


_OUT = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean, payload binary"


def _parsed(content: bytes, payloads: bool) -> tuple:
    """A row of a record, given without its magic. The payload of HTTP blocks is their body; a revisit has what its fields say."""
    head, _, rest = content.partition(GAP.encode())
    fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    get = lambda name: fields.get(name)
    payload = rest[: int(fields[b"content-length"])]
    said = (get(b"warc-payload-digest") or "").removeprefix("sha1:")
    length = None
    if (get(b"content-type") or "").replace(" ", "").startswith("application/http"):
        http, _, payload = payload.partition(GAP.encode())
        length = int(found[1]) if (found := _LENGTH.search(http.replace(b"\r\n", b"\n"))) else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = get(b"warc-type")
    if kind == "revisit":
        shown, intact = (length, said or None), None
    else:
        shown, intact = (len(payload), digest), (not said or said == digest) and length in (None, len(payload))
    return kind, get(b"warc-record-id"), get(b"warc-target-uri"), get(b"warc-refers-to"), *shown, intact, payload if payloads and kind != "revisit" else None


def _records(payloads: bool):
    """Over rows (file, block, size, base, next, value): records that lie in a split, and pieces (file, end, place, piece) of others."""
    between, magic, names = BETWEEN.encode(), len(MAGIC), [*(c.split()[0] for c in _OUT.split(", ")), "file", "end", "place", "piece"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, begun, end, held, place, out = None, 0, False, 0, [], 0, []

        def close() -> tuple | None:
            """The row of what is held, which ends at ``end``: a record if it began in this split and is whole, else a piece."""
            if not held:
                return None
            content = between.join(held)
            return (*_parsed(content, payloads), None, None, None, None) if begun else (*[None] * 8, here[0], end, place, content)

        def batch() -> pa.RecordBatch:
            cols = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

        for b in batches:
            for file, block, size, base, following, value in zip(*(c.to_pylist() for c in b.columns)):
                if base is None:
                    raise ValueError("the splits of an archive changed between two reads")
                if here is None or here[:2] != (file, block):
                    if here:
                        begun = begun and at > here[2]
                        out += [x] if (x := close()) else []
                    here, at, begun, end, held, place = (file, block, size), base, False, following, [], base
                whole = at == 0
                if (0 if whole else at - magic) == end or whole:
                    out += [x] if (x := close()) else []
                    held, begun, place = [], True, at
                    own = value[magic:] if whole else value
                    head = (own + b"\n").partition(GAP.encode())[0]
                    end = at + (magic if whole else 0) + len(head) + _claimed(head)
                    held.append(own)
                else:
                    held.append(value)
                at += len(value) + len(between)
                if len(out) >= 1000 or sum(len(x[7] or x[11] or b"") for x in out) > 1 << 24:
                    yield batch()
                    out = []
        if here:
            begun = begun and at > here[2]
            out += [x] if (x := close()) else []
        if out:
            yield batch()

    return run


def read_warc(spark: SparkSession, folder: str, p: Reading = Reading()) -> DataFrame:
    """A row per record of the uncompressed archives in ``folder``: record_type, record_id, target_uri, refers_to, payload_bytes,
    payload_digest (base32 SHA-1), intact (the payload has the digest and length that it claims) and payload.

    Length and digest of a revisit's payload are those of its fields, and intact is null. What looks like a record inside a payload is none.
    A file that is cut off or has bytes between records is an error. Archives of any size are read in splits; what is sent to all tasks is
    one row a split, ``p.max_splits`` at most. Empty files and folders have no records.
    """
    rows = _segments(spark, folder)
    found = cut(rows.select("file", "block", "size", F.octet_length("value").alias("n"), F.substring_index(F.concat("value", F.lit("\n")), GAP, 1).cast("binary").alias("head")).mapInArrow(_candidates, "file string, block long, start long, exit long, size long"))
    plan = cut(_verified(found, p.max_rounds))
    if plan.limit(p.max_splits + 1).count() > p.max_splits:
        raise ValueError(f"over {p.max_splits} splits; read fewer archives at once")
    known = rows.join(F.broadcast(plan), ["file", "block"], "left").select("file", "block", "size", "base", "next", F.col("value").cast("binary").alias("value"))
    read = cut(known.mapInArrow(_records(p.payloads), f"{_OUT}, file string, end long, place long, piece binary"))
    names = [c.split()[0] for c in _OUT.split(", ")]

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        row = _parsed(BETWEEN.encode().join(t.column("piece").to_pylist()), p.payloads)
        return pa.table([pa.array([v], k) for v, k in zip(row, [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()])], names=names)

    parts = read.where("piece IS NOT NULL").select("file", "end", "place", "piece")
    return read.where("piece IS NULL").select(*names).unionByName(parts.groupBy("file", "end").applyInArrow(joined, _OUT))


def page_of(record: Column) -> Column:
    """The page_id in a record's name as text, null if it has none."""
    return F.nullif(F.regexp_extract(record, "^<urn:x-page:([^:]*):", 1), F.lit(""))


def temporary_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder."""
    return f"{checkpoint_dir(spark)}/warc-{uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of archives."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
