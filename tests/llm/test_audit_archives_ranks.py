"""The filter audit, archives and ranks against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from foliant.llm import filters, ranking, warc

rng = random.Random(11)


@pytest.fixture
def many(spark):
    """More ranges than usual, so that runs of equal rows cross their bounds."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def audit_rows():
    hot = "one text that many share " * 60
    rows = [(k, hot, "en" if k % 2 else None) for k in range(300)]
    rows += [(5, hot, "en"), (None, hot, "de"), (None, hot, "de"), (-1, None, "fr"), (900, None, None), (901, "", "fr"), (901, "", "fr")]
    words = [f"w{k}" for k in range(400)]
    for k in range(1000, 1200):
        n = rng.choice([3, 99, 100, 150])
        text = " ".join(rng.choice(words) for _ in range(n))
        rows.append((k, rng.choice([text, text.upper(), text + " $", "b " * n]), rng.choice(["en", "de", None, ""])))
    rows += [(2000 + k, "x " * 90_000 if k % 2 else "X", "long") for k in range(6)]
    return rows


def audited(rows, labels):
    """Every order by hand."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    facts = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in t.translate({c: 32 for c in range(9, 14)}).split(" ") if x]
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and low[t] < i}
        facts.append((part or "", bad, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    out, shapley = {}, collections.Counter()
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in orders:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [len(left) - len(gone), len(gone), sum(x[1][f] for x in mine) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                left = [x for x in left if not x[1][f]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(many):
    rows = audit_rows()
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 1200, 7)] + [(7, 1, 1), (7, None, None), (None, 1, 1), (5000, 1, 1)]
    docs = many.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, part string, fp long, mask int").repartition(7)
    lab = many.createDataFrame([(d, q, int(x) if x is not None else None) for d, q, x in labels], "doc_id long, quality int, toxic int")
    got = filters.audit_filters(docs, lab).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audited(rows, labels) and len(got) == 600 * 5
    assert filters.audit_filters(docs.limit(0), lab).count() == 0
    assert filters.audit_filters(docs, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_copies_meet_over_ranges(many):
    """Copies in several ranges count by the smallest id of all, and by none of their own id."""
    docs = many.createDataFrame([(k // 3, "same", "en") for k in range(600)] + [(k, "other", "en") for k in range(5)], "doc_id long, text string, lang string").repartition(5)
    masks = filters.failure_masks(docs, lambda text, words: {})
    assert masks.groupBy("mask").count().collect() and {(r.mask, r["count"]) for r in masks.groupBy("mask").count().collect()} == {(0, 4), (1, 601)}


PAYLOADS = [
    None, "", "", "<p>one</p>", "<p>one</p>", "\r\n", "\r\n\r\n", "ends with breaks\r\n\r\n", "ends with one\r\n", "WARC/1.1\r\nno record", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nrest",
    "a\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\nabcde", "x\r\n\r\nWARC/1.", "é€😀 " * 50, "long " * 20_000, "b\r\n\r\nWARC/1.1\r\n\r\n" * 30, "WARC/1.", "\n\r\n\rWARC/1.1\r\nContent-Length: 0\r\n\r\n",
]


def page_rows():
    rows = [(k, f"http://x/{k}", h) for k, h in enumerate(PAYLOADS)]
    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 8\r\n\r\n12345678\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows += [(100 + k, None if k % 3 else "http://y/\r\nWARC-Type: z/é", rng.choice([fake, fake + str(k % 5), "p" * (k * 37 % 900), fake * 9 + str(k)])) for k in range(200)]
    return rows + [(None, "http://n", "<p>one</p>"), (None, None, "null only"), (None, None, "null only"), (7, "http://x/7", PAYLOADS[7]), (3, "http://x/3", "<p>one</p>"), (3, "http://x/3", "other")]


def archived(rows):
    """(page, size, digest, type, refers) of every row."""
    first = {}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    for r in sorted(rows, key=key):
        first.setdefault((r[2] or ""), r)
    used, out = set(), []
    for r in rows:
        h = r[2] or ""
        is_first = first[h] == r and h not in used
        used |= {h} if is_first else set()
        out.append((r[0], len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if is_first else "revisit", None if is_first else first[h][0]))
    return collections.Counter(out)


@pytest.mark.parametrize("split", [None, 301])
def test_warc(many, tmp_path, split):
    rows = page_rows()
    pages = many.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, key string, class string").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/a")
    if split:
        many.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        many.conf.set("spark.sql.files.openCostInBytes", "1")
    many.conf.set("spark.sql.shuffle.partitions", "3")
    got = warc.read_warc(many, f"file://{tmp_path}/a").collect()
    number = lambda x: None if x is None or x.split(":")[2] == "" else int(x.split(":")[2])
    assert collections.Counter((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got) == archived(rows)
    assert all(r.intact is (True if r.record_type == "response" else None) for r in got)
    assert collections.Counter(bytes(r.payload) for r in got if r.record_type == "response") == collections.Counter((r[2] or "").encode() for r in {r[2] or "": r for r in rows}.values())
    assert len({r.record_id for r in got}) == len(rows) and all("\n" not in r.target_uri for r in got)


def test_warc_edges(many, tmp_path):
    many.conf.set("spark.sql.shuffle.partitions", "2")
    none = many.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, f"file://{tmp_path}/none")
    assert warc.read_warc(many, f"file://{tmp_path}/none").count() == 0
    # Records of other writers: field names in any case, no digest, other kinds; a file that is cut off.
    os.makedirs(tmp_path / "own")
    one = b"WARC/1.0\r\nwarc-type: warcinfo\r\ncontent-length: 4\r\n\r\nabcd\r\n\r\n"
    (tmp_path / "own/a.warc").write_bytes(one + one.replace(b"abcd", b"\r\n\r\n"))
    got = warc.read_warc(many, f"file://{tmp_path}/own").collect()
    assert sorted(bytes(r.payload) for r in got) == [b"\r\n\r\n", b"abcd"] and {r.record_type for r in got} == {"warcinfo"}
    (tmp_path / "own/b.warc").write_bytes(one + one[:-6])
    with pytest.raises(ValueError):
        warc.read_warc(many, f"file://{tmp_path}/own")


def ranked(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for mine in groups.values():
        pair = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)
        mine.sort(key=lambda r: (*pair(r), r[3] is None, r[3] or 0))
        keys = [pair(r) for r in mine]
        for k, r in enumerate(mine):
            out.append((*r, k + 1, keys.index(keys[k]) + 1, len(set(keys[: k + 1])), keys.count(keys[k])))
    return collections.Counter(out)


@pytest.mark.parametrize("at_most", [None, 2])
def test_ranks(many, at_most):
    rows = [(None if k % 17 == 0 else k % 40, rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6]), rng.choice([None, 1, 2, 3])) for k in range(600)]
    rows += [(99, 1, 5, k % 7) for k in range(500)] + [(99, 1, 5, 3)] * 300 + [(99, k % 3, 5, 1) for k in range(300)] + [(98, 1, 1, 1)] * 400
    df = many.createDataFrame([(*r, "x") for r in rows], "g int, a int, b long, t int, pos string").repartition(6)
    p = ranking.Ranking(("g",), ("a", "b"), ("t",), at_most=at_most)
    got = ranking.rank_ties(df, p)
    assert got.columns == ["g", "a", "b", "t", "pos", "_pos", "rank", "dense", "tied"]
    want = ranked(rows)
    if at_most:
        want = collections.Counter({k: n for k, n in want.items() if k[4] <= at_most})
    assert collections.Counter(tuple(r) for r in got.drop("pos").collect()) == want
    assert ranking.rank_ties(df.limit(0), p).count() == 0


def test_ranks_on_disk(many):
    """More rows than the engine's memory holds."""
    df = many.range(300_000, numPartitions=2).select((F.col("id") % 2).alias("g"), (F.col("id") % 1000).alias("a"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
    many.conf.set("spark.sql.shuffle.partitions", "2")
    got = ranking.rank_ties(df, ranking.Ranking(("g",), ("a",), ("t",), memory="40MB"))
    r = got.agg(F.count("*"), F.sum("pos"), F.max("dense"), F.max("tied"), F.countDistinct("g", "pos")).first()
    assert tuple(r) == (300_000, 2 * sum(range(1, 150_001)), 500, 300, 300_000)
