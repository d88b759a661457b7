"""The queries op1 to op13 over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat, decontaminate, filters, mixing, paragraphs, quality, ranking, scoring, secrets, simhash, suffix, tokens, warc
from foliant.sources import read_table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the line-first rules for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.quality_verdict(docs)
    return q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")])


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 7)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS c FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM rep) GROUP BY k),
firsts AS (SELECT k, min(j) AS j, l FROM (SELECT k, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS j FROM t) GROUP BY k, l),
m AS (SELECT k, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS c,
        len(regexp_extract_all(l, '[#*$%&|<>]')) AS sy, len(regexp_extract_all(l, '[|\x{bb}\x{203a}\x{2022}]')) AS sp,
        len(regexp_extract_all(l, '!!+(?:[\x20\x09-\x0D]|$)')) AS sh, len(regexp_extract_all(l, '[.,;:!?\x{2026}\x{3002}\x{ff0c}]')) AS pu,
        regexp_matches(l, '(?i)(?:BOILER)') AS bo FROM firsts),
cl AS (SELECT k, sum(c) AS clean FROM m WHERE NOT (sy * 100 > c * 10 OR (sp >= 3 AND sp * 100 > n * 20) OR sh * 100 > n * 30 OR (n >= 12 AND pu = 0) OR (n <= 30 AND bo)) GROUP BY k),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(c, 0)::BIGINT AS n_repeat_words, coalesce(clean, 0)::BIGINT AS clean FROM t LEFT JOIN cov USING (k) LEFT JOIN cl USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AS base_failed,
  (n_words >= 20 AND n_repeat_words * 100 <= n_words * 30 AND (word_chars - clean) * 100 <= word_chars * 50) AS kept, word_chars - clean AS lost_chars FROM f
""".replace("BOILER", "|".join(quality.BOILERPLATE))


#: A conversation whose texts look like marks and escapes.
TRICKY = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of -7, read back from their formatted texts and loss flags."""
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_chats(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'TRICKY', NULL UNION ALL SELECT -7, 1, 'assistant', 'TRICKY', NULL),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, lone ORDER BY turn, role, text) AS prev FROM c),
v AS (SELECT *, CASE WHEN role = 'system' THEN prev IS NULL WHEN role = 'user' THEN prev IS NULL OR prev IN ('system', 'assistant')
  WHEN role = 'assistant' THEN coalesce(prev IN ('user', 'tool'), false) WHEN role = 'tool' THEN coalesce(prev = 'assistant', false) ELSE false END AS ok FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + length(role) + length(text) + length(regexp_replace(role || text, '[^<>\\]', '', 'g')))::BIGINT AS formatted_chars,
  bool_and(ok) AND arg_max(role, (turn, role, text)) <> 'system' AS valid
FROM v GROUP BY conv_id, lone
""".replace("TRICKY", TRICKY)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item, array_to_string(w[i:i + 9], ' ') AS g, least(10, len(w)) AS n FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT k, i, pos.n, item FROM pos JOIN win USING (g, n)),
covered AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS j FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN its USING (k)
"""


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages with others, by component."""
    return paragraphs.repeated_paragraphs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public byte-level vocabulary."""
    import public_tokenizers

    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokens.TokenCount(public_tokenizers.path("byte_bpe_50k.json")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under word counts and under the recurrent model."""
    return scoring.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without byte strings of 400 that start elsewhere too."""
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the spans that the scan finds in every document."""
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    dense = F.size(F.filter("secrets", lambda s: s["novelty"] >= secrets.SecretScan().min_added)).cast("long").alias("n_incompressible")
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), count("novel"), dense)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by language."""
    return filters.audit_filters(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
low AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * len(regexp_extract_all(d.text, '[A-Z]')) > 10 * length(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(low < d.doc_id, false)] AS bad
  FROM d JOIN low USING (text) LEFT JOIN lab ON lab.doc_id = d.doc_id),
m AS (SELECT part, bad, len(list_filter(bad, lambda x: x)) AS k, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT list_reduce(list_transform(o, lambda x: chr(64 + x::INT)), lambda x, y: x || y) AS filter_order, l.i AS step, o[l.i] AS own, o[1:l.i - 1] AS before FROM o, l),
x AS (SELECT part, filter_order, step, n, good, toxic, k, bad[own] AS fails, len(list_filter(before, lambda j: bad[j])) > 0 AS earlier FROM m, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) FILTER (fails), 0)::BIGINT AS shapley FROM x GROUP BY part, filter_order, step
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as records of archives, written and read back."""
    folder = warc.temporary_folder(spark)
    warc.write_warc(read_table(spark, sf_dir, "pages"), folder)
    page = lambda c: warc.page_of(F.col(c)).cast("long")
    records = warc.read_warc(spark, folder, warc.Reading(payloads=False))
    warc.delete(spark, folder)
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")


OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, row_number() OVER w AS k, first_value(page_id) OVER w AS low FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST)),
b AS (SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits FROM r)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_reduce(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(generate_series(1, 5), lambda j: substr(bits, (5 * i + j)::INT, 1)::INT), lambda a, x: 2 * a + x) + 1, 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN low END AS refers_to, CASE WHEN k = 1 THEN true END AS intact FROM b
"""


def op13_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of every group of sale lines, with how many lines share their pair."""
    lines = read_table(spark, sf_dir, "sale_lines")
    tens, percent = ranking.pair_keys(F.col("quantity"), F.col("discount"))
    group = {
        "vendor_id": F.col("vendor_id"), "part": F.coalesce(F.col("item_id") % 5, F.lit(-1)),
        "month": F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1)),
    }
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = lines.select(
        *[F.when(one, -1).otherwise(c).cast("long").alias(n) for n, c in group.items()], tens.cast("long").alias("tens"), percent.cast("long").alias("percent"),
        "sale_id", "line_no", "quantity", F.floor(100 * F.col("amount") + 0.5).cast("long").alias("amount_cents"),
    )
    p = ranking.Ranking(("vendor_id", "part", "month"), ("tens", "percent"), ("sale_id", "line_no", "quantity", "amount_cents"), at_most=2)
    long = [F.col(c).cast("long").alias(c) for c in ("sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")]
    return ranking.rank_ties(rows, p).select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), *long)


#: The recursion is CRC-32 over the bytes of the decimal text, a bit a step.
OP13_SQL = r"""
WITH RECURSIVE ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
crc AS (SELECT sale_id, 0 AS bit, xor(4294967295, ascii(sale_id::VARCHAR)::BIGINT) AS c FROM ids
  UNION ALL SELECT sale_id, bit + 1, xor(xor(c >> 1, 3988292384 * (c & 1)), CASE WHEN (bit + 1) % 8 = 0 AND (bit + 1) // 8 < length(sale_id::VARCHAR) THEN ascii(substr(sale_id::VARCHAR, (bit + 1) // 8 + 1, 1))::BIGINT ELSE 0 END)
  FROM crc WHERE bit < 8 * length(sale_id::VARCHAR)),
one AS (SELECT sale_id FROM crc WHERE bit = 8 * length(sale_id::VARCHAR) AND xor(c, 4294967295) % 5 = 0),
l AS (SELECT s.*, o.sale_id IS NOT NULL AS one, floor(quantity / 10) AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, floor(100 * amount + 0.5)::BIGINT AS amount_cents FROM sale_lines s LEFT JOIN one o ON s.sale_id = o.sale_id),
g AS (SELECT CASE WHEN one THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN one THEN -1 ELSE coalesce(item_id % 5, -1) END AS part, CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
  tens, percent, sale_id, line_no, quantity, amount_cents FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
  count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM g)
SELECT vendor_id::BIGINT AS vendor_id, part::BIGINT AS part, month::BIGINT AS month, pos, pos AS place, sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, percent, amount_cents, tied FROM r WHERE pos <= 2
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_ranking_ties": op13_ranking_ties,
}
ORACLES = {"op6_quality_rules": OP6_SQL, "op7_decontamination": OP7_SQL, "op8_chat_formatting": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_warc": OP12_SQL, "op13_ranking_ties": OP13_SQL}
