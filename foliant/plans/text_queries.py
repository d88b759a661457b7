"""Queries over texts: scan scalars, language, script, recognition quality, redaction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import language as L
from foliant.functions import text as T
from foliant.operators.grouped import once
from foliant.operators.pages import bad_sources, best_of, needs_recognition, sampled_operators
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL, JS_SPACE, NORM, PAGE_H, PAGE_W, blocks_from_documents
from foliant.sources.tables import read_table

TEXT = Registry()
_in = lambda words: ", ".join(f"'{w}'" for w in words)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks_from_documents(_docs(spark, d))


LANGUAGE_CTE = rf"""
lw AS (SELECT *, lower({NORM % 'text'}) AS t, regexp_extract_all(lower({NORM % 'text'}), '\p{{L}}+') AS ws FROM %s),
lc AS (SELECT *, len(ws) AS n, len(regexp_extract_all(t, '[áéíóúñü¿¡]')) AS acc,
  len(list_filter(ws, lambda w: w IN ({_in(L.EN_STOP)}))) * 1.45::DOUBLE + len(list_filter(ws, lambda w: w IN ({_in(L.EN_MARK)}))) * 0.65::DOUBLE AS en,
  len(list_filter(ws, lambda w: w IN ({_in(L.ES_STOP)}))) * 1.45::DOUBLE + len(regexp_extract_all(t, '[áéíóúñü¿¡]')) * 2.2::DOUBLE
  + len(list_filter(ws, lambda w: regexp_matches(w, '{L.ES_SUFFIX}'))) * 0.9::DOUBLE + len(regexp_extract_all(t, '[¿¡]')) * 2.5::DOUBLE AS es FROM lw),
lang_of AS (SELECT *, CASE WHEN n = 0 OR (greatest(en, es) < 1.25 AND acc = 0 AND n < 5) THEN 'und' WHEN es > en THEN 'es-ES' ELSE 'en-US' END AS language,
  CASE WHEN n = 0 THEN 0.0 WHEN greatest(en, es) < 1.25 AND acc = 0 AND n < 5 THEN 0.2
  ELSE round(least(0.42::DOUBLE + abs(en - es) / greatest(en + es, 1.0::DOUBLE) * 0.46::DOUBLE + least(n / 24.0::DOUBLE, 0.12::DOUBLE), 0.99::DOUBLE), 3) END::DOUBLE AS confidence FROM lc)
"""


@TEXT.query("language_by_document", f"WITH {LANGUAGE_CTE % 'documents'} SELECT doc_id, language, confidence, n::BIGINT AS n_words, round(en, 3) AS english, round(es, 3) AS spanish FROM lang_of")
def language_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Operators 29, 30: language test of every document."""
    return _docs(spark, d).select("doc_id", L.detect_language(F.col("text")).alias("l")).select("doc_id", "l.*")


@TEXT.query("language_by_page", f"WITH {BLOCKS_SQL}, pages_t AS (SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY seq) AS text FROM blocks GROUP BY ALL), {LANGUAGE_CTE % 'pages_t'} SELECT doc_id, page_number, language, confidence FROM lang_of")
def language_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Operator 31: the language of a page is tested on its blocks together."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    pages = _blocks(spark, d).groupBy("doc_id", "page_number").agg(text.alias("text"))
    return pages.select("doc_id", "page_number", L.detect_language(F.col("text")).alias("l")).select("doc_id", "page_number", "l.language", "l.confidence")


@TEXT.query("recognition_languages", f"""WITH {LANGUAGE_CTE % 'documents'} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'explicit' WHEN language = 'es-ES' THEN 'detected-spanish' WHEN language = 'en-US' AND confidence >= 0.75 THEN 'detected-english' ELSE 'bilingual-fallback' END AS strategy,
 CASE WHEN doc_id % 10 = 0 THEN 'eng,fra,spa' WHEN language = 'es-ES' THEN 'spa,eng' WHEN language = 'en-US' AND confidence >= 0.75 THEN 'eng' ELSE 'eng,spa' END AS languages, language AS hint FROM lang_of""")
def recognition_languages(spark: SparkSession, d: str) -> DataFrame:
    """Operators 32, 33: explicit languages of every tenth document, else by detection."""
    asked = F.when(F.col("doc_id") % 10 == 0, "en+ fra,Spanish,eng").otherwise("")
    rows = _docs(spark, d).select("doc_id", T.ocr_languages(asked).alias("asked"), L.detect_language(F.col("text")).alias("l"))
    return rows.select("doc_id", L.recognition_plan(F.col("asked"), F.col("l.language"), F.col("l.confidence")).alias("p")).select("doc_id", "p.strategy", F.array_join("p.languages", ",").alias("languages"), "p.hint")


@TEXT.query("language_tags", """SELECT lang, count(*) AS n, max(CASE WHEN lang = 'es' THEN 'es-ES' ELSE 'en-US' END) AS tag, max(lang || '-' || upper(CASE WHEN lang = 'en' THEN 'us' ELSE lang END)) AS paired FROM documents GROUP BY lang""")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    """Operator 34: canonical tags of languages and of language pairs."""
    region = F.when(F.col("lang") == "en", "us").otherwise(F.col("lang"))
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.max(T.language_tag(F.col("lang"))).alias("tag"), F.max(T.language_tag(F.concat("lang", F.lit("_"), region))).alias("paired"))


_SCRIPT = r"""
sc AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{21}-\x{7f}\x{a0}-\x{24f}]')) AS latin, len(regexp_extract_all(text, '[\x{3000}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{ff00}-\x{ffef}]')) AS cjk,
 len(regexp_extract_all(text, '[\x{600}-\x{6ff}\x{750}-\x{77f}]')) AS arabic, len(regexp_extract_all(text, '[\x{590}-\x{5ff}]')) AS hebrew, len(regexp_extract_all(text, '[\x{400}-\x{52f}]')) AS cyrillic,
 len(regexp_extract_all(text, '[^\x{0}-\x{20}\x{80}-\x{9f}]')) AS seen FROM documents)"""


@TEXT.query("script_profile", f"""WITH {_SCRIPT} SELECT doc_id, latin::BIGINT AS latin, (seen - latin - cjk - arabic - hebrew - cyrillic)::BIGINT AS other,
 CASE WHEN seen < 20 THEN 'unknown' WHEN greatest(latin, cjk, arabic, hebrew, cyrillic) = 0 THEN 'other' WHEN latin >= greatest(cjk, arabic, hebrew, cyrillic) THEN 'latin' WHEN cjk >= greatest(arabic, hebrew, cyrillic) THEN 'cjk' ELSE 'x' END AS script,
 CASE WHEN seen < 20 THEN 0.0 ELSE round(greatest(latin, cjk, arabic, hebrew, cyrillic)::DOUBLE / seen, 6) END::DOUBLE AS ratio FROM sc""")
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    """Operators 35, 36: script histogram and the dominant script."""
    rows = _docs(spark, d).select("doc_id", L.script_counts(F.col("text")).alias("c")).withColumn("s", L.dominant_script(F.col("c")))
    return rows.select("doc_id", F.col("c.latin").cast("long").alias("latin"), F.col("c.other").cast("long").alias("other"), "s.script", F.round("s.ratio", 6).alias("ratio"))


@TEXT.query("script_samples", f"""WITH {BLOCKS_SQL}, o AS (SELECT doc_id, seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY doc_id) // 20) AS st FROM blocks),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM o WHERE i % st = 0) SELECT doc_id, string_agg(substr(text, 1, 40), ' ' ORDER BY seq) AS sample FROM k WHERE k <= 20 GROUP BY doc_id""")
def script_samples(spark: SparkSession, d: str) -> DataFrame:
    """Operator 35: the sample of a document's operators by which its script is told; blocks as operators, 20 of them."""
    return sampled_operators(_blocks(spark, d), 20, 40)


@TEXT.query("profile_route", f"""WITH {BLOCKS_SQL}, o AS (SELECT doc_id, count(*) / count(DISTINCT page_number)::DOUBLE AS ops FROM blocks GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND (doc_id % 8 = 0 OR ops <= 200) THEN 'forms-heavy' WHEN doc_id % 3 = 0 THEN 'scientific' ELSE 'default' END AS profile,
 CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 0.95 WHEN doc_id % 4 = 0 AND ops <= 200 THEN 0.75 WHEN doc_id % 3 = 0 THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence, round(ops, 6) AS ops_per_page FROM o""")
def profile_route(spark: SparkSession, d: str) -> DataFrame:
    """Operators 37 to 39: profile by operators per page, form, producer, script and citations."""
    ops = _blocks(spark, d).groupBy("doc_id").agg((F.count("*") / F.countDistinct("page_number")).alias("ops"), F.countDistinct("page_number").alias("n_pages"), F.array_join(F.collect_list("text"), " ").alias("t"))
    maker = F.when(F.col("doc_id") % 8 == 0, "Designer 6.5").when(F.col("doc_id") % 3 == 0, "pdfTeX-1.40").otherwise("Word")
    # Counts are columns before they are compared; otherwise every comparison would read the text again.
    ops = ops.withColumn("t", once(F.col("t"))).withColumns({"c": once(L.script_counts(F.col("t"))), "density": once(L.citation_density(F.col("t")))})
    rows = ops.withColumn("s", once(L.dominant_script(F.col("c"))))
    p = L.route_profile(F.col("ops"), F.col("n_pages"), F.col("doc_id") % 4 == 0, maker, F.col("s.script"), F.col("s.ratio"), F.col("density"))
    return rows.select("doc_id", p.alias("p"), F.round("ops", 6).alias("ops_per_page")).select("doc_id", "p.profile", "p.confidence", "ops_per_page")


@TEXT.query("citation_density", r"""SELECT doc_id, CASE WHEN length(t) < 100 THEN 0.0 ELSE round(len(regexp_extract_all(t, '\bv\.\s+[A-Z]')) / length(t)::DOUBLE * 1000 + len(regexp_extract_all(t, '§\s*[0-9]+')) / length(t)::DOUBLE * 1000, 6) END::DOUBLE AS density
FROM (SELECT doc_id, text || ' Roe v. Wade § 14' AS t FROM documents)""")
def citation_density(spark: SparkSession, d: str) -> DataFrame:
    """Operator 37: legal citations in a thousand characters."""
    return _docs(spark, d).select("doc_id", F.round(L.citation_density(F.concat("text", F.lit(" Roe v. Wade § 14"))), 6).alias("density"))


@TEXT.query("page_text_summary", f"""WITH {BLOCKS_SQL}, s AS (SELECT doc_id, page_number, count(*) AS n_blocks, sum(length(regexp_replace(text, '{JS_SPACE}+', '', 'g')))::BIGINT AS n_chars, sum(w * h) / (612.0::DOUBLE * 792.0::DOUBLE) AS cover FROM blocks GROUP BY ALL)
SELECT doc_id, page_number, n_blocks, n_chars, round(cover, 6) AS coverage, n_blocks <= 1 OR n_chars <= 24 OR cover <= 0.002 AS needs_ocr FROM s""")
def page_text_summary(spark: SparkSession, d: str) -> DataFrame:
    """Operators 14, 15: text on a page and whether it is too little."""
    cover = F.sum(F.col("w") * F.col("h")) / (PAGE_W * PAGE_H)
    rows = _blocks(spark, d).groupBy("doc_id", "page_number").agg(F.count("*").alias("n_blocks"), F.sum(F.length(T.without_space(F.col("text")))).alias("n_chars"), cover.alias("cover"))
    sparse = needs_recognition("auto", F.col("n_blocks"), F.col("n_chars"), F.col("cover"))
    return rows.select("doc_id", "page_number", "n_blocks", "n_chars", F.round("cover", 6).alias("coverage"), sparse.alias("needs_ocr"))


_RUN = "list_bool_or(list_transform(generate_series(1, length(t)), lambda i: i + %d <= length(t) AND length(replace(substr(t, i, %d), substr(t, i, 1), '')) = 0))"


@TEXT.query("garbage_tokens", r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\s]+'), lambda t: length(t) >= 2)) AS t FROM documents)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER ((length(t) >= 4 AND replace(t, substr(t, 1, 1), '') = '') OR length(regexp_replace(t, '[a-zA-Z0-9]', '', 'g')) > 0.5 * length(t) OR regexp_matches(t, '(_[a-zA-Z]{1,3}){2,}')) AS n_garbage FROM w GROUP BY doc_id""")
def garbage_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Operators 16, 17: tokens and those that look like failed recognition."""
    token = _docs(spark, d).select("doc_id", F.explode(F.split("text", r"\s+")).alias("t")).where(F.length("t") >= 2)
    return token.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(T.is_garbage_token(F.col("t"))).alias("n_garbage"))


_RATIOS = f"""r AS (SELECT doc_id, {NORM % 'text'} AS t, regexp_replace({NORM % 'text'}, '{JS_SPACE}+', '', 'g') AS c FROM documents),
q AS (SELECT doc_id, t, c, length(c) AS chars, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words, CASE WHEN c = '' THEN 1.0 ELSE len(regexp_extract_all(c, '[^A-Za-z0-9.,;:!?()''"%$&+\\-/]')) / length(c)::DOUBLE END AS sus,
 CASE WHEN c = '' THEN 0.0 ELSE len(regexp_extract_all(c, '[A-Za-z0-9]')) / length(c)::DOUBLE END AS alnum FROM r)"""


_REPEATS = """ch AS (SELECT doc_id, i, substr(c, i, 1) AS x FROM (SELECT doc_id, c, unnest(generate_series(1, length(c))) AS i FROM r)), g AS (SELECT doc_id, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS k FROM ch),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id, x, k), rp AS (SELECT doc_id, sum(n) FILTER (n >= 3) AS m FROM n GROUP BY doc_id)"""


@TEXT.query("recognition_score", f"""WITH {_RATIOS}, {_REPEATS}, z AS (SELECT q.*, CASE WHEN c = '' THEN 1.0 ELSE coalesce(m, 0) / length(c)::DOUBLE END AS rep FROM q LEFT JOIN rp USING (doc_id))
SELECT doc_id, round(sus, 6) AS suspicious, CASE WHEN chars = 0 THEN 0.0 ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.42::DOUBLE * 0.9 + least(chars / 180.0::DOUBLE, 1.0) * 0.24 + least(words / 32.0::DOUBLE, 1.0) * 0.12 + 0.3::DOUBLE * 0.05 + alnum * 0.17 - sus * 0.12 - rep * 0.08)), 3) END::DOUBLE AS score FROM z""")
def recognition_score(spark: SparkSession, d: str) -> DataFrame:
    """Operators 21, 22: score of a text as if recognized with confidence 90 in three blocks."""
    # Each figure is a column before others use it; otherwise every use would read the text again.
    rows = _docs(spark, d).select("doc_id", once(T.normalize_text(F.col("text"))).alias("t"), once(T.without_space(F.col("text"))).alias("c"))
    t, c = F.col("t"), F.col("c")
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    alnum = F.when(c == "", F.lit(0.0)).otherwise(F.regexp_count(c, F.lit("[A-Za-z0-9]")) / F.nullif(F.length(c), F.lit(0)))
    figures = {"words": words, "alnum": alnum, "sus": T.suspicious_ratio(c, c), "repeated": T.repeated_ratio(c, c)}
    rows = rows.select("doc_id", F.length(c).alias("chars"), *[once(v).alias(k) for k, v in figures.items()])
    score = T.candidate_score(F.lit(90.0), F.col("chars"), F.col("words"), F.lit(3), F.col("alnum"), F.col("sus"), F.col("repeated"))
    return rows.select("doc_id", F.round("sus", 6).alias("suspicious"), score.alias("score"))


@TEXT.query("repeated_ratio", r"""WITH r AS (SELECT doc_id, regexp_replace(text, '[\s]+', '', 'g') AS c FROM documents), ch AS (SELECT doc_id, c, i, substr(c, i, 1) AS x FROM (SELECT doc_id, c, unnest(generate_series(1, length(c))) AS i FROM r)),
g AS (SELECT doc_id, c, i, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS k FROM ch), n AS (SELECT doc_id, c, x, k, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, round(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / length(c)::DOUBLE, 6) AS repeated FROM n GROUP BY doc_id, c""")
def repeated_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Operator 22: share of a text in runs of one character."""
    return _docs(spark, d).select("doc_id", F.round(T.repeated_ratio(F.col("text")), 6).alias("repeated"))


_BG = "CASE WHEN %s = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(generate_series(1, greatest(length(%s) - 1, 1)), lambda i: substr(%s, i, 2))) END"


@TEXT.query("candidate_consensus", rf"""WITH c AS (SELECT item_id, trim(regexp_replace(lower({NORM % 'text'}), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark), b AS (SELECT item_id, item_id // 4 AS page, {_BG % ('t', 't', 't')} AS s FROM c),
p AS (SELECT a.item_id, avg(2.0::DOUBLE * len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s))) AS consensus FROM b a JOIN b ON a.page = b.page AND a.item_id <> b.item_id GROUP BY a.item_id)
SELECT b.item_id, b.page, round(coalesce(consensus, 1), 3)::DOUBLE AS consensus, len(s)::BIGINT AS n_bigrams, round((len(s) % 100) / 100.0::DOUBLE * 0.82::DOUBLE + round(coalesce(consensus, 1), 3) * 0.18::DOUBLE, 3)::DOUBLE AS final FROM b LEFT JOIN p USING (item_id)""")
def candidate_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Operators 23, 24: mean similarity of a candidate to the other candidates of its page, and the final score with it."""
    rows = read_table(spark, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 4).alias("page"), T.bigrams(F.col("text")).alias("s"))
    peer = rows.select(F.col("item_id").alias("peer"), F.col("page").alias("p"), F.col("s").alias("ps"))
    pairs = rows.join(peer, (F.col("page") == F.col("p")) & (F.col("item_id") != F.col("peer"))).groupBy("item_id").agg(F.avg(T.dice(F.col("s"), F.col("ps"))).alias("consensus"))
    return rows.join(pairs, "item_id", "left").select("item_id", "page", F.round(F.coalesce("consensus", F.lit(1.0)), 3).alias("consensus"), F.size("s").cast("long").alias("n_bigrams")).withColumn("final", T.final_score(F.col("n_bigrams") % 100 / 100, F.col("consensus")))


@TEXT.query("best_candidate", """WITH c AS (SELECT item_id, item_id // 4 AS page, item_id % 3 AS final, item_id % 2 AS score, length(text) AS chars, len(string_split(text, ' ')) AS words, item_id % 5 AS sure FROM benchmark)
SELECT page, item_id FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY CASE WHEN final = 0 THEN score ELSE final END DESC, score DESC, chars DESC, words DESC, sure DESC, item_id) = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Operator 25: the best candidate of a page by final score, score, characters, words and confidence, then order."""
    i = F.col("item_id")
    rows = read_table(spark, d, "benchmark").select(
        "item_id", F.floor(i / 4).alias("page"), (i % 3).alias("final"), (i % 2).alias("score"), F.length("text").alias("chars"), F.size(F.split("text", " ")).alias("words"), (i % 5).alias("confidence"), i.alias("seq"),
    )
    return best_of(rows, "page").select("page", "item_id")


@TEXT.query("bad_source_pages", f"""WITH {BLOCKS_SQL}, tk AS (SELECT doc_id, page_number, unnest(list_filter(regexp_split_to_array(text, '[\\s]+'), lambda t: length(t) >= 2)) AS t FROM blocks),
g AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER ((length(t) >= 4 AND replace(t, substr(t, 1, 1), '') = '') OR length(regexp_replace(t, '[a-zA-Z0-9]', '', 'g')) > 0.5 * length(t) OR regexp_matches(t, '(_[a-zA-Z]{{1,3}}){{2,}}')) AS bad FROM tk GROUP BY ALL),
f AS (SELECT doc_id, page_number, count(*) AS n_blocks, bool_or(regexp_matches(text, '(_[a-zA-Z]{{1,3}}){{3,}}') OR regexp_matches(text, '({"|".join(re.escape(c) + "{16}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.,;:!?*#$%&|<>= /-")})')) AS scanned FROM blocks GROUP BY ALL)
SELECT doc_id, page_number, scanned OR (n_blocks >= 3 AND coalesce(bad, 0) >= 0.3 * coalesce(n, 0) AND coalesce(n, 0) > 0) AS bad_source FROM f LEFT JOIN g USING (doc_id, page_number)""")
def bad_source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Operators 16, 17: pages whose own text is not to be trusted: fonts and traces of scans, or 30 % failed tokens on three blocks or more."""
    return bad_sources(_blocks(spark, d))


_SSN = """p AS (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS i FROM documents WHERE regexp_matches(text, '[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}')),
m AS (SELECT doc_id, i, CASE WHEN regexp_full_match(substr(text, i, 11), '[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}') THEN substr(text, i, 11) WHEN regexp_full_match(substr(text, i, 9), '[0-9]{9}') THEN substr(text, i, 9) END AS v, text FROM p),
f AS (SELECT doc_id, i, v, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM m WHERE v IS NOT NULL AND NOT regexp_matches(substr(text, i + length(v), 1), '[0-9]') AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[0-9]'))),
ok AS (SELECT doc_id, i, v, g FROM f WHERE substr(g, 1, 3) NOT IN ('000', '666') AND substr(g, 4, 2) <> '00' AND substr(g, 6, 4) <> '0000')"""


@TEXT.query("ssn_matches", f"WITH {_SSN} SELECT doc_id, i - 1 AS start, v AS value, '***-**-' || right(g, 4) AS masked, doc_id || ':ssn:' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS match_id FROM ok")
def ssn_matches(spark: SparkSession, d: str) -> DataFrame:
    """Operators 179, 180, 182: numbers found, masked and numbered."""
    rows = _docs(spark, d).select("doc_id", "text", T.find_ssn(F.col("text")).alias("found")).where(F.size("found") > 0)
    # The text before the k-th match is what stands before it in the pieces between matches.
    pieces = F.split("text", T.SSN)
    rows = rows.select("doc_id", pieces.alias("pieces"), "found", F.posexplode("found").alias("k", "value"))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("k") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("found", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("doc_id", before.cast("long").alias("start"), "value", T.masked_digits(F.col("value")).alias("masked"), F.concat(F.col("doc_id"), F.lit(":ssn:"), F.col("k") + 1).alias("match_id"))


@TEXT.query("redaction_summary", f"WITH {BLOCKS_SQL}, {_SSN.replace('FROM documents WHERE', 'FROM blk WHERE').replace('p AS (', 'blk AS (SELECT doc_id * 1000000 + seq AS doc_id, text FROM blocks), p AS (', 1)} SELECT doc_id // 1000000 AS doc_id, count(*) AS n_matches, count(DISTINCT (doc_id % 1000000) // 50) AS n_pages FROM ok GROUP BY ALL")
def redaction_summary(spark: SparkSession, d: str) -> DataFrame:
    """Operators 74, 182, 183: matches and pages that a plan redacts."""
    rows = _blocks(spark, d).select("doc_id", "page_number", F.explode(T.find_ssn(F.col("text"))).alias("v"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.countDistinct("page_number").alias("n_pages"))


@TEXT.query("masked_text", f"WITH {_SSN}, h AS (SELECT doc_id, count(*) AS n, sum(length(v) - 11) AS shrink FROM ok GROUP BY doc_id) SELECT doc_id, (length(text) - coalesce(shrink, 0))::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_masked FROM documents LEFT JOIN h USING (doc_id)")
def masked_text(spark: SparkSession, d: str) -> DataFrame:
    """Operators 180, 183: length of every text after masking."""
    return _docs(spark, d).select("doc_id", F.length(T.mask_ssn(F.col("text"))).cast("long").alias("n_chars"), F.size(T.find_ssn(F.col("text"))).cast("long").alias("n_masked"))


@TEXT.query("token_classes", rf"""WITH {BLOCKS_SQL}, t AS (SELECT unnest(string_split(text, ' ')) AS t FROM blocks) SELECT count(*) AS n_tokens, count(*) FILTER (regexp_matches(t, '(?i)^-?(?:[$£€¥])?(?:[0-9]+(?:[.,][0-9]+)*|[0-9]*\.[0-9]+)(?:%)?$|^n/a$')) AS n_numeric,
 count(*) FILTER (regexp_matches(t, '[0-9$£€¥%]')) AS n_numericish, count(*) FILTER (length(t) <= 48 AND regexp_matches(t, '[A-Za-z\x{{80}}-\x{{ffff}}]') AND NOT regexp_matches(t, '[0-9$£€¥%]')) AS n_headerish FROM t""")
def token_classes(spark: SparkSession, d: str) -> DataFrame:
    """Operators 2, 7, 131: numeric and header-like tokens."""
    t = _blocks(spark, d).select(F.explode(F.split("text", " ")).alias("t"))
    c = F.col("t")
    return t.agg(F.count("*").alias("n_tokens"), F.count_if(T.is_numeric_token(c)).alias("n_numeric"), F.count_if(T.looks_numeric(c)).alias("n_numericish"), F.count_if(T.looks_header(c)).alias("n_headerish"))


@TEXT.query("finding_codes", "SELECT source, lang, regexp_replace(regexp_replace(upper(lang || ' - ' || source), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS code, count(*) AS n FROM documents GROUP BY ALL")
def finding_codes(spark: SparkSession, d: str) -> DataFrame:
    """Operator 189: sanitized codes."""
    return _docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("code", T.finding_code(F.concat("lang", F.lit(" - "), "source")))


@TEXT.query("content_signatures", """WITH s AS (SELECT doc_id, sha256(text) AS sig FROM documents) SELECT sig AS signature, substr(sig, 1, 16) AS short_key, min(doc_id) AS retained, count(*) - 1 AS n_duplicates, round(('0x' || substr(sig, 1, 8))::BIGINT / 4294967295.0::DOUBLE, 6) AS fraction FROM s GROUP BY sig""")
def content_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Operators 170 to 173: dedupe by content signature, first retained; short keys and hash fractions."""
    s = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("signature")).groupBy("signature").agg(F.min("doc_id").alias("retained"), (F.count("*") - 1).alias("n_duplicates"))
    fraction = F.conv(F.substring("signature", 1, 8), 16, 10).cast("double") / 4294967295.0
    return s.select("signature", F.substring("signature", 1, 16).alias("short_key"), "retained", "n_duplicates", F.round(fraction, 6).alias("fraction"))
