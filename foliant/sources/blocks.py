"""Adapters of the driver's tables to the flat block model; they are ours, the tables have no geometry.

A block is a line of a document's text: fifty lines make a page, a line's length gives its width and indent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import is_plain, normalize_text

PAGE_W, PAGE_H = 612.0, 792.0


def blocks_from_documents(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, seq, block_id, text, x, y, w, h, font_size, font_name, column_hint, role."""
    # Lines are normalized in the array, so that the filter after it reads a column and does not work it out again; a text that holds
    # only plain characters and single spaces is looked through once, and its lines are trimmed.
    lines = F.split("text", "\n")
    texts = F.when(is_plain(F.col("text"), " \t\x0b\f\r"), F.transform(lines, lambda line: F.btrim(line))).otherwise(F.transform(lines, normalize_text))
    lines = docs.select("doc_id", F.posexplode(texts).alias("seq", "text")).where("text <> ''")
    n = F.length("text")
    at = F.col("seq")
    size = F.when((at % 7 == 0) & (n <= 60), 24.0).when((at % 5 == 0) & (n <= 80), 17.0).otherwise(12.0)
    return lines.select(
        "doc_id", (F.floor(at / 50) + 1).cast("int").alias("page_number"), "seq", F.concat(F.lit("b"), at).alias("block_id"), "text",
        (72.0 + 6 * (n % 5)).alias("x"), (72.0 + 14 * (at % 50) + F.when(at % 9 == 0, 2).otherwise(0)).alias("y"), F.least(n * 6.0, F.lit(468.0)).alias("w"), F.lit(12.0).alias("h"),
        size.alias("font_size"), F.when(at % 5 == 0, "Times-Bold").otherwise("Times-Roman").alias("font_name"), F.when(n % 4 == 0, 1).otherwise(0).alias("column_hint"),
        F.when(size >= 24, "H1").when(size >= 17, "H2").when(n % 11 == 0, "LI").otherwise("P").alias("role"),
    )


#: The same in DuckDB SQL, as common table expressions.
JS_SPACE = r"[\t\n\x{0B}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NORM = rf"trim(regexp_replace(coalesce(%s, ''), '{JS_SPACE}+', ' ', 'g'))"
BLOCKS_SQL = f"""
lines AS (SELECT doc_id, raw, i - 1 AS seq FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
norm AS (SELECT doc_id, seq, {NORM % 'raw'} AS text FROM lines),
blocks AS (SELECT doc_id, (seq // 50 + 1)::INT AS page_number, seq, 'b' || seq AS block_id, text, 72.0::DOUBLE + 6 * (length(text) % 5) AS x,
  72.0::DOUBLE + 14 * (seq % 50) + CASE WHEN seq % 9 = 0 THEN 2 ELSE 0 END AS y, least(length(text) * 6.0::DOUBLE, 468.0::DOUBLE) AS w, 12.0::DOUBLE AS h,
  CASE WHEN seq % 7 = 0 AND length(text) <= 60 THEN 24.0::DOUBLE WHEN seq % 5 = 0 AND length(text) <= 80 THEN 17.0::DOUBLE ELSE 12.0::DOUBLE END AS font_size,
  CASE WHEN seq % 5 = 0 THEN 'Times-Bold' ELSE 'Times-Roman' END AS font_name, CASE WHEN length(text) % 4 = 0 THEN 1 ELSE 0 END AS column_hint,
  CASE WHEN seq % 7 = 0 AND length(text) <= 60 THEN 'H1' WHEN seq % 5 = 0 AND length(text) <= 80 THEN 'H2' WHEN length(text) % 11 = 0 THEN 'LI' ELSE 'P' END AS role
  FROM norm WHERE text <> '')
"""
