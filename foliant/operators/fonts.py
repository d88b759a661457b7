"""Font names, glyph names, coverage of character maps and how missing characters are rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard fonts, names that stand for them, and glyph names besides the plain letters.
STANDARD = (
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Courier", "Courier-Bold", "Courier-Oblique",
    "Courier-BoldOblique", "Symbol", "ZapfDingbats",
)
SYNONYMS = {
    "TimesNewRoman": "Times-Roman", "TimesNewRomanPS": "Times-Roman", "TimesNewRomanPSMT": "Times-Roman", "TimesNewRoman-Bold": "Times-Bold", "TimesNewRomanPS-Bold": "Times-Bold", "TimesNewRomanPS-BoldMT": "Times-Bold",
    "TimesNewRoman-Italic": "Times-Italic", "TimesNewRomanPS-Italic": "Times-Italic", "TimesNewRomanPS-ItalicMT": "Times-Italic", "TimesNewRoman-BoldItalic": "Times-BoldItalic",
    "TimesNewRomanPS-BoldItalic": "Times-BoldItalic", "TimesNewRomanPS-BoldItalicMT": "Times-BoldItalic", "Arial": "Helvetica", "ArialMT": "Helvetica", "Arial-Bold": "Helvetica-Bold", "Arial-BoldMT": "Helvetica-Bold",
    "Arial-Italic": "Helvetica-Oblique", "Arial-ItalicMT": "Helvetica-Oblique", "Arial-BoldItalic": "Helvetica-BoldOblique", "Arial-BoldItalicMT": "Helvetica-BoldOblique", "CourierNew": "Courier", "CourierNewPS": "Courier",
    "CourierNewPSMT": "Courier", "CourierNew-Bold": "Courier-Bold", "CourierNewPS-BoldMT": "Courier-Bold", "CourierNew-Italic": "Courier-Oblique", "CourierNewPS-ItalicMT": "Courier-Oblique",
    "CourierNew-BoldItalic": "Courier-BoldOblique", "CourierNewPS-BoldItalicMT": "Courier-BoldOblique",
}
GLYPHS = {
    ".notdef": 0, "space": 0x20, "exclam": 0x21, "quotedbl": 0x22, "numbersign": 0x23, "dollar": 0x24, "percent": 0x25, "ampersand": 0x26, "quoteright": 0x2019, "parenleft": 0x28, "parenright": 0x29, "asterisk": 0x2A,
    "plus": 0x2B, "comma": 0x2C, "hyphen": 0x2D, "period": 0x2E, "slash": 0x2F, "zero": 0x30, "one": 0x31, "two": 0x32, "three": 0x33, "four": 0x34, "five": 0x35, "six": 0x36, "seven": 0x37, "eight": 0x38, "nine": 0x39,
    "colon": 0x3A, "semicolon": 0x3B, "less": 0x3C, "equal": 0x3D, "greater": 0x3E, "question": 0x3F, "at": 0x40, "bracketleft": 0x5B, "backslash": 0x5C, "bracketright": 0x5D, "asciicircum": 0x5E, "underscore": 0x5F,
    "quoteleft": 0x2018, "braceleft": 0x7B, "bar": 0x7C, "braceright": 0x7D, "asciitilde": 0x7E, "endash": 0x2013, "emdash": 0x2014, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotesingle": 0x27, "bullet": 0x2022,
    "ellipsis": 0x2026, "trademark": 0x2122, "copyright": 0xA9, "registered": 0xAE, "paragraph": 0xB6, "section": 0xA7, "degree": 0xB0, "plusminus": 0xB1, "multiply": 0xD7, "divide": 0xF7,
}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical_font(name: Column) -> Column:
    """A font's name without the prefix of a subset, and the standard name that it stands for."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"^[A-Z]{6}\+(?=.)", "")
    return F.coalesce(_lookup(SYNONYMS, bare), bare)


def is_standard_font(name: Column) -> Column:
    return canonical_font(name).isin(*STANDARD)


def fallback_font(name: Column) -> Column:
    """The family and style that stands in for a standard font, or null for any other."""
    c = F.lower(canonical_font(name))
    bold, italic = c.contains("bold"), c.contains("italic") | c.contains("oblique")
    style = F.when(bold & italic, "BoldItalic").when(bold, "Bold").when(italic, "Italic").otherwise("Regular")
    mono = F.concat(F.lit("NotoSansMono-"), F.when(bold, "MonoBold").otherwise("Mono"))
    family = F.when(c.startswith("times"), "NotoSerif").when(c.startswith("symbol"), "NotoSansSymbols").when(c.startswith("zapf"), "NotoSansSymbols2").otherwise("NotoSans")
    return F.when(is_standard_font(name), F.when(c.startswith("courier"), mono).otherwise(F.concat(family, F.lit("-"), style)))


def glyph_code(name: Column) -> Column:
    """The code point that a glyph name stands for: a letter itself, a listed name, uniXXXX or uXXXX to uXXXXXX; else null."""
    hexed = F.coalesce(F.nullif(F.regexp_extract(name, "^uni([0-9A-F]{4})$", 1), F.lit("")), F.nullif(F.regexp_extract(name, "^u([0-9A-F]{4,6})$", 1), F.lit("")))
    return F.when(name.rlike("^[A-Za-z]$"), F.ascii(name)).otherwise(F.coalesce(_lookup(GLYPHS, name), F.conv(hexed, 16, 10).cast("int")))


def is_private(code: Column) -> Column:
    """Whether a code point is in a private use area, or is none."""
    return code.isNull() | (code < 0) | code.between(0xE000, 0xF8FF) | code.between(0xF0000, 0xFFFFD) | code.between(0x100000, 0x10FFFD)


def map_repairs(glyphs: DataFrame) -> DataFrame:
    """Per font of glyphs in use (font_id, code, unicode, cmap_code, difference, glyph_name, ordering): coverage, missing, strategy, n_rebuilt.

    ``unicode`` is the code point of the font's own map, ``cmap_code`` that of its table, the next two are glyph names;
    private and absent ones count as missing. The first strategy that rebuilds any missing glyph is taken.
    """
    missing = is_private(F.col("unicode"))
    usable = lambda c: missing & ~is_private(c)
    tries = {
        "from-cmap-table": usable(F.col("cmap_code")), "from-differences": usable(glyph_code(F.col("difference"))), "from-agl": usable(glyph_code(F.col("glyph_name"))),
        "from-cid-ros": missing & (F.col("ordering") == "Adobe-Identity") & (F.col("code") > 0) & (F.col("code") < 0x10FFFF) & ~is_private(F.col("code")), "synthesized": missing & F.col("code").between(0x20, 0x7E),
    }
    by = glyphs.groupBy("font_id").agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in tries.items()])
    found = F.when(F.col("n_missing") == 0, F.struct(F.lit(None).cast("string").alias("strategy"), F.lit(0).cast("long").alias("n_rebuilt")))
    for k in tries:
        found = found.when(F.col(f"`{k}`") > 0, F.struct(F.lit(k).alias("strategy"), F.col(f"`{k}`").alias("n_rebuilt")))
    found = found.otherwise(F.struct(F.lit("impossible").alias("strategy"), F.lit(0).cast("long").alias("n_rebuilt")))
    return by.select("font_id", ((F.col("n") - F.col("n_missing")) / F.col("n")).alias("coverage"), "n_missing", found.alias("f")).select("font_id", "coverage", "n_missing", "f.*")
