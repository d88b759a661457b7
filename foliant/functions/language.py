"""Language, script and profile signals of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import normalize_text

# Word lists of the language test.
EN_STOP = "the and of to in is for with on that this by from as are be or an at it not under into".split()
EN_MARK = "the and with from this that first second report note".split()
ES_STOP = "el la los las y de del en para con por una un este esta que como se es al donde está estan están".split()
ES_SUFFIX = "ón$|ciones$|mente$|idad$|idades$|amiento$|amientos$"
# Patterns of legal citations.
CITATIONS = (
    r"\bv\.\s+[A-Z]", r"\bNo\.\s*\d{1,3}[-–]\d{2,}", r"\b\d+\s+U\.S\.\s+\d+\b", r"\b\d+\s+F\.\d+d\s+\d+\b", r"\bSee,?\s+e\.g\.,", r"(?i)\bet\s+seq\.\b",
    r"¶\s*\d+", r"§\s*\d+", r"\bSlip\s+[Oo]p\.\b", r"\bDkt\.\s+No\.",
)
# Code points by script, and names of producing software.
SCRIPTS = {
    "latin": "\\u0020-\\u024F", "cjk": "\\u3000-\\u303F\\u3040-\\u309F\\u30A0-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uFF00-\\uFFEF",
    "arabic": "\\u0600-\\u06FF\\u0750-\\u077F", "hebrew": "\\u0590-\\u05FF", "cyrillic": "\\u0400-\\u04FF\\u0500-\\u052F",
}
SCIENTIFIC = ("pdftex", "luahbtex", "xetex", "dvips", "ghostscript", "pikepdf", "tex live", "miktex")
FORMS = ("designer 6", "designer 7", "designer 8", "designer 9", "designer 10", "designer 11", "livecycle", "adobe acroform", "foxit phantom", "pdfelement", "nitro pdf")


def detect_language(text: Column) -> Column:
    """Struct language, confidence, n_words, english, spanish; only these two languages are told apart."""
    t = F.lower(normalize_text(text))
    # A word is a run of letters, so one count per list finds the words that stand alone, without an array of words.
    hits = lambda listed: F.regexp_count(t, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(listed)})(?!\p{{L}})"))
    n_words = F.regexp_count(t, F.lit(r"\p{L}+"))
    endings = F.regexp_count(t, F.lit(rf"(?:{ES_SUFFIX.replace('$', '')})(?!\p{{L}})"))
    accents = F.regexp_count(t, F.lit("[áéíóúñü¿¡]"))
    english = hits(EN_STOP) * 1.45 + hits(EN_MARK) * 0.65
    spanish = hits(ES_STOP) * 1.45 + accents * 2.2 + endings * 0.9 + F.regexp_count(t, F.lit("[¿¡]")) * 2.5
    counted = F.struct(n_words.alias("n"), accents.alias("accents"), english.alias("en"), spanish.alias("es"))
    return F.transform(F.array(counted), _language)[0]


def _language(c: Column) -> Column:
    n, en, es = c["n"], c["en"], c["es"]
    top, low = F.greatest(en, es), F.least(en, es)
    unknown = (n > 0) & (top < 1.25) & (c["accents"] == 0) & (n < 5)
    sure = 0.42 + (top - low) / F.greatest(top + low, F.lit(1.0)) * 0.46 + F.least(n / 24, F.lit(0.12))
    return F.struct(
        F.when((n == 0) | unknown, "und").when(es > en, "es-ES").otherwise("en-US").alias("language"),
        F.when(n == 0, F.lit(0.0)).when(unknown, F.lit(0.2)).otherwise(F.round(F.least(sure, F.lit(0.99)), 3)).alias("confidence"),
        n.cast("long").alias("n_words"), F.round(en, 3).alias("english"), F.round(es, 3).alias("spanish"),
    )


def recognition_plan(explicit: Column, language: Column, confidence: Column) -> Column:
    """Struct languages, strategy, hint: explicit ones, else Spanish first, else English if sure, else both."""
    hint = F.coalesce(language, F.lit("und"))
    pick = lambda langs, name, h: F.struct(langs.alias("languages"), F.lit(name).alias("strategy"), h.alias("hint"))
    both = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(F.size(explicit) > 0, pick(explicit, "explicit", hint)).when(language == "es-ES", pick(both("spa", "eng"), "detected-spanish", hint))
        .when((language == "en-US") & (confidence >= 0.75), pick(both("eng"), "detected-english", hint)).otherwise(pick(both("eng", "spa"), "bilingual-fallback", hint))
    )


def script_counts(text: Column) -> Column:
    """Struct of characters by script and of others; spaces and control characters don't count."""
    # A count is what a text loses with runs of these characters; what is neither latin nor skipped is looked for in texts beyond ASCII only.
    without = lambda t, chars: F.regexp_replace(t, F.lit(f"[{chars}]+"), F.lit(""))
    beyond = F.when(F.octet_length(text) == F.length(text), "").otherwise(without(text, "\\u0000-\\u024F"))
    n = F.length(beyond)
    latin = F.length(without(text, "\\u0000-\\u0020\\u0080-\\u009F")) - n
    rest = {s: n - F.length(without(beyond, SCRIPTS[s])) for s in SCRIPTS if s != "latin"}
    return F.struct(latin.alias("latin"), *[c.alias(s) for s, c in rest.items()], (n - sum(rest.values(), F.lit(0))).alias("other"))


def dominant_script(counts: Column) -> Column:
    """Struct script, ratio: the most frequent one (first of equals), unknown below twenty characters."""
    total = sum((counts[s] for s in (*SCRIPTS, "other")), F.lit(0))
    top = F.greatest(*[counts[s] for s in SCRIPTS])
    name = F.when(top == 0, "other")
    for s in SCRIPTS:
        name = name.when(counts[s] == top, s)
    few = total < 20
    return F.struct(F.when(few, "unknown").otherwise(name).alias("script"), F.when(few, F.lit(0.0)).otherwise(top / F.nullif(total, F.lit(0))).alias("ratio"))


def citation_density(text: Column) -> Column:
    """Legal citations in a thousand characters; 0 for texts under a hundred."""
    hits = sum((F.regexp_count(text, F.lit(p)) for p in CITATIONS), F.lit(0))
    return F.when(F.length(text) < 100, F.lit(0.0)).otherwise(hits / F.nullif(F.length(text), F.lit(0)) * 1000)


def route_profile(ops_per_page: Column, n_pages: Column, has_form: Column, producer: Column, script: Column, ratio: Column, density: Column) -> Column:
    """Struct profile, confidence: scanned, forms, cjk, legal, scientific or default, in this order."""
    made = F.lower(F.coalesce(producer, F.lit("")))
    by = lambda names: F.greatest(*[made.contains(x).cast("int") for x in names]) == 1
    out = lambda name, sure: F.struct(F.lit(name).alias("profile"), sure.alias("confidence"))
    return (
        F.when((ops_per_page == 0) & (n_pages > 0), out("scanned-low-quality", F.lit(0.95)))
        .when(has_form & (by(FORMS) | (ops_per_page <= 200)), out("forms-heavy", F.when(by(FORMS), 0.95).otherwise(0.75)))
        .when((script == "cjk") & (ratio >= 0.3), out("cjk", F.when(ratio >= 0.6, 0.95).otherwise(0.8)))
        .when((density >= 0.5) & (script == "latin") & (ratio >= 0.7), out("legal", F.when(density >= 1.0, 0.9).otherwise(0.7)))
        .when(by(SCIENTIFIC), out("scientific", F.lit(0.85))).otherwise(out("default", F.lit(0.6)))
    )
