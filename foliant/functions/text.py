"""Text scalars: normalization, token classes, OCR ratios, similarities, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space in texts, Unicode spaces and the byte order mark included.
SPACE = "[\\t\\n\\x0B\\f\\r    -     　﻿]"
# Compact numbers, and social security numbers; areas 000 and 666 are not assigned, areas from 900 are masked too.
NUMERIC = r"(?i)^-?(?:[$£€¥])?(?:\d+(?:[.,]\d+)*|\d*\.\d+)(?:%)?$|^n/a$"
SSN = r"(?<!\d)(?:(?!000|666)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}|(?!000|666)\d{3}(?!00)\d{2}(?!0000)\d{4})(?!\d)"
# Tokens that recognition garbles, fonts that scanning software hides its text in, and traces of scans.
GARBAGE_TOKENS = (r"^(.)\1{3,}$", "(_[a-zA-Z]{1,3}){2,}")
OCR_FONTS = r"(?i)hidden\s*(horz|vert)?\s*ocr|\bocr[-_ ]?[ab]\b|invisible.*text"
SCAN_ARTIFACTS = (r"(.)\1{15,}", "(_[a-zA-Z]{1,3}){3,}")


def is_plain(text: Column, odd: str = " \t\n\x0b\f\r") -> Column:
    """Whether a text is ASCII and holds none of ``odd``, of which a space stands for two in a row."""
    found = F.lit(False)
    for c in odd:
        found = found | text.contains("  " if c == " " else c)
    return (F.length(text) == F.octet_length(text)) & ~found


def normalize_text(text: Column) -> Column:
    """White space runs as one space, none at either end; null is empty."""
    t = F.coalesce(text, F.lit(""))
    # Most texts have single plain spaces only, which a search for the other ASCII ones shows without a pattern.
    return F.btrim(F.when(is_plain(t), t).otherwise(F.regexp_replace(t, SPACE + "+", " ")))


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def is_numeric_token(text: Column) -> Column:
    """A compact number: sign, currency, digits, percent; or n/a."""
    return normalize_text(text).rlike(NUMERIC)


def looks_numeric(text: Column) -> Column:
    """Has a digit, a currency sign or a percent sign."""
    return text.rlike("[0-9$£€¥%]")


def looks_header(text: Column) -> Column:
    """A short label: a letter or other non-ASCII character, and nothing numeric."""
    t = normalize_text(text)
    return (F.length(t) > 0) & (F.length(t) <= 48) & t.rlike("[A-Za-z\\u0080-\\uFFFF]") & ~looks_numeric(t)


def is_garbage_token(token: Column) -> Column:
    """One character repeated, mostly signs, or underscores between letters."""
    signs = F.length(F.regexp_replace(token, "[a-zA-Z0-9]", ""))
    return token.rlike(GARBAGE_TOKENS[0]) | (signs > 0.5 * F.length(token)) | token.rlike(GARBAGE_TOKENS[1])


def is_ocr_font(font: Column) -> Column:
    """Names of fonts that scanning software hides recognized text in."""
    return F.coalesce(font, F.lit("")).rlike(OCR_FONTS)


def has_scan_artifact(text: Column) -> Column:
    """A long run of one character, or several underscore tokens in a row."""
    return text.rlike(SCAN_ARTIFACTS[0]) | text.rlike(SCAN_ARTIFACTS[1])


def suspicious_ratio(text: Column, tight: Column | None = None) -> Column:
    """Share of characters outside letters, digits and common punctuation; 1 for an empty text. ``tight``: the text without spaces, if that is at hand."""
    t = without_space(text) if tight is None else tight
    odd = F.regexp_count(t, F.lit("[^A-Za-z0-9.,;:!?()'\"%$&+\\-/]"))
    return F.when(F.length(t) == 0, F.lit(1.0)).otherwise(odd / F.nullif(F.length(t), F.lit(0)))


def repeated_ratio(text: Column, tight: Column | None = None) -> Column:
    """Share of characters in runs of three or more; 1 for an empty text. ``tight``: the text without spaces, if that is at hand."""
    t = without_space(text) if tight is None else tight
    runs = F.length(t) - F.length(F.regexp_replace(t, r"(.)\1{2,}", ""))
    return F.when(F.length(t) == 0, F.lit(1.0)).otherwise(runs / F.nullif(F.length(t), F.lit(0)))


def comparable(text: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(normalize_text(text)), "[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    """The set of neighbouring character pairs of a comparable text; a single character stands for itself."""
    t = comparable(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def dice(left: Column, right: Column) -> Column:
    """Dice similarity of two sets; two empty ones are equal."""
    n = F.size(left) + F.size(right)
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / F.nullif(n, F.lit(0)))


def bigram_list(text: Column) -> Column:
    """All neighbouring pairs of a text, repeats included; none for a single character."""
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def multiset_jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two lists with repeats."""
    times = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    both = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda a, g: a + F.least(times(left, g), times(right, g)))
    return F.coalesce(F.try_divide(both, F.size(left) + F.size(right) - both), F.lit(0.0))


def candidate_score(confidence: Column, chars: Column, words: Column, blocks: Column, alnum: Column, suspicious: Column, repeated: Column) -> Column:
    """Score of a recognition result from 0 to 1, three decimals; nothing recognized is 0."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    total = unit(confidence / 100) * 0.42 + unit(chars / 180) * 0.24 + unit(words / 32) * 0.12 + unit(blocks / 10) * 0.05 + unit(alnum) * 0.17 - unit(suspicious) * 0.12 - unit(repeated) * 0.08
    return F.when((chars == 0) | (blocks == 0), F.lit(0.0)).otherwise(F.round(unit(total), 3))


def final_score(score: Column, consensus: Column) -> Column:
    """A candidate's score with what the other candidates of its page agree on, three decimals."""
    return F.round(score * 0.82 + consensus * 0.18, 3)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap over union of two boxes (x, y, w, h)."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.when(w * h == 0, F.lit(0.0)).otherwise(w * h / F.greatest(a[2] * a[3] + b[2] * b[3] - w * h, F.lit(1.0)))


def rotation(a: Column, b: Column) -> Column:
    """Nearest quarter turn of a text matrix."""
    degrees = F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))
    return (F.floor(degrees / 90 + 0.5) * 90 % 360).cast("int")


def find_ssn(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SSN), 0)


def mask_ssn(text: Column) -> Column:
    """Every number with all but its last four digits masked."""
    grouped = r"(?<!\d)(?:(?!000|666)\d{3}[- ](?!00)\d{2}[- ](?!0000)(\d{4})|(?!000|666)\d{3}(?!00)\d{2}(?!0000)(\d{4}))(?!\d)"
    return F.regexp_replace(text, grouped, "***-**-$1$2")


def masked_digits(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.concat(F.lit("***-**-"), F.right(digits, F.lit(4)))).otherwise("***-**-****")


def match_text(text: Column) -> Column:
    """For matching: without soft hyphens, zero-width and control characters, no-break spaces as spaces, lower case."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u00ad\\u200b-\\u200d\\ufeff\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    return F.lower(normalize_text(F.replace(t, F.lit(" "), F.lit(" "))))


def is_rtl(text: Column) -> Column:
    return text.rlike("[\\u0590-\\u05ff\\u0600-\\u06ff\\u0750-\\u077f]")


def finding_code(value: Column) -> Column:
    """Upper case with everything else as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(value), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def language_tag(value: Column, fallback: str = "en-US") -> Column:
    """Canonical xx-YY form of a language tag."""
    t = F.lower(F.replace(F.btrim(F.coalesce(value, F.lit(""))), F.lit("_"), F.lit("-")))
    pair = F.concat(F.substring(t, 1, 2), F.lit("-"), F.upper(F.substring(t, 4, 2)))
    return F.when(t.isin("es", "es-es"), "es-ES").when(t.isin("en", "en-us"), "en-US").when(t.rlike("^[a-z]{2}-[a-z]{2}$"), pair).otherwise(fallback)


def ocr_languages(value: Column) -> Column:
    """Requested recognition languages: split at plus and comma, with common names, each once."""
    def name(c: Column) -> Column:
        c = F.lower(F.btrim(c))
        return F.when(c.isin("eng", "en", "en-us", "english"), "eng").when(c.isin("spa", "es", "es-es", "spanish"), "spa").otherwise(c)

    return F.array_distinct(F.filter(F.transform(F.split(value, "[+,]"), name), lambda c: c != ""))


# Expansions of abbreviations.
ABBREVIATIONS = {
    "W3C": "World Wide Web Consortium", "URL": "Uniform Resource Locator", "URI": "Uniform Resource Identifier", "HTML": "HyperText Markup Language", "HTTP": "HyperText Transfer Protocol",
    "HTTPS": "HyperText Transfer Protocol Secure", "PDF": "Portable Document Format", "XML": "Extensible Markup Language", "JSON": "JavaScript Object Notation", "API": "Application Programming Interface",
    "USA": "United States of America", "UK": "United Kingdom", "EU": "European Union", "UN": "United Nations", "NYC": "New York City", "ISO": "International Organization for Standardization",
    "IEEE": "Institute of Electrical and Electronics Engineers", "NASA": "National Aeronautics and Space Administration", "FBI": "Federal Bureau of Investigation", "CEO": "Chief Executive Officer",
    "CIO": "Chief Information Officer", "CFO": "Chief Financial Officer",
}


def abbreviation_spans(text: Column, known_only: bool = True) -> Column:
    """Array of (token, start, end, expansion) for the known abbreviations that stand alone, in code points, end exclusive; or also for unknown ones of capitals alone."""
    pattern = "(?<![A-Za-z0-9])[A-Z0-9]{2,6}(?![A-Za-z0-9])"
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    tokens, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern)
    sizes = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, v: s + F.length(v))
    spans = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (sizes(between, i + 1) + sizes(tokens, i)).alias("start"), (sizes(between, i + 1) + sizes(tokens, i + 1)).alias("end"), F.try_element_at(known, t).alias("expansion")))
    return F.filter(spans, lambda s: s["expansion"].isNotNull() if known_only else s["expansion"].isNotNull() | s["token"].rlike("^[A-Z]+$"))


# Fixed value: families of fonts with letters of one width.
MONOSPACE = (
    "courier", "notosansmono", "consolas", "menlo", "source code pro", "sourcecodepro", "fira code", "firacode", "inconsolata", "roboto mono", "robotomono", "jetbrains mono", "jetbrainsmono", "ubuntu mono", "ubuntumono",
    "liberation mono", "liberationmono",
)


def run_style(font: Column, weight: Column, style: Column) -> Column:
    """Struct bold, italic, mono of a run of text, by its font's name or its own weight (a number or a word) and style."""
    name = F.lower(F.coalesce(font, F.lit("")))
    bold = (F.coalesce(weight.try_cast("double"), F.lit(0.0)) >= 600) | F.lower(F.coalesce(weight, F.lit(""))).contains("bold") | name.rlike("bold|black|heavy|semibold|demibold")
    italic = F.lower(F.coalesce(style, F.lit(""))).rlike("italic|oblique") | name.rlike("italic|oblique")
    mono = name.rlike(r"(^|[-_ ,+])mono(space)?([-_ ,+].*)?$")
    for family in MONOSPACE:
        mono = mono | name.contains(family)
    return F.struct(bold.alias("bold"), italic.alias("italic"), mono.alias("mono"))
