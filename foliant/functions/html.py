"""Structural audit of HTML source by patterns: elements, attributes, issues, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link texts that name no purpose.
GENERIC = ("click here", "here", "read more", "more", "learn more")


def strip_tags(html: Column) -> Column:
    """Visible text: without scripts, styles and tags."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style.*?</style>", ""), "<[^>]+>", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def elements(html: Column, tag: str) -> Column:
    """Array of raw elements, each up to its first closing tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), 0)


def void_elements(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\b[^>]*>"), 0)


def attribute(raw: Column, name: str) -> Column:
    """Value of a quoted attribute in the opening tag; empty if missing."""
    head = F.regexp_extract(raw, r"(?s)^<[^>]*>", 0)
    return F.regexp_extract(head, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _head(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)^<[^>]*>", 0)


def unlabelled_fields(html: Column) -> Column:
    """Array of form fields without a label for their id and without an accessible name; hidden fields don't count."""
    opening = lambda tag: F.transform(elements(html, tag), _head)
    fields = F.concat(void_elements(html, "input"), opening("select"), opening("textarea"))
    targets = F.filter(F.transform(elements(html, "label"), lambda e: attribute(e, "for")), lambda x: x != "")
    named = lambda e: F.array_contains(targets, attribute(e, "id")) | e.rlike(r"(?i)\saria-label(?:ledby)?\b")
    shown = lambda e: (F.lower(attribute(e, "type")) != "hidden") & (attribute(e, "aria-hidden") != "true")
    return F.filter(fields, lambda e: shown(e) & ~named(e))


def unscoped_headers(html: Column) -> Column:
    """Array of opening tags of header cells in tables that have neither scope nor id."""
    heads = F.flatten(F.transform(elements(html, "table"), lambda e: F.transform(elements(e, "th"), _head)))
    return F.filter(heads, lambda e: ~e.rlike(r"(?i)\s(?:scope|id)\b"))


def audit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, issue, severity, n): findings of a page; issues that do not occur have no row."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    count = lambda found, bad: F.size(F.filter(found, bad))
    lacks = lambda pattern: lambda e: ~e.rlike(pattern)
    one = lambda cond: cond.cast("int")
    inner = lambda e: strip_tags(e)
    levels = F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h\1>"), 1), lambda x: x.cast("int"))
    skips = F.size(F.filter(F.transform(levels, lambda x, i: (i > 0) & (x > F.get(levels, i - 1) + 1)), lambda x: x))
    root = F.regexp_extract(h, r"(?is)<html\b[^>]*>", 0)
    found = {
        ("document-language", "error"): one(F.btrim(attribute(root, "lang")) == ""),
        ("document-title", "error"): one(F.coalesce(inner(F.get(elements(h, "title"), F.lit(0))), F.lit("")) == ""),
        ("main-landmark", "error"): one(F.size(elements(h, "main")) != 1),
        ("single-h1", "error"): one(F.size(elements(h, "h1")) != 1),
        ("heading-order", "error"): skips,
        ("image-alt", "error"): count(void_elements(h, "img"), lambda e: (F.btrim(attribute(e, "alt")) == "") & (attribute(e, "role") != "presentation") & (attribute(e, "data-artifact") != "true") & (attribute(e, "aria-hidden") != "true")),
        ("figure-caption", "warning"): count(elements(h, "figure"), lacks(r"(?i)<figcaption\b")),
        ("table-caption", "error"): count(elements(h, "table"), lacks(r"(?i)<caption\b")),
        ("table-headers", "error"): count(elements(h, "table"), lacks(r"(?i)<th\b")),
        ("table-header-scope", "warning"): F.size(unscoped_headers(h)),
        ("form-label", "error"): F.size(unlabelled_fields(h)),
        ("link-target", "error"): count(elements(h, "a"), lambda e: F.btrim(attribute(e, "href")) == ""),
        ("link-purpose", "warning"): count(elements(h, "a"), lambda e: (inner(e) == "") | F.lower(inner(e)).isin(*GENERIC)),
        ("css-reading-order", "warning"): one(h.rlike(r"(?i)\b(order|grid-area)\s*:")),
        ("metadata-author", "warning"): one(~h.rlike(r"""(?i)<meta\b[^>]+name=["']author["']""")),
        ("metadata-subject", "warning"): one(~h.rlike(r"""(?i)<meta\b[^>]+name=["']subject["']""")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("issue"), F.lit(s).alias("severity"), n.cast("long").alias("n")) for (k, s), n in found.items()])
    return pages.select(F.col(id_col).alias("page_id"), F.inline(rows)).where("n > 0")


def summary(pages: DataFrame) -> DataFrame:
    """(page_id, errors, warnings, score, ready)."""
    by = audit(pages).groupBy("page_id").agg(F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"), F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"))
    out = pages.select("page_id").join(by, "page_id", "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("score", F.greatest(F.lit(0), 100 - F.col("errors") * 18 - F.col("warnings") * 6)).withColumn("ready", F.col("errors") == 0)
