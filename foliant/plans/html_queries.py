"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import html as H
from foliant.plans.registry import Registry
from foliant.sources.tables import read_table

HTML = Registry()

_STRIP = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_INNER = _STRIP.replace("(html,", "(e,")
_EL = lambda tag: rf"regexp_extract_all(html, '(?is)<{tag}\b[^>]*>.*?</{tag}>')"
_ATTR = lambda e, n: rf"""trim(regexp_extract(regexp_extract({e}, '(?s)^<[^>]*>'), '(?i)\s{n}\s*=\s*["'']([^"'']*)["'']', 1))"""
_LEVELS = r"list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>'), lambda e: e[3]::INT)"


@HTML.query("page_text", f"SELECT page_id, {_STRIP} AS text FROM pages")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """Operator 224: visible text of every page."""
    return read_table(spark, d, "pages").select("page_id", H.strip_tags(F.col("html")).alias("text"))


AUDIT_SQL = rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), l AS (SELECT page_id, {_LEVELS} AS lv FROM p), a AS (
SELECT page_id, 'document-language' AS issue, 'error' AS severity, ({_ATTR(r"regexp_extract(html, '(?is)<html\b[^>]*>')", 'lang')} = '')::INT AS n FROM p UNION ALL
SELECT page_id, 'document-title', 'error', (coalesce(list_transform({_EL('title')}, lambda e: {_INNER})[1], '') = '')::INT FROM p UNION ALL
SELECT page_id, 'main-landmark', 'error', (len({_EL('main')}) <> 1)::INT FROM p UNION ALL SELECT page_id, 'single-h1', 'error', (len({_EL('h1')}) <> 1)::INT FROM p UNION ALL
SELECT page_id, 'heading-order', 'error', len(list_filter(generate_series(2, len(lv)), lambda i: lv[i] > lv[i - 1] + 1)) FROM l UNION ALL
SELECT page_id, 'image-alt', 'error', len(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*>'), lambda e: {_ATTR('e', 'alt')} = '' AND {_ATTR('e', 'role')} <> 'presentation' AND {_ATTR('e', 'data-artifact')} <> 'true' AND {_ATTR('e', 'aria-hidden')} <> 'true')) FROM p UNION ALL
SELECT page_id, 'figure-caption', 'warning', len(list_filter({_EL('figure')}, lambda e: NOT regexp_matches(e, '(?i)<figcaption\b'))) FROM p UNION ALL
SELECT page_id, 'table-caption', 'error', len(list_filter({_EL('table')}, lambda e: NOT regexp_matches(e, '(?i)<caption\b'))) FROM p UNION ALL
SELECT page_id, 'table-headers', 'error', len(list_filter({_EL('table')}, lambda e: NOT regexp_matches(e, '(?i)<th\b'))) FROM p UNION ALL
SELECT page_id, 'table-header-scope', 'warning', len(list_filter(flatten(list_transform({_EL('table')}, lambda e: regexp_extract_all(e, '(?is)<th\b[^>]*>.*?</th>'))), lambda e: NOT regexp_matches(regexp_extract(e, '(?s)^<[^>]*>'), '(?i)\s(?:scope|id)\b'))) FROM p UNION ALL
SELECT page_id, 'form-label', 'error', len(list_filter(list_concat(list_concat(regexp_extract_all(html, '(?i)<input\b[^>]*>'), {_EL('select')}), {_EL('textarea')}), lambda e: lower({_ATTR('e', 'type')}) <> 'hidden' AND {_ATTR('e', 'aria-hidden')} <> 'true'
  AND NOT list_contains(list_filter(list_transform({_EL('label')}, lambda l: {_ATTR('l', 'for')}), lambda f: f <> ''), {_ATTR('e', 'id')}) AND NOT regexp_matches(regexp_extract(e, '(?s)^<[^>]*>'), '(?i)\saria-label(?:ledby)?\b'))) FROM p UNION ALL
SELECT page_id, 'link-target', 'error', len(list_filter({_EL('a')}, lambda e: {_ATTR('e', 'href')} = '')) FROM p UNION ALL
SELECT page_id, 'link-purpose', 'warning', len(list_filter({_EL('a')}, lambda e: {_INNER} = '' OR lower({_INNER}) IN ('click here', 'here', 'read more', 'more', 'learn more'))) FROM p UNION ALL
SELECT page_id, 'css-reading-order', 'warning', regexp_matches(html, '(?i)\b(order|grid-area)\s*:')::INT FROM p UNION ALL
SELECT page_id, 'metadata-author', 'warning', (NOT regexp_matches(html, '(?i)<meta\b[^>]+name=["'']author["'']'))::INT FROM p UNION ALL
SELECT page_id, 'metadata-subject', 'warning', (NOT regexp_matches(html, '(?i)<meta\b[^>]+name=["'']subject["'']'))::INT FROM p)"""


@HTML.query("html_audit", f"{AUDIT_SQL} SELECT page_id, issue, severity, n::BIGINT AS n FROM a WHERE n > 0")
def html_audit(spark: SparkSession, d: str) -> DataFrame:
    """Operators 225 to 227: issues of every page."""
    return H.audit(read_table(spark, d, "pages"))


@HTML.query("html_summary", f"{AUDIT_SQL}, s AS (SELECT page_id, sum(n) FILTER (severity = 'error') AS e, sum(n) FILTER (severity = 'warning') AS w FROM a GROUP BY 1) SELECT page_id, e::BIGINT AS errors, w::BIGINT AS warnings, greatest(0, 100 - e * 18 - w * 6)::BIGINT AS score, e = 0 AS ready FROM s")
def html_summary(spark: SparkSession, d: str) -> DataFrame:
    """Operator 229: score of every page."""
    return H.summary(read_table(spark, d, "pages"))


_TAGS = {"h1": "H1", "h2": "H2", "h3": "H3", "p": "P", "li": "LI", "ul": "L", "ol": "L", "table": "Table", "tr": "TR", "td": "TD", "th": "TH", "section": "Sect", "article": "Sect", "figure": "Figure", "main": "Document"}


@HTML.query("structure_roles", " UNION ALL ".join(f"SELECT page_id, '{role}' AS role, '{tag}' AS tag, len({_EL(tag)})::BIGINT AS n FROM pages WHERE len({_EL(tag)}) > 0" for tag, role in _TAGS.items()))
def structure_roles(spark: SparkSession, d: str) -> DataFrame:
    """Operator 228: elements of a page by role."""
    n = [F.struct(F.lit(role).alias("role"), F.lit(tag).alias("tag"), F.size(H.elements(F.col("html"), tag)).cast("long").alias("n")) for tag, role in _TAGS.items()]
    return read_table(spark, d, "pages").select("page_id", F.inline(F.array(*n))).where("n > 0")
