"""Known cases of single operators."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import html as H
from foliant.functions import language as L
from foliant.functions import text as T
from foliant.operators import layout as O
from foliant.operators import scores as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def nodes(spark, rows):
    schema = "doc_id long, page_number int, seq int, block_id string, text string, x double, y double, w double, h double, font_size double, font_name string, column_hint int, role string"
    full = [(1, p, k, i, t, x, y, w, 12.0, 12.0, "Times", c, r) for k, (p, i, t, x, y, w, c, r) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_numbers_are_found_and_masked(spark):
    t = F.lit("Primary 123-45-6789 Backup 987654321 Tax ID 12-3456789")
    r = one(spark, found=T.find_ssn(t), masked=T.mask_ssn(t), near=T.find_ssn(F.lit("12-3456789 123-45-678 000-12-3456 666121234")))
    assert r.found == ["123-45-6789", "987654321"] and r.near == []
    assert r.masked == "Primary ***-**-6789 Backup ***-**-4321 Tax ID 12-3456789"
    again = one(spark, m=T.mask_ssn(F.lit(r.masked)))
    assert again.m == r.masked


def test_reading_order_by_column_and_on_a_line(spark):
    df = nodes(spark, [(1, "a", "a", 72.0, 100.0, 50.0, 0, "P"), (1, "b", "b", 330.0, 20.0, 50.0, 1, "P"), (1, "c", "c", 72.0, 200.0, 50.0, 0, "P")])
    assert {r.block_id: r.reading_order for r in O.reading_order(df).collect()} == {"a": 0, "c": 1, "b": 2}
    df = nodes(spark, [(1, "paul", "p", 70.0, 141.0, 50.0, 0, "P"), (1, "amp", "&", 419.0, 141.0, 50.0, 0, "P"), (1, "dec", "d", 358.0, 142.0, 50.0, 0, "P")])
    assert [r.block_id for r in sorted(O.reading_order(df).collect(), key=lambda r: r.reading_order)] == ["paul", "dec", "amp"]


def test_order_is_a_permutation_and_merging_keeps_blocks(spark):
    rows = [(1 + k // 9, f"b{k}", f"line {k}" + "." * (k % 2), 72.0 + 30 * (k % 4 == 3), 72.0 + 14 * k + 60 * (k // 5), 200.0, 0, "P") for k in range(20)]
    df = nodes(spark, rows)
    assert {(r.page_number, r.block_id) for r in O.reading_order(df).collect()} == {(r[0], r[1]) for r in rows}
    merged = [b for r in O.merge_paragraphs(O.paragraph_groups(df)).collect() for b in r.merged_from]
    assert sorted(merged) == sorted(r[1] for r in rows)


def test_clusters_drift_with_their_mean(spark):
    r = one(spark, c=O.drifting_clusters(F.array(*[F.lit(float(v)) for v in (0, 5, 9, 13, 17)]), 6.0))
    assert [c.n for c in r.c] == [2, 3]


def test_language(spark):
    r = one(spark, en=L.detect_language(F.lit("The report is from the first of this series.")), es=L.detect_language(F.lit("¿Dónde está la información de los niños?")), no=L.detect_language(F.lit("")))
    assert (r.en.language, r.es.language, r.no.language) == ("en-US", "es-ES", "und") and r.no.confidence == 0
    r = one(spark, a=L.recognition_plan(F.array().cast("array<string>"), F.lit("en-US"), F.lit(0.8)), b=L.recognition_plan(F.array().cast("array<string>"), F.lit("en-US"), F.lit(0.5)), c=T.ocr_languages(F.lit("Spanish, en+eng")))
    assert (r.a.strategy, r.b.strategy, r.c) == ("detected-english", "bilingual-fallback", ["spa", "eng"])


@pytest.mark.parametrize("pages,form,made,script,ratio,density,want", [
    (0.0, True, "Designer 6", "latin", 1.0, 2.0, "scanned-low-quality"), (500.0, True, "Adobe LiveCycle", "latin", 1.0, 0.0, "forms-heavy"), (500.0, True, "iText", "cjk", 0.4, 0.0, "cjk"),
    (50.0, False, "", "latin", 0.9, 0.6, "legal"), (50.0, False, "pdfTeX", "latin", 0.9, 0.1, "scientific"), (50.0, False, None, "latin", 0.9, 0.1, "default"),
])
def test_profiles(spark, pages, form, made, script, ratio, density, want):
    r = one(spark, p=L.route_profile(F.lit(pages), F.lit(3), F.lit(form), F.lit(made), F.lit(script), F.lit(ratio), F.lit(density)))
    assert r.p.profile == want


def test_tokens(spark):
    good, bad = ["-$1,234.50", "12%", "n/a", ".5", "N/A"], ["12a", "", "$", "1,2,"]
    r = one(spark, g=F.array(*[T.is_numeric_token(F.lit(x)) for x in good]), b=F.array(*[T.is_numeric_token(F.lit(x)) for x in bad]))
    assert all(r.g) and not any(r.b)
    r = one(spark, g=F.array(*[T.is_garbage_token(F.lit(x)) for x in ("1111", "_Cou_nty_of", "#$%a")]), b=T.is_garbage_token(F.lit("word")), s=T.has_scan_artifact(F.lit("_Cou_nty_of")))
    assert all(r.g) and not r.b and r.s


def test_scores(spark):
    nothing = F.lit(None).cast("double")
    r = one(
        spark, all_=S.aggregate_score(F.lit(2), F.lit(1.0), F.lit(0), F.lit(90.0), F.lit(1.0)), none=S.aggregate_score(*[nothing] * 5), some=S.aggregate_score(F.lit(1), *[nothing] * 4),
        v=S.verdict(F.lit(0.95), F.lit(0.9), F.lit(0.4), F.lit(True)), health=S.repair_health(F.lit(2), F.lit(1), F.lit(1), F.lit(0), F.lit(3)), font=S.font_score(nothing, F.lit(3)),
    )
    assert r.all_ == pytest.approx(0.4 / 3 + 0.2 + 0.15 + 0.135 + 0.1) and r.none is None and r.some == 0.5
    assert (r.v.verdict, r.v.confidence, r.health, r.font) == ("native-recommended", 1.0, 0.68, 0.5)
    assert (O.common_length(list("abcd"), list("abcd")), O.common_length([], list("ab"))) == (4, 0)


def test_footnotes(spark):
    rows = [(1, f"b{k}", "Body text.", 72.0, 72.0 + 20 * k, 300.0, 0, "P") for k in range(8)] + [(1, "m", "1", 72.0, 640.0, 6.0, 0, "P"), (1, "n", "note goes on", 84.0, 640.0, 200.0, 0, "P"), (1, "o", "2 other note", 72.0, 660.0, 200.0, 0, "P")]
    df = nodes(spark, rows).withColumn("font_size", F.when(F.col("y") > 600, 8.0).otherwise(12.0))
    assert {(r.block_id, r.footnote, r.marker) for r in O.footnotes(df).collect()} == {("m", 1, "1"), ("n", 1, "1"), ("o", 2, "2")}


def test_html_audit(spark):
    page = """<html><head><title>T</title></head><body><main><h1>A</h1><h3>B</h3><img src="x"><img alt="ok"><a href="/x">click here</a><table><tr><td>1</td></tr></table></main></body></html>"""
    found = {r.issue: r.n for r in H.audit(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()}
    assert found == {"document-language": 1, "heading-order": 1, "image-alt": 1, "link-purpose": 1, "table-caption": 1, "table-headers": 1, "metadata-author": 1, "metadata-subject": 1}
    assert H.summary(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).where("page_id = 1").first().score == 0


def test_form_fields_and_header_cells(spark):
    page = """<label for="a">A</label><input id="a"><input id="b"><input type="hidden"><textarea aria-label="x"></textarea><select><option></select><table><tr><th scope="col">1</th><th>2</th></tr></table>"""
    r = spark.createDataFrame([(page,)], "h string").select(H.unlabelled_fields(F.col("h")).alias("f"), H.unscoped_headers(F.col("h")).alias("t")).first()
    assert r.f == ['<input id="b">', "<select>"] and r.t == ["<th>"]


def test_similarity(spark):
    r = one(spark, same=T.dice(T.bigrams(F.lit("Abc d")), T.bigrams(F.lit("abc  D!"))), none=T.dice(T.bigrams(F.lit("")), T.bigrams(F.lit(None).cast("string"))), box=T.iou([F.lit(float(v)) for v in (0, 0, 10, 10)], [F.lit(float(v)) for v in (5, 0, 10, 10)]))
    assert r.same == 1.0 and r.none == 1.0 and r.box == pytest.approx(50 / 150)
