"""Features of nodes and documents, the choice of a merger by them, and the figures of a role classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.text import run_style
from foliant.operators.grouped import once
from foliant.operators.layout import _or_null

# What marks a legal filing, and mergers by preference for each rule with the rule's confidence.
LEGAL = (
    r"(?i)\bNYSCEF\b", r"(?i)\bCourt\s+of\b", r"(?i)\bPetitioner\b", r"(?i)\bRespondent\b", r"(?i)\bPlaintiff\b", r"(?i)\bDefendant\b", r"(?i)\bIndex\s*No\.\s*\d", r"(?i)\bCase\s*No\.\s*\d",
    r"(?i)\bDocket\s*No\.\s*\d", r"(?i)\bSUPREME\s+COURT\b", r"(?i)\bMOTION\s+(TO|FOR)\b",
)
RULES = {
    "few-nodes": (0.9, ("v1-conservative", "v2-balanced")), "legal": (0.85, ("v7-refined", "v4-legal-tuned", "v6-hybrid")), "columns": (0.8, ("v8-precision", "v2-balanced", "v6-hybrid")),
    "headings": (0.75, ("v2-balanced", "v4-legal-tuned", "v1-conservative")), "scanned": (0.7, ("v6-hybrid", "v3-aggressive", "v2-balanced")), "dense": (0.75, ("v7-refined", "v6-hybrid", "v3-aggressive")),
    "default": (0.6, ("v7-refined", "v2-balanced", "v6-hybrid", "v1-conservative")),
}


def document_features(nodes: DataFrame) -> DataFrame:
    """One row per document: counts, ratios of roles, text density, and whether it is legal, scanned, in columns or has form fields.

    The first 50 nodes in order (seq) are looked at for legal texts: that is the rule. confidence may be absent.
    """
    role, text = F.upper(F.coalesce("role", F.lit(""))), F.coalesce("text", F.lit(""))
    share = lambda *names: F.count_if(role.isin(*names)) / F.count("*")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("page_number", "seq"))
    sure = F.avg(_or_null(nodes, "confidence", "double"))
    form = role.isin("FORM", "WIDGET") | F.coalesce(_or_null(nodes, "source_block_id", "string"), F.lit("")).rlike("(?i)acroform") | ((role == "ARTIFACT") & F.lower(text).rlike("checkbox|radio|text field"))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 50, F.struct("rank", text.alias("text"))))), lambda s: s["text"]), " ")
    pages = F.greatest(F.countDistinct("page_number"), F.lit(1))
    is_p = role.isin("P", "PARAGRAPH")
    by = nodes.withColumn("rank", rank).groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"), pages.alias("n_pages"), F.greatest(F.coalesce(F.max("column_hint"), F.lit(0)), F.lit(0)).alias("max_column"), share("H1", "H2", "H3", "HEADING").alias("heading_ratio"),
        share("P", "PARAGRAPH").alias("paragraph_ratio"), share("TH", "TD", "TABLE").alias("table_ratio"), share("ARTIFACT").alias("artifact_ratio"),
        F.coalesce(F.avg(F.when(is_p, F.length(text))), F.lit(0.0)).alias("mean_length"), (F.sum(F.length(text)) / pages).alias("density"), F.coalesce(sure, F.lit(1.0)).alias("mean_confidence"), F.max(form).alias("has_form"), head.alias("head"),
    )
    hits = sum((F.col("head").rlike(p).cast("int") for p in LEGAL), F.lit(0))
    return by.select(
        "*", (F.col("n_nodes") / F.col("n_pages")).alias("nodes_per_page"), (F.col("max_column") >= 1).alias("has_columns"), (hits >= 2).alias("is_legal"), (F.col("mean_confidence") < 0.75).alias("is_scanned"),
    ).drop("head")


def select_merger(features: DataFrame, available: list[str]) -> DataFrame:
    """Adds version, version_confidence and rule: the first rule that applies and has a version that is available."""
    f = F.col
    applies = {
        "few-nodes": f("n_nodes") < 20, "legal": f("is_legal"), "columns": f("has_columns") & (f("n_nodes") >= 20), "headings": f("heading_ratio") > 0.15, "scanned": f("is_scanned"),
        "dense": (f("density") > 5000) & ~f("has_columns"), "default": F.lit(True),
    }
    choice = F.when(F.lit(False), F.struct(F.lit("").alias("version"), F.lit(0.0).alias("version_confidence"), F.lit("").alias("rule")))
    for rule, (sure, wanted) in RULES.items():
        version = next((v for v in wanted if v in available), None)
        if version:
            choice = choice.when(applies[rule], F.struct(F.lit(version).alias("version"), F.lit(sure).alias("version_confidence"), F.lit(rule).alias("rule")))
    last = F.struct(F.lit(available[0] if available else "v2-balanced").alias("version"), F.lit(0.3).alias("version_confidence"), F.lit("none").alias("rule"))
    return features.withColumn("choice", choice.otherwise(last)).select(*features.columns, "choice.*")


def bucket(value: Column, bounds: list[float]) -> Column:
    """Number of the first bound that a value lies under, as text; a missing value counts as 0."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    out = F.when(F.lit(False), "")
    for k, b in enumerate(bounds):
        out = out.when(v < b, str(k))
    return out.otherwise(str(len(bounds)))


def _token(t: Column) -> Column:
    return (
        F.when(t == "", "none").when(t.rlike("^[A-Z]{2,}$"), "upper").when(t.rlike(r"^\d+$"), "number").when(t.rlike(r"^\d+[.,]\d+$"), "decimal").when(t.rlike("^[A-Za-z]+:$"), "label")
        .when(t.rlike("(?i)^https?:"), "url").when(t.rlike("^[A-Za-z]"), "word").otherwise("symbol")
    )


def role_features(nodes: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``nodes`` with a sorted array ``features`` of strings: place, text, layout block, node and neighbours.

    A node meets its layout block by source_block_id, and that block's page or, without a block, its own. Neighbours
    follow reading_order, page, top and left edge in the document. Columns that a table lacks count as missing: blocks
    may have block_type, heading_level, synthetic and the table columns; nodes heading_level, confidence,
    source_block_type, region_kind, artifact_type and n_merged. Sizes of fonts are held against the document's median.
    """
    extra = {"block_type": "string", "heading_level": "int", "synthetic": "boolean", "table_role": "string", "table_section": "string", "table_row_index": "int", "table_column_index": "int", "table_cell_confidence": "double", "table_detection_method": "string"}
    own = {"heading_level": "int", "confidence": "double", "source_block_type": "string", "region_kind": "string", "artifact_type": "string", "n_merged": "int"}
    middle = blocks.where("font_size > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list("font_size")).alias("s")).select("doc_id", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"))
    b = blocks.select("doc_id", F.col("block_id").alias("source_block_id"), F.col("page_number").alias("b_page"), F.col("font_size").alias("b_size"), F.col("font_name").alias("b_font"), *[_or_null(blocks, c, k).alias(f"b_{c}") for c, k in extra.items()])
    # Figures are columns before features use them; otherwise every use, and every bound of a bucket, would read the text again.
    t, chars, letters, tokens = (F.col(c) for c in ("_t", "_chars", "_letters", "_tokens"))
    ratio = lambda a, c: F.when(c > 0, a / F.nullif(c, F.lit(0))).otherwise(0.0)
    n = nodes.withColumns({f"n_{c}": _or_null(nodes, c, k) for c, k in own.items()}).withColumn("_t", once(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")))
    n = n.withColumns({"_chars": once(F.length(t)), "_letters": once(F.regexp_count(t, F.lit("[A-Za-z]"))), "_tokens": once(F.array_remove(F.split(t, r"\s+"), ""))})
    ends = {"_token0": F.coalesce(F.get(tokens, F.lit(0)), F.lit("")), "_token1": F.coalesce(F.get(tokens, F.size(tokens) - 1), F.lit(""))}
    figures = {"_words": F.size(tokens), "_digits": ratio(F.regexp_count(t, F.lit(r"\d")), chars), "_upper": ratio(F.regexp_count(t, F.lit("[A-Z]")), letters), **ends}
    n = n.withColumns({k: once(v) for k, v in figures.items()}).drop("_tokens", "_letters")
    w = W.partitionBy("doc_id").orderBy("reading_order", "page_number", "y", "x", "seq")
    prev, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    n = n.withColumns({
        "p_words": prev("_words"), "a_words": after("_words"), "has_p": prev("seq").isNotNull(), "has_a": after("seq").isNotNull(), "p_gap": F.abs(F.col("y") - prev(F.col("y") + F.col("h"))),
        "a_gap": F.abs(after("y") - (F.col("y") + F.col("h"))), "p_dx": F.col("x") - prev("x"), "a_dx": after("x") - F.col("x"), "n_total": F.count("*").over(W.partitionBy("doc_id")),
    })
    size = pages.select("doc_id", F.col("page_number").alias("b_page"), F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    n = n.join(b, ["doc_id", "source_block_id"], "left").withColumn("b_page", F.coalesce("b_page", "page_number")).join(size, ["doc_id", "b_page"], "left").join(middle, "doc_id", "left")
    wide, high = F.greatest(F.coalesce("page_w", F.lit(612.0)), F.lit(1.0)), F.greatest(F.coalesce("page_h", F.lit(792.0)), F.lit(1.0))
    x, y, width, height = (F.coalesce(c, F.lit(0.0)) for c in "xywh")
    places = {"_x": x / wide, "_y": y / high, "_w": width / wide, "_h": height / high, "_bottom": (y + height) / high}
    sizes = {"_size": F.coalesce("b_size", F.lit(0.0)) / F.greatest(F.coalesce("median", F.lit(10.0)), F.lit(1.0)), "_order": F.coalesce("reading_order", F.lit(0)) / F.col("n_total"), "_font": F.lower(F.coalesce("b_font", F.lit("")))}
    n = n.withColumns({k: once(v) for k, v in (places | sizes).items()})
    part = lambda c, k: F.greatest(F.least(F.floor(F.col(c) * k), F.lit(k - 1)), F.lit(0)).cast("string")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    has = lambda p: yes(t.rlike(p))
    some = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none"))
    level = lambda c: F.nullif(F.col(c), F.lit(0)).cast("string")
    font = F.col("_font")
    family = F.when(font == "", "unknown").when(font.rlike("mono|courier|consolas|code"), "mono").when(font.rlike("serif|times|georgia|garamond"), "serif").when(font.rlike("symbol|dingbat|zapf"), "symbol").otherwise("sans-or-other")
    cell = lambda c, bounds: F.when(F.col(c).isNull(), "none").otherwise(bucket(F.col(c), bounds))
    side = lambda there, dx: F.when(~F.col(there), "none").when(F.abs(dx) < 4, "aligned").when(F.col(dx) > 0, "indented").otherwise("outdented")
    gap = lambda there, c: F.when(~F.col(there), "none").otherwise(bucket(F.col(c), [3, 8, 16, 32, 64, 128]))
    features = {
        "page:xq": part("_x", 5), "page:yq": part("_y", 8), "page:w": bucket(F.col("_w"), [0.08, 0.18, 0.35, 0.65, 0.9]), "page:h": bucket(F.col("_h"), [0.015, 0.03, 0.06, 0.12]),
        "page:left": bucket(F.col("_x"), [0.08, 0.18, 0.32, 0.5]), "page:top": yes(F.col("_y") < 0.12), "page:bottom": yes(F.col("_bottom") > 0.88),
        "text:chars": bucket(chars, [1, 8, 20, 60, 140, 320]), "text:words": bucket(F.col("_words"), [1, 3, 8, 18, 40, 90]), "text:digits": bucket(F.col("_digits"), [0.02, 0.15, 0.4, 0.75]),
        "text:upper": bucket(F.col("_upper"), [0.2, 0.55, 0.85]), "text:empty": yes(chars == 0), "text:bullet": has(r"^\s*[•*+\-o]\s+"),
        "text:numbered": has(r"(?i)^\s*(\(?\d+[\).]|\(?[A-Za-z][\).]|[ivxlcdm]+[\).])\s+"), "text:ends-colon": has(":$"), "text:ends-period": has("[.!?]$"), "text:contains-url": has(r"(?i)(https?:\/\/|www\.|\.gov|\.org|\.edu)"),
        "text:punct-heavy": has(r"[|]{1,}|\s{3,}"), "text:table-markers": has(r"(?i)\b(total|amount|rate|date|code|description|item|qty|quantity)\b"), "text:note-marker": has(r"^\s*(\*|†|\[\d+\]|\d{1,2})\s*$"),
        "text:currency": has("[$€£]"), "text:percent": has("%"), "text:first-token": _token(F.col("_token0")), "text:last-token": _token(F.col("_token1")),
        "text:publication-notice": has(r"(?i)\b(federal register|scheduled to be published|govinfo|billing code)\b"),
        "layout:block-type": F.coalesce(F.nullif(F.col("b_block_type"), F.lit("")), F.lit("unknown")), "layout:heading-level": F.coalesce(level("b_heading_level"), level("n_heading_level"), F.lit("none")), "layout:font-class": family,
        "layout:font-ratio": bucket(F.col("_size"), [0.82, 0.96, 1.08, 1.3, 1.7]), "layout:synthetic": yes(F.coalesce("b_synthetic", F.lit(False))),
        "layout:table-role": some("b_table_role"), "layout:table-section": some("b_table_section"), "layout:table-row": cell("b_table_row_index", [1, 2, 4, 8, 16]), "layout:table-column": cell("b_table_column_index", [1, 2, 4, 8, 16]),
        "layout:table-confidence": cell("b_table_cell_confidence", [0.45, 0.7, 0.86, 0.94]), "layout:table-detection": some("b_table_detection_method"),
        "node:heading-level": F.coalesce(level("n_heading_level"), F.lit("none")), "node:column": F.coalesce(F.col("column_hint").cast("string"), F.lit("none")), "node:confidence": bucket(F.col("n_confidence"), [0.35, 0.55, 0.75, 0.9]),
        "node:order": bucket(F.col("_order"), [0.08, 0.2, 0.5, 0.8, 0.95]), "node:source-block-type": some("n_source_block_type"), "node:region-kind": some("n_region_kind"),
        "node:artifact-type": some("n_artifact_type"), "node:merged": yes(F.coalesce("n_n_merged", F.lit(0)) > 1), "neighbor:prev-words": bucket(F.col("p_words"), [1, 3, 8, 18, 40]), "neighbor:next-words": bucket(F.col("a_words"), [1, 3, 8, 18, 40]),
        "neighbor:prev-gap": gap("has_p", "p_gap"), "neighbor:next-gap": gap("has_a", "a_gap"), "neighbor:prev-x": side("has_p", "p_dx"), "neighbor:next-x": side("has_a", "a_dx"),
    }
    return n.withColumn("features", once(F.sort_array(F.array(*[F.concat(F.lit(f"{k}:"), v) for k, v in features.items()])))).select(*nodes.columns, "features")


def role_metrics(predictions: DataFrame) -> DataFrame:
    """Per role of (role, label): support, precision, recall and f1, six decimals; roles that are only predicted have no support."""
    hit = F.col("role") == F.col("label")
    actual = predictions.groupBy("role").agg(F.count("*").alias("support"), F.count_if(hit).alias("tp"))
    guessed = predictions.groupBy(F.col("label").alias("role")).agg(F.count("*").alias("n_label"))
    m = actual.join(guessed, "role", "full_outer").fillna(0, ["support", "tp", "n_label"])
    precision, recall = F.col("tp") / F.greatest("n_label", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(0.0)
    return m.select("role", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def overall_metrics(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, macro f1 over all and over supported roles, balanced accuracy, and the share of the most frequent role as a baseline."""
    by = role_metrics(predictions)
    on = F.col("support") > 0
    r = by.agg(
        F.sum("support").alias("n"), F.avg("f1").alias("macro_f1"), F.avg(F.when(on, F.col("f1"))).alias("supported_macro_f1"), F.avg(F.when(on, F.col("recall"))).alias("balanced_accuracy"),
        F.sum(F.col("recall") * F.col("support")).alias("hits"), F.max("support").alias("most"),
    )
    n = F.greatest("n", F.lit(1))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("macro_f1", "supported_macro_f1", "balanced_accuracy")], F.round(F.col("hits") / n, 6).alias("accuracy"), F.round(F.col("most") / n, 6).alias("baseline_accuracy"))


def inline_runs(runs: DataFrame) -> DataFrame:
    """Runs of a block (doc_id, block_id, seq, text, font_name, font_weight, font_style) that stand out: with start, end and inline_role.

    Code is set in letters of one width; bold runs are strong and italic ones stressed, unless 90 % of the block's
    characters are so.
    """
    block = W.partitionBy("doc_id", "block_id")
    n = F.length(F.coalesce("text", F.lit("")))
    r = runs.withColumn("s", run_style(F.col("font_name"), _or_null(runs, "font_weight", "string"), _or_null(runs, "font_style", "string"))).withColumn("n", n)
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).over(block) / F.nullif(F.sum("n").over(block), F.lit(0))
    r = r.withColumn("bold", share("s.bold")).withColumn("italic", share("s.italic")).withColumn("end", F.sum("n").over(block.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    role = F.when(F.col("s.mono"), "Code").when(F.col("s.bold") & (F.col("bold") < 0.9), "Strong").when(F.col("s.italic") & (F.col("italic") < 0.9), "Em")
    r = r.withColumn("inline_role", F.when(F.col("bold").isNotNull(), role)).where("inline_role IS NOT NULL")
    return r.select("doc_id", "block_id", "seq", "text", (F.col("end") - F.col("n")).alias("start"), "end", "inline_role")
