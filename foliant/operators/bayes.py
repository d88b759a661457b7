"""Naive Bayes over sets of string features: counts, tempered priors, abstention, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def train(examples: DataFrame, min_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """(classes with n and total, features with role, feature, n) from rows of (role, features)."""
    # A null feature beside the others counts the examples, so that one pass gives both.
    marked = F.array_append(F.col("features"), F.lit(None).cast("string"))
    by = examples.select("role", F.explode(marked).alias("feature")).groupBy("role", "feature").agg(F.count("*").alias("n"))
    counts = by.where("feature IS NOT NULL")
    if min_count > 1:
        seen = counts.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("feature")
        counts = counts.join(seen, "feature", "left_semi")
    totals = counts.groupBy("role").agg(F.sum("n").alias("total"))
    classes = by.where("feature IS NULL").select("role", F.col("n").alias("n_docs")).join(totals, "role", "left")
    return classes, counts


def predict(rows: DataFrame, classes: DataFrame, counts: DataFrame, alpha: float = 1.0, exponent: float = 0.35, threshold: float = 0.55, min_known: float = 0.35) -> DataFrame:
    """Per (id, features): label, confidence, known, abstained. Features never seen count against every class.

    Classes are few and given by the model, so each row meets all of them; feature counts meet by a join on the feature.
    """
    all_ = W.partitionBy()
    prior = F.pow(F.col("n_docs") + alpha, F.lit(exponent))
    vocabulary = counts.agg(F.countDistinct("feature").alias("v"))
    model = classes.select("role", F.log(prior / F.sum(prior).over(all_)).alias("prior"), "total").crossJoin(F.broadcast(vocabulary))
    long = rows.select("id", F.explode("features").alias("feature"))
    # One row per (feature, class) that was seen; the rest of a class's features share one value.
    base = counts.join(F.broadcast(model), "role").select("feature", "role", (F.log(F.col("n") + alpha) - F.log(F.lit(alpha))).alias("gain"))
    gains = long.join(base, "feature").groupBy("id", "role").agg(F.sum("gain").alias("gain"))
    known = long.join(counts.select("feature").distinct(), "feature", "left_semi").groupBy("id").agg(F.count("*").alias("n_known"))
    size = rows.select("id", F.size("features").alias("n"))
    score = F.col("prior") + F.col("n") * (F.log(F.lit(alpha)) - F.log(F.col("total") + alpha * F.greatest("v", F.lit(1)))) + F.coalesce("gain", F.lit(0.0))
    scored = size.crossJoin(F.broadcast(model)).join(gains, ["id", "role"], "left").select("id", "role", "n", score.alias("score"))
    by = scored.groupBy("id", "n").agg(F.max_by("role", F.struct("score", "role")).alias("label"), F.max("score").alias("top"), F.collect_list("score").alias("scores"))
    sure = 1 / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    out = by.join(known, "id", "left").select("id", "label", sure.alias("confidence"), F.when(F.col("n") > 0, F.coalesce("n_known", F.lit(0)) / F.col("n")).otherwise(0.0).alias("known"))
    return out.withColumn("abstained", (F.col("known") < min_known) | (F.col("confidence") < threshold))


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row: n, accuracy, brier-like error and ten-bin calibration error from (role, label, confidence)."""
    p = predictions.withColumn("hit", (F.col("role") == F.col("label")).cast("double")).withColumn("bin", F.least(F.floor(F.col("confidence") * 10), F.lit(9)))
    bins = p.groupBy("bin").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("confidence").alias("sure"), F.sum(F.pow(F.col("confidence") - F.col("hit"), 2)).alias("sq"))
    total = F.sum("n")
    return bins.agg(total.alias("n"), (F.sum("hits") / total).alias("accuracy"), (F.sum("sq") / total).alias("brier"), (F.sum(F.abs(F.col("hits") - F.col("sure"))) / total).alias("ece"))
