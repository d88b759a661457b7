"""Operators on reports, runs of jobs and reviews: each takes rows under its own column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: what an error's message says when trying again may help.
TRANSIENT = "emfile|enfile|eagain|ebusy|etimedout|timeout|econnreset|epipe|temporarily unavailable|resource busy"


def corruption_score(severity: Column, repaired: Column) -> Column:
    """What one issue adds to a document's corruption; sums stop at 1."""
    return F.when(severity == "error", F.when(repaired, 0.10).otherwise(0.25)).when(severity == "warning", F.when(repaired, 0.03).otherwise(0.07)).otherwise(0.0)


def size_ratio(raster: Column, native: Column) -> Column:
    """Native over raster size; 1 for two empty files, infinite for an empty raster one."""
    return F.when(raster == 0, F.when(native == 0, 1.0).otherwise(float("inf"))).otherwise(native / F.nullif(raster, F.lit(0)))


def is_transient(message: Column, flagged: Column) -> Column:
    """Whether a failure is worth another attempt: it says so itself, or by its message."""
    return F.coalesce(flagged, F.lit(False)) | F.lower(F.coalesce(message, F.lit(""))).rlike(TRANSIENT)


def attempts_made(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(job, stage, n_attempts, status, n_retryable) from possible attempts (job, stage, attempt, failed, message, retryable).

    Attempts follow one another while they fail for a reason that may pass, up to ``most``; what comes after is not made.
    """
    a = attempts.withColumn("again", F.col("failed") & is_transient(F.col("message"), F.col("retryable")))
    w = W.partitionBy("job", "stage").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    a = a.withColumn("made", F.coalesce(F.min("again").over(w), F.lit(True)) & (F.row_number().over(W.partitionBy("job", "stage").orderBy("attempt")) <= most)).where("made")
    last = F.max_by("failed", "attempt")
    return a.groupBy("job", "stage").agg(F.count("*").alias("n_attempts"), F.when(last, "failed").otherwise("completed").alias("status"), F.count_if("again").alias("n_retryable"))


def stage_summary(made: DataFrame, planned: DataFrame) -> DataFrame:
    """Per job: stages completed, failed and skipped, attempts and retryable failures. After a failed stage the rest is skipped.

    ``planned``: (job, stage), stages by number; ``made``: what ``attempts_made`` gives.
    """
    s = planned.join(made, ["job", "stage"], "left")
    before = F.max(F.col("status") == "failed").over(W.partitionBy("job").orderBy("stage").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("skipped", F.coalesce(before, F.lit(False)))
    ran = ~F.col("skipped")
    n = lambda c: F.sum(F.when(ran, F.coalesce(c, F.lit(0))).otherwise(0))
    return s.groupBy("job").agg(
        F.count("*").alias("total"), F.count_if(ran & (F.col("status") == "completed")).alias("completed"), F.count_if(ran & (F.col("status") == "failed")).alias("failed"), F.count_if("skipped").alias("skipped"),
        n("n_attempts").alias("n_attempts"), n("n_retryable").alias("n_retryable"),
    )


def runs_locally(depth: Column, capacity: Column) -> Column:
    """Whether a queue is longer than remote agents can take."""
    return depth > capacity


def review_summary(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: items, reviewed and not, decisions, notes; ``reviews`` (key, seq, decision, note) count by the latest of a key."""
    last = reviews.groupBy("key").agg(F.max_by(F.struct("decision", "note"), "seq").alias("r"))
    j = items.join(last, "key", "left")
    decided = lambda d: F.count_if(F.col("r.decision") == d).alias(d)
    return j.agg(F.count("*").alias("total"), F.count("r").alias("reviewed"), (F.count("*") - F.count("r")).alias("unreviewed"), decided("yes"), decided("no"), decided("review"), F.count_if(F.coalesce("r.note", F.lit("")) != "").alias("notes"))


def agent_stats(agents: DataFrame) -> DataFrame:
    """One row of agents (stale, status, claimed, completed, failed): stale ones, and of the others busy and idle ones, with sums."""
    live = ~F.col("stale")
    return agents.agg(
        F.count("*").alias("total"), F.count_if(live & ~F.col("status").eqNullSafe(F.lit("busy"))).alias("idle"), F.count_if(live & (F.col("status") == "busy")).alias("busy"), F.count_if("stale").alias("stale"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("claimed", "completed", "failed")],
    )


def status_detail(updates: DataFrame) -> DataFrame:
    """(job, state, message, state_since, last_check_in, check_ins) after all updates (job, ts, seq, agent, owner, state, message).

    Updates of an agent that does not own the job by then are dropped, late ones included. A null state or message
    keeps the one before; state_since moves only when the state changes.
    """
    u = updates.where(F.col("agent").eqNullSafe(F.col("owner")))
    w = W.partitionBy("job").orderBy("ts", "seq")
    held = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    u = u.withColumn("now", held("state")).withColumn("said", held("message"))
    changed = F.lag("now").over(w).isNull() | ~F.lag("now").over(w).eqNullSafe(F.col("now"))
    u = u.withColumn("changed", changed)
    at = F.struct("ts", "seq")
    return u.groupBy("job").agg(
        F.max_by("now", at).alias("state"), F.max_by("said", at).alias("message"), F.coalesce(F.max(F.when(F.col("changed") & F.col("now").isNotNull(), F.col("ts"))), F.min("ts")).alias("state_since"),
        F.max("ts").alias("last_check_in"), F.count("*").alias("check_ins"),
    )


def validation_contract(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, n_errors, pdf_ua, wcag_aa) of reports (id, is_compliant, status) with findings (id, severity): only errors count."""
    n = findings.where(F.lower("severity") == "error").groupBy("id").agg(F.count("*").alias("n_errors"))
    r = reports.join(n, "id", "left").fillna(0, ["n_errors"])
    clean = F.col("n_errors") == 0
    ok = F.coalesce("is_compliant", F.lit(False)) & (F.col("status").isNull() | (F.col("status") == "pass")) & clean
    return r.select("id", "n_errors", ok.alias("pdf_ua"), clean.alias("wcag_aa"))


def adjusted_summary(reports: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Summaries (id, passed_rules, failed_rules, passed_checks, failed_checks) with suppressed findings (id, failed_checks) moved from failed to passed."""
    s = suppressed.groupBy("id").agg(F.count("*").alias("n_rules"), F.coalesce(F.sum("failed_checks"), F.lit(0)).alias("n_checks"))
    r = reports.join(s, "id", "left").fillna(0, ["n_rules", "n_checks"])
    more, less = (lambda c, n: (F.col(c) + F.col(n)).alias(c)), (lambda c, n: F.greatest(F.col(c) - F.col(n), F.lit(0)).alias(c))
    return r.select("id", more("passed_rules", "n_rules"), less("failed_rules", "n_rules"), more("passed_checks", "n_checks"), less("failed_checks", "n_checks"))


def status_matrix(rows: DataFrame) -> DataFrame:
    """(column, covered, partial, gap, na) of a testing matrix (id, column, status); a missing status is na."""
    status = F.coalesce("status", F.lit("na"))
    return rows.groupBy("column").agg(*[F.count_if(status == s).alias(s) for s in ("covered", "partial", "gap", "na")])


def matrix_gaps(rows: DataFrame) -> DataFrame:
    """(id, priority, summary) of rows with a gap (id, gap_summary, gap_priority); the priority is medium if none is said."""
    return rows.where(F.col("gap_summary").isNotNull()).select("id", F.coalesce(F.nullif(F.col("gap_priority"), F.lit("")), F.lit("medium")).alias("priority"), F.col("gap_summary").alias("summary"))


def font_summary(fonts: DataFrame) -> DataFrame:
    """One row of fonts (embedded, action): all, embedded, and those whose plan is to change anything."""
    return fonts.agg(F.count("*").alias("total"), F.count_if("embedded").alias("embedded"), F.count_if(F.coalesce("action", F.lit("embed-as-is")) != "embed-as-is").alias("remediated"))


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """``rows`` with ``value`` met by ``key`` in ``first``, or else by ``other`` in ``second``; each has one row per key."""
    a = rows.join(first.select(key, F.col(value).alias("_first")), key, "left").join(second.select(other, F.col(value).alias("_second")), other, "left")
    return a.withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second")
