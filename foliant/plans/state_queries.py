"""Queries over runs, reviews, agents and reports: the driver's tables under the operators' column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import reports as R
from foliant.plans.registry import Registry
from foliant.sources.tables import read_table as t
from foliant.streaming.leases import EXPIRY, rocksdb_state
from foliant.streaming.leases import lease_expiries as lease_stream
from foliant.streaming.runs import new_folder, streamed

STATE = Registry()


@STATE.query("document_corruption", """SELECT l_orderkey AS id, round(least(1, sum(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN 0.10::DOUBLE ELSE 0.25::DOUBLE END WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 0.03::DOUBLE ELSE 0.07::DOUBLE END ELSE 0 END)), 6) AS score FROM lineitem GROUP BY 1""")
def document_corruption(spark: SparkSession, d: str) -> DataFrame:
    """Operator 96: corruption of orders by their line items as issues, repaired or not."""
    kind = F.col("l_returnflag")
    issue = F.when(kind == "R", "error").when(kind == "A", "warning").otherwise("info")
    repaired = F.when(kind == "R", F.col("l_linestatus") == "F").otherwise(F.col("l_linenumber") % 2 == 0)
    by = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(R.corruption_score(issue, repaired)).alias("s"))
    return by.select("id", F.round(F.least(F.col("s"), F.lit(1.0)), 6).alias("score"))


@STATE.query("size_ratios", "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 'inf'::DOUBLE END ELSE round(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE p_partkey END / (p_size % 5)::DOUBLE, 6) END::DOUBLE AS ratio FROM part")
def size_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Operator 92: native over raster sizes, empty files included."""
    native = F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(F.col("p_partkey"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(R.size_ratio(F.col("p_size") % 5, native), 6).alias("ratio"))


_ATTEMPTS = """WITH RECURSIVE o AS (SELECT l_orderkey, l_partkey % 3 AS stage, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey AS job, stage, row_number() OVER (PARTITION BY l_orderkey, stage ORDER BY l_linenumber) AS k, l_returnflag <> 'N' AS failed, l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linenumber % 2 = 0) AS retry FROM o),
m AS (SELECT * FROM a WHERE k = 1 UNION ALL SELECT a.* FROM m JOIN a ON a.job = m.job AND a.stage = m.stage AND a.k = m.k + 1 WHERE m.failed AND m.retry AND a.k <= 3),
g AS (SELECT job, stage, count(*) AS n, arg_max(failed, k) AS failed, count(*) FILTER (failed AND retry) AS r FROM m GROUP BY ALL)"""


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    kind, n = F.col("kind"), F.col("attempt")
    message = F.when(kind == "R", "read ETIMEDOUT").otherwise("no such file")
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job"), (F.col("l_partkey") % 3).alias("stage"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_returnflag").alias("kind"))
    return lines.select("job", "stage", "attempt", (kind != "N").alias("failed"), message.alias("message"), ((kind == "A") & (n % 2 == 0)).alias("retryable"))


@STATE.query("attempts_made", f"{_ATTEMPTS} SELECT job, stage, n AS n_attempts, CASE WHEN failed THEN 'failed' ELSE 'completed' END AS status, r AS n_retryable FROM g")
def attempts_made(spark: SparkSession, d: str) -> DataFrame:
    """Operator 221: attempts of stages, three at most and only while a failure may pass; line items as attempts."""
    return R.attempts_made(_attempts(spark, d))


@STATE.query("stage_summaries", f"""{_ATTEMPTS}, s AS (SELECT job, stage, n, failed, r, coalesce(bool_or(failed) OVER (PARTITION BY job ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM g)
SELECT job, count(*) AS total, count(*) FILTER (NOT skipped AND NOT failed) AS completed, count(*) FILTER (NOT skipped AND failed) AS failed, count(*) FILTER (skipped) AS skipped, coalesce(sum(n) FILTER (NOT skipped), 0)::BIGINT AS n_attempts, coalesce(sum(r) FILTER (NOT skipped), 0)::BIGINT AS n_retryable FROM s GROUP BY job""")
def stage_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Operator 71: stages of jobs by status with attempts and failures that were tried again."""
    a = _attempts(spark, d)
    return R.stage_summary(R.attempts_made(a), a.select("job", "stage").distinct())


@STATE.query("local_runs", "WITH q AS (SELECT o_orderpriority AS workload, count(*) FILTER (o_orderstatus = 'O') AS depth, count(DISTINCT o_clerk) AS capacity FROM orders GROUP BY 1) SELECT workload, depth, capacity, depth > capacity AS runs_locally FROM q".replace("o_clerk", "o_custkey"))
def local_runs(spark: SparkSession, d: str) -> DataFrame:
    """Operator 220: queues that are longer than the agents that there are, customers as agents."""
    q = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("workload")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("depth"), F.countDistinct("o_custkey").alias("capacity"))
    return q.withColumn("runs_locally", R.runs_locally(F.col("depth"), F.col("capacity")))


_DECISION = "CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'review' ELSE 'other' END"


@STATE.query("review_totals", f"""WITH l AS (SELECT user_id, arg_max({_DECISION}, event_id) AS dec, arg_max(CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END, event_id) AS note FROM events GROUP BY 1), j AS (SELECT c_custkey, l.* FROM customer LEFT JOIN l ON user_id = c_custkey)
SELECT count(*) AS total, count(user_id) AS reviewed, count(*) - count(user_id) AS unreviewed, count(*) FILTER (dec = 'yes') AS yes, count(*) FILTER (dec = 'no') AS no, count(*) FILTER (dec = 'review') AS review, count(*) FILTER (note <> '') AS notes FROM j""")
def review_totals(spark: SparkSession, d: str) -> DataFrame:
    """Operator 73: reviews by decision, with notes; events as reviews of customers."""
    k = F.col("event_id") % 4
    decision = F.when(k == 0, "yes").when(k == 1, "no").when(k == 2, "review").otherwise("other")
    reviews = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), decision.alias("decision"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("note"))
    return R.review_summary(t(spark, d, "customer").select(F.col("c_custkey").alias("key")), reviews)


@STATE.query("agent_totals", """WITH a AS (SELECT s_suppkey % 7 = 0 AS stale, s_suppkey % 2 = 0 AS busy, s_suppkey % 50 AS claimed, s_suppkey % 30 AS completed, s_suppkey % 11 AS failed FROM supplier)
SELECT count(*) AS total, count(*) FILTER (NOT stale AND NOT busy) AS idle, count(*) FILTER (NOT stale AND busy) AS busy, count(*) FILTER (stale) AS stale, sum(claimed)::BIGINT AS claimed, sum(completed)::BIGINT AS completed, sum(failed)::BIGINT AS failed FROM a""")
def agent_totals(spark: SparkSession, d: str) -> DataFrame:
    """Operator 72: agents idle, busy and stale, with their jobs; suppliers as agents."""
    k = F.col("s_suppkey")
    return R.agent_stats(t(spark, d, "supplier").select((k % 7 == 0).alias("stale"), F.when(k % 2 == 0, "busy").alias("status"), (k % 50).alias("claimed"), (k % 30).alias("completed"), (k % 11).alias("failed")))


@STATE.query("status_details", """WITH u AS (SELECT user_id AS job, ts, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN event_type END AS state, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id END AS message FROM events WHERE event_id % 10 > 0),
f AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS now, last_value(message IGNORE NULLS) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS said FROM u),
c AS (SELECT *, lag(now) OVER (PARTITION BY job ORDER BY ts, seq) AS before FROM f)
SELECT job, arg_max(now, (ts, seq)) AS state, arg_max(said, (ts, seq)) AS message, coalesce(max(ts) FILTER (now IS NOT NULL AND (before IS NULL OR before <> now)), min(ts)) AS state_since, max(ts) AS last_check_in, count(*) AS check_ins FROM c GROUP BY job""")
def status_details(spark: SparkSession, d: str) -> DataFrame:
    """Operators 218, 223: the status of jobs after all heartbeats; those of agents that lost their lease are dropped."""
    i = F.col("event_id")
    u = t(spark, d, "events").select(
        F.col("user_id").alias("job"), "ts", i.alias("seq"), F.lit("a").alias("owner"), F.when(i % 10 == 0, "b").otherwise("a").alias("agent"), F.when(i % 3 > 0, F.col("event_type")).alias("state"),
        F.when(i % 2 == 0, F.concat(F.lit("m"), i.cast("string"))).alias("message"),
    )
    return R.status_detail(u)


@STATE.query("validation_contracts", """WITH n AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS e FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, coalesce(e, 0) AS n_errors, o_custkey % 2 = 0 AND o_orderstatus <> 'P' AND coalesce(e, 0) = 0 AS pdf_ua, coalesce(e, 0) = 0 AS wcag_aa FROM orders LEFT JOIN n ON id = o_orderkey""")
def validation_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Operator 99: orders as validated documents, line items as findings."""
    findings = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("warning").alias("severity"))
    s = F.col("o_orderstatus")
    reports = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2 == 0).alias("is_compliant"), F.when(s == "P", "fail").when(s == "F", "pass").alias("status"))
    return R.validation_contract(findings, reports)


@STATE.query("adjusted_summaries", """WITH s AS (SELECT l_orderkey AS id, count(*) AS r, sum(l_linenumber) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey AS id, (o_custkey % 50 + coalesce(r, 0))::BIGINT AS passed_rules, greatest(o_custkey % 4 - coalesce(r, 0), 0)::BIGINT AS failed_rules, (100 + coalesce(c, 0))::BIGINT AS passed_checks, greatest(o_custkey % 9 - coalesce(c, 0), 0)::BIGINT AS failed_checks FROM orders LEFT JOIN s ON id = o_orderkey""")
def adjusted_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Operator 98: summaries after findings that a probe clears moved from failed to passed."""
    c = F.col("o_custkey")
    reports = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (c % 50).alias("passed_rules"), (c % 4).alias("failed_rules"), F.lit(100).cast("long").alias("passed_checks"), (c % 9).alias("failed_checks"))
    cleared = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("failed_checks"))
    return R.adjusted_summary(reports, cleared)


@STATE.query("status_matrix", """WITH m AS (SELECT p_brand AS "column", CASE p_size % 5 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' WHEN 2 THEN 'gap' WHEN 3 THEN 'na' END AS s FROM part) SELECT "column", count(*) FILTER (s = 'covered') AS covered, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'gap') AS gap, count(*) FILTER (coalesce(s, 'na') = 'na') AS na FROM m GROUP BY 1""")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Operator 101: statuses of a matrix by column, parts as rows and brands as columns."""
    names = F.array(*map(F.lit, ("covered", "partial", "gap", "na")))
    return R.status_matrix(t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("column"), F.get(names, (F.col("p_size") % 5).cast("int")).alias("status")))


@STATE.query("matrix_gaps", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'medium' END AS priority, p_type AS summary FROM part WHERE p_partkey % 6 = 0")
def matrix_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Operator 101: the gaps of the matrix with their priority; every sixth part has one."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return R.matrix_gaps(t(spark, d, "part").select(k.alias("id"), F.when(k % 6 == 0, F.col("p_type")).alias("gap_summary"), F.when(s % 2 == 0, "high").when(s % 3 == 0, "").alias("gap_priority")))


@STATE.query("font_summary", "SELECT count(*) AS total, count(*) FILTER (p_partkey % 3 > 0) AS embedded, count(*) FILTER (p_size % 4 > 1) AS remediated FROM part")
def font_summary(spark: SparkSession, d: str) -> DataFrame:
    """Operator 97: fonts, embedded ones, and those to be changed; parts as fonts."""
    s = F.col("p_size") % 4
    return R.font_summary(t(spark, d, "part").select((F.col("p_partkey") % 3 > 0).alias("embedded"), F.when(s == 1, "embed-as-is").when(s > 1, "inject-to-unicode").alias("action")))


@STATE.query("nodes_of_predictions", "SELECT o_orderkey AS id, o_custkey AS block, coalesce(c.c_nationkey, s.s_nationkey)::INT AS node FROM orders LEFT JOIN customer c ON c.c_custkey = o_orderkey LEFT JOIN supplier s ON s.s_suppkey = o_custkey")
def nodes_of_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Operators 46, 54: rows meet by one key, or else by another; orders as predictions."""
    p = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("block"))
    by_id = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("node"))
    by_block = t(spark, d, "supplier").select(F.col("s_suppkey").alias("block"), F.col("s_nationkey").alias("node"))
    return R.with_fallback(p, by_id, by_block, "id", "block", "node").select("id", "block", F.col("node").cast("int").alias("node"))


@STATE.query("lease_expiries", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) < 3600000 THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lease FROM g), l AS (SELECT user_id, lease, count(*) AS beats, epoch_us(max(ts)) // 1000 AS last FROM s GROUP BY ALL)
SELECT user_id AS agent_id, beats, last AS last_beat, last + 3600000 AS expired_at FROM l WHERE last + 3600000 <= (SELECT max(epoch_us(ts)) // 1000 - 60000 FROM events)""")
def lease_expiries(spark: SparkSession, d: str) -> DataFrame:
    """Operators 217, 223: the events as heartbeats in a stream; every lease of an hour that silence ended, by timers."""
    folder = new_folder(spark, "leases")
    events = t(spark, d, "events")
    # A pattern may be a file or a folder; a plain path must be a folder here.
    beats = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").selectExpr("user_id AS agent_id", "ts")
    with rocksdb_state(spark):
        query = streamed(lease_stream(beats, interval_ms=1_200_000), f"{folder}/rows", f"{folder}/state")
        query.awaitTermination()
    return spark.read.schema(EXPIRY).parquet(f"{folder}/rows").select("agent_id", "beats", F.unix_millis("last_beat").alias("last_beat"), F.unix_millis("expired_at").alias("expired_at"))
