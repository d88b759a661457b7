"""Queries over reports, jobs, agents, runs and models, on the driver's tables as stand-ins.

Orders are jobs (status by order status), customers are batches, events are heartbeats of agents, line items
are artifacts and findings; which column stands for what is said at each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import bayes, scores as S
from foliant.operators import layout as O
from foliant.plans.registry import Registry
from foliant.sources.blocks import BLOCKS_SQL, blocks_from_documents
from foliant.sources.tables import read_table as t

REPORTS = Registry()
_STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 2 WHEN 0 THEN 'queued' ELSE 'running' END WHEN 'F' THEN 'completed' ELSE 'failed' END"


def _status() -> Column:
    return F.expr(_STATUS_SQL)



@REPORTS.query("paragraph_quality", f"""WITH {BLOCKS_SQL}, a AS (SELECT doc_id, avg(length(text)) AS m, stddev_pop(length(text)) AS sd, count(*) AS n, count(DISTINCT page_number) AS p FROM blocks WHERE role = 'P' GROUP BY doc_id)
SELECT doc_id, round(least(1, greatest(0, 0.45::DOUBLE * CASE WHEN m < 20 THEN m / 20 * 0.3 WHEN m < 80 THEN 0.5 + 0.5 * (m - 20) / 60 WHEN m <= 500 THEN 1 WHEN m <= 2000 THEN 0.5 + 0.5 * (2000 - m) / 1500 ELSE greatest(0, 0.5 * (1 - (m - 2000) / 2000)) END
 + 0.35::DOUBLE * CASE WHEN n / p <= 30 THEN 1 ELSE greatest(0, 1 - (n / p - 30) / 70) END + 0.2::DOUBLE * CASE WHEN n > 1 THEN greatest(0, 1 - sd / m / 2) ELSE 1 END)), 6) AS quality FROM a""")
def paragraph_quality(spark: SparkSession, d: str) -> DataFrame:
    """Operator 79."""
    p = blocks_from_documents(t(spark, d, "documents")).where("role = 'P'")
    return S.paragraph_quality(p, "doc_id").select("doc_id", F.round("paragraph_quality", 6).alias("quality"))


@REPORTS.query("native_quality", """WITH a AS (SELECT l_suppkey, count(*) / count(DISTINCT l_linenumber)::DOUBLE AS pp, count(DISTINCT l_returnflag || l_linestatus) AS f, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS ts FROM lineitem GROUP BY ALL)
SELECT l_suppkey, round(0.35::DOUBLE * CASE WHEN pp < 50 THEN pp / 50 WHEN pp <= 500 THEN 1 ELSE greatest(0, 1 - (pp - 500) / 1500) END + 0.25 * CASE WHEN f = 0 THEN 0.2 WHEN f <= 10 THEN 1 ELSE greatest(0.3, 1 - (f - 10) / 30) END + 0.4 * CASE WHEN ts < 0.15 THEN ts / 0.15 WHEN ts <= 0.85 THEN 1 ELSE 0.8 END, 6)::DOUBLE AS quality, round(ts, 6) AS text_share FROM a""")
def native_quality(spark: SparkSession, d: str) -> DataFrame:
    """Operators 80, 91: suppliers as documents, line items as content operators."""
    a = t(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count("*") / F.countDistinct("l_linenumber")).alias("pp"), F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("f"), F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("ts"))
    return a.select("l_suppkey", F.round(S.native_quality(F.col("pp"), F.col("f"), F.col("ts")), 6).alias("quality"), F.round("ts", 6).alias("text_share"))


_METRICS = "m AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS vera, avg(CASE WHEN l_tax <= 0.04 THEN 1.0::DOUBLE ELSE 0 END) AS font, count(*) FILTER (l_linestatus = 'O') AS inv, avg(CASE WHEN l_discount > 0.02 THEN l_quantity * 2 END) AS ocr FROM lineitem GROUP BY l_orderkey)"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("vera"), F.avg(F.when(F.col("l_tax") <= 0.04, 1.0).otherwise(0.0)).alias("font"),
        F.count_if(F.col("l_linestatus") == "O").alias("inv"), F.avg(F.when(F.col("l_discount") > 0.02, F.col("l_quantity") * 2)).alias("ocr"),
    )


_AGG = "(0.4::DOUBLE / (1 + vera) + font * 0.2 + 0.15::DOUBLE / (1 + inv) + coalesce(ocr / 100 * 0.15, 0)) / (0.75::DOUBLE + CASE WHEN ocr IS NULL THEN 0 ELSE 0.15 END)"


@REPORTS.query("aggregate_score", f"WITH {_METRICS} SELECT l_orderkey, vera, round(font, 6) AS font, round(ocr, 6) AS ocr, round({_AGG}, 6) AS score FROM m")
def aggregate_score(spark: SparkSession, d: str) -> DataFrame:
    """Operators 76 to 78, 81: metrics of orders and their weighted mean without missing ones."""
    s = S.aggregate_score(F.col("vera"), F.col("font"), F.col("inv"), F.col("ocr"), F.lit(None).cast("double"))
    return _metrics(spark, d).select("l_orderkey", "vera", F.round("font", 6).alias("font"), F.round("ocr", 6).alias("ocr"), F.round(s, 6).alias("score"))


@REPORTS.query("run_difference", """WITH a AS (SELECT l_partkey AS k, avg(l_discount) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_partkey AS k, avg(l_discount) AS s FROM lineitem WHERE l_linenumber > 2 GROUP BY 1),
j AS (SELECT b.s - a.s AS delta FROM a FULL JOIN b USING (k)) SELECT count(*) AS n, count(*) FILTER (delta > 0.001) AS n_improved, count(*) FILTER (delta < -0.001) AS n_regressed, count(*) FILTER (abs(delta) <= 0.001) AS n_unchanged, round(avg(delta), 6) AS mean_delta FROM j""")
def run_difference(spark: SparkSession, d: str) -> DataFrame:
    """Operators 56, 89, 90: two runs joined by name with changes counted.

    Means are compared as whole fractions, as differences of exactly 0.001 would else fall to either side by the order of their sums.
    """
    li = t(spark, d, "lineitem")
    run = lambda cond, s, n: li.where(cond).groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.col("l_discount").cast("decimal(12,6)")).cast("decimal(16,6)").alias(s), F.count("l_discount").cast("decimal(9,0)").alias(n))
    j = run("l_linenumber <= 3", "sa", "na").join(run("l_linenumber > 2", "sb", "nb"), "k", "full_outer")
    # The difference times both counts, and the least change times both.
    j = j.withColumns({"p": F.col("sb") * F.col("na") - F.col("sa") * F.col("nb"), "q": F.col("na") * F.col("nb")}).withColumn("least", F.col("q") * F.lit(0.001).cast("decimal(4,3)"))
    delta = F.when(F.col("q") > 0, F.col("p").cast("double") / F.col("q").cast("double"))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("p") > F.col("least")).alias("n_improved"), F.count_if(F.col("p") < -F.col("least")).alias("n_regressed"), F.count_if(F.abs("p") <= F.col("least")).alias("n_unchanged"), F.round(F.avg(delta), 6).alias("mean_delta"))


@REPORTS.query("category_winners", """WITH s AS (SELECT n_regionkey AS r, s_suppkey AS doc, round(s_acctbal / 1000) AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey), k AS (SELECT *, max(score) OVER (PARTITION BY r) AS best FROM s)
SELECT r AS category, max(best) AS best, count(*) FILTER (score = best AND best > 0) AS n_best, CASE WHEN count(*) FILTER (score = best AND best > 0) = 1 THEN max(doc) FILTER (score = best) END AS winner FROM k GROUP BY r""")
def category_winners(spark: SparkSession, d: str) -> DataFrame:
    """Operator 84: the best document of a category, unless tied; suppliers by region."""
    s = t(spark, d, "supplier").join(F.broadcast(t(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("score", F.round(F.col("s_acctbal") / 1000))
    k = s.withColumn("best", F.max("score").over(W.partitionBy("n_regionkey")))
    top = (F.col("score") == F.col("best")) & (F.col("best") > 0)
    by = k.groupBy(F.col("n_regionkey").alias("category")).agg(F.max("best").alias("best"), F.count_if(top).alias("n_best"), F.max(F.when(top, F.col("s_suppkey"))).alias("w"))
    return by.select("category", "best", "n_best", F.when(F.col("n_best") == 1, F.col("w")).alias("winner"))


@REPORTS.query("category_scores", """SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE greatest(0, 1 - (least((o_orderkey % 30) / 20.0::DOUBLE, 1) * 0.6 + least((o_custkey % 70) / 50.0::DOUBLE, 1) * 0.4)) END, 6)::DOUBLE AS compliance,
 round(least(CASE WHEN o_orderkey % 3 = 0 THEN 0.4 ELSE 0 END + least((o_custkey % 150) / 100.0::DOUBLE, 1) * 0.3 + least((o_orderkey % 300) / 200.0::DOUBLE, 1) * 0.3, 1), 6)::DOUBLE AS structure,
 round(CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE (o_custkey % 5) / 4.0::DOUBLE * 0.7 + greatest(0, 1 - (o_orderkey % 13) / 10.0::DOUBLE) * 0.3 END, 6)::DOUBLE AS fonts FROM orders""")
def category_scores(spark: SparkSession, d: str) -> DataFrame:
    """Operators 82, 83: category scorers over orders' keys as counts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t(spark, d, "orders").select(
        "o_orderkey", F.round(S.compliance_score(F.col("o_orderstatus") == "F", k % 30, c % 70), 6).alias("compliance"), F.round(S.structure_score(k % 3 == 0, c % 150, k % 300), 6).alias("structure"),
        F.round(S.font_score(F.when(k % 5 != 0, c % 5 / 4), k % 13), 6).alias("fonts"),
    )


@REPORTS.query("writer_verdicts", """WITH v AS (SELECT l_orderkey, l_linenumber, 1 - l_discount AS p, 1 - l_tax * 2 AS f, l_quantity / 25 AS s, l_linestatus = 'O' AS sel FROM lineitem)
SELECT CASE WHEN p > 0.9 AND f >= 0.85 THEN 'native-recommended' ELSE 'raster-preferred' END AS verdict, round(least(1, CASE WHEN p > 0.9 THEN 0.4 WHEN p > 0.7 THEN 0.2 ELSE 0 END + CASE WHEN f > 0.85 THEN 0.25 WHEN f > 0.6 THEN 0.1 ELSE 0 END + CASE WHEN s < 0.5 THEN 0.2 WHEN s < 1 THEN 0.1 ELSE 0 END + CASE WHEN sel THEN 0.15 ELSE 0 END), 2)::DOUBLE AS confidence, count(*) AS n FROM v GROUP BY ALL""")
def writer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Operators 94, 231, 233: verdicts counted."""
    v = S.verdict(1 - F.col("l_discount"), 1 - F.col("l_tax") * 2, F.col("l_quantity") / 25, F.col("l_linestatus") == "O")
    return t(spark, d, "lineitem").select(v.alias("v")).groupBy("v.verdict", "v.confidence").agg(F.count("*").alias("n"))


@REPORTS.query("repair_health", """WITH i AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS sev, l_linestatus = 'F' AS rep FROM lineitem), c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (sev = 'error') AS e, count(*) FILTER (sev = 'warning') AS w, count(*) FILTER (sev = 'error' AND NOT rep) AS ue, count(*) FILTER (sev = 'warning' AND NOT rep) AS uw, avg(CASE WHEN rep THEN 1.0::DOUBLE ELSE 0 END) AS eff FROM i GROUP BY 1),
h AS (SELECT *, greatest(0, least(1, round(1 - (ue * 0.25::DOUBLE + uw * 0.1::DOUBLE + (e - ue) * 0.05::DOUBLE + (w - uw) * 0.02::DOUBLE), 3))) AS health FROM c)
SELECT l_orderkey, health::DOUBLE AS health, round(eff, 6) AS effectiveness, CASE WHEN health = 1 THEN 'clean' WHEN ue >= 3 THEN 'critical' WHEN ue >= 1 THEN 'high' WHEN health >= 0.8 THEN 'low' ELSE 'medium' END AS risk FROM h""")
def repair_health(spark: SparkSession, d: str) -> DataFrame:
    """Operator 95: line items as issues of orders."""
    sev = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    i = t(spark, d, "lineitem").select("l_orderkey", sev.alias("sev"), (F.col("l_linestatus") == "F").alias("rep"))
    n = lambda s, more=F.lit(True): F.count_if((F.col("sev") == s) & more)
    c = i.groupBy("l_orderkey").agg(F.count("*").alias("n"), n("error").alias("e"), n("warning").alias("w"), n("error", ~F.col("rep")).alias("ue"), n("warning", ~F.col("rep")).alias("uw"), F.avg(F.when(F.col("rep"), 1.0).otherwise(0.0)).alias("eff"))
    c = c.withColumn("health", S.repair_health(F.col("e"), F.col("w"), F.col("ue"), F.col("uw"), F.col("n")))
    return c.select("l_orderkey", "health", F.round("eff", 6).alias("effectiveness"), S.repair_risk(F.col("health"), F.col("ue")).alias("risk"))


@REPORTS.query("repair_timeline", """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber) AS step FROM lineitem""")
def repair_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Operator 177: repairs by severity."""
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(W.partitionBy("l_orderkey").orderBy(rank, "l_linenumber")).cast("long").alias("step"))


@REPORTS.query("job_status", f"SELECT count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, o_orderpriority AS workload FROM (SELECT *, {_STATUS_SQL} AS s FROM orders) GROUP BY ALL")
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """Operators 68, 71: jobs by status, zero where there is none."""
    j = t(spark, d, "orders").select(F.col("o_orderpriority").alias("workload"), _status().alias("s"))
    names = ["queued", "running", "completed", "failed"]
    return j.groupBy("workload").pivot("s", names).count().na.fill(0, names)


@REPORTS.query("batch_status", f"""WITH j AS (SELECT c_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' WHEN o_orderkey IS NOT NULL THEN {_STATUS_SQL} END AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey), b AS (SELECT c_custkey, count(s) AS total, count(*) FILTER (s = 'queued') AS q, count(*) FILTER (s = 'running') AS r, count(*) FILTER (s = 'failed') AS f, count(*) FILTER (s = 'completed') AS c, count(*) FILTER (s = 'missing') AS m FROM j GROUP BY 1)
SELECT CASE WHEN total = 0 THEN 'empty' WHEN q > 0 OR r > 0 THEN 'processing' WHEN f > 0 AND c > 0 THEN 'completed_with_failures' WHEN f > 0 THEN 'failed' WHEN m > 0 THEN 'incomplete' ELSE 'completed' END AS status, count(*) AS n_batches, sum(total)::BIGINT AS n_jobs, sum(m)::BIGINT AS n_missing FROM b GROUP BY 1""")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    """Operators 58, 69: batches with the status of all their jobs; one job in three is missing from the queue and counts in the total."""
    names = ["queued", "running", "completed", "failed", "missing"]
    o = t(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "missing").otherwise(_status()).alias("s"))
    by = o.groupBy("o_custkey").pivot("s", names).count()
    b = t(spark, d, "customer").select("c_custkey").join(by, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, names)
    b = b.withColumn("total", sum((F.col(c) for c in names), F.lit(0)))
    status = S.batch_status(*[F.col(c) for c in ("total", "queued", "running", "failed", "completed", "missing")])
    return b.groupBy(status.alias("status")).agg(F.count("*").alias("n_batches"), F.sum("total").alias("n_jobs"), F.sum("missing").alias("n_missing"))


@REPORTS.query("recent_jobs", f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created, {_STATUS_SQL} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 24")
def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Operators 166, 176: a report of the 24 latest jobs."""
    return t(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(24).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), _status().alias("status"))


@REPORTS.query("review_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def review_page(spark: SparkSession, d: str) -> DataFrame:
    """Operator 165: one page of a filtered list."""
    return t(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@REPORTS.query("top_counts", "SELECT p_type AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, name LIMIT 12")
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    """Operators 64, 65: the most frequent names, ties by name."""
    li = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(12)


@REPORTS.query("artifact_inventory", "SELECT l_returnflag AS kind, count(*) AS n_artifacts, sum(l_quantity)::BIGINT AS n_bytes, count(DISTINCT l_orderkey) AS n_jobs, count(*) FILTER (l_linestatus = 'O') AS n_missing FROM lineitem GROUP BY 1")
def artifact_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Operators 70, 97: artifacts by kind with sizes, jobs and missing ones."""
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n_artifacts"), F.sum("l_quantity").cast("long").alias("n_bytes"), F.countDistinct("l_orderkey").alias("n_jobs"), F.count_if(F.col("l_linestatus") == "O").alias("n_missing"))


@REPORTS.query("filtered_artifacts", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS label FROM part WHERE p_size > 25 AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '2')")
def filtered_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Operator 238: filters and a substring over joined fields."""
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return t(spark, d, "part").where((F.col("p_size") > 25) & F.lower(label).contains("2")).select("p_partkey", label.alias("label"))


@REPORTS.query("page_deltas", """WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS page, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL), b AS (SELECT l_orderkey AS doc, l_linenumber AS page, sum(l_extendedprice) AS q FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT coalesce(a.page, b.page) AS page, count(*) AS n, round(sum(coalesce(b.q, 0) - coalesce(a.q, 0)), 2) AS delta FROM a FULL JOIN b ON a.doc = b.doc AND a.page = b.page GROUP BY 1""")
def page_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Operators 57, 67: pages of two files side by side, missing ones as zero."""
    li = t(spark, d, "lineitem")
    a = li.where("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("a"))
    b = li.where("l_linenumber > 1").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("b"))
    j = a.join(b, ["l_orderkey", "l_linenumber"], "full_outer")
    return j.groupBy(F.col("l_linenumber").alias("page")).agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))), 2).alias("delta"))


@REPORTS.query("suppressed_findings", "SELECT l_shipmode AS code, count(*) AS n_left FROM (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def suppressed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Operators 45, 98: findings without those that a probe clears."""
    cleared = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, d, "lineitem").join(cleared, "l_orderkey", "left_anti").groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n_left"))


@REPORTS.query("prioritized_metadata", """WITH c AS (SELECT l_partkey AS id, 1 AS pr, l_orderkey AS v FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, 2, l_orderkey FROM lineitem WHERE l_linenumber = 2), b AS (SELECT id, pr, v FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY pr, v) = 1)
SELECT p_partkey, pr AS method, v AS table_id FROM part LEFT JOIN b ON id = p_partkey""")
def prioritized_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Operators 43, 44, 46, 48: candidates of several detectors, the first in rank wins, joined to all blocks."""
    li = t(spark, d, "lineitem")
    c = li.where("l_linenumber <= 2").groupBy("l_partkey").agg(F.min(F.struct(F.col("l_linenumber").alias("pr"), F.col("l_orderkey").alias("v"))).alias("b"))
    return t(spark, d, "part").join(c, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("b.pr").alias("method"), F.col("b.v").alias("table_id"))


@REPORTS.query("latest_reviews", "SELECT user_id, arg_max(event_type, event_id) AS decision, max(event_id) AS last_event, count(*) AS n FROM events GROUP BY user_id")
def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Operators 55, 169: the last record of every key."""
    return t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("decision"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@REPORTS.query("review_summary", "WITH l AS (SELECT c_custkey, arg_max(event_type, event_id) AS decision FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1) SELECT coalesce(decision, 'unreviewed') AS decision, count(*) AS n FROM l GROUP BY 1")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Operators 54, 73: items by their latest decision."""
    last = t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("decision"))
    j = t(spark, d, "customer").join(last, F.col("user_id") == F.col("c_custkey"), "left")
    return j.groupBy(F.coalesce("decision", F.lit("unreviewed")).alias("decision")).agg(F.count("*").alias("n"))


@REPORTS.query("stale_agents", """WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT user_id, max(ts) AS seen, arg_max(event_type, event_id) AS state FROM events GROUP BY 1)
SELECT user_id, epoch_ms(now) - epoch_ms(seen) > greatest((user_id % 40) * 60000 * 3, 30000) AS stale, state = 'purchase' AS busy FROM a, n""")
def stale_agents(spark: SparkSession, d: str) -> DataFrame:
    """Operators 72, 167, 219, 239: agents that were not seen for three heartbeats, or thirty seconds."""
    e = t(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    a = e.groupBy("user_id").agg(F.max("ts").alias("seen"), F.max_by("event_type", "event_id").alias("state")).crossJoin(F.broadcast(now))
    gone = F.unix_millis(F.col("now").cast("timestamp")) - F.unix_millis(F.col("seen").cast("timestamp"))
    return a.select("user_id", (gone > S.stale_window_ms(F.col("user_id") % 40 * 60000, F.lit(0))).alias("stale"), (F.col("state") == "purchase").alias("busy"))


@REPORTS.query("expired_leases", """WITH h AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT user_id, count(*) FILTER (epoch_ms(nxt) - epoch_ms(ts) >= 3600000) AS n_expired, count(*) AS n_beats FROM h GROUP BY 1""")
def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    """Operators 217, 218, 223: leases of an hour that ran out before the next heartbeat, replayed from the log."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    h = t(spark, d, "events").withColumn("late", F.unix_millis(F.lead("ts").over(w).cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp")) >= 3_600_000)
    return h.groupBy("user_id").agg(F.count_if("late").alias("n_expired"), F.count("*").alias("n_beats"))


@REPORTS.query("even_slice", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer) SELECT c_custkey FROM r WHERE rn IN (SELECT floor(i * (n - 1) / 19.0::DOUBLE + 0.5) FROM range(20) t(i))")
def even_slice(spark: SparkSession, d: str) -> DataFrame:
    """Operators 174, 175: twenty rows at even distances, which is the feature; ranks come from counts by range, not one task."""
    c = t(spark, d, "customer").select("c_custkey")
    width = 256
    bins = c.groupBy(F.floor(F.col("c_custkey") / width).alias("bin")).agg(F.count("*").alias("n"))
    ends = bins.withColumn("before", F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)))
    total = bins.agg(F.sum("n").alias("total"))
    ranked = c.withColumn("bin", F.floor(F.col("c_custkey") / width)).withColumn("r", F.row_number().over(W.partitionBy("bin").orderBy("c_custkey")))
    ranked = ranked.join(ends.select("bin", "before"), "bin").crossJoin(F.broadcast(total)).withColumn("rn", F.coalesce("before", F.lit(0)) + F.col("r") - 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.floor(i * (F.col("total") - 1) / 19.0 + 0.5))
    return ranked.where(F.array_contains(wanted, F.col("rn"))).select("c_custkey")


@REPORTS.query("factor_coverage", "WITH f AS (SELECT p_partkey, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part), n AS (SELECT k, count(DISTINCT v) AS n FROM f GROUP BY k) SELECT a.k AS factor_a, b.k AS factor_b, count(DISTINCT (a.v, b.v)) AS observed, max(na.n * nb.n) AS possible FROM f a JOIN f b ON a.p_partkey = b.p_partkey AND a.k < b.k JOIN n na ON na.k = a.k JOIN n nb ON nb.k = b.k GROUP BY 1, 2")
def factor_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Operator 236: pairs of factor values seen, against all possible ones."""
    f = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"), F.col("p_type").alias("type"))
    f = f.unpivot("p_partkey", ["brand", "size", "type"], "k", "v")
    n = F.broadcast(f.groupBy("k").agg(F.countDistinct("v").alias("n")))
    a = f.select("p_partkey", F.col("k").alias("factor_a"), F.col("v").alias("va"))
    b = f.select("p_partkey", F.col("k").alias("factor_b"), F.col("v").alias("vb"))
    pairs = a.join(b, "p_partkey").where("factor_a < factor_b").groupBy("factor_a", "factor_b").agg(F.countDistinct("va", "vb").alias("observed"))
    return pairs.join(n.select(F.col("k").alias("factor_a"), F.col("n").alias("na")), "factor_a").join(n.select(F.col("k").alias("factor_b"), F.col("n").alias("nb")), "factor_b").select("factor_a", "factor_b", "observed", (F.col("na") * F.col("nb")).alias("possible"))


@REPORTS.query("seeded_cases", "SELECT c_custkey AS case_id, (1664525::HUGEINT * (c_custkey + 7) + 1013904223) % 4294967296 AS seed FROM customer")
def seeded_cases(spark: SparkSession, d: str) -> DataFrame:
    """Operator 237: a seed per case, here per customer, which its number alone decides."""
    i = F.col("c_custkey")
    return t(spark, d, "customer").select(i.alias("case_id"), ((F.lit(1664525) * (i + 7) + 1013904223) % 4294967296).alias("seed"))


@REPORTS.query("font_plans", """WITH f AS (SELECT p_partkey AS k, p_size AS bits, p_partkey % 7 = 0 AS std, p_partkey % 5 > 0 AS emb, p_partkey % 3 = 0 AS sym, p_partkey % 2 = 0 AS dif, CASE WHEN p_partkey % 4 = 0 THEN 'Type1' ELSE 'TrueType' END AS st, p_partkey % 11 > 3 AS mp, (p_partkey % 13) / 12.0::DOUBLE AS cov, CASE WHEN p_partkey % 17 = 0 THEN 'impossible' ELSE 'cmap' END AS rp FROM part)
SELECT CASE WHEN std THEN 'substitute-fallback' WHEN NOT emb THEN 'subset-and-embed' WHEN sym AND NOT dif THEN 'rewrite-encoding' WHEN st = 'Type1' AND (NOT mp OR cov < 1) THEN 'synthesize-type0-wrapper' WHEN (NOT mp OR cov < 1) AND rp <> 'impossible' THEN 'inject-to-unicode' WHEN NOT mp OR cov < 1 THEN 'substitute-fallback' ELSE 'embed-as-is' END AS action,
CASE WHEN bits & 2 <> 0 THEN 'restricted' WHEN bits & 8 <> 0 THEN 'editable' WHEN bits & 4 <> 0 THEN 'preview-print' WHEN bits = 0 THEN 'installable' ELSE 'unknown' END AS licence, count(*) AS n FROM f GROUP BY ALL""")
def font_plans(spark: SparkSession, d: str) -> DataFrame:
    """Operators 193, 195: actions and licence classes of fonts, parts as fonts."""
    k = F.col("p_partkey")
    plan = S.font_plan(k % 7 == 0, k % 5 > 0, k % 3 == 0, k % 2 == 0, F.when(k % 4 == 0, "Type1").otherwise("TrueType"), k % 11 > 3, k % 13 / 12, F.when(k % 17 == 0, "impossible").otherwise("cmap"))
    return t(spark, d, "part").groupBy(plan.alias("action"), S.fs_type_class(F.col("p_size")).alias("licence")).agg(F.count("*").alias("n"))


_FEATURES = "['len:' || least(length(text) // 40, 5), 'end:' || right(text, 1), 'font:' || font_size::INT, 'col:' || column_hint, 'w:' || least(len(string_split(text, ' ')) // 4, 5)]"


def _examples(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_from_documents(t(spark, d, "documents"))
    words = F.least(F.floor(F.size(F.split("text", " ")) / 4), F.lit(5))
    f = F.array(
        F.concat(F.lit("len:"), F.least(F.floor(F.length("text") / 40), F.lit(5))), F.concat(F.lit("end:"), F.right("text", F.lit(1))),
        F.concat(F.lit("font:"), F.col("font_size").cast("int")), F.concat(F.lit("col:"), F.col("column_hint")), F.concat(F.lit("w:"), words),
    )
    return b.select(F.concat("doc_id", F.lit(":"), "block_id").alias("id"), "doc_id", "role", f.alias("features"))


@REPORTS.query("bayes_counts", f"WITH {BLOCKS_SQL}, e AS (SELECT role, unnest({_FEATURES}) AS feature FROM blocks) SELECT role, feature, count(*) AS n FROM e GROUP BY ALL")
def bayes_counts(spark: SparkSession, d: str) -> DataFrame:
    """Operators 208, 209: features of blocks counted by role."""
    return bayes.train(_examples(spark, d))[1].select("role", "feature", "n")


_NB = f"""WITH {BLOCKS_SQL}, ex AS (SELECT doc_id || ':' || block_id AS id, doc_id, role, {_FEATURES} AS f FROM blocks), tr AS (SELECT * FROM ex WHERE doc_id % 5 > 0), te AS (SELECT * FROM ex WHERE doc_id % 5 = 0),
fc AS (SELECT role, feature, count(*) AS n FROM (SELECT role, unnest(f) AS feature FROM tr) GROUP BY ALL), v AS (SELECT count(DISTINCT feature) AS v FROM fc), cl AS (SELECT role, pow(n + 1, 0.35) AS pw, total FROM (SELECT role, count(*) AS n FROM tr GROUP BY 1) JOIN (SELECT role, sum(n) AS total FROM fc GROUP BY 1) USING (role)),
pr AS (SELECT role, ln(pw / sum(pw) OVER ()) AS prior, total FROM cl), tf AS (SELECT id, role AS actual, unnest(f) AS feature FROM te), sc AS (SELECT tf.id, actual, pr.role, any_value(prior) + sum(ln((coalesce(fc.n, 0) + 1) / (total + v.v)::DOUBLE)) AS s FROM tf CROSS JOIN pr CROSS JOIN v LEFT JOIN fc ON fc.role = pr.role AND fc.feature = tf.feature GROUP BY tf.id, actual, pr.role),
p AS (SELECT id, actual, arg_max(role, (s, role)) AS label, 1 / sum(exp(s - m)) AS sure FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM sc) GROUP BY id, actual)"""


@REPORTS.query("bayes_predictions", f"{_NB} SELECT id, label, round(sure, 6) AS confidence, sure < 0.55 AS abstained FROM p")
def bayes_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Operator 210: roles of held-out blocks."""
    e = _examples(spark, d)
    p = bayes.predict(e.where("doc_id % 5 = 0"), *bayes.train(e.where("doc_id % 5 > 0")))
    return p.select("id", "label", F.round("confidence", 6).alias("confidence"), "abstained")


_NB_ALL = _NB.replace("te AS (SELECT * FROM ex WHERE doc_id % 5 = 0)", "te AS (SELECT * FROM ex)")


@REPORTS.query("bayes_predictions_all_blocks", f"{_NB_ALL} SELECT id, split_part(id, ':', 1)::BIGINT % 5 = 0 AS held_out, label, round(sure, 6) AS confidence, sure < 0.55 AS abstained FROM p")
def bayes_predictions_all_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Operator 210: roles of all blocks, and whether the block was held out from training."""
    e = _examples(spark, d)
    p = bayes.predict(e, *bayes.train(e.where("doc_id % 5 > 0")))
    return p.select("id", (F.split("id", ":")[0].cast("long") % 5 == 0).alias("held_out"), "label", F.round("confidence", 6).alias("confidence"), "abstained")


@REPORTS.query("bayes_evaluation", f"{_NB}, b AS (SELECT least(floor(sure * 10), 9) AS bin, count(*) AS n, sum(CASE WHEN actual = label THEN 1.0::DOUBLE ELSE 0 END) AS hits, sum(sure) AS s, sum(pow(sure - CASE WHEN actual = label THEN 1 ELSE 0 END, 2)) AS sq FROM p GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(hits) / sum(n), 6) AS accuracy, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(hits - s)) / sum(n), 6) AS ece FROM b")
def bayes_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Operator 211: accuracy and calibration on held-out blocks."""
    e = _examples(spark, d)
    p = bayes.predict(e.where("doc_id % 5 = 0"), *bayes.train(e.where("doc_id % 5 > 0"))).join(e.select("id", "role"), "id")
    r = bayes.evaluate(p)
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "ece")])


@REPORTS.query("confusion_matrix", f"{_NB} SELECT actual, count(*) FILTER (label = 'H1') AS h1, count(*) FILTER (label = 'H2') AS h2, count(*) FILTER (label = 'LI') AS li, count(*) FILTER (label = 'P') AS p FROM p GROUP BY 1")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Operator 211: the confusion matrix as a pivot."""
    e = _examples(spark, d)
    p = bayes.predict(e.where("doc_id % 5 = 0"), *bayes.train(e.where("doc_id % 5 > 0"))).join(e.select("id", "role"), "id")
    m = p.groupBy(F.col("role").alias("actual")).pivot("label", ["H1", "H2", "LI", "P"]).count().na.fill(0)
    return m.select("actual", *[F.col(c).alias(c.lower()) for c in ("H1", "H2", "LI", "P")])


@REPORTS.query("structure_fidelity")
def structure_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Operator 93: common subsequence of the role sequences of neighbouring documents."""
    b = blocks_from_documents(t(spark, d, "documents"))
    s = b.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role"))), lambda x: x["role"]).alias("roles"))
    n = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("roles").alias("other"))

    @F.pandas_udf("double")
    def ratio(a, b):
        return (a.combine(b, lambda x, y: O.common_length(list(x), list(y)) / max(len(x), len(y), 1))).astype(float)

    return s.join(n, "doc_id").select("doc_id", F.round(ratio("roles", "other"), 6).alias("fidelity"))
