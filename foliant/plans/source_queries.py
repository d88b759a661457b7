"""Round trips of given tables through the sources: contracts, review logs and folders of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.registry import Registry
from foliant.sources import files
from foliant.sources.tables import read_table
from foliant.streaming.runs import new_folder

SOURCES = Registry()

_CONTRACT = "documentId string, pageCount int, nodes array<struct<id: bigint, text: string, page: int>>"


def _contracts(spark: SparkSession, d: str) -> str:
    """A JSON document per nation with its customers as nodes; of every tenth nation the end is cut off, of every seventh the page count is missing."""
    folder, n = new_folder(spark, "contracts"), F.col("c_nationkey")
    nodes = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), (F.col("c_custkey") % 5).cast("int").alias("page"))))
    docs = read_table(spark, d, "customer").groupBy("c_nationkey").agg(nodes.alias("nodes"))
    text = F.to_json(F.struct(n.cast("string").alias("documentId"), F.when(n % 7 != 3, F.lit(5)).alias("pageCount"), "nodes"), {"pretty": "true"})
    cut = F.when(n % 10 == 9, F.substring(text, 1, 60)).otherwise(text)
    docs.select(n.alias("document"), cut.alias("value")).repartition("document").write.partitionBy("document").text(folder)
    return folder


@SOURCES.query("contract_documents", """WITH c AS (SELECT c_nationkey AS n, count(*) AS k, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1)
SELECT CASE WHEN n % 10 <> 9 THEN n::VARCHAR END AS document_id, CASE WHEN n % 10 <> 9 THEN k END AS n_nodes, CASE WHEN n % 10 <> 9 THEN ids END AS ids, CASE WHEN n % 10 = 9 THEN 'corrupt' WHEN n % 7 = 3 THEN 'missing pageCount' END AS problem FROM c""")
def contract_documents(spark: SparkSession, d: str) -> DataFrame:
    """Customers by nation as JSON contracts, read back and checked against their schema."""
    read = files.read_contract(spark, _contracts(spark, d), _CONTRACT, ["documentId", "pageCount", "nodes"])
    sound = F.coalesce(F.col("problem") != "corrupt", F.lit(True))
    ids = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x["id"])
    return read.select(F.when(sound, F.col("documentId")).alias("document_id"), F.when(sound, F.size("nodes").cast("long")).alias("n_nodes"), F.when(sound, ids).alias("ids"), "problem")


@SOURCES.query("review_log", "SELECT o_custkey AS item_key, arg_max(o_orderstatus, o_orderkey) AS decision, max(o_orderkey) AS reviewed FROM orders GROUP BY 1")
def review_log(spark: SparkSession, d: str) -> DataFrame:
    """Operators 55, 169: orders as reviews of customers in JSON lines, appended by number; the last one counts."""
    folder = new_folder(spark, "reviews")
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("item_key"), F.col("o_orderstatus").alias("decision"), F.col("o_orderkey").alias("reviewed"))
    rows.orderBy("reviewed").write.json(folder)
    return files.last_appended(files.read_log(spark, folder, "item_key bigint, decision string, reviewed bigint"), "item_key")


@SOURCES.query("artifact_files", "SELECT DISTINCT 'document=' || c_nationkey AS folder, 'txt' AS kind, true AS filled FROM customer")
def artifact_files(spark: SparkSession, d: str) -> DataFrame:
    """Operator 70: the files of a folder of contracts."""
    found = files.inventory(spark, _contracts(spark, d), "*.txt")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("name", r"\."), -1).alias("kind"), (F.col("bytes") > 0).alias("filled"))
