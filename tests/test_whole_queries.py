"""Queries that take every row, page and block of their tables."""

from pyspark.sql import functions as F

from foliant.plans.catalog import REGISTRY
from foliant.sources.blocks import blocks_from_documents

DIR = "/root/testdata/sf0.001"


def test_batches_count_every_job(spark):
    r = REGISTRY.queries["batch_status"](spark, DIR).agg(F.sum("n_jobs"), F.sum("n_missing"), F.sum("n_batches")).first()
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    assert tuple(r) == (orders.count(), orders.where("o_orderkey % 3 = 0").count(), spark.read.parquet(f"{DIR}/customer.parquet").count())


def test_bands_of_later_pages_count(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(["line"] * 160)), (2, "one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n for r in REGISTRY.queries["band_overlaps"](spark, str(tmp_path)).collect()}
    y = [72 + 14 * (k % 50) + 2 * (k % 9 == 0) for k in range(160)]
    assert got == {1: sum((v < 100 and v + 12 > 60) or (v < 780 and v + 12 > 740) for v in y), 2: 1}


def test_every_block_gets_a_role(spark):
    got = REGISTRY.queries["bayes_predictions_all_blocks"](spark, DIR)
    blocks = blocks_from_documents(spark.read.parquet(f"{DIR}/documents.parquet"))
    assert {r[0]: r[1] for r in got.groupBy("held_out").count().collect()} == {True: blocks.where("doc_id % 5 = 0").count(), False: blocks.where("doc_id % 5 > 0").count()}
