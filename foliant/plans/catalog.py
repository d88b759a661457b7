"""All queries of the library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.html_queries import HTML
from foliant.plans.layout_queries import LAYOUT
from foliant.plans.match_queries import MATCHES
from foliant.plans.model_queries import MODELS
from foliant.plans.more_queries import MORE
from foliant.plans.registry import Registry
from foliant.plans.report_queries import REPORTS
from foliant.plans.sequence_queries import SEQUENCES
from foliant.plans.source_queries import SOURCES
from foliant.plans.state_queries import STATE
from foliant.plans.table_queries import TABLES
from foliant.plans.tag_queries import TAGS
from foliant.plans.text_queries import TEXT
from foliant.sources.tables import read_table

REGISTRY = Registry()


@REGISTRY.query(
    "source_text_summary",
    r"""SELECT source, lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents GROUP BY ALL""",
)
def source_text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and lines by source and language."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.split("text", "\n"))).alias("n_lines"))


for _part in (TEXT, LAYOUT, REPORTS, HTML, SEQUENCES, MORE, MODELS, TAGS, TABLES, MATCHES, SOURCES, STATE):
    for _name, _query in _part.queries.items():
        REGISTRY.query(_name, _part.oracles.get(_name))(_query)
