"""Registered queries and the SQL that checks them."""

from pyspark.sql import DataFrame, SparkSession

from scholia.operators.bibliometrics import author_stats
from scholia.operators.ranking import dedupe_papers
from scholia.plans import documents, papers
from scholia.sources.sample import papers_view

QUERIES = {**papers.QUERIES, **documents.QUERIES}
ORACLE_SQL = {**papers.ORACLE_SQL, **documents.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers deduplicated, then their top authors."""
    return author_stats(dedupe_papers(papers_view(spark, sf_dir)))
