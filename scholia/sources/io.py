"""Readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.text import blank_to_null, strip_tags
from scholia.sources.schemas import PAPER, RAW_RESULTS


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; where that is unset, a temporary one, on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
    return f"{path}/{name}-{uuid.uuid4().hex}"


def read_papers(spark: SparkSession, path: str, arrays: bool = True) -> DataFrame:
    """Stored paper lists (JSON arrays, or else a record a line) with thesis, kind and language taken from the names of
    files, or of folders of part files, such as `<thesis>_relevant_papers_dedup_Chinese.json`."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:/|$)", 1)
    return spark.read.schema(PAPER).json(path, multiLine=arrays).withColumns(
        {
            "thesis_id": F.regexp_extract(name, r"^(.*?)_(?:relevant|TOP)", 1),
            "kind": F.when(name.contains("TOP"), F.lower(F.regexp_extract(name, r"(TOP\d+)", 1))).when(name.contains("dedup"), "dedup").otherwise("raw"),
            "lang": F.regexp_extract(name, r"_([A-Za-z]+)$", 1),
        }
    )


def read_documents(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Whole text files of a folder: path, text."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_raw_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_RESULTS).json(path, multiLine=True)


def _digits(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]+$"), value.try_cast("int")).otherwise(0)


def normalize_search_results(raw: DataFrame) -> DataFrame:
    """S3: one paper record per item of a search response (EAV metadata to columns, tags stripped)."""
    item = raw.select(F.explode("data.data").alias("x")).select("x.*")
    last = lambda arr, key, val: F.element_at(F.filter(arr, lambda m: m["name"] == key), -1)[val]
    meta = lambda key: F.when(F.exists("metadata", lambda m: m["name"] == key), last(F.col("metadata"), key, "value"))
    metric = lambda key: F.coalesce(_digits(F.when(F.exists("metrics", lambda m: m["name"] == key), last(F.col("metrics"), key, "value"))), F.lit(0))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    authors = F.transform(
        some("authors"),
        lambda a: F.struct(F.coalesce(a["title"], F.lit("")).alias("name"), F.coalesce(a["id"], F.lit("")).alias("id"), F.coalesce(a["corresponding"], F.lit(False)).alias("corresponding")),
    )
    groups = F.filter("keywords", lambda g: g["items"].isNotNull())
    flat = F.flatten(F.transform(groups, lambda g: F.transform(g["items"], lambda i: strip_tags(i["item"]))))
    pages = F.coalesce(blank_to_null(strip_tags(meta("PM"))), blank_to_null(strip_tags(F.coalesce("source.pages", "source.pageRange"))))
    return item.select(
        strip_tags(meta("TI")).alias("Title"), strip_tags(meta("KY")).alias("KeyWords"), strip_tags(meta("AB")).alias("Abstract"),
        strip_tags(meta("LY")).alias("Journal"), meta("DB").alias("Database"), pages.alias("PageRange"),
        F.coalesce(meta("YE"), F.lit("")).alias("PublicationYear"), F.get(authors, F.lit(0))["name"].alias("FirstAuthor"),
        authors.alias("Authors"),
        F.transform(some("affiliations"), lambda a: F.struct(a["id"].alias("id"), a["title"].alias("name"))).alias("Affiliations"),
        F.transform(some("indexes"), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("description"))).alias("CoreJournalIndexes"),
        F.struct("source.type", "source.title", "source.year", "source.volume", "source.issue").alias("Source"),
        some("funds").alias("Funds"), F.when(F.size(flat) > 0, flat).alias("DetailedKeywords"),
        F.when(F.size("metrics") > 0, F.struct(metric("DTC").alias("download_count"), metric("CTC").alias("citation_count"))).alias("Metrics"),
        F.col("publishing").alias("Publishing"),
        F.struct(
            "repository.resource", "repository.dataset", "repository.type",
            F.col("repository.ccl1").alias("subject_category_1"), F.col("repository.ccl2").alias("subject_category_2"),
        ).alias("Repository"),
    )


def write_papers(papers: DataFrame, path: str, format: str = "parquet") -> None:
    """Papers by language, one folder each."""
    papers.write.mode("overwrite").partitionBy("lang").format(format).save(path)


def with_provenance(extractions: DataFrame, method: str, version: str, text_col: str = "text") -> DataFrame:
    """When and how a row was extracted, and the digest of what from."""
    return extractions.withColumns(
        {"method": F.lit(method), "extractor_version": F.lit(version), "extracted_at": F.current_timestamp(), "content_md5": F.md5(text_col)}
    )


def write_extractions(extractions: DataFrame, path: str, method: str, version: str) -> None:
    with_provenance(extractions, method, version).write.mode("append").parquet(path)


def pending_documents(docs: DataFrame, done: DataFrame, keys=("doc_id", "content_md5")) -> DataFrame:
    """Documents without a stored result of the same content."""
    return docs.withColumn("content_md5", F.md5("text")).join(done.select(*keys), list(keys), "left_anti")


def reuse_documents(docs: DataFrame, done: DataFrame, keys=("doc_id", "content_md5")) -> DataFrame:
    return docs.withColumn("content_md5", F.md5("text")).join(done.select(*keys), list(keys), "left_semi")


def pick_best_version(versions: DataFrame, keys: list[str], priority: list[str], required: list[str], version_col: str = "version") -> DataFrame:
    """Of each key's versions with all required fields filled, the first in priority."""
    rank = F.coalesce(*[F.when(F.col(version_col) == v, k) for k, v in enumerate(priority)], F.lit(len(priority)))
    whole = versions
    for c in required:
        whole = whole.where(blank_to_null(F.col(c)).isNotNull())
    first = Window.partitionBy(*keys).orderBy(rank, version_col)
    return whole.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def artifact_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: thesis, kind, length (content is not read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        F.regexp_extract(name, r"^([^_.]+)", 1).alias("thesis_id"),
        F.when(name.contains("extracted"), "extraction").when(name.contains("TOP"), "top").when(name.contains("papers"), "papers").otherwise("other").alias("kind"),
        "length",
    )


def artifact_inventory(files: DataFrame) -> DataFrame:
    """Per thesis, the number and bytes of stored files and which kinds there are."""
    kinds = ("extraction", "papers", "top")
    return files.groupBy("thesis_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"),
        *[F.max(F.col("kind") == k).alias(f"has_{k}") for k in kinds],
    )
