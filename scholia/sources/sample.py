"""Paper records built from a star schema of orders, for queries and checks.

An order stands for a paper, its lines' suppliers for the authors, their nations for the
affiliations, the customer's region and nation for the subjects, part types for funds and
keywords.  PAPERS_SQL builds the same rows, flat, for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: what a paper's lines hold.
LINE_FIELDS = ("s_name", "s_suppkey", "s_nation", "p_type")
MADE_FROM = {"FirstAuthor": ("s_name",), "Authors": ("s_name", "s_suppkey"), "Affiliations": ("s_suppkey", "s_nation"), "Funds": ("p_type",), "KeyWords": ("p_type",), "DetailedKeywords": ("p_type",)}


def papers_view(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = LINE_FIELDS) -> DataFrame:
    """The papers; of the columns made from lines, those whose fields are asked for (an optimizer cannot take fields out of collected lists)."""
    orders, lines, customers, suppliers, parts, nations, regions = (
        load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region")
    )
    people = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("s_nation"))
    # the larger table is joined while the rows are narrow
    told = lines.join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left").join(people, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    by_order = told.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", *[f for f in LINE_FIELDS if f in fields]))).alias("x"),
        F.sum("l_quantity").cast("int").alias("downloads"), F.count(F.lit(1)).cast("int").alias("citations"),
    )
    places = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    whole = orders.join(by_order, "o_orderkey", "left").join(places, F.col("o_custkey") == F.col("c_custkey"), "left")
    year, chinese = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 2 == 0
    # a field that was not asked for is null here, and what is made from it is left out below
    of = lambda r, c: r[c] if c in fields else F.lit(None).cast("string")
    keywords = F.transform("x", lambda r: of(r, "p_type"))
    authors = F.transform("x", lambda r: F.struct(of(r, "s_name").alias("name"), of(r, "s_suppkey").cast("string").alias("id"), (r["l_linenumber"] == 1).alias("corresponding")))
    return whole.select(
        F.col("o_custkey").alias("thesis_id"), F.when(chinese, "Chinese").otherwise("English").alias("lang"), F.col("o_orderkey").alias("pos"),
        F.concat_ws(" ", "c_name", "o_orderstatus", "o_orderpriority").alias("Title"),
        F.when(chinese, F.array_join(keywords, ";;")).otherwise(F.array_join(keywords, ";")).alias("KeyWords"),
        F.concat_ws(" ", "c_mktsegment", "n_name").alias("Abstract"), F.col("o_orderpriority").alias("Journal"), year.alias("PublicationYear"),
        F.get(authors, F.lit(0))["name"].alias("FirstAuthor"), authors.alias("Authors"),
        F.transform("x", lambda r: F.struct(of(r, "s_suppkey").cast("string").alias("id"), of(r, "s_nation").alias("name"))).alias("Affiliations"),
        F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit("").alias("description"))).alias("CoreJournalIndexes"),
        F.struct(
            F.when(F.col("o_orderstatus") == "O", "JOURNALS").otherwise("CONFERENCES").alias("type"), F.col("o_orderpriority").alias("title"), year.alias("year"),
            F.lit("1").alias("volume"), F.month("o_orderdate").cast("string").alias("issue"),
        ).alias("Source"),
        F.transform("x", lambda r: F.struct(of(r, "p_type").alias("title"))).alias("Funds"),
        F.when(F.col("o_orderkey") % 3 == 0, keywords).alias("DetailedKeywords"),
        F.struct(F.col("downloads").alias("download_count"), F.col("citations").alias("citation_count")).alias("Metrics"),
        F.struct(F.col("r_name").alias("subject_category_1"), F.col("n_name").alias("subject_category_2")).alias("Repository"),
        F.to_date("o_orderdate").alias("pub_date"),
    ).drop(*[c for c, need in MADE_FROM.items() if not set(need) <= set(fields)])


#: l: lines with author, affiliation and fund; p: papers without the nested parts.
PAPERS_SQL = """
l AS (SELECT l_orderkey AS pos, l_linenumber AS ln, s_name AS author, n_name AS affiliation, p_type AS fund,
             l_linenumber = 1 AS corresponding, l_suppkey AS author_id
      FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
      LEFT JOIN part ON l_partkey = p_partkey),
lm AS (SELECT l_orderkey AS pos, CAST(sum(l_quantity) AS INTEGER) AS downloads, CAST(count(*) AS INTEGER) AS citations FROM lineitem GROUP BY 1),
lk AS (SELECT pos, list(fund ORDER BY ln, author, author_id, affiliation, fund) AS kws FROM l GROUP BY 1),
p AS (SELECT o_custkey AS thesis_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Chinese' ELSE 'English' END AS lang, o_orderkey AS pos,
             concat_ws(' ', c_name, o_orderstatus, o_orderpriority) AS title, o_orderpriority AS journal,
             CAST(year(o_orderdate) AS VARCHAR) AS year, c_mktsegment AS core_index, r_name AS subject_1, n_name AS subject_2,
             CASE WHEN o_orderstatus = 'O' THEN 'JOURNALS' ELSE 'CONFERENCES' END AS source_type,
             concat_ws(' ', c_mktsegment, n_name) AS abstract, CAST(month(o_orderdate) AS VARCHAR) AS issue,
             downloads, citations, kws, CAST(o_orderdate AS DATE) AS pub_date,
             CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(kws, ';;') ELSE array_to_string(kws, ';') END AS keywords
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lm ON lm.pos = o_orderkey LEFT JOIN lk ON lk.pos = o_orderkey)
"""
