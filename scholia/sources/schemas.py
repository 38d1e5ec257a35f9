"""Schemas of the record formats, as Spark DDL.  Field names are fixed by the formats."""

PAPER = """
Title STRING, KeyWords STRING, Abstract STRING, Journal STRING, Database STRING,
PageRange STRING, PublicationYear STRING, FirstAuthor STRING,
Authors ARRAY<STRUCT<name: STRING, id: STRING, corresponding: BOOLEAN>>,
Affiliations ARRAY<STRUCT<id: STRING, name: STRING>>,
CoreJournalIndexes ARRAY<STRUCT<name: STRING, description: STRING>>,
Source STRUCT<type: STRING, title: STRING, year: STRING, volume: STRING, issue: STRING>,
Funds ARRAY<STRUCT<title: STRING>>, DetailedKeywords ARRAY<STRING>,
Metrics STRUCT<download_count: INT, citation_count: INT>,
Publishing STRUCT<status: STRING, modes: ARRAY<STRING>>,
Repository STRUCT<resource: STRING, dataset: STRING, type: STRING,
                  subject_category_1: STRING, subject_category_2: STRING>
"""

RAW_RESULTS = """
code STRING, message STRING, data STRUCT<total: BIGINT, size: BIGINT, data: ARRAY<STRUCT<
metadata: ARRAY<STRUCT<name: STRING, value: STRING>>,
authors: ARRAY<STRUCT<title: STRING, id: STRING, corresponding: BOOLEAN>>,
affiliations: ARRAY<STRUCT<id: STRING, title: STRING>>,
indexes: ARRAY<STRUCT<name: STRING, value: STRING>>,
source: STRUCT<type: STRING, title: STRING, year: STRING, volume: STRING, issue: STRING,
               pages: STRING, pageRange: STRING>,
funds: ARRAY<STRUCT<title: STRING>>,
keywords: ARRAY<STRUCT<items: ARRAY<STRUCT<item: STRING>>>>,
metrics: ARRAY<STRUCT<name: STRING, value: STRING>>,
publishing: STRUCT<status: STRING, modes: ARRAY<STRING>>,
repository: STRUCT<resource: STRING, dataset: STRING, type: STRING, ccl1: STRING, ccl2: STRING>>>>
"""

#: The fields of an extracted thesis, in the order of the format.
THESIS_FIELDS = (
    "thesis_number", "title_cn", "author_cn", "title_en", "author_en", "university_cn", "university_en",
    "degree_level", "major_cn", "college", "supervisor_cn", "supervisor_en", "defense_date",
    "submission_date", "abstract_cn", "abstract_en", "keywords_cn", "keywords_en",
    "theoretical_framework", "acknowledgement", "references", "author_contributions",
)
