"""Works and citations made of the test tables, as DataFrames and as the CTEs that say the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.session import deal, table

#: works: documents as bibliographic records. The first line is the title; the rest follows from doc_id.
WORKS = """works AS (
  SELECT doc_id, text AS abstract, lang, source, string_split(text, chr(10))[1] AS title,
         CASE WHEN doc_id % 5 <> 0 THEN concat('https://doi.org/10.', 1000 + doc_id % 37, '/AB.', doc_id % 400) END AS doi,
         CASE WHEN doc_id % 11 <> 0 THEN 1995 + doc_id % 10 END AS year, doc_id % 90 AS cited,
         CASE WHEN doc_id % 13 <> 0 THEN concat('Author ', doc_id % 60, ' Sur', doc_id % 25) END AS author,
         1 + doc_id % 3 AS source_count FROM documents)"""

#: edges: an order cites each of its parts once; year is the order's.
EDGES = """edges AS (
  SELECT DISTINCT l_orderkey AS src, l_partkey AS ref, CAST(year(o_orderdate) AS BIGINT) AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: vectors: embeddings in double precision with a year.
VECTORS = "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label, 1995 + vec_id % 7 AS year FROM embeddings)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text AS abstract", "lang", "source", "split(text, '\\n')[0] AS title",
        "CASE WHEN doc_id % 5 <> 0 THEN concat('https://doi.org/10.', 1000 + doc_id % 37, '/AB.', doc_id % 400) END AS doi",
        "CASE WHEN doc_id % 11 <> 0 THEN 1995 + doc_id % 10 END AS year", "doc_id % 90 AS cited",
        "CASE WHEN doc_id % 13 <> 0 THEN concat('Author ', doc_id % 60, ' Sur', doc_id % 25) END AS author",
        "1 + doc_id % 3 AS source_count",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = deal(table(spark, sf_dir, "lineitem")).select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("ref")).distinct()
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.year("o_orderdate").cast("long").alias("year"))
    return lines.join(orders, "src").select("src", "ref", "year")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS array<double>) AS v", "CAST(label AS bigint) AS label", "1995 + vec_id % 7 AS year")


#: records: works that several sources report, with repeated identifiers and gaps.
RECORDS = """records AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN concat('10.1000/', doc_id % 350) END AS doi,
         CASE WHEN doc_id % 19 <> 0 THEN substr(string_split(text, chr(10))[1], 1, 9) ELSE '' END AS title,
         CASE WHEN doc_id % 11 <> 0 THEN CAST(1995 + doc_id % 3 AS BIGINT) END AS year,
         CASE WHEN doc_id % 3 <> 0 THEN concat('Author ', doc_id % 60) END AS author, doc_id % 90 AS cited,
         doc_id % 4 AS rank, doc_id % 2 AS from_a, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS from_b FROM documents)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "CASE WHEN doc_id % 5 <> 0 THEN concat('10.1000/', doc_id % 350) END AS doi",
        "CASE WHEN doc_id % 19 <> 0 THEN substr(split(text, '\\n')[0], 1, 9) ELSE '' END AS title",
        "CASE WHEN doc_id % 11 <> 0 THEN 1995 + doc_id % 3 END AS year",
        "CASE WHEN doc_id % 3 <> 0 THEN concat('Author ', doc_id % 60) END AS author", "doc_id % 90 AS cited",
        "doc_id % 4 AS rank", "doc_id % 2 AS from_a", "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS from_b",
    )
