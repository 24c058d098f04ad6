"""Queries over the descriptive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import describe
from corpusloom.plans.registry import query
from corpusloom.plans.session import table


@query(
    "agg_hhi",
    """
    WITH c AS (
      SELECT year(o_orderdate) AS year, p_brand AS venue, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      WHERE o_orderdate IS NOT NULL AND p_brand IS NOT NULL AND trim(p_brand) <> '' GROUP BY 1, 2),
    s AS (SELECT year, n, sum(n) OVER (PARTITION BY year) AS t FROM c)
    SELECT year, round(sum((n * 1.0 / t) * (n * 1.0 / t)), 6) AS hhi,
           round(-sum((n * 1.0 / t) * ln(n * 1.0 / t)), 6) AS shannon_entropy,
           count(*) AS n_venues, CAST(max(t) AS BIGINT) AS n_papers
    FROM s GROUP BY year
    """,
)
def agg_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    works = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey)
    return describe.concentration(works, "y", "p_brand")
