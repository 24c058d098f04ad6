"""The divergence methods by name, each giving one contract: year, channel, window, hyperparams and value.

Window is text (cumulative where a method has none), hyperparams are text and null where a method has none, so summaries and change points run over any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import kernels
from corpusloom.plans import divergence_queries, kernel_queries  # noqa: F401  they register what is named below
from corpusloom.plans.registry import ORACLES, QUERIES, query

C = F.col


class Method(NamedTuple):
    """A method's channel, the query that computes it, and the columns that its values stand in, each under the hyperparams that it means (None: the query says)."""

    channel: str
    query: str
    values: tuple[tuple[str, str | None], ...] = (("value", None),)


METHODS: dict[str, Method] = {
    "S1_MMD": Method("semantic", "div_s1"),
    "S2_energy": Method("semantic", "div_s2"),
    "S3_sliced_wasserstein": Method("semantic", "div_s3"),
    "S4_frechet": Method("semantic", "div_s4"),
    "L1": Method("lexical", "div_l1"),
    "L2": Method("lexical", "div_l2", (("novelty", "novelty"), ("transience", "transience"), ("resonance", "resonance"))),
    "L3": Method("lexical", "div_l3"),
    "G1_pagerank": Method("citation", "div_g1"),
    "G2_spectral": Method("citation", "div_g2"),
    "G3_coupling_age": Method("citation", "div_g3"),
    "G4_cross_tradition": Method("citation", "div_g4"),
    "G5_pref_attachment": Method("citation", "div_g5"),
    "G6_entropy": Method("citation", "div_g6"),
    "G7_disruption": Method("citation", "div_g7_year"),
    "G8_betweenness": Method("citation", "div_g8"),
    "G9_community": Method("citation", "div_g9"),
    "C2ST_embedding": Method("semantic", "div_c2st_emb"),
    "C2ST_lexical": Method("lexical", "div_c2st_lex"),
}
CONTRACT = ["year", "channel", "window", "hyperparams", "value"]


def series(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One method's values in the contract."""
    if name not in METHODS:
        raise ValueError(f"no method {name}; there are {', '.join(METHODS)}")
    m = METHODS[name]
    df = QUERIES[m.query](spark, sf_dir)
    year = C("anchor") if "anchor" in df.columns else C("year")
    window = C("window").cast("string") if "window" in df.columns else F.lit("cumulative")
    said = C("hyperparams").cast("string") if "hyperparams" in df.columns else F.lit(None).cast("string")
    cells = F.array(*(F.struct((said if h is None else F.lit(h)).alias("hyperparams"), C(v).cast("double").alias("value")) for v, h in m.values))
    return df.select(year.cast("long").alias("year"), F.lit(m.channel).alias("channel"), window.alias("window"), F.explode(cells).alias("x")).select("year", "channel", "window", "x.hyperparams", "x.value")


def all_series(spark: SparkSession, sf_dir: str, names: Sequence[str] = tuple(METHODS)) -> DataFrame:
    """Several methods' values in the contract, with method."""
    each = [series(spark, sf_dir, n).withColumn("method", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, each).select("method", *CONTRACT)


def series_sql(name: str, columns: Callable[[str], bool]) -> str:
    """The DuckDB statement of series; columns says which of anchor, window and hyperparams the query has."""
    m = METHODS[name]
    year, window, said = "anchor" if columns("anchor") else "year", 'CAST("window" AS VARCHAR)' if columns("window") else "'cumulative'", "hyperparams" if columns("hyperparams") else "CAST(NULL AS VARCHAR)"
    parts = [f"SELECT '{name}' AS method, CAST({year} AS BIGINT) AS year, '{m.channel}' AS channel, {window} AS \"window\", {said if h is None else repr(h)} AS hyperparams, CAST({v} AS DOUBLE) AS value FROM q" for v, h in m.values]
    return f"SELECT * FROM (WITH q AS ({ORACLES[m.query]}) {' UNION ALL '.join(parts)})"


#: Methods that SQL can state, with the columns that their queries have beside the values.
STATED = {"S1_MMD": "anchor window hyperparams", "S2_energy": "anchor window", "L1": "anchor window", "L2": "anchor window", "L3": "", "G3_coupling_age": "", "G6_entropy": "anchor window", "G7_disruption": ""}


@query("div_methods", " UNION ALL ".join(series_sql(n, STATED[n].split().__contains__) for n in STATED))
def div_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods that SQL can state, in one contract."""
    return all_series(spark, sf_dir, tuple(STATED))


@query("rs_cp_methods")
def rs_cp_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of every method's series, whatever the method: those of div_methods and of the sliced and the degree methods."""
    s = all_series(spark, sf_dir, (*STATED, "S3_sliced_wasserstein", "G5_pref_attachment")).withColumn("hyperparams", F.coalesce("hyperparams", F.lit("default")))
    return kernels.change_points(s, "year", "value", ["method", "window", "hyperparams"])
