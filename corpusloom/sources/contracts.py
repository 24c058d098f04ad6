"""Contracts of tables: columns, types and conditions, and how far a table keeps them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """schema in DDL; required columns without nulls; unique columns; conditions by name; whether other columns are refused."""

    schema: str
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    strict: bool = True


DIVERGENCE = Contract("year int, channel string, window string, hyperparams string, value double", ("year", "channel", "window"), checks={"channel": "channel IN ('semantic', 'lexical', 'citation')"})
CONCENTRATION = Contract("year bigint, hhi double, shannon_entropy double, n_venues bigint, n_papers bigint", ("year",), ("year",), {"hhi": "hhi BETWEEN 0 AND 1", "papers": "n_papers > 0"})
FLOW = Contract("Stage string, In bigint, Removed bigint, Out bigint", ("Stage",), ("Stage",), {"in": "`In` > 0", "removed": "Removed >= 0"})
WORKS = Contract("source string, source_id string, doi string, title string, year int", ("source", "source_id"), strict=False)


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """rule and n: rows against each rule, all rules in one pass but for uniqueness; missing and surplus columns count as one."""
    names = [x.strip().split()[0].strip("`") for x in contract.schema.split(",")]
    lost = [c for c in names if c not in df.columns]
    extra = [c for c in df.columns if c not in names] if contract.strict else []
    rules = [(f"column {c}", 1) for c in lost] + [(f"surplus {c}", 1) for c in extra]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in contract.required if c in df.columns]
    aggs += [F.count_if(~F.coalesce(F.expr(e), F.lit(True))).alias(f"check {k}") for k, e in contract.checks.items()]
    aggs += [(F.count(c) - F.count_distinct(c)).alias(f"unique {c}") for c in contract.unique if c in df.columns]
    found = df.sparkSession.createDataFrame(rules, "rule string, n long")
    if aggs:
        row = df.agg(*aggs)
        found = found.union(row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in row.columns))).alias("x")).select("x.*"))
    return found.where("n > 0")


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """df cast to the contract's columns and types, others kept unless it is strict; raises if a rule is broken."""
    broken = violations(df, contract).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in broken))
    kinds = [x.strip().split() for x in contract.schema.split(",")]
    cast = [F.col(c).cast(k).alias(c) for c, k in kinds]
    return df.select(*cast, *(c for c in df.columns if not contract.strict and c not in dict(kinds)))
