"""Writers: the deposit's columns, reports, pools and tables of text."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deposit(works: DataFrame, flags: dict[str, str], renames: dict[str, str], drops: Sequence[str] = ()) -> DataFrame:
    """works with flagged and flag_reason in place of boolean flags, columns renamed and dropped."""
    reasons = F.concat_ws("; ", *(F.when(F.col(c), F.lit(said)) for c, said in flags.items()))
    out = works.withColumn("flag_reason", F.nullif(reasons, F.lit(""))).withColumn("flagged", F.col("flag_reason").isNotNull()).drop(*flags, *drops)
    return out.withColumnsRenamed(renames)


def write_csv(df: DataFrame, path: str) -> None:
    """All rows or none: the committer moves finished files into place."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def append_pool(df: DataFrame, path: str) -> None:
    """Lines of compressed JSON added to a pool."""
    df.write.mode("append").option("compression", "gzip").json(path)


def report(df: DataFrame, **counters: Column) -> DataFrame:
    """One row, report: counters of a table as JSON."""
    return df.agg(F.to_json(F.struct(*(c.alias(k) for k, c in counters.items()))).alias("report"))


def new_only(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Rows whose key the pool lacks."""
    return df.join(pool.select(key).distinct(), key, "left_anti")


def markdown(rows: DataFrame, most: int = 500) -> str:
    """A small table as Markdown; raises beyond so many rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", r"\|") for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, got)])


def yaml_vars(rows: DataFrame, most: int = 500) -> str:
    """The lines of a YAML mapping from a small table of metric and value, in the order of the metrics; raises beyond so many rows."""
    got = rows.select("metric", "value").orderBy("metric").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return "".join(f"{json.dumps(str(r.metric), ensure_ascii=False)}: {json.dumps(r.value, ensure_ascii=False)}\n" for r in got)
