"""Poisson bootstraps: every unit carries a weight for each replicate, told by a hash, so all replicates are summed in one pass and no row is copied."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the distribution function of Poisson(1) passes parts of 65,536; a draw is the number of these at or below 16 bits of a hash.
STEPS = [math.floor(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8)]
#: Draws of 16 bits in one digest.
PER_DIGEST = 8


def poisson_weights(units: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """id and w, an array of Poisson(1) weights, one a replicate, of every distinct unit (id) that isn't null.

    Weights follow from the MD5 digests of seed, number of the digest and id, eight replicates a digest, so any engine can repeat them.
    """
    digests = -(-replicates // PER_DIGEST)

    def drawn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column("id").to_pylist()
            raw = b"".join(hashlib.md5(f"{seed}|{d}|{i}".encode()).digest() for i in ids for d in range(digests))
            w = np.searchsorted(STEPS, np.frombuffer(raw, ">u2").reshape(len(ids), -1)[:, :replicates], "right").astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * replicates, pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["id", "w"])

    distinct = units.select("id").where("id IS NOT NULL").distinct()
    return distinct.mapInArrow(drawn, f"id {dict(units.dtypes)['id']}, w array<int>")


#: The same weights in DuckDB, as a list from an expression for the id.
SQL_WEIGHTS = "list_transform(range({replicates}), lambda r: len(list_filter({steps}, lambda s: s <= CAST(concat('0x', substr(md5(concat('{seed}|', r // 8, '|', {id})), 4 * (r % 8) + 1, 4)) AS INTEGER))))"


def sql_weights(id_: str, replicates: int, seed: int = 42) -> str:
    """The DuckDB expression of a unit's weights."""
    return SQL_WEIGHTS.format(replicates=replicates, steps=STEPS, seed=seed, id=id_)


def weighted_sums(rows: DataFrame, weights: DataFrame, unit: str, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """by, and of each value its weighted sum in every replicate (array of double), over rows joined with their unit's weights (id, w)."""
    each = rows.withColumn("_unit", F.col(unit)).join(weights.select(F.col("id").alias("_unit"), F.col("w").alias("_w")), "_unit")

    replicates = weights.select(F.max(F.size("w"))).first()[0] or 0

    def total(value: Column) -> Column:
        return F.array(*(F.sum(F.get("_w", F.lit(i)) * value) for i in range(replicates))).cast("array<double>")

    return each.groupBy(*by).agg(*(total(v).alias(c) for c, v in values.items()))


def quantile(c: Column, q: float) -> Column:
    """A quantile of an array of numbers, between neighbours in proportion; null of an empty one."""
    s = F.array_sort(c)
    at = (F.size(c) - 1) * F.lit(q)
    low = F.get(s, F.floor(at).cast("int"))
    return low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def share(c: Column, holds) -> Column:
    """The share of an array's values of which something holds."""
    return F.size(F.filter(c, holds)) / F.size(c)


def counts(rows: DataFrame, weights: DataFrame, unit: str, by: str) -> DataFrame:
    """by and boot: how many rows it has in every replicate, in whole numbers (the engine's vector sums are means times numbers, and off by some bits)."""
    sums = weighted_sums(rows.withColumn("_one", F.lit(1.0)), weights, unit, [by], {"boot": F.col("_one")})
    return sums.withColumn("boot", F.transform("boot", lambda x: F.round(x)))


def presence(edges: DataFrame, least: int, replicates: int = 200, seed: int = 42) -> DataFrame:
    """ref, n (edges), presence (the share of replicates in which it is cited least times or more), and the median and the 2.5 and 97.5 % quantiles of its count,
    over resampled sources of edges (src, ref). A ref that no replicate holds has presence 0.
    """
    e = edges.select("src", "ref").where("src IS NOT NULL AND ref IS NOT NULL")
    sums = counts(e, poisson_weights(e.select(F.col("src").alias("id")), replicates, seed), "src", "ref")
    n = e.groupBy("ref").agg(F.count("*").alias("n"))
    out = n.join(sums, "ref")
    quantiles = [quantile(F.col("boot"), q).alias(c) for c, q in (("boot_median", 0.5), ("boot_q025", 0.025), ("boot_q975", 0.975))]
    return out.select("ref", "n", share(F.col("boot"), lambda x: x >= least).alias("presence"), *quantiles)


def rates(edges: DataFrame, least: int, marked: DataFrame, anchors: int, replicates: int = 200, seed: int = 42) -> DataFrame:
    """mark, n_refs, n_present and rate for each group of anchors marked (ref, mark): how many of its refs are cited least times, and in which share of replicates at least
    so many anchors are."""
    e = edges.select("src", "ref").join(marked.select("ref").distinct(), "ref", "left_semi")
    sums = counts(e, poisson_weights(e.select(F.col("src").alias("id")), replicates, seed), "src", "ref")
    n = e.groupBy("ref").agg(F.count("*").alias("n"))
    each = marked.select("ref", "mark").join(n.join(sums, "ref"), "ref")
    there = F.transform("boot", lambda x: F.when(x >= least, 1.0).otherwise(0.0))
    total = each.groupBy("mark").agg(F.count("*").alias("n_refs"), F.count_if(F.col("n") >= least).alias("n_present"), vector_to_array(Summarizer.sum(array_to_vector(there))).alias("present"))
    return total.select("mark", "n_refs", "n_present", share(F.transform("present", lambda x: F.round(x)), lambda x: x >= anchors).alias("rate"))


def change_point(rows: DataFrame, unit: str, group: str, value: str, late: Column, replicates: int = 200, seed: int = 42) -> DataFrame:
    """group, change (the mean of late rows less that of the others) and its 2.5 and 97.5 % quantiles over resampled units. Replicates without rows on a side are left out."""
    r = rows.where(F.col(value).isNotNull() & late.isNotNull()).select(unit, group, F.col(value).cast("double").alias("_x"), late.alias("_late"))
    side = {"n1": F.col("_late").cast("double"), "s1": F.when(F.col("_late"), F.col("_x")).otherwise(0.0), "n0": (~F.col("_late")).cast("double"), "s0": F.when(F.col("_late"), 0.0).otherwise(F.col("_x"))}
    sums = weighted_sums(r, poisson_weights(r.select(F.col(unit).alias("id")), replicates, seed), unit, [group], side)
    point = r.groupBy(group).agg((F.avg(F.when(F.col("_late"), F.col("_x"))) - F.avg(F.when(~F.col("_late"), F.col("_x")))).alias("change"))
    boot = F.expr("filter(transform(arrays_zip(n1, s1, n0, s0), z -> IF(z.n1 > 0 AND z.n0 > 0, z.s1 / z.n1 - z.s0 / z.n0, NULL)), x -> x IS NOT NULL)")
    return point.join(sums.select(group, boot.alias("boot")), group).select(group, "change", quantile(F.col("boot"), 0.025).alias("q025"), quantile(F.col("boot"), 0.975).alias("q975"))
