"""Words counted text by text in Arrow tasks: a text gives a row for each distinct word of it, and no row is made for an occurrence.

Patterns are Python's, in which \\w is letters, numbers and the underscore: Java's [\\p{L}\\p{N}_]. Texts are lower-cased before, by Spark.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of a batch, rows that a task gives back at once, and distinct terms that it sums before it gives them back.
TEXTS, ROWS, TERMS = 256, 100_000, 200_000


def words(pattern: str) -> Callable[[str], Counter]:
    """How often a text has each match of a pattern."""
    find = re.compile(pattern).findall
    return lambda t: Counter(find(t))


def letters() -> Callable[[str], Counter]:
    """How often a text has each run of letters, Java's \\p{L}+: runs of \\w are cut where they hold others."""
    find = re.compile(r"\w+").findall

    def tell(t: str) -> Counter:
        out = Counter(find(t))
        for w in [w for w in out if not w.isalpha()]:
            n = out.pop(w)
            for x in "".join(c if c.isalpha() else " " for c in w).split():
                out[x] += n
        return out

    return tell


def _texts(texts: DataFrame, key: str, text: Column) -> DataFrame:
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS)
    return texts.where(text.isNotNull()).select(key, F.lower(text).alias("_text"))


def once(texts: DataFrame, key: str) -> bool:
    """Whether no two rows have one key."""
    return texts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def by_text(texts: DataFrame, key: str, text: Column, found: Callable[[], Callable[[str], Iterable[tuple]]], value: str) -> DataFrame:
    """key, term and a value (its name and type, long or double) of every text, as found(), asked for once a task, tells them."""
    kind, name = dict(texts.dtypes)[key], value.split()[0]
    type_ = pa.int64() if value.endswith("long") else pa.float64()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = found()
        for b in it:
            at, terms, values = [], [], []
            for i, t in enumerate(b.column(1)):
                new = tell(t.as_py())
                at.extend([i] * len(new))
                terms.extend(x for x, _ in new)
                values.extend(y for _, y in new)
                if len(at) >= ROWS or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(terms, pa.string()), pa.array(values, type_)], [key, "term", name])
                    at, terms, values = [], [], []

    return _texts(texts, key, text).mapInArrow(run, f"`{key}` {kind}, term string, {value}")


def counts(texts: DataFrame, key: str, text: Column, found: Callable[[], Callable[[str], Counter]], alone: bool) -> DataFrame:
    """key, term and n: how often the texts of a key have each term. alone: no two texts have one key (once), so none are summed."""

    def tell() -> Callable[[str], Iterable[tuple]]:
        count = found()
        return lambda t: count(t).items()

    each = by_text(texts, key, text, tell, "n long")
    return each if alone else each.groupBy(key, "term").agg(F.sum("n").alias("n"))


def totals(texts: DataFrame, key: str, text: Column, found: Callable[[], Callable[[str], Counter]], alone: bool) -> DataFrame:
    """term, n and docs: how often all texts have each term, and the keys whose texts have it. A task sums its own texts before it gives rows back."""
    if not alone:
        return counts(texts, key, text, found, False).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n, docs = found(), {}, {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array(docs.values(), pa.int64())], ["term", "n", "docs"])

        for b in it:
            for t in b.column(1):
                for x, k in count(t.as_py()).items():
                    n[x] = n.get(x, 0) + k
                    docs[x] = docs.get(x, 0) + 1
                if len(n) > TERMS:
                    yield rows()
                    n, docs = {}, {}
        yield rows()

    return _texts(texts, key, text).mapInArrow(run, "term string, n long, docs long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weighed(texts: DataFrame, key: str, text: Column, found: Callable[[], Callable[[str], Counter]], inverse: dict[str, float]) -> DataFrame:
    """key, term and w: sublinear counts by the inverse frequencies of a bounded vocabulary, each text of length one. No two texts may have one key."""

    def all_of() -> Callable[[str], Iterable[tuple]]:
        count = found()

        def tell(t: str) -> list[tuple]:
            w = [(x, (1 + math.log(n)) * inverse[x]) for x, n in count(t).items() if x in inverse]
            length = math.sqrt(math.fsum(y * y for _, y in w))
            return [(x, y / length) for x, y in w]

        return tell

    return by_text(texts, key, text, all_of, "w double")
