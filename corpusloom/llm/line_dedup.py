"""Line deduplication with two Bloom filters.

A line's key is the line stripped of white space and with A-Z lower-cased. A first pass over the texts fills
two filters: keys seen in one document, and keys seen in two or more. The second pass asks the
second filter, and only what it suspects is shuffled, as digest and doc_id, to count documents exactly and to
choose the one that keeps its lines. A document without any suspect never moves; the others meet the list of
their lines to drop in one join on doc_id. Where the lines are too many for one filter, digests are dealt by range
to filters of their own (bloom.twice_seen), and all documents meet their list.

Defined cases: a null or empty text is one empty line. Rows with one doc_id are one document. A row without
doc_id is left whole and isn't counted. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bloom import Bloom, bits_for, build, fits, twice_seen
from corpusloom.llm.common import batches, materialise, raw_texts, tune
from corpusloom.llm.hashing import SPACE

#: Bytes of text for which the filters reckon with one line.
BYTES_A_LINE = 128


def _long(key: bytes, least: int) -> bool:
    """Whether a key has that many code points."""
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _keys(text: bytes, least: int) -> list[bytes]:
    """The digest of each line's key; empty for lines that are too short to count."""
    keys = [x.strip(SPACE).lower() for x in text.split(b"\n")]
    return [hashlib.sha256(k).digest() if _long(k, least) else b"" for k in keys]


def _hashes(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest."""
    return np.frombuffer(b"".join(digests), np.uint64)[::4] if digests else np.zeros(0, np.uint64)


def dedup_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """doc_id, text (of the lines that stay), n_lines and n_dropped of every row of docs (doc_id, text).

    Lines with a key of at least `least` code points found in at least `documents` documents stay only in the
    largest doc_id that holds them.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lines = size // BYTES_A_LINE
    n_bits = bits_for(lines)

    def each(b: pa.RecordBatch) -> list[list[bytes]]:
        return [_keys(t, least) for t in raw_texts(b.column("text"))]

    def counted(b: pa.RecordBatch) -> np.ndarray:
        return _hashes([k for keys in each(b) for k in {*keys} - {b""}])

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [list({*ks} - {b""}) for ks in each(b)]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array([k for x in found for k in x], pa.binary())], ["doc_id", "key"])

    def repeats(held: DataFrame) -> DataFrame:
        """doc_id and the digests of its lines to drop."""
        repeated = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).where(F.col("n") >= documents).select("key", "keep_id")
        return held.join(repeated, "key").where("doc_id < keep_id").groupBy("doc_id").agg(F.collect_list("key").alias("drop"))


    def suspects(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        """Each batch, and of each row the digests that the filter suspects."""
        bloom = Bloom(n_bits, twice.value)
        for b in batches(it):
            keys = each(b)
            flat = [k for ks in keys for k in {*ks} - {b""}]
            seen = {k for k, hit in zip(flat, bloom.has(_hashes(flat)), strict=True) if hit}
            yield b, [list({*ks} & seen) if i is not None else [] for i, ks in zip(b.column("doc_id").to_pylist(), keys, strict=True)]

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in suspects(it):
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array([k for x in found for k in x], pa.binary())], ["doc_id", "key"])

    def without(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in suspects(it):
            rows = b.filter(pa.array([not x for x in found]))
            texts = raw_texts(rows.column("text"))
            n = pa.array([t.count(b"\n") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), n, pa.array([0] * len(texts), pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    def having(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in suspects(it):
            yield b.filter(pa.array([bool(x) for x in found]))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out, lines, dropped = [], [], []
            for t, drop in zip(raw_texts(b.column("text")), b.column("drop").to_pylist(), strict=True):
                whole = t.split(b"\n")
                drop = set(drop or ())
                kept = [x for x, k in zip(whole, _keys(t, least), strict=True) if k not in drop] if drop else whole
                out.append(b"\n".join(kept))
                lines.append(len(whole))
                dropped.append(len(whole) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    schema = "doc_id long, text string, n_lines long, n_dropped long"
    if not fits(lines):
        held = twice_seen(docs.where("doc_id IS NOT NULL").mapInArrow(digests, "doc_id long, key binary"), lines)
        return docs.join(repeats(materialise(held.distinct())), "doc_id", "left").mapInArrow(cut, schema)
    twice = spark.sparkContext.broadcast(build(docs.where("doc_id IS NOT NULL"), counted, n_bits)[1])
    drops = repeats(docs.mapInArrow(pairs, "doc_id long, key binary").distinct())
    suspected = docs.mapInArrow(having, "doc_id long, text string").join(drops, "doc_id", "left").mapInArrow(cut, schema)
    return docs.mapInArrow(without, schema).unionByName(suspected)
