"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last 16 bytes has a given form, so equal texts are
cut alike wherever they stand. Each chunk gets a digest; the ordered digests are the text's recipe, and only
recipes, some tens of bytes each, are compared. Texts whose recipe no other text has are done. The chunks of
the others move once, one copy a task, to verify that no digest stands for two contents; if one does, the
digests are doubled in length and all is done again, so that equal identifiers always mean equal bytes.

Defined cases: a null text counts as empty; all empty texts are one group. Rows with one doc_id are one
document to keep_id and kept, and each counts in group_size. A null doc_id stays only in a group without any
other. An empty table gives an empty table; other columns are not read. Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bloom import Bloom, bits_for, build, fits
from corpusloom.llm.common import batches, materialise, raw_texts, tune

#: Bytes of a chunk: least, most, and the bits of the rolling hash that must be 0 at a cut (on average 2^11).
LEAST, MOST, CUT_BITS = 512, 16384, 11
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def _cuts(texts: list[bytes]) -> Iterator[list[int]]:
    """The ends of each text's chunks. Rolled over all texts at once: a cut lies at least LEAST bytes, more than
    the hash's window, into its text, so no text sees the one before it."""
    h = _GEAR[np.frombuffer(b"".join(texts), np.uint8)]
    for w in (1, 2, 4, 8):
        more = h.copy()
        more[w:] += h[:-w] << np.uint32(w)
        h = more
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    begin = 0
    for t in texts:
        n, last, out = len(t), 0, []
        lo, hi = np.searchsorted(at, (begin + LEAST, begin + n))
        for c in (at[lo:hi] - begin).tolist():
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c - last >= LEAST:
                last = c
                out.append(c)
        while n - last > MOST:
            last += MOST
            out.append(last)
        yield [*out, n] if n > last or not out else out
        begin += n


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    for t, ends in zip(texts, _cuts(texts), strict=True):
        yield [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_sha256 (hex) and recipe (the digests of the chunks in order) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = [t.lower() for t in raw_texts(b.column("text"))]
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            recipe = [b"".join(_digest(c, size) for c in cs) for cs in _chunks(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sha), pa.array(recipe, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text_sha256 string, recipe binary")


def _key(recipes_: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=8).digest() for r in recipes_), np.uint64)


def _ambiguous(docs: DataFrame, each: DataFrame, repeated: DataFrame, size: int) -> bool:
    """Whether a digest in a repeated recipe stands for two contents. each: the recipes of docs."""
    n = repeated.count()
    wanted, n_bits = None, bits_for(n)
    if fits(n):
        wanted = docs.sparkSession.sparkContext.broadcast(build(repeated.select("recipe"), lambda b: _key(b.column("recipe").to_pylist()), n_bits)[0])
    else:  # the documents are fetched by doc_id instead; those without one all come
        ids = each.join(repeated.select("recipe"), "recipe", "left_semi").where("doc_id IS NOT NULL").select("doc_id").distinct()
        docs = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi").select("text").unionByName(docs.where("doc_id IS NULL").select("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(n_bits, wanted.value) if wanted else None
        for b in batches(it):
            texts = [t.lower() for t in raw_texts(b.column("text"))]
            parts = [[(_digest(c, size), c) for c in cs] for cs in _chunks(texts)]
            hit = bloom.has(_key([b"".join(d for d, _ in p) for p in parts])) if bloom else [True] * len(parts)
            rows = {x for p, h in zip(parts, hit, strict=True) if h for x in p}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["digest", "chunk"])

    contents = docs.select("text").mapInArrow(run, "digest binary, chunk binary").distinct()
    return not contents.groupBy("digest").count().where("count > 1").isEmpty()


def exact_dedup(docs: DataFrame, digest_size: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    while True:
        each = materialise(recipes(docs, digest_size))
        groups = each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        if not _ambiguous(docs, each, groups.where("group_size > 1"), digest_size):
            break
        if digest_size >= 64:
            raise RuntimeError("two chunks share a digest of full length")
        digest_size *= 2
    # joined on a key of its own, so that both sides are dealt anew and Spark may split a recipe that very many share
    key = F.xxhash64("recipe").alias("recipe_key")
    return each.select("*", key).join(groups.select("*", key), ["recipe_key", "recipe"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
