"""Near-duplicate groups with b-bit MinHash.

Each text's set of word shingles gets 128 minima. Five whole minima at a time make a band, and texts that share a
band are candidates; of each minimum only four bits are kept, packed into eight longs, and the similarity of a candidate pair
is estimated by counting equal fields and taking off the share that agrees by chance.

Equal sets are one node. Then, without listing the pairs of a band:

1. every member of a band is paired with the band's smallest member; pairs whose estimate is more than six standard errors
   short of the threshold go; the others are confirmed on whole sets, and linked nodes get one label;
2. bands that still hold several labels, and more than the pair just tested, are cut into blocks. Every two blocks of a band meet in one
   task, which compares whole sets of different labels exactly and returns a spanning forest of the links.

So a group whose copies resemble its first one costs one comparison a copy; only nodes that share a band and aren't known to be linked are
compared with one another, in blocks of bounded size. Whole sets are read again from the texts that need them, found by a
Bloom filter of bounded size or, where they are too many for it, by a join on doc_id. Components are found by passing labels on and jumping pointers, on tables in the shared folder.

Defined cases: a text without words, or null, has no shingles and is linked with nothing; a text of fewer than five
words has one shingle, the whole. Rows with one doc_id are one node where they have one text. Empty tables give empty tables;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bloom import Bloom, bits_for, build, fits
from corpusloom.llm.common import batches, materialise, raw_texts, tune
from corpusloom.llm.hashing import Words, mix

#: Words of a shingle.
WIDTH = 5
#: Bands and minima in each: a pair shares no band once in two million times at a similarity of 0.85, and once in 20,000 at 0.8.
BANDS, ROWS = 25, 5
#: Minima of a signature, and the low bits kept of each.
MINIMA, BITS = 128, 4
_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at a time, so that they stay in the processor's cache.
BLOCK = 1 << 15


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, sorted within each, and where each text's begin and the last end.

    A shingle is the 64-bit hash of five consecutive words, or of all words of a text that has fewer.
    """
    words = Words(texts)
    h, n = words.hashes(), words.counts()
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    left = words.first[1:][doc] - np.arange(len(h))  # words from here to the text's end
    s = np.zeros(len(h), np.uint64)
    for i in range(WIDTH):
        inside = np.minimum(np.arange(len(h)) + i, len(h) - 1)
        s += np.where(left > i, mix(h[inside] * _PLACE[i]), np.uint64(0))
    s = mix(s + np.minimum(left, WIDTH).astype(np.uint64))
    begins = (left >= WIDTH) | ((np.arange(len(h)) == words.first[:-1][doc]) & (n[doc] < WIDTH))
    s, doc = s[begins], doc[begins]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(texts) + 1))


def minima(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The MINIMA minima of each text that has shingles; rows of texts without any are all ones."""
    out = np.full((len(first) - 1, MINIMA), np.iinfo(np.uint64).max, np.uint64)
    rows = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(rows):  # whole texts, about a block of shingles; a text longer than a block is folded piece by piece
        end = max(at + 1, int(np.searchsorted(first[rows + 1], first[rows[at]] + BLOCK, "right")))
        lo, hi = first[rows[at]], first[rows[end - 1] + 1]
        if end == at + 1:
            for a in range(lo, hi, BLOCK):
                part = s[a : min(hi, a + BLOCK)]
                for k in range(MINIMA):
                    out[rows[at], k] = min(out[rows[at], k], (part * _MULTIPLY[k] + _ADD[k]).min())
        else:
            part, cuts = s[lo:hi], first[rows[at:end]] - lo
            for k in range(MINIMA):
                out[rows[at:end], k] = np.minimum.reduceat(part * _MULTIPLY[k] + _ADD[k], cuts)
        at = end
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """The key of each band of each text."""
    used = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS)
    return mix((used * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def packed(m: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, sixteen to a long. They come from its middle: a minimum's top bits are nearly all 0."""
    low = (m >> np.uint64(16)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return (low.reshape(len(m), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.view(np.int64).ravel()))


def signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n (shingles), set_key (digest of the set), signature and bands of each row (doc_id, text)."""
    for b in batches(it):
        s, first = shingle_sets(raw_texts(b.column("text")))
        m = minima(s, first)
        keys = [hashlib.blake2b(s[a:e].tobytes(), digest_size=16).digest() for a, e in zip(first, first[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(keys), _lists(packed(m)), _lists(band_keys(m))], ["doc_id", "n", "set_key", "signature", "bands"])


SIGNED = "doc_id long, n long, set_key binary, signature array<long>, bands array<long>"


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two signatures show: equal fields, less what agrees by chance."""
    ones = int("1" * (64 // BITS), 1 << BITS)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for i in (2, 1):  # a field's bits fall together into its lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, i))
        return F.bit_count(z.bitwiseAND(F.lit(ones)))

    chance = 1.0 / (1 << BITS)
    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda t, x: t + x)
    return (1 - apart / MINIMA - chance) / (1 - chance)


def _hash_ids(ids: list[int]) -> np.ndarray:
    return mix(np.array(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and shingles (sorted 64-bit hashes as bytes) of the wanted (doc_id; distinct) of docs, once each."""
    n = wanted.count()

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        s, first = shingle_sets(raw_texts(b.column("text")))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s[a:e].tobytes() for a, e in zip(first, first[1:], strict=False)], pa.binary())], ["doc_id", "shingles"])

    docs, schema = docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id long, shingles binary"
    if not n or not fits(n):
        return docs.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: map(sets, batches(it)), schema).dropDuplicates(["doc_id"])
    n_bits = bits_for(n)
    bits = docs.sparkSession.sparkContext.broadcast(build(wanted, lambda b: _hash_ids(b.column("doc_id").to_pylist()), n_bits)[0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(n_bits, bits.value)
        for b in batches(it):
            yield sets(b.filter(pa.array(bloom.has(_hash_ids(b.column("doc_id").to_pylist())))))

    return docs.mapInArrow(run, schema).dropDuplicates(["doc_id"])


def _linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _confirm(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            sets = [[np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("x", "y")]
            ok = [_linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent) for x, y in zip(*sets, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


#: Members of a block, on average, and shingles compared at a time.
MEMBERS, COLUMNS = 256, 4096


def links_between(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different label, across the sides if there are two."""
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one member adds to no intersection
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (c, c + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        both += part @ part.T
    ok = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    ok &= labels[:, None] != labels[None, :]
    if len(set(sides.tolist())) > 1:
        ok &= sides[:, None] != sides[None, :]
    label, out = labels.copy(), []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            out.append((i, j))
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node that can be reached) of every node of edges (a, b)."""
    edges = materialise(edges.union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    while True:
        labels = materialise(labels.select("node", "label"))
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("near"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = near.join(jump, F.col("near") == F.col("to")).select("node", F.least("near", "far").alias("label"))
        step = materialise(step)
        if step.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            return labels
        labels = step


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Documents are linked if their sets' intersection is at least so many percent of their union.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = materialise(docs.mapInArrow(signatures, SIGNED))
    one = F.min(F.struct("doc_id", "signature", "bands")).alias("r")
    nodes = materialise(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(one).select("set_key", "r.*"))
    members = nodes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    bands = members.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = materialise(members.join(bands, "band"))

    signs = nodes.select("doc_id", "signature")
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b")
    t = percent / 100
    pairs = materialise(pairs.where(estimate(F.col("sa"), F.col("sb")) >= t - 6 * (t * (1 - t) / MINIMA) ** 0.5).select("a", "b"))
    sets = whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = materialise(sets)
    sided = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    labels = components(sided.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"))

    named = members.where("size > 2").join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
    named = materialise(named)
    open_ = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    rest = materialise(named.join(open_, "band"))
    more = components(_blocks(docs, rest, percent))
    final = nodes.select("set_key", F.col("doc_id").alias("node")).join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("label"))
    final = final.join(more.toDF("label", "smaller"), "label", "left").select("set_key", F.coalesce("smaller", "label").alias("component"))
    out = signed.select("doc_id", "n", "set_key").join(final, "set_key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _blocks(docs: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels within the bands of rest (band, node, size, label)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        labels = rows["label"].to_numpy()
        if len(set(labels.tolist())) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        found = links_between([np.frombuffer(x, np.uint64) for x in rows["shingles"]], labels, rows["block"].to_numpy(), percent)
        return pd.DataFrame([(labels[i], labels[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    sets = whole_sets(docs, rest.select(F.col("node").alias("doc_id")).distinct())
    n = F.ceil(F.col("size") / MEMBERS).cast("int")
    cut = rest.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    held = cut.join(sets.toDF("node", "shingles"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = held.select("band", "node", "label", "block", "shingles", other).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block", "shingles")
    return met.groupBy("band", "i", "j").applyInPandas(run, "a long, b long")
