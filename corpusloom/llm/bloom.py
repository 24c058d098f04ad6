"""Bloom filters, whole or by range of hashes.

A whole filter is built over partitions, merged by segments and broadcast; it is for as many items as fits() allows. Beyond these keys are dealt to tasks by hash, and each
task has filters for its own range, as large as the range needs, so filters never fill up, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 15
HASHES = 4
#: Bounds of a filter's bits; the larger is 32 MB.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 28


def bits_for(items: int) -> int:
    """Bits for so many items: a power of two, about ten an item, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (10 * max(1, items)).bit_length()))


def fits(items: int) -> bool:
    """Whether a whole filter has bits enough for so many items."""
    return 10 * items <= MOST_BITS


#: Keys that a range of hashes holds, about: its filters have some megabytes.
RANGE = 1 << 21


class Bloom:
    """bits: the filter, eight to a byte."""

    def __init__(self, n_bits: int, bits: bytes | None = None) -> None:
        self.mask = np.uint64(n_bits - 1)
        self.bits = np.zeros(n_bits // 8, np.uint8) if bits is None else np.frombuffer(bits, np.uint8)

    def _places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            p = (h + np.uint64(i) * step) & self.mask
            yield (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which of these 64-bit hashes may have been added."""
        out = np.ones(len(h), bool)
        for at, bit in self._places(h):
            out &= (self.bits[at] & bit) != 0
        return out

    def add(self, h: np.ndarray) -> None:
        for at, bit in self._places(h):
            np.bitwise_or.at(self.bits, at, bit)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one segment: once is the union; twice also holds what two parts have each seen once."""
    once, twice = np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)
    for o, t in zip(rows["once"], rows["twice"], strict=True):
        o = np.frombuffer(o, np.uint8)
        twice |= np.frombuffer(t, np.uint8) | (once & o)
        once |= o
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "slot": rows["slot"].iloc[:1] // 64, "once": [once.tobytes()], "twice": [twice.tobytes()]})


_SCHEMA = "segment int, slot long, once binary, twice binary"


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], n_bits: int) -> tuple[bytes, bytes]:
    """The once-seen and twice-seen filters over the hashes of each Arrow batch of df.

    hashes gives each item once for each time that it counts. Each task emits the segments it has touched;
    they are merged in two steps, by slots of 64 tasks and then whole, so no group grows with the input.
    """

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(n_bits), Bloom(n_bits)
        for b in it:
            h = hashes(b)
            unique, n = np.unique(h, return_counts=True)
            twice.add(unique[(n > 1) | once.has(unique)])
            once.add(unique)
        o, t = once.bits.reshape(-1, SEGMENT), twice.bits.reshape(-1, SEGMENT)
        for s in np.flatnonzero(o.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([o[s].tobytes()]), pa.array([t[s].tobytes()])], ["segment", "once", "twice"])

    rows = df.mapInArrow(part, "segment int, once binary, twice binary").select("segment", F.spark_partition_id().cast("long").alias("slot"), "once", "twice")
    # a partition's number is the slot: 64 to a group in the first step
    rows = rows.withColumn("slot", F.floor(F.col("slot") / 64))
    merged = rows.groupBy("segment", "slot").applyInPandas(_merge, _SCHEMA).groupBy("segment").applyInPandas(_merge, _SCHEMA)
    size = n_bits // 8
    once, twice = bytearray(size), bytearray(size)
    for r in merged.collect():
        at = r.segment * SEGMENT
        once[at : at + SEGMENT], twice[at : at + SEGMENT] = r.once, r.twice
    return bytes(once), bytes(twice)


def twice_seen(pairs: DataFrame, items: int) -> DataFrame:
    """Those of pairs (doc_id, key: a digest; distinct in each batch) whose key may be in several documents, by a once-seen and a twice-seen filter for each range of keys. items: about how many.

    Keys that a task itself finds in two documents are known already: their pairs don't move, and the range is told once a task. A range keeps in memory
    what it has seen once; later pairs pass as they come. So a key that very many documents hold costs its range a row a task.
    """
    from corpusloom.llm.common import materialise

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        kept: dict[bytes, int] = {}

        def out(rows: list[tuple[bytes, int | None, bool, bool]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], ["key", "doc_id", "known", "told"])

        for b in it:
            rows = []
            for d, k in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), strict=True):
                if k in seen:
                    rows.append((k, d, True, False))
                elif k in kept and kept[k] != d:
                    rows += [(k, d, True, False), (k, kept.pop(k), True, False), (k, None, False, True)]
                    seen.add(k)
                else:
                    kept[k] = d
            if len(kept) + len(seen) > RANGE:  # a task's memory is bounded: what it forgets the ranges tell
                rows += [(k, d, False, False) for k, d in kept.items()]
                kept.clear()
                seen.clear()
            if rows:
                yield out(rows)
        rest = list(kept.items())
        for lo in range(0, len(rest), 1 << 14):
            yield out([(k, d, False, False) for k, d in rest[lo : lo + (1 << 14)]])

    def ranged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(1 << 25), Bloom(1 << 25)
        waiting: list[pa.RecordBatch] = []
        for b in it:
            h = np.frombuffer(b"".join(k[:8] for k in b.column("key").to_pylist()), np.uint64)
            told = b.column("told").to_numpy(zero_copy_only=False)
            unique, n = np.unique(h, return_counts=True)
            twice.add(np.concatenate([unique[(n > 1) | once.has(unique)], h[told]]))
            once.add(unique)
            hit = twice.has(h) & ~told
            b = b.select(["doc_id", "key"])
            yield b.filter(pa.array(hit))
            waiting.append(b.filter(pa.array(~hit & ~told)))
        for b in waiting:
            h = np.frombuffer(b"".join(k[:8] for k in b.column("key").to_pylist()), np.uint64)
            yield b.filter(pa.array(twice.has(h)))

    rows = materialise(pairs.mapInArrow(part, "key binary, doc_id long, known boolean, told boolean"))
    ranges = max(1, -(-items // RANGE))
    return rows.where("NOT known").repartition(ranges, "key").mapInArrow(ranged, "doc_id long, key binary").unionByName(rows.where("known").select("doc_id", "key"))
