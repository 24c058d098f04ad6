"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 32 words. Each passage is described by how its bytes fall into classes (letters,
digits, every ASCII punctuation mark), by the lengths and endings of its words and by how often words repeat. A
hidden layer encodes the description; gated attention weighs the passages; the weighted sum of encodings is scored by a
logistic unit. All weights are learned together from document labels alone.

The model is fitted on the driver to at most `most` labelled documents of at most LONGEST bytes, those first in the
order of a hash of doc_id as long as they have at most BYTES in all; of rows with one doc_id the shortest text is learned from. Scoring reads every passage of every document.

Defined cases: a null or empty text is one empty passage and gets a score. Rows without doc_id are scored and never learned from;
labels without quality are not used; without any label the score is 0.5 for all. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import batches, raw_texts, tune
from corpusloom.llm.hashing import Words

#: Words of a passage, units of the encoding and of the attention, the longest text that is learned from, and bytes of all of them.
PASSAGE, HIDDEN, ATTENTION, LONGEST, BYTES = 32, 24, 12, 200_000, 64 << 20

_PUNCTUATION = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_CLASS = np.zeros(256, np.int64)  # 0: other controls
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[0x80:] = 4
_CLASS[list(b" ")] = 5
_CLASS[list(b"\n")] = 6
_CLASS[_PUNCTUATION] = np.arange(7, 7 + len(_PUNCTUATION))
CLASSES = 7 + len(_PUNCTUATION)
FEATURES = CLASSES + 7


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The descriptions of all passages, and how many each text has (one at least)."""
    words = Words(texts)
    n = words.counts()
    each = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(texts)), n)
    of_word = first[doc] + (np.arange(len(doc)) - words.first[:-1][doc]) // PASSAGE
    # a passage's bytes run from its first word to the next passage's; the case is that of the text itself
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    inner = np.flatnonzero((np.arange(len(doc)) - words.first[:-1][doc]) % PASSAGE == 0)
    inner = inner[inner != words.first[:-1][doc[inner]]]
    cut = np.zeros(total + 1, np.int64)
    cut[first] = begins
    cut[of_word[inner]] = words.starts[inner]
    length = np.diff(cut)
    of_byte = np.repeat(np.arange(total), length)
    histogram = np.bincount(of_byte * CLASSES + _CLASS[raw[: len(of_byte)]], minlength=total * CLASSES).reshape(total, CLASSES)
    x = np.zeros((total, FEATURES), np.float32)
    x[:, :CLASSES] = np.sqrt(histogram / np.maximum(1, length)[:, None])
    count = np.bincount(of_word, minlength=total)
    some = np.maximum(1, count)
    size = (words.ends - words.starts).astype(np.float64)
    h = words.hashes()
    order = np.lexsort((h, of_word))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
    last = _CLASS[words.bytes[words.ends - 1]]
    mean = np.bincount(of_word, size, total) / some
    x[:, CLASSES] = np.log1p(count) / 4
    x[:, CLASSES + 1] = np.log1p(mean)
    x[:, CLASSES + 2] = np.log1p(np.sqrt(np.maximum(0, np.bincount(of_word, size * size, total) / some - mean**2)))
    x[:, CLASSES + 3] = np.bincount(of_word[order], again, total) / some
    x[:, CLASSES + 4] = np.bincount(of_word, last >= 7, total) / some
    x[:, CLASSES + 5] = np.bincount(of_word, last == 3, total) / some
    x[:, CLASSES + 6] = np.bincount(of_word, size == 1, total) / some
    return x, each


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Scaling of the descriptions, and the weights by name."""

    centre: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
        w, first = self.w, np.concatenate([[0], np.cumsum(each)[:-1]])
        out = {"x": x, "h": np.tanh(x @ w["encode"] + w["encode0"])}
        out["t"], out["g"] = np.tanh(out["h"] @ w["attend"]), _sigmoid(out["h"] @ w["gate"])
        e = (out["t"] * out["g"]) @ w["weigh"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), each))
        out["a"] = e / np.repeat(np.add.reduceat(e, first), each)
        out["z"] = np.add.reduceat(out["a"][:, None] * out["h"], first)
        out["p"] = _sigmoid(out["z"] @ w["score"] + w["score0"])
        return out

    def score(self, x: np.ndarray, each: np.ndarray) -> np.ndarray:
        """The score of each text of passages()."""
        return self.forward((x - self.centre) / self.scale, each)["p"]

    def gradients(self, f: dict[str, np.ndarray], each: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by weight."""
        w, d = self.w, (f["p"] - y) / len(y)
        dz = np.repeat(d[:, None] * w["score"], each, axis=0)
        s = (dz * f["h"]).sum(axis=1)  # what more attention to a passage does
        first = np.concatenate([[0], np.cumsum(each)[:-1]])
        de = f["a"] * (s - np.repeat(np.add.reduceat(f["a"] * s, first), each))
        dt = de[:, None] * w["weigh"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * w["weigh"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ w["attend"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        return {
            "encode": f["x"].T @ dh, "encode0": dh.sum(axis=0), "attend": f["h"].T @ dt, "gate": f["h"].T @ dg,
            "weigh": (de[:, None] * f["t"] * f["g"]).sum(axis=0), "score": f["z"].T @ d, "score0": d.sum(keepdims=True),
        }


def fit(x: np.ndarray, each: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 9) -> Model:
    """The model of bags: descriptions, passages of each bag, and labels from 0 to 1."""
    rng = np.random.default_rng(seed)
    draw = lambda a, b: (rng.normal(size=(a, b)) / a**0.5).astype(np.float32)
    w = {"encode": draw(FEATURES, HIDDEN), "encode0": np.zeros(HIDDEN, np.float32), "attend": draw(HIDDEN, ATTENTION), "gate": draw(HIDDEN, ATTENTION), "weigh": draw(ATTENTION, 1)[:, 0], "score": draw(HIDDEN, 1)[:, 0], "score0": np.zeros(1, np.float32)}
    centre = x.mean(axis=0) if len(x) else np.zeros(FEATURES, np.float32)
    scale = x.std(axis=0) + 1e-2 if len(x) else np.ones(FEATURES, np.float32)
    model = Model(centre, scale, w)
    if not len(y):
        w["score"][:] = 0
        return model
    x = (x - centre) / scale
    first = np.concatenate([[0], np.cumsum(each)])
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            g = model.gradients(model.forward(x[rows], each[part]), each[part], y[part])
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, a in w.items():  # Adam, with weight decay
                d = g[k] + 1e-4 * a
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the row's label must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Model:
    """The model of the labelled documents: docs (doc_id, text), labels (doc_id, quality), held-out rows left out."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    text = docs.where(F.octet_length("text") <= LONGEST).select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h"))
    each = text.drop("text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("n", "h")).alias("r"), F.first("quality").alias("quality"))
    total = F.sum("r.n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `most` rows
    few = each.withColumn("total", total).where(F.col("total") <= BYTES).select("doc_id", "r.n", "r.h", "quality")
    rows = text.join(F.broadcast(few), ["doc_id", "n", "h"]).select("doc_id", "text", F.col("quality").cast("double").alias("quality")).dropDuplicates(["doc_id"])

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            x, each = passages(raw_texts(b.column("text")))
            cuts = np.cumsum(each)[:-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([p.tobytes() for p in np.split(x, cuts)])], ["doc_id", "quality", "x"])

    found = rows.mapInArrow(describe, "doc_id long, quality double, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    bags = [np.frombuffer(v, np.float32).reshape(-1, FEATURES) for v in found.column("x").to_pylist()]
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(x, np.array([len(b) for b in bags], np.int64), found.column("quality").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the likelihood of label 1, of every row of docs (doc_id, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            p = model.score(*passages(raw_texts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def select(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score the threshold or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield b.filter(pa.array(model.score(*passages(raw_texts(b.column("text")))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every row of docs (doc_id, text)."""
    tune(docs.sparkSession)
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
