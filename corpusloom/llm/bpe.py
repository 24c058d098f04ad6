"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

The ranks become a sentencepiece BPE model without any training: each token's bytes are mapped to
printable characters, one per byte, and the piece is scored by its negative rank, so that
sentencepiece's best-scored merge is the merge of lowest rank; ties go to the leftmost pair in both.
Normalisation is the identity, and no dummy prefix or white-space escape is added. The unknown piece
that the format demands stands after the last rank, so that piece ids are ranks.

A text is cut into pre-tokens by the vocabulary's pattern, each is encoded alone, and ids are decoded
by looking up each id's piece and mapping its characters back to bytes.

Defined cases: null and empty texts have no tokens (hash of the empty string); rows are independent, so
repeated rows, ties and extra columns change nothing; an empty table gives an empty table. Very long texts
are held one Arrow batch at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.common import batches, release, tune

#: Distinct pre-tokens in each of a worker's two generations; a full one becomes the old one.
CACHE = 1 << 18


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
TO_PIECE = {b: c for b, c in enumerate(ALPHABET)}
TO_BYTE = {ord(c): b for b, c in enumerate(ALPHABET)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: varint, length-delimited or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model whose piece ids are the ranks."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = [_field(1, _field(1, "".join(map(TO_PIECE.__getitem__, t)).encode()) + _field(2, -float(r)) + _field(3, 1)) for t, r in by_rank]
    unknown = len(by_rank)
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.pieces = [bytes(TO_BYTE[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.decimals = [str(i) for i in range(len(ranks))]
        self.known = _Known(self.model, ranks)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class _Known(dict):
    """Ids by pre-token, encoded when first asked for. Two generations: what is in use outlives a change."""

    def __init__(self, model, ranks: dict[bytes, int]) -> None:
        self.model, self.ranks, self.old = model, ranks, {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token)
        if ids is None:
            raw = token.encode()
            whole = self.ranks.get(raw)  # a pre-token that is a token is not merged again
            ids = (whole,) if whole is not None else tuple(self.model.encode(raw.decode("latin-1").translate(_LATIN)))
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[token] = ids
        return ids

    def forget(self) -> None:
        """Workers are used again by other stages; what a task remembered goes with it."""
        self.clear()
        self.old = {}
        release()


_LATIN = {b: c for b, c in enumerate(ALPHABET)}


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _each(path: str, pattern: str, row: Callable[[Codec, str], tuple], fields: list[pa.Field]) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches(it):
            rows = [row(codec, x or "") for x in b.column("text").to_pylist()]
            out = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out], ["doc_id", *(f.name for f in fields)])
        codec.known.forget()

    return run


def _ids_row(codec: Codec, text: str) -> tuple:
    return (codec.encode(text),)


def _digests(codec: Codec, ids: list[int]) -> tuple:
    return len(ids), hashlib.sha256(" ".join(map(codec.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _digest_row(codec: Codec, text: str) -> tuple:
    return _digests(codec, codec.encode(text))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text. path: a rank file that each machine has."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_each(path, pattern, _ids_row, [pa.field("ids", pa.list_(pa.int32()))]), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text (binary) of rows of doc_id and ids; null ids count as none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for b in batches(it):
            texts = [codec.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def _whole_row(codec: Codec, text: str) -> tuple:
    ids = codec.encode(text)
    return *_digests(codec, ids), ids


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and on request ids: encode and decode in one pass of the worker."""
    tune(docs.sparkSession)
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields, schema = [*fields, pa.field("ids", pa.list_(pa.int32()))], f"{schema}, ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(_each(path, pattern, _whole_row if with_ids else _digest_row, fields), schema)
