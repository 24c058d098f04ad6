"""LM scoring with an Elias-Fano trigram trie, sharded by context.

The model backs off from trigrams to bigrams to words, and every n-gram of the learning texts is kept:

    p(w | u v) = c(u v w) / (c(u v) + M) if c(u v w) > 0, else M / (c(u v) + M) p(w | v)    (a context never seen has weight 1)
    p(w | v) = c(v w) / (c(v) + M) if c(v w) > 0, else M / (c(v) + M) p(w)
    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

Each context holds the mass M / (c + M) back for the next level. It isn't renormalised over the words seen after the context, so probabilities sum to one at
most. The text's boundary is a word as well: the last of a text, and twice the context of its first.

A level above the words is a trie for each shard: contexts, pointers to their ranges and successors in Elias-Fano form, with probabilities and weights in codes
of one byte, in a file that the task maps while it asks. An n-gram is sought as a successor within its context's range. A shard holds
whole contexts, so their counts are at hand. Contexts that are frequent in the corpus are split by n-gram over all shards instead, and their
counts, of which there are at most HOT, are broadcast.

What moves: each task sums its n-grams over some megabytes of text (a piece) and sends each once a level, sorted and in steps. At the third level all texts' n-grams
travel with the texts that they occur in; the shard builds its trie from the counts of the learning texts and answers at once with sums by text. Only what it
lacks goes on to the second level, and from there to the words. An n-gram that occurs in many texts of a piece isn't sent with them:
its value comes back to the piece. Frequent words are broadcast and never sent.

Words, and two words as a context, are told apart by 64 bits of hash; within a shard, which holds about as many contexts at every size, contexts by 40 bits and successors of one
context by 24, so of a million n-grams about one is taken for another. Defined cases: a null or empty text is its boundary alone. Rows
with one doc_id are scored one by one; a row without doc_id is scored but never learned from. Without learning rows all counts are 0. An empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches, materialise, raw_texts, release, tune
from corpusloom.llm.elias_fano import TAIL, Trie, mapped
from corpusloom.llm.hashing import Words, mix

U = np.uint64
_TAILS, _TAIL = U(TAIL), U((1 << TAIL) - 1)
_STEP = U(0x9E3779B97F4A7C15)
BOUNDARY = U(0x5BF03635D1A9C2E7)
#: Mass that a context holds back, in counts.
M = 4.0
#: Bytes of text that a task sums up at a time, and bytes of text for each shard.
PIECE, SHARD = 4 << 20, 12 << 20
#: The most words or contexts that are broadcast: those as frequent as one in so many tokens, and seen LEAST times at least.
HOT, LEAST = 1 << 16, 64
#: An n-gram in more texts of a piece gets its value sent back.
OFTEN = 16


def planes(a: np.ndarray) -> bytes:
    """The values' bytes, all lowest ones first, so that bytes that are mostly alike lie together, compressed."""
    a = np.ascontiguousarray(a)
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def from_planes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(b[4:], int.from_bytes(b[:4], "little"), "zstd", asbytes=True) if b else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(a: np.ndarray) -> bytes:
    return planes(np.diff(a, prepend=a.dtype.type(0)))


def _from_steps(b: bytes, kind: type = U) -> np.ndarray:
    return np.cumsum(from_planes(b, kind), dtype=kind)


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The hash of a context and a token: the context that they are for the next level."""
    return mix(context * _STEP + token)


def _code(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """An n-gram within its shard: 40 bits of its context, then TAIL bits of its token."""
    return mix(context) >> _TAILS << _TAILS | token & _TAIL


_START = _pair(np.array([BOUNDARY]), np.array([BOUNDARY]))[0]


def log_p(count: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """log10 of the smoothed probability of words of these counts."""
    return np.log10((count + 0.1) / (tokens + 0.1 * (words + 1)))


def _at(keys: np.ndarray, values: np.ndarray, want: np.ndarray, other: float) -> np.ndarray:
    """The values of sorted keys where want is, and other where it isn't."""
    if not len(keys):
        return np.full(len(want), other, np.float64)
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[i] == want, values[i], other)


class Tokens:
    """The tokens of a piece of text, each text's boundary last, and the two before each (a text's first has the boundary twice)."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words(texts)
        n = words.counts() + 1
        ends = np.cumsum(n) - 1
        self.token = np.full(int(n.sum()), BOUNDARY)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = words.hashes()
        self.text = np.repeat(np.arange(len(texts)), n)
        self.n = n
        self.before = np.concatenate([[BOUNDARY], self.token[:-1]])[: len(self.token)]
        self.context = _pair(np.concatenate([[BOUNDARY], self.before[:-1]])[: len(self.token)], self.before)
        self.context[np.concatenate([[0], ends[:-1] + 1])[: len(texts)]] = _START


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """doc_ids, texts and whether each is learned from, of some PIECE of text at a time."""
    ids, texts, learn, size = [], [], [], 0
    for b in batches(it):
        for i, t, k in zip(b.column("doc_id").to_pylist(), raw_texts(b.column("text")), b.column("learn").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            learn.append(bool(k) and i is not None)
            size += len(t)
            if size >= PIECE:
                yield ids, texts, np.array(learn)
                ids, texts, learn, size = [], [], [], 0
    if ids:
        yield ids, texts, np.array(learn)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard that leaves each shard's own order as it is, and where each shard begins in it."""
    at = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.uint32), kind="stable")
    return at, np.searchsorted(shard[at], np.arange(shards + 1))


def _shard_of(context: np.ndarray, token: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A context's own shard, or for a hot context (sorted) one of each n-gram's own. It tells bits of the context that the code leaves out."""
    split = _at(hot, np.ones(len(hot)), context, 0) > 0
    return (np.where(split, _pair(context, token), mix(context) & _TAIL) % U(shards)).astype(np.int64)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 64], strict=True), schema.types, strict=True)], schema=schema)


_PARTS = ("code", "count", "rank", "text", "times", "slot", "onward", "more")
#: Messages of a piece to a shard. code (steps) and count (in learning texts) of its n-grams; rank, text and times: which n-gram occurs in which text how often;
#: slot: of each n-gram the number under which the piece wants its value, or 0; onward: before and token of the n-grams without count.
_SENT = pa.schema([("shard", pa.int32()), ("piece", pa.int64()), *((c, pa.binary()) for c in _PARTS)])
_SENT_SQL = "shard int, piece long, " + ", ".join(f"{c} binary" for c in _PARTS)
#: Answers. SUM: a texts, b scores, and of words c base scores and d known words. VALUE: a slots, b values. OWN: what a piece keeps of itself: a ids, b tokens,
#: c base scores, d known words, e, f, g slots, texts and times. LACK: token after before isn't there; it occurs n times in text `at`, and is asked of shard next.
SUM, VALUE, OWN, LACK = range(4)
_ANSWER = ["kind", "piece", *"abcdefg", "shard", "at", "n", "before", "token"]
_ANSWER_SQL = "kind int, piece long, " + ", ".join(f"{c} binary" for c in "abcdefg") + ", shard int, at long, n long, before long, token long"


def _answers(blobs: list[tuple], lacks: list[np.ndarray]) -> pd.DataFrame:
    """blobs: kind, piece and up to seven values. lacks: arrays of shard, piece, at, n, before and token."""
    release()
    whole = dict.fromkeys(("shard", "at", "n", "before", "token"), "Int64")  # not floats, which have too few bits for hashes
    out = pd.DataFrame([(*x, *[None] * (9 - len(x))) for x in blobs], columns=_ANSWER[:9]).reindex(columns=_ANSWER).astype(whole)
    if lacks and (rows := np.concatenate(lacks, axis=1)).shape[1]:
        more = pd.DataFrame(dict(zip(("shard", "piece", "at", "n", "before", "token"), rows, strict=True))).assign(kind=LACK).reindex(columns=_ANSWER).astype(whole)
        out = pd.concat([out, more], ignore_index=True) if blobs else more
    return out


def _sums(text: np.ndarray, *values: np.ndarray) -> tuple[bytes, ...]:
    """The texts that occur, and sums of values by text."""
    there, inverse = np.unique(text, return_inverse=True)
    return planes(there.astype(np.uint32)), *(planes(np.bincount(inverse, v, len(there))) for v in values)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which each value is."""
    distinct, inverse = np.unique(values, return_inverse=True)
    place = np.empty(len(distinct), np.int64)
    place[inverse] = np.arange(len(values))
    return distinct, place, inverse


def _counted(shards: int, hot: np.ndarray):
    """For mapInArrow: the counts alone of bigrams in learning texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, learn in _pieces(it):
            t = Tokens([x for x, k in zip(texts, learn, strict=True) if k])
            code, place, inverse = _distinct(_code(t.before, t.token))
            count = np.bincount(inverse, minlength=len(code)).astype(np.uint32)
            at, cut = _by_shard(_shard_of(t.before[place], t.token[place], hot, shards), shards)
            yield from _batches([(s, 0, _steps(code[i := at[cut[s] : cut[s + 1]]]), planes(count[i]), *[b""] * 6) for s in np.flatnonzero(np.diff(cut))], _SENT)

    return run


def _occurrences(kind: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (kind, text) of tokens, in order, and how often each occurs."""
    pair, times = np.unique(kind.astype(U) << U(32) | text.astype(U), return_counts=True)
    return (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.uint32), times.astype(np.uint32)


def _asked(shards: int, hot: Broadcast, tokens: int, words: int):
    """For mapInArrow: the trigrams of all texts with counts and occurrences (shard below shards), the words that aren't broadcast (from shards on; their
    hashes as code), and a row that each piece keeps for itself (shard below 0)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot1, hot2), part, none = hot.value, TaskContext.get().partitionId(), b""
        for number, (ids, texts, learn) in enumerate(_pieces(it)):
            piece, t, rows = part << 32 | number, Tokens(texts), []
            code, first, inverse = _distinct(_code(t.context, t.token))
            at, cut = _by_shard(_shard_of(t.context[first], t.token[first], hot2[0], shards), shards)
            rank = np.empty(len(first), np.int64)
            rank[at] = np.arange(len(first))
            held, text, times = _occurrences(rank[inverse], t.text)
            count, first = np.bincount(inverse, learn[t.text], len(code)).astype(np.uint32)[at], first[at]
            often = (np.bincount(held, minlength=len(first)) > OFTEN) & (count > 0)
            slot = np.where(often, np.cumsum(often), 0).astype(np.uint32)
            mine = often[held]
            kept = planes(slot[held[mine]]), planes(text[mine]), planes(times[mine])
            held, text, times = held[~mine], text[~mine], times[~mine]
            ends = np.searchsorted(held, cut)
            for s in np.flatnonzero(np.diff(cut)):
                a, e = cut[s], cut[s + 1]
                i, p, lacks = at[a:e], slice(ends[s], ends[s + 1]), first[a:e][count[a:e] == 0]
                onward = planes(np.concatenate([t.before[lacks], t.token[lacks]])) if len(lacks) else none
                rows.append((s, piece, _steps(code[i]), planes(count[a:e]), _steps((held[p] - a).astype(np.uint32)), planes(text[p]), planes(times[p]), planes(slot[a:e]) if slot[a:e].any() else none, onward, none))
            keys, inverse = np.unique(t.token, return_inverse=True)
            n = _at(*hot1, keys, -1)
            near = n >= 0
            base = np.where(near, log_p(np.maximum(0, n), tokens, words), 0)
            local = [planes(np.bincount(t.text, x[inverse], len(texts))) for x in (base, (n > 0).astype(np.float64))]
            lost = np.array([i is None for i in ids])
            own = np.array([0 if i is None else i for i in ids], np.int64).tobytes() + lost.tobytes()
            rows.append((-1 - piece % shards, piece, own, planes(t.n.astype(np.int64)), *local, *kept, none))
            at, cut = _by_shard(np.where(near, shards, (keys % U(shards)).astype(np.int64)), shards)
            rank = np.full(len(keys), len(keys))
            rank[at[: cut[shards]]] = np.arange(cut[shards])
            mine = rank[inverse]
            held, text, times = _occurrences(mine[mine < len(keys)], t.text[mine < len(keys)])
            ends = np.searchsorted(held, cut)
            for s in np.flatnonzero(np.diff(cut)):
                p = slice(ends[s], ends[s + 1])
                rows.append((shards + s, piece, _steps(keys[at[cut[s] : cut[s + 1]]]), none, _steps((held[p] - cut[s]).astype(np.uint32)), planes(text[p]), planes(times[p]), *[none] * 3))
            yield from _batches(rows, _SENT)

    return run


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """code and count of the n-grams counted in a shard's messages, in order."""
    codes, counts = [np.zeros(0, U)], [np.zeros(0)]
    for c, n in zip(rows["code"], rows["count"], strict=True):
        n = from_planes(n, np.uint32)
        codes.append(_from_steps(c)[n > 0])
        counts.append(n[n > 0])
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(counts), len(code))


def _trie(rows: pd.DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> Trie:
    """The trie of a shard, mapped from a file. hot: contexts that other shards share, and their counts."""
    code, n = _merged(rows)
    context = code >> _TAILS
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    names = mix(hot[0]) >> _TAILS
    order = np.argsort(names)
    shared = _at(names[order], hot[1][order], context[begin], -1)
    total = np.where(shared < 0, np.add.reduceat(n, begin) if len(begin) else 0, shared)
    each = np.repeat(total, np.diff(np.append(begin, len(context))))
    blob = Trie.of(context, code & _TAIL, np.log10(n / (each + M)), np.log10(M / (total + M))).dump()
    del code, context, n, each
    return Trie.load(mapped(blob))


def _find(trie: Trie, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return trie.find(code >> _TAILS, code & _TAIL)


def _spread(df: DataFrame, shards: int, *more: str) -> DataFrame:
    """df dealt to so many tasks by shard: what a task reads is a few shards' bytes at every size."""
    return df.repartition(shards, "shard", *more)


def _sorted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of df (k, n), HOT rows at most, in the order of the keys."""
    rows = df.toPandas()
    keys, n = rows["k"].to_numpy(np.int64).view(U), rows["n"].to_numpy(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _tally(docs: DataFrame, shards: int) -> DataFrame:
    """shard, a (hashes, in steps) and c (counts) over learning texts, of all words (shard below shards) and of the bigrams seen LEAST times at least
    (from shards on), and how many different ones and tokens these are."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("a", pa.binary()), ("c", pa.binary())])
        for _, texts, learn in _pieces(it):
            t = Tokens([x for x, k in zip(texts, learn, strict=True) if k])
            for begin, keys in ((0, t.token), (shards, _pair(t.before, t.token))):
                found, n = np.unique(keys, return_counts=True)
                at, cut = _by_shard((found % U(shards)).astype(np.int64), shards)
                yield from _batches([(begin + s, _steps(found[i := at[cut[s] : cut[s + 1]]]), planes(n[i].astype(np.uint32))) for s in np.flatnonzero(np.diff(cut))], schema)

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found, inverse = np.unique(np.concatenate([_from_steps(x) for x in rows["a"]]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([from_planes(x, np.uint32) for x in rows["c"]]), len(found)).astype(np.int64)
        if key[0] >= shards:
            found, n = found[n >= LEAST], n[n >= LEAST]
        release()
        return pd.DataFrame([(key[0], _steps(found), planes(n), len(found), int(n.sum()))], columns=["shard", "a", "c", "words", "tokens"])

    sent = docs.mapInArrow(part, "shard int, a binary, c binary")
    return materialise(_spread(sent, shards).groupBy("shard").applyInPandas(whole, "shard int, a binary, c binary, words long, tokens long"))


def _hottest(least: int):
    """For mapInPandas: the keys of a tally seen at least least times, with their counts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            for a, c in zip(rows["a"], rows["c"], strict=True):
                n = from_planes(c, np.int64)
                yield pd.DataFrame({"k": _from_steps(a)[n >= least].view(np.int64), "n": n[n >= least]})

    return run


def score(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, n_tokens, n_known, base_score and score of every row of docs (doc_id, text, learn) under the model of those with learn; and the tokens learned from."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text", "learn")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    tally = _tally(docs, shards)
    vocabulary = tally.where(F.col("shard") < shards)
    known = vocabulary.agg(F.sum("tokens"), F.sum("words")).first()
    tokens, words = known[0] or 0, known[1] or 0
    least = max(LEAST, tokens // HOT)

    hot1 = _sorted(vocabulary.select("a", "c").mapInPandas(_hottest(least), "k long, n long"))
    keys, n = _sorted(tally.where(F.col("shard") >= shards).select("a", "c").mapInPandas(_hottest(least), "k long, n long"))
    starts, beginnings = keys == _START, hot1[0] == BOUNDARY  # every text has the start for a context, but only an empty one for its bigram
    keys, n = np.append(keys[~starts], np.full(beginnings.sum(), _START)), np.append(n[~starts], hot1[1][beginnings])
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((hot1, (keys[order], n[order])))

    bigrams = docs.mapInArrow(_counted(shards, hot1[0]), _SENT_SQL)

    def first(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Of a shard's trigrams, or of its words, the sums by text; what it has no trigram for; what pieces keep, as it came."""
        if not len(rows):
            return _answers([], [])
        shard, out, lacks = rows["shard"].iloc[0], [], []
        if shard < 0:
            return _answers([(OWN, r.piece, r.code, r.count_, r.rank, r.text, r.times, r.slot, r.onward) for r in rows.rename(columns={"count": "count_"}).itertuples(index=False)], [])
        if shard >= shards:
            have, n = (_from_steps(known["a"].iloc[0]), from_planes(known["c"].iloc[0], np.int64)) if len(known) else (np.zeros(0, U), np.zeros(0))
            for r in rows.itertuples(index=False):
                count = _at(have, n, _from_steps(r.code), 0)
                rank, text, times = _from_steps(r.rank, np.uint32), from_planes(r.text, np.uint32), from_planes(r.times, np.uint32)
                there, base, seen = _sums(text, log_p(count, tokens, words)[rank] * times, (count > 0)[rank] * times)
                out.append((SUM, r.piece, there, None, base, seen))
            return _answers(out, [])
        trie = _trie(rows, hot.value[1])
        for r in rows.rename(columns={"count": "count_"}).itertuples(index=False):
            count = from_planes(r.count_, np.uint32)
            found, value = _find(trie, _from_steps(r.code))
            if r.slot:
                slot = from_planes(r.slot, np.uint32)
                out.append((VALUE, r.piece, planes(slot[slot > 0]), planes(value[slot > 0])))
            rank, text, times = _from_steps(r.rank, np.uint32), from_planes(r.text, np.uint32), from_planes(r.times, np.uint32)
            if len(rank):
                out.append((SUM, r.piece, *_sums(text, value[rank] * times)))
            if r.onward:
                new = np.cumsum(count == 0) - 1  # where an n-gram without count is in onward
                before, token = from_planes(r.onward, U).reshape(2, -1)
                p = np.flatnonzero(~found[rank])
                at = new[rank[p]]
                lacks.append(_lacking(r.piece, text[p], times[p], before[at], token[at], _shard_of(before[at], token[at], hot.value[0][0], shards)))
        return _answers(out, lacks)

    def second(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Sums by text of the bigrams asked for; words that weren't seen after the one before go on, unless they are broadcast."""
        if not len(asked):
            return _answers([], [])
        before, token = (asked[c].to_numpy(np.int64).view(U) for c in ("before", "token"))
        found, value = _find(_trie(rows, hot.value[0]), _code(before, token))
        count = _at(*hot.value[0], token, -1)
        near = ~found & (count >= 0)
        value = np.where(near, value + log_p(np.maximum(count, 0), tokens, words), value)
        p = ~found & ~near
        piece, text, times = (asked[c].to_numpy(np.int64) for c in ("piece", "at", "n"))
        more = _lacking(piece[p], text[p], times[p], before[p], token[p], (token[p] % U(shards)).astype(np.int64))
        return _answers(_by_piece(piece, text, value * times), [more])

    def third(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Sums by text of words alone."""
        if not len(asked):
            return _answers([], [])
        have, n = (_from_steps(known["a"].iloc[0]), from_planes(known["c"].iloc[0], np.int64)) if len(known) else (np.zeros(0, U), np.zeros(0))
        value = log_p(_at(have, n, asked["token"].to_numpy(np.int64).view(U), 0), tokens, words)
        piece, text, times = (asked[c].to_numpy(np.int64) for c in ("piece", "at", "n"))
        return _answers(_by_piece(piece, text, value * times), [])

    above = _spread(vocabulary.select((F.col("shard") + shards).alias("shard"), F.lit(-1).cast("long").alias("own"), "a", "c"), shards, "own")
    asked = docs.mapInArrow(_asked(shards, hot, tokens, words), _SENT_SQL).withColumn("own", F.when(F.col("shard") < 0, F.col("piece")).otherwise(-1))
    answers = materialise(_spread(asked, shards, "own").groupBy("shard", "own").cogroup(above.groupBy("shard", "own")).applyInPandas(first, _ANSWER_SQL))
    lacks = [*"abcdefg"]
    backed = _spread(answers.where(F.col("kind") == LACK).drop(*lacks), shards).groupBy("shard").cogroup(_spread(bigrams, shards).groupBy("shard"))
    backed = materialise(backed.applyInPandas(second, _ANSWER_SQL))
    last = _spread(backed.where(F.col("kind") == LACK).drop(*lacks), shards).groupBy("shard").cogroup(_spread(vocabulary.select("shard", "a", "c"), shards).groupBy("shard"))
    last = last.applyInPandas(third, _ANSWER_SQL)
    parts = answers.unionByName(backed).where(F.col("kind") != LACK).unionByName(last).select("kind", "piece", *"abcdefg")
    return parts.groupBy("piece").applyInPandas(_finish, "doc_id long, n_tokens long, n_known long, base_score double, score double"), tokens


def _lacking(piece, text: np.ndarray, times: np.ndarray, before: np.ndarray, token: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return np.stack([shard, np.broadcast_to(piece, len(text)), text.astype(np.int64), times.astype(np.int64), before.view(np.int64), token.view(np.int64)])


def _by_piece(piece: np.ndarray, text: np.ndarray, value: np.ndarray) -> list[tuple]:
    order = np.argsort(piece, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(piece[order], prepend=-1)), len(order))
    return [(SUM, int(piece[order[a]]), *_sums(text[order[a:e]], value[order[a:e]])) for a, e in zip(ends, ends[1:], strict=False)]


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    """The texts of a piece with what was found for them."""
    rows = rows.sort_values(["kind", "a", "b", "c"], na_position="first")  # so that sums come out alike each time
    own = rows[rows["kind"] == OWN].iloc[0]
    n = from_planes(own.b, np.int64)
    ids, lost = np.frombuffer(own.a, np.int64, len(n)), np.frombuffer(own.a[8 * len(n) :], bool)
    base, known, score = from_planes(own.c, np.float64).copy(), from_planes(own.d, np.float64).copy(), np.zeros(len(n))
    slots, text, times = (from_planes(x, np.uint32) for x in (own.e, own.f, own.g))
    values = np.zeros(int(slots.max(initial=0)) + 1)
    for r in rows[rows["kind"] == VALUE].itertuples(index=False):
        values[from_planes(r.a, np.uint32)] = from_planes(r.b, np.float64)
    score += np.bincount(text, values[slots] * times, len(n))
    for r in rows[rows["kind"] == SUM].itertuples(index=False):
        at = from_planes(r.a, np.uint32)
        for total, x in ((score, r.b), (base, r.c), (known, r.d)):
            if x:
                total[at] += from_planes(x, np.float64)
    doc = pd.array(ids, dtype="Int64")
    doc[lost] = pd.NA
    return pd.DataFrame({"doc_id": doc, "n_tokens": n, "n_known": np.rint(known).astype(np.int64), "base_score": base, "score": score})


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def train_and_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    out, tokens = score(docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("learn")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
