"""Spelling variants grouped by an even-partition pigeonhole join.

A word one edit from another keeps one of its two even segments whole. Every word of length l is indexed under its
first l // 2 code points and under the rest; a word looks among those of its own length for its own two segments, and
among those one shorter for its first segment and for its last, moved by one place. What meets on a segment is verified
to be one edit apart, and pairs met twice are counted once.

A segment that more than MOST words of one length share is not joined. Its words are cut again: what is left of them
beside the segment must itself be one edit apart, so it is halved by the same rule, and segment and half together are the new key.
So no key joins many words with many others, and no pair is lost; a key with one code point left holds true variants only.

Defined cases: null texts hold no words; a null doc_id counts as an empty one; repeated rows count again. Runs of any
length are words. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, materialise

#: A maximal run of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
#: The least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
TIMES = 5
#: One run in so many loses a code point.
DIVISOR = 199
#: Words that are joined under one segment; more are told apart by a further one.
MOST = 64


def words(docs: DataFrame) -> DataFrame:
    """word and n of every word of docs (doc_id, text) that is long and frequent enough.

    A run whose crc32 with its doc_id divides by DIVISOR loses the code point that the crc32 names.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    runs = runs.select("run", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    found = runs.select(F.when(F.col("h") % DIVISOR == 0, short).otherwise(F.col("run")).alias("word"))
    return found.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


KEY = ["length", "path", "seg"]


def _part(word: Column, begin: Column, end: Column) -> Column:
    return word.substr(begin + 1, end - begin)


def _halves(entries: DataFrame) -> DataFrame:
    """Two entries for each: its open part's first half joins the key, or its second.

    Entries hold word, n, the key, a and b (the open part of the indexed word) and shift (1 for a word that is one longer).
    """
    word, a, b, shift, seg = (F.col(c) for c in ("word", "a", "b", "shift", "seg"))
    mid = a + F.floor((b - a) / 2).cast("int")
    first = F.struct(F.concat("path", F.lit("0")).alias("path"), F.concat(seg, F.lit("|"), _part(word, a, mid)).alias("seg"), mid.alias("a"), b.alias("b"))
    second = F.struct(F.concat("path", F.lit("1")).alias("path"), F.concat(seg, F.lit("|"), _part(word, mid + shift, b + shift)).alias("seg"), a.alias("a"), mid.alias("b"))
    return entries.select("word", "n", "length", "shift", F.explode(F.array(first, second)).alias("x")).select("word", "n", "length", "shift", "x.*")


def _whole(vocabulary: DataFrame, shifts: list[int]) -> DataFrame:
    """Every word with all of it open, as of its own length or as one longer than those it looks for."""
    shift = F.explode(F.array(*map(F.lit, shifts))).alias("shift")
    out = vocabulary.select("word", "n", shift).withColumn("length", F.char_length("word") - F.col("shift"))
    return out.select("word", "n", "length", "shift", F.lit("").alias("path"), F.lit("").alias("seg"), F.lit(0).alias("a"), F.col("length").alias("b"))


def near_pairs(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, other and other_n of every two distinct words of vocabulary (word, n) one edit apart, once a pair."""
    index, probes, found = _whole(vocabulary, [0]), _whole(vocabulary, [0, 1]), []
    while True:
        index, probes = _halves(index), _halves(probes)
        sizes = index.groupBy(*KEY).agg(F.count("*").alias("size"))
        sized = materialise(index.join(sizes, KEY))
        hot = (F.col("size") > most) & (F.col("b") - F.col("a") > 1)
        cold = sized.where(~hot).select(*KEY, F.col("word").alias("other"), F.col("n").alias("other_n"))
        once = (F.col("shift") == 1) | (F.col("word") < F.col("other"))
        met = cold.join(probes.select("word", "n", "shift", *KEY), KEY).where(once & (F.levenshtein("word", "other", 1) == 1))
        found.append(materialise(met.select("word", "n", "other", "other_n")))
        index = sized.where(hot).drop("size")
        if index.isEmpty():
            break
        keys = materialise(index.select(*KEY).distinct())
        probes = materialise(probes.join(keys, KEY, "left_semi").select(probes.columns))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["word", "other"])


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): pointers are jumped until none moves. n rises TIMES-fold a step, so few rounds do."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        to = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(at.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group_variants(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of vocabulary (word, n; words distinct)."""
    vocabulary = materialise(vocabulary.select("word", "n"))
    pairs = near_pairs(vocabulary, most)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    good = -F.col("best.m") >= TIMES * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    roots = _roots(near.where("form IS NOT NULL"))
    out = vocabulary.join(near.join(roots, "word", "left"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The variants among the words of docs (doc_id, text)."""
    return group_variants(words(docs), most)
