"""Language by character trigrams: smoothed log probabilities learned from labelled texts, summed over a text's words.

Each distinct word is scored once, whatever the number of texts that hold it: trigrams are taken of the words, a text's score is the sum over its words,
and all of it is joins and aggregates. Words carry a mark at either end, so first and last letters count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import counting, graph

#: Letters of a gram, and what is added to each count.
WIDTH, ADDED = 3, 0.5
#: Distinct grams, or words, with their numbers in all languages, that are broadcast at most; more meet in a join.
MOST_SENT = 500_000


def words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, word and n of every text (key, text): runs of letters, lower-cased."""
    each = counting.counts(texts, key, F.col(text), counting.letters, counting.once(texts.where(F.col(text).isNotNull()), key))
    return each.select(key, F.col("term").alias("word"), "n")


def _grams(word: Column) -> Column:
    marked = F.concat(F.lit("_"), word, F.lit("_"))
    return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substring(marked, i, F.lit(WIDTH)))


def model(counted: DataFrame, languages: DataFrame, key: str) -> DataFrame:
    """gram, lang and lp, the log probability of every gram seen in any language, in each: learned from words (key, word, n) of the texts that languages (key, lang) names."""
    known = counted.join(languages.where("lang IS NOT NULL"), key).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = known.select("lang", "n", F.explode(_grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("c"))
    grams = graph.written(grams)  # read three times
    seen = grams.select("gram").distinct()
    total = grams.groupBy("lang").agg(F.sum("c").alias("t"))  # a row a language
    size = seen.agg(F.count("*").alias("v"))
    every = seen.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(size)).join(grams, ["lang", "gram"], "left")
    return every.select("gram", "lang", F.ln((F.coalesce("c", F.lit(0)) + ADDED) / (F.col("t") + ADDED * (F.col("v") + 1))).alias("lp"))


def detect(texts: DataFrame, key: str, text: str, languages: DataFrame) -> DataFrame:
    """key and detected of every text: the language of greatest sum, the first by name among equals; null for a text without letters that any known text has.

    A gram that no labelled text has says nothing and is left out.
    """
    counted = graph.settle(words(texts, key, text))
    table = graph.settle(model(counted, languages, key))
    names = [r["lang"] for r in table.select("lang").distinct().orderBy("lang").collect()]  # a row a language
    if not names:
        return texts.select(key, F.lit(None).cast("string").alias("detected"))
    every = range(len(names))
    by_gram = table.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == x, F.col("lp"))).alias(f"p{i}") for i, x in enumerate(names)))
    each = counted.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    scored = graph.settle(each.join(_sent(graph.settle(by_gram)), "gram").groupBy("word").agg(*(F.sum(f"p{i}").alias(f"s{i}") for i in every)))
    # Where the words' scores are sent, a text's words are still side by side and its sums are told before they move.
    total = counted.join(_sent(scored), "word").groupBy(key).agg(*(F.round(F.sum(F.col("n") * F.col(f"s{i}")), 4).alias(f"s{i}") for i in every))
    best = F.array_min(F.array(*(F.struct((-F.col(f"s{i}")).alias("m"), F.lit(x).alias("lang")) for i, x in enumerate(names))))
    return texts.select(key).join(total.select(key, best["lang"].alias("detected")), key, "left")


def _sent(rows: DataFrame) -> DataFrame:
    """rows, written already: broadcast while they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows
