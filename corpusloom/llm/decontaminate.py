"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

A window is ten consecutive words of a test item, or the whole of a shorter item. Its terms are ranked by how often the corpus holds them. The index stores
postings (term, document, position) of the two rarest terms of every window. The lists of the rarest terms are intersected, adjusted by the terms' offset, in a
join on document and place; windows that share both terms and their distance share the join. What is left is few; of those documents alone the
postings of all terms are indexed, and the lists of the remaining terms are intersected with it, so a match is exact. Windows with a term that the corpus lacks are
never searched. An item is near in a document where the two rarest terms of one of its windows, among those that occur, stand within span words.

What is broadcast is counted first: beyond MOST_TERMS rows Spark joins by shuffle instead. Postings are joined by document as well as term, so no term, however
common, meets in one task.

Defined cases: null and empty texts have no words and no hits. Items without item_id or words are left out; items
with one item_id are one item. Rows with one doc_id and one text get the same result each. Empty tables give no
hits. An item whose every window has but one different word is never near. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, materialise

#: A word: a run of a-z, digits and all that is not ASCII, in lower-cased text.
#: Said as what it holds: Java's matcher is more than twice as slow on the complement.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: The most rows of a table made from the test set that is broadcast.
MOST_TERMS = 200_000


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_TERMS else df


def item_windows(items: DataFrame, length: int) -> DataFrame:
    """window_id, window (words) and items (sorted ids as strings) of every distinct window of items (item_id, text)."""
    w = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    each = w.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {length - 1})), i -> slice(w, i, {length}))")).alias("window"))
    found = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.select(F.xxhash64("window").alias("window_id"), "window", "items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n, its occurrences in docs, of those terms that occur. terms: distinct."""
    # the outer form: else Spark adds a filter on the array's size, and with it cuts every text twice
    there = docs.select(F.explode_outer(words(F.col("text"))).alias("term"))
    return there.join(_small(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("n"))


def ranked(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window_id, n (words), items, term, at (from 0) and rank of each place of each window whose term occurs, the rarest first (the first of equals), and how many
    occur (there)."""
    each = windows.select("window_id", F.size("window").alias("words"), "items", F.posexplode("window").alias("at", "term")).join(_small(counts, counts.count()), "term")
    w = each.groupBy("window_id").agg(F.first("words").alias("words"), F.first("items").alias("items"), F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("r"))  # a window's words
    w = w.select("window_id", F.col("words").alias("n"), "items", F.size("r").alias("there"), F.posexplode("r").alias("rank", "x"))
    return w.select("window_id", "n", "items", "there", "x.term", "x.at", "rank")


def rare_pairs(places: DataFrame) -> DataFrame:
    """pair, items, term and other (whether it is the second) of the two rarest different terms of each window."""
    first = places.where("rank = 0").select("window_id", "items", F.col("term").alias("a"))
    second = places.join(first.select("window_id", "a"), "window_id").where(F.col("term") != F.col("a")).groupBy("window_id").agg(F.min_by("term", "rank").alias("b"))
    pairs = first.join(second, "window_id").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.explode("items").alias("item"))
    pairs = pairs.groupBy("x", "y").agg(F.collect_set("item").alias("items")).withColumn("pair", F.xxhash64("x", "y"))
    sides = F.array(*(F.struct(F.col(c).alias("term"), F.lit(o).alias("other")) for c, o in (("x", False), ("y", True))))
    return pairs.select("pair", "items", F.explode(sides).alias("s")).select("pair", "items", "s.term", "s.other")


#: Stands after a text's last word, so that the index tells how many words there are.
END = ""
KEY = ["doc_id", "text_key"]


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: term, doc_id, text_key and position (from 0) of the terms (distinct) in docs, and END with the number of words of each row."""
    placed = F.posexplode_outer(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("position", "term")
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), placed)
    terms = materialise(terms.union(terms.sparkSession.createDataFrame([(END,)], "term string")))
    return each.join(_small(terms, terms.count()), "term").select("term", *KEY, "position")


def _met(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
    """The rows of x whose document and columns `on` are in y."""
    x, y = x.alias("x"), y.alias("y")
    return x.join(y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in KEY] + [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on], "left_semi")


def _begins(index: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text_key, window_id and start of the windows whose two rarest terms stand at their distance; of windows of one word, of all."""
    whole = places.where("there = n")
    second = whole.where("rank = 1").select("window_id", F.col("term").alias("b"), F.col("at").alias("at_b"))
    starts = whole.where("rank = 0").select("window_id", F.col("term").alias("a"), "at").join(second, "window_id", "left")
    starts = materialise(starts.select("window_id", "a", "at", "b", (F.col("at_b") - F.col("at")).alias("apart")).withColumn("sign", F.xxhash64("a", "b", "apart")))
    signs = materialise(starts.select("sign", "a", "b", "apart").distinct())
    n = signs.count()
    first = index.join(_small(signs.select(F.col("a").alias("term"), "sign", (F.col("b").isNull()).alias("alone")), n), "term").select(*KEY, "sign", "position", "alone")
    other = index.join(_small(signs.where("b IS NOT NULL").select(F.col("b").alias("term"), "sign", "apart"), n), "term").select(*KEY, "sign", (F.col("position") - F.col("apart")).alias("position"))
    both = _met(first.where("NOT alone"), other, "sign", "position").unionByName(first.where("alone"))
    found = both.join(_small(starts.select("sign", "window_id", "at"), starts.count()), "sign").where("position >= at")
    return found.select(*KEY, "window_id", (F.col("position") - F.col("at")).alias("start")).distinct()


def phrases(docs: DataFrame, index: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text_key, start (from 0), n (words) and items of every exact occurrence of a window, by intersection from the rarest term on."""
    begun = materialise(_begins(index, places))
    left = materialise(begun.select(*KEY).distinct()).toDF("id", "key")
    few = _small(left, left.count())
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    keyed = keyed.join(few, keyed.doc_id.eqNullSafe(few.id) & (keyed.text_key == few.key), "left_semi").dropDuplicates(KEY)
    rest = postings(keyed, places.select("term").distinct())
    terms = places.where("there = n").select("window_id", "n", "items", "at", "term")
    wanted = begun.join(_small(terms, terms.count()), "window_id").withColumn("position", F.col("start") + F.col("at"))
    full = _met(wanted, rest, "position", "term").groupBy(*KEY, "window_id", "start").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("items").alias("items"))
    return full.where("k = n").select(*KEY, "start", "n", "items")


def near(index: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """doc_id, text_key and item for which the terms of a pair stand within span words.

    Positions are cut into blocks of span words, and a posting meets its own block and the next, so a term that fills a document costs no more than its postings."""
    each = index.join(_small(pairs, pairs.count()), "term").select(*KEY, "pair", "other", "position", F.floor(F.col("position") / span).alias("own"))
    spread = each.withColumn("block", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    place = lambda best, o, here: best(F.when((F.col("other") == o) & ((F.col("own") == F.col("block")) == here), F.col("position")))
    met = spread.groupBy(*KEY, "pair", "block").agg(place(F.max, False, False).alias("a0"), place(F.max, True, False).alias("b0"), place(F.min, False, True).alias("a1"), place(F.min, True, True).alias("b1"))
    close = met.where(f"(a1 IS NOT NULL AND b1 IS NOT NULL) OR b1 - a0 <= {span} OR a1 - b0 <= {span}").select(*KEY, "pair").distinct()
    named = pairs.where("other").select("pair", F.explode("items").alias("item"))
    return close.join(_small(named, named.count()), "pair").select(*KEY, "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, span: int | None = 20) -> DataFrame:
    """For every row of docs (doc_id, text): n_words, n_hit (words inside an exact match), n_items and items (with exact
    matches; sorted), n_near (items with near matches; null without span) and contaminated."""
    docs = docs.select("doc_id", "text")
    windows = materialise(item_windows(items, length))
    counts = materialise(term_counts(docs, windows.select(F.explode("window").alias("term")).distinct()))
    places = materialise(ranked(windows, counts))
    pairs = materialise(rare_pairs(places)) if span is not None else None
    rare = places.where("rank <= 1").select("term")
    index = materialise(postings(docs, (rare if pairs is None else rare.union(pairs.select("term"))).distinct()))
    covered = F.expr(
        """aggregate(array_sort(collect_set(struct(CAST(start AS BIGINT) AS s, CAST(start + n AS BIGINT) AS e))),
             named_struct('n', 0L, 'to', 0L),
             (a, x) -> named_struct('n', a.n + greatest(0L, x.e - greatest(a.to, x.s)), 'to', greatest(a.to, x.e)), a -> a.n)"""
    )
    exact = phrases(docs, index, places).groupBy(*KEY).agg(covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    if pairs is None:
        both = exact.withColumn("n_near", F.lit(None).cast("long"))
    else:
        close = near(index, pairs, span).groupBy(*KEY).agg(F.count("*").alias("n_near"))
        both = exact.unionByName(close, allowMissingColumns=True).groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("n_hit", "items", "n_near")))
    found = both.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n_hit", "items", "n_near")
    base = index.where(F.col("term") == END).select(*KEY, F.col("position").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return base.join(found, base.doc_id.eqNullSafe(found.id) & (base.text_key == found.key), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.lit(None) if pairs is None else F.coalesce("n_near", F.lit(0))).cast("long").alias("n_near"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
