"""Flags, protection and the keep-or-remove policy of a corpus, each a boolean column that is never null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def missing(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def safe_title(title: Column, safe: Sequence[str]) -> Column:
    return T.any_of(F.lower(title), safe)


def missing_metadata(title: Column, author: Column, year: Column, safe: Sequence[str]) -> Column:
    """No title; or no author or year where the title isn't safe."""
    return missing(title) | ((missing(author) | year.isNull()) & ~safe_title(title, safe))


def no_abstract(abstract: Column, title: Column, safe: Sequence[str], most: int = 50) -> Column:
    return (F.length(F.trim(F.coalesce(abstract, F.lit("")))) <= most) & ~safe_title(title, safe)


def blacklisted(title: Column, noise: Sequence[str], safe: Sequence[str], exact: Sequence[str]) -> Column:
    """A noise term without a safe word, or one of the exact titles."""
    low = F.lower(title)
    return (T.any_of(low, noise) & ~safe_title(title, safe)) | _true(low.isin(*exact))


def isolated(works: DataFrame, edges: DataFrame, key: str, before: int) -> DataFrame:
    """Keys of works of a year up to `before` that neither cite nor are cited: two anti joins on distinct ends."""
    old = works.where((F.col("year") <= before) & F.col(key).isNotNull()).select(key)
    return old.join(edges.select(F.col("src").alias(key)), key, "left_anti").join(edges.select(F.col("ref").alias(key)), key, "left_anti")


def semantic_outliers(vectors: DataFrame, key: str, vector: str, sigma: float = 2.0) -> DataFrame:
    """key, distance (cosine, to the mean vector) and outlier: beyond mean + sigma population deviations.

    Two one-row tables, the centroid and the threshold, are joined to the rows; both are of fixed size.
    """
    centre = V.centroid(vectors, vector).select(V.unit(F.col("centroid")).alias("centre"))
    far = vectors.crossJoin(F.broadcast(centre)).select(key, (1 - V.cosine(V.wide(F.col(vector)), F.col("centre"))).alias("distance"))
    limit = far.agg((F.avg("distance") + sigma * F.stddev_pop("distance")).alias("limit"))
    return far.crossJoin(F.broadcast(limit)).select(key, "distance", (F.col("distance") > F.col("limit")).alias("outlier"))


def concept_groups(c: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """How many groups have one of their words among a text's words of three ASCII letters or more."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    out = F.lit(0)
    for terms in groups.values():
        out = out + F.arrays_overlap(words, F.array(*map(F.lit, terms))).cast("int")
    return F.coalesce(out, F.lit(0)).cast("long")


def relevance_candidates(abstract: Column, title: Column, groups: Mapping[str, Sequence[str]], flagged: Column) -> Column:
    """What a model should score: has text, fewer than two groups in title and in abstract, and isn't flagged."""
    return ~missing(abstract) & (concept_groups(title, groups) < 2) & (concept_groups(abstract, groups) < 2) & ~flagged


def protection(**reasons: Column) -> Column:
    """The reasons that hold, joined; empty if none."""
    return F.concat_ws("; ", *(F.when(_true(c), F.lit(k)) for k, c in reasons.items()))


def policy(flagged: Column, protected: Column, year: Column, floor: int) -> Column:
    """keep or remove; a year below the floor is removed even where protected."""
    return F.when(_true(year < floor), "remove").when(flagged & ~protected, "remove").otherwise("keep")


def flag_string(**flags: tuple[Column, Column | None]) -> Column:
    """Flags that hold, with their details, joined by |."""
    parts = []
    for name, (c, detail) in flags.items():
        said = F.lit(name) if detail is None else F.concat(F.lit(f"{name}:"), detail)
        parts.append(F.when(_true(c), said))
    return F.concat_ws("|", *parts)


def verify_terms(titles: DataFrame, title: str, flag: str, terms: Sequence[str]) -> DataFrame:
    """Of each noise term: titles with it, of those flagged, and missed. One pass: terms are exploded where they match."""
    low = F.lower(F.col(title))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms)))
    each = titles.select(F.explode(found).alias("term"), F.col(flag).alias("f")).groupBy("term").agg(F.count("*").alias("matches"), F.count_if("f").alias("flagged"))
    every = titles.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return every.join(each, "term", "left").select("term", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("matches", "flagged"))).withColumn("missed", F.col("matches") - F.col("flagged"))


def quadrant(lang: Column, south: Column, known: Column) -> Column:
    """EN or nonEN by N or S; null where language or place is unknown."""
    side = F.when(south, "S").otherwise("N")
    return F.when(lang.isNotNull() & known, F.concat(F.when(lang == "en", "EN").otherwise("nonEN"), F.lit("-"), side))


def theme(c: Column, patterns: Sequence[str], first: Sequence[str], second: Sequence[str]) -> Column:
    """Any pattern; or a term of the first kind together with one of the second."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | low.rlike(p)
    return hit | (T.any_of(low, first) & T.any_of(low, second))


def institution(c: Column, allowed: Sequence[str], excluded: Sequence[str]) -> Column:
    """exclude before allow before unknown."""
    return F.when(T.any_of(F.lower(c), excluded), "exclude").when(T.any_of(F.lower(c), allowed), "allow").otherwise("unknown")


def subtopic(works: DataFrame, title: str, cited: str, key: str, patterns: Sequence[str]) -> DataFrame:
    """Works whose title fits a pattern; of equal normalised titles that with most citations, then the smallest key.

    max_by needs one row a title before the shuffle, where a window would move them all.
    """
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.col(title).rlike(p)
    best = F.max_by(F.struct(key, title, cited), F.struct(F.col(cited), -F.col(key)))
    return works.where(fits).groupBy(T.norm_title(F.col(title)).alias("norm")).agg(best.alias("b")).select(f"b.{key}", f"b.{cited}")


def topics(c: Column, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """The topic with most terms found, earlier ones first among equals, and the second where it has two and is at most one
    behind: a struct (topic, second); nulls where nothing is found."""
    low = F.lower(c)
    scored = F.array_sort(F.array(*(F.struct((-T.hits(low, terms)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(taxonomy.items()))))
    top, next_ = scored[0], scored[1]
    near = (-next_["s"] >= 2) & (next_["s"] - top["s"] <= 1)
    return F.struct(F.when(top["s"] < 0, top["name"]).alias("topic"), F.when((top["s"] < 0) & near, next_["name"]).alias("second"))


def cascade(rules: Sequence[tuple[Column, str]], other: str) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(other)
    for c, value in reversed(rules):
        out = F.when(c, value).otherwise(out)
    return out


def period(year: Column, breaks: Sequence[int], first: int, last: int) -> Column:
    """The label of the period a year is in; null outside."""
    starts, ends = [first, *breaks], [*(b - 1 for b in breaks), last]
    out = F.lit(None).cast("string")
    for a, b in zip(starts, ends, strict=True):
        out = F.when(year.between(a, b), f"{a}-{b}").otherwise(out)
    return out


def in_snapshot(works: DataFrame, dois: DataFrame, ids: DataFrame) -> DataFrame:
    """works (doi, id) with in_snapshot: doi among dois, or no doi and id among ids. Each side is joined once on distinct keys."""
    a = dois.distinct().withColumn("by_doi", F.lit(True))
    b = ids.distinct().withColumn("by_id", F.lit(True))
    out = works.join(a, "doi", "left").join(b, "id", "left")
    return out.withColumn("in_snapshot", _true(F.col("by_doi")) | (F.col("doi").isNull() & _true(F.col("by_id")))).drop("by_doi", "by_id")
