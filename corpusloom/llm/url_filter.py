"""URL filters: rules by host and path, else logistic regression on hashed character n-grams, JVM-side throughout.

The n-grams are made by SQL, hashed by murmur3 into a vector of fixed length, and weighed by a model that is
fitted to a small labelled URL table; the table's rows are the bound of all that the driver gathers.

Defined cases: with labels of one class that class is the verdict, and with none it is allow. A null URL, or one without ://, has an empty host and path; no rule fits it, and the model weighs
its empty n-grams. Rows are independent; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER

#: Lengths of the n-grams and buckets of their hashes.
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
#: The most rules that are written into the query.
MOST_RULES = 1000

# Words of hosts that are blocked, words of ordinary hosts (some of which hold parts of the former), and what stands beside either.
RISKY = """
casino poker slots roulette blackjack jackpot bets betting bet bingo lotto gambling pills pill viagra cialis pharmacy meds steroids porn adult xxx sex sexy nude cams webcams escort hookup
payday loans loan forex bitcoin doubler giveaway prize winner spam spammer backlinks linkfarm followers traffic clicks popup popunder ads adserver adclick track tracker tracking affiliate
warez crack keygen torrent replica counterfeit phishing
""".split()
ORDINARY = """
garden library school recipe travel museum history science weather music theatre river mountain village forum news health kitchen books radio church football archive university nature birds photo software
linux data math physics chemistry biology poetry language dictionary philosophy cooking bakery bridge castle harbour island forest ocean farmers bicycle railway airport hotel hospital parliament council
county journal press magazine gazette teacher student college academy institute society better alphabet betty essex sextant sussex pillow pillar caterpillar sportswear loanword camshaft cambridge campus
adsorption address roads trades trackfield soundtrack ticket clickstream slotted winners winter windows passport export classics classroom crackers cracow replicate bookstore library poetry market
""".split()
BESIDE = "best free cheap my the top online win club shop now hub world zone pro x farm big new daily city super real go easy fast old web net24 one house land blue red".split()
ENDS = "com net org info io co biz eu de fr es top site club".split()
#: Rows of the table for each risky word, of ordinary hosts for each row that is blocked, and the share of these with a made-up name.
EACH, ORDINARY_EACH, MADE_UP = 16, 3, 0.7


def _table() -> list[tuple[str, float]]:
    """Labelled URLs (1: block). Both classes get the same prefixes, endings, neighbours and paths, so that only the words and the letters of the names tell them apart."""
    rng = random.Random(20240117)
    syllable = lambda: rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", *"nrstlmdh"])

    def name(word: str) -> str:
        beside = [rng.choice(BESIDE) for _ in range(rng.choice((0, 1, 1, 2)))]
        beside.insert(rng.randint(0, len(beside)), word)
        return rng.choice(("-", "-", "")).join(beside)

    def url(host: str) -> str:
        prefix = rng.choice(("", "", "www.", "www.", "m.", "blog.", "shop.", "static.", f"{syllable()}{syllable()}."))
        middle = rng.choice(("", "", "", f"{syllable()}{syllable()}."))
        path = rng.choice(("", "/", f"/{rng.choice(('en', 'de', 'fr', 'es', 'it'))}/{rng.randint(1, 9999)}", f"/{rng.randint(1, 9999)}.html", f"/{syllable()}{syllable()}/{rng.randint(1, 99)}", f"/{rng.choice(ORDINARY)}/{syllable()}{syllable()}"))
        return f"http://{prefix}{host}.{middle}{rng.choice(ENDS)}{path}"

    rows = [(url(name(w)), 1.0) for w in RISKY for _ in range(EACH)]
    for _ in range(ORDINARY_EACH * len(rows)):
        made = "".join(syllable() for _ in range(rng.randint(2, 4))) if rng.random() < 0.5 else "".join(rng.choices("eeettaaooinshrdlucmfwypvbgk", k=rng.randint(4, 10)))
        rows.append((url(name(made if rng.random() < MADE_UP else rng.choice(ORDINARY))), 0.0))
    return rows


def labelled(spark: SparkSession) -> DataFrame:
    """The small table that the model is fitted to unless another is given: url, label (1: block)."""
    return spark.createDataFrame(_table(), "url string, label double")


def with_parts(df: DataFrame) -> DataFrame:
    """df (url) with host and path."""
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return df.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, each marked with where it stands; lower-cased."""
    def cut(mark: str, s: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - F.lit(n - 1)))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substring(s, i, F.lit(n))))

    ends = {m: F.concat(F.lit("^"), F.lower(s), F.lit("$")) for m, s in (("h", host), ("p", path))}
    return F.concat(*(cut(m, s, n) for m, s in ends.items() for n in GRAMS))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(df.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def fit(labels: DataFrame) -> LogisticRegressionModel:
    """The model of labels (url, label: 1 is block), of which both occur; either class weighs the same in all."""
    labels = labels.select("url", F.col("label").cast("double").alias("label")).where("label IS NOT NULL").coalesce(1)  # a small table, read again at each step
    share = labels.agg(F.avg("label")).first()[0]
    labels = labels.withColumn("weight", F.when(F.col("label") > 0.5, 0.5 / share).otherwise(0.5 / (1 - share)))
    model = LogisticRegression(maxIter=60, regParam=0.0003, standardization=False, featuresCol="features", labelCol="label", weightCol="weight")
    return model.fit(_features(with_parts(labels)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (length, rule, verdict) of the longest rule (host, path, verdict) that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [
        F.when((F.concat(F.lit("."), host).endswith(F.lit(f".{h}"))) & path.startswith(F.lit(p)), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, rule: string, verdict: string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], labels: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, p_block (of the model) and verdict of every row of pages (page_id, url)."""
    labels = labelled(pages.sparkSession) if labels is None else labels
    df = with_parts(pages.select("page_id", "url")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    kinds = [r.y for r in labels.select((F.col("label") > 0.5).alias("y")).where("y IS NOT NULL").distinct().collect()]
    if len(kinds) == 2:
        df = fit(labels).transform(_features(df)).withColumn("p_block", vector_to_array("probability")[1])
    else:  # nothing to tell apart
        df = df.withColumn("p_block", F.lit(float(kinds == [True])))
    verdict = F.coalesce("fit.verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return df.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), "p_block", verdict.alias("verdict"))
