"""Words are counted where a text is read, without a row for each occurrence or a shuffle of them: the same counts and weights as a plain explode."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vocabulary import STOPS
from corpusloom.operators import counting, labels, language
from corpusloom.operators import divergence as D
from corpusloom.plans import divergence_queries as Q

SF = "/root/testdata/sf0.001"
ODD = [(1, "Ab ab x9_y É́ ÉCOLE école 東京 東京 Ⅷ² a1b İstanbul ΣΑΣ"), (2, None), (3, ""), (4, "—  !"), (5, "ab\nAB\tab ab"), (6, "x²y z٣w 𝒳𝒴 _ __ a_b")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exploded(df, pattern):
    each = df.select("id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(pattern), F.lit(0))).alias("term"))
    return {tuple(r) for r in each.groupBy("id", "term").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("rows", [ODD, ODD + [(1, "ab neu"), (None, "ab"), (None, "ab ab")]])
def test_counts_equal_exploded_ones(spark, rows):
    df = spark.createDataFrame(rows, "id long, t string")
    alone = counting.once(df.where("t IS NOT NULL"), "id")
    assert alone == (len(rows) == len(ODD))
    for found, pattern in ((Q._words, Q._WORD), (counting.letters, r"\p{L}+")):
        got = counting.counts(df, "id", F.col("t"), found, alone)
        assert "Generate" not in plan(got)
        want = exploded(df, pattern)
        assert {tuple(r) for r in got.collect()} == want
        sums = {r.term: (r.n, r.docs) for r in counting.totals(df, "id", F.col("t"), found, alone).collect()}
        assert sums == {x: (sum(n for _, y, n in want if y == x), sum(y == x for _, y, _ in want)) for _, x, _ in want}


def test_totals_are_given_back_in_parts(spark, monkeypatch):
    rows = [(i, f"w{i} w{i + 1} all") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    monkeypatch.setattr(counting, "TERMS", 5)
    got = {r.term: (r.n, r.docs) for r in counting.totals(df, "id", F.col("t"), Q._words, True).collect()}
    assert got["all"] == (40, 40) and got["w7"] == (2, 2) and got["w0"] == (1, 1) and len(got) == 42


def test_weights_need_no_shuffle(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = Q.weights(spark, SF)
    assert "Exchange" not in plan(got) and "Generate" not in plan(got)

    def plain(sf):
        names = D.vocabulary(Q.every_term(spark, sf), "doc_id", "term", STOPS, Q.LEAST_DOCS, Q.MOST_TERMS)
        return {(r.doc_id, r.term): r.w for r in D.tfidf(Q.every_term(spark, sf).join(names, "term"), "doc_id", "term", Q.docs(spark, sf)).collect()}

    assert {(r.doc_id, r.term): r.w for r in got.collect()} == pytest.approx(plain(SF))
    d.unionByName(d.where("doc_id < 20").withColumn("text", F.concat(F.lit("more words "), "text"))).write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.term): r.w for r in Q.weights(spark, str(tmp_path)).collect()} == pytest.approx(plain(str(tmp_path)))


def test_weights_of_a_year_meet_its_pairs(spark):
    rows = [(i, 1995 + i % 7, f"t{i % 5}", 0.1 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, year long, term string, w double")
    pairs = Q.W.sliding_pairs(df.select("id", "year"), "year", (1, 2))
    want = {tuple(r)[:2]: r.value for r in D.lexical_js(pairs, df.select("id", "term", "w"), "id", "term", 5).collect()}
    yearly = df.groupBy("year", "term").agg(F.sum("w").alias("w"))
    got = {tuple(r)[:2]: r.value for r in D.lexical_js(pairs, yearly, "id", "term", 5, by="year").collect()}
    assert len(got) > 3 and got == pytest.approx(want)


def test_terms_of_labels_are_counted(spark):
    df = spark.createDataFrame([(1, "b a b a b"), (2, "a")], "id long, t string")
    each = labels.terms(df, "id", F.col("t"), [], r"\w+")
    assert "Generate" not in plan(each) and {tuple(r) for r in each.collect()} == {(1, "b", 3), (1, "a", 2), (1, "b a", 2), (1, "a b", 2), (2, "a", 1)}


def test_words_of_languages_are_counted_where_texts_are_read(spark):
    assert "Exchange" not in plan(language.words(spark.createDataFrame([(1, "b a b")], "id long, t string"), "id", "t"))
