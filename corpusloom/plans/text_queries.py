"""Queries over the text and vector functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.operators import language
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import VECTORS, WORKS, vectors, works

C = F.col
_DOI = r"regexp_replace(trim(doi), '^(?i:https?://(dx\.)?doi\.org/|doi:\s*)', '')"
_TITLE = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_TOKENS = r"CASE WHEN trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END"


@query("fn_norm_doi", f"WITH {WORKS} SELECT doc_id, lower(trim({_DOI})) AS doi FROM works")
def fn_norm_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", T.norm_doi(C("doi")).alias("doi"))


@query("fn_clean_doi", rf"WITH {WORKS} SELECT doc_id, nullif(lower(regexp_extract(doi, '10\.[0-9]{{4,}}[^\s]*')), '') AS doi FROM works")
def fn_clean_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", T.find_doi(C("doi")).alias("doi"))


@query("fn_norm_title", f"WITH {WORKS} SELECT doc_id, {_TITLE.format('title')} AS title FROM works")
def fn_norm_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", T.norm_title(C("title")).alias("title"))


@query("fn_norm_near", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) AS key FROM documents")
def fn_norm_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_near(C("text"))).alias("key"))


@query(
    "fn_norm_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
          regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\n', ' '), '\s+', ' ', 'g'))) AS key
        FROM documents""",
)
def fn_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_text(C("text"))).alias("key"))


@query("fn_norm_text_whole")
def fn_norm_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fn_norm_text, with every entity and garbled characters repaired, over the pages' html and the documents' texts."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), C("doc_id").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), C("page_id").alias("id"), C("html").alias("text"))
    return d.unionByName(p).select("kind", "id", F.md5(T.norm_text_whole(C("text"))).alias("key"))


@query(
    "fn_norm_lang",
    """WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN upper(lang) WHEN 1 THEN concat(lang, '-XX') WHEN 2 THEN 'eng' WHEN 3 THEN ' German ' WHEN 4 THEN 'xx' ELSE concat(lang, '_CA') END AS l FROM documents),
       y AS (SELECT doc_id, lower(trim(split_part(translate(l, '_', '-'), '-', 1))) AS h FROM x)
       SELECT doc_id, CASE WHEN h IN ('en','fr','de','es') THEN h WHEN h = 'eng' THEN 'en' WHEN h = 'german' THEN 'de' END AS lang FROM y""",
)
def fn_norm_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 6 WHEN 0 THEN upper(lang) WHEN 1 THEN concat(lang, '-XX') WHEN 2 THEN 'eng' WHEN 3 THEN ' German ' WHEN 4 THEN 'xx' ELSE concat(lang, '_CA') END")
    return table(spark, sf_dir, "documents").select("doc_id", T.norm_language(raw).alias("lang"))


_VOTE = ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(repr(x) for x in w)}))) AS {k}" for k, w in T.VOTES.items())


@query(
    "fn_vote_lang",
    rf"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS t FROM documents), n AS (SELECT doc_id, {_VOTE} FROM t)
        SELECT doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr'
               WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS lang FROM n""",
)
def fn_vote_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.vote_language(C("text")).alias("lang"))


@query(
    "fn_detect_lang",
    r"""WITH d AS (SELECT doc_id, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS held_out, text FROM documents),
    n AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM d) GROUP BY ALL),
    k AS (SELECT lang, word, sum(n) AS n FROM n JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
    g AS (SELECT lang, gram, sum(n) AS c FROM (SELECT lang, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(concat('_', word, '_'), i, 3))) AS gram FROM k) GROUP BY ALL),
    t AS (SELECT lang, sum(c) AS t FROM g GROUP BY 1), v AS (SELECT DISTINCT gram FROM g), p AS (SELECT gram, lang, ln((coalesce(c, 0) + 0.5) / (t + 0.5 * ((SELECT count(*) FROM v) + 1))) AS lp FROM (SELECT * FROM v, t) LEFT JOIN g USING (lang, gram)),
    w AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(concat('_', word, '_'), i, 3))) AS gram FROM (SELECT DISTINCT word FROM n)), s AS (SELECT word, lang, sum(lp) AS s FROM w JOIN p USING (gram) GROUP BY ALL),
    b AS (SELECT doc_id, min((-x, lang))[2] AS detected FROM (SELECT doc_id, lang, round(sum(n * s), 4) AS x FROM n JOIN s USING (word) GROUP BY ALL) GROUP BY 1)
    SELECT doc_id, held_out, lang, detected FROM d LEFT JOIN b USING (doc_id)""",
)
def fn_detect_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by its trigrams, learned from the labelled ones that aren't held out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.substring(F.md5(C("doc_id").cast("string")), 1, 1).isin("0", "1", "2", "3").alias("held_out"))
    found = language.detect(d, "doc_id", "text", d.where("NOT held_out").select("doc_id", "lang"))
    return d.select("doc_id", "held_out", "lang").join(found, "doc_id")


@query("fn_inv_index", f"WITH {WORKS} SELECT doc_id, title FROM works WHERE title <> ''")
def fn_inv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles turned into maps of word to places, and back."""
    words = works(spark, sf_dir).where("title <> ''").select("doc_id", F.posexplode(F.split("title", " ")).alias("place", "word"))
    index = words.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places"))
    index = index.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("doc_id", T.from_inverted_index(C("index")).alias("title"))


@query(
    "fn_clean_abs",
    r"""WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
        SELECT page_id, CASE WHEN length(t) < 20 OR contains(lower(t), 'no abstract available') OR contains(lower(t), 'access to this document') THEN md5('') ELSE md5(t) END AS key FROM c""",
)
def fn_clean_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_abstract(C("html"))).alias("key"))


@query("fn_first_para", "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 50)[1] AS paragraph FROM documents")
def fn_first_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_paragraph(C("text")).alias("paragraph"))


@query("fn_token_count", f"SELECT doc_id, CAST({_TOKENS.format('text')} AS BIGINT) AS n FROM documents")
def fn_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(C("text")).alias("n"))


@query(
    "fn_abstract_status",
    f"""SELECT CASE WHEN trim(text) = '' THEN 'missing' WHEN doc_id % 17 = 0 THEN 'generated' WHEN {_TOKENS.format("text")} > 1000 THEN 'too_long' ELSE 'original' END AS status,
        count(*) AS n FROM documents GROUP BY 1""",
)
def fn_abstract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(T.abstract_status(C("text"), C("doc_id") % 17 == 0).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("fn_length_class", f"SELECT CASE WHEN trim(text) = '' THEN 'missing' WHEN {_TOKENS.format('text')} > 1000 THEN 'too_long' ELSE 'ok' END AS class, count(*) AS n FROM documents GROUP BY 1")
def fn_length_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(T.length_class(C("text")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


_PAIRS = "pairs AS (SELECT a.doc_id, a.title AS x, b.title AS y, a.author AS p, b.author AS q FROM works a JOIN works b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir)
    return w.select("doc_id", C("title").alias("x"), C("author").alias("p")).join(w.select((C("doc_id") - 1).alias("doc_id"), C("title").alias("y"), C("author").alias("q")), "doc_id")


@query("fn_sim_seq", f"WITH {WORKS}, {_PAIRS} SELECT doc_id, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS similarity FROM pairs WHERE x = regexp_replace(x, '[^\\x00-\\x7f]', '', 'g') AND y = regexp_replace(y, '[^\\x00-\\x7f]', '', 'g')")
def fn_sim_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ASCII titles: the oracle counts edits of bytes."""
    ascii_ = (F.octet_length("x") == F.length("x")) & (F.octet_length("y") == F.length("y"))
    return _pairs(spark, sf_dir).where(ascii_).select("doc_id", F.round(T.edit_similarity(C("x"), C("y")), 6).alias("similarity"))


@query("fn_token_sort", f"WITH {WORKS} SELECT doc_id, array_to_string(list_sort(string_split({_TITLE.format('title')}, ' ')), ' ') AS words FROM works")
def fn_token_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", T.token_sorted(C("title")).alias("words"))


@query("fn_author_tokens", rf"WITH {WORKS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(author), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2))), ' ') AS tokens FROM works WHERE author IS NOT NULL")
def fn_author_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where("author IS NOT NULL").select("doc_id", F.array_join(T.author_tokens(C("author")), " ").alias("tokens"))


@query("fn_same_author", f"WITH {WORKS}, {_PAIRS} SELECT doc_id, list_contains(string_split(lower(q), ' '), string_split(lower(p), ' ')[-1]) OR list_contains(string_split(lower(p), ' '), string_split(lower(q), ' ')[-1]) AS same FROM pairs")
def fn_same_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", T.same_author(C("p"), C("q")).alias("same"))


@query("fn_chunks", "SELECT doc_id, i AS chunk, md5(substr(text, 1 + 450 * i, 500)) AS key FROM (SELECT doc_id, text, unnest(range(0, CAST(1 + (greatest(1, length(text) - 50) - 1) // 450 AS BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def fn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(C("text"), 500, 50)).alias("chunk", "piece"))
    return each.select("doc_id", C("chunk").cast("long").alias("chunk"), F.md5("piece").alias("key"))


@query("fn_json_extract", "SELECT event_id, regexp_extract(concat('Answer: ', props, ' {\"z\": 1}'), '\\{[^{}]*\\}') AS object FROM events")
def fn_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.first_json(F.concat(F.lit("Answer: "), "props", F.lit(' {"z": 1}'))).alias("object"))


@query("fn_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_hash", "SELECT doc_id, substr(md5(text), 1, 8) AS short, substr(sha256(text), 1, 16) AS long, substr(sha256(concat(doc_id, '|', text)), 1, 12) AS keyed FROM documents")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("short"), sha(C("text"), 16).alias("long"), sha(F.concat("doc_id", F.lit("|"), "text"), 12).alias("keyed"))


@query("fn_slug", r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_\-]', '_', 'g') AS slug FROM pages")
def fn_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(C("url")).alias("slug"))


@query("fn_email", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def fn_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.is_email(C("text"))).select("doc_id")


@query("fn_clean_term", r"WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE length(term) >= 3 AND NOT regexp_matches(term, '[0-9]') AND term NOT IN ('the', 'and') GROUP BY 1")
def fn_clean_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("term"))
    return terms.where(T.clean_term(C("term"), ("the", "and"))).groupBy("term").agg(F.count("*").alias("n"))


@query("fn_word_stats", r"SELECT doc_id, length(text) - length(replace(text, '|', '')) AS bars, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS numbers, CAST(len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: x NOT IN ('1', '2'))) AS BIGINT) AS unknown_numbers FROM documents")
def fn_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks, numbers, and distinct numbers that aren't among known ones."""
    numbers = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    unknown = F.size(F.array_except(numbers, F.array(F.lit("1"), F.lit("2")))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("[|]")).cast("long").alias("bars"), F.size(numbers).cast("long").alias("numbers"), unknown.alias("unknown_numbers"))


@query("fn_title_overlap", f"WITH {WORKS}, {_PAIRS}, t AS (SELECT doc_id, {_TITLE.format('x')} AS x, {_TITLE.format('y')} AS y FROM pairs), s AS (SELECT doc_id, x, y, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM t) SELECT doc_id, x = y OR len(list_intersect(a, b)) / len(a) > 0.2 AS near FROM s")
def fn_title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", T.title_overlap(C("x"), C("y"), 0.2).alias("near"))


@query("fn_bib", f"WITH {WORKS} SELECT doc_id, translate(lower(title), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS folded, lower(string_split(author, ' ')[-1]) AS surname FROM works")
def fn_bib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", T.fold(C("title")).alias("folded"), F.lower(F.element_at(F.split("author", " "), -1)).alias("surname"))


@query(
    "fn_vector",
    f"""WITH {VECTORS}, p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])), 6) AS dot, round(list_cosine_similarity(x, y), 6) AS cosine, round(list_distance(x, y), 6) AS distance FROM p""",
)
def fn_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    p = v.select("vec_id", C("v").alias("x")).join(v.select((C("vec_id") - 1).alias("vec_id"), C("v").alias("y")), "vec_id")
    return p.select("vec_id", F.round(V.dot(C("x"), C("y")), 6).alias("dot"), F.round(V.cosine(C("x"), C("y")), 6).alias("cosine"), F.round(V.distance(C("x"), C("y")), 6).alias("distance"))
