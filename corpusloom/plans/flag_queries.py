"""Queries over flags, protection, policy and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import quality_flags as Q
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import EDGES, VECTORS, WORKS, edges, vectors, works

C = F.col
SAFE, NOISE, EXACT = ("the ", "und "), ("thth", "erer", "||"), ("the.", "was.")
GROUPS = {"a": ("the", "that"), "b": ("les", "des"), "c": ("und", "der"), "d": ("for", "with")}
TAXONOMY = {"articles": ("the ", " a ", " le "), "joins": ("and ", " et ", " und ", " y "), "places": (" in ", " of ", " de "), "verbs": (" is ", " was ", " est ")}

_safe = "(" + " OR ".join(f"contains(lower(title), '{s}')" for s in SAFE) + ")"
_noise = "(" + " OR ".join(f"contains(lower(title), '{s}')" for s in NOISE) + ")"
_exact = "lower(title) IN (" + ", ".join(f"'{x}'" for x in EXACT) + ")"
_missing = f"(trim(title) = '' OR ((author IS NULL OR year IS NULL) AND NOT {_safe}))"
_short = f"(length(trim(abstract)) <= 50 AND NOT {_safe})"
_black = f"(({_noise} AND NOT {_safe}) OR {_exact})"
#: works with the flags that need no other table.
FLAGGED = f"{WORKS}, flagged AS (SELECT *, {_missing} AS f1, {_short} AS f2, {_black} AS f3 FROM works)"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).withColumns({"f1": Q.missing_metadata(C("title"), C("author"), C("year"), SAFE), "f2": Q.no_abstract(C("abstract"), C("title"), SAFE), "f3": Q.blacklisted(C("title"), NOISE, SAFE, EXACT)})


@query("flt_missing_meta", f"WITH {FLAGGED} SELECT doc_id FROM flagged WHERE f1")
def flt_missing_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).where("f1").select("doc_id")


@query("flt_no_abstract", f"WITH {FLAGGED} SELECT doc_id FROM flagged WHERE f2")
def flt_no_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).where("f2").select("doc_id")


@query("flt_blacklist", f"WITH {FLAGGED} SELECT doc_id FROM flagged WHERE f3")
def flt_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).where("f3").select("doc_id")


@query("flt_cit_isolated", f"WITH {EDGES} SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) <= 1998 AND NOT EXISTS (SELECT 1 FROM edges WHERE src = o_orderkey) AND NOT EXISTS (SELECT 1 FROM edges WHERE ref = o_orderkey)")
def flt_cit_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return Q.isolated(w, edges(spark, sf_dir), "id", 1998)


@query(
    "flt_sem_outlier",
    f"""WITH {VECTORS}, u AS (SELECT unnest(range(1, 65)) AS i), m AS (SELECT i, avg(v[i]) AS m FROM vectors, u GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM m),
        d AS (SELECT vec_id, 1 - list_cosine_similarity(v, c) AS d FROM vectors, c), l AS (SELECT avg(d) + 2 * stddev_pop(d) AS l FROM d)
        SELECT vec_id, round(d, 6) AS distance, d > l AS outlier FROM d, l""",
)
def flt_sem_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.semantic_outliers(vectors(spark, sf_dir), "vec_id", "v").withColumn("distance", F.round("distance", 6))


_count = " + ".join(f"CAST(list_has_any(w, [{', '.join(repr(x) for x in v)}]) AS BIGINT)" for v in GROUPS.values())


@query("flt_concepts", f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM documents) SELECT doc_id, {_count} AS n_groups FROM w WHERE {_count} >= 2")
def flt_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", Q.concept_groups(C("text"), GROUPS).alias("n_groups")).where("n_groups >= 2")


@query("flt_llm", f"WITH {FLAGGED}, w AS (SELECT *, regexp_extract_all(lower(title), '[a-z]{{3,}}') AS w FROM flagged), t AS (SELECT * REPLACE (regexp_extract_all(lower(abstract), '[a-z]{{3,}}') AS w), {_count} AS n FROM w) SELECT doc_id FROM t WHERE trim(abstract) <> '' AND n < 2 AND {_count} < 2 AND NOT (f1 OR f2 OR f3)")
def flt_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a relevance model; the model itself is not part of this environment."""
    f = flagged(spark, sf_dir)
    return f.where(Q.relevance_candidates(C("abstract"), C("title"), GROUPS, C("f1") | C("f2") | C("f3"))).select("doc_id")


#: Reasons of protection and the policy built on the flags.
JUDGED = f"""{FLAGGED}, {EDGES}, p AS (SELECT *, concat_ws('; ', CASE WHEN cited >= 80 THEN 'cited' END, CASE WHEN source_count >= 3 THEN 'sources' END,
  CASE WHEN doc_id IN (SELECT ref FROM edges) AND doc_id % 4 = 0 THEN 'cited_in_corpus' END, CASE WHEN source = 'src1' THEN 'curated' END) AS reasons FROM flagged),
  judged AS (SELECT *, CASE WHEN year < 1996 THEN 'remove' WHEN (f1 OR f2 OR f3) AND reasons = '' THEN 'remove' ELSE 'keep' END AS action FROM p)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = edges(spark, sf_dir).select(C("ref").alias("doc_id")).distinct().withColumn("in_corpus", F.lit(True))
    f = flagged(spark, sf_dir).join(cited, "doc_id", "left")
    reasons = Q.protection(cited=C("cited") >= 80, sources=C("source_count") >= 3, cited_in_corpus=C("in_corpus") & (C("doc_id") % 4 == 0), curated=C("source") == "src1")
    f = f.withColumn("reasons", reasons)
    return f.withColumn("action", Q.policy(C("f1") | C("f2") | C("f3"), C("reasons") != "", C("year"), 1996))


@query("flt_protect", f"WITH {JUDGED} SELECT doc_id, reasons FROM judged WHERE reasons <> ''")
def flt_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).where("reasons <> ''").select("doc_id", "reasons")


@query("flt_policy", f"WITH {JUDGED} SELECT doc_id, action FROM judged")
def flt_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", "action")


@query("flt_extend", f"WITH {JUDGED} SELECT doc_id, title, CASE action WHEN 'remove' THEN 'would_remove' ELSE action END AS action FROM judged")
def flt_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", "title", F.when(C("action") == "remove", "would_remove").otherwise(C("action")).alias("action"))


_DETAIL = "concat_ws(',', CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN author IS NULL THEN 'author' END, CASE WHEN year IS NULL THEN 'year' END)"


@query("flt_flagstring", f"WITH {FLAGGED} SELECT doc_id, concat_ws('|', CASE WHEN f1 THEN concat('missing_metadata:', {_DETAIL}) END, CASE WHEN f2 THEN 'no_abstract' END, CASE WHEN f3 THEN 'title_blacklist' END, CASE WHEN cited > 85 THEN concat('share:', printf('%.3f', cited / 90)) END) AS flags FROM flagged")
def flt_flagstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.concat_ws(",", F.when(F.trim("title") == "", "title"), F.when(C("author").isNull(), "author"), F.when(C("year").isNull(), "year"))
    share = F.format_string("%.3f", C("cited") / F.lit(90.0))
    flags = Q.flag_string(missing_metadata=(C("f1"), detail), no_abstract=(C("f2"), None), title_blacklist=(C("f3"), None), share=(C("cited") > 85, share))
    return flagged(spark, sf_dir).select("doc_id", flags.alias("flags"))


@query("agg_flagcounts", f"WITH {FLAGGED}, s AS (SELECT concat_ws('|', CASE WHEN f1 THEN concat('missing_metadata:', {_DETAIL}) END, CASE WHEN f2 THEN 'no_abstract' END, CASE WHEN f3 THEN 'title_blacklist' END) AS flags FROM flagged), e AS (SELECT unnest(string_split(flags, '|')) AS f FROM s) SELECT split_part(trim(f), ':', 1) AS flag, count(*) AS n FROM e WHERE f <> '' GROUP BY 1")
def agg_flagcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.concat_ws(",", F.when(F.trim("title") == "", "title"), F.when(C("author").isNull(), "author"), F.when(C("year").isNull(), "year"))
    flags = Q.flag_string(missing_metadata=(C("f1"), detail), no_abstract=(C("f2"), None), title_blacklist=(C("f3"), None))
    each = flagged(spark, sf_dir).select(F.explode(F.split(flags, "[|]")).alias("f")).where("f <> ''")
    return each.groupBy(F.split_part(F.trim("f"), F.lit(":"), F.lit(1)).alias("flag")).agg(F.count("*").alias("n"))


@query("flt_verify_blacklist", f"WITH {FLAGGED}, t AS (SELECT unnest([{', '.join(repr(x) for x in NOISE)}, 'qqqq']) AS term) SELECT term, count(*) FILTER (WHERE contains(lower(title), term)) AS matches, count(*) FILTER (WHERE contains(lower(title), term) AND f3) AS flagged, count(*) FILTER (WHERE contains(lower(title), term) AND NOT f3) AS missed FROM t, flagged GROUP BY term")
def flt_verify_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.verify_terms(flagged(spark, sf_dir), "title", "f3", (*NOISE, "qqqq"))


SOUTH = ("src1", "src7")


@query("flt_near_gs", "SELECT doc_id, contains(source, 'src1') OR contains(source, 'src7') AS south, lang <> 'en' AS other_language FROM documents")
def flt_near_gs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.any_of(C("source"), SOUTH).alias("south"), (C("lang") != "en").alias("other_language"))


@query("flt_quadrant", "SELECT CASE WHEN source <> 'src0' THEN concat(CASE WHEN lang = 'en' THEN 'EN' ELSE 'nonEN' END, '-', CASE WHEN contains(source, 'src1') OR contains(source, 'src7') THEN 'S' ELSE 'N' END) END AS quadrant, count(*) AS n FROM documents GROUP BY 1")
def flt_quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Q.quadrant(C("lang"), T.any_of(C("source"), SOUTH), C("source") != "src0")
    return table(spark, sf_dir, "documents").groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"))


@query("flt_theme", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\bthnd[a-z]*\b') OR regexp_matches(lower(text), 'queeau$') OR ((contains(lower(text), 'hand') OR contains(lower(text), 'que')) AND (contains(lower(text), 'ttion') OR contains(lower(text), 'eau')))")
def flt_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(Q.theme(C("text"), [r"\bthnd[a-z]*\b", r"queeau\z"], ("hand", "que"), ("ttion", "eau"))).select("doc_id")


@query("flt_institution", "SELECT CASE WHEN contains(lower(title), 'erer') THEN 'exclude' WHEN contains(lower(title), 'the ') OR contains(lower(title), 'de ') THEN 'allow' ELSE 'unknown' END AS verdict, count(*) AS n FROM (SELECT string_split(text, chr(10))[1] AS title FROM documents) GROUP BY 1")
def flt_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).groupBy(Q.institution(C("title"), ("the ", "de "), ("erer",)).alias("verdict")).agg(F.count("*").alias("n"))


_NORM = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("flt_subtopic", f"WITH {WORKS}, h AS (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY cited DESC, doc_id) AS r FROM works WHERE regexp_matches(title, '^The') OR regexp_matches(title, 'eau') OR regexp_matches(title, '[0-9]')) SELECT doc_id, cited FROM h WHERE r = 1")
def flt_subtopic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.subtopic(works(spark, sf_dir), "title", "cited", "doc_id", ("^The", "eau", "[0-9]"))


_scores = ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in terms) + f") AS s{i}" for i, terms in enumerate(TAXONOMY.values()))
_named = ", ".join(f"(-s{i}, {i}, '{k}')" for i, k in enumerate(TAXONOMY))


@query(
    "flt_topic",
    f"""WITH s AS (SELECT doc_id, {_scores} FROM documents), e AS (SELECT doc_id, unnest([{', '.join(f"{{'s': s{i}, 'i': {i}, 'name': '{k}'}}" for i, k in enumerate(TAXONOMY))}]) AS t FROM s),
        r AS (SELECT doc_id, t.s AS s, t.name AS name, row_number() OVER (PARTITION BY doc_id ORDER BY t.s DESC, t.i) AS r FROM e),
        p AS (SELECT a.doc_id, a.s AS s1, a.name AS n1, b.s AS s2, b.name AS n2 FROM r a JOIN r b USING (doc_id) WHERE a.r = 1 AND b.r = 2)
        SELECT doc_id, CASE WHEN s1 > 0 THEN n1 END AS topic, CASE WHEN s1 > 0 AND s2 >= 2 AND s1 - s2 <= 1 THEN n2 END AS second FROM p""",
)
def flt_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Q.topics(C("text"), TAXONOMY)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.topic", "t.second")


@query("flt_doctype", f"WITH {WORKS} SELECT doc_id, CASE WHEN source = 'src2' THEN 'report' WHEN starts_with(doi, 'https://doi.org/10.1000/') THEN 'preprint' WHEN contains(lower(title), 'ting') THEN 'chapter' WHEN doi IS NULL THEN 'other' ELSE 'article' END AS type FROM works")
def flt_doctype(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(C("source") == "src2", "report"), (C("doi").startswith("https://doi.org/10.1000/"), "preprint"), (F.contains(F.lower("title"), F.lit("ting")), "chapter"), (C("doi").isNull(), "other")]
    return works(spark, sf_dir).select("doc_id", Q.cascade(rules, "article").alias("type"))


@query("flt_venue", "SELECT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'Brand one and two' WHEN p_brand LIKE 'Brand#1%' THEN 'Brand teens' ELSE p_brand END AS venue, CASE WHEN p_type = 'ECONOMY' THEN 'journal' WHEN p_type = 'SMALL' THEN 'series' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def flt_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    venue = F.when(C("p_brand").isin("Brand#1", "Brand#2"), "Brand one and two").when(C("p_brand").startswith("Brand#1"), "Brand teens").otherwise(C("p_brand"))
    kind = Q.cascade([(C("p_type") == "ECONOMY", "journal"), (C("p_type") == "SMALL", "series")], "other")
    return table(spark, sf_dir, "part").groupBy(venue.alias("venue"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("flt_boilerplate", f"WITH {WORKS} SELECT doc_id FROM works WHERE abstract = title OR starts_with(lower(abstract), 'the and') OR length(trim(abstract)) < 60")
def flt_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).where((C("abstract") == C("title")) | F.lower("abstract").startswith("the and") | (F.length(F.trim("abstract")) < 60)).select("doc_id")


POLES = (("hand", "thing", "there"), ("eau", "que ", "ment"))


@query("flt_pole", "SELECT doc_id, " + ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in p) + f") >= 2 AS {n}" for n, p in zip(("first", "second"), POLES, strict=True)) + " FROM documents")
def flt_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *((T.hits(F.lower("text"), p) >= 2).alias(n) for n, p in zip(("first", "second"), POLES, strict=True)))


@query("flt_finance_journal", "SELECT p_partkey FROM part WHERE lower(trim(p_name)) IN ('red widget', 'blue bolt')")
def flt_finance_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower(F.trim("p_name")).isin("red widget", "blue bolt")).select("p_partkey")


@query("flt_cf_regex", rf"WITH {WORKS} SELECT doc_id FROM works WHERE regexp_matches(lower(title), '\bof[\s-]?the\b') OR regexp_matches(lower(abstract), '\bof[\s-]?the\b')")
def flt_cf_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = r"\bof[\s-]?the\b"
    return works(spark, sf_dir).where(F.lower("title").rlike(p) | F.lower("abstract").rlike(p)).select("doc_id")


@query("flt_lang_fix", "SELECT doc_id, CASE WHEN lang2 IS NULL THEN lang WHEN lang2 <> lang AND n_chars >= 100 THEN lang ELSE lang2 END AS language FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'fr' ELSE lang END AS lang2 FROM documents)")
def flt_lang_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded language, filled from a detected one, and overruled by it on texts long enough."""
    recorded = F.when(C("doc_id") % 3 == 1, F.lit("fr")).when(C("doc_id") % 3 == 2, C("lang"))
    said = F.when(recorded.isNull() | ((recorded != C("lang")) & (C("n_chars") >= 100)), C("lang")).otherwise(recorded)
    return table(spark, sf_dir, "documents").select("doc_id", said.alias("language"))


@query("prj_period", f"WITH {WORKS} SELECT CASE WHEN year BETWEEN 1995 AND 1997 THEN '1995-1997' WHEN year BETWEEN 1998 AND 2000 THEN '1998-2000' WHEN year BETWEEN 2001 AND 2003 THEN '2001-2003' END AS period, count(*) AS n FROM works GROUP BY 1")
def prj_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).groupBy(Q.period(C("year"), (1998, 2001), 1995, 2003).alias("period")).agg(F.count("*").alias("n"))


@query("prj_in_v1", f"WITH {WORKS} SELECT doc_id AS id, coalesce(doi IN (SELECT doi FROM works WHERE doc_id % 3 = 0), FALSE) OR (doi IS NULL AND doc_id IN (SELECT doc_id FROM works WHERE doc_id % 2 = 0)) AS in_snapshot FROM works")
def prj_in_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir).select("doi", C("doc_id").alias("id"))
    old = Q.in_snapshot(w, w.where("id % 3 = 0 AND doi IS NOT NULL").select("doi"), w.where("id % 2 = 0").select("id"))
    return old.select("id", "in_snapshot")
