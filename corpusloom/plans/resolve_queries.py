"""Queries over joins, linkage, deduplication and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import resolve as R
from corpusloom.operators import similar as S
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import EDGES, RECORDS, VECTORS, WORKS, edges, records, vectors, works

C = F.col


def _rank() -> Column:
    """Source order, then id: a total order."""
    return F.struct("rank", "id")


_NORM = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("ded_priority", f"WITH {RECORDS} SELECT doi, arg_min(author, rank * 1000000 + id) FILTER (WHERE trim(author) <> '') AS author, arg_min(title, rank * 1000000 + id) FILTER (WHERE trim(title) <> '') AS title, arg_min(year, rank * 1000000 + id) FILTER (WHERE year IS NOT NULL) AS year, max(cited) AS cited, max(from_a) AS from_a, CAST(max(from_b) AS INTEGER) AS from_b, count(*) AS n FROM records WHERE doi IS NOT NULL GROUP BY doi")
def ded_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where("doi IS NOT NULL")
    return R.merge_by_priority(r, ["doi"], _rank(), ["author", "title", "year"], ["cited", "from_a", "from_b"])


_TWO = f"{RECORDS}, k AS (SELECT *, CASE WHEN doi IS NOT NULL THEN concat('d:', doi) WHEN {_NORM} <> '' THEN concat('t:', {_NORM}, '|', coalesce(substr(CAST(year AS VARCHAR), 1, 4), '')) END AS merge_key FROM records), m AS (SELECT merge_key, arg_min(author, rank * 1000000 + id) FILTER (WHERE trim(author) <> '') AS author, max(cited) AS cited, max(from_a) AS from_a, CAST(max(from_b) AS INTEGER) AS from_b, count(*) AS n, CASE WHEN starts_with(merge_key, 'd:') THEN 'doi' ELSE 'title' END AS pass FROM k WHERE merge_key IS NOT NULL GROUP BY merge_key)"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.two_pass(records(spark, sf_dir), "doi", "title", "year", _rank(), ["author"], ["cited", "from_a", "from_b"])


@query("ded_two_pass", f'WITH {_TWO} SELECT * REPLACE (md5(merge_key) AS merge_key) FROM m')
def ded_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).withColumn("merge_key", F.md5("merge_key"))


@query("ded_merge", f"WITH {_TWO} SELECT pass, count(*) AS kept, CAST(sum(n) AS BIGINT) AS merged, CAST(sum(from_a + from_b) AS BIGINT) AS sources FROM m GROUP BY pass")
def ded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the merge: rows kept and merged by pass, and sources flagged."""
    return _two(spark, sf_dir).groupBy("pass").agg(F.count("*").alias("kept"), F.sum("n").alias("merged"), F.sum(C("from_a") + C("from_b")).alias("sources"))


@query("ded_keepmax", f"WITH {RECORDS} SELECT id, doi IS NOT NULL AND row_number() OVER (PARTITION BY doi ORDER BY cited DESC, id) > 1 AS deduped FROM records")
def ded_keepmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_most_cited(records(spark, sf_dir), "doi", "cited", "id").select("id", "deduped")


@query("ded_placeholder", f"WITH {RECORDS}, g AS (SELECT doi FROM records WHERE rank = 1 AND doi IS NOT NULL GROUP BY doi HAVING count(*) > 1) SELECT id, CASE WHEN rank = 1 AND doi IN (SELECT doi FROM g) THEN NULL ELSE doi END AS doi FROM records")
def ded_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.clear_placeholders(records(spark, sf_dir), "doi", C("rank") == 1).select("id", "doi")


_CIT = """c AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS o, l_orderkey % 500 AS source, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 200 END AS ref_id, CASE WHEN l_suppkey % 10 = 0 THEN '__NO_REFS__' WHEN l_partkey % 4 <> 0 THEN concat('10.1/', l_partkey % 300) END AS ref_doi,
  CASE WHEN l_suppkey % 7 <> 0 THEN concat('t', l_suppkey) END AS title, CASE WHEN l_suppkey % 7 <> 0 THEN concat('a', l_suppkey % 9) END AS author, CASE WHEN l_suppkey % 7 <> 0 THEN l_linenumber % 4 END AS year FROM lineitem)"""


@query(
    "ded_citations",
    f"""WITH {_CIT}, d AS (SELECT * FROM c),
        a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, ref_id ORDER BY o) AS r FROM d WHERE ref_doi IS DISTINCT FROM '__NO_REFS__') WHERE ref_id IS NULL OR r = 1),
        b AS (SELECT *, row_number() OVER (PARTITION BY source, ref_doi ORDER BY o) AS rd, row_number() OVER (PARTITION BY source, ref_doi IS NULL, title, author, year ORDER BY o) AS rt FROM a)
        SELECT o, source, ref_id, ref_doi FROM b WHERE CASE WHEN ref_doi IS NOT NULL THEN rd = 1 WHEN title IS NULL AND author IS NULL AND year IS NULL THEN TRUE ELSE rt = 1 END""",
)
def ded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = "CASE WHEN l_suppkey % 7 <> 0 THEN"
    e = table(spark, sf_dir, "lineitem").selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS o", "l_orderkey % 500 AS source", "CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 200 END AS ref_id",
        "CASE WHEN l_suppkey % 10 = 0 THEN '__NO_REFS__' WHEN l_partkey % 4 <> 0 THEN concat('10.1/', l_partkey % 300) END AS ref_doi",
        f"{known} concat('t', l_suppkey) END AS title", f"{known} concat('a', l_suppkey % 9) END AS author", f"{known} l_linenumber % 4 END AS year",
    )
    return R.dedup_citations(e, "o").select("o", "source", "ref_id", "ref_doi")


@query("ded_title", f"WITH {RECORDS} SELECT min(id) AS id FROM records WHERE {_NORM} <> '' GROUP BY {_NORM}")
def ded_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.norm_title(C("title"))
    return records(spark, sf_dir).where(key != "").groupBy(key.alias("k")).agg(F.min("id").alias("id")).select("id")


_CC = "r(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)"


@query(
    "ded_near",
    rf"""WITH RECURSIVE {RECORDS}, n AS (SELECT doc_id AS id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 200) AS k1 FROM documents),
        k AS (SELECT id, concat('0:', k1) AS g FROM n WHERE k1 <> '' UNION ALL SELECT id, concat('1:', {_NORM}) FROM records WHERE {_NORM} <> ''),
        b AS (SELECT g, min(id) AS m FROM k GROUP BY g HAVING count(*) >= 5), e AS (SELECT DISTINCT m AS a, id AS b FROM k JOIN b USING (g)),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), {_CC}, c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a),
        z AS (SELECT component, count(*) AS size FROM c GROUP BY 1), w AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS "group" FROM z)
        SELECT id, "group", size FROM c JOIN w USING (component)""",
)
def ded_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), F.substring(T.norm_near(C("text")), 1, 200).alias("k1"))
    df = records(spark, sf_dir).select("id", T.norm_title(C("title")).alias("k2")).join(body, "id")
    return R.near_groups(df, "id", [C("k1"), C("k2")], 5)


@query("ded_fuzzy_group")
def ded_fuzzy_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works without identifier whose titles are alike, merged: the longest title, and the union of what the rows list."""
    w = works(spark, sf_dir).where("doi IS NULL")
    w = w.select(C("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.expr("concat('course ', doc_id % 7, '; course ', doc_id % 11)").alias("courses"), C("source").alias("institutions"), C("lang").alias("countries"))
    groups = S.title_groups(w.select("id", S.sorted_words(C("title")).alias("s")))
    return S.merge_groups(w, groups, "title", ["courses", "institutions", "countries"])


@query("ded_courses", "WITH e AS (SELECT DISTINCT concat(o_orderpriority, '/', o_orderstatus) AS c, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT c, count(*) AS n FROM e GROUP BY c), b AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM e x JOIN e y ON x.i = y.i AND x.c < y.c GROUP BY 1, 2) SELECT a, b, b.n, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS canonical FROM b JOIN n p ON p.c = a JOIN n q ON q.c = b WHERE b.n >= 10 AND b.n / least(p.n, q.n) > 0.8")
def ded_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).join(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS src", "concat(o_orderpriority, '/', o_orderstatus) AS c"), "src").selectExpr("c", "ref AS i")
    return R.overlapping_sets(e, "c", "i", 10, 0.8)


@query("ded_fp", f"WITH {RECORDS}, w AS (SELECT *, list_distinct(string_split({_NORM}, ' ')) AS w FROM records WHERE doi IS NOT NULL), p AS (SELECT x.doi, min(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))) AS least FROM w x JOIN w y ON x.doi = y.doi AND x.id < y.id GROUP BY 1), n AS (SELECT doi, count(*) AS n, count(DISTINCT author) > 1 AS authors_differ, count(*) FILTER (WHERE year IS NULL) AS no_year FROM w GROUP BY 1 HAVING count(*) > 1) SELECT doi, n, authors_differ, no_year, round(least, 6) AS least_similar FROM n JOIN p USING (doi)")
def ded_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.divergent_groups(records(spark, sf_dir), "doi", "id", F.array_distinct(F.split(T.norm_title(C("title")), " ")), "author", "year")
    return out.withColumn("least_similar", F.round("least_similar", 6))


@query("ded_dropdup", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def ded_dropdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()


@query("set_union", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM customer UNION ALL SELECT 's' FROM supplier) GROUP BY 1")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = (table(spark, sf_dir, t).select(F.lit(t[0]).alias("kind")) for t in ("customer", "supplier"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"))


@query("set_diff", f"WITH {EDGES} SELECT ref FROM edges EXCEPT SELECT src FROM edges WHERE year > 1998")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select("ref").subtract(e.where("year > 1998").select("src"))


@query("set_inter", f"WITH {EDGES} SELECT ref FROM edges INTERSECT SELECT src FROM edges WHERE year > 1998")
def set_inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select("ref").intersect(e.where("year > 1998").select("src"))


@query("set_jaccard", f"WITH {WORKS}, w AS (SELECT doc_id, list_distinct(string_split({_NORM}, ' ')) AS w FROM works) SELECT x.doc_id, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM w x JOIN w y ON y.doc_id = x.doc_id + 1")
def set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir).select("doc_id", F.array_distinct(F.split(T.norm_title(C("title")), " ")).alias("x"))
    p = w.join(w.select((C("doc_id") - 1).alias("doc_id"), C("x").alias("y")), "doc_id")
    return p.select("doc_id", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("jn_inner", "SELECT c_mktsegment AS cluster, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def jn_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("cluster"))
    return table(spark, sf_dir, "orders").select("o_custkey", C("o_orderstatus").alias("status")).join(c, "o_custkey").groupBy("cluster", "status").agg(F.count("*").alias("n"))


@query("jn_left_multi", "WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) < 2000 GROUP BY 1, 2), b AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, count(*) AS big FROM orders WHERE o_totalprice > 490000 AND o_orderstatus <> 'P' GROUP BY 1, 2) SELECT year, status, n, urgent, big FROM y LEFT JOIN s USING (year, status) LEFT JOIN b USING (year, status)")
def jn_left_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), C("o_orderstatus").alias("status"), "o_orderpriority", "o_totalprice")
    count = lambda df, name: df.groupBy("year", "status").agg(F.count("*").alias(name))
    urgent = count(o.where("o_orderpriority = '1-URGENT' AND year < 2000"), "urgent")
    return count(o, "n").join(urgent, ["year", "status"], "left").join(count(o.where("o_totalprice > 490000 AND status <> 'P'"), "big"), ["year", "status"], "left")


@query("jn_semi", f"WITH {EDGES} SELECT src, ref FROM edges WHERE src IN (SELECT c_custkey FROM customer) AND ref IN (SELECT c_custkey FROM customer)")
def jn_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    e = edges(spark, sf_dir)
    return e.join(keys.toDF("src"), "src", "left_semi").join(keys.toDF("ref"), "ref", "left_semi").select("src", "ref")


@query("jn_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jn_lookup", f"WITH {RECORDS}, l AS (SELECT title, arg_max(doi, id) AS doi FROM records WHERE title <> '' AND doi IS NOT NULL GROUP BY title) SELECT r.id, l.doi AS linked FROM records r LEFT JOIN l USING (title)")
def jn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map whose last entry for a key wins, as a join on a table of one row a key."""
    r = records(spark, sf_dir)
    lookup = r.where("title <> '' AND doi IS NOT NULL").groupBy("title").agg(F.max_by("doi", "id").alias("linked"))
    return r.join(lookup, "title", "left").select("id", "linked")


@query("jn_cache_fill", f"WITH {RECORDS}, a AS (SELECT id, min(concat('A', id % 50)) AS v FROM records WHERE id % 6 = 0 GROUP BY id), b AS (SELECT doi, min(concat('B', id % 40)) AS v FROM records WHERE doi IS NOT NULL AND id % 7 = 0 GROUP BY doi) SELECT r.id, coalesce(nullif(trim(r.author), ''), a.v, b.v) AS author, CASE WHEN trim(r.author) <> '' THEN 'original' WHEN a.v IS NOT NULL THEN 'a' WHEN b.v IS NOT NULL THEN 'b' END AS author_from FROM records r LEFT JOIN a USING (id) LEFT JOIN b ON r.doi = b.doi")
def jn_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    a, b = r.where("id % 6 = 0").selectExpr("id", "concat('A', id % 50) AS v"), r.where("doi IS NOT NULL AND id % 7 = 0").selectExpr("doi", "concat('B', id % 40) AS v")
    return R.fill(r, "author", [("a", a, "id", "v"), ("b", b, "doi", "v")]).select("id", "author", "author_from")


@query("jn_crossfill", f"WITH {RECORDS}, l AS (SELECT doi, arg_max(title, length(title) * 1000000 - id) AS t FROM records WHERE doi IS NOT NULL AND trim(title) <> '' GROUP BY doi) SELECT id, coalesce(CASE WHEN trim(title) <> '' THEN title END, t) AS title FROM records LEFT JOIN l USING (doi)")
def jn_crossfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crossfill(records(spark, sf_dir), "doi", "title", "id").select("id", "title")


@query("jn_fuzzy")
def jn_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each work whose id is divisible by 50 the other work, within a year, whose sorted title words are most alike, at 85 % or more."""
    d = works(spark, sf_dir).select(C("doc_id").alias("id"), T.token_sorted(C("title")).alias("s"), (1995 + C("doc_id") % 2).alias("year"))
    return S.link_titles(d.where("id % 50 = 0"), d)


@query("jn_nn", f"WITH {VECTORS}, d AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) AS d FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM d) SELECT vec_id AS id, round(avg(d), 6) AS distance FROM r WHERE n <= 5 GROUP BY 1")
def jn_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(C("vec_id").alias("id"), "v")
    return R.nearest(v.where("id % 50 = 0"), v, 5).withColumn("distance", F.round("distance", 6))


@query("jn_pair_self", f"WITH {RECORDS}, w AS (SELECT id, list_filter(list_distinct(string_split({_NORM}, ' ')), lambda x: x <> '') AS w FROM records) SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM w x JOIN w y ON x.id < y.id WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.7")
def jn_pair_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.similar_pairs(records(spark, sf_dir), "id", F.split(T.norm_title(C("title")), " "), 0.7).withColumn("jaccard", F.round("jaccard", 6))


@query("jn_community_cluster", f"WITH {EDGES} SELECT p_brand AS community, c_mktsegment AS cluster, count(DISTINCT src) AS citers FROM edges JOIN part ON ref = p_partkey JOIN orders ON src = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def jn_community_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(C("p_partkey").alias("ref"), C("p_brand").alias("community"))
    orders = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("src"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("cluster"))
    each = edges(spark, sf_dir).join(part, "ref").join(orders, "src").join(customer, "o_custkey")
    return each.groupBy("community", "cluster").agg(F.count_distinct("src").alias("citers"))


@query("jn_meta_priority", f"WITH {EDGES}, m AS (SELECT p_partkey AS ref, p_name AS title, 0 AS rank, 0 AS o FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT ref, concat('cited in ', year), 1, src FROM edges) SELECT ref, arg_min(title, rank * 1000000000 + o) AS title FROM m GROUP BY ref")
def jn_meta_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS ref", "p_name AS title", "0 AS rank", "0L AS o")
    seen = edges(spark, sf_dir).selectExpr("ref", "concat('cited in ', year) AS title", "1 AS rank", "src AS o")
    return own.unionByName(seen).groupBy("ref").agg(F.min_by("title", F.struct("rank", "o")).alias("title"))


@query("jn_cross_terms", "WITH t AS (SELECT unnest(['hand', 'eau', 'ung', 'ción']) AS term) SELECT term, count(*) FILTER (WHERE contains(text, term)) AS n FROM documents, t GROUP BY 1")
def jn_cross_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of terms against every text, each text read once."""
    terms = ("hand", "eau", "ung", "ción")
    counts = table(spark, sf_dir, "documents").agg(*(F.count_if(F.contains("text", F.lit(t))).alias(f"n{i}") for i, t in enumerate(terms)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), C(f"n{i}").alias("n")) for i, t in enumerate(terms)))).alias("x")).select("x.*")


@query("jn_outer_concat", "WITH a AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) < 1999 GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS m FROM orders WHERE o_orderstatus = 'O' AND year(o_orderdate) > 1996 GROUP BY 1) SELECT coalesce(a.year, b.year) AS year, coalesce(n, 0) AS f, coalesce(m, 0) AS o FROM a FULL JOIN b ON a.year = b.year")
def jn_outer_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus")
    a = y.where("o_orderstatus = 'F' AND year < 1999").groupBy("year").agg(F.count("*").alias("f"))
    b = y.where("o_orderstatus = 'O' AND year > 1996").groupBy("year").agg(F.count("*").alias("o"))
    return a.join(b, "year", "full").fillna(0, ["f", "o"])


@query("jn_witness", f"WITH {EDGES}, t AS (SELECT ref FROM edges GROUP BY ref ORDER BY count(*) DESC, ref LIMIT 20) SELECT a.ref AS a, b.ref AS b, count(*) AS n, string_agg(CAST(a.src AS VARCHAR), ';' ORDER BY a.src) AS witnesses FROM edges a JOIN edges b ON a.src = b.src AND a.ref < b.ref WHERE a.ref IN (SELECT ref FROM t) AND b.ref IN (SELECT ref FROM t) GROUP BY 1, 2")
def jn_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).select("src", "ref")
    top = e.groupBy("ref").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ref").limit(20).select("ref")
    e = e.join(F.broadcast(top), "ref", "left_semi")
    pairs = e.select("src", C("ref").alias("a")).join(e.select("src", C("ref").alias("b")), "src").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ";").alias("witnesses"))
