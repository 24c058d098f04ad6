"""Queries over readers, parsers and sinks. Records of each format are made of the test tables and parsed again, so the oracle
states what the parser must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import quality_flags as Q
from corpusloom.operators.graph import spread
from corpusloom.plans.flag_queries import FLAGGED, flagged
from corpusloom.plans.registry import query
from corpusloom.plans.session import table
from corpusloom.plans.standins import EDGES, VECTORS, WORKS, edges, vectors, works
from corpusloom.sources import contracts, sinks
from corpusloom.sources import readers as R
from corpusloom.streaming import incremental

C = F.col


@query("src_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, nullif(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE concat(p_name, ', \"', p_brand, '\"') END, '') AS title FROM part")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of CSV with quotes and blanks, parsed by the reader's schema."""
    title = F.when(C("p_partkey") % 9 == 0, "").otherwise(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')))
    line = F.to_csv(F.struct("p_partkey", title.alias("title")), {"escape": '"'})
    got = table(spark, sf_dir, "part").select(F.from_csv(line, "id string, title string", {"escape": '"'}).alias("r")).select("r.*")
    return got.select("id", F.nullif("title", F.lit("")).alias("title"))


@query("src_concat", "SELECT c_name AS name, 'customer' AS source, c_acctbal AS balance, CAST(NULL AS BIGINT) AS size FROM customer UNION ALL SELECT p_name, 'part', NULL, p_size FROM part")
def src_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(C("c_name").alias("name"), F.lit("customer").alias("source"), C("c_acctbal").alias("balance"))
    p = table(spark, sf_dir, "part").select(C("p_name").alias("name"), F.lit("part").alias("source"), C("p_size").cast("long").alias("size"))
    return R.concat([c, p])


@query("src_works", f"WITH {WORKS} SELECT doc_id, title, year, cited FROM works")
def src_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("doc_id", "title", C("year").try_cast("long").alias("year"), "cited")


@query("src_citations", f"WITH {EDGES} SELECT src, ref, year FROM edges")
def src_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query("src_embeddings", f"WITH {VECTORS} SELECT vec_id, label, len(v) AS dims, round(v[1], 6) AS first FROM vectors")
def src_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.size("v").cast("long").alias("dims"), F.round(C("v")[0], 6).alias("first"))


@query("src_corpus", f"WITH {WORKS} SELECT doc_id, year, cited FROM works WHERE trim(title) <> '' AND year BETWEEN 1996 AND 2002 AND cited >= 10")
def src_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus(works(spark, sf_dir), 1996, 2002, 10).select("doc_id", "year", "cited")


@query("src_jsonl", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 0")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of JSON lines of which every tenth is broken; broken ones go."""
    line = F.when(C("event_id") % 10 == 0, "{broken").otherwise(C("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(line, "k bigint, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r._corrupt IS NULL").select("event_id", "r.k")


_JSON = """concat('{"id":"https://openalex.org/W', p_partkey, '","doi":"https://doi.org/10.1/P', p_partkey, '","title":"', p_name, '","publication_year":', 1990 + p_size, ',"cited_by_count":', p_size, ',"language":"eng","authorships":[{"author":{"display_name":"A ', p_size, '"},"institutions":[{"display_name":"Z"},{"display_name":"', p_type, '"}]},{"author":{"display_name":"B"},"institutions":[{"display_name":"Z"}]}],"concepts":[{"display_name":"top","level":0},{"display_name":"', p_brand, '","level":2},{"display_name":"deep","level":3}],"abstract_inverted_index":{"world":[1],"hello":[0,2]},"referenced_works":["https://openalex.org/W', p_size, '","https://openalex.org/W7"]}')"""


def _openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.from_json(F.expr(_JSON), R.OPENALEX).alias("r")).select("r.*")


@query("src_openalex", "SELECT concat('W', p_partkey) AS source_id, concat('10.1/p', p_partkey) AS doi, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, CAST(p_size AS INTEGER) AS cited, concat('A ', p_size) AS first_author, concat('A ', p_size, ' ; B') AS authors, CASE WHEN p_type < 'Z' THEN concat(p_type, ' ; Z') ELSE concat('Z ; ', p_type) END AS affiliations, concat('top ; ', p_brand) AS keywords, 'hello world hello' AS abstract, 'en' AS language FROM part")
def src_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _openalex(spark, sf_dir)
    return R.openalex_works(r.union(r))


@query("src_openalex_refs", "SELECT concat('W', p_partkey) AS source_id, unnest([concat('W', p_size), 'W7']) AS ref_id FROM part")
def src_openalex_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.openalex_refs(_openalex(spark, sf_dir))


_ISTEX = """concat('{"id":"I', p_partkey, '","doi":["10.2/X', p_partkey, '"],"title":"', p_name, '","publicationDate":"', 1990 + p_size, '-05","author":[{"name":"N ', p_size, '","affiliations":["Lab ', p_type, '","a', p_size, '@b.org"]},{"name":"M","affiliations":["Lab ', p_type, '"]}],"keywords":{"teeft":["one","two","three"]},"refBibs":[{"doi":"10.3/R', p_size, '","title":"T"},{"title":"U"}]}')"""


@query("src_istex", "SELECT concat('I', p_partkey) AS source_id, concat('10.2/x', p_partkey) AS doi, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, concat('N ', p_size, ' ; M') AS authors, concat('Lab ', p_type) AS affiliations, 'one ; two' AS keywords FROM part")
def src_istex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.istex_works(table(spark, sf_dir, "part").select(F.from_json(F.expr(_ISTEX), R.ISTEX).alias("r")).select("r.*"), 2)


@query("src_istex_refs", "SELECT concat('I', p_partkey) AS source_id, 0 AS place, concat('10.3/r', p_size) AS ref_doi, 'T' AS ref_title FROM part UNION ALL SELECT concat('I', p_partkey), 1, NULL, 'U' FROM part")
def src_istex_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.istex_refs(table(spark, sf_dir, "part").select(F.from_json(F.expr(_ISTEX), R.ISTEX).alias("r")).select("r.*"))


@query("src_ris", "SELECT p_name AS title, concat(p_brand, ' ; ', p_type) AS authors, CAST(1990 + p_size AS VARCHAR) AS year, concat('10.1/ab', p_partkey) AS doi, CASE WHEN p_size > 10 THEN 'An abstract.' END AS abstract, 'J' AS journal FROM part")
def src_ris(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = "concat('TY  - JOUR\\nTI  - ', p_name, '\\nAU  - ', p_brand, '\\nA1  - ', p_type, '\\nPY  - ', 1990 + p_size, '/01/02\\nDO  - https://doi.org/10.1/AB', p_partkey, CASE WHEN p_size > 10 THEN '\\nAB  - An abstract.' ELSE '' END, '\\nJO  - J\\n')"
    return table(spark, sf_dir, "part").select(R.parse_ris(F.expr(record)).alias("r")).select("r.*")


@query("src_bibtex", "SELECT 'article' AS kind, concat('k', p_partkey) AS key, concat('The ', p_name) AS title, p_brand AS author, CAST(1990 + p_size AS VARCHAR) AS year, concat('10.1/ab', p_partkey) AS doi FROM part UNION ALL SELECT 'book', concat('b', p_partkey), p_type, NULL, CAST(p_size AS VARCHAR), NULL FROM part")
def src_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('@Article{k', p_partkey, ',\\n  title = {The {', p_name, '}},\\n  author={', p_brand, '},\\n year = ', 1990 + p_size, ',\\n doi = \"10.1/AB', p_partkey, '\"\\n}\\n@book{b', p_partkey, ', title=\"', p_type, '\", year={', p_size, '}}')"
    return table(spark, sf_dir, "part").select(F.explode(R.entries(F.expr(text))).alias("e")).select(R.parse_bibtex(C("e")).alias("r")).select("r.*")


@query("src_scispace_csv", "SELECT p_name AS title, p_brand AS journal, CAST(p_size AS BIGINT) AS year FROM part")
def src_scispace_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's columns by our names."""
    return table(spark, sf_dir, "part").withColumnsRenamed({"p_name": "title", "p_brand": "journal"}).select("title", "journal", C("p_size").cast("long").alias("year"))


@query("src_yaml_seed", "SELECT 'Second' AS title, CAST(2001 AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS note UNION ALL SELECT 'Third', 2005, 'kept'")
def src_yaml_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seed(spark, [{"title": "First", "year": 1980}, {"title": "Second", "year": 2001}, {"title": "Third", "year": "2005", "note": "kept"}, {"title": "Fourth", "year": "n.d."}], 1990, 2010).select("title", "year", "note")


@query("src_wb_meta", "SELECT p_partkey, concat(p_brand, ' ; ', p_type) AS author, p_name AS title FROM part")
def src_wb_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes: every second record is a list of keys and values."""
    listed = """concat('[{"key":"author","value":"', p_brand, '"},{"key":"author","value":"', p_type, '"},{"key":"title","value":"', p_name, '"}]')"""
    mapped = """concat('{"author":["', p_brand, '","', p_type, '"],"title":["', p_name, '"]}')"""
    m = R.world_bank_metadata(F.expr(f"CASE WHEN p_partkey % 2 = 0 THEN {listed} ELSE {mapped} END"))
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", C("m")["author"].alias("author"), C("m")["title"].alias("title"))


@query("src_tei", "SELECT p_partkey, CASE WHEN p_size > 20 THEN p_name ELSE p_brand END AS title, 'Sur' AS author, CAST(1990 + p_size AS VARCHAR) AS year, CASE WHEN p_size > 20 THEN p_brand END AS journal, concat('10.1/t', p_partkey) AS doi FROM part")
def src_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = "concat('<biblStruct>', CASE WHEN p_size > 20 THEN concat('<analytic><title>', p_name, '</title></analytic>') ELSE '' END, '<monogr><author><surname>Sur</surname></author><title>', p_brand, '</title><imprint><date when=\"', 1990 + p_size, '-01\"/></imprint></monogr><idno type=\"DOI\">10.1/T', p_partkey, '</idno></biblStruct>')"
    part = spread(table(spark, sf_dir, "part"), "p_partkey")  # a file of few bytes is one task, and a record costs a millisecond
    return part.select("p_partkey", R.parse_tei(F.expr(xml)).alias("r")).select("p_partkey", "r.*")


@query("src_teaching", "WITH r AS (SELECT c_nationkey, concat('10.4/', c_custkey % 200) AS k, min(c_name) OVER (PARTITION BY c_custkey % 200) AS x FROM customer) SELECT k AS key, string_agg(DISTINCT concat('U', c_nationkey), ' ; ' ORDER BY concat('U', c_nationkey)) AS institutions, count(DISTINCT c_nationkey) AS n FROM r GROUP BY k")
def src_teaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("U"), "c_nationkey").alias("institution")).agg(F.collect_list(F.struct(F.concat(F.lit("10.4/"), C("c_custkey") % 200).alias("doi"), C("c_name").alias("title"))).alias("readings"))
    return R.teaching(r).select("key", "institutions", "n")


@query("src_crossref", "SELECT concat('10.1/p', p_partkey) AS source, concat('10.1/r', p_size) AS ref_doi, 'A title' AS ref_title, CAST(1990 + p_size AS INTEGER) AS ref_year FROM part WHERE p_size > 5 UNION ALL SELECT concat('10.1/p', p_partkey), NULL, p_name, NULL FROM part WHERE p_size > 5 UNION ALL SELECT concat('10.1/p', p_partkey), '__NO_REFS__', NULL, NULL FROM part WHERE p_size <= 5")
def src_crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = """concat('{"DOI":"10.1/P', p_partkey, '"', CASE WHEN p_size > 5 THEN concat(',"reference":[{"DOI":"10.1/R', p_size, '","article-title":"A title","year":"', 1990 + p_size, '"},{"article-title":"","unstructured":"', p_name, '","year":"n.d."}]') ELSE '' END, '}')"""
    return R.crossref_refs(table(spark, sf_dir, "part").select(F.from_json(F.expr(item), R.CROSSREF).alias("r")).select("r.*")).select("source", "ref_doi", "ref_title", "ref_year")


@query("src_smoke", "WITH r AS (SELECT doc_id, cited >= 80 AS core, row_number() OVER (PARTITION BY cited >= 80 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM (SELECT doc_id, doc_id % 90 AS cited FROM documents)) SELECT doc_id, core FROM r WHERE r <= CASE WHEN core THEN 20 ELSE 80 END")
def src_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.smoke_sample(works(spark, sf_dir).select("doc_id", "cited"), "doc_id", C("cited") >= 80, 20, 80).select("doc_id", "core")


@query("snk_deposit", f"WITH {FLAGGED} SELECT doc_id AS id, nullif(concat_ws('; ', CASE WHEN f1 THEN 'missing metadata' END, CASE WHEN f2 THEN 'no abstract' END, CASE WHEN f3 THEN 'noise' END), '') AS flag_reason, f1 OR f2 OR f3 AS flagged FROM flagged")
def snk_deposit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged(spark, sf_dir).select("doc_id", "f1", "f2", "f3")
    return sinks.deposit(f, {"f1": "missing metadata", "f2": "no abstract", "f3": "noise"}, {"doc_id": "id"})


@query("snk_report", "SELECT concat('{\"records\":', count(*), ',\"long\":', count(*) FILTER (WHERE n_chars > 2000), '}') AS report FROM documents")
def snk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(table(spark, sf_dir, "documents"), records=F.count("*"), long=F.count_if(C("n_chars") > 2000))


@query("snk_pool", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def snk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pool that has every third record still lacks."""
    e = table(spark, sf_dir, "events").select("event_id")
    return sinks.new_only(e, e.where("event_id % 3 = 0"), "event_id")


@query("contract_violations", f"WITH {WORKS} SELECT 'null author' AS rule, count(*) FILTER (WHERE author IS NULL) AS n FROM works UNION ALL SELECT 'check cited', count(*) FILTER (WHERE cited > 80) FROM works UNION ALL SELECT 'unique doi', count(doi) - count(DISTINCT doi) FROM works HAVING count(doi) > count(DISTINCT doi)")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contracts.Contract("doc_id bigint, author string", ("doc_id", "author"), ("doi",), {"cited": "cited <= 80"}, strict=False)
    return contracts.violations(works(spark, sf_dir), c)


@query("stream_daily", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the event stream, drained from the files at hand. An extension: the batch pipeline has no streams."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    e = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"daily_{uuid.uuid4().hex}"
    stream = stream.withColumn("ts", C("ts").cast("timestamp"))
    return incremental.drain(spark, incremental.daily(stream, "ts", "1 day", "event_type"), name, f"{folder}/{name}")


@query("flt_gate", "SELECT 'f9' AS missing")
def flt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that a policy asks for and the table lacks."""
    f = flagged(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in ("f1", "f3", "f9") if c not in f.columns], "missing string")


@query("src_crossfill_period", f"WITH {WORKS} SELECT CASE WHEN year BETWEEN 1995 AND 1999 THEN '1995-1999' WHEN year BETWEEN 2000 AND 2004 THEN '2000-2004' END AS period, lang, count(*) AS n FROM works WHERE trim(title) <> '' AND year BETWEEN 1995 AND 2004 GROUP BY 1, 2")
def src_crossfill_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = R.corpus(works(spark, sf_dir), 1995, 2004)
    return w.groupBy(Q.period(C("year"), (2000,), 1995, 2004).alias("period"), "lang").agg(F.count("*").alias("n"))
