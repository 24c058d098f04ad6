"""Readers of catalog, record and reference formats. Parsing is by native expressions, so files split across the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Catalogs as strings with quoted line breaks, blanks as null, and source from each file's name."""
    df = spark.read.csv(list(paths), schema=strings(columns), header=True, multiLine=True, escape='"')
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(_works)?\.csv", 1)
    return df.select(*(X.blank_to_null(F.col(c)).alias(c) for c in columns), name.alias("source"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON, compressed or not; lines that aren't JSON go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def corpus(works: DataFrame, first: int, last: int, cited: int | None = None) -> DataFrame:
    """Works with a title in a range of years, and cited often enough if asked."""
    df = works.where((F.trim("title") != "") & F.col("year").between(first, last))
    return df if cited is None else df.where(F.col("cited") >= cited)


def parse_ris(record: Column) -> Column:
    """One RIS record as a struct: the first title, year, DOI and abstract, and all authors joined."""
    tag = lambda t: X.blank_to_null(F.trim(F.regexp_extract(record, rf"(?m)^(?:{t})  - *(.*)$", 1)))
    authors = F.transform(F.regexp_extract_all(record, F.lit(r"(?m)^(?:AU|A1)  - *(.*)$"), F.lit(1)), lambda a: F.trim(a))
    return F.struct(tag("TI|T1").alias("title"), F.array_join(authors, " ; ").alias("authors"), F.substring(tag("PY|Y1"), 1, 4).alias("year"), X.norm_doi(tag("DO")).alias("doi"), tag("AB|N2").alias("abstract"), tag("JO|T2|JF").alias("journal"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    records = spark.read.text(path, lineSep="ER  -").where(F.col("value").rlike("(?m)^TY  -"))
    return records.select(parse_ris(F.col("value")).alias("r")).select("r.*")


def parse_bibtex(entry: Column) -> Column:
    """One BibTeX entry as a struct of kind, key, title, author, year and doi; braces or quotes around values, one level of braces within."""
    field = lambda n: X.blank_to_null(F.regexp_replace(F.regexp_extract(entry, rf'(?is)\b{n}\s*=\s*(?:\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}|"([^"]*)"|([0-9]+))', 1), r"[{}]|\s+(?=\s)", ""))
    bare = lambda n: F.coalesce(field(n), X.blank_to_null(F.regexp_extract(entry, rf'(?is)\b{n}\s*=\s*"([^"]*)"', 1)), X.blank_to_null(F.regexp_extract(entry, rf"(?is)\b{n}\s*=\s*([0-9]+)", 1)))
    return F.struct(F.lower(F.regexp_extract(entry, r"@(\w+)\s*\{\s*([^,\s]+)", 1)).alias("kind"), F.regexp_extract(entry, r"@(\w+)\s*\{\s*([^,\s]+)", 2).alias("key"), bare("title").alias("title"), bare("author").alias("author"), bare("year").alias("year"), X.norm_doi(bare("doi")).alias("doi"))


def entries(text: Column) -> Column:
    """The BibTeX entries of a text."""
    return F.filter(F.split(text, r"\n(?=@)"), lambda e: e.rlike(r"^\s*@\w+\s*\{"))


OPENALEX = (
    "id string, doi string, title string, publication_year int, cited_by_count int, language string, authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string>>>>, "
    "concepts array<struct<display_name: string, level: int>>, abstract_inverted_index map<string, array<int>>, referenced_works array<string>"
)


def openalex_works(records: DataFrame, deepest: int = 2) -> DataFrame:
    """Nested records as works, one row an id: authors and distinct sorted affiliations joined, concepts down to a level, abstracts put together."""
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["display_name"])))))
    concepts = F.transform(F.filter("concepts", lambda c: c["level"] <= deepest), lambda c: c["display_name"])
    out = records.select(
        F.regexp_replace("id", "^https://openalex.org/", "").alias("source_id"), X.norm_doi(F.col("doi")).alias("doi"), "title", F.col("publication_year").alias("year"), F.col("cited_by_count").alias("cited"),
        F.get(names, 0).alias("first_author"), F.array_join(names, " ; ").alias("authors"), F.array_join(places, " ; ").alias("affiliations"), F.array_join(concepts, " ; ").alias("keywords"),
        X.from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"), X.norm_language(F.col("language")).alias("language"),
    )
    return out.groupBy("source_id").agg(F.min(F.struct(*[c for c in out.columns if c != "source_id"])).alias("r")).select("source_id", "r.*")


def openalex_refs(records: DataFrame) -> DataFrame:
    """An edge for each work that a record refers to."""
    short = lambda c: F.regexp_replace(c, "^https://openalex.org/", "")
    return records.select(short(F.col("id")).alias("source_id"), F.explode("referenced_works").alias("r")).select("source_id", short(F.col("r")).alias("ref_id"))


ISTEX = "id string, doi array<string>, title string, publicationDate string, author array<struct<name: string, affiliations: array<string>>>, keywords struct<teeft: array<string>>, refBibs array<struct<doi: string, title: string>>"


def istex_works(records: DataFrame, most: int = 20) -> DataFrame:
    """Nested records as works: affiliations that look like mail addresses go, the first keywords stay, distinct ones in order."""
    affiliations = F.array_distinct(F.filter(F.flatten(F.transform("author", lambda a: a["affiliations"])), lambda x: ~X.is_email(x)))
    return records.select(
        F.col("id").alias("source_id"), X.norm_doi(F.get("doi", 0)).alias("doi"), "title", F.substring("publicationDate", 1, 4).try_cast("int").alias("year"),
        F.array_join(F.transform("author", lambda a: a["name"]), " ; ").alias("authors"), F.array_join(affiliations, " ; ").alias("affiliations"), F.array_join(F.slice("keywords.teeft", 1, most), " ; ").alias("keywords"),
    )


def istex_refs(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").alias("source_id"), F.posexplode("refBibs").alias("place", "r")).select("source_id", "place", X.norm_doi(F.col("r.doi")).alias("ref_doi"), F.col("r.title").alias("ref_title"))


CROSSREF = "DOI string, reference array<struct<DOI: string, `article-title`: string, `volume-title`: string, unstructured: string, year: string, author: string>>"


def crossref_refs(items: DataFrame) -> DataFrame:
    """An edge for each reference, its title by a chain of fallbacks; a sentinel row for items without any."""
    doi = X.norm_doi(F.col("DOI"))
    each = items.where("size(reference) > 0").select(doi.alias("source"), F.explode("reference").alias("r"))
    title = F.coalesce(*(X.blank_to_null(F.col(f"r.`{c}`")) for c in ("article-title", "volume-title", "unstructured")))
    refs = each.select("source", X.norm_doi(F.col("r.DOI")).alias("ref_doi"), title.alias("ref_title"), F.col("r.author").alias("ref_author"), F.col("r.year").try_cast("int").alias("ref_year"))
    none = items.where("coalesce(size(reference), 0) <= 0").select(doi.alias("source"), F.lit("__NO_REFS__").alias("ref_doi"))
    return refs.unionByName(none, allowMissingColumns=True)


def parse_tei(xml: Column) -> Column:
    """A TEI citation: title of the article or else of the volume, first surname, year and journal."""
    x = lambda p: X.blank_to_null(F.xpath_string(xml, F.lit(p)))
    return F.struct(F.coalesce(x("//analytic/title"), x("//monogr/title")).alias("title"), x("(//surname)[1]").alias("author"), F.substring(x("//date/@when"), 1, 4).alias("year"), F.when(x("//analytic/title").isNotNull(), x("//monogr/title")).alias("journal"), X.norm_doi(x("//idno[@type='DOI']")).alias("doi"))


def world_bank_metadata(json: Column) -> Column:
    """Metadata in either of two shapes, a map of lists or a list of key and value, as a map of joined values."""
    lists = F.from_json(json, "map<string, array<string>>")
    pairs = F.from_json(json, "array<struct<key: string, value: string>>")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    joined = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]), " ; ")))
    return F.when(F.ltrim(json).startswith("["), joined).otherwise(F.transform_values(lists, lambda _, v: F.array_join(v, " ; ")))


def seed(spark: SparkSession, rows: Sequence[dict], first: int, last: int) -> DataFrame:
    """Curated entries (title, year, and more) within bounds of years, as a table."""
    names = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in rows], strings(names))
    return df.withColumn("year", F.col("year").try_cast("int")).where(F.col("year").between(first, last))


def teaching(readings: DataFrame) -> DataFrame:
    """Courses (institution, readings: array of doi and title) as one row a reading, the first seen by identifier or else title, with its institutions."""
    r = readings.select("institution", F.posexplode("readings").alias("place", "r")).select("institution", "place", "r.doi", "r.title")
    key = F.coalesce(X.blank_to_null(F.col("doi")), X.norm_title(F.col("title")))
    g = r.groupBy(key.alias("key")).agg(F.min_by("title", F.struct("institution", "place")).alias("title"), F.array_join(F.array_sort(F.collect_set("institution")), " ; ").alias("institutions"), F.count_distinct("institution").alias("n"))
    return g


def smoke_sample(works: DataFrame, key: str, core: Column, n_core: int, n_rest: int) -> DataFrame:
    """So many core rows and so many others, drawn by a hash of the key."""
    from corpusloom.operators.windows import top_per_group

    w = works.withColumn("core", F.coalesce(core, F.lit(False)))
    ranked = top_per_group(w, max(n_core, n_rest), [F.md5(F.col(key).cast("string")), F.col(key)], "core")
    return ranked.where(F.when(F.col("core"), F.col("place") <= n_core).otherwise(F.col("place") <= n_rest)).drop("place")


def manifest(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """input: the paths that a stage of a pipeline file (YAML: stages, each with deps as a list) reads, in no order."""
    text = spark.read.text(path, wholetext=True).select("value")
    name = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in stage)
    block = F.regexp_extract("value", rf"(?m)^  {name}:[ \t]*\n((?:^(?:    .*|[ \t]*)\n?)*)", 1)
    deps = F.regexp_extract(block, r"(?m)^    deps:[ \t]*\n((?:^ {4,}- .*\n?)*)", 1)
    each = F.explode(F.regexp_extract_all(deps, F.lit(r"(?m)^ +- +(.*?)[ \t:]*$"), F.lit(1)))
    return text.select(each.alias("input")).select(F.regexp_replace("input", "^[\"']|[\"']$", "").alias("input"))
