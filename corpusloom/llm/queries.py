"""One query for each operator, over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, exact_dedup, html_extract, line_dedup, lm, minhash, neighbours, periodic, quality, secrets, spelling, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; of each the largest doc_id stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a word model and under the n-gram trie."""
    return lm.train_and_score(_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, places and a digest of the secrets in every document."""
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    n = [F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in secrets.BASE]
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    base = F.sha2(F.expr(joined.format("filter(spans, x -> x.kind <> 'random')")), 256).alias("base_sha256")
    return out.select("doc_id", *n, base, F.expr(joined.format("spans")).alias("spans"))


#: Host, path and verdict of each rule.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, and the digest of what stays."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every document."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels that aren't held out."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", "n_near")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent words of the documents, their near words and the forms they are variants of."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of each vector whose id divides by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), 20, 20)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document."""
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_score": op2_lm_score,
    "op3_minhash": op3_minhash,
    "op4_secrets": op4_secrets,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_html_extract": op8_html_extract,
    "op9_quality": op9_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling": op11_spelling,
    "op12_neighbours": op12_neighbours,
    "op13_periodic_runs": op13_periodic_runs,
}

#: A-Z lower-cased, in DuckDB.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A word of the decontamination query.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWERED} AS t FROM documents)""",
    "op6_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        f AS (SELECT k.doc_id, i, line, r.key IS NOT NULL AND k.doc_id < keep_id AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op10_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
        t AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
              FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t))),
        h AS (SELECT doc_id, item, n, i FROM x JOIN t USING (n, s)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY 1),
        m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1),
        p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM d), f AS (SELECT term, count(*) AS f FROM p GROUP BY 1),
        v AS (SELECT item, s, x.term, min(x.i) AS i, any_value(f) AS f FROM (SELECT DISTINCT item, s, unnest(string_split(s, ' ')) AS term, generate_subscripts(string_split(s, ' '), 1) AS i FROM t) x JOIN f USING (term) GROUP BY 1, 2, 3),
        o AS (SELECT item, s, term, row_number() OVER (PARTITION BY item, s ORDER BY f, i) AS k FROM v),
        y AS (SELECT DISTINCT a.item, a.term AS ta, b.term AS tb FROM o a JOIN o b USING (item, s) WHERE a.k = 1 AND b.k = 2),
        q AS (SELECT DISTINCT x.doc_id, ta, tb FROM (SELECT DISTINCT ta, tb FROM y) JOIN p x ON x.term = ta JOIN p z ON z.term = tb AND z.doc_id = x.doc_id AND abs(z.i - x.i) <= 20),
        g AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM q JOIN y USING (ta, tb) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op11_spelling": r"""
        WITH c AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(i))),
        b AS (SELECT chr(i::INTEGER) AS x, CASE WHEN i < 128 THEN [i] ELSE [192 + i // 64, 128 + i % 64] END AS u FROM range(1, 256) r(i)),
        r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        d AS (SELECT doc_id, run, count(*) AS m FROM r GROUP BY 1, 2),
        k AS (SELECT doc_id, run, m, list_transform(range(length(hex(encode(concat(doc_id, ':', run)))) // 2), lambda i: CAST(concat('0x', substr(hex(encode(concat(doc_id, ':', run))), 2 * i + 1, 2)) AS BIGINT)) AS u FROM d),
        h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295, u), lambda a, y: xor(t[xor(a % 256, y) + 1], a // 256)), 4294967295) AS h FROM k, c),
        s AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, m FROM h),
        v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM s GROUP BY 1 HAVING length(word) >= 6 AND sum(m) >= 5),
        g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        x AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS w FROM g),
        p AS (SELECT DISTINCT * FROM (
          SELECT x.word, x.n, y.word AS other, y.n AS m FROM x JOIN x y USING (i, w) WHERE x.word <> y.word
          UNION ALL SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON x.w = v.word
          UNION ALL SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON x.w = v.word)),
        q AS (SELECT word, n, count(*) AS n_near, min((-m, other)) AS best FROM p GROUP BY 1, 2),
        f AS (SELECT word, n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM q),
        z AS (SELECT * FROM (WITH RECURSIVE z(word, root, i) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT z.word, f.form, i + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL) SELECT word, max_by(root, i) AS root FROM z GROUP BY 1))
        SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN f USING (word) LEFT JOIN z USING (word)""",
}
