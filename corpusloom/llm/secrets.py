"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame operations alone.

Places come from cutting a text at a pattern: the lengths of the pieces and of the matches add up to each match's
first and last code point.

The battery looks at every run of 20 or more letters, digits and + / _ - = that no fixed pattern's span overlaps. Its encoding is inferred (hexadecimal,
base 32, base 64), its characters become values of that alphabet, and three statistics are taken:

* chi-squared against uniform use of the alphabet,
* the number of runs of values above and below the middle,
* the correlation of each value with the next.

A run in which the three, by Bonferroni's rule, reject a uniform source is no candidate. How likely an ordinary run is to look as random is told by three
p-values: of a chi-squared so small (non-central, since letters are used unevenly; it grows with the length), and of the other two so close to 0. What ordinary runs are like is
taken from the table's own, those in which chi-squared clearly rejects a uniform source, added to PRIOR runs of fixed values. The three are combined by Fisher's method, and in each band of
lengths the false discovery rate is held at 1 % by the step-up rule over all such runs of the table. P-values are counted
in bins, so the rule costs one small aggregation and no sort. Texts are read once; what is found in them is written and read again.

Defined cases: a null or empty text has no spans. Rows are independent but for the thresholds, to which repeated rows
count each time. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

#: The fixed patterns, by kind: the pattern, the group whose length counts, and its least length. The second and third
#: take only whole runs of their characters, which their least length then decides at once.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: The alphabets of the encodings in the order of their values, and the excess of ordinary words over uniform use of each.
ALPHABETS = {"hex": ("0123456789abcdef", 1.0), "b32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.2), "b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2)}
#: Below this p the battery rejects a uniform source; the false discovery rate; bins for each factor of ten of p; how many runs the fixed values count for, and their deviation.
REJECT, RATE, BINS, PRIOR, SPREAD = 1e-3, 0.01, 4, 50, 2.0
#: The most accepted runs that are broadcast.
MOST_RUNS = 200_000
# Chebyshev coefficients of the complementary error function, from the highest power down; the relative error is below 1.2e-7 everywhere.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_spans(df: DataFrame, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """df (text) with name: array of (kind, s, e, m), places and text of the pattern's matches whose group is long enough."""
    p, kind = _sql(pattern), f"'{name}'"
    df = df.withColumn("h", F.expr(f"regexp_extract_all(text, {p}, 0)"))
    none = "CAST(array() AS array<string>)"
    df = df.withColumn("p", F.expr(f"CASE WHEN size(h) > 0 THEN split(text, {p}, -1) ELSE {none} END"))
    df = df.withColumn("g", F.expr(f"CASE WHEN size(h) > 0 THEN regexp_extract_all(text, {p}, {group}) ELSE {none} END"))
    spans = f"""CASE WHEN size(h) = 0 THEN CAST(array() AS array<struct<kind: string, s: int, e: int, m: string>>) ELSE
        aggregate(sequence(1, size(h)), named_struct('at', 0, 'out', CAST(array() AS array<struct<kind: string, s: int, e: int, m: string>>)),
          (a, i) -> named_struct('at', a.at + length(p[i - 1]) + length(h[i - 1]), 'out', CASE WHEN length(g[i - 1]) < {least} THEN a.out ELSE
            concat(a.out, array(named_struct('kind', {kind}, 's', a.at + length(p[i - 1]), 'e', a.at + length(p[i - 1]) + length(h[i - 1]), 'm', h[i - 1]))) END),
          a -> a.out) END"""
    return df.withColumn(name, F.expr(spans)).drop("h", "p", "g")


def _lower(z: str) -> str:
    """The normal distribution function of an SQL expression, exact far into the lower tail."""
    series = f"aggregate(array({', '.join(f'{c}D' for c in ERFC)}), 0D, (a, c) -> c + a * t)"
    tail = f"transform(array(1 / (1 + abs(zz) / sqrt(8D))), t -> 0.5 * t * exp(-zz * zz / 2 + {series}))[0]"
    return f"transform(array(CAST({z} AS double)), zz -> CASE WHEN zz <= 0 THEN {tail} ELSE 1 - {tail} END)[0]"


def tested(runs: DataFrame) -> DataFrame:
    """runs (run) with encoding, n, z_uniform, z_runs, z_serial, excess (of chi-squared over that of a uniform source, a character), band (of lengths) and random: whether the battery
    leaves a uniform source possible."""
    one = lambda i: "CASE enc " + " ".join(f"WHEN '{k}' THEN {v[i] if i else _sql(v[0])}" for k, v in ALPHABETS.items()) + " END"
    df = runs.withColumn("enc", F.expr("CASE WHEN run RLIKE '^[0-9a-f]+$' OR run RLIKE '^[0-9A-F]+$' THEN 'hex' WHEN run RLIKE '^[A-Z2-7]+=*$' THEN 'b32' ELSE 'b64' END"))
    df = df.withColumn("bare", F.expr("CASE WHEN enc = 'hex' THEN lower(run) ELSE rtrim('=', translate(run, '-_', '+/')) END"))
    df = df.withColumn("alphabet", F.expr(one(0))).withColumn("excess", F.expr(one(1))).withColumn("k", F.expr("CAST(length(alphabet) AS double)"))
    df = df.withColumn("v", F.expr("transform(regexp_extract_all(bare, '.', 0), c -> CAST(instr(alphabet, c) - 1 AS double))")).withColumn("n", F.expr("CAST(greatest(1, size(v)) AS double)"))
    df = df.withColumn("u", F.expr("array_distinct(v)"))
    df = df.withColumn("sq", F.expr("aggregate(u, 0D, (a, x) -> a + pow(size(filter(v, y -> y = x)), 2))"))
    df = df.withColumn("chi", F.expr("k / n * sq - n"))
    df = df.withColumn("up", F.expr("CAST(size(filter(v, x -> x >= k / 2)) AS double)"))
    df = df.withColumn("r", F.expr("aggregate(sequence(2, greatest(2, size(v))), 1D, (a, i) -> a + CASE WHEN (get(v, i - 1) >= k / 2) <> (get(v, i - 2) >= k / 2) THEN 1 ELSE 0 END)"))
    df = df.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    df = df.withColumn("var", F.expr("aggregate(v, 0D, (a, x) -> a + pow(x - mean, 2))"))
    df = df.withColumn("co", F.expr("aggregate(sequence(2, greatest(2, size(v))), 0D, (a, i) -> a + coalesce((get(v, i - 1) - mean) * (get(v, i - 2) - mean), 0))"))
    df = df.withColumn("z_uniform", F.expr("(pow(greatest(chi, 0) / (k - 1), 1 / 3D) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))"))
    df = df.withColumn("rm", F.expr("2 * up * (n - up) / n + 1"))
    df = df.withColumn("z_runs", F.expr("CASE WHEN rm > 2 AND n > 1 THEN (r - rm) / sqrt((rm - 1) * (rm - 2) / (n - 1)) ELSE 99D END"))
    df = df.withColumn("z_serial", F.expr("CASE WHEN var > 0 THEN co / var * sqrt(n) ELSE 99D END"))
    df = df.withColumn("excess", F.expr("(chi - (k - 1)) / n"))
    df = df.withColumn("band", F.expr("least(8, CAST(floor(log2(n)) AS int))"))
    each = [_lower("(-z_uniform)"), f"(2 * {_lower('(-abs(z_runs))')})", f"(2 * {_lower('(-abs(z_serial))')})"]
    df = df.withColumn("random", F.expr(f"n >= 16 AND 3 * least({', '.join(each)}) >= {REJECT}D"))
    return df.select(*runs.columns, F.col("enc").alias("encoding"), "k", "n", "z_uniform", "z_runs", "z_serial", "excess", "band", "random")


#: Statistics whose distribution in ordinary runs is taken from the table.
OWN = ("z_runs", "z_serial")


def ordinary(results: DataFrame) -> dict[str, dict[str, tuple[float, float]]]:
    """Of each encoding (three) the mean excess of ordinary runs, and mean and deviation of the other statistics."""
    clear = results.where(F.expr(f"{_lower('(-z_uniform)')} < {REJECT}D AND n >= 16"))
    moments = [f(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col(c)))).alias(f"{c}_{n}") for c in (*OWN, "excess") for n, f in (("sum", F.sum), ("sq", lambda x: F.sum(x * x)))]
    seen = {r.encoding: r for r in clear.groupBy("encoding").agg(F.count("*").alias("n"), *moments).collect()}
    out = {}
    for name, (_, excess) in ALPHABETS.items():
        r = seen.get(name)
        n = PRIOR + (r.n if r else 0)
        own = {"excess": ((PRIOR * excess + (r.excess_sum if r else 0)) / n, 0.0)}
        for c in OWN:
            mean = (r[f"{c}_sum"] if r else 0.0) / n
            own[c] = mean, max(1.0, ((PRIOR * SPREAD**2 + (r[f"{c}_sq"] if r else 0.0)) / n - mean**2) ** 0.5)
        out[name] = own
    return out


def with_p(results: DataFrame, null: dict[str, dict[str, tuple[float, float]]]) -> DataFrame:
    """results with p: how likely an ordinary run is to look as random; null for what isn't a candidate."""
    of = lambda c, i: "CASE encoding " + " ".join(f"WHEN '{k}' THEN {v[c][i]!r}D" for k, v in null.items()) + " END"
    df = results.withColumn("usual", F.expr(of("excess", 0)))
    df = df.withColumn("z_word", F.expr("least(0D, (n * excess - n * usual) / sqrt(2 * (k - 1) + 4 * n * usual))"))
    for c in OWN:
        df = df.withColumn("m", F.expr(of(c, 0))).withColumn("d", F.expr(of(c, 1)))
        df = df.withColumn(f"hi_{c}", F.expr(f"(abs({c}) - m) / d")).withColumn(f"lo_{c}", F.expr(f"(-abs({c}) - m) / d"))
    df = df.withColumn("product", F.expr("greatest(1e-300D, least(1D, " + " * ".join([_lower("z_word"), *(f"greatest(1e-6D, {_lower(f'hi_{c}')} - {_lower(f'lo_{c}')})" for c in OWN)]) + "))"))
    fisher = "least(1D, product * (1 - ln(product) + pow(ln(product), 2) / 2))"
    return df.withColumn("p", F.expr(f"CASE WHEN random THEN greatest(1e-30D, {fisher}) END")).select(*results.columns, "p")


def thresholds(results: DataFrame) -> dict[int, float]:
    """The largest p of each band (at most nine) that the step-up rule accepts, from counts of p-values in bins."""
    bins = results.select("band", F.expr(f"CASE WHEN p IS NULL THEN 0 ELSE CAST(floor(-log10(p) * {BINS}) AS int) END").alias("bin")).groupBy("band", "bin").count().collect()
    out = {}
    for band in {r.band for r in bins}:
        mine = sorted(((r.bin, r["count"]) for r in bins if r.band == band), reverse=True)
        total, rank = sum(n for _, n in mine), 0
        for b, n in mine:  # all p-values of a bin count as its largest
            rank += n
            if b > 0 and 10 ** (-b / BINS) <= RATE * rank / total:
                out[band] = 10 ** (-b / BINS)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, s, e, m) by s and then kind, for every row of docs (doc_id, text).

    Kinds: assign, access and hex from the fixed patterns, random from the battery where no fixed pattern's span overlaps.
    s and e are code points, e exclusive; m is the matched text.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, (pattern, group, least) in BASE.items():
        df = _with_spans(df, kind, pattern, group, least)
    df = _with_spans(df, "random", RUN, 0, 20)
    df = df.select("doc_id", F.expr("concat(assign, access, hex)").alias("base"), "random")
    found = materialise(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.expr("filter(random, x -> NOT exists(base, y -> y.s < x.e AND x.s < y.e))").alias("random")))
    results = materialise(tested(found.select("row", F.explode("random").alias("x")).select("row", "x", F.col("x.m").alias("run"))))
    results = with_p(results, ordinary(results))
    limits = thresholds(results)
    if not limits:
        return found.select("doc_id", _ordered("base"))
    accepted = results.where(" OR ".join(f"(band = {b} AND p <= {p!r}D)" for b, p in sorted(limits.items())))
    more = materialise(accepted.groupBy("row").agg(F.collect_list("x").alias("more")))
    more = F.broadcast(more) if more.count() <= MOST_RUNS else more
    return found.join(more, "row", "left").select("doc_id", _ordered("concat(base, coalesce(more, filter(base, y -> false)))"))


def _ordered(name: str):
    order = "CASE x.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"
    return F.expr(f"transform(array_sort(transform({name}, x -> named_struct('s', x.s, 'k', {order}, 'x', x))), y -> y.x)").alias("spans")
