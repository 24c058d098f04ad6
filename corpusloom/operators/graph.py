"""Graph operators on edge tables. Iterations write their tables to the checkpoint folder, so lineage stays short and no executor's loss
undoes more than one step."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import vector as V


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in one process, a temporary one, and on a cluster that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='corpusloom-')}")
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as a table and read again: for loops of many rounds, in which checkpoints hand on ever more constraints of columns to the optimizer."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session's shuffles have: for groups of few bytes and much work, which adaptive execution would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def symmetric(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct (a, b) in both directions, without loops."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    return e.union(e.select("b", "a")).distinct()


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs a < b."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node within reach, of edges (a, b): labels pass along edges and jump to their label's label."""
    e = written(symmetric(edges))
    labels = written(e.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = e.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        far = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        step = written(step.join(far, F.col("c") == F.col("to")).select("node", F.least("c", "far").alias("component"), "old"))
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def cocitation(edges: DataFrame, least: int, multiple: bool = False) -> DataFrame:
    """a < b and n, the citing documents (src) that share both refs; with multiple, each repetition of an edge counts."""
    e = edges.select("src", "ref") if multiple else edges.select("src", "ref").distinct()
    if least > 1:  # a ref in fewer edges is in no pair that counts
        known = e.groupBy("ref").agg(F.count("*").alias("k"))
        e = e.join(known.where(F.col("k") >= least).select("ref"), "ref", "left_semi")
    pairs = e.select("src", F.col("ref").alias("a")).join(e.select("src", F.col("ref").alias("b")), "src").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def coupling(edges: DataFrame, least: int) -> DataFrame:
    """a < b and n, the refs that two sources share."""
    return cocitation(edges.select(F.col("ref").alias("src"), F.col("src").alias("ref")), least)


def coupling_jaccard(edges: DataFrame, least: int) -> DataFrame:
    """coupling with distance: one less shared refs over all refs of either."""
    size = edges.select("src", "ref").distinct().groupBy("src").agg(F.count("*").alias("d"))
    c = coupling(edges, least)
    c = c.join(size.toDF("a", "da"), "a").join(size.toDF("b", "db"), "b")
    return c.select("a", "b", "n", (1 - F.col("n") / (F.col("da") + F.col("db") - F.col("n"))).alias("distance"))


def degrees(edges: DataFrame, a: str = "src", b: str = "ref") -> DataFrame:
    """node, n_out and n_in of distinct edges: one aggregation of both ends."""
    e = edges.select(a, b).distinct()
    ends = e.select(F.col(a).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(b, F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def pagerank(edges: DataFrame, steps: int, alpha: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """node and rank after so many steps over distinct edges (src, ref); the rank of nodes without refs is spread over all.

    Sources that nothing cites all have one rank, and what nodes without refs lose is known from the others: so only nodes that cite and are cited move from step to step, and the
    last step alone passes all edges. tolerance: fewer steps once the ranks of all nodes that cite together move by less than it times the number of all nodes."""
    e = written(edges.select("src", "ref").where("src <> ref").distinct())
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("d"), F.lit(0).alias("cited")).union(e.select("ref", F.lit(0), F.lit(1)))
    nodes = written(ends.groupBy("node").agg(F.sum("d").alias("d"), F.max("cited").alias("cited")))
    n, alone = nodes.agg(F.count("*"), F.count_if(F.col("cited") == 0)).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    e = written(e.join(nodes.where("d > 0").withColumnRenamed("node", "src"), "src"))
    given = written(e.where("cited = 0").groupBy(F.col("ref").alias("node")).agg(F.sum(1 / F.col("d")).alias("given")))
    core = nodes.where("d > 0 AND cited = 1").select("node", "d").join(given, "node", "left")
    rank = written(core.select("node", "d", F.coalesce("given", F.lit(0.0)).alias("given"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved")))
    within = written(e.where("cited = 1").join(rank.select(F.col("node").alias("ref")), "ref", "left_semi").select("src", "ref"))

    def sent(links: DataFrame) -> DataFrame:
        return links.select("src", "ref").join(rank.select(F.col("node").alias("src"), (F.col("rank") / F.col("d")).alias("got")), "src").select(F.col("ref").alias("node"), "got")

    same, step = 1.0 / n, 1  # the rank of a source that nothing cites
    while True:
        held, moved = rank.agg(F.coalesce(F.sum("rank"), F.lit(0.0)), F.coalesce(F.sum("moved"), F.lit(0.0))).first()
        before, same = same, (1 - alpha * (held + alone * same)) / n
        if step == steps or (step > 1 and tolerance is not None and moved + alone * abs(same - before) < n * tolerance):
            break
        got = sent(within).groupBy("node").agg(F.sum("got").alias("got"))
        new = F.lit(same) + alpha * (F.lit(before) * F.col("given") + F.coalesce("got", F.lit(0.0)))
        rank = written(rank.join(got, "node", "left").select("node", "d", "given", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        step += 1
    got = sent(e.where("cited = 1")).union(given.select("node", before * F.col("given"))).groupBy("node").agg(F.sum("got").alias("got"))
    return nodes.select("node").join(got, "node", "left").select("node", (F.lit(same) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))


def resting_ranks(edges: DataFrame, by: Sequence[str], alpha: float = 0.85, tolerance: float = 1e-10, steps: int = 200) -> DataFrame:
    """by, node and x, PageRank at rest of each graph of edges (by, src, ref) but for a factor: x of a graph sums to more than one.

    Nodes without refs give each node the same, so ranks stand to each other as x = 1 + alpha * (the sum of x / d over citers). Sources that nothing cites have x = 1, what they
    give is summed once, and only nodes that cite and are cited move from round to round, until all of a graph's x together move by less than tolerance times their sum."""
    by = list(by)
    e = written(edges.select(*by, "src", "ref").distinct())
    real = F.expr("CAST(src <> ref AS INT)")
    ends = e.select(*by, F.col("src").alias("node"), real.alias("d"), F.lit(0).alias("cited")).union(e.select(*by, "ref", F.lit(0), real))
    nodes = written(ends.groupBy(*by, "node").agg(F.sum("d").alias("d"), F.max("cited").alias("cited")))
    e = written(e.where("src <> ref").join(nodes.where("d > 0").withColumnRenamed("node", "src"), [*by, "src"]))
    given = written(e.where("cited = 0").groupBy(*by, F.col("ref").alias("node")).agg(F.sum(1 / F.col("d")).alias("given")))
    core = nodes.where("d > 0 AND cited = 1").select(*by, "node", "d")
    x = written(core.join(given, [*by, "node"], "left").select(*by, "node", "d", F.coalesce("given", F.lit(0.0)).alias("given"), F.lit(1.0).alias("x"), F.lit(0.0).alias("old")))
    within = written(e.where("cited = 1").join(core.select(*by, F.col("node").alias("ref")), [*by, "ref"], "left_semi").select(*by, "src", "ref"))

    def sent(links: DataFrame) -> DataFrame:
        return links.select(*by, "src", "ref").join(x.select(*by, F.col("node").alias("src"), (F.col("x") / F.col("d")).alias("got")), [*by, "src"]).select(*by, F.col("ref").alias("node"), "got")

    for _ in range(steps):
        got = sent(within).groupBy(*by, "node").agg(F.sum("got").alias("got"))
        x = written(x.join(got, [*by, "node"], "left").select(*by, "node", "d", "given", (1 + alpha * (F.col("given") + F.coalesce("got", F.lit(0.0)))).alias("x"), F.col("x").alias("old")))
        if x.groupBy(*by).agg(F.sum(F.abs(F.col("x") - F.col("old"))).alias("moved"), F.sum("x").alias("all")).where(F.col("moved") > tolerance * F.col("all")).isEmpty():
            break
    got = sent(e.where("cited = 1")).union(given.select(*by, "node", "given")).groupBy(*by, "node").agg(F.sum("got").alias("got"))
    return nodes.select(*by, "node").join(got, [*by, "node"], "left").select(*by, "node", (1 + alpha * F.coalesce("got", F.lit(0.0))).alias("x"))


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges (a, b) with la and lb, the labels (node, label) of their ends; edges with an end unlabelled go."""
    return edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's modularity of a partition over undirected edges (a, b)."""
    e = labelled(edges, labels)
    ends = e.select(F.col("la").alias("label")).union(e.select("lb")).groupBy("label").agg(F.count("*").alias("d"))
    inside = e.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count("*").alias("l"))
    m = ends.agg((F.sum("d") / 2).alias("m"))
    each = ends.join(inside, "label", "left").crossJoin(F.broadcast(m))
    return each.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def within_share(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: edges, and the share of them whose ends have one label."""
    return labelled(edges, labels).agg(F.count("*").alias("n"), F.avg(F.expr("CASE WHEN la = lb THEN 1.0D ELSE 0.0D END")).alias("share"))


def assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's assortativity of the symmetrised label matrix."""
    e = labelled(edges, labels)
    both = e.select("la", "lb").union(e.select("lb", "la")).groupBy("la", "lb").agg(F.count("*").alias("n"))
    total = both.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("same"))
    rows = both.groupBy("la").agg(F.sum("n").alias("r")).agg(F.sum(F.pow(F.col("r").cast("double"), 2)).alias("sq"))
    return total.crossJoin(rows).select(((F.col("same") / F.col("t") - F.col("sq") / F.pow("t", F.lit(2))) / (1 - F.col("sq") / F.pow("t", F.lit(2)))).alias("assortativity"))


def edge_metric(edges: DataFrame, vectors: DataFrame, metric: V.Metric, by: str) -> DataFrame:
    """Per group of edges (a, b, by): n and the mean of a metric of the ends' vectors (node, v)."""
    e = edges.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")
    return e.groupBy(by).agg(F.count("*").alias("n"), F.avg(metric(F.col("va"), F.col("vb"))).alias("mean"))


def meta_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """la <= lb and n, the undirected edges between communities (and within, la = lb)."""
    e = labelled(edges, labels)
    return e.groupBy(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).agg(F.count("*").alias("n"))


def meta_members(edges: DataFrame, labels: DataFrame, least: float = 0.02, top: int = 8) -> DataFrame:
    """community, n (its nodes), share, coverage (the share of all nodes that the communities listed hold) and members (the top nodes of most edges, joined by ;) of
    every community with at least so great a share of the nodes that have edges (a, b) and a label."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))
    each = ends.join(labels.toDF("node", "community"), "node")
    size = each.groupBy("community").agg(F.count("*").alias("n"))
    total = size.agg(F.sum("n").alias("t"))
    kept = size.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("t")).where(F.col("share") >= least)
    held = kept.agg((F.sum("n") / F.max("t")).alias("coverage"))
    order = Window.partitionBy("community").orderBy(F.desc("d"), "node")  # each task keeps its top before the shuffle
    best = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    members = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"].cast("string")), ";").alias("members"))
    return kept.join(members, "community").crossJoin(F.broadcast(held)).select("community", "n", "share", "coverage", "members")


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """The Jaccard index of every two communities (node, label) of two partitions that share a node."""
    a, b = left.toDF("node", "a"), right.toDF("node", "b")
    shared = a.join(b, "node").groupBy("a", "b").agg(F.count("*").alias("n"))
    na, nb = a.groupBy("a").agg(F.count("*").alias("na")), b.groupBy("b").agg(F.count("*").alias("nb"))
    return shared.join(na, "a").join(nb, "b").select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """node and label after so many rounds in which each node takes the commonest label around it, its own once included, the
    smallest of equals."""
    e = settle(symmetric(edges))
    labels = e.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = e.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label").union(labels)
        n = votes.groupBy("node", "label").agg(F.count("*").alias("n"))
        labels = settle(n.groupBy("node").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    return labels


def community_share(works: DataFrame, community: str, least: float) -> DataFrame:
    """works of communities with a share of at least least of all rows; the total is one row."""
    total = works.agg(F.count("*").alias("all"))
    big = works.groupBy(community).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= least * F.col("all")).select(community)
    return works.join(big, community, "left_semi")


