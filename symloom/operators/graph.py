"""The dependency graph: neighbours, PageRank, impact, traces. Nodes are symbols, edges (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators.tables import written

#: Targets of a list, in expectation at most; a source with more has several.
_LIST = 1 << 16


def build(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges whose ends are both symbols."""
    ids = symbols.select("id")
    pairs = edges.select("src", "dst").distinct()
    return pairs.join(ids, pairs.src == ids.id, "left_semi").join(ids, pairs.dst == ids.id, "left_semi")


def start_ids(symbols: DataFrame, name: str) -> DataFrame:
    """The last symbol with that qualified name, else all with that bare name."""
    exact = symbols.where(F.col("qualified_name") == name).agg(F.max_by("id", F.struct("file_path", "byte_start", "seq")).alias("id")).where("id is not null")
    bare = symbols.where(F.col("name") == name).select("id").join(exact.select(F.lit(1).alias("one")), F.lit(True), "left_anti")
    return exact.unionByName(bare)


def neighbours(edges: DataFrame, starts: DataFrame, direction: str = "both") -> DataFrame:
    """Distinct ids one step away; starts are not removed. Any other direction means both."""
    out = edges.join(starts.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(starts.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    found = {"out": out, "in": into}.get(direction)
    return (out.unionByName(into) if found is None else found).distinct()


@contextmanager
def _cleared(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of a written table go when it is there, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 4) -> DataFrame:
    """id, score: a fixed number of rounds, mass of sinks lost, no normalisation.

    Nodes, and edges as lists of a source's targets, are dealt by id once and stay
    so; a round is one join within those parts and one sum with map-side combine.
    Every few rounds the scores are written.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    own = edges.select("src", "dst").repartition(parts, "src")
    degree = own.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    some = F.pmod(F.xxhash64("dst"), F.ceil(F.col("_out") / _LIST))
    lists = own.join(degree.hint("shuffle_hash"), "src").groupBy("src", "_out", some.alias("_some")).agg(F.collect_list("dst").alias("_to")).drop("_some").persist()
    ids = nodes.select("id").repartition(parts, "id").persist()
    score = ids.withColumn("score", F.lit(1.0 / n))
    with _cleared(nodes.sparkSession):
        for k in range(1, rounds + 1):
            given = lists.join(score.withColumnRenamed("id", "src").hint("shuffle_hash"), "src")
            into = given.select(F.explode("_to").alias("id"), (F.col("score") / F.col("_out")).alias("_in")).groupBy("id").agg(F.sum("_in").alias("_in"))
            score = ids.join(into.hint("shuffle_hash"), "id", "left").select("id", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("_in", F.lit(0.0))).alias("score"))
            if k % every == 0 or k == rounds:
                score = written(score)
    lists.unpersist()
    ids.unpersist()
    return score


def walk(edges: DataFrame, starts: DataFrame, depth: int | None, revisit: bool = False) -> DataFrame:
    """id, depth of what is reached along edges, by a frontier that is written at each step.

    A visited id is expanded once. With ``revisit`` each id is listed at its
    first depth of at least one, so a start shows at the length of its cycle;
    without, starts are left out.
    """
    seen = written(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    front, listed, k = seen.select("id"), None, 0
    while depth is None or k < depth:
        k += 1
        near = written(edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct())
        if not near.limit(1).count():
            break
        step = near.withColumn("depth", F.lit(k))
        listed = step if listed is None else listed.unionByName(step)
        fresh = written(near.join(seen, "id", "left_anti"))
        if not fresh.limit(1).count():
            break
        seen = seen.unionByName(fresh.withColumn("depth", F.lit(k)))
        front = fresh
    if revisit:
        empty = starts.sparkSession.createDataFrame([], "id long, depth int")
        return (listed if listed is not None else empty).groupBy("id").agg(F.min("depth").alias("depth"))
    return seen.where("depth > 0")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact(edges: DataFrame, starts: DataFrame, depth: int | None = 3) -> DataFrame:
    """What depends on the starts, within a depth or without bound."""
    return walk(reverse(edges), starts, depth)


def trace(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """direction (upstream, downstream), id, depth; a start on a cycle is listed."""
    up = walk(reverse(edges), starts, depth, revisit=True).withColumn("direction", F.lit("upstream"))
    return up.unionByName(walk(edges, starts, depth, revisit=True).withColumn("direction", F.lit("downstream")))


def related(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """ids within hops along or against the edges, paths not mixed, starts left out."""
    found = walk(edges, starts, hops).select("id").unionByName(walk(reverse(edges), starts, hops).select("id"))
    return found.distinct().join(starts.select("id"), "id", "left_anti")


def ranked(symbols: DataFrame, ranks: DataFrame, limit: int = 10, kind: str | None = None, prefix: str | None = None) -> DataFrame:
    """The symbols of highest rank; filters come before the limit. Scores that agree to 12 digits are ties, as sums differ by their order."""
    rows = symbols.where(F.col("kind") == kind) if kind else symbols
    rows = rows.where(F.col("file_path").startswith(prefix)) if prefix else rows
    return rows.join(ranks, "id").orderBy(F.desc(F.round("score", 12)), "qualified_name", "id").limit(limit)


def score_of(symbols: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """One row: the highest score among symbols of that name, 0 without any."""
    return start_ids(symbols, name).join(ranks, "id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def about(symbols: DataFrame, name: str) -> DataFrame:
    """file_path and kind of a name: of the first, in list order, of the symbols it stands for."""
    found = symbols.join(start_ids(symbols, name), "id", "left_semi")
    first = F.struct("file_path", "byte_start", "seq")
    return found.agg(F.min_by("file_path", first).alias("file_path"), F.min_by("kind", first).alias("kind"))
