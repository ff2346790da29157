"""What the operators of this package share: written tables, global ranks, components.

Intermediate tables go to the folder in ``spark.checkpoint.dir`` (shared by all
executors on a cluster), so a lost executor never loses what was written. Only
where that setting is empty and the master is local, as in tests, a local
temporary folder is used; elsewhere an empty setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The low bits of monotonically_increasing_id() that count rows of a partition.
_ROW_BITS = 33


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="symloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/symloom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._symloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing will read again."""
    path = getattr(df, "_symloom_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def totals(df: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of each(batch), ``size`` whole numbers, over all of df; a task sends its own sum to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "<i8")
        for batch in batches:
            if batch.num_rows:
                total += each(batch).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    return sum((np.frombuffer(r.t, "<i8") for r in df.mapInArrow(run, "t binary").collect()), np.zeros(size, "i8"))


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, from the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ordered(df: DataFrame, *by: Column | str) -> DataFrame:
    """df dealt into ranges of ``by`` and sorted in each, with columns _part and _idx (row in it)."""
    n = width(df.sparkSession)
    mid = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(n, *by)
        .sortWithinPartitions(*by)
        .withColumn("_mid", mid)
        .withColumn("_part", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )


def ranked(df: DataFrame, *by: Column | str, name: str = "ranked") -> DataFrame:
    """df with a gapless global ``_pos`` from 0 in the order of ``by``, without a single-task sort.

    Rows are dealt into sorted ranges and written once; the offsets of the
    ranges (one row for each partition) are summed and joined back.
    """
    rows = written(ordered(df, *by), name)
    ends = rows.groupBy("_part").agg((F.max("_idx") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = rows.join(F.broadcast(base), "_part").withColumn("_pos", F.col("_base") + F.col("_idx"))
    out = out.drop("_part", "_idx", "_base")
    out._symloom_path = rows._symloom_path
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, component), the smallest id reachable.

    Alternating large-star and small-star steps; each is a min() with map-side
    combine and a join; the edges of a hub, pairs of numbers, meet its minimum in
    one task. Each step is a written table. Ids without an
    edge to another id are not returned.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = written(pairs, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(cur)
    for _ in range(rounds):
        if not was[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where(F.col("u") != F.col("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        new = written(small, "small")
        now = mark(new)
        forget(cur)
        forget(large)
        cur = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not converge")
    out = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    ids = out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
    return ids
