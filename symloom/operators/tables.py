"""Written tables and schemas that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = "id bigint, file_id bigint, file_path string, seq int, name string, qualified_name string, kind string, visibility string, signature string, docstring string, byte_start bigint, byte_end bigint, parent_id bigint"
FILES = "file_id bigint, path string, language string, hash string, last_indexed timestamp"
IMPORTS = "file_id bigint, file_path string, ord int, raw_text string, source_module string, imported_names array<string>"
REFERENCES = "file_id bigint, file_path string, ord int, symbol_name string, byte_start bigint, byte_end bigint, context string"
EDGES = "src bigint, dst bigint, context string"
KINDS = ("function", "class", "method", "type", "const", "interface", "module")
VISIBILITIES = ("public", "private", "internal")


def written(df: DataFrame) -> DataFrame:
    """df through Parquet in the shared folder of spark.checkpoint.dir, which cuts lineage and outlives executors."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="symloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/symloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, key: str, size: str) -> DataFrame:
    """df with before: the sum of size over the rows of smaller keys, which are unique.

    Sums go over ranges of keys: one of each range first, then within it, so no
    task sorts all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = written(df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    less = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = rows.groupBy("_part").agg(F.sum(size).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(less), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), "_part")
    return rows.withColumn("before", F.col("_base") + F.coalesce(F.sum(size).over(inner), F.lit(0))).drop("_part", "_base")


def in_list_order(df: DataFrame) -> DataFrame:
    return df.orderBy("file_path", "byte_start", "seq")


def with_qualified(symbols: DataFrame) -> DataFrame:
    """Add or fill qualified_name from the parent chain (path::name, parent::name)."""
    old = F.col("qualified_name") if "qualified_name" in symbols.columns else F.lit(None).cast("string")
    cur = symbols.withColumn("_q", F.when(F.length(old) > 0, old)).withColumn("_q", F.when(F.col("parent_id").isNull(), F.coalesce("_q", F.concat_ws("::", "file_path", "name"))).otherwise(F.col("_q")))
    while True:  # one join for each level of nesting
        done = cur.where("_q is not null").select(F.col("id").alias("parent_id"), F.col("_q").alias("_pq"))
        new = written(cur.join(done, "parent_id", "left").withColumn("_q", F.coalesce("_q", F.concat_ws("::", F.col("_pq"), F.when(F.col("_pq").isNotNull(), F.col("name"))))).withColumn("_q", F.when(F.length("_q") > 0, F.col("_q"))).drop("_pq"))
        missing = (cur.where("_q is null").count(), new.where("_q is null").count())
        cur = new
        if missing[1] in (0, missing[0]):
            break
    filled = F.coalesce("_q", F.concat_ws("::", "file_path", "name"))
    cols = symbols.columns if "qualified_name" in symbols.columns else [*symbols.columns, "qualified_name"]
    return cur.withColumn("qualified_name", filled).select(*cols)


def stats(files: DataFrame, symbols: DataFrame, imports: DataFrame, references: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the size of each table and the languages in order."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = files.agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_set("language")).alias("languages"))
    for df, name in ((symbols, "n_symbols"), (imports, "n_imports"), (references, "n_references"), (edges, "n_edges")):
        out = out.crossJoin(one(df, name))  # one row each
    return out
