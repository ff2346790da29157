"""The persistent index: five Parquet tables in a folder, replaced file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import resolve, tables

SCHEMAS = {"files": tables.FILES, "symbols": tables.SYMBOLS, "imports": tables.IMPORTS, "references": tables.REFERENCES, "edges": tables.EDGES}


def diff(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status: new, changed, unchanged, or deleted for what is stored but gone. Both sides: path, hash."""
    both = scan.select("path", F.col("hash").alias("_new")).join(stored.select("path", F.col("hash").alias("_old"), F.lit(True).alias("_there")), "path", "full")
    status = F.when(F.col("_new").isNull(), "deleted").when(F.col("_there").isNull(), "new").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def replace_rows(table: DataFrame, fresh: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """table without the rows of keys in fresh or gone, and with fresh."""
    drop = fresh.select(key) if gone is None else fresh.select(key).unionByName(gone.select(key))
    return table.join(drop.distinct(), key, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


class Catalog:
    """Opens, reads and replaces the tables of an index folder.

    A commit writes all tables under a new version and then the version's name,
    so readers see one whole state and a failed run leaves the old one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = self._fs()
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[5:]) for n in names if n.startswith("done-"))

    def table(self, name: str) -> DataFrame:
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], SCHEMAS[name])
        df = self.spark.read.parquet(f"{self.path}/v{done[-1]}/{name}")
        return migrate(df) if name == "symbols" else df

    def commit(self, frames: dict[str, DataFrame]) -> None:
        version = (self.versions() or [0])[-1] + 1
        for name in SCHEMAS:
            frames.get(name, self.table(name)).write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        self._fs().create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done-{version}")).close()

    def stats(self) -> DataFrame:
        return tables.stats(*(self.table(n) for n in ("files", "symbols", "imports", "references", "edges")))

    def views(self, prefix: str = "") -> None:
        """Register the tables for SQL."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)

    def upsert(self, parsed: dict[str, DataFrame], gone: DataFrame | None = None) -> None:
        """Replace the files in parsed["files"], drop those in gone (path), and resolve all edges anew.

        Edges are resolved over the whole corpus, so they don't depend on the
        order in which files came.
        """
        fresh = parsed["files"].select(F.col("path").alias("file_path"))
        lost = None if gone is None else gone.select(F.col("path").alias("file_path"))
        out = {"files": replace_rows(self.table("files"), parsed["files"], "path", gone)}
        for name in ("symbols", "imports", "references"):
            rows = self.table(name)
            drop = fresh if lost is None else fresh.unionByName(lost)
            kept = rows.join(drop.distinct(), "file_path", "left_anti").select(*rows.columns)
            out[name] = kept.unionByName(parsed[name].select(*rows.columns))
        out = {k: tables.written(v) for k, v in out.items()}
        refs = out["references"].withColumn("ref_id", F.xxhash64("file_path", "ord"))
        out["edges"] = resolve.edges(refs.select("ref_id", "file_path", "symbol_name", "byte_start"), out["symbols"], out["imports"])
        self.commit(out)


def migrate(symbols: DataFrame) -> DataFrame:
    """Older tables lack qualified_name; it is filled from the parent chain."""
    if "qualified_name" in symbols.columns:
        return symbols
    return tables.with_qualified(symbols)
