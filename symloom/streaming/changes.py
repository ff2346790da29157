"""Change events: debounce in batch and in streams, and a stream of a tree's changes."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def debounce(changes: DataFrame, quiet: str = "200 milliseconds", watermark: str | None = None) -> DataFrame:
    """path, ts, n_events: the last event of each burst of a path, once it has been quiet that long.

    On a stream give a watermark; sessions are then emitted as it passes them.
    """
    rows = changes.withWatermark("ts", watermark) if watermark else changes
    out = rows.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n_events"))
    return out.select("path", "ts", "n_events")


class TreeChangesReader(SimpleDataSourceStreamReader):
    """Compares listings of a tree; an offset is the listing it saw, so a restart loses nothing."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def _list(self) -> dict[str, list]:
        out = {}
        for at, dirs, names in os.walk(self.root):
            dirs.sort()
            for n in sorted(names):
                full = os.path.join(at, n)
                try:
                    s = os.stat(full)
                except OSError:
                    continue
                out[os.path.relpath(full, self.root)] = [s.st_mtime_ns, s.st_size]
        return out

    def initialOffset(self) -> dict:
        return {"seen": "{}"}

    def read(self, start: dict):
        was, now = json.loads(start["seen"]), self._list()
        return iter(self._rows(was, now)), {"seen": json.dumps(now, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(json.loads(start["seen"]), json.loads(end["seen"])))

    @staticmethod
    def _rows(was: dict, now: dict) -> list[tuple]:
        out = [(p, v[0] // 1000, v[1], "create" if p not in was else "modify") for p, v in now.items() if was.get(p) != v]
        return out + [(p, None, None, "remove") for p in was if p not in now]


class TreeChanges(DataSource):
    """spark.readStream.format("treechanges").load(root): path, mtime_us, size, op."""

    @classmethod
    def name(cls) -> str:
        return "treechanges"

    def schema(self) -> str:
        return "path string, mtime_us bigint, size bigint, op string"

    def simpleStreamReader(self, schema) -> TreeChangesReader:
        return TreeChangesReader(self.options)


def watch(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the changes of a tree, overwritten files included."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("treechanges").load(root)
