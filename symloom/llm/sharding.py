"""Operator 4: documents into a fixed number of shards by best-fit-decreasing bin packing.

Equal texts are one indivisible group; a group larger than a shard is cut into
the fewest pieces that fit one, as no law of sizes could hold otherwise. Pieces,
from the largest, enter the shard with the tightest room that holds them, found
in a balanced tree (a treap). The capacity is the least, to a small step, for
which all pieces fit.

Scale: pieces above a thousandth of a shard are packed one by one (at most a
thousand for each shard, whatever the corpus); smaller ones by size classes,
exact to 4096 bytes and then rounded up by 1/512 at most, of which there are a
bounded number: best fit puts equal sizes into the same shard until it is full,
so a class is packed by a few divisions. Groups then look up their shard by
their global rank in the class. No group, shard or class is gathered in one task.

Defined cases: a null text is empty and equal to an empty one; rows with equal
doc_id are separate documents; a null doc_id comes first in its shard; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import common

SHARDS = 40
#: Bytes that each document takes besides its text.
HEAD = 16
#: Pieces above capacity / FINE are packed one by one.
FINE = 1000


class Treap:
    """A balanced tree of (room, bin): least(room) finds the tightest bin that has it."""

    def __init__(self, seed: int = 1):
        self.rng, self.root = random.Random(seed), None

    def _split(self, node: list | None, key: tuple) -> tuple:
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.rng.random(), None, None]), b)

    def remove(self, key: tuple) -> None:
        a, b = self._split(self.root, key)
        _, b = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, b)

    def least(self, room: int) -> tuple | None:
        node, best = self.root, None
        while node:
            if node[0] >= (room, -1):
                node, best = node[2], node[0]
            else:
                node = node[3]
        return best


def best_fit(sizes: list[tuple[int, int]], shards: int, capacity: int) -> list[list[tuple[int, int]]] | None:
    """For each (size, count), in decreasing size: [(shard, how many)]; None if they don't fit."""
    tree = Treap()
    for b in range(shards):
        tree.add((capacity, b))
    out = []
    for size, count in sizes:
        put = []
        while count:
            found = tree.least(size)
            if found is None:
                return None
            room, b = found
            n = min(count, room // size)
            tree.remove(found)
            tree.add((room - n * size, b))
            put.append((b, n))
            count -= n
        out.append(put)
    return out


def least_capacity(sizes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """best_fit() at the least capacity that fits, to 1/20000."""
    if not sizes:
        return []
    low = max(-(-sum(s * n for s, n in sizes) // shards), sizes[0][0])
    got, step = best_fit(sizes, shards, low), max(1, low // 20_000)
    if got is not None:
        return got
    while (got := best_fit(sizes, shards, low + step)) is None:
        step *= 2
    bad, good = step // 2, step
    while good - bad > max(1, low // 20_000):
        mid = (good + bad) // 2
        if (better := best_fit(sizes, shards, low + mid)) is None:
            bad = mid
        else:
            good, got = mid, better
    return got


def _class(size: Column) -> Column:
    """The size that a piece counts with: exact to 4096, then rounded up by 1/512 at most."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - 9, F.lit(0))).cast("long")
    return F.when(size <= 4096, size).otherwise(F.ceil(size / unit).cast("long") * unit)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(HEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("same"))
    base = common.written(base, "sizes")
    groups = common.written(base.groupBy("same").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")), "groups")
    total = groups.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    limit = max(1, -(-total // shards))
    per = F.greatest(F.floor(F.lit(limit) / F.col("size")), F.lit(1))
    groups = groups.withColumn("per", per.cast("long")).withColumn("n", F.ceil(F.col("copies") / F.col("per")).cast("long"))
    pieces = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pieces = pieces.select("same", F.col("piece").cast("long"), (F.least("per", F.col("copies") - F.col("piece") * F.col("per")) * F.col("size")).alias("bytes"))
    pieces = pieces.withColumn("big", F.col("bytes") * FINE > limit).withColumn("class", F.when(F.col("big"), F.col("bytes")).otherwise(_class(F.col("bytes"))))
    rows = common.ranked(pieces, F.desc("big"), F.desc("class"), "same", "piece", name="pieces")
    rows = rows.drop("bytes")
    sizes = rows.groupBy("big", "class").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first"))
    sizes = sorted(sizes.collect(), key=lambda r: (-r["class"], not r.big))  # at most FINE * shards + some 20,000 rows
    # Big pieces stand before small ones in the ranks; in one class of each, one after the other.
    put = least_capacity([(r["class"], r.n) for r in sizes], shards)
    table = []
    for r, bins in zip(sizes, put):
        at = r["first"]
        for b, n in bins:
            table.append((r.big, r["class"], at, at + n, b))
            at += n
    plan = spark.createDataFrame(table, "big boolean, class long, lo long, hi long, shard int") if table else spark.createDataFrame([], "big boolean, class long, lo long, hi long, shard int")
    # At most one row for each class and each time a shard is filled.
    placed = rows.join(F.broadcast(plan), ["big", "class"]).where((F.col("_pos") >= F.col("lo")) & (F.col("_pos") < F.col("hi"))).select("same", "piece", "shard")
    cut = groups.where("n > 1").select("same", "per")
    many = base.join(cut, "same")
    many = common.ranked(many, "same", "doc_id", name="copies")
    start = many.groupBy("same").agg(F.min("_pos").alias("_from"))
    many = many.join(start, "same").withColumn("piece", F.floor((F.col("_pos") - F.col("_from")) / F.col("per")).cast("long")).select(*base.columns, "piece")
    whole = base.join(cut.select("same"), "same", "left_anti").withColumn("piece", F.lit(0).cast("long")).select(*base.columns, "piece")
    out = whole.unionByName(many).join(placed, ["same", "piece"]).select("doc_id", "size", "text_crc32", "shard")
    out = common.ranked(out, "shard", "doc_id", "text_crc32", "size", name="shards")
    first = out.groupBy("shard").agg(F.min("_pos").alias("_from"))
    out = out.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_pos") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in shards 0 to 39."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
