"""Operator 5: near-duplicate documents by MinHash with tensored banding, confirmed on full sets.

Two collections of m half-keys (k minima each) are computed, and every pair
(A_i, B_j) is the key of a table: m * m tables from 2 m k minima, about a square
root of what as many plain bands need. With m = 8 and k = 3 a pair of
similarity 0.85 shares a table with probability above 0.999.

1. One pass over the texts gives each document the digest of its shingle set and
   its minima. Documents with equal sets are one class, with a number of its own.
2. In each table bucket, every class is paired with the smallest; pairs whose
   minima agree in too few places to be links are left out.
3. The full sets of the classes that are left are made once from their whole
   texts, and the pairs are confirmed on them. Components of links are labels.
4. Buckets of three and more that still hold two labels are searched to the end:
   the classes that share such buckets form clusters, and blocks of a cluster are
   compared in tasks that return spanning forests of confirmed links.

No pair list of a group is made: step 2 is linear in a bucket, step 4 returns
forests. Equal texts meet in step 1, however many they are. Step 4 is quadratic
in the classes of a cluster that are like each other but for a link, in tasks of
two blocks.

What can be missed: a pair of similarity 0.85 shares no table with a chance just
below 0.001 (``halves`` and ``minima`` set it), and one that does is dropped for
its minima with a chance of 1e-7. ``halves=16`` brings the first below 1e-9.

Defined cases: null texts, empty texts and texts of white space have an empty
set (n_shingles 0), link with nothing and are kept; rows with equal doc_id are
one node, linked through the text of any of them, and each row is returned; a
null doc_id is returned with a null component and kept true; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import common
from symloom.llm.shingles import MinHash, digest, linked, shingles

#: Half-keys in each collection, and minima in a half-key.
HALVES = 8
MINIMA = 3
#: Classes of a block, and shingles where they are large (a class of more is a block by itself, but for hash collisions).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def _least_agreement(count: int, similarity: float, miss: float = 1e-7) -> int:
    """The most places that two minhash signatures of this similarity agree in but for a chance of ``miss``."""
    from math import comb

    total = 0.0
    for k in range(count + 1):
        total += comb(count, k) * similarity**k * (1 - similarity) ** (count - k)
        if total > miss:
            return k
    return count


def _sketch(size: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHash(count)
        for batch in batches:
            n, dig, sig = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                dig.append(digest(s) if len(s) else None)
                sig.append(minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _keys(halves: int, each: int):
    """Rows (key, cls) for the halves * halves tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if not part.num_rows:
                    continue
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(part.num_rows, 2, halves, each).astype("u8")
                half = np.arange(1, 2 * halves + 1, dtype="u8").reshape(1, 2, halves) * np.uint64(0xC2B2AE3D27D4EB4F)
                for i in range(each):
                    half = (half ^ sig[:, :, :, i]) * mul
                    half ^= half >> np.uint64(31)
                key = (half[:, 0, :, None] * mul + half[:, 1, None, :]).reshape(part.num_rows, -1)
                cls = np.repeat(part.column(0).to_numpy(), key.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view("i8")), pa.array(cls)], ["key", "cls"])

    return run


def _agree(least: int):
    """Pairs (a, b, many, ok) that may be links (ok), or stand in a bucket of three and more (many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                ok = pa.array((a == b).sum(axis=1) >= least)
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "many")), ok], ["a", "b", "many", "ok"])
                yield out.filter(pc.or_(ok, batch.column("many")))

    return run


def _sets(size: int):
    """(cls, shingles) of the texts that have the digest of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, sets = [], []
            for c, want, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).cast(pa.binary())):
                s = shingles(text.as_py(), size)
                if len(s) and digest(s) == want.as_py():
                    cls.append(c)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "shingles"])

    return run


def _confirm(num: int, den: int):
    """The pairs (a, b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8"), num, den) for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(x: np.ndarray, y: np.ndarray, i: int, nx: int, ny: np.ndarray, other: np.ndarray, num: int, den: int, least: int) -> np.ndarray:
    """The rows of y that row i of x may link with: of another label, of like size, and alike in ``least`` places."""
    near = (den * ny >= num * nx) & (num * ny <= den * nx) & other
    near[near] = (x[i] == y[near]).sum(axis=1) >= least
    return near


def _partners(num: int, den: int, least: int):
    """The rows of two blocks of a cluster that may link with one of the other, without their sets."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        left = pdf[pdf.side == 0]
        right = left if same else pdf[pdf.side == 1]
        keep_l, keep_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(p.sig), "<u4").reshape(len(p), -1) for p in (left, right))
            nx, ny, lx, ly = left.n.to_numpy(), right.n.to_numpy(), left.label.to_numpy(), right.label.to_numpy()
            for i in range(len(left)):
                near = _near(x, y, i, int(nx[i]), ny, lx[i] != ly, num, den, least)
                keep_l[i] = near.any()
                keep_r |= near
        out = left[keep_l | keep_r] if same else pd.concat([left[keep_l], right[keep_r]])
        return out[["cluster", "i", "j", "side", "cls", "label", "sig"]]

    return run


def _search(num: int, den: int, least: int):
    """A spanning forest of the links between two blocks of a cluster, for classes of different labels."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = key[1] == key[2]
        right = left if same else right
        a, b = [], []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(p.sig), "<u4").reshape(len(p), -1) for p in (left, right))
            sx, sy = ([np.frombuffer(s, "u8") for s in p.shingles] for p in (left, right))
            root = {v: v for v in pd.concat([left.label, right.label])}

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            lx, ly, cx, cy = left.label.to_numpy(), right.label.to_numpy(), left.cls.to_numpy(), right.cls.to_numpy()
            ny = np.array([len(s) for s in sy])
            for i in range(len(left)):
                for j in np.flatnonzero(_near(x, y, i, len(sx[i]), ny, lx[i] != ly, num, den, least)):
                    if same and j <= i or find(lx[i]) == find(ly[j]):
                        continue
                    if linked(sx[i], sy[j], num, den):
                        root[find(lx[i])] = find(ly[j])
                        a.append(cx[i])
                        b.append(cy[j])
        a, b = np.array(a, "i8"), np.array(b, "i8")
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 85, den: int = 100, halves: int = HALVES, minima: int = MINIMA, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links are den * |intersection| >= num * |union| of sets of ``size``-word
    shingles. Tables that a join reads by a hot key are written before it: a
    join of plain exchanges is one that adaptive execution can split.
    """
    made: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        made.append(common.written(df, name))
        return made[-1]

    count = 2 * halves * minima
    least = _least_agreement(count, num / den)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    sketch = common.written(base.mapInArrow(_sketch(size, count), "doc_id long, n_shingles long, digest binary, sig binary"), "sketch")
    known = sketch.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    # A class has a number of its own, as one doc_id may be the smallest of several.
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    keys = written(classes.select("cls", "sig").mapInArrow(_keys(halves, minima), "key long, cls long"), "keys")
    buckets = keys.groupBy("key").agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(buckets, "key"), "shared")
    pairs = shared.where("cls <> pivot").groupBy(F.col("cls").alias("a"), F.col("pivot").alias("b")).agg((F.max("n") > 2).alias("many"))
    sigs = classes.select("cls", "sig")
    pairs = written(pairs, "candidates").join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    pairs = written(pairs.mapInArrow(_agree(least), "a long, b long, many boolean, ok boolean"), "pairs")
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    need = written(need.join(classes.select("cls", "digest", F.col("rep").alias("doc_id")), "cls"), "need")
    # Texts are shuffled at every size: what is needed of them grows with the corpus.
    sets = base.join(need.hint("merge"), "doc_id").select("cls", "digest", "text").mapInArrow(_sets(size), "cls long, shingles binary")
    sets = written(sets.groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")
    both = pairs.where("ok").select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    links = written(both.mapInArrow(_confirm(num, den), "a long, b long"), "links")
    links = links.unionByName(written(_rest(shared, classes, sets, links, num, den, least, block), "more"))
    # An id with several classes links them: each with the smallest.
    twice = known.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).where("lo <> hi").select("doc_id")
    twice = written(twice, "twice")
    if twice.limit(1).count():
        own = written(known.select("doc_id", "digest").join(twice, "doc_id").join(classes.select("digest", "cls"), "digest").select("doc_id", "cls").distinct(), "own")
        first = written(own.groupBy("doc_id").agg(F.min("cls").alias("b")), "first")
        links = links.unionByName(own.join(first, "doc_id").select(F.col("cls").alias("a"), "b"))
    comp = written(common.components(links), "components")
    low = comp.join(classes.select(F.col("cls").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    comp = comp.join(written(low, "low"), "component").select(F.col("id").alias("cls"), "component_id")
    part = classes.select("digest", "cls", "rep").join(comp, "cls", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    part = common.written(part, "part")
    for df in made:
        common.forget(df)
    out = sketch.select("doc_id", "n_shingles", "digest").join(part, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(shared, classes, sets, links, num, den, least, block) -> DataFrame:
    """Links between classes that share a bucket of three or more but no label yet (step 4)."""
    label = common.components(links).withColumnRenamed("id", "cls").withColumnRenamed("component", "label")
    busy = shared.where("n > 2")
    label = busy.select("cls").distinct().join(label, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"))
    label = common.written(label, "labels")
    mixed = busy.join(label, "cls").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows = busy.join(common.written(mixed, "mixed"), "key").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    group = common.components(rows).withColumnRenamed("id", "cls").withColumnRenamed("component", "cluster")
    group = common.written(group.join(label, "cls").join(classes.select("cls", "sig", "n"), "cls"), "clusters")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sizes = common.written(group.groupBy("cluster").agg(blocks), "sizes")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("blk")).alias("i"), F.greatest(j, F.col("blk")).alias("j"), (j < F.col("blk")).cast("int").alias("side")))
    dealt = group.join(sizes, "cluster").withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("p", F.explode(pairs)).select("cluster", "p.*", "cls", "label", "sig", "n")
    # Signatures first: sets go only where they have a class to be compared with.
    some = dealt.groupBy("cluster", "i", "j").applyInPandas(_partners(num, den, least), "cluster long, i int, j int, side int, cls long, label long, sig binary")
    dealt = common.written(some, "partners").join(sets, "cls").select("cluster", "i", "j", "side", "cls", "label", "sig", "shingles")
    return dealt.groupBy("cluster", "i", "j").applyInPandas(_search(num, den, least), "a long, b long")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with their columns, that are left when one document of each group stays.

    Rows without a doc_id, and one row of each doc_id without words, stay; of
    rows with one doc_id that stays, the one with the smallest hash does.
    """
    groups = near_duplicates(docs, **how).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    kept = common.written(groups, "kept")
    # As in near_duplicates: a shuffle at every size, since the ids that stay grow with the corpus.
    out = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("_rows > 1").limit(1).count():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        out = out.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*")
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, links of 100 * intersection >= 85 * union."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
