"""Operator 3: near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors of a label are compared by cosine in double precision. Equal vectors
are one item with a weight. Spherical k-means on a bounded sample gives cells;
each item belongs to the cell of its nearest centroid. Two items with cosine of
at least t lie within d = sqrt(2 - 2 t) of each other, so an item of cell b can
have a partner in cell a only where <y, c_b> - <y, c_a> <= d |c_a - c_b|: there
a copy of it visits a (for a < b), and no link is lost to the cells' borders. The
same holds for each other centroid in the place of c_b; the nearest few are tried.
The items at home in a cell and its visitors are cut into blocks. Each block at
home meets each block of the cell once, as one task-sized group; visitors don't
meet each other. A group returns a link count for each item and a spanning forest
of its links, never the pairs. Components of the forest give the groups.

Defined cases: a null label compares with nothing, nor does a vector that is
null, empty, zero or holds null or non-finite components (n_links 0, its own
component, kept); vectors of different length never link; rows with equal
vec_id are one node whose links are those of its vectors; a null vec_id is
returned with no links, its component null and kept true; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm import common, vectors

#: Vectors at most, in expectation, that the centroids are fitted on.
SAMPLE = 20_000
BLOCK = 512
#: Centroids nearest to an item that are tried to keep it from visiting a cell.
WITNESSES = 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(centroids: dict[int, np.ndarray], reach: float, rows: int = 512):
    """Rows (item, cell, visits) for each cell that an item belongs to or visits; centroids by length of the vectors."""

    def run(batches):
        for pdf in batches:
            for dim, of in pdf.groupby(pdf.embedding.map(len)):
                c = centroids[dim]
                for k in range(0, len(of), rows):
                    own = of.iloc[k : k + rows]
                    s = _unit(np.stack(own.embedding.to_numpy()).astype(float)) @ c.T
                    home = s.argmax(axis=1)
                    each = np.arange(len(s))
                    far = np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T))
                    row, cell = np.nonzero((s[each, home][:, None] - s <= reach * far + 1e-9) & (np.arange(len(c)) <= home[:, None]))
                    near = np.argpartition(-s, min(WITNESSES, s.shape[1]) - 1, axis=1)[:, :WITNESSES]
                    for w in near.T:
                        w = w[row]
                        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nd->n", c[w], c[cell])))
                        ok = (s[row, w] - s[row, cell] <= reach * apart + 1e-9) | (cell == home[row])
                        row, cell = row[ok], cell[ok]
                    out = own.iloc[row].reset_index(drop=True)
                    yield pd.DataFrame({"label": out.label, "dim": dim, "cell": cell, "visits": cell != home[row], "item": out["item"], "n": out.n, "embedding": out.embedding})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, smallest item reachable) over the edges a-b, for items other than the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = np.arange(len(ids))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        new = low.copy()
        m = np.minimum(low[u], low[v])
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    keep = low != np.arange(len(ids))
    return ids[keep], ids[low[keep]]


def _compare(least: float):
    """Links of one pair of blocks: counts (a = item, n) and forest edges (a, b)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = key[3] == key[4]
        right = left if same else right
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        raw_y = np.stack(right.embedding.to_numpy()).astype(float)
        raw_x = raw_y if same else np.stack(left.embedding.to_numpy()).astype(float)
        x, y = _unit(raw_x), _unit(raw_y)
        s = x @ y.T
        hit = s >= least
        for i, j in np.argwhere(np.abs(s - least) < 1e-12):  # at the border, by the plain definition
            p, q = raw_x[i], raw_y[j]
            hit[i, j] = float((p * q).sum()) / (float(np.sqrt((p * p).sum())) * float(np.sqrt((q * q).sum()))) >= least
        ix, iy = left.item.to_numpy(), right.item.to_numpy()
        hit &= ix[:, None] != iy[None, :]
        nx, ny = hit @ right.n.to_numpy(), (hit.T @ left.n.to_numpy())
        i, j = np.nonzero(hit)
        a, b = _forest(ix[i], iy[j])
        ids, ns = (ix, nx) if same else (np.concatenate([ix, iy]), np.concatenate([nx, ny]))
        keep = ns > 0
        return pd.DataFrame({"a": np.concatenate([ids[keep], a]), "b": np.concatenate([np.full(keep.sum(), -1), b]), "n": np.concatenate([ns[keep], np.zeros(len(a), int)])})

    return run


def near_duplicates(rows: DataFrame, least: float = 0.98, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    cells: number of centroids for each length of vectors; by default the square
    root of the number of distinct vectors over 4, up to 65,536, fitted on
    ``sample`` vectors or five a cell. They are shipped in the type they have.
    """
    kind = "array<float>" if rows.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    base = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label").cast("string"))
    good = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable(F.col("embedding")))
    # Equal vectors of a label: one item, named by its smallest vec_id.
    items = common.written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("item"), F.count_distinct("vec_id").alias("n")).withColumn("digest", F.xxhash64("label", "embedding")), "items")
    # An id belongs to several items only when it stands in several rows; items are numbered apart then.
    named, twice = items, good.groupBy("vec_id").count().where("count > 1").limit(1).count() > 0
    if twice:
        named = common.ranked(named.drop("item"), "digest", name="numbered").withColumnRenamed("_pos", "item")
    centroids = {}
    for r in named.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each length of vectors
        k = cells or int(min(1 << 16, max(1, (r.n / 4) ** 0.5)))
        x = vectors.sample(named.where(F.size("embedding") == r.dim), "embedding", max(sample, 5 * k))
        centroids[r.dim] = vectors.spherical_kmeans(_unit(x), k)
    reach = float(np.sqrt(2 - 2 * least))
    spread = named.select("label", "embedding", "item", "n").mapInPandas(_cells(centroids, reach), f"label string, dim int, cell int, visits boolean, item long, n long, embedding {kind}")
    spread = common.written(spread, "cells")
    in_blocks = lambda test: F.ceil(F.count_if(test) / block).cast("int")
    sizes = spread.groupBy("label", "dim", "cell").agg(in_blocks(~F.col("visits")).alias("homes"), in_blocks(F.col("visits")).alias("guests")).where("homes > 0")
    own = F.pmod(F.xxhash64("item"), F.when(F.col("visits"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    dealt = spread.join(sizes, ["label", "dim", "cell"]).withColumn("blk", own + F.when(F.col("visits"), F.col("homes")).otherwise(0))
    # Each pair of blocks once: block i meets j >= i as side 0, j < i as side 1. Guests' blocks come after the homes' and meet those alone.
    last = F.when(F.col("visits"), F.col("homes")).otherwise(F.col("homes") + F.col("guests")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least(j, F.col("blk")).alias("i"), F.greatest(j, F.col("blk")).alias("j"), (j < F.col("blk")).cast("int").alias("side")))
    dealt = dealt.withColumn("p", F.explode(pairs)).select("label", "dim", "cell", "p.*", "item", "n", "embedding")
    found = common.written(dealt.groupBy("label", "dim", "cell", "i", "j").applyInPandas(_compare(least), "a long, b long, n long"), "links")
    linked = found.where("b < 0").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("links"))
    if twice:
        rows_of = good.join(named.select("label", "embedding", "item", "n"), ["label", "embedding"]).select("vec_id", "item", "n")
        edges = found.where("b >= 0").select("a", "b")
        # ids and items are nodes of one graph: items below zero
        graph = edges.select((-F.col("a") - 1).alias("a"), (-F.col("b") - 1).alias("b")).unionByName(rows_of.select(F.col("vec_id").alias("a"), (-F.col("item") - 1).alias("b")))
        comp = common.components(graph)
        ids = base.where("vec_id is not null").select("vec_id").distinct().join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        low = ids.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
        label_of = ids.join(low, "component", "left").select("vec_id", F.coalesce("component_id", "vec_id").alias("component_id"))
        per = rows_of.distinct().join(linked, "item", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        out = base.select("vec_id").join(label_of, "vec_id", "left").join(per, "vec_id", "left")
    else:
        comp = common.components(found.where("b >= 0").select("a", "b")).withColumnRenamed("id", "item")
        known = named.join(linked, "item", "left").join(comp, "item", "left")
        known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "item").alias("component_id"))
        # Most vectors stand alone; only those with links are joined back, by their content.
        out = base.withColumn("_ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable(F.col("embedding")))
        out = out.join(known.where("n_links > 0").withColumn("_ok", F.lit(True)), ["label", "embedding", "_ok"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, links at a cosine of 0.98 and more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
