"""Operator 10: nearest neighbours by score-aware anisotropic quantisation.

Smallest Euclidean distance is largest inner product of (q, 1) with
(x, -|x|^2 / 2). The vector part, less the mean of a bounded sample (distances
stay as they are), is product-quantised into four-bit codes; the
codebooks are fitted on that sample with the anisotropic loss, which weighs
the residual parallel to x ``eta`` times as much as the rest: codes are assigned
by coordinate descent under it and codewords are its weighted least-squares
solutions. The norm part is kept as it is. Equal vectors are coded once, every
vector is. Queries, in blocks, meet the codes, in ``SPANS`` spans: a task holds a
block of queries and the best ``depth`` of each so far, while the codes of its
span pass by in batches and are scored by tables of q with each codeword. So no
group is held in memory, and at most ``SPANS * depth`` rows a query are shuffled.
The best ``depth`` over all spans are ranked again by exact distances of the
original vectors; the k-th of them bounds the distance of each query.

Codes can't tell vectors apart that lie closer than their error, so what they
missed is found by a second scan: the original vectors pass every block of
queries as matrix products in double precision, and pairs within a query's bound,
or within rounding errors of it, get exact distances; the bound falls as nearer
ones come. So the result is that of brute force, whatever the codes tell; they
only decide how many pairs need exact distances. A task holds a block of queries
and k rows of each.

Work is twice (queries x distinct vectors), and every vector is shuffled once for
each block of ``_block()`` queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, as query or candidate; a query meets only vectors of
its length; of rows with equal vec_id each is a candidate, and a query's own
vec_id is none of its candidates; ties go to the smaller vec_id; a query with no
candidate and an empty table give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm import common, vectors

#: Vectors at most, in expectation, that the codebooks are fitted on.
SAMPLE = 10_000
#: Weight of the residual parallel to the vector.
ETA = 3.0
#: Candidates of a query that are ranked again.
DEPTH = 200
QUERY_BLOCK = 1024
#: Spans of the codes, and codes that are scored at once.
SPANS, CODE_BLOCK = 16, 4096
#: Bytes of a block of queries in the exact scan; products, and pairs with exact distances, at once.
EXACT_BYTES, PRODUCTS, PAIRS = 1 << 24, 1 << 22, 1 << 16


class Quantizer:
    """Four-bit product codes: books[m, 16, d] over slices of d components."""

    def __init__(self, dim: int, books: np.ndarray):
        self.dim, self.books = dim, books
        self.parts, _, self.width = books.shape

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = self.parts * self.width - self.dim
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), self.parts, self.width)

    def codes(self, x: np.ndarray, eta: float = ETA, sweeps: int = 3) -> np.ndarray:
        """Codes under |r|^2 + (eta - 1) <r, x / |x|>^2, by coordinate descent from the nearest codewords."""
        s = self.split(x)
        unit = s / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]
        apart = ((s[:, :, None, :] - self.books[None]) ** 2).sum(axis=3)
        along = np.einsum("nmd,nmd->nm", s, unit)[:, :, None] - np.einsum("nmd,mkd->nmk", unit, self.books)
        code = apart.argmin(axis=2)
        row = np.arange(len(x))
        total = along[row[:, None], np.arange(self.parts)[None], code].sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - along[row, m, code[:, m]]
                code[:, m] = (apart[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[row, m, code[:, m]]
        return code.astype("u1")

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's slices with each codeword: (query, part, 16)."""
        return np.einsum("qmd,mkd->qmk", self.split(q), self.books)


def fit(x: np.ndarray, width: int = 2, eta: float = ETA, rounds: int = 6, seed: int = 7) -> Quantizer:
    """Codebooks for the sample x."""
    n, dim = x.shape
    rng = np.random.default_rng(seed)
    parts = -(-dim // width)
    quant = Quantizer(dim, np.zeros((parts, 16, width)))
    s = quant.split(x)
    quant.books = np.stack([s[rng.choice(n, 16, replace=n < 16), m] for m in range(parts)])
    unit = s / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None, None]
    for k in range(rounds):
        code = quant.codes(x, eta if k else 1.0)
        around = np.stack([quant.books[m, code[:, m]] for m in range(parts)], axis=1)
        along = np.einsum("nmd,nmd->nm", s - around, unit)
        total = along.sum(axis=1)
        for m in range(parts):
            u, rest = unit[:, m], total - along[:, m] + np.einsum("nd,nd->n", s[:, m], unit[:, m])
            for c in range(16):
                own = code[:, m] == c
                if own.any():  # min over b of sum |s - b|^2 + (eta - 1) (rest - <u, b>)^2
                    left = own.sum() * np.eye(width) + (eta - 1) * u[own].T @ u[own]
                    right = s[own, m].sum(axis=0) + (eta - 1) * (u[own] * rest[own, None]).sum(axis=0)
                    quant.books[m, c] = np.linalg.solve(left, right)
    return quant


def pack_codes(code: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
    return code[:, 0::2] | code[:, 1::2] << 4


def unpack_codes(raw: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([raw & 15, raw >> 4], axis=2).reshape(len(raw), -1)[:, :parts]


def _index(quant: Quantizer, center: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf.embedding.to_numpy()).astype(float) - center if len(pdf) else np.zeros((0, quant.dim))
            raw = pack_codes(quant.codes(x))
            yield pd.DataFrame({"row": pdf["item"], "half": (x * x).sum(axis=1) / 2, "data": [r.tobytes() for r in raw]})

    return run


def _scan(quant: Quantizer, center: np.ndarray, depth: int):
    """Batches sorted by (block, span, code): a block's queries, then the codes of a span. Gives the best rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, tables, best, rows = None, [], None, None, None

        def done() -> pa.RecordBatch:
            good = np.isfinite(best)
            names = np.repeat(np.array(asked, "i8")[:, None], best.shape[1], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(names[good]), pa.array(rows[good]), pa.array(best[good].astype(float))], ["query_row", "row", "approx"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "span", "code")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if tuple(keys[lo, :2]) != at:
                    if best is not None:
                        yield done()
                    at, asked, held, tables, best, rows = tuple(keys[lo, :2]), [], [], None, None, None
                part = batch.slice(lo, hi - lo)
                if not keys[lo, 2]:
                    asked += part.column("row").to_pylist()
                    held += [np.frombuffer(b.as_buffer(), "f8") - center for b in part.column("data")]
                    continue
                if not asked:
                    continue
                if tables is None:
                    tables = quant.tables(np.stack(held)).astype("f4")
                    best, rows = np.full((len(asked), 0), -np.inf, "f4"), np.zeros((len(asked), 0), "i8")
                for k in range(0, hi - lo, CODE_BLOCK):
                    some = part.slice(k, CODE_BLOCK)
                    code = unpack_codes(np.frombuffer(b"".join(some.column("data").to_pylist()), "u1").reshape(some.num_rows, -1), quant.parts)
                    score = np.repeat(-some.column("half").to_numpy()[None].astype("f4"), len(asked), axis=0)
                    for m in range(quant.parts):
                        score += tables[:, m][:, code[:, m]]
                    score = np.concatenate([best, score], axis=1)
                    row = np.concatenate([rows, np.repeat(some.column("row").to_numpy()[None], len(asked), axis=0)], axis=1)
                    if score.shape[1] > depth:
                        top = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
                        score, row = np.take_along_axis(score, top, 1), np.take_along_axis(row, top, 1)
                    best, rows = score, row
        if best is not None:
            yield done()

    return run


def _block(dim: int) -> int:
    """Queries of a block in the exact scan."""
    return max(256, min(1 << 15, EXACT_BYTES // (8 * dim)))


class _Nearest:
    """The k nearest of each query of a block among vectors that pass by: by exact distance, then by the smallest id that isn't the query's own."""

    def __init__(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, center: np.ndarray, k: int):
        self.x, self.own, self.bound, self.center, self.k = x, own, bound, center, k
        y = x - center
        self.twice, self.norm = 2 * y, (y * y).sum(axis=1)
        self.score, self.key, self.item = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo("i8").max), np.full((len(x), k), -1)

    def meet(self, x: np.ndarray, item: np.ndarray, low: np.ndarray, low2: np.ndarray) -> None:
        """low, low2: the two smallest ids of each vector x; without a second, low2 is low."""
        step = max(16, PRODUCTS // len(self.x))
        for lo in range(0, len(x), step):
            part = slice(lo, lo + step)
            with np.errstate(over="ignore", invalid="ignore"):
                y = x[part] - self.center
                norm = (y * y).sum(axis=1)
                most = np.where(self.item[:, -1] >= 0, np.minimum(self.bound, self.score[:, -1]), self.bound)
                # What lies as near the bound as rounding errors of the products gets its exact distance.
                safe = 1 - 1e-15 * (x.shape[1] + 8)
                far = (safe * self.norm - most * most * (1 + 1e-14))[:, None] + safe * norm[None] > self.twice @ y.T
            q, v = np.nonzero(~far)
            for k in range(0, len(q), PAIRS):
                self._take(x[part], item[part], low[part], low2[part], q[k : k + PAIRS], v[k : k + PAIRS])

    def _take(self, x: np.ndarray, item: np.ndarray, low: np.ndarray, low2: np.ndarray, q: np.ndarray, v: np.ndarray) -> None:
        key = np.where(low[v] == self.own[q], low2[v], low[v])
        good = key != self.own[q]
        q, v, key = q[good], v[good], key[good]
        total = np.zeros(len(q))
        with np.errstate(over="ignore"):
            for a, b in zip(self.x.T, x.T):  # one component after the other, as in the queries' other steps
                total += (a[q] - b[v]) ** 2
        score = np.sqrt(total)
        near = score <= self.bound[q]
        near &= (score < self.score[q, -1]) | (score == self.score[q, -1]) & (key < self.key[q, -1])
        q, v, key, score = q[near], v[near], key[near], score[near]
        if not len(q):
            return
        who = np.unique(q)
        q = np.concatenate([np.repeat(who, self.k), q])
        score, key, item = np.concatenate([self.score[who].ravel(), score]), np.concatenate([self.key[who].ravel(), key]), np.concatenate([self.item[who].ravel(), item[v]])
        order = np.lexsort((item, key, item < 0, score, q))
        q = q[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = place < self.k
        order, q, place = order[kept], q[kept], place[kept]
        self.score[q, place], self.key[q, place], self.item[q, place] = score[order], key[order], item[order]


def _exact(dim: int, center: np.ndarray, k: int, kind: str):
    """Batches sorted by (block, span, code, low): a block's queries with their bounds, then the vectors of a span. Gives the k nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], None

        def done() -> pa.RecordBatch:
            rows = np.repeat(np.concatenate([p[0] for p in asked])[:, None], k, axis=1)
            good = best.item >= 0
            return pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (rows, best.item, best.key, best.score)], ["query_row", "item", "key", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "span", "code")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if tuple(keys[lo, :2]) != at:
                    if best is not None:
                        yield done()
                    at, asked, best = tuple(keys[lo, :2]), [], None
                part = batch.slice(lo, hi - lo)
                row, low, low2, bound = (part.column(c).to_numpy() for c in ("row", "low", "low2", "bound"))
                x = np.frombuffer(b"".join(part.column("data").to_pylist()), kind).reshape(-1, dim).astype(float)
                if not keys[lo, 2]:
                    asked.append((row, x, low, bound))
                elif asked:
                    best = best or _Nearest(*(np.concatenate([p[i] for p in asked]) for i in (1, 2, 3)), center, k)
                    best.meet(x, row, low, low2)
        if best is not None:
            yield done()

    return run


def _dealt(q: DataFrame, c: DataFrame, n: int, block: int, order: list[str]) -> DataFrame:
    """n queries q in blocks, each for every span, before the rows c of the span, each for every block; both have row."""
    down = -(-n // block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    name = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    q = q.select(name(down).alias("block"), every(SPANS).alias("span"), F.lit(0).alias("code"), *q.columns)
    c = c.select(every(down).alias("block"), name(SPANS).alias("span"), F.lit(1).alias("code"), *c.columns)
    parts = max(1, min(down * SPANS, 16 * common.width(q.sparkSession)))
    return q.unionByName(c).repartition(parts, "block", "span").sortWithinPartitions("block", "span", "code", *order)


def search(table: DataFrame, queries: DataFrame, k: int = 10, depth: int = DEPTH, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among ``table``. Both have vec_id and embedding."""
    usable = vectors.usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    base = table.select(F.col("vec_id").cast("long"), "embedding").where(usable)
    # Equal vectors: one item. A query needs the k + 1 smallest ids of each at most, as one may be its own.
    items = base.groupBy("embedding").agg(F.min("vec_id").alias("low")).select("embedding", "low", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("item"))
    items = common.written(items, "items")
    named = base.distinct().join(items.select("embedding", "item"), "embedding")
    named = named.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy("vec_id"))).where(F.col("_r") <= k + 1).select("item", "vec_id", "_r")
    named = common.written(named, "named")
    asked = queries.select(F.col("vec_id").cast("long"), "embedding").where(usable)
    asked = common.written(asked.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "queries")
    float_ = [df.schema["embedding"].dataType.elementType.simpleString() == "float" for df in (items, asked)]
    kind = "f4" if all(float_) else "f8"
    wide = lambda df: df.withColumn("x", F.col("embedding").cast("array<double>")).drop("embedding")
    near = None
    dims = sorted(r.dim for r in items.select("dim").distinct().collect())  # a row for each length of vectors
    wants = {r.dim: r.n for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    for dim in dims:
        if dim not in wants:
            continue
        own, ask = items.where(F.col("dim") == dim), asked.where(F.col("dim") == dim)
        some = vectors.sample(own, "embedding", sample)
        center = some.mean(axis=0)
        quant = fit(some - center)
        code = common.written(own.select("item", "embedding").mapInPandas(_index(quant, center), "row long, half double, data binary"), "codes")
        q = wide(ask.select("row", "embedding")).mapInPandas(_bytes("f8"), "row long, data binary").withColumn("half", F.lit(0.0))
        got = _dealt(q, code, wants[dim], QUERY_BLOCK, []).mapInArrow(_scan(quant, center, max(depth, k)), "query_row long, row long, approx double")
        best = Window.partitionBy("query_row").orderBy(F.desc("approx"), "row")
        found = got.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max(depth, k)).select("query_row", F.col("row").alias("item"))
        # The k-th exact distance of what the codes found, without rows of the query's own id alone, bounds those to find.
        q = ask.select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("embedding").alias("q"))
        second = named.where("_r = 2").select("item", F.col("vec_id").alias("low2"))
        own = own.select("item", "embedding", "low").join(second, "item", "left").withColumn("low2", F.coalesce("low2", "low"))
        pairs = found.join(q, "query_row").join(own, "item").where((F.col("low") != F.col("query_id")) | (F.col("low2") != F.col("query_id")))
        apart = F.zip_with(F.col("q").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda a, b: (a - b) * (a - b))
        pairs = pairs.select("query_row", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, v: s + v)).alias("score"))
        bound = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("query_row").orderBy("score"))).where(F.col("_r") == k).select(F.col("query_row").alias("row"), F.col("score").alias("bound"))
        q = wide(ask.select("row", "vec_id", "embedding").join(bound, "row", "left")).select("row", F.col("vec_id").alias("low"), F.col("vec_id").alias("low2"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "x")
        c = wide(own.withColumnRenamed("item", "row")).select("row", "low", "low2", F.lit(0.0).alias("bound"), "x")
        form = "row long, low long, low2 long, bound double, data binary"
        q, c = (df.mapInPandas(_bytes(kind), form) for df in (q, c))
        got = _dealt(q, c, wants[dim], _block(dim), ["low"]).mapInArrow(_exact(dim, center, k, kind), "query_row long, item long, key long, score double")
        near = got if near is None else near.unionByName(got)
    if near is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The k nearest vectors by (distance, smallest id that isn't the query's own) hold the k nearest rows.
    first = Window.partitionBy("query_row").orderBy("score", "key", "item")
    near = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("query_row", "item", "score")
    near = near.join(asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row")
    near = near.join(named.select("item", "vec_id"), "item").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "item")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bytes(kind: str):
    """Numbers x of a row as bytes data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="x").assign(data=[np.asarray(x, kind).tobytes() for x in pdf.x])

    return run


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all of ``embeddings``."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(table, table.where(F.pmod("vec_id", F.lit(100)) == 0))
