"""Operator 2: a mixture with target weights by iterative proportional fitting.

Every document belongs to a cell (source, language, topic) and weighs its tokens
(a quarter of its UTF-8 bytes, rounded up). Topics are cells of spherical k-means
over hashed word counts, fitted on all texts and assigned to each.
Target marginals flatten the corpus: the share of a value is its share of tokens
to the power alpha, normalised; no value can get more tokens than it has, and
what it can't take goes to the others. Or the weights of values are given
(``weights``): values that are not named then get nothing, and weights that the
corpus can't meet are an error. Raking scales the inclusion probabilities
of cells to one marginal after the other, none above 1, until all three hold; a
warning says so where they don't after ``ROUNDS``. A document is drawn where a
hash of its doc_id, uniform in 0 to 1, is below the probability of its cell, so
a draw can be repeated anywhere.

Cells are counted over all documents. Up to ``small`` cells are raked on the
driver (that many rows at most); beyond, the same steps, as many and as near,
run as joins of tables.

Defined cases: a null source or language is a value of its own; a null or empty
text has no tokens and is drawn with the probability of its cell; rows with
equal doc_id are drawn alike, those without one by their source, language and text; an empty table gives no rows; columns that clash
with internal names are kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import common
from symloom.llm.shingles import _words

TOPICS = 8
BUCKETS = 256
#: Unit of vectors in whole numbers, and rows whose vectors are held at once.
ONE, ROWS = float(1 << 20), 2000
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Share of all tokens that is drawn, in expectation.
KEEP = 0.8
SMALL = 200_000
ROUNDS, NEAR = 300, 1e-6
Weights = dict[str, dict[str | None, float]]
DIMS = ("source", "lang", "topic")
_BITS = 1 << 52


def word_counts(text: bytes | None) -> np.ndarray:
    """How many lower-case words fall into each bucket."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(_words.__getitem__, words), "u8", len(words))
    return np.bincount((h % np.uint64(BUCKETS)).astype("i8"), minlength=BUCKETS)


def unit_vectors(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of damped counts, a row each, in whole numbers of 1 / ONE; zero without words."""
    x = np.log1p(counts, dtype=float)
    return np.rint(x * (ONE / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1))))[:, None])


def _counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word counts of some rows at a time."""
    for at in range(0, len(texts), ROWS):
        yield np.stack([word_counts(t.as_py()) for t in texts.slice(at, ROWS).cast(pa.binary())])


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (_row struct of the columns ``keep``, _counts) for each row of docs, written: texts are read once and not moved."""
    box, kind = _boxed(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c.astype("u1" if c.max() < 256 else "<u4").tobytes() for part in _counts(batch.column(1)) for c in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["_row", "_counts"])

    return common.written(box.mapInArrow(run, f"_row {kind}, _counts binary"), "counts")


def _boxed(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    box = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text"))
    return box, box.select("_row").schema["_row"].dataType.simpleString()


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """Unit vectors of some rows of _counts at a time."""
    for at in range(0, len(column), ROWS):
        raw = column.slice(at, ROWS).to_pylist()
        yield unit_vectors(np.stack([np.frombuffer(r, "u1" if len(r) == BUCKETS else "<u4") for r in raw]))


def _own(u: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The nearest centroid of each unit vector; products are of whole numbers below 2^53, so they are the same in any batch."""
    mean, centroids = model
    if not len(centroids):
        return np.zeros(len(u), "i4")
    c = np.rint(centroids * ONE)
    return np.argmax(u @ c.T - np.rint(mean * ONE) @ c.T, axis=1).astype("i4")


def _centred(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors after the mean is taken off; zero where nothing is left."""
    v = u / ONE - mean
    norm = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.where(norm > 1e-9, v / np.maximum(norm, 1e-9), 0.0)


def fit_topics(rows: DataFrame, topics: int = TOPICS, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(mean, centroids) of the word vectors of all rows of counted().

    Every row counts, copies as often as they occur. Lloyd's rounds are sums over
    all rows in tasks, of which the driver gets one vector a topic; they start at
    the texts with the smallest hashes and end when no centroid moves.
    """
    table = rows.select("_counts")

    def first(batch: pa.RecordBatch) -> np.ndarray:
        return np.append(sum(u.sum(axis=0) for u in _vectors(batch.column(0))), batch.num_rows)

    total = common.totals(table, first, BUCKETS + 1)
    if not total[-1]:
        return np.zeros(BUCKETS), np.zeros((0, BUCKETS))
    mean = total[:-1] / total[-1] / ONE
    h = F.xxhash64(F.lit(3), "_counts")
    few = [r.h for r in table.select(h.alias("h")).distinct().orderBy("h").limit(topics).collect()]
    seeds = {r.h: r.c for r in table.select(h.alias("h"), F.col("_counts").alias("c")).where(F.col("h").isin(few)).dropDuplicates(["h"]).collect()}
    c = _centred(np.concatenate(list(_vectors(pa.array([seeds[k] for k in few], pa.binary())))), mean)
    c = c[np.abs(c).sum(axis=1) > 0]
    for _ in range(rounds if len(c) else 0):
        model = mean, c

        def each(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(c.shape)
            for u in _vectors(batch.column(0)):
                out += np.eye(len(c))[_own(u, model)].T @ np.rint(_centred(u, mean) * ONE)
            return out.ravel()

        new = common.totals(table, each, c.size).reshape(c.shape) / ONE
        norm = np.sqrt((new * new).sum(axis=1))[:, None]
        new = np.where(norm > 1e-12, new / np.maximum(norm, 1e-12), c)
        if (new == c).all():
            break
        c = new
    return mean, c


def assigned(rows: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (_row, _topic) for each row of counted()."""
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_own(u, model) for u in _vectors(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, "i4"), *got]))], ["_row", "_topic"])

    return rows.mapInArrow(run, f"_row {kind}, _topic int")


def with_topic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """Rows (_row struct of the columns ``keep``, _topic) for each row of docs; texts are read once and not moved."""
    box, kind = _boxed(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_own(unit_vectors(c), model) for c in _counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, "i4"), *got]))], ["_row", "_topic"])

    return box.mapInArrow(run, f"_row {kind}, _topic int")


def _value(c: Column) -> Column:
    """A string for each value, null included."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def targets(tokens: dict, alpha: float, keep: float, weight: dict | None = None) -> dict:
    """Tokens to draw of each value: keep of the total, flattened by alpha or dealt by weight, none above what there is."""
    total = sum(tokens.values()) * keep
    weight = {k: t**alpha for k, t in tokens.items()} if weight is None else weight
    out, free = {}, {k: t for k, t in tokens.items() if t > 0 and weight.get(k, 0) > 0}
    rest = total
    while free:
        all_of = sum(weight[k] for k in free)
        full = {k for k, t in free.items() if rest * weight[k] / all_of >= t}
        if not full:
            return out | {k: rest * weight[k] / all_of for k in free}
        for k in full:
            out[k] = free.pop(k)
            rest -= out[k]
    _feasible(rest, total)
    return out


def _feasible(rest: float, total: float) -> None:
    if rest > 1e-6 * max(1.0, total):
        raise ValueError(f"the values with a weight have {total - rest:.0f} tokens, {total:.0f} are wanted")


def _said(worst: float, near: float) -> None:
    if worst >= near:
        warnings.warn(f"raking stopped at a gap of {worst:.2g} of a marginal; {near:.2g} was wanted", stacklevel=3)


def _named(weights: Weights, name: str) -> dict[str, float]:
    return {"null" if k is None else f"={k}" if name != "topic" else str(k): float(w) for k, w in weights[name].items()}


def rake(cells: list[tuple], keep: float = KEEP, alpha: dict[str, float] = ALPHA, weights: Weights | None = None, rounds: int = ROUNDS, near: float = NEAR) -> list[float]:
    """Probabilities of cells (source, lang, topic, tokens), on the driver."""
    t = np.array([c[3] for c in cells], float)
    p = np.full(len(cells), keep)
    sides = []
    for d, name in enumerate(DIMS):
        values, own = np.unique(np.array([str(c[d]) for c in cells], object).astype(str), return_inverse=True)
        sums = np.bincount(own, t, len(values))
        given = _named(weights, name) if weights and name in weights else None
        weight = None if given is None else {i: given.get(str(v), 0.0) for i, v in enumerate(values)}
        want = targets(dict(enumerate(sums.tolist())), alpha[name], keep, weight)
        sides.append((own, np.array([want.get(i, 0.0) for i in range(len(values))])))
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for own, want in sides:
            have = np.bincount(own, t * p, len(want))
            factor = np.where(have > 0, want / np.maximum(have, 1e-300), 1.0)
            worst = max(worst, float(np.abs(have - want).sum() / max(1.0, want.sum())))
            p = np.minimum(1.0, p * factor[own])
        if worst < near:
            break
    _said(worst, near)
    return p.tolist()


def rake_tables(cells: DataFrame, keep: float = KEEP, alpha: dict[str, float] = ALPHA, weights: Weights | None = None, rounds: int = ROUNDS, near: float = NEAR) -> DataFrame:
    """The same for cells of any number: a table with p; each round is three sums and joins, written."""
    cur = common.written(cells.withColumn("p", F.lit(keep)), "cells")
    sides = []
    for name in DIMS:
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("have")).where("have > 0")
        total = keep * (sums.agg(F.sum("have")).first()[0] or 0.0)
        if weights and name in weights:
            given = cells.sparkSession.createDataFrame(list(_named(weights, name).items()) or [("", 0.0)], "_v string, _w double")
            sums = sums.join(F.broadcast(given), F.col(name).cast("string") == F.col("_v"), "left").withColumn("_w", F.coalesce("_w", F.lit(0.0))).drop("_v")  # given by the caller, so held already
        else:
            sums = sums.withColumn("_w", F.pow("have", F.lit(alpha[name])))
        want = sums.withColumn("want", F.when(F.col("_w") <= 0, F.lit(0.0)))
        while True:  # as in targets(); each pass fills at least one value
            r = want.agg(F.sum(F.when(F.col("want").isNull(), F.col("_w"))).alias("w"), (F.lit(total) - F.coalesce(F.sum("want"), F.lit(0.0))).alias("rest")).first()
            if r.w is None:
                _feasible(r.rest or 0.0, total)
                break
            give = F.lit(r.rest) * F.col("_w") / F.lit(r.w)
            full = F.col("want").isNull() & (give >= F.col("have"))
            if not want.where(full).limit(1).count():
                want = want.withColumn("want", F.coalesce("want", give))
                break
            want = common.written(want.withColumn("want", F.when(full, F.col("have")).otherwise(F.col("want"))), "want")
        sides.append(common.written(want.select(name, "want"), "want"))
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for name, want in zip(DIMS, sides):
            have = cur.groupBy(name).agg(F.sum(F.col("tokens") * F.col("p")).alias("have")).join(want, name, "left")
            have = common.written(have.select(name, "want", "have"), "have")
            r = have.agg(F.sum(F.abs(F.coalesce("want", F.lit(0.0)) - F.col("have"))).alias("off"), F.sum("want").alias("all")).first()
            worst = max(worst, (r.off or 0.0) / max(1.0, r["all"] or 0.0))
            factor = F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(F.lit(1.0))
            new = common.written(cur.join(have, name).withColumn("p", F.least(F.lit(1.0), F.col("p") * factor)).drop("want", "have"), "cells")
            common.forget(cur)
            common.forget(have)
            cur = new
        if worst < near:
            break
    _said(worst, near)
    return cur


def probabilities(cells: DataFrame, keep: float = KEEP, alpha: dict[str, float] = ALPHA, small: int = SMALL, weights: Weights | None = None) -> tuple[DataFrame, bool]:
    """cells (source, lang, topic, tokens) with p, and whether they are few enough to broadcast."""
    cells = common.written(cells, "cells")
    if cells.count() > small:
        return rake_tables(cells, keep, alpha, weights), False
    rows = sorted(map(tuple, cells.select(*DIMS, "tokens").collect()))
    done = [(*r, float(p)) for r, p in zip(rows, rake(rows, keep, alpha, weights))]
    return cells.sparkSession.createDataFrame(done, "source string, lang string, topic int, tokens long, p double"), True


def draw(seed: int, row: str = "") -> Column:
    """Uniform in 0 to 1, the same for equal ids, or for equal rows without an id; row: a struct that holds the columns."""
    c = lambda name: F.col(f"{row}.{name}" if row else name)
    own = F.when(c("doc_id").isNotNull(), F.xxhash64(F.lit(seed), c("doc_id"))).otherwise(F.xxhash64(F.lit(seed), c("source"), c("lang"), c("text")))
    return F.pmod(own, F.lit(_BITS)) / F.lit(float(_BITS))


def _at(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"source": _value(F.col("_row.source")), "lang": _value(F.col("_row.lang")), "topic": F.col("_topic")})


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMS).agg(F.sum("_row.tokens").cast("long").alias("tokens"))


def _tokens(text: Column) -> Column:
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def weigh(docs: DataFrame, keep: float = KEEP, alpha: dict[str, float] = ALPHA, seed: int = 42, small: int = SMALL, weights: Weights | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, drawn for each row of docs."""
    docs = docs.select("doc_id", "source", "lang", "text", _tokens(F.col("text")).alias("tokens"), draw(seed).alias("u"))
    rows = counted(docs, ["doc_id", "source", "lang", "tokens", "u"])
    rows = _at(common.written(assigned(rows, fit_topics(rows)), "topics"))
    p, few = probabilities(_sums(rows), keep, alpha, small, weights)
    p = p.select(*DIMS, F.col("p").alias("_p"))
    out = rows.join(F.broadcast(p) if few else p, list(DIMS))
    return out.select("_row.doc_id", "_row.source", "_row.lang", F.col("_topic").alias("topic"), "_row.tokens", F.col("_p").alias("probability"), (F.col("_row.u") < F.col("_p")).alias("drawn"))


def sample(docs: DataFrame, keep: float = KEEP, alpha: dict[str, float] = ALPHA, seed: int = 42, small: int = SMALL, weights: Weights | None = None) -> DataFrame:
    """The rows of docs that are drawn, with their columns. Topics are found twice, so that no text is shuffled or written."""
    cols = docs.columns
    slim = counted(docs.select("source", "lang", "text", _tokens(F.col("text")).alias("tokens")), ["source", "lang", "tokens"])
    model = fit_topics(slim)
    p, few = probabilities(_sums(_at(assigned(slim, model))), keep, alpha, small, weights)
    common.forget(slim)
    p = p.select(*DIMS, F.col("p").alias("_p"))
    full = _at(with_topic(docs, model, cols))
    full = full.join(F.broadcast(p) if few else p, list(DIMS)).where(draw(seed, "_row") < F.col("_p"))
    return full.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` weighed and drawn."""
    return weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"))
