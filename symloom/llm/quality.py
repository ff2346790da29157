"""Operator 6: quality scores by Bradley-Terry pairwise ranking.

One pass over the whole texts measures style features. Rows labelled 1 are
preferred to rows labelled 0: a logistic loss on the differences of their
features, which stand for quantile bins, gives each bin a strength and each
document a score. Scores are mapped to 0 to 1 so that ``threshold`` lies at the
quantile of the labelled scores below which the share of label 0 lies, with a
slope that fits the labels best.

The fit uses every labelled row but those of the held-out fold (crc32 of the
doc_id as text, modulo 5, is 0), and every pair of them with different labels:
each step is a sum over all rows in tasks, of which the driver gets a fixed
number of totals. Pairs are summed over a grid of scores, which changes the mean
loss of a pair by less than 1e-3. Language, source, doc_id and labels are no
features.

Defined cases: null and empty texts have the features of an empty text and get a
score; rows with equal doc_id are scored by their own texts, and a label counts
for each; a null label or doc_id teaches nothing; without both labels every
score is 0.5 (and kept); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import common

THRESHOLD = 0.3
#: Quantiles of each label that make bins; points of the grid of raw scores; labelled rows that a task sums; unit of the sums.
BINS, GRID, TASK_ROWS, ONE = 12, 1024, 50_000, float(1 << 30)
FOLDS = 5
NAMES = ["words", "word_length", "upper", "digits", "marks", "spaces", "other", "capital_words", "repeats", "distinct", "top_word", "mark_runs", "end_marks", "bars", "line_length", "line_repeats", "mark_variety", "long_words", "capital_shouts", "bigram_repeats"]
_RUNS = re.compile(r"[^\w\s]{2,}")
_WORD_MARKS = re.compile(r"[^\w\s]+(?=\s|$)")


def features(text: str | None) -> list[float]:
    """Style of one whole text, shares where a length would count twice."""
    text = text or ""
    words, n = text.split(), max(1, len(text))
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits, spaces = sum(map(text.count, "0123456789")), text.count(" ") + text.count("\n")
    marks = {c: text.count(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}
    total = sum(marks.values())
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / k, upper / n, digits / n, total / n, spaces / n, 1 - len(text.encode("ascii", "ignore")) / n,
        sum(w[:1].isupper() for w in words) / k, sum(a == b for a, b in zip(words, words[1:])) / k, len(counts) / k**0.85, max(counts.values(), default=0) / k,
        len(_RUNS.findall(text)) / k, len(_WORD_MARKS.findall(text)) / k, marks["|"] / k, float(np.log1p(n / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(v > 0 for c, v in marks.items() if c not in ".,") / (1 + np.log1p(k)), sum(len(w) > 18 for w in words) / k, sum(w.isupper() and len(w) > 1 for w in words) / k, 1 - pairs / max(1, len(words) - 1),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["_row", "x"])


def _radix(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits in the order of single-precision values."""
    u = np.ascontiguousarray(x, "<f4").view("<u4")
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31))


def _edge(key: int) -> float:
    """The largest value with these first 24 bits."""
    u = key << 8 | 0xFF
    return float(np.array([u & 0x7FFFFFFF if u >> 31 else ~u & 0xFFFFFFFF], "<u4").view("<f4")[0])


def _counts(taught: DataFrame, bits: int, within: np.ndarray | None = None) -> dict[int, list[tuple[int, int]]]:
    """How many rows of each label and feature (2 * feature + label) begin with each ``bits`` bits; within: longer by 8 bits than these only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, x = _rows(batch)
                key = (2 * np.arange(x.shape[1]) + y[:, None]) << 32 | (_radix(x) >> np.uint32(32 - bits)).astype("i8")
                if within is not None:
                    key = key[np.isin(key >> 32 << 32 | (key & 0xFFFFFFFF) >> 8, within)]
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["k", "n"])

    out: dict[int, list[tuple[int, int]]] = {}
    for r in taught.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.k >> 32, []).append((r.k & 0xFFFFFFFF, r.n))
    return {k: sorted(v) for k, v in out.items()}


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().astype("i8"), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _edges(taught: DataFrame, bins: int) -> list[np.ndarray]:
    """Quantiles of both labels, so that a rare one has bins of its own: order statistics of all rows, rounded up in the 24th bit."""
    first = _counts(taught, 16)
    ranks, hit = {}, []
    for k, rows in first.items():
        key, n = np.array(rows).T
        ends = np.cumsum(n)
        want = np.unique(np.ceil(np.linspace(0, 1, bins + 1)[1:-1] * ends[-1]).astype("i8"))  # from 1
        at = np.searchsorted(ends, want)
        ranks[k] = [(int(key[i]), int(w - ends[i] + n[i])) for i, w in zip(at, want)]
        hit += [k << 32 | p for p, _ in ranks[k]]
    second = _counts(taught, 24, np.unique(np.array(hit, "i8")))
    out: list[list[float]] = [[] for _ in NAMES]
    for k, want in ranks.items():
        key, n = np.array(second[k]).T
        for p, w in want:
            own = key >> 8 == p
            out[k // 2].append(_edge(int(key[own][np.searchsorted(np.cumsum(n[own]), w)])))
    return [np.unique(e) for e in out]


class Ranker:
    """Strengths of quantile bins of features; score() is 0 to 1."""

    def __init__(self, edges: list[np.ndarray], threshold: float = THRESHOLD):
        self.edges, self.w = edges, np.zeros(sum(len(e) + 1 for e in edges))
        self.cut, self.slope, self.shift = 0.0, 1.0, float(np.log(threshold / (1 - threshold)))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        base = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])
        return np.stack([base[j] + np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w[self._bins(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut) + self.shift, -40, 40)))

    def codes(self, taught: DataFrame) -> DataFrame:
        """Rows (y, the bins of all features as 16-bit numbers)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    c = self._bins(_rows(batch)[1]).astype("<u2")
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in c], pa.binary())], ["y", "c"])

        return taught.mapInArrow(run, "y int, c binary")

    def learn(self, codes: DataFrame, n: tuple[int, int], ridge: float = 1e-3, rounds: int = 60, near: float = 1e-4) -> None:
        """Strengths of least logistic loss over all pairs of rows of both labels, then threshold and slope.

        Each step is a sum over all rows: the distribution of the raw scores of
        each label on a grid (a score counts for the two points beside it) gives
        the loss over all pairs and the pull on a score, and the pulls of all rows
        give the gradient, which goes to L-BFGS. Sums are of whole numbers, so
        they are the same in any order.
        """
        loss, pull = self._pairs(codes, self.w, ridge)
        grad = self._gradient(codes, self.w, n, pull, ridge)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            if np.abs(grad).max() < near:
                break
            way, kept = grad.copy(), []
            for s, y in reversed(past):
                a = (s @ way) / (s @ y)
                way -= a * y
                kept.append(a)
            way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.abs(grad).max()
            for (s, y), a in zip(past, reversed(kept)):
                way += (a - (y @ way) / (s @ y)) * s
            step = 1.0
            while step > 1e-3:
                w = self.w - step * way
                got, pull = self._pairs(codes, w, ridge)
                if got <= loss - 1e-4 * step * (grad @ way):
                    break
                step /= 2
            else:
                break
            new = self._gradient(codes, w, n, pull, ridge)
            if (w - self.w) @ (new - grad) > 1e-12:
                past = [*past[-9:], (w - self.w, new - grad)]
            self.w, grad, loss = w, new, got
        self._calibrate(codes, n)

    def _pairs(self, codes: DataFrame, w: np.ndarray, ridge: float) -> tuple[float, tuple[np.ndarray, ...]]:
        """(loss, (points, pull on rows of label 0, and of label 1)) at strengths w."""
        lo, hi = self._span(w)
        at = np.linspace(lo, hi, GRID)
        bad, good = (h / h.sum() for h in self._histogram(codes, w, lo, hi, GRID))
        diff = at[None, :] - at[:, None]  # of label 0 minus that of label 1
        pull = 1 / (1 + np.exp(-np.clip(diff, -500, 500)))
        loss = good @ np.logaddexp(0, diff) @ bad + ridge / 2 * (w @ w)
        return float(loss), (at, good @ pull, pull @ bad)

    def _span(self, w: np.ndarray) -> tuple[float, float]:
        """Bounds of all raw scores."""
        parts = np.split(w, np.cumsum([len(e) + 1 for e in self.edges])[:-1])
        lo, hi = sum(p.min() for p in parts), sum(p.max() for p in parts)
        return float(lo) - 1e-6, float(max(hi, lo + 1e-3)) + 1e-6

    def _histogram(self, codes: DataFrame, w: np.ndarray, lo: float, hi: float, points: int) -> np.ndarray:
        """Rows of each label at points between lo and hi, each split between the two beside its score; what lies beyond counts at the ends."""

        def each(batch: pa.RecordBatch) -> np.ndarray:
            y, s = _scores(batch, w)
            place = np.clip((s - lo) / (hi - lo) * (points - 1), 0, points - 1)
            cell = np.minimum(place.astype("i8"), points - 2)
            up = np.rint((place - cell) * ONE)
            cell = cell + y * points
            return np.bincount(cell, ONE - up, 2 * points) + np.bincount(cell + 1, up, 2 * points)

        return common.totals(codes, each, 2 * points).reshape(2, points) / ONE

    def _gradient(self, codes: DataFrame, w: np.ndarray, n: tuple[int, int], pull: tuple, ridge: float) -> np.ndarray:
        at, *by = pull

        def each(batch: pa.RecordBatch) -> np.ndarray:
            y, s = _scores(batch, w)
            force = np.rint(np.where(y == 1, np.interp(s, at, by[1]), np.interp(s, at, by[0])) * ONE)
            c = _code(batch).astype("i8") + len(w) * y[:, None]
            return np.bincount(c.ravel(), np.repeat(force, c.shape[1]), 2 * len(w))

        bad, good = common.totals(codes, each, 2 * len(w)).reshape(2, -1) / ONE
        return bad / n[0] - good / n[1] + ridge * w

    def _calibrate(self, codes: DataFrame, n: tuple[int, int]) -> None:
        """The cut below which the share of label 0 lies, and the slope that fits the labels best."""
        at, hist = np.linspace(*self._span(self.w), GRID), self._histogram(codes, self.w, *self._span(self.w), GRID)
        below, above = self._ranked(codes, n[0]), self._ranked(codes, n[0] + 1)
        self.cut = below + (above - below) * n[1] / sum(n)
        slopes = 2.0 ** np.arange(-4, 4)
        loss = [sum(hist[v] @ np.logaddexp(0, -(2 * v - 1) * (k * (at - self.cut) + self.shift)) for v in (0, 1)) for k in slopes]
        self.slope = float(slopes[int(np.argmin(loss))])

    def _ranked(self, codes: DataFrame, rank: int) -> float:
        """The raw score of this rank (from 1) among all rows, to the span by GRID cubed: the cell that holds it is divided."""
        lo, hi = self._span(self.w)
        for _ in range(3):
            k = int(np.searchsorted(np.cumsum(self._cells(codes, lo, hi)), rank)) - 1
            lo, hi = lo + (hi - lo) * k / GRID, lo + (hi - lo) * (k + 1) / GRID
        return hi

    def _cells(self, codes: DataFrame, lo: float, hi: float) -> np.ndarray:
        """Rows below lo, in each of GRID cells, and above hi."""

        def each(batch: pa.RecordBatch) -> np.ndarray:
            place = np.ceil((_scores(batch, self.w)[1] - lo) / (hi - lo) * GRID)
            return np.bincount(np.clip(place, 0, GRID + 1).astype("i8"), minlength=GRID + 2)

        return common.totals(codes, each, GRID + 2)


def _code(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, -1)


def _scores(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().astype("i8"), w[_code(batch)].sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> Ranker | None:
    """A ranker from all measured rows (_row.doc_id, x) with labels (doc_id, label); None without both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("_id")))
    taught = measured.select(F.col("_row.doc_id").cast("long").alias("_id"), "x").join(known, "_id").select("y", "x")
    taught = common.written(taught, "taught")
    n = {r.y: r.n for r in taught.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    ranker = Ranker(_edges(taught, BINS), threshold)
    # Few numbers a row, read in each step: tasks of a size that is worth one.
    codes = common.written(ranker.codes(taught).coalesce(-(-(n[0] + n[1]) // TASK_ROWS)), "codes")
    ranker.learn(codes, (n[0], n[1]))
    common.forget(taught)
    common.forget(codes)
    return ranker


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: _row (its columns but the text), score, predicted."""
    keep = [c for c in docs.columns if c != "text"]
    box = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col("text"))
    kind = box.select("_row").schema["_row"].dataType.simpleString()
    measured = common.written(box.mapInArrow(_measure, f"_row {kind}, x array<float>"), "features")
    ranker = fit(measured, labels, threshold=threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                s = ranker.score(x) if ranker else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["_row", "score"])

    out = measured.mapInArrow(run, f"_row {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learnt from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("_row.doc_id", held_out(F.col("_row.doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with their columns.

    Each text is measured once and written with its features, so no text is
    shuffled: labels meet ids and features only, at every size of the tables.
    """
    box = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    kind = box.select("_row").schema["_row"].dataType.simpleString()
    measured = common.written(box.mapInArrow(_measure, f"_row {kind}, x array<float>"), "features")
    ranker = fit(measured, labels, threshold=threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and ranker:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                batch = batch.filter(pa.array(ranker.score(x) >= threshold))
            yield batch.select(["_row"])

    return measured.mapInArrow(run, f"_row {kind}").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
