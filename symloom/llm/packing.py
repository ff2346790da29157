"""Operator 7: sequences of tokens filled by cutting-stock column generation.

Each document is its ids and an end id, cut into full pieces of the sequence
length and one remainder. Full pieces are sequences by themselves. The
remainders are a cutting-stock problem over the histogram of their lengths in
units of ``grain`` ids, rounded up (128 rows at most for 1024 and 8, so it is
solved on the driver whatever the corpus): the linear program over patterns
starts from patterns of one length and of two that fill a sequence, an unbounded
knapsack by dynamic programming prices new columns, and the rounded patterns are
dealt to the documents by their global rank within each length. What rounding
leaves (at most a few pieces a pattern) is packed best fit decreasing. Offsets
are sums of the true lengths, so the units cost padding at the end only: less
than ``grain`` ids a piece.

Defined cases: a null or empty text is its end id alone; rows with equal doc_id
are separate documents; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm import bpe, common

LENGTH = 1024
GRAIN = 8
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end_id: int, size: int):
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = bpe.encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.ids(text.as_py() or "") + tail
                n = len(ids) // 4
                out += [(doc, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _knapsack(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: how often it holds each length."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for w in range(int(lengths[0]), size + 1):
        k = fits[w]
        got = best[w - lengths[:k]] + value[:k]
        i = int(np.argmax(got))
        best[w], pick[w] = (got[i], i) if got[i] > best[w - 1] else (best[w - 1], -1)
    counts, w = np.zeros(len(lengths)), size
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            counts[pick[w]] += 1
            w -= int(lengths[pick[w]])
    return float(best[size]), counts


def patterns(histogram: dict[int, int], size: int = LENGTH, gap: float = 0.002, steps: int = 3000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how often}, times used) that hold every piece of the histogram exactly once.

    Column generation stops when the linear program is within ``gap`` of its
    lower bound (Farley's, or the sum of lengths) or after ``steps`` columns.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0), int)
    if not len(lengths):
        return []
    need = np.array([histogram[int(x)] for x in lengths], float)
    m, per = len(lengths), (size // lengths).astype(float)
    columns = [np.eye(m)[i] * per[i] for i in range(m)]
    pairs = [(i, int(j)) for i in range(m) if (j := np.searchsorted(lengths, size - lengths[i])) < m and i < j and lengths[i] + lengths[j] == size]
    inverse, x = np.diag(1 / per), need / per
    floor = float(lengths @ need) / size
    for k in range(steps):
        duals = inverse.sum(axis=0)
        if k < len(pairs):
            column = np.zeros(m)
            column[[*pairs[k]]] = 1
            value = float(duals @ column)
            if value <= 1 + 1e-9:
                continue
        else:
            value, column = _knapsack(lengths, np.maximum(duals, 0), size)
            floor = max(floor, x.sum() / max(value, 1))
        if value <= 1 + 1e-9 or x.sum() <= floor * (1 + gap):
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        step = max(0.0, ratio[r])
        x = np.maximum(x - step * d, 0)
        x[r] = step
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        columns[r] = column
    out, left = [], need.astype(int)
    for k in np.argsort(-x, kind="stable"):
        a = columns[k].astype(int)
        times = min(int(x[k] + 1e-6), *(int(left[i] // a[i]) for i in np.flatnonzero(a)))
        if times > 0:
            left = left - times * a
            out.append(({int(lengths[i]): int(a[i]) for i in np.flatnonzero(a)}, times))
    return out + _best_fit(lengths, left, size)


def _best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    rooms: list[tuple[int, int]] = []
    bins: list[dict[int, int]] = []
    for length, n in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        for _ in range(n):
            at = bisect_left(rooms, (length, -1))
            room, b = rooms.pop(at) if at < len(rooms) else (size, len(bins))
            if b == len(bins):
                bins.append({})
            bins[b][length] = bins[b].get(length, 0) + 1
            insort(rooms, (room - length, b))
    same: dict[tuple, int] = {}
    for b in bins:
        same[tuple(sorted(b.items()))] = same.get(tuple(sorted(b.items())), 0) + 1
    return [(dict(k), n) for k, n in same.items()]


class Plan:
    """Where the piece of each length and rank goes: (sequence, place in it)."""

    def __init__(self, used: list[tuple[dict[int, int], int]]):
        slots: dict[int, list[tuple]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for pattern, times in used:
            slot = 0
            for length, a in sorted(pattern.items(), reverse=True):
                slots.setdefault(length, []).append((ranks.get(length, 0), base, a, slot))
                ranks[length] = ranks.get(length, 0) + a * times
                slot += a
            base += times
        self.sequences = base
        self.slots = {k: np.array(v, "i8").T for k, v in slots.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, slot = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
        for x in np.unique(length):
            own = length == x
            first, base, each, slots = self.slots[int(x)]
            at = np.searchsorted(first, rank[own], side="right") - 1
            k = rank[own] - first[at]
            seq[own] = base[at] + k // each[at]
            slot[own] = slots[at] + k % each[at]
        return seq, slot


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded once, without a shuffle; pieces (a few numbers each) are
    ranked by (length in units, doc_id, start) over all partitions, and dealt
    once more by sequence, of which none holds more than ``size`` pieces.
    """
    rows = common.written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, end_id, size), _PIECES), "cut")
    rows = rows.withColumn("_units", F.when(F.col("length") < size, F.ceil(F.col("length") / grain)).otherwise(size // grain + 1))
    at = common.ranked(rows, "_units", "doc_id", "start", "doc_tokens", "ids_crc32", name="pieces")
    counts = at.groupBy("_units").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_first"))
    counts = counts.collect()  # a row for each length in units
    plan = Plan(patterns({r._units: r.n for r in counts if r._units <= size // grain}, size // grain))
    firsts = {r._units: r._first for r in counts}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("_units").to_numpy(zero_copy_only=False)
            rank = batch.column("_pos").to_numpy(zero_copy_only=False)
            rank = rank - np.array([firsts[int(x)] for x in units], "i8")
            seq, slot = plan.sequences + rank, np.zeros(len(rank), "i8")
            part = units <= size // grain
            seq[part], slot[part] = plan.place(units[part], rank[part])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq, pa.int64()), pa.array(slot, pa.int64())], [*batch.schema.names[:5], "sequence_id", "_slot"])

    cols = [c.split()[0] for c in _PIECES.split(", ")]
    out = at.select(*cols, "_units", "_pos").mapInArrow(place, f"{_PIECES}, sequence_id long, _slot long")
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_path())
