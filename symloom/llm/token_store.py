"""Operator 1: token ids in directly addressable codes.

File format. A store is a folder of two Parquet tables. ``segments`` has one row
for each run of whole documents (ids in ascending doc_id order): part, seg,
seg_start (ids of the part before it), n_docs, n_tokens and ``payload``, one
binary block that stands alone. ``parts`` has one row for each part: part, base
(ids of all parts before it), n_tokens. Parquet is only the container, so that
any store Spark reaches can hold it and a lost executor's work is redone.

payload, little-endian: magic ``DAC1``; u32 n_docs, u32 n_tokens, u8 levels,
u8 widths[levels], 2 spare bytes when needed to reach 4; i64 doc_id[n_docs] with
a bitmap of null ids; u32 first id position[n_docs + 1]; then each level:
u32 count, the chunks of ``width`` bits each (packed), and, but for the last
level, the continuation bitmap (bit 1: the id goes on in the next level) and its
rank directory: u32 of ones before each block of 512 bits.

An id is cut into chunks from its low bits; level k holds the k-th chunk of the
ids that have one. Id i is read without decoding anything else: chunk i of level
0, then, while its bit is 1, chunk rank1(i) of the next level. A range of ids is
a range of each level, so whole documents are read by vector operations. The
widths are those with the least bits for the segment's own lengths of ids, found
by dynamic programming.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm import bpe, common

MAGIC = b"DAC1"
BLOCK = 512
SEGMENT_TOKENS = 1 << 18


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, low bits first, with the least total bits for these ids."""
    if not len(ids):
        return [1]
    lengths = np.bincount(np.maximum(1, np.frexp(ids.astype("f8"))[1]), minlength=2)
    top = len(lengths) - 1
    beyond = np.append(lengths[::-1].cumsum()[::-1][1:], 0).astype("f8")  # ids of more than b bits
    cost, step = [0.0] * (top + 1), [0] * (top + 1)
    for b in range(top - 1, -1, -1):  # cost of the bits from b on, for ids that reach them
        cost[b], step[b] = min((beyond[b] * (w + (b + w < top) * (1 + 32 / BLOCK)) + cost[b + w], w) for w in range(1, top - b + 1))
    out, b = [], 0
    while b < top:
        out.append(step[b])
        b += step[b]
    return out


def _pack(values: np.ndarray, width: int) -> bytes:
    """Chunks of ``width`` bits one after the other: eight of them are ``width`` bytes, made in words of 64 bits."""
    n, words = -(-len(values) // 8), -(-width // 8)
    eight = np.zeros((8, n), "u8")
    eight.T.flat[: len(values)] = values
    out = np.zeros((n, words), "<u8")
    for k in range(8):
        word, bit = divmod(k * width, 64)
        out[:, word] |= eight[k] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= eight[k] >> np.uint64(64 - bit)
    raw = out.view("u1").reshape(n, 8 * words)[:, :width].tobytes()
    return raw[: (len(values) * width + 7) // 8]


def _unpack(buf: memoryview, first: int, last: int, width: int) -> np.ndarray:
    """Chunks first to last - 1 of a packed level."""
    lo, hi = first // 8, -(-last // 8)
    n, words = max(0, hi - lo), -(-width // 8)
    raw = np.zeros(n * width, "u1")
    own = np.frombuffer(buf[lo * width : hi * width], "u1")
    raw[: len(own)] = own
    eight = np.zeros((n, 8 * words), "u1")
    eight[:, :width] = raw.reshape(n, width)
    eight = eight.view("<u8")
    out, mask = np.empty((n, 8), "u4"), np.uint64((1 << width) - 1)
    for k in range(8):
        word, bit = divmod(k * width, 64)
        x = eight[:, word] >> np.uint64(bit)
        if bit + width > 64:
            x |= eight[:, word + 1] << np.uint64(64 - bit)
        out[:, k] = x & mask
    return out.ravel()[first - 8 * lo : last - 8 * lo]


_ONES = np.array([bin(i).count("1") for i in range(256)], "u4")


class Level:
    """One level of a segment: chunks, and below the last level a bitmap with its rank directory."""

    def __init__(self, width: int, count: int, chunks: memoryview, bitmap: memoryview | None, ranks: np.ndarray | None):
        self.width, self.count, self.chunks, self.bitmap, self.ranks = width, count, chunks, bitmap, ranks

    def rank(self, i: int) -> int:
        """Ones among the first i bits of the bitmap."""
        block = i // BLOCK
        lo, n = block * BLOCK // 8, i // 8
        ones = int(self.ranks[block]) + int(_ONES[np.frombuffer(self.bitmap[lo:n], "u1")].sum())
        return ones + int(_ONES[self.bitmap[n] & ((1 << (i % 8)) - 1)]) if i % 8 else ones


class Segment:
    """Reads a payload by position."""

    def __init__(self, payload: bytes):
        buf = memoryview(payload)
        if bytes(buf[:4]) != MAGIC:
            raise ValueError("not a token segment")
        self.n_docs, self.n_tokens, levels = struct.unpack_from("<IIB", buf, 4)
        widths = list(buf[13 : 13 + levels])
        at = 13 + levels
        at += -at % 4
        self.doc_ids = np.frombuffer(buf, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        nulls = (self.n_docs + 7) // 8
        self.null = np.unpackbits(np.frombuffer(buf, "u1", nulls, at), bitorder="little")[: self.n_docs].astype(bool)
        at += nulls
        self.first = np.frombuffer(buf, "<u4", self.n_docs + 1, at)
        at += 4 * (self.n_docs + 1)
        self.levels = []
        for k, w in enumerate(widths):
            (count,) = struct.unpack_from("<I", buf, at)
            at += 4
            size = (count * w + 7) // 8
            chunks, bitmap, ranks = buf[at : at + size], None, None
            at += size
            if k + 1 < levels:
                size = (count + 7) // 8
                bitmap = buf[at : at + size]
                at += size
                ranks = np.frombuffer(buf, "<u4", count // BLOCK + 1, at)
                at += 4 * (count // BLOCK + 1)
            self.levels.append(Level(w, count, chunks, bitmap, ranks))

    def __getitem__(self, i: int) -> int:
        """Id i alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for level in self.levels:
            out |= int(_unpack(level.chunks, i, i + 1, level.width)[0]) << shift
            shift += level.width
            if level.bitmap is None or not level.bitmap[i // 8] >> (i % 8) & 1:
                break
            i = level.rank(i)
        return out

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1."""
        out, where, shift = np.zeros(last - first, "u4"), np.arange(last - first), 0
        for level in self.levels:
            if first >= last:
                break
            out[where] |= _unpack(level.chunks, first, last, level.width) << np.uint32(shift)
            shift += level.width
            if level.bitmap is None:
                break
            raw = np.unpackbits(np.frombuffer(level.bitmap[first // 8 : (last + 7) // 8], "u1"), bitorder="little")
            where = where[raw[first % 8 : first % 8 + last - first].astype(bool)]
            first, last = level.rank(first), level.rank(last)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.first[k]), int(self.first[k + 1]))


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The payload of whole documents."""
    widths = best_widths(ids)
    head = MAGIC + struct.pack("<IIB", len(doc_ids), len(ids), len(widths)) + bytes(widths)
    head += b"\0" * (-len(head) % 4)
    null = np.array([d is None for d in doc_ids], bool)
    out = [head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(null, bitorder="little").tobytes()]
    out.append(np.concatenate([[0], np.cumsum(lengths)]).astype("<u4").tobytes())
    rest = ids.astype("u4")
    for k, w in enumerate(widths):
        out += [struct.pack("<I", len(rest)), _pack(rest & np.uint32((1 << w) - 1), w)]
        if k + 1 < len(widths):
            rest = rest >> np.uint32(w)
            more = rest > 0
            bits = np.packbits(more, bitorder="little").tobytes()
            ones = np.concatenate([[0], np.cumsum(more)])[::BLOCK]
            out += [bits, ones[: len(more) // BLOCK + 1].astype("<u4").tobytes()]
            rest = rest[more]
    return b"".join(out)


_SEGMENTS = "part long, seg long, seg_start long, n_docs long, n_tokens long, payload binary"


def _segments(path: str, end_id: int | None, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = bpe.encoder(path), TaskContext.get().partitionId()
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        docs, lengths, raw, seg, start, held = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raw), "<u4")
            row = [part, seg, start, len(docs), len(ids), encode_segment(docs, lengths, ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 5 + [pa.binary()])], ["part", "seg", "seg_start", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), code.many(batch.column(1))):
                docs.append(doc)
                lengths.append((len(ids) + len(tail)) // 4)
                raw += (ids, tail)
                held += lengths[-1]
                if held >= budget:
                    yield flush()
                    docs, lengths, raw, seg, start, held = [], [], [], seg + 1, start + held, 0
        if docs:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2, segment_tokens: int = SEGMENT_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts in ascending id order and write a store at ``path``.

    A null text is empty; a null id comes first; rows with equal ids are kept,
    in the order of a hash of their texts. Columns but the two named are not
    read. Texts are dealt into ranges of id, hash and row number before they are
    encoded, so each is shuffled once and encoded once, and one id may have rows
    in many ranges; a segment holds whole documents and at least
    ``segment_tokens`` ids, but for the last of a part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("_same", F.xxhash64("text"))
    by = ["doc_id", "_same", F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(common.width(docs.sparkSession), *by).sortWithinPartitions("doc_id", "_same", "text").drop("_same")
    rows.mapInArrow(_segments(vocabulary, end_id, segment_tokens), _SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    sizes = docs.sparkSession.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``, the ids of all segments before; parts has one row for each part written."""
    parts = spark.read.schema("part long, n_tokens long, base long").parquet(f"{path}/parts").select("part", "base")
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("seg_start"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            seg = Segment(payload.as_py())
            ids, cuts = memoryview(seg.slice(0, seg.n_tokens).astype("<u4").tobytes()), (4 * seg.first.astype("i8")).tolist()
            crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seg.doc_ids, pa.int64(), mask=seg.null),
                    pa.array(start + seg.first[:-1].astype("i8"), pa.int64()),
                    pa.array(np.diff(seg.first).astype("i8"), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    return read_segments(spark, path).select("start", "payload").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, id) of single ids, each read from its own segment only; positions beyond the store give no row."""
    want = sorted(set(positions))
    hit = F.exists(F.lit(want).cast("array<bigint>"), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                seg = Segment(payload.as_py())
                own = [p for p in want if start <= p < start + seg.n_tokens]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([seg[p - start] for p in own], pa.int64())], ["position", "id"])

    return read_segments(spark, path).where(hit).select("start", "payload").mapInArrow(run, "position long, id long")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` written to a store and read back from it."""
    path = common.scratch(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, bpe.default_path())
    return digest(spark, path)
