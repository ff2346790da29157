"""References to edges: the innermost containing symbol, then the target by priority.

Set-wise over the whole corpus, so the order in which files arrive has no
influence. No join pairs the references of a file with its symbols: the symbols
of a file are laid out once as stretches that don't overlap, and what a name
means in a file is found once for each such pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.text import file_stem, module_path

#: Bytes of a file, as a power of two, whose references are placed together.
_SHIFT = 20
_MOST = (1 << 63) - 1


def _last(x: str | Column) -> Column:
    """Nulls in order after all numbers."""
    return F.coalesce(x, F.lit(_MOST))


def _innermost(a: np.ndarray, b: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and owner of stretches: the owner is the narrowest of the ranges [a, b) there, the first of equal ones."""
    points = np.unique(np.concatenate([a, b]))
    lo, hi = np.searchsorted(points, a).tolist(), np.searchsorted(points, b).tolist()
    owner, free = [-1] * len(points), list(range(len(points) + 1))  # free: a step to the next stretch without an owner
    for k in np.lexsort((seq, b - a)).tolist():
        i = lo[k]
        while True:
            while free[i] != i:
                free[i] = free[free[i]]
                i = free[i]
            if i >= hi[k]:
                break
            owner[i], free[i] = k, i + 1
    own = np.array(owner)
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    stop = np.r_[points[new[1:]], points[-1:]]
    good = own[new] >= 0
    return points[new][good], stop[good], own[new][good]


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols sorted by file as stretches; a file's symbols are held together."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        a, b, seq = (t.column(c).to_numpy() for c in ("a", "b", "seq"))
        start, stop, own = _innermost(a, b, seq)
        rows = t.take(pa.array(own))
        return pa.Table.from_arrays([rows.column("file_path"), pa.array(start), pa.array(stop), rows.column("id"), rows.column("name"), pa.array((b - a)[own]), rows.column("seq")], ["file_path", "start", "stop", "id", "name", "w", "seq"])

    for batch in batches:
        names = batch.column("file_path").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1].column("file_path")[0].as_py() != names[lo]:
                yield from done().to_batches()
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from done().to_batches()


def stretches(symbols: DataFrame) -> DataFrame:
    """file_path, start, stop, id, name, w, seq: where each symbol is the innermost."""
    s = symbols.select("file_path", F.col("byte_start").cast("long").alias("a"), F.col("byte_end").cast("long").alias("b"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("id"), "name")
    s = s.where("a < b and file_path is not null").repartition("file_path").sortWithinPartitions("file_path", "seq", "id")
    return s.mapInArrow(_lay_out, "file_path string, start long, stop long, id long, name string, w long, seq long")


def _held(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """References in a symbol, with the innermost as src (its name, width and place beside it). Each meets the last stretch before it, in one sort."""
    s = stretches(symbols).withColumn("_cut", F.explode(F.sequence(F.shiftright("start", _SHIFT), F.shiftright(F.col("stop") - 1, _SHIFT))))
    s = s.select("file_path", "_cut", F.col("start").alias("_at"), F.struct("stop", F.col("id").alias("src"), F.col("name").alias("src_name"), "w", "seq").alias("_s"))
    r = references.where("byte_start is not null").select("file_path", F.shiftright(F.col("byte_start").cast("long"), _SHIFT).alias("_cut"), F.col("byte_start").cast("long").alias("_at"), F.struct("ref_id", "symbol_name").alias("_r"))
    order = Window.partitionBy("file_path", "_cut").orderBy("_at", F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(r, allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(order))
    return both.where("_r is not null and _at < _s.stop").select("_r.ref_id", "file_path", "_r.symbol_name", "_s.src", "_s.src_name", "_s.w", "_s.seq")


def containers(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, file_path, symbol_name, src: references in a symbol, with the innermost; outside any, a reference is dropped."""
    held = _held(references, symbols)
    return held.groupBy("ref_id", "file_path", "symbol_name").agg(F.min(F.struct("w", "seq", "src"))["src"].alias("src"))


def _local(held: DataFrame, symbols: DataFrame, how: str) -> DataFrame:
    """held with _near: (other, w, seq, dst) of the target in the reference's own file, the container itself first, then the shortest span."""
    best = F.min(F.struct(F.lit(True).alias("other"), _last(F.col("byte_end") - F.col("byte_start")).alias("w"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("dst")))
    s = symbols.groupBy("file_path", F.col("name").alias("symbol_name")).agg(best.alias("_near"))
    itself = F.struct(F.lit(False).alias("other"), "w", "seq", F.col("src").alias("dst"))
    return held.join(s, ["file_path", "symbol_name"], how).withColumn("_near", F.when(F.col("src_name") == F.col("symbol_name"), itself).otherwise(F.col("_near")))


def local_targets(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, src, dst for names defined in the reference's own file: the container itself first, then the shortest span."""
    rows = _local(_held(references, symbols), symbols, "inner")
    best = rows.groupBy("ref_id").agg(F.min(F.struct("_near", "src")).alias("_b"))
    return best.select("ref_id", "_b.src", F.col("_b")["_near"]["dst"].alias("dst"))


def global_targets(ask: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """file_path, symbol_name, _far: (ord, nested, path, byte_start, seq, dst, via) of what a name means outside the file; via import, top_level, nested.

    ask: file_path, symbol_name, each pair once. Imports that say the same count
    once, and of the symbols of a name in a file the first.
    """
    ref = F.col("symbol_name")
    named = F.exists("imported_names", lambda n: (n == ref) | n.endswith(F.concat(F.lit("."), ref)))
    module = F.col("source_module")
    as_module = (module == ref) | module.endswith(F.concat(F.lit("."), ref)) | module.endswith(F.concat(F.lit("::"), ref))
    said = imports.groupBy("file_path", "source_module", "imported_names").agg(F.min("ord").cast("long").alias("ord"))
    relevant = ask.join(said, "file_path").where(F.coalesce(named, F.lit(False)) | F.coalesce(as_module, F.lit(False)))
    relevant = relevant.groupBy("file_path", "symbol_name", module_path(F.coalesce(module, F.lit(""))).alias("_m")).agg(F.min("ord").alias("ord")).where("_m <> ''")
    nested = F.col("parent_id").isNotNull()
    first = F.min(F.struct(nested.alias("nested"), F.col("file_path").alias("path"), _last("byte_start").alias("byte_start"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("dst")))
    # By import, whether a symbol is nested has no weight.
    early = F.min(F.struct(_last("byte_start").alias("byte_start"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("long").alias("dst")))
    s = symbols.groupBy(F.col("name").alias("symbol_name"), F.col("file_path").alias("path")).agg(early.alias("_f"))
    through = relevant.join(s, "symbol_name").where(F.contains(file_stem(F.col("path")), F.col("_m")))
    by_import = F.struct("ord", F.lit(False).alias("nested"), "path", F.col("_f.byte_start").alias("byte_start"), F.col("_f.seq").alias("seq"), F.col("_f.dst").alias("dst"), F.lit("import").alias("via"))
    through = through.groupBy("file_path", "symbol_name").agg(F.min(by_import).alias("_through"))
    # Without an import the choice is the same for every file: one row for each name.
    rest = symbols.groupBy(F.col("name").alias("symbol_name")).agg(first.alias("_a"))
    via = F.when(F.col("_a.nested"), "nested").otherwise("top_level").alias("via")
    other = F.struct(F.lit(_MOST).alias("ord"), F.col("_a.nested").alias("nested"), F.col("_a.path").alias("path"), F.col("_a.byte_start").alias("byte_start"), F.col("_a.seq").alias("seq"), F.col("_a.dst").alias("dst"), via)
    out = ask.join(rest, "symbol_name").join(through, ["file_path", "symbol_name"], "left")
    return out.select("file_path", "symbol_name", F.coalesce("_through", other).alias("_far"))


def targets(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """ref_id, src, dst, via for each reference that resolves: in its own file if it can, else by global_targets()."""
    ask = references.select("file_path", "symbol_name").distinct()
    rows = _local(_held(references, symbols), symbols, "left").join(global_targets(ask, symbols, imports), ["file_path", "symbol_name"], "left")
    rows = rows.where("_near is not null or _far is not null")
    near = F.col("_near").isNotNull()
    best = F.min(F.struct((~near).alias("_away"), "_near", F.when(~near, F.col("_far")).alias("_far"), "src"))
    b = rows.groupBy("ref_id").agg(best.alias("_b")).select("ref_id", "_b.src", F.col("_b")["_near"].alias("n"), F.col("_b")["_far"].alias("f"))
    dst = F.coalesce("n.dst", "f.dst")
    via = F.when(F.col("n").isNull(), F.col("f.via")).when(F.col("src") == dst, "self").otherwise("local")
    return b.select("ref_id", "src", dst.alias("dst"), via.alias("via"))


def edges(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Distinct (src, dst, context)."""
    return targets(references, symbols, imports).select("src", "dst", F.lit("call").alias("context")).distinct()
