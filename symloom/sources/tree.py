"""A tree of source files as a table, and its parsed tables.

Spark's own file listing leaves out names that begin with _ or ., so the tree is
a Python data source with its own walk: the listing is split into partitions by
size, and content is read in them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from symloom.parsing import braces, python, ruby
from symloom.sources.filters import Rules, classify


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.content = options.get("content", "true") == "true"
        self.only = options.get("only")
        self.bytes = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[_Files]:
        found = []
        if self.only:
            full = os.path.join(self.root, self.only)
            found = [(self.only, os.stat(full).st_size)] if os.path.isfile(full) else []
        else:
            for at, dirs, names in os.walk(self.root, followlinks=False):
                dirs.sort()
                for n in names:
                    full = os.path.join(at, n)
                    if os.path.isfile(full) and not os.path.islink(full):
                        found.append((os.path.relpath(full, self.root).replace("\\", "/"), os.stat(full).st_size))
        out, run, held = [], [], 0
        for f in sorted(found):
            run.append(f)
            held += f[1] + 4096
            if held >= self.bytes:
                out.append(_Files(run))
                run, held = [], 0
        return [*out, _Files(run)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, size in partition.files:
            content = None
            if self.content:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
            yield path, size, content


class SourceTree(DataSource):
    """spark.read.format("srctree").load(root): path, size, content. Options: content, only, partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return "path string, size bigint, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, rules: Rules | None = None, only: str | None = None) -> DataFrame:
    """Classified listing of a tree, without content."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("srctree").option("content", "false")
    return classify((reader.option("only", only) if only else reader).load(root).drop("content"), rules)


def read(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("srctree")
    return (reader.option("only", only) if only else reader).load(root)


#: The nested tables of a parsed file: name to (field, type) each; owner is the parent's name.
_NESTED = {
    "symbols": {"seq": "int", "name": "string", "kind": "string", "visibility": "string", "signature": "string", "docstring": "string", "byte_start": "bigint", "byte_end": "bigint", "parent": "int", "owner": "string"},
    "imports": {"ord": "int", "raw_text": "string", "source_module": "string", "imported_names": "array<string>"},
    "refs": {"ord": "int", "symbol_name": "string", "byte_start": "bigint", "byte_end": "bigint"},
}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def parse_source(source: bytes, language: str):
    """The parser of a language."""
    if language == "python":
        return python.parse(source)
    return ruby.parse(source) if language == "ruby" else braces.parse(source, language)


def _rows(source: bytes, language: str) -> dict[str, list[tuple]]:
    """The nested tables of a source, as tuples in the order of their fields."""
    got = parse_source(source, language)
    up = [None if s.parent is None else got.symbols[s.parent].name for s in got.symbols]
    return {
        "symbols": [(i, s.name, s.kind, s.visibility, s.signature, s.docstring, s.start, s.end, s.parent, up[i]) for i, s in enumerate(got.symbols)],
        "imports": [(i, m.raw_text, m.module, m.names) for i, m in enumerate(got.imports)],
        "refs": [(i, *r) for i, r in enumerate(got.references)],
    }


def _nested(name: str, lists: list[list[tuple]]) -> pa.Array:
    fields = _NESTED[name]
    columns = list(zip(*chain.from_iterable(lists))) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, _ARROW[kind]) for c, kind in zip(columns, fields.values())], list(fields))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), structs)


def _parse(tables: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            hashes, errors, found = [], [], []
            for language, content in zip(batch.column("language").to_pylist(), batch.column("content")):
                digest = error = None
                rows: dict[str, list[tuple]] = {}
                try:
                    source = bytes(content.as_py())
                    source.decode("utf-8")
                    rows = _rows(source, language)
                    digest = str(xxhash.xxh3_64_intdigest(source))
                except Exception as e:  # a file that can't be read or parsed is a row with its error
                    error = f"{type(e).__name__}: {e}"[:500]
                hashes.append(digest)
                errors.append(error)
                found.append(rows)
            if batch.num_rows:
                nested = [_nested(t, [rows.get(t, []) for rows in found]) for t in tables]
                yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("language"), pa.array(hashes, pa.string()), pa.array(errors, pa.string()), *nested], ["path", "language", "hash", "error", *tables])

    return run


def content_hash(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda c: None if c is None else str(xxhash.xxh3_64_intdigest(bytes(c))))


def parse(files: DataFrame, *tables: str) -> DataFrame:
    """files (path, language, content) parsed: one row each, with an error for those that aren't UTF-8. tables: those of _NESTED that are read later; all if empty."""
    tables = tables or tuple(_NESTED)
    form = "".join(f", {t} array<struct<{','.join(f'{k}:{v}' for k, v in _NESTED[t].items())}>>" for t in tables if t in _NESTED)
    return files.select("path", "language", "content").mapInArrow(_parse(tuple(t for t in tables if t in _NESTED)), f"path string, language string, hash string, error string{form}")


def explode(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables of parsed files, those that were parsed for. Ids are hashes of path and place, so they don't depend on other files."""
    good = parsed.where("error is null")
    file_id = F.xxhash64("path")
    out = {"files": good.select(file_id.alias("file_id"), "path", "language", "hash", F.current_timestamp().alias("last_indexed"))}
    ident = lambda seq: F.xxhash64("path", seq)
    if "symbols" in parsed.columns:
        s = good.select("path", F.explode("symbols").alias("s"))
        out["symbols"] = s.select(
            ident(F.col("s.seq")).alias("id"), file_id.alias("file_id"), F.col("path").alias("file_path"), "s.seq", "s.name",
            F.when(F.col("s.parent").isNull(), F.concat_ws("::", "path", "s.name")).otherwise(F.concat_ws("::", "path", "s.owner", "s.name")).alias("qualified_name"),
            "s.kind", "s.visibility", "s.signature", "s.docstring", "s.byte_start", "s.byte_end",
            F.when(F.col("s.parent").isNotNull(), ident(F.col("s.parent"))).alias("parent_id"), F.col("s.owner").alias("parent_name"),
        )
    if "imports" in parsed.columns:
        i = good.select("path", F.explode("imports").alias("i"))
        out["imports"] = i.select(file_id.alias("file_id"), F.col("path").alias("file_path"), "i.ord", "i.raw_text", "i.source_module", "i.imported_names")
    if "refs" in parsed.columns:
        r = good.select("path", F.explode("refs").alias("r"))
        out["references"] = r.select(file_id.alias("file_id"), F.col("path").alias("file_path"), "r.ord", "r.symbol_name", "r.byte_start", "r.byte_end", F.lit("call").alias("context"))
    return out
