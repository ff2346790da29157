"""The named queries of an index, each as a DataFrame, most with a text view."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import catalog as C
from symloom.functions import text as X
from symloom.operators import graph, ranking, render, retrieval, tables
from symloom.sources import tree
from symloom.sources.config import Config
from symloom.sources.filters import summary


class SymbolNotFound(LookupError):
    """No symbol has that name."""

    code = "SYMBOL_NOT_FOUND"


class Index:
    """An index folder and the source tree it was made from."""

    def __init__(self, spark: SparkSession, root: str, path: str | None = None, config: Config | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = C.Catalog(spark, path or f"{self.root}/.symloom")
        self.config = config or Config.load(f"{self.root}/.symloom.toml")
        self._held: dict[str, DataFrame] = {}

    # Tables, read once for each version of the index

    def _table(self, name: str) -> DataFrame:
        key = f"{name}@{(self.catalog.versions() or [0])[-1]}"
        if key not in self._held:
            self._held[key] = self.catalog.table(name)
        return self._held[key]

    @property
    def symbols(self) -> DataFrame:
        return self._table("symbols")

    @property
    def imports(self) -> DataFrame:
        return self._table("imports")

    @property
    def edges(self) -> DataFrame:
        return graph.build(self.symbols, self._table("edges"))

    def ranks(self) -> DataFrame:
        """PageRank, computed once for each version of the index."""
        key = f"ranks@{(self.catalog.versions() or [0])[-1]}"
        if key not in self._held:
            self._held[key] = graph.pagerank(self.symbols.select("id"), tables.written(self.edges))
        return self._held[key]

    # Ingest

    def reindex(self, path: str | None = None) -> dict[str, int]:
        """Index what is new or changed and drop what is gone; with a path, that file only, under the same filters."""
        files = tables.written(tree.scan(self.spark, self.root, self.config.rules(), only=path))
        counts = summary(files).first().asDict()
        good = files.where("reason is null").select("path", "language")
        content = tree.read(self.spark, self.root, only=path).join(good, "path")
        digest = F.pandas_udf(tree.content_hash, "string")
        scanned = tables.written(content.select("path", "language", "content", digest("content").alias("hash")))
        stored = self._table("files").select("path", "hash")
        if path:
            stored = stored.where(F.col("path") == path)
        change = tables.written(C.diff(scanned.select("path", "hash"), stored))
        todo = change.where("status in ('new', 'changed')")
        parsed = tables.written(tree.parse(scanned.join(todo.select("path"), "path")))
        gone = change.where("status = 'deleted'").select("path")
        n = {r.status: r.n for r in change.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        errors = parsed.where("error is not null").count()
        if n.get("new", 0) + n.get("changed", 0) + n.get("deleted", 0):
            self.catalog.upsert(tree.explode(parsed), gone)
        return counts | {"indexed": n.get("new", 0) + n.get("changed", 0) - errors, "unchanged": n.get("unchanged", 0), "deleted": n.get("deleted", 0), "errors": errors}

    def watch(self, checkpoint: str):
        """A streaming query that reindexes when files of the tree change."""
        from symloom.streaming.changes import watch

        def run(batch: DataFrame, _: int) -> None:
            if batch.limit(1).count():
                self.reindex()

        return watch(self.spark, self.root).where("path not like '.symloom%'").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()

    # Queries

    def index_status(self) -> DataFrame:
        return self.catalog.stats()

    def map_overview(self, max_chars: int = 120_000, detail: str = "full") -> DataFrame:
        s = self.index_status().first()
        line = f"Codebase: {s.n_files} files, {s.n_symbols} symbols, {s.n_imports} imports\n" + "\n" * (detail == "tree")
        return render.map_overview(self.symbols, detail, max_chars, len(line))

    def find_symbol(self, name: str, kind: str | None = None) -> DataFrame:
        found = retrieval.find(self.symbols, name, kind)
        if not found.limit(1).count():
            raise SymbolNotFound(name)
        return found

    def read_source(self, symbol: str, max_chars: int = 20_000, mode: str = "full") -> DataFrame:
        """file_path, line, source of the first such symbol; mode skeleton: its signature and those of its children."""
        first = self.find_symbol(symbol).limit(1)
        if mode == "skeleton":
            kids = self.symbols.where("parent_id is not null").join(F.broadcast(first.select(F.col("id").alias("parent_id"))), "parent_id")
            lines = kids.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "seq", "signature"))), lambda k: F.concat(F.lit("  "), k["signature"], F.lit("\n"))), "").alias("_k"))
            body = F.when(F.col("_k") == "", "  ...\n").otherwise(F.col("_k"))
            return first.crossJoin(lines).select("file_path", F.concat("signature", F.lit("\n"), body).alias("source"))
        path = first.first().file_path
        text = tree.read(self.spark, self.root, only=path).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("_s"))
        both = first.join(text, "file_path")
        part = X.byte_slice(F.col("_s"), F.col("byte_start"), F.col("byte_end"))
        both = both.withColumns({"line": X.line_number(F.col("_s"), F.col("byte_start")), "_t": part})
        return both.select("file_path", "line", X.head_tail(F.col("_t"), max_chars).alias("source"))

    def search_symbols(self, query: str, max_results: int = 10) -> DataFrame:
        return retrieval.search(self.symbols, query, max_results)

    def get_skeleton(self, file_path: str) -> DataFrame:
        text = tree.read(self.spark, self.root, only=file_path).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("source"))
        return render.skeletons(self.symbols.where(F.col("file_path") == file_path), text)

    def _starts(self, symbol: str) -> DataFrame:
        starts = tables.written(graph.start_ids(self.symbols, symbol))
        if not starts.limit(1).count():
            raise SymbolNotFound(symbol)
        return starts

    def _named(self, ids: DataFrame) -> DataFrame:
        """ids with what their symbols say; an id without a symbol is unknown."""
        got = ids.join(self.symbols.select("id", "qualified_name", "kind", "file_path", "signature"), "id", "left")
        return got.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("qualified_name", "kind", "file_path")})

    def get_dependencies(self, symbol: str, direction: str = "both", max_results: int = 20) -> DataFrame:
        """Neighbours in the order of their names; ``total`` is how many there are."""
        near = graph.neighbours(self.edges, self._starts(symbol), direction)
        names = self._named(near).dropDuplicates(["qualified_name"])
        total = names.agg(F.count(F.lit(1)).alias("total"))
        return names.crossJoin(F.broadcast(total)).orderBy("qualified_name").limit(max_results)

    def get_impact(self, symbol: str, max_depth: int = 3, max_results: int = 30) -> DataFrame:
        """What depends on a symbol, by file; ``total`` and ``total_files`` count all of it."""
        hit = graph.impact(tables.written(self.edges), self._starts(symbol), max_depth)
        rows = tables.written(self._named(hit))
        total = rows.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("file_path").alias("total_files"))
        return rows.crossJoin(F.broadcast(total)).orderBy("file_path", "qualified_name", "id").limit(max_results)

    def trace_data_flow(self, symbol: str, max_depth: int = 3, max_results: int = 20) -> DataFrame:
        """direction, qualified_name, depth, score; at most max_results in each direction."""
        rows = self._named(graph.trace(tables.written(self.edges), self._starts(symbol), max_depth)).join(self.ranks(), "id", "left")
        rows = rows.groupBy("direction", "qualified_name").agg(F.min("depth").alias("depth"), F.max("score").alias("score"), F.first("kind").alias("kind"), F.first("file_path").alias("file_path"))
        sides = [rows.where(F.col("direction") == side).orderBy("depth", F.desc("score"), "qualified_name").limit(max_results) for side in ("upstream", "downstream")]
        return sides[0].unionByName(sides[1])

    def get_ranked_symbols(self, top_n: int = 10, kind: str | None = None, path: str | None = None) -> DataFrame:
        return graph.ranked(self.symbols, self.ranks(), top_n, kind, path)

    def compress_context(self, query: str, token_budget: int | None = None) -> DataFrame:
        return ranking.compress_context(self.symbols, query, self.config.default_token_budget if token_budget is None else token_budget)

    def pack_repo(self, token_budget: int | None = None, format: str = "xml") -> DataFrame:
        budget = self.config.default_token_budget if token_budget is None else token_budget
        return (ranking.pack_json if format == "json" else ranking.pack_xml)(self.symbols, budget)

    def search_imports(self, query: str, max_results: int = 30) -> DataFrame:
        return retrieval.search_imports(self.imports, query, max_results)


def packed_text(packed: DataFrame) -> str:
    """The artefact of pack_repo(); its size is bounded by the budget."""
    rows = packed.collect()
    if "block" in packed.columns:
        return "<repo>\n" + "".join(r.block for r in rows) + "</repo>\n"
    return json.dumps({"files": [{"path": r.file_path, "symbols": r.symbols} for r in rows]}, indent=2, ensure_ascii=False)


def score_text(rows: DataFrame) -> DataFrame:
    """Scores with six digits."""
    return rows.withColumn("score", F.format_string("%.6f", "score"))


def _by_file(rows: list, line) -> str:
    out, at = "", None
    for r in rows:
        if r.file_path != at:
            at = r.file_path
            out += f"{at}:\n"
        out += line(r)
    return out


def impact_text(impact: DataFrame) -> str:
    """get_impact() by file, with totals and what is left out; its rows are bounded by max_results."""
    rows = impact.collect()
    if not rows:
        return "Nothing depends on it\n"
    total, files = rows[0].total, rows[0].total_files
    out = f"{total} affected symbols across {files} files\n" + _by_file(rows, lambda r: f"  {r.qualified_name}\n")
    more = f"... and {total - len(rows)} more symbols in {files - min(files, len(rows))} files\n"
    return out + more * (total > len(rows))


def dependencies_text(near: DataFrame) -> str:
    """get_dependencies() a line each, with what is left out."""
    rows = near.collect()
    out = "".join(f"{r.qualified_name} [{r.kind}] {r.file_path}\n" for r in rows)
    return out + (f"... and {rows[0].total - len(rows)} more\n" if rows and rows[0].total > len(rows) else "")


def imports_text(found: DataFrame) -> str:
    """search_imports() by file."""
    rows = found.collect()
    return f"{len(rows)} imports across {len({r.file_path for r in rows})} files\n" + _by_file(rows, lambda r: f"  {r.raw_text}\n")
