"""Relevance of symbols to a query: TF-IDF with boosts, and selection under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import query_terms, terms, token_estimate
from symloom.operators.tables import running, written


def document_terms(symbols: DataFrame) -> DataFrame:
    """symbols with _terms: name, qualified name, signature, path and docstring, a name counting in each."""
    return symbols.withColumn("_terms", terms(F.concat_ws(" ", "name", "qualified_name", "signature", "file_path", "docstring")))


def document_frequency(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """term, df over docs with _terms; only the wanted terms where given."""
    each = docs.select(F.explode(F.array_distinct("_terms")).alias("term"))
    return (each.where(F.col("term").isin(wanted)) if wanted is not None else each).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(symbols: DataFrame, query: str, boosts: bool = True) -> DataFrame:
    """symbols with score. Frequencies are taken of the query's terms only, in one pass, as one row."""
    words = query_terms(query)
    if not words:
        return symbols.withColumn("score", F.lit(0.0))
    docs, distinct = document_terms(symbols), sorted(set(words))
    has = {t: F.array_contains("_terms", t) for t in distinct}
    counts = docs.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(has[t]).alias(f"_df{i}") for i, t in enumerate(distinct)])
    docs = docs.crossJoin(F.broadcast(counts))  # one row
    size = F.greatest(F.size("_terms"), F.lit(1))
    score, matched = F.lit(0.0), F.lit(0)
    qn, name, path = F.lower(F.coalesce("qualified_name", F.lit(""))), F.lower("name"), F.lower("file_path")
    for t in words:
        tf = F.size(F.filter("_terms", lambda x: x == t)) / size  # noqa: B023  built at once
        df = F.col(f"_df{distinct.index(t)}")
        long = len(t.encode()) > 2
        part = F.when(has[t], tf * (F.ln(F.col("_n") / (df + 1)) + 1) if long else tf).otherwise(0.0)
        if boosts:
            hit = F.when(qn == t, 6.0).when(name == t, 5.0)
            if long:
                hit = hit.when(F.contains(qn, F.lit(t)), 2.5).when(F.contains(name, F.lit(t)), 2.0)
                part = part + F.when(F.contains(path, F.lit(t)), 1.5).otherwise(0.0)
            part = part + hit.otherwise(0.0)
        score, matched = score + part, matched + has[t].cast("int")
    if boosts and len(words) >= 2:
        score = score * F.when(matched >= 2, 1 + matched / F.lit(float(len(words)))).otherwise(1.0)
    drop = ["_terms", "_n", *[f"_df{i}" for i in range(len(distinct))]]
    return docs.withColumn("score", score).drop(*drop)


#: Rows that one step of the selection brings to the driver.
STEP = 1000


def greedy(ranked: DataFrame, budget: int, cost: Column | None = None, step: int = STEP) -> DataFrame:
    """Rows taken in the order of score while they fit; what doesn't fit is skipped and the rest goes on.

    The selection is sequential by definition: it looks at the next ``step`` rows
    in order that cost no more than what is left, a top-k without a full sort,
    and goes on behind them until nothing is left or nothing fits. What has been
    taken spends the budget, so it is at most ``budget`` rows, besides rows that
    cost nothing. ``take`` is the order of selection; rows of equal keys go by id.
    """
    cost = token_estimate(F.col("signature")) if cost is None else cost
    rows = ranked.withColumn("_cost", cost).where(F.col("score") > 0)
    rows = rows.select((-F.col("score")).alias("s"), "file_path", "byte_start", "seq", "id", F.col("_cost").alias("c"))
    order = ["s", "file_path", "byte_start", "seq", "id"]
    left, taken = budget, []
    while left > 0 or not taken:
        rows = rows.where(F.col("c") <= left)
        near = rows.orderBy(*order).limit(step).collect()
        for x in near:
            if x.c <= left and (left > 0 or not taken):
                left -= x.c
                taken.append((x.id, len(taken)))
        if len(near) < step:
            break
        end = near[-1]
        behind = F.struct(*order) > F.struct(*[F.lit(end[k]).cast(rows.schema[k].dataType) for k in order])
        rows = written(rows.where(behind & (F.col("c") <= left)))
    kind = ranked.schema["id"].dataType.simpleString()
    picked = ranked.sparkSession.createDataFrame(taken, f"id {kind}, take int")
    return ranked.join(picked, "id")


def compress_context(symbols: DataFrame, query: str, budget: int = 32000) -> DataFrame:
    """One row for each file that has selected symbols: file_path, block of text, tokens."""
    picked = greedy(tfidf(symbols, query), budget)
    rows = picked.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("take", "signature"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: F.concat(x["signature"], F.lit("\n"))), "")
    out = rows.select("file_path", F.concat(F.lit("// "), "file_path", F.lit("\n"), lines, F.lit("\n")).alias("block"), F.size("r").alias("n_symbols"))
    return out.orderBy("file_path")


def _prefix(blocks: DataFrame, budget: int, base: int, cost: Column) -> DataFrame:
    """Blocks in path order up to the first that overflows the budget."""
    rows = running(blocks.withColumn("cost", cost), "file_path", "cost")
    rows = rows.withColumn("used_tokens", F.lit(base) + F.col("before") + F.col("cost"))
    return rows.where(F.col("used_tokens") <= budget).drop("before").orderBy("file_path")


def _by_file(symbols: DataFrame) -> DataFrame:
    rows = symbols.where("parent_id is null").groupBy("file_path")
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "seq", "signature"))), lambda x: x["signature"]).alias("_s"))


def pack_xml(symbols: DataFrame, budget: int = 32000) -> DataFrame:
    """file_path, block, cost, used_tokens for each file that fits."""
    body = F.array_join(F.transform("_s", lambda s: F.concat(s, F.lit("\n"))), "")
    block = F.concat(F.lit('<file path="'), "file_path", F.lit('">\n'), body, F.lit("</file>\n"))
    return _prefix(_by_file(symbols).select("file_path", block.alias("block")), budget, 2, token_estimate(F.col("block")))


def pack_json(symbols: DataFrame, budget: int = 32000) -> DataFrame:
    """file_path, symbols, cost, used_tokens for each file that fits."""
    return _prefix(_by_file(symbols).select("file_path", F.array_join("_s", "\n").alias("symbols")), budget, 20, token_estimate(F.col("symbols")) + 20)
