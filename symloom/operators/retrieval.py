"""Lookups: exact, fuzzy with a rank, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import ascii_lower, like
from symloom.operators.tables import in_list_order

FIELDS = ("qualified_name", "name", "file_path", "signature", "docstring")
WEIGHTS = {"qualified_name": -12, "name": -10, "file_path": -5, "signature": -3, "docstring": -1}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _text(name: str) -> Column:
    return F.coalesce(name, F.lit(""))


def find(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Symbols whose qualified or bare name equals ``name``, in list order."""
    hit = (F.col("qualified_name") == name) | (F.col("name") == name)
    return in_list_order(symbols.where(hit & (F.col("kind") == kind) if kind else hit))


def fuzzy_filter(query: str) -> Column:
    """Any word of more than two bytes anywhere in a field; with short words only, equality, prefixes and path segments."""
    words = query.split()
    long = [w for w in words if len(w.encode()) > 2]
    if long:
        return _any([like(_text(f), f"%{w}%") for w in long for f in FIELDS])
    tests = []
    for w in words:
        low = "".join(c.lower() if c.isascii() else c for c in w)
        for f in ("name", "qualified_name"):
            tests += [ascii_lower(_text(f)) == low, like(_text(f), f"{w}%")]
        tests.append(like(_text("file_path"), f"%/{w}%"))
    return _any(tests) if tests else F.lit(False)


def fuzzy_rank(query: str) -> Column:
    """Lower is better: the whole query as a name, then the best field of each word, then the kind."""
    rank = F.when((F.col("name") == query) | (F.col("qualified_name") == query), -100).otherwise(0)
    for w in query.split():
        case: Column | None = None
        for f, weight in WEIGHTS.items():
            test = like(_text(f), f"%{w}%")
            case = F.when(test, weight) if case is None else case.when(test, weight)
        rank = rank + case.otherwise(0)
    return rank + F.when(F.col("kind") == "variable", 5).when(F.col("kind") == "const", 3).otherwise(0)


def search(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best symbols of a query, with their rank."""
    hit = symbols.where(fuzzy_filter(query)).withColumn("rank", fuzzy_rank(query))
    return hit.orderBy("rank", "file_path", "byte_start", "seq").limit(limit)


def search_imports(imports: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Imports that hold any word; words of one or two bytes are whole module segments."""
    module, tests = _text("source_module"), []
    for w in query.split():
        if len(w.encode()) <= 2:
            tests += [module == w, like(module, f"{w}/%"), like(module, f"%/{w}")]
        else:
            tests += [like(_text("raw_text"), f"%{w}%"), like(module, f"%{w}%")]
    return imports.where(_any(tests) if tests else F.lit(False)).orderBy("file_path", "ord").limit(limit)
