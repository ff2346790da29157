"""Registered queries of the parsers: one source of each language for every row of ``part``, with the rows expected.

The sources have the part's key wherever a ``$`` stands. What is expected is
stated by hand next to each; offsets are found by DuckDB in the source itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.plans import adapters as A
from symloom.plans.queries import query
from symloom.sources import tree


#: Sources of a task: at least, where there are tasks for all cores, and at most.
FEW, MANY = 200, 20_000


@dataclass
class Sample:
    """symbols: (name, kind, visibility, signature, docstring, text, parent); imports: (text, module, names); calls: (name, text that begins with what is called)."""

    source: str
    symbols: list[tuple]
    imports: list[tuple]
    calls: list[tuple]


SAMPLES = {
    "python": Sample(
        'import box$\nfrom pkg import lid$\n\nMAX = 1$\n\nclass Tower$(Base):\n    """Tall $."""\n\n    def _rise(self, a):\n        return help$(a)\n\ndef help$(x):\n    return lid$(x)\n',
        [
            ("MAX", "const", "public", "MAX = 1$", None, "MAX = 1$", None),
            ("Tower$", "class", "public", "class Tower$(Base):", "Tall $.", 'class Tower$(Base):\n    """Tall $."""\n\n    def _rise(self, a):\n        return help$(a)', None),
            ("_rise", "method", "private", "def _rise(self, a):", None, "def _rise(self, a):\n        return help$(a)", 1),
            ("help$", "function", "public", "def help$(x):", None, "def help$(x):\n    return lid$(x)", None),
        ],
        [("import box$", "box$", "box$"), ("from pkg import lid$", "pkg", "pkg,lid$")],
        [("help$", "help$(a)"), ("lid$", "lid$(x)")],
    ),
    "typescript": Sample(
        "import { lid$ } from './pkg';\nexport interface Shape$ { area(): number; }\nexport class Box$ {\n  open(a: string) { return lid$(a); }\n}\nfunction plain$() { return 1; }\n",
        [
            ("Shape$", "interface", "public", "interface Shape$", None, "interface Shape$ { area(): number; }", None),
            ("Box$", "class", "public", "class Box$", None, "class Box$ {\n  open(a: string) { return lid$(a); }\n}", None),
            ("open", "method", "public", "open(a: string)", None, "open(a: string) { return lid$(a); }", 1),
            ("plain$", "function", "internal", "function plain$()", None, "function plain$() { return 1; }", None),
        ],
        [("import { lid$ } from './pkg'", "./pkg", "lid$")],
        [("lid$", "lid$(a)")],
    ),
    "javascript": Sample(
        'import lid$ from "pkg";\nclass Box$ {\n  open() { return lid$(1); }\n}\nexport function free$(x) { return x; }\n',
        [
            ("Box$", "class", "internal", "class Box$", None, "class Box$ {\n  open() { return lid$(1); }\n}", None),
            ("open", "method", "public", "open()", None, "open() { return lid$(1); }", 0),
            ("free$", "function", "public", "function free$(x)", None, "function free$(x) { return x; }", None),
        ],
        [('import lid$ from "pkg"', "pkg", "lid$")],
        [("lid$", "lid$(1)")],
    ),
    "rust": Sample(
        "use std::map$;\npub struct Point$ { x: u8 }\nimpl Point$ { fn draw(&self) { paint$(1); } }\nconst MAX$: u8 = 3;\npub fn free$(x: u8) -> u8 { x }\n",
        [
            ("Point$", "type", "public", "pub struct Point$", None, "pub struct Point$ { x: u8 }", None),
            ("Point$::draw", "method", "private", "fn draw(&self)", None, "fn draw(&self) { paint$(1); }", None),
            ("MAX$", "const", "private", "const MAX$: u8 = 3;", None, "const MAX$: u8 = 3;", None),
            ("free$", "function", "public", "pub fn free$(x: u8) -> u8", None, "pub fn free$(x: u8) -> u8 { x }", None),
        ],
        [("use std::map$;", "std::map$", "std::map$")],
        [("paint$", "paint$(1)")],
    ),
    "go": Sample(
        'package main\n\nimport "fmt$"\n\ntype Server struct {\n\tport$ int\n}\n\nfunc (s *Server) Start$() {\n\tstop$(1)\n}\n\nfunc stop$(x int) {\n}\n',
        [
            ("Server", "type", "public", "Server struct", None, "Server struct {\n\tport$ int\n}", None),
            ("Server.Start$", "method", "public", "func (s *Server) Start$()", None, "func (s *Server) Start$() {\n\tstop$(1)\n}", None),
            ("stop$", "function", "private", "func stop$(x int)", None, "func stop$(x int) {\n}", None),
        ],
        [('import "fmt$"', "fmt$", "fmt$")],
        [("stop$", "stop$(1)")],
    ),
    "java": Sample(
        "package a;\nimport java.util.List$;\npublic class Order$ {\n    public static final int MAX = 3;\n    private int size() { return count$(1); }\n}\ninterface Item$ { }\n",
        [
            ("Order$", "class", "public", "public class Order$", None, "public class Order$ {\n    public static final int MAX = 3;\n    private int size() { return count$(1); }\n}", None),
            ("MAX", "const", "public", "public static final int MAX = 3;", None, "public static final int MAX = 3;", 0),
            ("size", "method", "private", "private int size()", None, "private int size() { return count$(1); }", 0),
            ("Item$", "interface", "internal", "interface Item$", None, "interface Item$ { }", None),
        ],
        [("import java.util.List$;", "java.util.List$", "List$")],
        [("count$", "count$(1)")],
    ),
    "c": Sample(
        "#include <std$.h>\nstruct node$ { int a; };\nstatic const int MAX$ = 5;\nint add$(int a) { return sum$(a); }\n",
        [
            ("node$", "type", "public", "struct node$ { int a; }", None, "struct node$ { int a; }", None),
            ("MAX$", "const", "public", "static const int MAX$ = 5;", None, "static const int MAX$ = 5;", None),
            ("add$", "function", "public", "int add$(int a)", None, "int add$(int a) { return sum$(a); }", None),
        ],
        [("#include <std$.h>", "std$.h", "std$.h")],
        [("sum$", "sum$(a)")],
    ),
    "cpp": Sample(
        "#include <vec$>\nnamespace geo$ {\nclass Shape {\npublic:\n  int area() { return side$(1); }\n};\n}\n",
        [
            ("geo$", "module", "public", "namespace geo$", None, "namespace geo$ {\nclass Shape {\npublic:\n  int area() { return side$(1); }\n};\n}", None),
            ("Shape", "class", "public", "class Shape", None, "class Shape {\npublic:\n  int area() { return side$(1); }\n}", None),
            ("area", "method", "public", "int area()", None, "int area() { return side$(1); }", 1),
        ],
        [("#include <vec$>", "vec$", "vec$")],
        [("side$", "side$(1)")],
    ),
    "ruby": Sample(
        "require 'set$'\nclass Shelf$\n  def add(x)\n    keep$(x)\n  end\nend\ndef free$\n  1\nend\n",
        [
            ("Shelf$", "class", "public", "class Shelf$", None, "class Shelf$\n  def add(x)\n    keep$(x)\n  end\nend", None),
            ("add", "method", "public", "def add(x)", None, "def add(x)\n    keep$(x)\n  end", 0),
            ("free$", "function", "public", "def free$", None, "def free$\n  1\nend", None),
        ],
        [("require 'set$'", "set$", "set$")],
        [("keep$", "keep$(x)")],
    ),
}


def _text(v: str | None) -> str:
    """A literal of SQL with the key put in."""
    return "cast(null as varchar)" if v is None else "replace('" + v.replace("'", "''") + "', '$', cast(p_partkey as varchar))"


def _at(source: str, part: str) -> str:
    start = f"cast(strpos({_text(source)}, {_text(part)}) - 1 as bigint)"
    return f"{start} as byte_start, {start} + strlen({_text(part)}) as byte_end"


def _symbols_sql(language: str) -> str:
    x = SAMPLES[language]
    path = f"'{language}/' || p_partkey"
    rows = []
    for i, (name, kind, visibility, signature, doc, part, parent) in enumerate(x.symbols):
        owner = x.symbols[parent][0] if parent is not None else None
        chain = f"{path} || '::' || {_text(owner) + " || '::' || " if owner else ''}{_text(name)}"
        rows.append(f"select {path} as file_path, {i} as seq, {_text(name)} as name, {chain} as qualified_name, '{kind}' as kind, '{visibility}' as visibility, {_text(signature)} as signature, {_text(doc)} as docstring, {_at(x.source, part)}, {_text(owner)} as parent from part")
    return " union all ".join(rows)


def _imports_sql() -> str:
    return " union all ".join(
        f"select '{language}/' || p_partkey as file_path, {i} as ord, {_text(raw)} as raw_text, {_text(module)} as source_module, {_text(names)} as imported_names from part"
        for language, x in SAMPLES.items()
        for i, (raw, module, names) in enumerate(x.imports)
    )


def _calls_sql() -> str:
    """A call's range is that of what is called, here the name."""
    start = "cast(strpos({0}, {1}) - 1 as bigint)"
    rows = [(language, name, start.format(_text(x.source), _text(part))) for language, x in SAMPLES.items() for name, part in x.calls]
    return " union all ".join(f"select '{language}/' || p_partkey as file_path, {_text(name)} as symbol_name, {at} as byte_start, {at} + strlen({_text(name)}) as byte_end from part" for language, name, at in rows)


def sources(spark: SparkSession, d: str, *languages: str) -> DataFrame:
    """path, language, content: the samples of the languages for every part."""
    keys = A.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"))
    # Rows of keys are few bytes, so Spark's splits of the file would leave nearly all parsing to one task.
    n = keys.count() * len(languages)
    rows = keys.repartition(max(1, min(-(-n // FEW), max(-(-n // MANY), spark.sparkContext.defaultParallelism))), "k")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("language"), F.lit(SAMPLES[k].source).alias("s")) for k in languages]))
    rows = rows.select("k", each.alias("x"))
    return rows.select(F.concat("x.language", F.lit("/"), "k").alias("path"), "x.language", F.encode(F.replace("x.s", F.lit("$"), "k"), "UTF-8").alias("content"))


def _parsed(spark: SparkSession, d: str, table: str, *languages: str) -> dict[str, DataFrame]:
    return tree.explode(tree.parse(sources(spark, d, *languages), table))


def _register(language: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = _parsed(spark, d, "symbols", language)["symbols"]
        return s.select("file_path", "seq", "name", "qualified_name", "kind", "visibility", "signature", "docstring", "byte_start", "byte_end", F.col("parent_name").alias("parent"))

    run.__name__ = f"parse_{language}"
    query(_symbols_sql(language))(run)


for _language in SAMPLES:
    _register(_language)


@query(_imports_sql())
def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "imports", *SAMPLES)["imports"].select("file_path", "ord", "raw_text", "source_module", F.array_join("imported_names", ",").alias("imported_names"))


@query(_calls_sql())
def parse_calls(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "refs", *SAMPLES)["references"].select("file_path", "symbol_name", "byte_start", "byte_end")


@query("select language, count(*) as n_files from part, (values " + ", ".join(f"('{k}')" for k in SAMPLES) + ") as t(language) group by language")
def parse_files(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "files", *SAMPLES)["files"].groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
