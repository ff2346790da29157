"""Registered queries of the engine, over the adapters, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import text as X
from symloom.operators import graph, ranking, render, resolve, retrieval, tables
from symloom.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: DuckDB for X.terms().
_TERMS = r"list_filter(list_transform(regexp_extract_all({0}, '\p{{Lu}}?[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}\p{{N}}]+|\p{{Lu}}'), lambda t: lower(t)), lambda t: strlen(t) >= 2)"
_DOC = "concat_ws(' ', name, qualified_name, signature, file_path, docstring)"
_LIST = "file_path, byte_start, seq"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scans and statistics


@query(f"{A.sql('sym')} select id, file_path, seq, name, qualified_name, kind, visibility, byte_start, byte_end, parent_id from sym")
def all_symbols(spark: SparkSession, d: str) -> DataFrame:
    return tables.in_list_order(A.symbols(spark, d)).select("id", "file_path", "seq", "name", "qualified_name", "kind", "visibility", "byte_start", "byte_end", "parent_id")


@query(f"{A.sql('sym')} select id, name, byte_start, byte_end from sym where file_path = 'src3/en'")
def symbols_of_file(spark: SparkSession, d: str) -> DataFrame:
    return A.symbols(spark, d).where("file_path = 'src3/en'").orderBy("byte_start", "seq").select("id", "name", "byte_start", "byte_end")


@query(f"{A.sql('sym', 'ref', 'imp')} select (select count(distinct file_path) from sym) as n_files, (select count(*) from sym) as n_symbols, (select count(*) from imp) as n_imports, (select count(*) from ref) as n_references, (select array_to_string(list_sort(list_distinct(list(kind))), ',') from sym) as languages")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    s = A.symbols(spark, d)
    files = s.groupBy("file_path").agg(F.first("kind").alias("language"))
    out = tables.stats(files, s, A.imports(spark, d), A.references(spark, d, s), s.limit(0))
    return out.select("n_files", "n_symbols", "n_imports", "n_references", F.array_join("languages", ",").alias("languages"))


# Text functions and relevance


@query("select doc_id, (strlen(text) + 3) // 4 as tokens from documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"select doc_id, array_to_string({_TERMS.format('text')}, ' ') as terms from documents")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.array_join(X.terms(F.col("text")), " ").alias("terms"))


@query(f"{A.sql('sym')} select term, count(*) as df from (select unnest(list_distinct({_TERMS.format(_DOC)})) as term from sym) group by term")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return ranking.document_frequency(ranking.document_terms(A.symbols(spark, d)))


def _tfidf_sql(text: str, boosts: bool) -> str:
    """score0: id and score of each symbol."""
    words = X.query_terms(text)
    parts, hits = [], []
    for i, t in enumerate(words):
        long = len(t.encode()) > 2
        tf = f"len(list_filter(w, lambda x: x = '{t}'))::double / greatest(len(w), 1)"
        base = f"{tf} * (ln(n::double / (f{i} + 1)) + 1)" if long else tf
        parts.append(f"case when list_contains(w, '{t}') then {base} else 0 end")
        hits.append(f"list_contains(w, '{t}')::int")
        if boosts:
            more = f" when contains(lower(qualified_name), '{t}') then 2.5 when contains(lower(name), '{t}') then 2.0" if long else ""
            parts.append(f"case when lower(qualified_name) = '{t}' then 6.0 when lower(name) = '{t}' then 5.0{more} else 0 end")
            if long:
                parts.append(f"case when contains(lower(file_path), '{t}') then 1.5 else 0 end")
    total, hit = " + ".join(f"({p})" for p in parts), " + ".join(hits)
    if boosts and len(words) > 1:
        total = f"({total}) * case when {hit} >= 2 then 1 + ({hit}) / {float(len(words))} else 1 end"
    dfs = ", ".join(f"count(*) filter (list_contains(w, '{t}')) as f{i}" for i, t in enumerate(words))
    return f"""wd as (select *, {_TERMS.format(_DOC)} as w from sym), fr as (select count(*) as n, {dfs} from wd),
        score0 as (select wd.*, ({total})::double as score from wd, fr)"""


ASK = "fn src3 er the"


@query(f"{A.sql('sym')}, {_tfidf_sql('the entionnd src3', False)} select id, round(score, 6) as score from score0")
def tfidf_base(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tfidf(A.symbols(spark, d), "the entionnd src3", boosts=False).select("id", F.round("score", 6).alias("score"))


@query(f"{A.sql('sym')}, {_tfidf_sql(ASK, True)} select id, round(score, 6) as score from score0")
def tfidf_boosted(spark: SparkSession, d: str) -> DataFrame:
    return ranking.tfidf(A.symbols(spark, d), ASK).select("id", F.round("score", 6).alias("score"))


_GREEDY = """
        ordered as (select *, (strlen(signature) + 3) // 4 as cost, row_number() over (order by score desc, file_path, byte_start, seq) as r from score0 where score > 0),
        scan(r, left_over, took) as (select 0::bigint, {budget}::bigint, false union all
            select o.r, case when o.cost <= s.left_over and (s.left_over > 0 or o.r = 1) then s.left_over - o.cost else s.left_over end, o.cost <= s.left_over and (s.left_over > 0 or o.r = 1)
            from scan s join ordered o on o.r = s.r + 1),
        picked as (select o.*, row_number() over (order by o.r) - 1 as take from ordered o join scan s on s.r = o.r and s.took)"""


@query(f"{A.sql('sym', recursive=True)}, {_tfidf_sql('the and src3', True)}, {_GREEDY.format(budget=9_000)} select id, take::int as take from picked")
def greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    return ranking.greedy(ranking.tfidf(A.symbols(spark, d), "the and src3"), 9_000).select("id", "take")


@query(f"{A.sql('sym', recursive=True)}, {_tfidf_sql('the and src3', True)}, {_GREEDY.format(budget=32_000)} select file_path, '// ' || file_path || chr(10) || string_agg(signature || chr(10), '' order by take) || chr(10) as block, count(*)::int as n_symbols from picked group by file_path")
def compress_context(spark: SparkSession, d: str) -> DataFrame:
    return ranking.compress_context(A.symbols(spark, d), "the and src3", 32_000)


_BLOCKS = {
    "pack_xml": """bl as (select file_path, '<file path="' || file_path || '">' || chr(10) || string_agg(signature || chr(10), '' order by byte_start, seq) || '</file>' || chr(10) as block from sym where parent_id is null group by 1),
        co as (select *, (strlen(block) + 3) // 4 as cost from bl)""",
    "pack_json": """bl as (select file_path, string_agg(signature, chr(10) order by byte_start, seq) as symbols from sym where parent_id is null group by 1),
        co as (select *, (strlen(symbols) + 3) // 4 + 20 as cost from bl)""",
}


@query(f"{A.sql('sym')}, {_BLOCKS['pack_xml']}, us as (select *, (2 + sum(cost) over (order by file_path))::bigint as used_tokens from co) select file_path, block, cost, used_tokens from us where used_tokens <= 32000")
def pack_xml(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pack_xml(A.symbols(spark, d), 32_000)


@query(f"{A.sql('sym')}, {_BLOCKS['pack_json']}, us as (select *, (20 + sum(cost) over (order by file_path))::bigint as used_tokens from co) select file_path, symbols, cost, used_tokens from us where used_tokens <= 32000")
def pack_json_files(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pack_json(A.symbols(spark, d), 32_000)


# Lookups


@query(f"{A.sql('sym')} select id, qualified_name, kind from sym where qualified_name = 'fn_3' or name = 'fn_3'")
def find_exact(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.find(A.symbols(spark, d), "fn_3").select("id", "qualified_name", "kind")


@query(f"{A.sql('sym')} select id, qualified_name, kind from sym where (qualified_name = 'fn_3' or name = 'fn_3') and kind = 'fr'")
def find_exact_kind(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.find(A.symbols(spark, d), "fn_3", "fr").select("id", "qualified_name", "kind")


def _like(f: str, p: str) -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"translate(coalesce({f}, ''), {az}) like translate('{p}', {az})"


def _search_sql(text: str, limit: int) -> str:
    words = text.split()
    long = [w for w in words if len(w) > 2]
    where = " or ".join(_like(f, f"%{w}%") for w in long for f in retrieval.FIELDS) or " or ".join(f"lower(name) = '{w}' or lower(qualified_name) = '{w}' or {_like('name', w + '%')} or {_like('qualified_name', w + '%')} or {_like('file_path', '%/' + w + '%')}" for w in words)
    rank = f"case when name = '{text}' or qualified_name = '{text}' then -100 else 0 end" + "".join(" + case " + " ".join(f"when {_like(f, f'%{w}%')} then {v}" for f, v in retrieval.WEIGHTS.items()) + " else 0 end" for w in words) + " + case kind when 'variable' then 5 when 'const' then 3 else 0 end"
    return f"{A.sql('sym')} select id, qualified_name, ({rank})::int as rank from sym where {where} order by rank, {_LIST} limit {limit}"


@query(_search_sql("SRC3/en thE fn%4", 25))
def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(A.symbols(spark, d), "SRC3/en thE fn%4", 25).select("id", "qualified_name", "rank")


@query(_search_sql("fn en", 20))
def search_short(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(A.symbols(spark, d), "fn en", 20).select("id", "qualified_name", "rank")


@query(_search_sql("fn_3", 1_000_000))
def search_rank_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(A.symbols(spark, d), "fn_3", 1_000_000).select("id", "qualified_name", "rank")


@query(f"{A.sql('imp_html')} select file_path, ord, raw_text from imp_html where {_like('raw_text', '%TION%')} or {_like('source_module', '%TION%')} or {_like('raw_text', '%the,%')} or {_like('source_module', '%the,%')} order by file_path, ord limit 30")
def search_imports(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_imports(A.links(spark, d), "TION the,", 30).select("file_path", "ord", "raw_text")


@query(f"{A.sql('imp_html')} select file_path, ord, raw_text from imp_html where source_module = 'de' or {_like('source_module', 'de/%')} or {_like('source_module', '%/de')} order by file_path, ord limit 30")
def search_imports_short(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_imports(A.links(spark, d), "de", 30).select("file_path", "ord", "raw_text")


# Resolution

_HELD = f"""{A.sql('sym', 'ref', 'imp')},
        held as (select r.ref_id, r.file_path, r.symbol_name, arg_min(s.id, (s.byte_end - s.byte_start) * 1000000 + s.seq) as src
            from ref r join sym s on s.file_path = r.file_path and s.byte_start <= r.byte_start and r.byte_start < s.byte_end group by 1, 2, 3)"""
_RESOLVED = f"""{_HELD},
        near as (select ref_id, src, id as dst, case when id = src then 'self' else 'local' end as via from (select h.ref_id, h.src, s.id,
            row_number() over (partition by h.ref_id order by (s.id = h.src) desc, s.byte_end - s.byte_start, s.seq) as k
            from held h join sym s on s.file_path = h.file_path and s.name = h.symbol_name) where k = 1),
        far as (select ref_id, src, id as dst, case when o is not null then 'import' when parent_id is not null then 'nested' else 'top_level' end as via from (
            select *, row_number() over (partition by ref_id order by o nulls last, case when o is null and parent_id is not null then 1 else 0 end, file_path, byte_start, seq) as k from (
                select h.ref_id, h.src, s.id, s.parent_id, s.file_path, s.byte_start, s.seq, (select min(i.ord) from imp i where i.file_path = h.file_path and i.imported = h.symbol_name and contains(s.file_path, i.module)) as o
                from held h join sym s on s.name = h.symbol_name where h.ref_id not in (select ref_id from near))) where k = 1),
        alls as (select * from near union all select * from far)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The symbols without their texts, written once as they are read several times."""
    return tables.written(A.symbols(spark, d).select("id", "file_path", "name", "byte_start", "byte_end", "seq", "parent_id"))


@query(f"{_HELD} select ref_id, symbol_name, src from held")
def contain_innermost(spark: SparkSession, d: str) -> DataFrame:
    s = _placed(spark, d)
    return resolve.containers(A.references(spark, d, s), s).select("ref_id", "symbol_name", "src")


@query(f"{_RESOLVED} select ref_id, src, dst from near")
def resolve_local(spark: SparkSession, d: str) -> DataFrame:
    s = _placed(spark, d)
    return resolve.local_targets(A.references(spark, d, s), s)


@query(f"{_RESOLVED} select ref_id, src, dst, via from alls")
def resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    s = _placed(spark, d)
    return resolve.targets(A.references(spark, d, s), s, A.imports(spark, d))


@query(f"{_RESOLVED} select distinct src, dst, 'call' as context from alls")
def edges_resolved(spark: SparkSession, d: str) -> DataFrame:
    s = _placed(spark, d)
    return resolve.edges(A.references(spark, d, s), s, A.imports(spark, d))


# Graph


def _start(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query(f"{A.sql('edge')} select distinct dst as id from edge where src = 7")
def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(A.edges(spark, d), _start(spark, 7), "out")


@query(f"{A.sql('edge')} select distinct src as id from edge where dst = 7")
def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(A.edges(spark, d), _start(spark, 7), "in")


@query(f"{A.sql('edge')} select dst as id from edge where src = 7 union select src from edge where dst = 7")
def neighbors_both(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(A.edges(spark, d), _start(spark, 7))


def _rank_sql(rounds: int = 20) -> str:
    out = [f"{A.sql('edge')}, cnt as (select count(*)::double as n from node), deg as (select src, count(*)::double as o from edge group by 1), r0 as materialized (select id, 1 / n as s from node, cnt)"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} as materialized (select node.id, 0.15 / n + 0.85 * coalesce(i.t, 0) as s from node cross join cnt left join (select e.dst, sum(r.s / deg.o) as t from edge e join r{k - 1} r on r.id = e.src join deg on deg.src = e.src group by 1) i on i.dst = node.id)")
    return ", ".join(out)


def _ranks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = tables.written(A.edges(spark, d))
    n = tables.written(A.nodes(e))
    return n, graph.pagerank(n, e)


@query(f"{_rank_sql()} select id, round(s, 8) as score from r20")
def pagerank_20(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d)[1].select("id", F.round("score", 8).alias("score"))


@query(f"{_rank_sql()} select id, qualified_name, round(s, 8) as score from r20 join node using (id) order by round(s, 12) desc, qualified_name, id limit 10")
def ranked_top_n(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranked(*_ranks(spark, d)).select("id", "qualified_name", F.round("score", 8).alias("score"))


@query(f"{_rank_sql()} select id, qualified_name, round(s, 8) as score from r20 join node using (id) where kind = 'function' order by round(s, 12) desc, qualified_name, id limit 10")
def ranked_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranked(*_ranks(spark, d), kind="function").select("id", "qualified_name", F.round("score", 8).alias("score"))


@query(f"{_rank_sql()} select id, qualified_name, round(s, 8) as score from r20 join node using (id) where file_path like 'd3/%' order by round(s, 12) desc, qualified_name, id limit 10")
def ranked_by_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.ranked(*_ranks(spark, d), prefix="d3/").select("id", "qualified_name", F.round("score", 8).alias("score"))


def _walk_sql(start: int, depth: int | None, up: bool) -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    stop = f"where w.depth < {depth}" if depth else "where w.depth < 12"
    return f"{A.sql('edge', recursive=True)}, w(id, depth) as (select {start}::bigint, 0 union select e.{b}, w.depth + 1 from w join edge e on e.{a} = w.id {stop})"


@query(f"{_walk_sql(7, 3, True)} select id, min(depth)::int as depth from w where id <> 7 group by id")
def impact_depth_3(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(tables.written(A.edges(spark, d)), _start(spark, 7), 3)


@query(f"{_walk_sql(7, None, True)} select distinct id from w where id <> 7")
def impact_unbounded(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(tables.written(A.edges(spark, d)), _start(spark, 7), None).select("id")


@query(f"{_walk_sql(7, 3, True)}, m as (select distinct id from w where id <> 7) select file_path, count(*) as n_symbols, string_agg(name, ',' order by name) as names from m join node using (id) group by 1")
def impact_by_file(spark: SparkSession, d: str) -> DataFrame:
    e = tables.written(A.edges(spark, d))
    hit = graph.impact(e, _start(spark, 7), 3).join(A.nodes(e), "id")
    return hit.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query(f"{_walk_sql(7, 3, True)} select id, min(depth)::int as depth from w where depth > 0 group by id")
def trace_up(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(graph.reverse(tables.written(A.edges(spark, d))), _start(spark, 7), 3, revisit=True)


@query(f"{_walk_sql(7, 3, False)} select id, min(depth)::int as depth from w where depth > 0 group by id")
def trace_down(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(tables.written(A.edges(spark, d)), _start(spark, 7), 3, revisit=True)


@query(f"{_walk_sql(7, 2, False)}, u(id, depth) as (select 7::bigint, 0 union select e.src, u.depth + 1 from u join edge e on e.dst = u.id where u.depth < 2) select id from w where id <> 7 union select id from u where id <> 7")
def related_n(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(tables.written(A.edges(spark, d)), _start(spark, 7), 2)


# Views


@query(f"{A.sql('sym')}, f as (select file_path, count(*) filter (parent_id is null) as n from sym group by 1) select regexp_extract(file_path, '^(.*)/[^/]*$', 1) as key, regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/  (' || count(*) || ' files, ' || sum(n)::bigint || ' symbols)' || chr(10) as block from f group by 1, regexp_extract(file_path, '^(.*)/[^/]*$', 1)")
def map_tree(spark: SparkSession, d: str) -> DataFrame:
    return render.map_overview(A.symbols(spark, d), "tree").select("key", "block")


_FULL = "blocks as (select s.file_path as key, chr(10) || s.file_path || ':' || chr(10) || string_agg('  ' || s.signature || chr(10) || coalesce(k.t, ''), '' order by s.byte_start, s.seq) as block from sym s left join (select parent_id, string_agg('    ' || signature || chr(10), '' order by byte_start, seq) as t from sym where parent_id is not null group by 1) k on k.parent_id = s.id where s.parent_id is null group by 1, s.file_path)"


@query(f"{A.sql('sym')}, {_FULL}, b as (select *, coalesce(sum(strlen(block)) over (order by key rows between unbounded preceding and 1 preceding), 0) as p from blocks) select key, block from b where p <= 120000")
def map_full(spark: SparkSession, d: str) -> DataFrame:
    return render.map_overview(A.symbols(spark, d), "full", 120_000).select("key", "block")


@query(f"{A.sql('sym')} select file_path as key, chr(10) || file_path || ':' || chr(10) || string_agg('  ' || case visibility when 'public' then '+' when 'private' then '-' else '~' end || '  ' || name || chr(10), '' order by byte_start, seq) as block from sym where parent_id is null group by 1, file_path")
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    return render.map_overview(A.symbols(spark, d), "summary", 10**9).select("key", "block")


@query(f"{A.sql('sym')} select s.file_path, string_agg(s.signature || chr(10) || coalesce(k.t, '') || chr(10), '' order by s.byte_start, s.seq) as skeleton from sym s left join (select parent_id, string_agg('  ' || signature || chr(10), '' order by byte_start, seq) as t from sym where parent_id is not null group by 1) k on k.parent_id = s.id where s.parent_id is null group by 1")
def skeleton_lines(spark: SparkSession, d: str) -> DataFrame:
    return render.skeletons(A.symbols(spark, d))


#: DuckDB: whole characters of bytes given in hexadecimal, without those that an end cuts.
_WHOLE = "decode(unhex(regexp_extract(regexp_replace({0}, '^(?:[89AB].)+', ''), '^(?:[0-7].|[CD].[89AB].|E.(?:[89AB].){{2}}|F.(?:[89AB].){{3}})*')))"


@query(f"with d as (select doc_id, text, hex(text) as h from documents) select doc_id, case when strlen(text) <= 400 then text else {_WHOLE.format('h[1:600]')} || chr(10) || '... (truncated)' || chr(10) || {_WHOLE.format('h[-200:]')} end as t from d")
def head_tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", X.head_tail(F.col("text"), 400).alias("t"))


@query(f"with d as (select doc_id, hex(text) as h from documents), e as (select doc_id, {_WHOLE.format('h[21:120]')} as t, {_WHOLE.format('h[1:100]')} as p from d) select doc_id, t, length(p) - length(replace(p, chr(10), '')) + 1 as line from e")
def source_slice(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", X.byte_slice(F.col("text"), F.lit(10), F.lit(60)).alias("t"), X.line_number(F.col("text"), F.lit(50)).cast("long").alias("line"))


@query(f"{A.sql('sym')}, t as (select c.id, coalesce(p.qualified_name, c.file_path) || '::' || c.name as qualified_name from sym c left join (select id, file_path || '::' || name as qualified_name from sym) p on p.id = c.parent_id) select * from t")
def qualified_backfill(spark: SparkSession, d: str) -> DataFrame:
    return tables.with_qualified(A.symbols(spark, d).drop("qualified_name")).select("id", "qualified_name")


# Change capture


@query("select doc_id, case when doc_id % 3 = 0 then 'new' when doc_id % 7 = 0 then 'changed' else 'unchanged' end as status from documents")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    from symloom.catalog import diff

    docs = A.table(spark, d, "documents")
    scan = docs.select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    stored = scan.where("path % 3 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("hash")))
    return diff(scan, stored).select(F.col("path").alias("doc_id"), "status")


@query("select doc_id, case when doc_id % 4 = 0 then 'deleted' when doc_id % 3 = 0 then 'new' else 'unchanged' end as status from documents where not (doc_id % 4 = 0 and doc_id % 3 = 0)")
def prune_deleted(spark: SparkSession, d: str) -> DataFrame:
    from symloom.catalog import diff

    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    return diff(docs.where("path % 4 <> 0"), docs.where("path % 3 <> 0")).select(F.col("path").alias("doc_id"), "status")


@query("select doc_id, text from (select doc_id, case when doc_id % 5 = 0 then 'fresh' else text end as text from documents where doc_id % 2 = 0 union all select doc_id, text from documents where doc_id % 2 = 1)")
def upsert_state(spark: SparkSession, d: str) -> DataFrame:
    from symloom.catalog import replace_rows

    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    fresh = docs.where("path % 2 = 0").withColumn("text", F.when(F.col("path") % 5 == 0, "fresh").otherwise(F.col("text")))
    return replace_rows(docs, fresh, "path").select(F.col("path").alias("doc_id"), "text")


@query("with e as (select user_id::varchar as path, ts, event_type, lead(ts) over (partition by user_id order by ts) as nx from events) select path, ts::timestamp as ts from e where nx is null or nx >= ts + interval 6 hours group by 1, 2")
def debounce_latest(spark: SparkSession, d: str) -> DataFrame:
    from symloom.streaming.changes import debounce

    return debounce(A.changes(spark, d), "6 hours").select("path", "ts")


_TREE = "tr as (select conv_id || case turn % 4 when 0 then '/a.py' when 1 then '/.b/x.ts' when 2 then '/dist/y.go' else '/test_z.rs' end as path, strlen(text) * 60 as size from conversations)"


@query(f"with {_TREE} select path, size, case when path like '%/.b/%' then 'hidden' when path like '%/dist/%' then 'excluded' when size > 2048 then 'size' when path like '%/test_%' then 'test' end as reason from tr")
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    from symloom.sources.filters import Rules, classify

    return classify(_paths(spark, d), Rules(max_file_size_kb=2)).select("path", "size", "reason")


@query(f"with {_TREE} select count(*) as scanned, count(*) filter (path like '%/.b/%') as hidden, count(*) filter (path like '%/dist/%') as excluded, count(*) filter (path like '%/a.py' and size <= 2048) as kept from tr")
def walk_summary(spark: SparkSession, d: str) -> DataFrame:
    from symloom.sources.filters import Rules, classify, summary

    return summary(classify(_paths(spark, d), Rules(max_file_size_kb=2))).select("scanned", "hidden", "excluded", "kept")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations")
    tail = F.when(F.col("turn") % 4 == 0, "/a.py").when(F.col("turn") % 4 == 1, "/.b/x.ts").when(F.col("turn") % 4 == 2, "/dist/y.go").otherwise("/test_z.rs")
    return c.select(F.concat(F.col("conv_id").cast("string"), tail).alias("path"), (F.octet_length("text") * 60).cast("long").alias("size"))




# Tables as they are, names, and rows of edge cases


@query(f"{A.sql('sym')} select distinct file_path, regexp_replace(file_path, '^.*/', '') as language from sym")
def all_files(spark: SparkSession, d: str) -> DataFrame:
    return A.symbols(spark, d).select("file_path", F.regexp_replace("file_path", "^.*/", "").alias("language")).distinct()


@query(f"{A.sql('imp')} select file_path, ord, source_module, imported as names from imp")
def all_imports(spark: SparkSession, d: str) -> DataFrame:
    return A.imports(spark, d).select("file_path", "ord", "source_module", F.array_join("imported_names", ",").alias("names"))


@query(f"{A.sql('edge')} select src, dst from edge")
def all_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.edges(spark, d)


@query(f"{A.sql('edge')} select e.src, e.dst from edge e join node a on a.id = e.src join node b on b.id = e.dst where a.kind <> 'function' or a.id % 3 > 0 intersect select src, dst from edge where dst <= 1000000 or dst % 3 > 0")
def valid_edges(spark: SparkSession, d: str) -> DataFrame:
    e = tables.written(A.edges(spark, d))
    known = A.nodes(e).where("kind <> 'function' or id % 3 > 0")
    return graph.build(known, e.unionByName(e))


_GLOBS = ["**/dist/**", "1*/a.py", "[!2]?/{.b,test}*"]


@query(f"with {_TREE} select path, case when path like '%/.b/%' then 'hidden' when path like '%/dist/%' then 'excluded' when regexp_matches(path, '^1.*/a\\.py$') or regexp_matches(path, '^[^2]./(\\.b|test).*$') then 'pattern' when path like '%/test_%' then 'test' end as reason from tr")
def glob_reasons(spark: SparkSession, d: str) -> DataFrame:
    from symloom.sources.filters import Rules, classify

    return classify(_paths(spark, d), Rules(max_file_size_kb=1 << 30, exclude_patterns=_GLOBS)).select("path", "reason")


@query(f"{A.sql('sym')} select id from sym where name = 'fn_3'")
def starts_bare(spark: SparkSession, d: str) -> DataFrame:
    return graph.start_ids(A.symbols(spark, d), "fn_3")


@query(f"{A.sql('sym')} select id from sym where qualified_name = (select min(qualified_name) from sym) order by byte_start desc, seq desc limit 1")
def starts_qualified(spark: SparkSession, d: str) -> DataFrame:
    s = A.symbols(spark, d)
    return graph.start_ids(s, s.agg(F.min("qualified_name")).first()[0])


@query(f"{A.sql('sym')} select max(id * 0.5)::double as score from sym where name = 'fn_3'")
def score_of_name(spark: SparkSession, d: str) -> DataFrame:
    s = A.symbols(spark, d)
    return graph.score_of(s, s.select("id", (F.col("id") * F.lit(0.5)).alias("score")), "fn_3")


@query(f"{A.sql('sym')} select file_path, kind from sym where name = 'fn_3' order by file_path, byte_start, seq limit 1")
def about_name(spark: SparkSession, d: str) -> DataFrame:
    return graph.about(A.symbols(spark, d), "fn_3")


@query("select cast(null as varchar) as block where false")
def compress_nothing(spark: SparkSession, d: str) -> DataFrame:
    return ranking.compress_context(A.symbols(spark, d), "", 1000).select("block")


@query(f"{A.sql('edge')} select distinct name from (select dst as id from edge where src = 7 union select src from edge where dst = 7) join node using (id)")
def neighbor_names(spark: SparkSession, d: str) -> DataFrame:
    e = tables.written(A.edges(spark, d))
    return graph.neighbours(e, _start(spark, 7), "sideways").join(A.nodes(e), "id").select("name").distinct()


@query(f"{_walk_sql(7, 3, True)} select name, min(depth)::int as depth from w join node using (id) where depth > 0 group by name")
def trace_names(spark: SparkSession, d: str) -> DataFrame:
    e = tables.written(A.edges(spark, d))
    up = graph.walk(graph.reverse(e), _start(spark, 7), 3, revisit=True)
    return up.join(A.nodes(e), "id").groupBy("name").agg(F.min("depth").alias("depth"))


@query("select l_orderkey, l_linenumber, format('{:.6f}', l_extendedprice::double / 7) as score from lineitem")
def six_digits(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.6f", F.col("l_extendedprice").cast("double") / 7).alias("score"))
