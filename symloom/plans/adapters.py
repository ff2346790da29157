"""The synthetic tables seen as symbols, references, imports, edges and changes.

Each adapter has DuckDB SQL of the same name in SQL, written apart from the
Spark code, so the oracle shares no plan with what it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names are ids modulo NAMES, so that homonyms exist; references use modulo CALLS, so that some resolve to nothing.
NAMES, CALLS = 17, 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid end to end in files of their source and language; each fifth holds the next four."""
    docs = table(spark, sf_dir, "documents").withColumn("_n", F.octet_length("text"))  # before the join, which then needs no text for it
    docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", "lang").alias("file_path"),
        F.concat(F.lit("fn_"), (F.col("doc_id") % NAMES).cast("string")).alias("name"),
        F.col("lang").alias("kind"),
        F.when(F.col("quality") == 1, "public").when(F.col("quality") == 0, "private").otherwise("internal").alias("visibility"),
        F.col("text").alias("signature"),
        "_n",
    )
    order = Window.partitionBy("file_path").orderBy("id")
    rows = rows.withColumns({"seq": F.row_number().over(order), "_e": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumn("_block", F.floor((F.col("seq") - 1) / 5))
    block = Window.partitionBy("file_path", "_block")
    first = (F.col("seq") - 1) % 5 == 0
    rows = rows.withColumns({"_head": F.min("id").over(block), "_stop": F.max("_e").over(block)})
    return rows.select(
        "id",
        "file_path",
        F.col("seq").cast("int"),
        "name",
        F.concat_ws("::", "file_path", "name").alias("qualified_name"),
        "kind",
        "visibility",
        "signature",
        F.lit(None).cast("string").alias("docstring"),
        (F.col("_e") - F.col("_n") + F.floor(F.col("_n") / 10)).cast("long").alias("byte_start"),
        F.when(first, F.col("_stop")).otherwise(F.col("_e")).cast("long").alias("byte_end"),
        F.when(~first, F.col("_head")).alias("parent_id"),
    )


def references(spark: SparkSession, sf_dir: str, syms: DataFrame | None = None) -> DataFrame:
    """Events as calls in files, at offsets spread over the file."""
    syms = symbols(spark, sf_dir) if syms is None else syms
    ends = syms.groupBy("file_path").agg(F.max("byte_end").alias("_end"))
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.when(F.col("event_id") % 2 == 0, "/en").otherwise("/fr"))
    e = e.select(F.col("event_id").alias("ref_id"), path.alias("file_path"), F.concat(F.lit("fn_"), (F.col("event_id") % CALLS).cast("string")).alias("symbol_name"))
    return e.join(ends, "file_path").select("ref_id", "file_path", "symbol_name", (F.col("ref_id") * 7919 % F.col("_end")).alias("byte_start"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as imports of English files."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    name = F.concat(F.lit("fn_"), (F.col("event_id") % NAMES).cast("string"))
    module = F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"), F.lit(".fr"))
    path = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit("/en"))
    return e.select(path.alias("file_path"), F.col("event_id").alias("ord"), F.concat(F.lit("import "), module).alias("raw_text"), module.alias("source_module"), F.array(name).alias("imported_names"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as imports."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_path"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)))
    return p.select("file_path", F.col("pos").alias("ord"), F.col("col").alias("raw_text"), F.col("col").alias("source_module"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph of suppliers (ids as they are) and parts (ids above 1,000,000); the quantity of a row turns its edge one way or the other."""
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") + 1_000_000
    down = F.col("l_quantity") < 25
    return li.select(F.when(down, F.col("l_suppkey")).otherwise(part).alias("src"), F.when(down, part).otherwise((F.col("l_suppkey") + 1) % 50).alias("dst")).distinct()


def nodes(edge: DataFrame) -> DataFrame:
    """The ends of edges as symbols."""
    ids = edge.select(F.col("src").alias("id")).unionByName(edge.select(F.col("dst").alias("id"))).distinct()
    path = F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/f"), (F.col("id") % 31).cast("string"))
    name = F.concat(F.lit("n"), F.col("id").cast("string"))
    kind = F.when(F.col("id") > 1_000_000, "function").otherwise("class")
    return ids.select("id", path.alias("file_path"), name.alias("name"), F.concat(path, F.lit("::"), name).alias("qualified_name"), kind.alias("kind"), F.col("id").alias("byte_start"), F.lit(1).alias("seq"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a path."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_type").alias("op"))


SQL = {
    "sym": f"""
        sym0 as (select d.doc_id as id, d.source || '/' || d.lang as file_path, 'fn_' || (d.doc_id % {NAMES}) as name, d.lang as kind,
            case l.quality when 1 then 'public' when 0 then 'private' else 'internal' end as visibility,
            d.text as signature, strlen(d.text) as nb from documents d left join labels l on l.doc_id = d.doc_id),
        sym1 as (select *, row_number() over (partition by file_path order by id) as seq,
            sum(nb) over (partition by file_path order by id rows unbounded preceding) as e from sym0),
        sym2 as (select *, min(id) over (partition by file_path, (seq - 1) // 5) as head, max(e) over (partition by file_path, (seq - 1) // 5) as stop from sym1),
        sym as (select id, file_path, seq::int as seq, name, file_path || '::' || name as qualified_name, kind, visibility, signature, null::varchar as docstring,
            (e - nb + nb // 10)::bigint as byte_start, (case when (seq - 1) % 5 = 0 then stop else e end)::bigint as byte_end,
            case when (seq - 1) % 5 <> 0 then head end as parent_id from sym2)""",
    "ref": f"""
        ends as (select file_path, max(byte_end) as stop from sym group by 1),
        ref0 as (select event_id as ref_id, 'src' || (user_id % 20) || case when event_id % 2 = 0 then '/en' else '/fr' end as file_path,
            'fn_' || (event_id % {CALLS}) as symbol_name from events),
        ref as (select ref_id, r.file_path, symbol_name, ref_id * 7919 % stop as byte_start from ref0 r join ends using (file_path))""",
    "imp": f"""
        imp as (select 'src' || (user_id % 20) || '/en' as file_path, event_id as ord, 'src' || (event_id % 20) || '.fr' as source_module,
            'src' || (event_id % 20) || '/fr' as module, 'fn_' || (event_id % {NAMES}) as imported from events where event_type = 'purchase')""",
    "imp_html": """
        hrefs as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages),
        imp_html as (select page_id::varchar as file_path, i - 1 as ord, h[i] as raw_text, h[i] as source_module from (select *, unnest(range(1, len(h) + 1)) as i from hrefs))""",
    "edge": """
        edge as (select l_suppkey as src, l_partkey + 1000000 as dst from lineitem where l_quantity < 25
            union select l_partkey + 1000000, (l_suppkey + 1) % 50 from lineitem where l_quantity >= 25 or l_quantity is null),
        node as (select id, 'd' || (id % 7) || '/f' || (id % 31) as file_path, 'n' || id as name, 'd' || (id % 7) || '/f' || (id % 31) || '::n' || id as qualified_name,
            case when id > 1000000 then 'function' else 'class' end as kind from (select src as id from edge union select dst from edge))""",
}


def sql(*names: str, recursive: bool = False) -> str:
    """A WITH clause of adapters."""
    return ("with recursive " if recursive else "with ") + ",".join(SQL[n] for n in names)
