"""Operator 8: secrets in whole texts, by DataFrame functions only.

Base rules (assign, access, hex) are leftmost non-overlapping matches with
positions in code points: the pieces between matches, by ``split``, and the
matches, by ``regexp_extract_all``, give each start as a running length.

The method adds ``entropy`` spans. Candidates are runs of 20 and more characters
of base64 and url-safe alphabets that hold a digit and a letter. The Shannon
entropy of a sliding window of 20 characters is kept by incremental counts: a
character that comes in and one that goes out each change one count and the sum
of c * log2(c). A window is high from 3.0 bits (candidates of hexadecimal digits
only), 3.5 (lower case and digits), 3.4 (upper case and digits) or 3.75 (mixed, which
hold upper and lower case or one of ``+/_=-`` besides letters and digits). The span reaches from the first high
window to the last. The allow-list drops UUIDs and slugs of plain words and
numbers. No window touches a placeholder, and in paths and addresses each segment
is a candidate of its own. Spans that meet a base span are not added.

Defined cases: a null text is empty and has no spans; rows with equal doc_id are
scanned alike, each by itself; columns that clash with internal names are kept
apart, as only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of [A-Z0-9] is taken from its first AKIA to its end, so 20 and more characters is 16 and more after it
HEX = r"[0-9a-f]{24,}"  # runs are maximal
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS, LOWER_BITS, UPPER_BITS, MIXED_BITS = 3.0, 3.5, 3.4, 3.75
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ["assign", "access", "hex", "entropy"]
#: Candidates that are no secrets.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[-_/=+]*([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*$",
    r"(?i)(example|placeholder|changeme|your_|dummy|xxxx|0000000|1234567|abcdefg)",
    r"//|/[A-Za-z]+/[A-Za-z]+/",
]
#: Of these, those that speak of a candidate as a whole; the others speak of its pieces only.
WHOLE = ALLOW[:2]
#: Placeholders by length, which no window may touch.
BLANKS = {4: "xxxx", 5: "your_|dummy", 7: "example|0000000|1234567|abcdefg", 8: "changeme", 11: "placeholder"}
#: In a path or an address the pieces are its segments. A // in the middle of a run is none, as base64 has it by chance.
PATH = r"^//|=//|/[A-Za-z]+/[A-Za-z]+/"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Entries of an array that are folded together; the folds of blocks are then folded, so no long array grows step by step.
FOLD = 64


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, also where it stands inside of a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _fold(items: Column, total, join, out, kind: str) -> Column:
    """array<kind>: out(state, x) for each x of items, state the running value of all entries before.

    total(x) is an integer of one entry, and join(state, total) the next state,
    from 0: sums and maxima. Blocks of FOLD entries keep it near linear.
    """
    numbers = F.expr("cast(array() as array<int>)")

    def body(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / FOLD).cast("int"))
        part = lambda b: F.slice(z, b * FOLD + 1, FOLD)
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: join(a, total(x))))
        zero = F.struct(F.lit(0).alias("pos"), numbers.alias("out"))
        starts = F.aggregate(sums, zero, lambda a, x: F.struct(join(a["pos"], x).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"])
        none = F.expr(f"cast(array() as array<{kind}>)")

        def run(begin: Column) -> Column:
            step = lambda a, x: F.struct(join(a["pos"], total(x)).alias("pos"), F.concat(a["out"], F.array(out(a["pos"], x))).alias("out"))
            return F.flatten(F.transform(blocks, lambda b: F.aggregate(part(b), F.struct(F.get(begin, b).alias("pos"), none.alias("out")), step, lambda a: a["out"])))

        return F.when(F.size(z) > 0, _let(starts, run)).otherwise(none)

    return _let(items, body)


def _runs(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, s>> of the matches ``found`` of pattern."""
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("s")))
    pairs = F.filter(pairs, lambda x: x["s"].isNotNull())  # the text after the last match
    span = lambda pos, x: F.struct((pos + x["gap"]).alias("start"), (pos + x["gap"] + x["n"]).alias("end"), x["s"].alias("s"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,s:string>>)")
    return F.when(F.size(found) > 0, _fold(pairs, lambda x: x["gap"] + x["n"], lambda a, n: a + n, span, "struct<start:int,end:int,s:string>")).otherwise(empty)


def _spans(runs: Column, kind: int) -> Column:
    return F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), r["end"].alias("end")))


def _weight(c: Column) -> Column:
    """c * log2(c), 0 for c of at most 1."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def high_windows(s: Column, bits: Column) -> Column:
    """struct<first, last>: starts of the first and last window of s with at least ``bits`` of entropy, -1 for none."""
    log = F.log2(F.lit(float(WINDOW)))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def step(codes: Column):
        def run(acc: Column, i: Column) -> Column:
            come = F.get(codes, i)
            go = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
            same = come == go
            up, down = F.get(acc["counts"], come), F.get(acc["counts"], F.greatest(go, F.lit(0)))
            total = F.when(same, acc["sum"]).otherwise(
                acc["sum"] + _weight(up + 1) - _weight(up) + F.when(go >= 0, _weight(down - 1) - _weight(down)).otherwise(F.lit(0.0))
            )
            counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], lambda c, k: c + (k == come).cast("int") - (k == go).cast("int")))
            high = (i >= WINDOW - 1) & (log - total / WINDOW >= bits)
            at = i - (WINDOW - 1)
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(high & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"),
                F.when(high, at).otherwise(acc["last"]).alias("last"),
            )

        return run

    found = lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return _let(codes, lambda c: F.aggregate(F.sequence(F.lit(0), F.length(s) - 1), zero, step(c), found))


def _wanted(s: Column) -> Column:
    """A candidate that the allow-list leaves; every one with a digit and a letter is of a class."""
    ok = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    for pattern in WHOLE:
        ok = ok & ~s.rlike(pattern)
    return ok


def _pieces(s: Column) -> Column:
    """array<struct<start, end, s>>: the parts of a candidate that placeholders and, in a path, slashes leave."""
    left = F.when(s.rlike(PATH), F.translate(s, "/", " ")).otherwise(s)
    for n, words in BLANKS.items():
        left = F.regexp_replace(left, f"(?i)({words})", " " * n)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(s).alias("end"), s.alias("s")))
    parts = F.filter(_runs(left, CANDIDATE, F.regexp_extract_all(left, F.lit(CANDIDATE), 0)), lambda r: _wanted(r["s"]))
    return F.when(left == s, whole).otherwise(parts)


def _bits(s: Column) -> Column:
    """The least entropy of a high window in a candidate, by its character class."""
    of = F.when(s.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).when(s.rlike("^[0-9a-z]+$"), F.lit(LOWER_BITS))
    return of.when(s.rlike("^[0-9A-Z]+$"), F.lit(UPPER_BITS)).otherwise(F.lit(MIXED_BITS))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns _base and _spans: arrays of struct(start, kind, end), kind a place in KINDS.

    The text column must be non-null; every pass is a narrow projection.
    """
    t = F.col(text)
    out = docs.withColumns({"_m0": F.regexp_extract_all(t, F.lit(ASSIGN), 0), "_m1": F.regexp_extract_all(t, F.lit(ACCESS), 0), "_m2": F.regexp_extract_all(t, F.lit(HEX), 0), "_m3": F.regexp_extract_all(t, F.lit(CANDIDATE), 0)})
    # The value of an assignment is all after its separator, which is the first : or = of the match.
    value = lambda r: F.regexp_extract(r["s"], "^" + ASSIGN, 2)
    assign = F.filter(_runs(t, ASSIGN, F.col("_m0")), lambda r: F.length(value(r)) >= 6)
    base = F.concat(_spans(assign, 0), _spans(_runs(t, ACCESS, F.col("_m1")), 1), _spans(_runs(t, HEX, F.col("_m2")), 2))
    out = out.withColumn("_base", F.array_sort(base))
    worth = F.exists(F.col("_m3"), _wanted)
    none = F.expr(f"cast(array() as {_SPAN})")
    runs = F.filter(_runs(t, CANDIDATE, F.col("_m3")), lambda r: _wanted(r["s"]))

    def high(p: Column) -> Column:
        return F.transform(F.array(high_windows(p["s"], _bits(p["s"]))), lambda w: F.struct((p["start"] + w["first"]).alias("first"), (p["start"] + w["last"]).alias("last"), (w["first"] >= 0).alias("high")))

    def span(r: Column) -> Column:
        w = F.filter(F.flatten(F.transform(_pieces(r["s"]), high)), lambda x: x["high"])
        return F.transform(F.array(w), lambda x: F.struct((r["start"] + F.array_min(F.transform(x, lambda y: y["first"]))).alias("start"), F.lit(3).alias("kind"), (r["start"] + F.array_max(F.transform(x, lambda y: y["last"])) + WINDOW).alias("end"), (F.size(x) > 0).alias("high")))

    more = F.filter(F.flatten(F.transform(runs, span)), lambda s: s["high"])
    more = F.transform(more, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    # Base spans by blocks with the range they cover, so that a span is held against few of them.
    block = lambda x: F.struct(F.get(x, 0)["start"].alias("lo"), F.array_max(F.transform(x, lambda y: y["end"])).alias("hi"), x.alias("x"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_base") - 1) / FOLD).cast("int")), lambda b: _let(F.slice("_base", b * FOLD + 1, FOLD), block))
    meet = lambda s, b: (b["lo"] < s["end"]) & (s["start"] < b["hi"]) & F.exists(b["x"], lambda y: (y["start"] < s["end"]) & (s["start"] < y["end"]))
    free = _let(blocks, lambda held: F.filter(more, lambda s: ~F.exists(held, lambda b: meet(s, b))))
    out = out.withColumn("_more", F.when(worth, F.when(F.size("_base") > 0, free).otherwise(more)).otherwise(none))
    return out.withColumn("_spans", F.array_sort(F.concat("_base", "_more"))).drop("_m0", "_m1", "_m2", "_m3", "_more")


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = find(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_said(F.col("_base")), 256).alias("base_sha256"), _said(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the columns they have; in the texts each run of overlapping spans is replaced by ``mark``.

    A null text stays null. n_chars, where it is a column, follows the new text.
    """
    cols = docs.columns
    box = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    found = find(box)

    # Four bytes a character, so that a piece is cut without counting characters from the start.
    def cut(wide: Column) -> Column:
        get = lambda at, n: F.decode(F.substring(wide, at * 4 + 1, n * 4), "UTF-32")
        piece = lambda pos, s: F.when((s["start"] >= pos) | (pos == 0), F.concat(get(pos, F.greatest(s["start"] - pos, F.lit(0))), F.lit(mark))).otherwise(F.lit(""))
        pieces = _fold(F.col("_spans"), lambda s: s["end"], lambda a, n: F.greatest(a, n), piece, "string")
        last = F.array_max(F.transform("_spans", lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), get(last, F.length("text") - last))

    done = _let(F.encode("text", "UTF-32"), cut)
    new = F.when(F.size("_spans") > 0, done).otherwise(F.col("_row.text"))
    found = found.select("_row", new.alias("_new"))
    size = {"text": F.col("_new"), "n_chars": F.when(F.col("_new").isNotNull(), F.length("_new")).otherwise(F.col("_row.n_chars") if "n_chars" in cols else F.lit(None))}
    kinds = {f.name: f.dataType for f in docs.schema}
    return found.select(*[(size[c].cast(kinds[c]) if c in size else F.col(f"_row.`{c}`")).alias(c) for c in cols])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same in DuckDB, with each window's entropy from scratch, but without the classes of one case, and with the allow-list for whole runs."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def runs(pattern: str) -> str:
        m, g = f"regexp_extract_all(t, {q(pattern)}, 0)", f"regexp_split_to_array(t, {q(pattern)})"
        return f"""list_transform(range(1, len({m}) + 1), lambda i: {{'start': coalesce(list_sum(list_transform({g}[1:i], lambda x: length(x))), 0)::bigint
            + coalesce(list_sum(list_transform({m}[1:i-1], lambda x: length(x))), 0)::bigint, 's': {m}[i]}})"""

    # (?i) folds beyond ASCII in DuckDB
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
    assign = ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", either)
    allow = " and ".join(f"not regexp_matches(s, {q(p)})" for p in ALLOW)
    return f"""
    with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents),
    hit as (
      select rid, 0 as kind, unnest({runs(assign)}) as r from d where regexp_matches(t, {q(assign)})
      union all select rid, 1, unnest({runs(ACCESS)}) from d where regexp_matches(t, {q(ACCESS)})
      union all select rid, 2, unnest({runs(HEX)}) from d where regexp_matches(t, {q(HEX)})),
    base as (select rid, kind, r.start as s0, r.start + length(r.s) as e0 from hit
      where kind > 0 or length(regexp_extract(r.s, {q('^' + assign)}, 2)) >= 6),
    cand as (select rid, r.start as p0, r.s as s from (select rid, unnest({runs(CANDIDATE)}) as r from d where regexp_matches(t, {q(CANDIDATE)}))),
    good as (select *, regexp_full_match(s, '[0-9a-fA-F]+') as hexa from cand where regexp_matches(s, '[0-9]') and regexp_matches(s, '[A-Za-z]')
      and (regexp_full_match(s, '[0-9a-fA-F]+') or (regexp_matches(s, '[a-z]') and regexp_matches(s, '[A-Z]')) or regexp_matches(s, '[+/_=-]')) and {allow}),
    win as (select rid, p0, hexa, i, string_split(substr(s, i::bigint + 1, {WINDOW}), '') as c from (select *, unnest(range(0, length(s) - {WINDOW} + 1)) as i from good)),
    ent as (select rid, p0, i, hexa, log2({WINDOW}) - list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) * log2(len(list_filter(c, lambda y: y = x))))) / {WINDOW} as h from win),
    more as (select rid, 3 as kind, p0 + min(i) as s0, p0 + max(i) + {WINDOW} as e0 from ent where h >= case when hexa then {HEX_BITS} else {MIXED_BITS} end group by rid, p0),
    al as (select * from base union all select m.* from more m where not exists (select 1 from base b where b.rid = m.rid and b.s0 < m.e0 and m.s0 < b.e0)),
    said as (select rid, count(*) filter (kind = 0) n0, count(*) filter (kind = 1) n1, count(*) filter (kind = 2) n2, count(*) filter (kind = 3) n3,
      string_agg(({KINDS})[kind + 1] || ':' || s0 || ':' || e0, ',' order by s0, kind) filter (kind < 3) as b,
      string_agg(({KINDS})[kind + 1] || ':' || s0 || ':' || e0, ',' order by s0, kind) as a from al group by rid)
    select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, coalesce(n3, 0) as n_entropy,
      sha256(coalesce(b, '')) as base_sha256, coalesce(a, '') as spans from d left join said using (rid)"""


SQL = _sql()
