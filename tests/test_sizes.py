"""Plans and work that must not grow with the whole table in one task, or with its square."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from symloom.operators import graph, resolve
from symloom.parsing import braces
from symloom.plans import parsed
from symloom.plans.queries import QUERIES, SQL
from tests.oracle import difference


def test_sources_are_dealt_to_all_cores_and_parsed_once(spark):
    sf = "/root/testdata/sf0.1"
    assert parsed.sources(spark, sf, "go").rdd.getNumPartitions() >= 8
    for name in ("parse_go", "parse_imports", "parse_calls", "parse_files"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_long_sources_take_linear_time():
    def seconds(n):
        text = "".join(f"const a{i} = go{i}({i});\nx.y{i}.z = 1\n" for i in range(n)).encode()
        began = time.process_time()
        braces.parse(text, "javascript")
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 8 * seconds(10_000)


@pytest.mark.parametrize(("names", "twice"), [(("contain_innermost", "resolve_local"), True), (("resolve_targets", "edges_resolved"), False)])
def test_resolution_on_odd_rows(spark, tmp_path, names, twice):
    """Events of one id in two files (between which the SQL of the last two leaves ties open), equal rows, ids that are null or negative, and texts that are null or empty: as the SQL says."""
    for t in ("documents", "labels", "events"):
        rows = pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pandas()
        if t == "documents":
            later = rows.duplicated(["source", "lang"])
            rows["text"] = [x if not m else None if i % 5 == 3 else "" if i % 7 == 4 else x for i, m, x in zip(rows["doc_id"], later, rows["text"])]
        if t == "events":
            again = rows.head(300 * twice).assign(user_id=rows["user_id"] * 3 + 1)
            low = rows.head(50).assign(event_id=-rows["event_id"].head(50) - 1)
            rows = pd.concat([rows, again, rows.head(100), low, rows.tail(5).assign(event_id=pd.NA)]).astype({"event_id": "Int64", "user_id": "int64"})
        pq.write_table(pa.Table.from_pandas(rows, preserve_index=False), tmp_path / f"{t}.parquet", coerce_timestamps="us")
    for name in names:
        assert difference(spark, QUERIES[name], SQL[name], str(tmp_path)) == "", name


def test_stretches_of_ranges_that_cross(spark):
    rng = np.random.default_rng(5)
    syms = [(i, f"f{i % 3}", f"n{i % 4}", int(a), int(a + w), int(i)) for i, (a, w) in enumerate(zip(rng.integers(0, 3 << 20, 300), rng.choice([-5, 0, 1, 7, 5000, 5000, 1 << 21], 300)))]
    refs = [(k, f"f{k % 4}", f"n{k % 6}", int(p)) for k, p in enumerate(rng.integers(-3, 5 << 20, 4000))] + [(9000 + i, p, "n1", a + d) for i, p, _, a, b, _ in syms for d in (-1, 0)]
    s = spark.createDataFrame(syms, "id long, file_path string, name string, byte_start long, byte_end long, seq int")
    r = spark.createDataFrame(refs, "ref_id long, file_path string, symbol_name string, byte_start long")
    want = set()
    for k, path, _, p in refs:
        inside = [(b - a, q, i) for i, f, _, a, b, q in syms if f == path and a <= p < b]
        if inside:
            want.add((k, path, min(inside)[2]))
    got = {}
    for x in resolve.containers(r, s).collect():
        got.setdefault(x.ref_id, set()).add((x.ref_id, x.file_path, x.src))
    once = {k for k, *_ in refs if sum(x[0] == k for x in refs) == 1}
    assert {x for k in once for x in got.get(k, ())} == {x for x in want if x[0] in once}


def test_no_join_of_references_with_all_symbols_of_a_file(spark):
    for name in ("contain_innermost", "resolve_local", "resolve_targets"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.splitlines() if "Join" in x]
        assert not any("<" in x for x in joins) and all("symbol_name" in x or "file_path" in x for x in joins), joins
        assert not any("byte_start" in x for x in joins)


def test_rounds_of_pagerank_sort_no_edges(spark, monkeypatch):
    """Edges stay dealt by source: no round sorts or joins them row by row; the scores are those of a loop, with hubs in several lists and ends that are no nodes."""
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 600), rng.integers(0, 45, 600))} | {(3, b) for b in range(40)} | {(50, 1)}
    plans, write = [], graph.written
    monkeypatch.setattr(graph, "_LIST", 7, raising=False)
    monkeypatch.setattr(graph, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, edges = spark.createDataFrame([(i,) for i in range(42)], "id long"), spark.createDataFrame(sorted(pairs), "src long, dst long")
        got = {r.id: r.score for r in graph.pagerank(nodes, edges, rounds=6).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    score = {i: 1 / 42 for i in range(42)}
    out = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    for _ in range(6):
        score = {i: 0.15 / 42 + 0.85 * sum(score[a] / out[a] for a, b in pairs if b == i and a in score) for i in score}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-12 for i in score)
    assert not any("SortMergeJoin" in p for p in plans)
