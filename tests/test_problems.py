"""The dealt operators on odd input: nulls, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import datetime as dt
import json
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.functions import jsontext
from loamgraph.operators import hotkeys, orphans, quotient, seen
from loamgraph.operators import inline
from loamgraph.operators.inline import LINKS, FlatTables, graph_elements, graph_tables
from loamgraph.operators.orphans import References
from loamgraph.operators.widen import WideTables
from loamgraph.plans.problems import QUERIES

T = lambda *a: dt.datetime(*a)


# ---- 1: wide tables
PROPS = "elem string, id bigint, key string, val string, seq bigint, ELEM string"
KEYS = "for_elem string, key string, attr_type string"


def test_wide(spark):
    rows = [
        ("V", 1, "age", " 42\n", 1, "x"), ("V", 1, "age", "41", 0, "x"), ("V", 1, "Age", "seven", 2, "x"), ("V", 2, "age", "9223372036854775808", 3, "x"), ("V", 2, "w", "1e5", 4, "x"),
        ("V", 3, "w", ".", 5, "x"), ("V", 3, "name", "", 6, "x"), ("V", 3, "age", "", 7, "x"), ("V", 4, "other", "x" * 100_000, 8, "x"), ("V", 5, "age", "5", 9, "x"), ("V", 5, "age", None, 10, "x"),
        ("V", 6, "age", "6", None, "x"), ("V", 6, "age", "7", None, "x"), ("V", 1, "age", " 42\n", 1, "x"), ("E", 1, "age", "x", 1, "x"), ("E", 2, "w", "-.5", 1, "x"),
        (None, 1, "age", "1", 1, "x"), ("V", None, "age", "z", 1, "x"), ("V", 1, None, "z", 1, "x"), ("V", 7, "id", "i", 1, "x"), ("V", 8, "w", "1_0", 1, "x"), ("V", 9, "w", "1e999", 1, "x"),
    ]
    keys = [("node", "age", "int"), ("node", "Age", "int"), ("all", "w", "float"), ("node", "name", None), ("all", "name", "int"), ("node", "id", "string"), ("node", "age", "int"), (None, "q", "int"), ("edge", None, "int")]
    t = WideTables(spark.createDataFrame(rows, PROPS), spark.createDataFrame(keys, KEYS), fan_in=2)
    v = {r["id"]: r for r in t.wide("V").collect()}
    assert t.wide("V").columns == ["id", "Age", "age_2", "id_2", "name", "w", "unfit"]
    assert set(v) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert (v[1]["age_2"], v[1]["Age"], v[2]["w"], v[3]["name"], v[5]["age_2"], v[6]["age_2"], v[7]["id_2"], v[9]["w"]) == (42, None, 1e5, "", None, 7, "i", float("inf"))
    assert {(r.elem, r.id, r.key, r.val) for r in t.unfit().collect()} == {("V", 1, "Age", "seven"), ("V", 2, "age", "9223372036854775808"), ("V", 3, "w", "."), ("V", 3, "age", ""), ("V", 8, "w", "1_0")}
    assert {r["id"]: r["w"] for r in t.wide("E").collect()} == {1: None, 2: -0.5}


def test_wide_empty(spark):
    p, k = spark.createDataFrame([], PROPS), spark.createDataFrame([], KEYS)
    assert WideTables(p, k).wide("V").count() == 0 and WideTables(p, k).unfit().count() == 0
    some = spark.createDataFrame([("V", 1, "a", "x", 1, "y")], PROPS)
    assert WideTables(some, k).wide("V").columns == ["id", "unfit"]
    assert WideTables(p, spark.createDataFrame([("all", "a", "int")], KEYS)).unfit().count() == 0
    with pytest.raises(ValueError):
        WideTables(p.drop("seq"), k)


def test_many_attributes_in_small_plans(spark):
    n = 300
    rows = spark.range(n * 20).selectExpr("'V' AS elem", "id % 20 AS id", f"concat('k', id div 20) AS key", "IF(id % 7 = 0, 'x', cast(id AS string)) AS val", "id AS seq")
    keys = spark.createDataFrame([("node", f"k{i}", "int" if i % 2 else "string") for i in range(n)], KEYS)
    t = WideTables(rows, keys, fan_in=20)
    wide = t.wide("V")
    plan = wide._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Join") <= 20 and len(wide.columns) == n + 2
    got = {r["id"]: r for r in wide.collect()}
    assert all((got[i % 20][f"k{i // 20}"] is None) == (i % 7 == 0 and i // 20 % 2 == 1) for i in range(n * 20))
    assert sum(len(r["unfit"]) for r in got.values()) == t.unfit().count() == sum(i % 7 == 0 and i // 20 % 2 == 1 for i in range(n * 20))


def test_an_entity_with_very_many_undeclared_keys_is_one_cell(spark):
    rows = spark.range(9000).selectExpr("'V' AS elem", "IF(id % 3 = 0, 7, id) AS id", "IF(id % 3 = 0, concat('x', id), 'age') AS key", "string(id) AS val", "id AS seq")
    t = WideTables(rows, spark.createDataFrame([("node", "age", "int")], KEYS))
    assert t.cells.groupBy("id").count().agg({"count": "max"}).first()[0] == 2  # 7 has an age too
    assert t.wide("V").count() == 6000 and t.wide("V").where("id = 7").first().age == 7 and t.unfit().count() == 0


def test_joins_of_narrow_tables_do_not_shuffle(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = WideTables(spark.read.parquet("/root/testdata/sf0.01/props.parquet"), spark.read.parquet("/root/testdata/sf0.01/attr_keys.parquet"))
        plan = t.wide("V")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# ---- 2: seen keys
@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, (1 << 20) - 1), max_size=300), st.sets(st.integers(0, (1 << 20) - 1), max_size=300))
def test_quotient_filter(a, b):
    make = lambda s: quotient.build(np.array(sorted(s), np.uint64), 20)
    fa, fb = make(a), make(b)
    assert quotient.fingerprints(fa).tolist() == sorted(a) and quotient.entries(fa) == len(a)
    assert quotient.fingerprints(quotient.merge(fa, fb)).tolist() == sorted(a | b)
    asked = np.array(sorted(a | b), np.uint64)
    assert quotient.contains(fa, asked).tolist() == [x in a for x in asked.tolist()]


def test_filter_is_compact():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 37, 100_000, dtype=np.uint64))
    assert len(quotient.build(fp, 37)) / len(fp) < 4  # 8 bytes for the plain fingerprints


@pytest.mark.parametrize("bits", [6, 12, 62])
def test_seen_before(spark, bits):
    rng = random.Random(bits)
    keys = [bytes([rng.randrange(40)]) * rng.randrange(3) for _ in range(300)] + [None, b"", b"a\x00", b"a", b"x" * 100_000]
    rows = [(i, k) for i, k in enumerate(keys)]
    rows += rows[::7] + [(None, b"a")]
    rng.shuffle(rows)
    base = [(b"\x01",), (b"\x02\x02",), (None,), (b"\x01",)]
    known, want = {k for (k,) in base}, set()
    for i, k in enumerate(keys):
        if k is not None:
            if k in known:
                want.add(i)
            known.add(k)
    e, b = spark.createDataFrame(rows, "seq bigint, key binary"), spark.createDataFrame(base, "key binary")
    assert {r.seq for r in seen.seen_before(e, b, bits=bits, batches=3, exact=True).collect()} == want
    assert want <= {r.seq for r in seen.seen_before(e, b, bits=bits, exact=False).collect()}  # never the other way


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 58), st.lists(st.integers(0, (1 << 58) - 1), max_size=80))
def test_packed_numbers(width, values):
    x = np.array(values, np.uint64) & np.uint64((1 << width) - 1)
    data = quotient._pack(x, width)
    assert len(data) <= (len(x) * width + 63) // 64 * 8 + 8
    at = np.random.default_rng(0).permutation(len(x))
    assert quotient._values(np.frombuffer(data, "<u8"), width, at).tolist() == x[at].tolist()


def test_lookup_in_a_full_shard_needs_little_memory():
    rng = np.random.default_rng(3)
    have = np.unique(rng.integers(0, 1 << 52, seen.SHARD, dtype=np.uint64))
    tracemalloc.start()
    blob = quotient.build(have, 52)
    built = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    asked = np.concatenate([have[:5], have[:5] ^ np.uint64(1)])
    assert quotient.contains(blob, asked).tolist() == np.isin(asked, have).tolist()
    looked = tracemalloc.get_traced_memory()[1] - len(blob)
    tracemalloc.stop()
    assert built < 16 << 20 and looked < 6 << 20 and len(blob) < 6 * len(have)


def test_billions_of_earlier_keys_stay_in_bounded_shards():
    for earlier in (10**6, 10**9, 10**12):
        assert earlier / (1 << seen.shard_bits(earlier + 10)) <= seen.SHARD


def test_shards_follow_from_the_earlier_keys_too(spark, monkeypatch):
    monkeypatch.setattr(seen, "SHARD", 16)
    made = []
    create = seen.SeenFilter.create
    monkeypatch.setattr(seen.SeenFilter, "create", lambda *a, **kw: made.append(create(*a, **kw)) or made[-1])
    base = spark.range(4000).selectExpr("encode(cast(id AS string), 'utf-8') AS key")
    e = spark.createDataFrame([(1, b"7"), (2, b"x"), (3, b"x")], "seq bigint, key binary")
    assert {r.seq for r in seen.seen_before(e, base).collect()} == {1, 3}
    assert made[0].shard_bits == 8 and made[0].state.count() > 128


def test_seen_empty(spark):
    e, b = spark.createDataFrame([], "seq bigint, key binary"), spark.createDataFrame([(b"a",)], "key binary")
    assert seen.seen_before(e, b).count() == 0
    assert seen.error_rates(e, b, widths=(20,)).first().wrong == 0
    some = spark.createDataFrame([(5, b"a"), (6, b"b"), (7, b"b")], "seq bigint, key binary")
    assert [r.seq for r in seen.seen_before(some, b.limit(0)).collect()] == [7]


def test_error_rate_is_as_derived(spark):
    e = spark.range(40_000).selectExpr("id AS seq", "CAST(CAST(id AS STRING) AS BINARY) AS key")
    r = seen.error_rates(e, spark.createDataFrame([], "key binary"), widths=(18,)).first()
    assert r.records == r.new_records == 40_000 and abs(r.measured_rate - r.derived_rate) < 0.1 * r.derived_rate


# ---- 3: orphans
def test_orphans(spark):
    edges = [
        (1, "7", " 8 ", T(2024, 1, 15)), (2, "+7", "8x", T(2024, 2, 10)), (3, None, "  ", T(2024, 1, 1)), (4, "7", "9", T(2024, 3, 1)), (5, "100", "7", None), (6, "7", "99999999999999999999", T(2024, 1, 1)),
        (7, "8", "8", T(2024, 1, 1)), (8, "8", "100", T(2024, 1, 31)), (1, "7", " 8 ", T(2024, 1, 15)), (None, "5", "100", T(2024, 1, 1)), (9, "7", "7", T(2024, 2, 20)), (10, "7", "x" * 100_000, T(2024, 2, 20)), (11, "-3", "7", T(2023, 1, 1)),
    ]
    life = [(7, T(2023, 12, 5), T(2024, 2, 15)), (7, T(2024, 3, 1), None), (8, T(2024, 1, 1), T(2024, 1, 31)), (8, T(2024, 1, 1), T(2024, 1, 31)), (None, T(2020, 1, 1), None), (-3, None, None)]
    e = spark.createDataFrame(edges, "id bigint, source string, target string, ts timestamp").selectExpr("*", "'clash' AS ID", "1 AS code", "2 AS side")
    v, p = spark.createDataFrame(life, "id bigint, created_ts timestamp, removed_ts timestamp"), spark.createDataFrame([(100,), (None,)], "id bigint")
    got = {(r.edge_id, r.side) for r in References(e, v, p).orphans().collect()}
    assert got == {(2, "target"), (4, "target"), (5, "target"), (6, "target"), (8, "source"), (None, "source"), (9, "source"), (9, "target"), (10, "source"), (10, "target"), (11, "target")}
    assert References(e.limit(0), v, p).orphans().count() == 0
    n = References(e, v.limit(0), p.limit(0)).orphans().count()
    assert n == len({(i, s) for i, a, b, _ in edges for s, x in (("source", a), ("target", b)) if x and x.strip()})


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, orphans.RANGE - 1), max_size=50) | st.just(set(range(0, orphans.RANGE, 3))))
def test_squeezed_bitmaps(places):
    bits = np.zeros(orphans.RANGE, np.uint8)
    bits[list(places)] = 1
    bits = np.packbits(bits, bitorder="little").tobytes()
    data = orphans.squeeze(bits)
    assert orphans.unsqueeze(data).tobytes() == bits and len(data) == min(len(bits), 2 * len(places))


def test_orphans_of_many_lifetimes_and_a_hot_key(spark):
    rng = random.Random(8)
    at = lambda: T(2020, 1, 1) + dt.timedelta(hours=rng.randrange(3 * 365 * 24))
    life = [(k, min(a, b), None if rng.random() < 0.2 else max(a, b)) for k in range(40) for a, b in [(at(), at()) for _ in range(rng.randrange(4))]]
    edges = [(i, str(7 if rng.random() < 0.5 else rng.randrange(60)), str(rng.randrange(60)), at()) for i in range(3000)]
    v, p = spark.createDataFrame(life, "id bigint, created_ts timestamp, removed_ts timestamp"), spark.createDataFrame([(55,)], "id bigint")
    r = References(spark.createDataFrame(edges, "id bigint, source string, target string, ts timestamp"), v, p)
    lives = lambda k, t: k == 55 or any(i == k and a <= t and (b is None or t < b) for i, a, b in life)
    assert {(x.edge_id, x.side) for x in r.orphans().collect()} == {(i, s) for i, a, b, t in edges for s, k in (("source", a), ("target", b)) if not lives(int(k), t)}
    parts = {x.key: x.parts for x in r.heavy().collect()}
    assert parts[7] > 3 and len(parts) <= orphans.SPREAD * 4 and sum(parts.values()) <= 2 * orphans.SPREAD * 4


# ---- 4: hot keys
def test_hot(spark):
    rows = [(1, "outE", e, "l" if e % 2 else None, e, T(2024, 1, 1)) for e in range(600)] + [(v, "outE", v, "k", v, None) for v in range(2, 402)] + [(None, "outE", 5, None, 1, None), (3, None, 1, "a", 1, None), (9, "inE", None, "a", 1, None)]
    a = spark.createDataFrame(rows + rows[:50], "vertex_id bigint, key string, edge_id bigint, label string, seq bigint, ts timestamp").selectExpr("*", "1 AS KEY")
    assert {(r.key, r.vertex_id) for r in hotkeys.hot(a).collect()} == {("outE", 1), ("inE", 9)}
    r = {(x.key, x.vertex_id): x for x in hotkeys.report(a).collect()}[("outE", 1)]
    assert (r.degree, r.writes, r.labels, r.first_edge, r.last_edge) == (600, 650, 1, 0, 599)
    blocks = hotkeys.edge_lists(a, span=100).where("vertex_id = 1").orderBy("block").collect()
    assert [e for b in blocks for e in b.edges] == list(range(600)) and max(b.n for b in blocks) == 100
    assert hotkeys.hot(a.limit(0)).count() == hotkeys.report(a.limit(0)).count() == 0


# ---- 5: nested records
def brute_elements(rows):
    found = set()
    lst = lambda x: x if isinstance(x, list) else [x]
    text = lambda x: "" if x is None else str(x)

    def graphs(record, holder, parent):
        for g in lst(holder.get("graph")):
            if isinstance(g, dict):
                for name in ("node", "edge"):
                    for e in lst(g.get(name)):
                        if isinstance(e, dict):
                            keys = {text(d.get("key")) for d in lst(e.get("data")) if isinstance(d, dict) and d.get("key") is not None}
                            found.update((record, text(e.get("id")), parent, k) for k in keys or {""})
                            if name == "node":
                                graphs(record, e, text(e.get("id")))

    for record, payload in rows:
        try:
            top = json.loads(payload)
        except (ValueError, TypeError):
            continue
        if isinstance(top, dict):
            graphs(record, top, "")
    return found


def test_elements_equal_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/raw_records.parquet").select("record_id", "payload").collect()]
    assert {tuple(r) for r in QUERIES["p5_found"](spark, "/root/testdata/sf0.01").collect()} == brute_elements(rows)


def test_nested_edge_cases(spark):
    deep = '{"graph":{"node":{"id":1,"data":{"key":"k"}}}}'
    for i in range(2, 400):
        deep = '{"graph":{"node":{"id":%d,%s}}}' % (i, deep[1:-1])
    rows = [
        (1, '{"graph": {"node": [{"id": 1.50, "data": [{"key": 5}, {"key": null}, "x", {"key": "a", "value": {"z": {"y": 1}}}]}, null, 3], "edge": {"id": "e\\ud800", "source": 1}}}'),
        (1, '{"graph": {"node": {"id": "n", "graph": [{"node": {"data": []}}, {"edge": []}], "port": [{"name": "p"}]}}, "meta": {"origin": {"path": "x", "tags": ["a", "b"]}}}'),
        (2, None), (3, ""), (4, "[1, 2]"), (5, '{"graph": {"node": [{"id": 1}'), (6, '{"graph": null}'), (7, deep), (None, '{"graph": {"edge": {"id": true}}}'), (8, '{"graph": NaN}'), (7, deep), (9, "[" * 50_000 + "]" * 50_000),
    ]
    flat = graph_tables(spark.createDataFrame([(a, b, 1) for a, b in rows], "record_id bigint, payload string, doc int"))
    got = {tuple(r) for r in graph_elements(flat).collect()}
    assert {g for g in got if g[0] == 1} == {(1, "1.50", "", "5"), (1, "1.50", "", "a"), (1, "e?", "", ""), (1, "n", "", ""), (1, "", "n", "")}
    assert len({g for g in got if g[0] == 7}) == 399 and (7, "1", "2", "k") in got and (None, "true", "", "") in got
    assert "meta_origin_path" in flat.columns["record"] and flat.columns["origin_tags"] == ["item"]
    assert [r["item"] for r in flat.table("origin_tags").orderBy("n").collect()] == ["a", "b"]
    ports = flat.table("port").join(flat.table("node", "id").withColumnRenamed("row_id", "p").select("p", "id"), None).where("parent_row = p").collect()
    assert [(r["name"], r["id"]) for r in ports] == [("p", "n")]
    inlined = FlatTables(spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "d": [{"e": {"f": 2}}, {"e": null}]}')], "record_id bigint, payload string"))
    assert inlined.columns == {"record": ["a_b_c"], "d": ["e", "e_f"]}
    empty = graph_tables(spark.createDataFrame([], "record_id bigint, payload string"))
    assert graph_elements(empty).count() == 0 and empty.table("node").count() == 0


def test_names_that_clash(spark):
    rows = [(1, '{"a_b": 1, "a": {"b": 2, "x": [7, 8]}, "n": 3, "row_id": 4, "id": 5, "Id": 6}'), (2, '{"a_x": [{"q": 1}]}'), (3, '{"record": [{"z": 9}], "Record": [{"z": 10}], "": {"": 11}}')]
    flat = FlatTables(spark.createDataFrame(rows, "record_id bigint, payload string"))
    assert all(len({c.lower() for c in [*inline.KEYS, *cs]}) == len(cs) + len(inline.KEYS) for cs in flat.columns.values())
    got = flat.element("record", "z").collect(), flat.element("Record", "z").collect(), flat.element("a_x", "q").collect()
    assert [[(r[-1]) for r in rs] for rs in got] == [["9"], ["10"], ["1"]]
    assert [r["item"] for r in flat.table("a_x_2").orderBy("n").collect()] == ["7", "8"]
    top = {r.record_id: r.asDict() for r in flat.table(flat.graph.tables[(inline.TOP,)]).collect()}
    assert sorted(v for k, v in top[1].items() if v is not None and k not in inline.KEYS) == list("123456")
    assert len(set(map(str.lower, flat.graph.tables.values()))) == len(flat.graph.tables)


def test_only_what_is_asked_for(spark):
    records = spark.read.parquet("/root/testdata/sf0.001/raw_records.parquet")
    whole, some = graph_tables(records), graph_tables(records, only=LINKS)
    assert {r.tbl for r in some.rows.select("tbl").distinct().collect()} == {"node", "edge", "graph", "data"}
    for t, cs in LINKS.items():
        assert sorted(map(str, some.element(t, *cs).collect())) == sorted(map(str, whole.element(t, *cs).collect()))
    with pytest.raises(ValueError):
        some.table("data", "value")


NAMES = st.sampled_from(["a", "A", "b", "a_b", "b_a", "n", "", "record", "item", "a_a", "id", "row_id"])
SCALARS = st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=2)
OBJECTS = st.dictionaries(NAMES, st.recursive(SCALARS, lambda x: st.lists(x, max_size=3) | st.dictionaries(NAMES, x, max_size=4), max_leaves=12), max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(OBJECTS, max_size=4))
def test_every_scalar_comes_back(records):
    texts = [json.dumps(r) for r in records]
    found = [tuple(r) for pdf in inline._analyse(frozenset())(iter([pd.DataFrame({"payload": texts})])) for r in pdf.itertuples(index=False)]
    children = {}
    for what, e, n in found:
        if what in ("o", "oo"):
            children[e, n] = children.get((e, n), False) or what == "oo"
    graph = inline.SchemaGraph(children, frozenset((e, n) for w, e, n in found if w == "a"), frozenset((e, n) for w, e, n in found if w == "l"))
    batch = pa.RecordBatch.from_pydict({"record_id": list(range(len(texts))), "doc": [str(i) for i in range(len(texts))], "payload": texts})
    rows = [r for rb in inline._shred(graph, frozenset(), None, batch=3)(iter([batch])) for r in rb.to_pylist()]
    want = []
    for i, r in enumerate(records):
        todo = [r]
        while todo:
            x = todo.pop()
            for v in x.values():
                for y in v if isinstance(v, list) else [v]:
                    if isinstance(y, dict):
                        todo.append(y)
                    else:
                        want.append((i, jsontext.dump(jsontext.parse(json.dumps(y))[1])))
    assert sorted(map(str, want)) == sorted(str((r["record_id"], v)) for r in rows for _, v in r["vals"])
    layout = graph.layout()
    assert all(len({k for k, _ in r["vals"]}) == len(r["vals"]) and {k for k, _ in r["vals"]} <= set(layout[r["tbl"]]) for r in rows)
    ids = {(r["tbl"], r["row_id"]) for r in rows}
    assert len(ids) == len(rows) and all(r["parent_row"] is None or (r["parent_tbl"], r["parent_row"]) in ids for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=15))
def test_json_reader(value):
    text = json.dumps(value)
    assert jsontext._deep(text) == jsontext.parse(text)[1]
    for broken in (text[:-1], text + ",", text + " 1"):
        try:
            json.loads(broken)
        except ValueError:
            assert jsontext.parse(broken) == (False, None)
            with pytest.raises(ValueError):
                jsontext._deep(broken)
