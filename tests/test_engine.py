"""The store, the graph, traversals, codecs, importers and streams."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.functions import codec
from loamgraph.functions.bloom import Bloom
from loamgraph.operators import changelog, ordered, traverse
from loamgraph.operators.graph import FEATURES, PropertyGraph
from loamgraph.operators.store import Store
from loamgraph.sources import importers
from loamgraph import session
from loamgraph.streaming import replay
from loamgraph.streaming.status import Status

EDGES = [(7, 1, 2, "knows", 0.5), (8, 1, 4, "knows", 1.0), (9, 1, 3, "created", 0.4), (10, 4, 5, "created", 1.0), (11, 4, 3, "created", 0.4), (12, 6, 3, "created", 0.2)]
PEOPLE = {1: ("marko", 29, None), 2: ("vadas", 27, None), 3: ("lop", None, "java"), 4: ("josh", 32, None), 5: ("ripple", None, "java"), 6: ("peter", 35, None)}


@pytest.fixture(scope="module")
def graphml(tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "g.graphml"
    data = lambda **kw: "".join(f'<data key="{k}">{v}</data>' for k, v in kw.items() if v is not None)
    keys = "".join(f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in (("weight", "edge", "float"), ("name", "node", "string"), ("age", "node", "int"), ("lang", "node", "string")))
    nodes = "".join(f'<node id="{i}">{data(name=n, age=a, lang=lang)}</node>\n' for i, (n, a, lang) in PEOPLE.items())
    edges = "".join(f'<edge id="{i}" source="{a}" target="{b}" label="{lab}">{data(weight=w)}</edge>\n' for i, a, b, lab, w in EDGES)
    path.write_text(f'<?xml version="1.0"?><graphml>{keys}<graph id="G" edgedefault="directed">{nodes}{edges}</graph></graphml>')
    return str(path)


@pytest.fixture(scope="module")
def g(spark, graphml):
    return importers.graphml(spark, graphml)


def ids(df, *order, column="w"):
    return [r[column] for r in df.orderBy(*order).collect()]


# ---- change log and store
def test_store_against_a_dict(spark, tmp_path):
    rng, model = random.Random(4), {}
    store = Store(spark, f"file://{tmp_path}/s", bloom=True)
    assert list(store) == [] and store.get("a") is None
    for step in range(6):
        keys = [bytes([rng.randrange(5), rng.choice([0, 127, 128, 255])])[: rng.randrange(3)] for _ in range(8)]
        if step % 3 == 2:
            store.remove_batch(spark.createDataFrame([(k,) for k in keys], "k binary"))
            for k in keys:
                model.pop(k, None)
        else:
            rows = [(k, b"" if rng.random() < 0.3 else bytes([step])) for k in dict.fromkeys(keys)]
            store.put_batch(spark.createDataFrame(rows, "k binary, v binary"))
            model.update(rows)
        store = Store(spark, f"file://{tmp_path}/s")  # opened again
        assert list(store) == sorted(model.items())
        if step == 3:
            store.compact()
            store.vacuum()
            assert list(store) == sorted(model.items()) and len(store.runs) == 1
    some = sorted(model)[len(model) // 2]
    assert store.get(some) == model[some] and store.exists(some) and not store.exists(b"zz")
    assert list(store.seek(some)) == [x for x in sorted(model.items()) if x[0] >= some]
    assert [bytes(r.k) for r in store.scan(prefix=b"\x01", reverse=True).collect()] == [k for k in sorted(model, reverse=True) if k.startswith(b"\x01")]
    assert {(bytes(r.k), r.found) for r in store.multi_get(spark.createDataFrame([(some,), (b"zz",)], "k binary")).collect()} == {(some, True), (b"zz", False)}
    assert list(store.copy_to(f"file://{tmp_path}/t")) == sorted(model.items())
    assert store.stats().agg(F.sum("entries")).first()[0] == store.info()["entries"] > 0
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/s", cache=1)


def test_levels_against_a_dict(spark, tmp_path):
    """Steps of compaction keep the state; files of a level do not overlap; a get reads only what can hold its key."""
    rng, model = random.Random(9), {}
    store = Store(spark, f"file://{tmp_path}/s", first=2, base_bytes=4000, file_bytes=2000)
    done = set()
    for step in range(7):
        keys = [b"%05d" % rng.randrange(2000) for _ in range(120)]
        if step % 4 == 3:
            store.remove_batch(spark.createDataFrame([(k,) for k in keys], "k binary"))
            for k in keys:
                model.pop(k, None)
        else:
            rows = [(k, b"%d.%d" % (step, i), i) for i, k in enumerate(keys)]
            store.put_batch(spark.createDataFrame(rows, "k binary, v binary, at int"), order="at")
            model.update((k, v) for k, v, _ in rows)
        while (level := store.compact_step()) is not None:
            done.add(level)
        by_level = {}
        for r in store.runs:
            by_level.setdefault(r.level, []).append(r)
        for n, runs in by_level.items():
            assert not n or all(a.largest < b.smallest for a, b in zip(runs, runs[1:]))
        assert all(s < 1 for s in store.scores().values())
    store = Store(spark, f"file://{tmp_path}/s")
    assert list(store) == sorted(model.items()) and done >= {0, 1} and max(r.level for r in store.runs) >= 2
    key = sorted(model)[len(model) // 2]
    assert store.get(key) == model[key] and len(store.runs_of(key, key)) < len(store.runs) / 2
    assert [bytes(r.k) for r in store.scan(prefix=b"00").collect()] == [k for k in sorted(model) if k.startswith(b"00")]
    assert [bytes(r.k) for r in store.scan(lo=b"01", hi=b"011").collect()] == [k for k in sorted(model) if b"01" <= k <= b"011"]
    store.vacuum()
    assert list(Store(spark, f"file://{tmp_path}/s", cache_bytes=1 << 30)) == sorted(model.items()) and store._versions() == [store.version]


def test_a_failed_write_is_no_hindrance(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path)
    store.add("a", "1")
    rows = spark.createDataFrame([("b", 5, "ADD", "2")], LOG)
    for change in (lambda s: s.append_log(rows), lambda s: s.compact()):
        with monkeypatch.context() as m:
            m.setattr(Store, "_commit", lambda self, runs: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                change(store)
        store = Store(spark, path)  # the writer starts again and repeats the batch
        change(store)
        change(store)
    assert list(Store(spark, path)) == [(b"a", b"1"), (b"b", b"2")]
    folders = len(os.listdir(tmp_path / "s"))
    store.vacuum()
    assert len(os.listdir(tmp_path / "s")) < folders and list(Store(spark, path)) == [(b"a", b"1"), (b"b", b"2")]


def test_script_of_reopening(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for k, v in (("V7", "vertex 7"), ("V6", "vertex 6"), ("E5", "edge 2")):
        Store(spark, path).add(k, v)
    for _ in range(2):
        for k in ("V7", "V6"):
            Store(spark, path).remove(k)
    assert list(Store(spark, path).seek(b"\x00")) == [(b"E5", b"edge 2")] and Store(spark, path).get("E5") == b"edge 2"


def test_log_semantics(spark):
    rows = [("a", 1, "ADD", "x"), ("a", 3, "DEL", None), ("a", 2, "ADD", "late"), ("b", 1, "ADD", ""), ("c", 1, "ADD", None), ("d", 1, "ADD", "1"), ("d", 1, "ADD", "2"), (None, 9, "ADD", "n"), ("e", None, "ADD", "old"), ("ab", 1, "ADD", "p")]
    log = spark.createDataFrame(rows, "k string, seq bigint, op string, v string")
    assert [tuple(r) for r in changelog.scan(log).collect()] == [("ab", "p"), ("b", ""), ("c", None), ("d", "2"), ("e", "old")]
    assert changelog.tombstones(log).first().k == "a" and changelog.compact(log, base_level=False).count() == 6
    assert [r.version for r in changelog.history(log).where("k = 'a'").orderBy("version").collect()] == [1, 2, 3]
    assert changelog.snapshot(log.limit(0)).count() == 0
    assert "StringStartsWith" in plan(changelog.scan(spark.read.parquet("/root/testdata/sf0.001/customer.parquet").selectExpr("c_name AS k", "c_custkey AS seq", "'ADD' AS op", "c_acctbal AS v"), prefix="C"))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stored_tables_can_be_released(spark, tmp_path):
    from loamgraph import session

    kept = session._written[:]
    session._written.clear()
    df = session.stored(spark.range(3).selectExpr("id", "id % 2 AS p"), "t", "p")
    folder = session._written[0].replace("file://", "")
    assert df.count() == 3 and os.path.isdir(folder)
    session.release(spark)
    assert not os.path.exists(folder) and not session._written
    session._written.extend(kept)
    assert session.stored(spark.range(0), "t").count() == 0


# ---- order
def test_ordered(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(-50, 5000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x bigint, i bigint")
    want, by = {}, {}
    for g, x, i in sorted(rows):
        by.setdefault(g, []).append((x, i))
    for g, xs in by.items():
        for n, (x, i) in enumerate(xs, 1):
            want[i] = n
    assert {r.i: r.n for r in ordered.ranked(df, ["g"], "x", "n", F.col("i")).collect()} == want
    down = {r.i: r.n for r in ordered.ranked(df, ["g"], "x", "n", F.desc("i"), descending=True).collect()}
    assert all(down[i] == len(by[g]) + 1 - want[i] for g, _, i in rows)
    sets = df.select("g", "x").distinct()
    d = ordered.differences(sets, ["g"], "x", "d")
    assert all(r.s == r.x for r in ordered.running(d, ["g"], "x", "d", "s").collect())
    assert [r.i for r in ordered.numbered(df, "x", "i").orderBy("place").collect()] == [i for _, i in sorted((x, i) for _, x, i in rows)]
    assert ordered.numbered(df.limit(0), "x").count() == 0 == ordered.ranked(df.limit(0), ["g"], "x", "n").count()


# ---- graph
def test_golden(g, spark):
    one, three = g.v(1), g.v(3)
    assert ids(g.neighbours("out", seeds=one), "edge_id") == [2, 4, 3]
    e = g.e(12).first()
    assert (e.src, e.dst) == (6, 3)
    assert ids(g.neighbours("in", ["created"], three), "edge_id") == [1, 4, 6]
    assert ids(g.incident("in", ["created"], three), "edge_id", column="src") == [1, 4, 6]
    assert g.e(99).count() == 0 and g.next_id("E") == 13
    assert {r.id for r in g.having("V", "lang", "java").collect()} == {3, 5}
    assert {r.id for r in g.having_between("V", "age", 28, 33, "bigint").collect()} == {1, 4}
    assert {r.id: r.val for r in g.property("V", "lang", "?").collect()}[1] == "?"
    assert {r.key for r in g.property_keys("V").where("id = 1").collect()} == {"name", "age"}
    assert ids(g.query().labels("created").interval("weight", 0.3, 1.0).direction("out").vertices(), "edge_id") == [3, 3]
    assert {(r.v, r.n) for r in g.query().has("weight", 1.0).direction("out").count().collect()} == {(1, 1), (4, 1)}
    assert {(r.id, r.degree) for r in g.degrees().collect()} == {(1, 3), (2, 1), (3, 3), (4, 3), (5, 1), (6, 1)}
    assert {r.id: r.hops for r in traverse.k_hop(g.edges, one.select("id"), 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}
    assert sorted(r.w for r in traverse.walk(g.edges, one.select("id"), ["out", "in"], [["created"], ["created"]]).collect()) == [1, 4, 6]
    counts = {r.id: int(r.walks) for r in traverse.walk_counts(g.edges, ["out", "in", "out"]).collect()}
    assert counts == {i: traverse.walk(g.edges, g.v(i).select("id"), ["out", "in", "out"]).count() for i in (1, 4, 6)}
    assert [r.text for r in g.e(7).select(codec.edge_text(F.col("id"), F.col("src"), F.col("label"), F.col("dst")).alias("text")).collect()] == ["e[7][1-knows->2]"]


def test_changes(g, spark):
    loop = spark.createDataFrame([(20, 6, 6, "self"), (21, 6, 99, "lost"), (7, 1, 5, "moved")], "id bigint, src bigint, dst bigint, label string")
    h = g.add_vertices(spark.createDataFrame([(6,), (50,), (None,)], "id bigint")).add_edges(loop)
    assert h.vertices.count() == 7 and h.e(7).first().dst == 5
    assert ids(h.neighbours("both", ["self"], h.v(6)), "dir") == [6, 6]
    assert [tuple(r) for r in h.dangling().collect()] == [(21, "dst")]
    gone = h.remove_vertices(spark.createDataFrame([(1,)], "id bigint"))
    assert {r.id for r in gone.dangling().collect()} == {7, 8, 9, 21} and gone.property("V", "name").count() == 6
    clean = h.remove_vertices(spark.createDataFrame([(1,)], "id bigint"), cascade=True)
    assert clean.edges.where("src = 1 OR dst = 1").count() == 0 and clean.props.where("elem = 'V' AND id = 1").count() == 0 and clean.props.where("elem = 'E' AND id = 8").count() == 0
    p = h.set_properties(spark.createDataFrame([("V", 1, "name", "new"), ("V", 2, "name", None), ("V", 50, "name", "")], "elem string, id bigint, key string, val string"))
    assert {r.id: r.val for r in p.property("V", "name").collect()} | {3: 0, 4: 0, 5: 0, 6: 0} == {1: "new", 2: None, 50: "", 3: 0, 4: 0, 5: 0, 6: 0}
    hooked = h.with_hook("tags", lambda c: F.lower(c), lambda c: F.array_join(F.array_sort(F.split(c, " ")), " "))
    hooked = hooked.set_properties(spark.createDataFrame([("V", 1, "tags", "B A"), ("V", 1, "name", "X")], "elem string, id bigint, key string, val string"))
    assert hooked.props.where("key = 'tags'").first().val == "b a" and hooked.property("V", "tags").where("id = 1").first().val == "a b" and hooked.property("V", "name").where("id = 1").first().val == "X"
    assert h.remove_edges(spark.createDataFrame([(20,)], "id bigint")).counts().where("elem = 'E'").first().n == 7
    assert PropertyGraph.new(spark).degrees().count() == 0


def test_blocks_of_clustered_numbers(spark):
    df = spark.range(20_000).selectExpr("id % 2 AS g", "IF(id = 7, 1000000000000000000, IF(id = 8, NULL, id)) AS x")
    sizes = [r["count"] for r in ordered._blocked(df, "x").groupBy("_b").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10 * 20_000 / ordered.BLOCKS
    got = sorted((r.g, r.x is not None, r.x or 0, r.n) for r in ordered.ranked(df, ["g"], "x", "n").collect())
    assert [n for *_, n in got] == [*range(1, 10_001)] * 2
    sums = {(r.g, r.x): r.s for r in ordered.running(ordered.differences(df.where("x IS NOT NULL"), ["g"], "x", "d"), ["g"], "x", "d", "s").collect()}
    assert len(sums) == 19_999 and all(x == s for (_, x), s in sums.items())


def test_typed_values(g, spark):
    t = g.typed(spark.createDataFrame([("V", "age", "int"), ("E", "weight", "float")], "elem string, key string, type string"))
    assert ids(t.having("V", "age", 29), "id", column="id") == [1] and t.having("V", "age", "29").count() == 0 and g.having("V", "age", "29").count() == 1
    assert ids(t.having("E", "weight", 1.0), "id", column="id") == [8, 10] and t.having("E", "weight", 1).count() == 0
    lists = spark.createDataFrame([("V", 1, "tags", ["b", "a"]), ("V", 2, "tags", [])], "elem string, id bigint, key string, val array<string>")
    maps = spark.createDataFrame([("V", 3, "m", {"x": 1})], "elem string, id bigint, key string, val map<string,int>")
    bools = spark.createDataFrame([("V", 4, "b", True), ("V", 5, "b", None)], "elem string, id bigint, key string, val boolean")
    t = t.set_properties(lists).set_properties(maps).set_properties(bools).set_properties(spark.createDataFrame([("V", 6, "s", 'a"b')], "elem string, id bigint, key string, val string"))
    assert [t.having("V", k, v).count() for k, v in (("tags", ["b", "a"]), ("tags", []), ("m", {"x": 1}), ("b", True), ("s", 'a"b'), ("b", "true"), ("b", 1))] == [1, 1, 1, 1, 1, 0, 0]
    assert all(FEATURES[f"supports{kind}Property"] for kind in ("Map", "UniformList", "MixedList", "Boolean", "Long")) and not FEATURES["supportsSerializableObjectProperty"]
    values = t.props.select("val", codec.unpack_json(codec.pack_json("val")).alias("again"), codec.json_text(F.col("val")).alias("text")).collect()
    assert all(r.val == r.again for r in values) and {'a"b', "marko", "29", '["b","a"]'} <= {r.text for r in values}
    assert {(r.v, r.n) for r in t.query().has("weight", 1.0).direction("out").count().collect()} == {(1, 1), (4, 1)}
    assert g.typed().having("V", "age", "29").count() == 1


def test_a_vertex_with_a_third_of_all_edges_is_split(spark):
    """The joins of traversals are split by the engine where one vertex has very many edges; the aggregates after them do not prevent it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(60_000).repartition(6).selectExpr("id", "IF(id % 3 = 0, 7, id % 5000) AS src", "(id * 17) % 20000 AS dst", "'l' AS label")
        seeds = spark.range(5000)
        reached = traverse.neighbours(edges, seeds, "out").select("w").distinct()
        degree = traverse.incident(edges, seeds, "out").groupBy("dst").count()
        for df in (reached, degree):
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_limit_and_ids(g, spark):
    first = g.query().limit(1).edges().collect()
    assert {(r.v, r.edge_id) for r in first} == {(1, 7), (2, 7), (3, 9), (4, 8), (5, 10), (6, 12)} and len(first) == 6
    assert {(r.v, r.w) for r in g.query().direction("out").labels("knows").vertex_ids().collect()} == {(1, 2), (1, 4)}
    new = g.with_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), "V", "name").orderBy("id").collect()
    assert [(r.id, r.name) for r in new] == [(7, "a"), (8, "b"), (9, "c")]
    twice = g.add_edges(spark.createDataFrame([(30, 1, 2, "a"), (30, 1, 3, "b"), (None, 1, 1, "x")], "id bigint, src bigint, dst bigint, label string"))
    assert tuple(twice.e(30).first()) == (30, 1, 3, "b") and twice.edges.count() == 7
    loops = g.add_edges(spark.range(70_000).selectExpr("id + 100 AS id", "1L AS src", "1L AS dst", "'l' AS label"))
    assert {r.id: int(r.walks) for r in traverse.walk_counts(loops.edges, ["out"] * 5).where("id = 1").collect()}[1] > 70_000**5


def test_bloom(spark):
    keys = spark.range(20_000).selectExpr("IF(id % 100 = 0, NULL, encode(string(id), 'utf-8')) AS k").unionByName(spark.range(5000).selectExpr("encode('7', 'utf-8') AS k"))
    asked = spark.range(10_000, 60_000).selectExpr("encode(string(id), 'utf-8') AS k", "id")
    got = {r.id for r in Bloom(keys, "k").maybe(asked, "k").collect()}
    there = {i for i in range(10_000, 20_000) if i % 100}
    assert there <= got and len(got - there) < 0.03 * 40_000
    assert Bloom(keys.limit(0), "k").maybe(asked, "k").count() == 0 == Bloom(keys, "k").maybe(asked.limit(0), "k").count()


def test_graphml_rejects(spark, tmp_path):
    keys = '<key id="age" for="node" attr.name="age" attr.type="int"/><key id="w" for="edge" attr.name="share" attr.type="float"/><key id="d" for="node" attr.name="d" attr.type="date"/>'
    nodes = '<node id="1"><data key="age">x</data></node><node id="n0"/><node id="2"><data key="age">7</data><data key="d">today</data></node>'
    edges = '<edge id="5" source="1" target="2"><data key="w">half</data></edge><edge id="e" source="1" target="2"/><edge id="6" source="n0" target=""/>'
    (tmp_path / "r.graphml").write_text(f'<?xml version="1.0"?><graphml>{keys}<graph>{nodes}{edges}</graph></graphml>')
    path = str(tmp_path / "r.graphml")
    got = {tuple(r) for r in importers.graphml_rejects(spark, path).collect()}
    assert {x[:3] for x in got} == {("V", "n0", "id"), ("E", "e", "id"), ("E", "6", "source"), ("E", "6", "target"), ("V", "1", "age"), ("E", "5", "share")}
    g = importers.graphml(spark, path)
    assert ids(g.vertices, "id", column="id") == [1, 2] and ids(g.edges, "id", column="id") == [5]
    with pytest.raises(ValueError):
        importers.graphml(spark, path, strict=True)


def test_importers(spark, tmp_path, graphml):
    (tmp_path / "a.txt").write_text("1 2\n2 3\n\nx y\n")
    (tmp_path / "b.txt").write_text("3\t1\n1 2\n")
    g = importers.edge_list(spark, f"file://{tmp_path}/*.txt")
    assert [tuple(r) for r in g.edges.orderBy("id").collect()] == [(0, 1, 2, "link"), (1, 2, 3, "link"), (4, 3, 1, "link"), (5, 1, 2, "link")] and g.vertices.count() == 3
    (tmp_path / "ids").write_text("1 2\n 17 z\n")
    assert [r.id for r in importers.id_list(spark, f"file://{tmp_path}/ids").collect()] == [1, 2, 17]
    assert importers.check_types(spark, graphml).count() == 0
    w = importers.workload(spark, 500, keys=50, puts=0.5, dels=0.1)
    assert w.select("op").distinct().count() == 3 and changelog.snapshot(w.where("op <> 'GET'")).count() <= 50 and {len(r.v) for r in w.collect()} == {100}


def test_nested_graphml(spark, tmp_path):
    deep = '<node id="4"><data key="name">a &lt; b &amp; c</data><graph><node id="5"><graph><node id="6"><data key="age">7</data></node></graph></node></graph></node>'
    inner = f'<graph><node id="2"><data key="name">in</data></node>{deep}<edge id="7" source="1" target="2" label="x"/></graph>'
    outer = '<edge id="8" source="1" target="3"><graph><node id="9"/><edge id="10" source="9" target="2" label="y &amp; z"><data key="weight">0.5</data></edge></graph></edge>'
    keys = '<key id="age" for="node" attr.name="age" attr.type="int"/><key id="weight" for="edge" attr.name="weight" attr.type="float"/>'
    (tmp_path / "n.graphml").write_text(f'<?xml version="1.0"?><graphml>{keys}<graph id="G"><node id="1"><data key="name">out</data>{inner}</node><node id="3"/>{outer}</graph></graphml>')
    g = importers.graphml(spark, str(tmp_path / "n.graphml"))
    assert ids(g.vertices, "id", column="id") == [1, 2, 3, 4, 5, 6, 9]
    assert [tuple(r) for r in g.edges.orderBy("id").collect()] == [(7, 1, 2, "x"), (8, 1, 3, None), (10, 9, 2, "y & z")]
    assert sorted(map(tuple, g.props.collect())) == [("E", 10, "weight", "0.5"), ("V", 1, "name", "out"), ("V", 2, "name", "in"), ("V", 4, "name", "a < b & c"), ("V", 6, "age", "7")]
    assert g.dangling().count() == 0


def test_graphml_declarations_by_kind(spark, tmp_path):
    key = lambda i, kind, name, type_: f'<key id="{i}" {kind} attr.name="{name}" attr.type="{type_}"/>'
    keys = key("w", 'for="node"', "weight", "int") + key("w", 'for="edge"', "share", "float") + key("a", 'for="all"', "any", "int") + key("b", "", "both", "float") + key("o", 'for="edge"', "only", "int")
    keys += key("r", 'for="node"', "first", "int") + key("r", 'for="node"', "last", "string") + key("r", 'for="all"', "other", "int")
    data = lambda *pairs: "".join(f'<data key="{k}">{v}</data>' for k, v in pairs)
    node = f'<node id="1">{data(("w", 3), ("a", 4), ("b", 0.5), ("o", "text"), ("r", "x"))}</node>'
    edge = f'<edge id="2" source="1" target="1">{data(("w", 0.5), ("a", 5), ("b", 1.5), ("o", 6), ("r", 7))}</edge>'
    for name, text in (("1", keys), ("2", "".join(reversed([f"<key {k}" for k in keys.split("<key ")[1:6]])) + keys[keys.index('<key id="r"') :])):  # the order of other declarations does not matter
        (tmp_path / name).write_text(f'<?xml version="1.0"?><graphml>{text}<graph>{node}{edge}</graph></graphml>')
        got = {(r.elem, r.key): r.val for r in importers.graphml(spark, str(tmp_path / name)).props.collect()}
        assert got == {("V", "weight"): "3", ("V", "any"): "4", ("V", "both"): "0.5", ("V", "o"): "text", ("V", "last"): "x", ("E", "share"): "0.5", ("E", "any"): "5", ("E", "both"): "1.5", ("E", "only"): "6", ("E", "other"): "7"}


# ---- codecs
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text(max_size=40), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=4), x, max_size=18), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_pack(value):
    data = codec.pack(value)
    assert codec.unpack(data) == value
    for broken in (data[:-1], data + b"\xc0"):
        with pytest.raises((ValueError, IndexError)):
            codec.unpack(broken)


def test_byte_functions(spark):
    assert codec.crc32c([b"123456789", b"", b"\x00" * 32, b"a"]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0xC1D04330] and len(codec.crc32c([])) == 0
    for n in (0, 1, 127, 128, 300, (1 << 63) - 1):
        assert codec.varint_decode(codec.varint_encode(n)) == (n, len(codec.varint_encode(n)))
    r = spark.createDataFrame([(n,) for n in (0, 127, 128, 1 << 40)], "n bigint").select("n", codec.varint_size(F.col("n")).alias("s")).collect()
    assert all(x.s == len(codec.varint_encode(x.n)) for x in r)
    r = spark.createDataFrame([(n,) for n in (0, 127, 128, 1 << 40, (1 << 63) - 1)], "n bigint").select("n", codec.varint(F.col("n")).alias("v")).select("*", codec.varint_value(F.col("v")).alias("b")).collect()
    assert all(bytes(x.v) == codec.varint_encode(x.n) and x.b == x.n for x in r)
    c = spark.createDataFrame([(b"123456789",), (None,)], "b binary").select(codec.crc32c_column("b").alias("c"), codec.to_hex(F.col("b")).alias("h")).collect()
    assert [x.c for x in c] == [0xE3069283, None] and c[0].h == "0x313233343536373839"
    lists = spark.createDataFrame([([5, 1, 9, 9],), ([],)], "x array<bigint>").select(codec.delta_encode(F.col("x")).alias("d")).select("d", codec.delta_decode(F.col("d")).alias("x")).collect()
    assert [(x.d, x.x) for x in lists] == [([1, 4, 4, 0], [1, 5, 9, 9]), ([], [])]
    k = spark.createDataFrame([("V/17/name",), ("v/3",), ("x",)], "k string").select(codec.last_part(F.col("k")).alias("p"), codec.id_part(F.col("k")).alias("i")).collect()
    assert [(x.p, x.i) for x in k] == [("name", 17), ("3", 3), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("1.9",), ("x",), ("7",)], "s string").select(codec.to_long(F.col("s"))).collect()] == [1, None, 7]


# ---- streams
LOG = "k string, seq bigint, op string, v string"
BATCHES = [[("a", 5, "ADD", "5"), ("b", 1, "ADD", "")], [("a", 9, "DEL", None), ("c", 2, "ADD", "2")], [("a", 7, "ADD", "late"), ("b", 3, "ADD", "3")]]


def stream(spark, tmp_path, name):
    src = tmp_path / name
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"file://{src}/{i}")
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{src}/*")


def test_late_writes_lose(spark, tmp_path):
    q = replay.streaming_updates(stream(spark, tmp_path, "u")).writeStream.format("memory").queryName("updates").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.seq, r.op) for r in changelog.latest(spark.table("updates")).collect()} == {("a", 9, "DEL"), ("b", 3, "ADD"), ("c", 2, "ADD")}
    q = replay.streaming_latest(stream(spark, tmp_path, "l")).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, r.seq, r.op) for r in spark.table("latest").collect()} == {("a", 9, "DEL"), ("b", 3, "ADD"), ("c", 2, "ADD")}


def test_status_of_a_stream(spark, tmp_path):
    status = Status(spark)
    q = replay.streaming_latest(stream(spark, tmp_path, "m")).writeStream.format("memory").queryName("watched").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c4").trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(100):
        if status.batches().count() >= 3:
            break
        time.sleep(0.2)
    status.close()
    got = status.batches().where("query = 'watched'").collect()
    assert sum(r.rows for r in got) == 6 and max(r.state_rows for r in got) == 3 and all(r.millis > 0 for r in got)


def test_workload_and_package(spark):
    w = importers.workload(spark, 4000, rate=5.0).agg(F.avg("wait").alias("m"), F.min("wait").alias("lo")).first()
    assert abs(w.m - 0.2) < 0.02 and w.lo >= 0
    assert session.ship(spark) is None
    assert ordered.blocks_for(0) == ordered.blocks_for(10**6) == 1024 and ordered.blocks_for(10**13) == ordered.MOST and ordered.blocks_for(3 * 10**9) == 4096


def test_executors_get_the_package(tmp_path):
    """Executors that have no such package on their path run its functions after ``ship``."""
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from loamgraph.session import build_session, ship
from loamgraph.functions import codec
s = build_session(master="local-cluster[1,1,1024]", spark__checkpoint__dir="file://{tmp_path}/shared", spark__ui__enabled="false", spark__driver__host="127.0.0.1", spark__sql__shuffle__partitions="1")
ship(s)
assert s.createDataFrame([(b"123456789",)], "b binary").select(codec.crc32c_column("b").alias("c")).first().c == 0xE3069283
s.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]


def test_stream_into_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", first=2)
    replay.into_store(stream(spark, tmp_path, "s"), store, f"file://{tmp_path}/c3")().awaitTermination(120)
    assert list(Store(spark, f"file://{tmp_path}/store")) == [(b"b", b"3"), (b"c", b"2")]
