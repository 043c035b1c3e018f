"""Queries on the property graph of the tables edges, vertices, catalog_vertices and props."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import codec
from loamgraph.functions.text import sql_is_int, sql_strip
from loamgraph.operators import hotkeys, ordered, traverse
from loamgraph.operators.graph import PropertyGraph
from loamgraph.session import load, own_folder
from loamgraph.sources import importers
from loamgraph.sources.importers import table_graph, table_rejects


def v_scan(s, d):
    """Vertices with their place in the order of their keys, that is, of the ids as text."""
    return ordered.numbered(table_graph(s, d).vertices.select("id", F.col("id").cast("string").alias("key")), "key")


def e_scan(s, d):
    return table_graph(s, d).scan("E")


def v_filter_prop(s, d):
    return table_graph(s, d).having("V", "lang", "en")


def e_filter_prop(s, d):
    return table_graph(s, d).having("E", "hops", "3")


def e_label_filter(s, d):
    return traverse.labelled(table_graph(s, d).edges, ["knows", "cites"])


def e_project(s, d):
    e = table_graph(s, d).edges
    return e.select("id", F.col("src").alias("out_v"), F.col("dst").alias("in_v"), "label", codec.edge_text(F.col("id"), F.col("src"), F.coalesce("label", F.lit("")), F.col("dst")).alias("text"))


def e_other(s, d):
    """For both endpoints of every edge the other one."""
    e = table_graph(s, d).edges
    both = e.select("id", "src", "dst", F.explode(F.array("src", "dst")).alias("v"))
    return traverse.other_end(both, "v").select("id", "v", "other")


def _incident(direction: str, labels=()):
    return lambda s, d: table_graph(s, d).incident(direction, labels).select("v", "edge_id", "label", "dir")


def _near(direction: str, labels=()):
    return lambda s, d: table_graph(s, d).neighbours(direction, labels)


def adjacency_list(s, d):
    """Out-edges of each vertex in sorted blocks, as text."""
    e = table_graph(s, d).edges.select(F.lit("outE").alias("key"), F.col("src").alias("vertex_id"), F.col("id").alias("edge_id"))
    return hotkeys.edge_lists(e).select(F.col("vertex_id").alias("id"), "block", F.array_join("edges", ",").alias("edges"))


def delta_blocks(s, d):
    """The blocks of the adjacency lists as differences."""
    e = table_graph(s, d).edges.select(F.lit("outE").alias("key"), F.col("src").alias("vertex_id"), F.col("id").alias("edge_id"))
    return hotkeys.edge_lists(e).select(F.col("vertex_id").alias("id"), "block", F.array_join(codec.delta_encode(F.col("edges")), ",").alias("deltas"))


def _deltas(s, d) -> DataFrame:
    return ordered.differences(load(s, d, "lineitem").select(F.col("l_suppkey").alias("v"), F.col("l_orderkey").alias("x")).distinct(), ["v"], "x", "delta")


def delta_encode(s, d):
    return _deltas(s, d)


def delta_decode(s, d):
    return ordered.running(_deltas(s, d), ["v"], "x", "delta", "decoded").select("v", "delta", "decoded")


def degree(s, d):
    return table_graph(s, d).degrees()


def neighbour_report(s, d):
    """Name and number of orders of every customer."""
    c = load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    e = load(s, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return traverse.neighbour_report(c, e, c)


def two_hop(s, d):
    """Customer to order to part, one row per walk."""
    o, l = load(s, d, "orders"), load(s, d, "lineitem")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part"))


def bipartite_walk(s, d):
    """How many walks supplier - part - supplier - part begin at each supplier."""
    e = load(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"))
    return traverse.walk_counts(e, ["out", "in", "out"])


def walks_out_out(s, d):
    """How many walks of two out-edges begin at each vertex."""
    return traverse.walk_counts(table_graph(s, d).edges, ["out", "out"])


def k_hop(s, d):
    """Vertices within three out-edges of a long-standing vertex."""
    return traverse.k_hop(table_graph(s, d).edges, load(s, d, "catalog_vertices").select("id"), 3).select("id", F.col("hops").cast("bigint").alias("hops"))


def prop_get_default(s, d):
    return table_graph(s, d).property("V", "tier", "none")


def prop_keys(s, d):
    return table_graph(s, d).property_keys("V")


def dangling_edges(s, d):
    """Edges whose endpoint has been no vertex at any time."""
    return table_graph(s, d).dangling()


def removed_vertices(s, d):
    """Edges left after the long-standing vertices are removed with all that hangs on them."""
    return table_graph(s, d).remove_vertices(load(s, d, "catalog_vertices"), cascade=True).edges


def set_property(s, d):
    """Kinds written over the property rank of all vertices that have one."""
    g = table_graph(s, d)
    new = g.props.where("elem = 'V' AND key = 'rank'").select("elem", "id", "key", F.concat(F.lit("#"), "val").alias("val"))
    return g.set_properties(new).property("V", "rank").where("val IS NOT NULL")


def vq_has_interval_count(s, d):
    """Per vertex the edges with a trust from 0 to below 0.5 and label knows or link."""
    return table_graph(s, d).query().labels("knows", "link").interval("trust", 0.0, 0.5).direction("both").count()


def vq_limit(s, d):
    return table_graph(s, d).query().direction("out").vertices().orderBy("v", "edge_id").limit(50)


def vq_limit_per_vertex(s, d):
    """The first three edges of each vertex, with what they lead to."""
    return table_graph(s, d).query().limit(3).vertices()


def _typed(s, d):
    kinds = load(s, d, "attr_keys").where("key IS NOT NULL AND for_elem IS NOT NULL")
    elems = F.when(F.col("for_elem") == "node", F.array(F.lit("V"))).when(F.col("for_elem") == "edge", F.array(F.lit("E"))).otherwise(F.array(F.lit("V"), F.lit("E")))
    return table_graph(s, d).typed(kinds.select(F.explode(elems).alias("elem"), "key", F.coalesce("attr_type", F.lit("string")).alias("type")))


def v_filter_typed(s, d):
    """Vertices of the number 30 as age, and of the text 30, which no age is."""
    g = _typed(s, d)
    return g.having("V", "age", 30).withColumn("as", F.lit("number")).unionByName(g.having("V", "age", "30").withColumn("as", F.lit("text")))


def pack_roundtrip(s, d):
    """Typed property values after MessagePack and back."""
    p = _typed(s, d).props
    return p.select("elem", "id", "key", codec.json_text(codec.unpack_json(codec.pack_json("val"))).alias("val")).where("key IN ('name', 'age', 'note', 'hops')")


def value_checksums(s, d):
    """How many properties have the check value of the nine digits, and how many values there are."""
    c = codec.crc32c_column(F.encode("val", "utf-8"))
    probe = codec.crc32c_column(F.encode(F.concat(F.lit("123456789"), F.substring("val", 1, 0)), "utf-8"))
    return table_graph(s, d).props.select(c.alias("c"), probe.alias("p")).agg(F.count("c").alias("n"), F.count_if(F.col("p") == 0xE3069283).alias("known"))


def graph_rejects(s, d):
    """Endpoints for which edges are left out of the graph."""
    return table_rejects(s, d)


def graph_accounts(s, d):
    """Edge ids, those in the graph and those left out."""
    ids = load(s, d, "edges").select("id").distinct()
    return ids.agg(F.count("*").alias("ids")).crossJoin(table_graph(s, d).edges.agg(F.count_distinct("id").alias("taken"))).crossJoin(table_rejects(s, d).agg(F.count_distinct("id").alias("rejected")))  # one row each


def v_text(s, d):
    """Text form of every vertex."""
    return table_graph(s, d).vertices.select("id", codec.vertex_text(F.col("id")).alias("text"))


def walk_chain(s, d):
    """Ends of the walks from a long-standing vertex along an edge 'knows' and back along an edge 'cites'."""
    seeds = load(s, d, "catalog_vertices").select("id").distinct()
    return traverse.walk(table_graph(s, d).edges, seeds, ["out", "in"], [["knows"], ["cites"]])


def import_edge_list(s, d):
    """Orders as an edge list written to text files and read again."""
    at = own_folder(s)
    load(s, d, "orders").select(F.concat_ws("\t", "o_custkey", "o_orderkey")).write.text(at)
    return importers.edge_list(s, at, label="order").edges.select("src", "dst", "label")


def import_ids(s, d):
    """The customers' keys written to text files and read again as a list of ids."""
    at = own_folder(s)
    load(s, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" and"))).write.text(at)
    return importers.id_list(s, at)


def import_graphml(s, d):
    """Names and balances of the customers and their orders, as GraphML and back: properties of the nodes and, as links, the edges."""
    at = own_folder(s)
    c, o = load(s, d, "customer"), load(s, d, "orders")
    keys = s.createDataFrame([("name", "node", "name", "string"), ("nation", "node", "nation", "int"), ("price", "edge", "price", "float")], "_id string, _for string, `_attr.name` string, `_attr.type` string")
    data = lambda **cells: F.array(*(F.struct(F.col(c).cast("string").alias("_VALUE"), F.lit(k).alias("_key")) for k, c in cells.items())).alias("data")
    nodes = c.select(F.col("c_custkey").alias("_id"), data(name="c_name", nation="c_nationkey"))
    orders = o.select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("_source"), F.col("o_orderkey").alias("_target"), F.lit("order").alias("_label"), data(price="o_totalprice"))
    for tag, part in (("key", keys), ("node", nodes), ("edge", orders)):
        part.write.mode("append").format("xml").option("rootTag", "graphml").option("rowTag", tag).save(at)
    g = importers.graphml(s, at)
    props = g.props.select("elem", "id", "key", F.when(F.col("key") == "price", "").otherwise(F.col("val")).alias("val"), F.when(F.col("key") == "price", F.col("val").cast("double")).alias("number"))
    links = g.edges.select(F.lit("E").alias("elem"), "id", F.lit("src").alias("key"), F.col("src").cast("string").alias("val"), F.lit(None).cast("double").alias("number"))
    return props.unionByName(links)


def numbered_vertices(s, d):
    """Customers as new vertices: their ids follow the greatest in use, in the order of their names."""
    g = table_graph(s, d)
    return g.with_ids(load(s, d, "customer").select("c_name"), "V", "c_name").select("id", "c_name")


def prop_value_between(s, d):
    return table_graph(s, d).having_between("V", "age", 20, 40, "bigint")


def graph_counts(s, d):
    return table_graph(s, d).counts()


def label_stats(s, d):
    e = table_graph(s, d).edges
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


QUERIES = {f.__name__: f for f in (v_scan, e_scan, v_filter_prop, e_filter_prop, e_label_filter, e_project, e_other)} | {
    "v_outE": _incident("out"), "v_inE": _incident("in"), "v_bothE": _incident("both"), "v_outE_labels": _incident("out", ["knows"]),
    "v_outV": _near("out"), "v_inV": _near("in"), "v_bothV": _near("both"), "v_bothV_labels": _near("both", ["link", "cites"]),
} | {f.__name__: f for f in (
    adjacency_list, delta_blocks, delta_encode, delta_decode, degree, neighbour_report, two_hop, bipartite_walk, walks_out_out, k_hop, prop_get_default, prop_keys, dangling_edges, removed_vertices,
    set_property, vq_has_interval_count, vq_limit, prop_value_between, graph_counts, label_stats, vq_limit_per_vertex, v_filter_typed, pack_roundtrip, value_checksums, graph_rejects, graph_accounts,
    numbered_vertices, v_text, walk_chain, import_edge_list, import_ids, import_graphml,
)}

_END = lambda c: f"CASE WHEN {sql_is_int(c)} THEN try_cast({sql_strip(c)} AS BIGINT) END"
_G = f"""e AS (SELECT DISTINCT id, src, dst, label FROM (SELECT id, {_END('source')} AS src, {_END('target')} AS dst, label FROM edges) WHERE src IS NOT NULL AND dst IS NOT NULL),
     v AS (SELECT id FROM vertices UNION SELECT id FROM catalog_vertices),
     p AS (SELECT * FROM (SELECT elem, id, key, arg_max(struct_pack(v := val), seq).v AS val FROM props GROUP BY ALL) WHERE val IS NOT NULL)"""
_IN = "SELECT v.id AS v, e.id AS edge_id, e.src AS w, e.label, 'in' AS dir FROM v JOIN e ON e.dst = v.id"
_OUT = "SELECT v.id AS v, e.id AS edge_id, e.dst AS w, e.label, 'out' AS dir FROM v JOIN e ON e.src = v.id"
_BOTH = f"{_IN} UNION ALL {_OUT}"
_BLOCKS = "b AS (SELECT src AS id, e.id // 4096 AS block, e.id AS x FROM e)"
_DELTAS = "x AS (SELECT DISTINCT l_suppkey AS v, l_orderkey AS x FROM lineitem), t AS (SELECT v, x, x - coalesce(lag(x) OVER (PARTITION BY v ORDER BY x), 0) AS delta FROM x)"


def _inc(sql: str, where: str = "true") -> str:
    return f"WITH {_G}, r AS ({sql}) SELECT v, edge_id, label, dir FROM r WHERE {where}"


def _nb(sql: str, where: str = "true") -> str:
    return f"WITH {_G}, r AS ({sql}) SELECT v, edge_id, w, dir FROM r WHERE {where}"


ORACLES = {
    "v_scan": f"WITH {_G} SELECT id, id::VARCHAR AS key, row_number() OVER (ORDER BY id::VARCHAR) AS place FROM v",
    "e_scan": f"WITH {_G} SELECT * FROM e ORDER BY id::VARCHAR",
    "v_filter_prop": f"WITH {_G} SELECT id FROM v WHERE id IN (SELECT id FROM p WHERE elem = 'V' AND key = 'lang' AND val = 'en')",
    "e_filter_prop": f"WITH {_G} SELECT * FROM e WHERE id IN (SELECT id FROM p WHERE elem = 'E' AND key = 'hops' AND val = '3')",
    "e_label_filter": f"WITH {_G} SELECT * FROM e WHERE label IN ('knows', 'cites')",
    "e_project": f"WITH {_G} SELECT id, src AS out_v, dst AS in_v, label, 'e[' || id || '][' || src || '-' || coalesce(label, '') || '->' || dst || ']' AS text FROM e",
    "e_other": f"WITH {_G} SELECT id, src AS v, dst AS other FROM e UNION ALL SELECT id, dst, src FROM e",
    "v_outE": _inc(_OUT), "v_inE": _inc(_IN), "v_bothE": _inc(_BOTH), "v_outE_labels": _inc(_OUT, "label = 'knows'"),
    "v_outV": _nb(_OUT), "v_inV": _nb(_IN), "v_bothV": _nb(_BOTH), "v_bothV_labels": _nb(_BOTH, "label IN ('link', 'cites')"),
    "adjacency_list": f"WITH {_G}, {_BLOCKS} SELECT id, block, string_agg(x::VARCHAR, ',' ORDER BY x) AS edges FROM b GROUP BY ALL",
    "delta_blocks": f"""WITH {_G}, {_BLOCKS}, t AS (SELECT id, block, x, x - coalesce(lag(x) OVER (PARTITION BY id, block ORDER BY x), 0) AS delta FROM b)
        SELECT id, block, string_agg(delta::VARCHAR, ',' ORDER BY x) AS deltas FROM t GROUP BY ALL""",
    "delta_encode": f"WITH {_DELTAS} SELECT v, x, delta FROM t",
    "delta_decode": f"WITH {_DELTAS} SELECT v, delta, (sum(delta) OVER (PARTITION BY v ORDER BY x ROWS UNBOUNDED PRECEDING))::BIGINT AS decoded FROM t",
    "degree": f"""WITH {_G}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1)
        SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id)""",
    "neighbour_report": "SELECT c_custkey AS id, any_value(c_name) AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "two_hop": "SELECT o_custkey AS customer, l_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "bipartite_walk": """WITH m AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT s, sum(n) AS n FROM m GROUP BY s),
        b AS (SELECT p, sum(m.n * a.n) AS n FROM m JOIN a USING (s) GROUP BY p) SELECT s AS id, sum(m.n * b.n)::DECIMAL(38,0) AS walks FROM m JOIN b USING (p) GROUP BY s""",
    "walks_out_out": f"WITH {_G}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1) SELECT e.src AS id, sum(o.n)::DECIMAL(38,0) AS walks FROM e JOIN o ON e.dst = o.src GROUP BY 1",
    "k_hop": f"""WITH RECURSIVE {_G}, r AS (SELECT id, 0 AS hops FROM catalog_vertices UNION SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 3)
        SELECT id, min(hops)::BIGINT AS hops FROM r GROUP BY id""",
    "prop_get_default": f"WITH {_G} SELECT v.id, coalesce(val, 'none') AS val FROM v LEFT JOIN (FROM p WHERE elem = 'V' AND key = 'tier') p ON p.id = v.id",
    "prop_keys": f"WITH {_G} SELECT DISTINCT id, key FROM p WHERE elem = 'V' AND key NOT IN ('inE', 'outE')",
    "dangling_edges": f"WITH {_G} SELECT id, 'src' AS side FROM e WHERE src NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'dst' FROM e WHERE dst NOT IN (SELECT id FROM v)",
    "removed_vertices": f"WITH {_G} SELECT * FROM e WHERE src NOT IN (SELECT id FROM catalog_vertices) AND dst NOT IN (SELECT id FROM catalog_vertices)",
    "set_property": f"WITH {_G} SELECT p.id, '#' || val AS val FROM p JOIN v ON v.id = p.id WHERE elem = 'V' AND key = 'rank'",
    "vq_has_interval_count": f"""WITH {_G}, r AS ({_BOTH}) SELECT v, count(*) AS n FROM r WHERE label IN ('knows', 'link')
        AND edge_id IN (SELECT id FROM p WHERE elem = 'E' AND key = 'trust' AND try_cast(val AS DOUBLE) >= 0 AND try_cast(val AS DOUBLE) < 0.5) GROUP BY v""",
    "vq_limit": f"WITH {_G}, r AS ({_OUT}) SELECT v, edge_id, w, dir FROM r ORDER BY v, edge_id LIMIT 50",
    "vq_limit_per_vertex": f"WITH {_G}, r AS ({_BOTH}) SELECT v, edge_id, w, dir FROM r QUALIFY row_number() OVER (PARTITION BY v ORDER BY dir, edge_id) <= 3",
    "v_filter_typed": f"WITH {_G} SELECT id, 'number' AS \"as\" FROM v WHERE id IN (SELECT id FROM p WHERE elem = 'V' AND key = 'age' AND {sql_is_int('val')} AND try_cast({sql_strip('val')} AS BIGINT) = 30)",
    "pack_roundtrip": f"""WITH {_G} SELECT elem, id, key, CASE WHEN key IN ('age', 'hops') AND NOT (key = 'age' AND elem = 'E') AND NOT (key = 'hops' AND elem = 'V') THEN try_cast({sql_strip('val')} AS BIGINT)::VARCHAR ELSE val END AS val
        FROM p WHERE key IN ('name', 'note') OR key = 'age' AND (elem = 'E' OR {sql_is_int('val')}) OR key = 'hops' AND (elem = 'V' OR {sql_is_int('val')})""",
    "value_checksums": f"WITH {_G} SELECT count(*) AS n, count(*) AS known FROM p WHERE elem IS NOT NULL AND id IS NOT NULL AND key IS NOT NULL",
    "graph_rejects": f"SELECT DISTINCT id, side, endpoint FROM (SELECT id, 'src' AS side, source AS endpoint FROM edges UNION ALL SELECT id, 'dst', target FROM edges) WHERE endpoint IS NULL OR NOT {sql_is_int('endpoint')}",
    "graph_accounts": f"WITH {_G}, a AS (SELECT count(DISTINCT id) AS ids FROM edges), t AS (SELECT count(DISTINCT id) AS taken FROM e) SELECT ids, taken, ids - taken AS rejected FROM a, t",
    "v_text": f"WITH {_G} SELECT id, 'v[' || id || ']' AS text FROM v",
    "walk_chain": f"WITH {_G} SELECT c.id AS v, b.src AS w FROM catalog_vertices c JOIN e a ON a.src = c.id AND a.label = 'knows' JOIN e b ON b.dst = a.dst AND b.label = 'cites'",
    "import_edge_list": "SELECT o_custkey AS src, o_orderkey AS dst, 'order' AS label FROM orders",
    "import_ids": "SELECT c_custkey AS id FROM customer",
    "import_graphml": """SELECT 'V' AS elem, c_custkey AS id, 'name' AS key, c_name AS val, NULL::DOUBLE AS number FROM customer UNION ALL SELECT 'V', c_custkey, 'nation', c_nationkey::VARCHAR, NULL FROM customer
        UNION ALL SELECT 'E', o_orderkey, 'price', '', o_totalprice FROM orders UNION ALL SELECT 'E', o_orderkey, 'src', o_custkey::VARCHAR, NULL FROM orders""",
    "numbered_vertices": f"WITH {_G} SELECT (SELECT max(id) FROM v) + row_number() OVER (ORDER BY c_name) AS id, c_name FROM customer",
    "prop_value_between": f"WITH {_G} SELECT id FROM v WHERE id IN (SELECT id FROM p WHERE elem = 'V' AND key = 'age' AND {sql_is_int('val')} AND try_cast({sql_strip('val')} AS BIGINT) BETWEEN 20 AND 40)",
    "graph_counts": f"WITH {_G} SELECT 'V' AS elem, count(*) AS n FROM v UNION ALL SELECT 'E', count(*) FROM e",
    "label_stats": f"WITH {_G} SELECT label, count(*) AS n, count(DISTINCT src) AS sources, min(id) AS first_id, max(id) AS last_id FROM e GROUP BY label",
}
