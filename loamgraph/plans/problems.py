"""Queries on the dealt problems of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import sql_is_float, sql_is_int, sql_strip
from loamgraph.operators import hotkeys, seen
from loamgraph.operators.inline import LINKS, graph_elements, graph_tables
from loamgraph.operators.orphans import References
from loamgraph.operators.widen import WideTables
from loamgraph.session import load


def _wide(s: SparkSession, d: str) -> WideTables:
    return WideTables(load(s, d, "props"), load(s, d, "attr_keys"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _wide(s, d).unfit().select("elem", "id", "key")


def _flat_unfit(df: DataFrame) -> DataFrame:
    """The list of unfit values as its number, so that rows can be compared as plain values."""
    return df.withColumn("unfit", F.size("unfit").cast("bigint"))


def p1_wide_vertices(s: SparkSession, d: str) -> DataFrame:
    return _flat_unfit(_wide(s, d).wide("V"))


def p1_wide_edges(s: SparkSession, d: str) -> DataFrame:
    return _flat_unfit(_wide(s, d).wide("E"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(load(s, d, "sst_entries"), load(s, d, "base_keys"))


def p2_error_rates(s: SparkSession, d: str) -> DataFrame:
    return seen.error_rates(load(s, d, "sst_entries"), load(s, d, "base_keys"))


def p2_derived_rates(s: SparkSession, d: str) -> DataFrame:
    return seen.derived_rates(load(s, d, "sst_entries"), load(s, d, "base_keys")).withColumn("derived_rate", F.round(F.col("derived_rate") * 1e6, 3))


def p2_seen_by_file(s: SparkSession, d: str) -> DataFrame:
    entries = load(s, d, "sst_entries")
    files = entries.where("key IS NOT NULL AND seq IS NOT NULL").groupBy("seq").agg(F.min("file_num").alias("file_num"))
    known = seen.seen_before(entries, load(s, d, "base_keys")).withColumn("hit", F.lit(1))
    return files.join(known, "seq", "left").groupBy("file_num").agg(F.count("*").alias("records"), F.count("hit").alias("seen"))


def _references(s: SparkSession, d: str) -> References:
    return References(load(s, d, "edges"), load(s, d, "vertices"), load(s, d, "catalog_vertices"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return _references(s, d).orphans().select("edge_id", "side").distinct()


def p3_orphans_by_month(s: SparkSession, d: str) -> DataFrame:
    return _references(s, d).by_period()


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return hotkeys.hot(load(s, d, "adjacency")).select("key", "vertex_id")


def p4_vertex_report(s: SparkSession, d: str) -> DataFrame:
    return hotkeys.report(load(s, d, "adjacency"))


def p4_edge_lists(s: SparkSession, d: str) -> DataFrame:
    return hotkeys.edge_lists(load(s, d, "adjacency")).withColumn("edges", F.array_join("edges", ",")).withColumn("n", F.col("n").cast("bigint"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return graph_elements(graph_tables(load(s, d, "raw_records"), only=LINKS))


def _p5_table(name: str, *columns: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return graph_tables(load(s, d, "raw_records"), only={name: columns}).element(name, *columns).withColumn("n", F.col("n").cast("bigint"))

    return run


QUERIES = {
    "p1_found": p1_found,
    "p1_wide_vertices": p1_wide_vertices,
    "p1_wide_edges": p1_wide_edges,
    "p2_found": p2_found,
    "p2_error_rates": p2_error_rates,
    "p2_derived_rates": p2_derived_rates,
    "p2_seen_by_file": p2_seen_by_file,
    "p3_found": p3_found,
    "p3_orphans_by_month": p3_orphans_by_month,
    "p4_found": p4_found,
    "p4_vertex_report": p4_vertex_report,
    "p4_edge_lists": p4_edge_lists,
    "p5_found": p5_found,
    "p5_nodes": _p5_table("node", "id", "desc"),
    "p5_edges": _p5_table("edge", "id", "source", "target", "label"),
    "p5_data": _p5_table("data", "key", "value", "desc"),
}

_CELLS = """cells AS (SELECT elem, id, key, arg_max(struct_pack(v := val), seq).v AS val FROM props
                      WHERE elem IS NOT NULL AND id IS NOT NULL AND key IS NOT NULL GROUP BY ALL),
     kinds AS (SELECT DISTINCT e.elem, a.key, coalesce(a.attr_type, 'string') AS typ FROM attr_keys a
               JOIN (VALUES ('V', 'node'), ('E', 'edge')) e(elem, kind) ON a.for_elem IN (e.kind, 'all'))"""
_FITS = f"CASE k.typ WHEN 'int' THEN {sql_is_int('val')} WHEN 'float' THEN {sql_is_float('val')} ELSE true END"

#: The declared attributes of the data by element, for the wide tables' SQL.
_NODE = {
    "age": "int", "balance": "float", "bio": "string", "checksum": "string", "code": "string", "depth": "int", "height_cm": "float", "joined_year": "int", "lang": "string",
    "latitude": "float", "longitude": "float", "name": "string", "nick": "string", "postcode": "string", "quota": "int", "rank": "int", "ratio": "float", "revision": "int",
    "score": "float", "tier": "string", "visits": "int", "weight": "int",
}
_EDGE = {"channel": "string", "checksum": "string", "code": "int", "cost": "float", "hops": "int", "lang": "string", "note": "string", "rank": "string", "revision": "int", "since": "int", "trust": "float", "weight": "float"}


def _wide_sql(elem: str, types: dict[str, str]) -> str:
    cast = {"int": f"CASE WHEN {sql_is_int('val')} THEN try_cast({sql_strip('val')} AS BIGINT) END", "float": f"CASE WHEN {sql_is_float('val')} THEN try_cast({sql_strip('val')} AS DOUBLE) END", "string": "val"}
    columns = ", ".join(f'max({cast[t]}) FILTER (key = \'{k}\') AS "{k}"' for k, t in types.items())
    return f"""WITH {_CELLS} SELECT c.id, {columns}, count(*) FILTER (val IS NOT NULL AND NOT ({_FITS})) AS unfit
    FROM cells c LEFT JOIN kinds k USING (elem, key) WHERE c.elem = '{elem}' GROUP BY c.id"""


_SEEN = """firsts AS (SELECT key, min(seq) AS seq FROM sst_entries WHERE key IS NOT NULL AND seq IS NOT NULL GROUP BY key),
     found AS (SELECT DISTINCT e.seq FROM sst_entries e JOIN firsts f ON e.key = f.key
               WHERE e.seq > f.seq OR e.key IN (SELECT key FROM base_keys WHERE key IS NOT NULL))"""
_ORPHANS = f"""refs AS (SELECT DISTINCT id AS edge_id, side, ts, endpoint FROM
         (SELECT id, ts, 'source' AS side, source AS endpoint FROM edges UNION ALL SELECT id, ts, 'target', target FROM edges)
         WHERE length({sql_strip('endpoint')}) > 0),
     keyed AS (SELECT edge_id, side, ts, CASE WHEN {sql_is_int('endpoint')} THEN try_cast({sql_strip('endpoint')} AS BIGINT) END AS k FROM refs),
     lost AS (SELECT DISTINCT edge_id, side, ts FROM keyed r WHERE k IS NULL OR (NOT EXISTS (SELECT 1 FROM catalog_vertices c WHERE c.id = r.k)
              AND NOT EXISTS (SELECT 1 FROM vertices v WHERE v.id = r.k AND v.created_ts <= r.ts AND (v.removed_ts IS NULL OR r.ts < v.removed_ts))))"""
_ENTRIES = """entries AS (SELECT key, vertex_id, edge_id, arg_max(struct_pack(l := label), (seq, label)).l AS label, count(*) AS writes, min(ts) AS first_ts, max(ts) AS last_ts
                          FROM adjacency WHERE key IS NOT NULL AND vertex_id IS NOT NULL GROUP BY key, vertex_id, edge_id)"""
# Every value of the valid texts with its parent; the objects with the name they have in the object that holds them; those that have a row, with its number.
_JSON = """r AS (SELECT DISTINCT record_id, payload, coalesce(record_id::VARCHAR, '?') || ':' || left(md5(payload), 16) AS doc FROM raw_records WHERE payload IS NOT NULL AND json_valid(payload)),
     t AS (SELECT r.record_id, r.doc, j.key, j.value, j.type, j.id, j.parent, j.fullkey FROM r, json_tree(r.payload) j WHERE NOT regexp_matches(j.fullkey, '\\.value[.\\[]')),
     tops AS (SELECT doc FROM t WHERE parent IS NULL AND type = 'OBJECT'),
     o AS (SELECT t.*, CASE WHEN p.type = 'ARRAY' THEN p.key ELSE t.key END AS name, CASE WHEN p.type = 'ARRAY' THEN p.parent ELSE t.parent END AS holder
           FROM t JOIN tops USING (doc) LEFT JOIN t p ON p.doc = t.doc AND p.id = t.parent WHERE t.type = 'OBJECT'),
     w AS (SELECT *, doc || '/' || (row_number() OVER (PARTITION BY doc ORDER BY id) - 1) AS row_id, row_number() OVER (PARTITION BY doc, holder, name ORDER BY id) - 1 AS n
           FROM o WHERE parent IS NULL OR name IN ('graph', 'node', 'edge', 'data', 'port', 'key')),
     a AS (SELECT doc, parent, key, CASE WHEN type <> 'NULL' THEN value ->> '$' END AS val FROM t WHERE key = 'value' OR type NOT IN ('OBJECT', 'ARRAY'))"""
_ATTR = "(SELECT val FROM a WHERE a.doc = {0}.doc AND a.parent = {0}.id AND a.key = '{1}')"


def _p5_sql(name: str, *columns: str) -> str:
    values = ", ".join(f'{_ATTR.format("w", c)} AS "{c}"' for c in columns)
    return f"""WITH {_JSON} SELECT w.record_id, w.row_id, coalesce(p.name, 'record') AS parent_tbl, p.row_id AS parent_row, w.n, {values}
        FROM w JOIN w p ON p.doc = w.doc AND p.id = w.holder WHERE w.name = '{name}'"""


ORACLES = {
    "p1_found": f"WITH {_CELLS} SELECT c.elem, c.id, c.key FROM cells c JOIN kinds k USING (elem, key) WHERE val IS NOT NULL AND NOT ({_FITS})",
    "p1_wide_vertices": _wide_sql("V", _NODE),
    "p1_wide_edges": _wide_sql("E", _EDGE),
    "p2_found": f"WITH {_SEEN} SELECT seq FROM found",
    "p2_derived_rates": """WITH b AS (SELECT DISTINCT key FROM base_keys WHERE key IS NOT NULL), k AS (SELECT DISTINCT key FROM sst_entries WHERE key IS NOT NULL AND seq IS NOT NULL),
        n AS (SELECT (SELECT count(DISTINCT seq) FROM sst_entries WHERE key IS NOT NULL AND seq IS NOT NULL) AS records, (SELECT count(*) FROM k WHERE key NOT IN (FROM b)) AS new_records, (SELECT count(*) FROM b) AS base)
        SELECT w AS bits, records, new_records, base, round((SELECT sum(1 - exp((base + i) * -(2.0 ** -w + 2.0 ** (-2 * w) / 2))) FROM range(new_records) t(i)) / records * 1e6, 3) AS derived_rate
        FROM n, (VALUES (24), (28), (62)) x(w)""",
    "p2_seen_by_file": f"""WITH {_SEEN}, files AS (SELECT seq, min(file_num) AS file_num FROM sst_entries WHERE key IS NOT NULL AND seq IS NOT NULL GROUP BY seq)
        SELECT file_num, count(*) AS records, count(found.seq) AS seen FROM files LEFT JOIN found ON files.seq = found.seq GROUP BY file_num""",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT edge_id, side FROM lost",
    "p3_orphans_by_month": f"WITH {_ORPHANS} SELECT side, coalesce(strftime(ts, '%Y-%m'), '') AS month, count(*) AS orphans FROM lost GROUP BY ALL",
    "p4_found": """WITH d AS (SELECT key, vertex_id, count(*) AS n FROM (SELECT DISTINCT key, vertex_id, edge_id FROM adjacency WHERE key IS NOT NULL) GROUP BY ALL),
        t AS (SELECT key, sum(n) AS total FROM d GROUP BY key) SELECT d.key, vertex_id FROM d JOIN t ON d.key = t.key WHERE vertex_id IS NOT NULL AND n * 50 >= total""",
    "p4_vertex_report": f"""WITH {_ENTRIES}, l AS (SELECT key, vertex_id, label, count(*) AS n FROM entries GROUP BY ALL),
        t AS (SELECT key, vertex_id, count(label) AS labels, arg_max(struct_pack(l := label), (n, coalesce(label, ''))).l AS top_label FROM l GROUP BY ALL)
        SELECT e.key, e.vertex_id, count(*) AS degree, sum(writes)::BIGINT AS writes, any_value(labels) AS labels, any_value(top_label) AS top_label,
               min(edge_id) AS first_edge, max(edge_id) AS last_edge, min(first_ts) AS first_ts, max(last_ts) AS last_ts
        FROM entries e JOIN t ON e.key = t.key AND e.vertex_id = t.vertex_id GROUP BY e.key, e.vertex_id""",
    "p4_edge_lists": """SELECT key, vertex_id, block, count(*) AS n, string_agg(edge_id::VARCHAR, ',' ORDER BY edge_id) AS edges FROM
        (SELECT DISTINCT key, vertex_id, edge_id, edge_id // 4096 AS block FROM adjacency WHERE key IS NOT NULL AND vertex_id IS NOT NULL AND edge_id IS NOT NULL) GROUP BY ALL""",
    "p5_found": f"""WITH {_JSON}, e AS (SELECT w.record_id, w.doc, w.id, w.name, coalesce({_ATTR.format("w", "id")}, '') AS elem_id, coalesce({_ATTR.format("h", "id")}, '') AS parent_id
            FROM w JOIN w g ON g.doc = w.doc AND g.id = w.holder AND g.name = 'graph' LEFT JOIN w h ON h.doc = w.doc AND h.id = g.holder AND h.name = 'node' WHERE w.name IN ('node', 'edge')),
        k AS (SELECT w.doc, w.holder, {_ATTR.format("w", "key")} AS key FROM w WHERE w.name = 'data')
        SELECT DISTINCT e.record_id, elem_id, parent_id, coalesce(k.key, '') AS key FROM e LEFT JOIN k ON k.doc = e.doc AND k.holder = e.id AND k.key IS NOT NULL""",
    "p5_nodes": _p5_sql("node", "id", "desc"),
    "p5_edges": _p5_sql("edge", "id", "source", "target", "label"),
    "p5_data": _p5_sql("data", "key", "value", "desc"),
}
