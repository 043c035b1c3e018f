"""Queries on change logs: events as a log by user, orders as ordered keys, sst_entries as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.functions import codec
from loamgraph.functions.bloom import Bloom
from loamgraph.operators import changelog as log
from loamgraph.operators import ordered
from loamgraph.operators.store import Store
from loamgraph.session import load, own_folder
from loamgraph.sources.importers import workload
from loamgraph.streaming.replay import throughput


def events_log(s: SparkSession, d: str) -> DataFrame:
    """Key user_id, order event_id, removal on 'error', value ``value``."""
    e = load(s, d, "events")
    return e.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DEL").otherwise("ADD").alias("op"), F.col("value").alias("v"))


def orders_log(s: SparkSession, d: str) -> DataFrame:
    """Key 'o/<orderkey>', value the order's price."""
    return load(s, d, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("k"), F.col("o_orderkey").alias("seq"), F.lit("ADD").alias("op"), F.col("o_totalprice").alias("v"))


def entries_log(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "sst_entries").select(F.col("key").alias("k"), "seq", "op", F.col("val").alias("v"), "file_num")


def _run(s: SparkSession, d: str) -> DataFrame:
    return events_log(s, d).withColumn("run", F.pmod("seq", F.lit(4)).cast("int"))


def kv_snapshot(s, d):
    return log.snapshot(events_log(s, d))


def kv_get(s, d):
    return log.get(events_log(s, d), 7)


def kv_multi_get(s, d):
    """The value of every customer's key; keys without a live value are reported as not found."""
    return log.multi_get(events_log(s, d), load(s, d, "customer").select(F.col("c_custkey").alias("k")))


def kv_version_history(s, d):
    return log.history(events_log(s, d))


def kv_tombstones(s, d):
    return log.tombstones(events_log(s, d))


def kv_merge_runs(s, d):
    rows = _run(s, d)
    return log.merge_runs(*(rows.where(F.col("run") == i) for i in range(4))).where("op = 'ADD'").select("k", "seq", "v")


def kv_range_scan(s, d):
    return log.scan(orders_log(s, d), lo="o/1", hi="o/3")


def kv_prefix_scan(s, d):
    return log.scan(orders_log(s, d), prefix="o/12")


def kv_seek_limit(s, d):
    return log.scan(orders_log(s, d), lo="o/5", limit=100)


def kv_reverse_scan(s, d):
    return log.scan(orders_log(s, d), hi="o/5", reverse=True, limit=100)


def kv_full_scan(s, d):
    """All live keys with their place in byte order."""
    return ordered.numbered(log.snapshot(orders_log(s, d)), "k")


def kv_binary_snapshot(s, d):
    """State of the table files' entries: keys of any bytes, empty values kept."""
    return log.snapshot(entries_log(s, d)).select(F.hex("k").alias("k"), "v")


def kv_run_stats(s, d):
    return log.run_stats(entries_log(s, d), "file_num").withColumn("smallest", F.hex("smallest")).withColumn("largest", F.hex("largest"))


def kv_range_overlap(s, d):
    return log.overlaps(log.run_stats(entries_log(s, d), "file_num"), "file_num")


def kv_level_scores(s, d):
    """Score of levels of the table files, whose level is the number of digits of their bytes above four, and the level to compact."""
    stats = log.run_stats(entries_log(s, d), "file_num")
    digits = F.length((F.col("key_bytes") + F.col("value_bytes")).cast("string"))
    scored = log.needs_compaction(stats.withColumn("level", F.greatest(digits - 4, F.lit(0)).cast("bigint")), "level", base_bytes=1 << 10)
    worst = scored.agg(F.max(F.struct("score", -F.col("level"))).alias("w")).select((-F.col("w.col2")).alias("worst"))
    return scored.crossJoin(worst).select("level", "runs", "bytes", F.round("score", 6).alias("score"), (F.col("level") == F.col("worst")).alias("chosen"))  # one row


def kv_op_counters(s, d):
    return entries_log(s, d).groupBy("op").agg(F.count("*").alias("n"))


def kv_partial_compaction(s, d):
    return log.compact(events_log(s, d), base_level=False)


def kv_full_compaction(s, d):
    return log.compact(events_log(s, d))


def kv_bloom_candidates(s, d):
    """Entries' keys that are base keys: those that pass the Bloom filter of the base keys are compared."""
    base, keys = load(s, d, "base_keys"), load(s, d, "sst_entries").select("key").distinct()
    return Bloom(base, "key").maybe(keys, "key").join(base.select("key"), "key", "left_semi").select(F.hex("key").alias("key"))


def kv_new_keys(s, d):
    """Set difference: keys of entries that are not base keys."""
    return load(s, d, "sst_entries").select("key").where("key IS NOT NULL").distinct().join(load(s, d, "base_keys").select("key"), "key", "left_anti").select(F.hex("key").alias("key"))


def latency_percentiles(s, d):
    """Order statistics of value per event type: the value at place floor(n q) of the sorted values, exactly.

    Equal values are counted together, and the counts summed up in blocks of the value.
    """
    e = load(s, d, "events").where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    n = e.groupBy("event_type").agg(F.sum("c").alias("n"))
    at = ordered.running(e, ["event_type"], "value", "c", "upto").join(n, "event_type")
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1), F.col("value"))).alias(name) for q, name in ((0.99, "p99"), (0.999, "p999"), (0.9999, "p9999"))]
    return at.groupBy("event_type").agg(*picks, F.max("value").alias("max"), F.max("n").alias("n"))


def throughput_interval(s, d):
    n = throughput(load(s, d, "events").where("ts IS NOT NULL"), "ts")
    return n.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("start")))  # one row per hour


def topk_least_used(s, d):
    return load(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy("n", "user_id").limit(10)


def prop_between(s, d):
    return load(s, d, "events").where(F.col("value").between(10.0, 50.0)).select("event_id", "user_id", "value")


def key_parse(s, d):
    """Key text of every property row, and its parts."""
    p = load(s, d, "props").where("elem IS NOT NULL AND id IS NOT NULL AND key IS NOT NULL").select("elem", "id", "key").distinct()
    k = p.select(codec.property_key(F.col("elem"), F.col("id"), F.col("key")).alias("path"), codec.element_key(F.col("elem"), F.col("id")).alias("element"))
    return k.select("path", "element", codec.last_part(F.col("path")).alias("name"), codec.id_part(F.col("path")).alias("id"), codec.to_hex(F.col("element")).alias("hex"), codec.varint_size(codec.id_part(F.col("path"))).cast("bigint").alias("id_bytes"))


def varints(s, d):
    """The vertices' ids as numbers of variable length, and read back."""
    n = load(s, d, "vertices").select("id").where("id IS NOT NULL").distinct().select("id", codec.varint(F.col("id")).alias("v"))
    return n.select("id", F.hex("v").alias("hex"), codec.varint_value(F.col("v")).alias("back"))


def file_range_sizes(s, d):
    """Bytes of all files and of each, with the share of the total."""
    stats = log.run_stats(entries_log(s, d), "file_num").select("file_num", (F.col("key_bytes") + F.col("value_bytes")).alias("bytes"))
    return stats.withColumn("total", F.sum("bytes").over(Window.partitionBy()))  # one row per file


def _store(s, **options) -> Store:
    """An empty store below the shared folder."""
    return Store(s, own_folder(s), **options)


def _events_store(s, d) -> Store:
    """The events as a store of several levels, written slice by slice and opened again."""
    store, rows = _store(s, first=2), events_log(s, d).withColumn("k", F.col("k").cast("string").cast("binary")).withColumn("v", F.col("v").cast("string").cast("binary"))
    for i in range(5):
        store.append_log(rows.where(F.pmod("seq", F.lit(5)) == i))
        store.compact_step(keep_tombstones=True)
    return Store(s, store.path)


def _number(c: str, kind: str):
    return F.col(c).cast("string").cast(kind).alias(c)


def store_roundtrip(s, d):
    return _events_store(s, d).snapshot().select(_number("k", "bigint"), _number("v", "double"))


def store_multi_get(s, d):
    keys = load(s, d, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return _events_store(s, d).multi_get(keys).select(_number("k", "bigint"), "found", _number("v", "double"))


def _orders_store(s, d) -> Store:
    """Orders put twice, the second time some with another value, and every seventh key removed."""
    store, rows = _store(s), orders_log(s, d).select("k", F.col("v").cast("string").alias("v"), "seq")
    store.put_batch(rows)
    store.put_batch(rows.where("seq % 3 = 0").withColumn("v", F.concat(F.lit("-"), "v")))
    store.remove_batch(rows.where("seq % 7 = 0"))
    return store


def store_scan(s, d):
    return _orders_store(s, d).scan(lo="o/1", hi="o/3").select(F.col("k").cast("string").alias("k"), _number("v", "double"))


def store_compacted(s, d):
    """Entries, adds and key range of the store's manifest after everything is compacted, and what reads find then."""
    store = _orders_store(s, d)
    store.compact()
    store.vacuum()
    total = store.stats().agg(F.sum("entries").alias("entries"), F.sum("adds").alias("adds"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
    return total.crossJoin(store.snapshot().agg(F.count("*").alias("live"), F.max(_number("v", "double")).alias("max_v")))  # one row each


def store_copy(s, d):
    other = _orders_store(s, d).copy_to(own_folder(s))
    return other.snapshot().select(F.col("k").cast("string").alias("k"), _number("v", "double"))


def workload_counts(s, d):
    """A mixed workload run against a store in the order of its numbers: writes and gets by kind, and the keys alive at the end."""
    store, work = _store(s, first=2), workload(s, 3000, keys=500, puts=0.5, dels=0.1, sequential=True).persist()
    hits = None
    for i in range(3):
        part = work.where(F.floor(F.col("seq") / 1000) == i)
        store.append_log(part.where("op <> 'GET'"))
        got = store.multi_get(part.where("op = 'GET'").select("k"))
        hits = got if hits is None else hits.unionByName(got)
        store.compact_step(keep_tombstones=True)
    kinds = work.agg(F.count("*").alias("operations"), F.count_distinct("k").alias("keys"))
    live = log.snapshot(work.where("op <> 'GET'")).agg(F.count("*").alias("live"))
    same = store.snapshot().agg(F.count("*").alias("stored"))
    out = kinds.crossJoin(live.crossJoin(same).select((F.col("live") == F.col("stored")).alias("agrees"))).crossJoin(hits.agg((F.count_if("found") > 0).alias("hit")))  # one row each
    return out


QUERIES = {f.__name__: f for f in (
    kv_snapshot, kv_get, kv_multi_get, kv_version_history, kv_tombstones, kv_merge_runs, kv_range_scan, kv_prefix_scan, kv_seek_limit, kv_reverse_scan, kv_full_scan, kv_binary_snapshot,
    kv_run_stats, kv_range_overlap, kv_level_scores, kv_op_counters, kv_partial_compaction, kv_full_compaction, kv_bloom_candidates, kv_new_keys, latency_percentiles, throughput_interval,
    topk_least_used, prop_between, key_parse, file_range_sizes, store_roundtrip, store_multi_get, store_scan, store_compacted, store_copy, workload_counts, varints,
)}

_LOG = "l AS (SELECT user_id AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'ADD' END AS op, value AS v FROM events)"
_TOP = f"{_LOG}, top AS (SELECT k, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(struct_pack(v := v), seq).v AS v FROM l WHERE k IS NOT NULL GROUP BY k)"
_ORDERS = "o AS (SELECT 'o/' || o_orderkey AS k, o_totalprice AS v FROM orders)"
_LEFT = "o AS (SELECT 'o/' || o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 0)"
_STATS = """st AS (SELECT file_num, count(*) AS entries, count(*) FILTER (op = 'ADD') AS adds, count(*) FILTER (op = 'DEL') AS dels, min(key) AS smallest, max(key) AS largest,
            coalesce(sum(octet_length(key)), 0)::BIGINT AS key_bytes, coalesce(sum(strlen(val)), 0)::BIGINT AS value_bytes FROM sst_entries GROUP BY file_num)"""

ORACLES = {
    "kv_snapshot": f"WITH {_TOP} SELECT k, v FROM top WHERE op = 'ADD'",
    "kv_get": f"WITH {_TOP} SELECT k, v FROM top WHERE op = 'ADD' AND k = 7",
    "kv_multi_get": f"WITH {_TOP} SELECT c_custkey AS k, op IS NOT NULL AS found, v FROM customer LEFT JOIN (FROM top WHERE op = 'ADD') ON k = c_custkey",
    "kv_version_history": f"WITH {_LOG} SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS version FROM l",
    "kv_tombstones": f"WITH {_TOP} SELECT k, seq FROM top WHERE op = 'DEL'",
    "kv_merge_runs": f"WITH {_TOP} SELECT k, seq, v FROM top WHERE op = 'ADD'",
    "kv_range_scan": f"WITH {_ORDERS} SELECT k, v FROM o WHERE k >= 'o/1' AND k <= 'o/3' ORDER BY k",
    "kv_prefix_scan": f"WITH {_ORDERS} SELECT k, v FROM o WHERE starts_with(k, 'o/12') ORDER BY k",
    "kv_seek_limit": f"WITH {_ORDERS} SELECT k, v FROM o WHERE k >= 'o/5' ORDER BY k LIMIT 100",
    "kv_reverse_scan": f"WITH {_ORDERS} SELECT k, v FROM o WHERE k <= 'o/5' ORDER BY k DESC LIMIT 100",
    "kv_full_scan": f"WITH {_ORDERS} SELECT k, v, row_number() OVER (ORDER BY k) AS place FROM o",
    "kv_binary_snapshot": """SELECT hex(key) AS k, v.v AS v FROM (SELECT key, arg_max(op, seq) AS op, arg_max(struct_pack(v := val), seq) AS v FROM sst_entries WHERE key IS NOT NULL GROUP BY key) WHERE op = 'ADD'""",
    "kv_run_stats": f"WITH {_STATS} SELECT * REPLACE (hex(smallest) AS smallest, hex(largest) AS largest) FROM st",
    "kv_range_overlap": f"WITH {_STATS} SELECT a.file_num AS left_run, b.file_num AS right_run FROM st a JOIN st b ON a.file_num < b.file_num AND a.smallest <= b.largest AND b.smallest <= a.largest",
    "kv_level_scores": f"""WITH {_STATS}, lv AS (SELECT greatest(length((key_bytes + value_bytes)::VARCHAR) - 4, 0) AS level, count(*) AS runs, sum(key_bytes + value_bytes)::BIGINT AS bytes FROM st GROUP BY ALL)
        SELECT level, runs, bytes, round(CASE WHEN level = 0 THEN runs / 4.0 ELSE bytes / (1024 * 10.0 ^ (level - 1)) END, 6)::DOUBLE AS score,
               row_number() OVER (ORDER BY CASE WHEN level = 0 THEN runs / 4.0 ELSE bytes / (1024 * 10.0 ^ (level - 1)) END DESC, level) = 1 AS chosen FROM lv""",
    "kv_op_counters": "SELECT op, count(*) AS n FROM sst_entries GROUP BY op",
    "kv_partial_compaction": f"WITH {_TOP} SELECT * FROM top",
    "kv_full_compaction": f"WITH {_TOP} SELECT * FROM top WHERE op = 'ADD'",
    "kv_bloom_candidates": "SELECT DISTINCT hex(key) AS key FROM base_keys WHERE key IN (SELECT key FROM sst_entries WHERE key IS NOT NULL)",
    "store_roundtrip": f"WITH {_TOP} SELECT k, v FROM top WHERE op = 'ADD'",
    "store_multi_get": f"WITH {_TOP} SELECT c_custkey AS k, op IS NOT NULL AS found, v FROM customer LEFT JOIN (FROM top WHERE op = 'ADD') ON k = c_custkey",
    "store_scan": f"WITH {_LEFT} SELECT k, v FROM o WHERE k >= 'o/1' AND k <= 'o/3'",
    "store_compacted": f"WITH {_LEFT} SELECT count(*) AS entries, count(*) AS adds, hex(min(k)) AS smallest, hex(max(k)) AS largest, count(*) AS live, max(v) AS max_v FROM o",
    "store_copy": f"WITH {_LEFT} SELECT k, v FROM o",
    "varints": """WITH n AS (SELECT DISTINCT id, greatest(1, ceil(length(bin(id)) / 7.0))::BIGINT AS size FROM vertices WHERE id IS NOT NULL)
        SELECT id, list_reduce(list_transform(range(size), lambda i: printf('%02X', ((id >> (i * 7)::BIGINT) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END)), lambda x, y: x || y) AS hex, id AS back FROM n""",
    "workload_counts": "SELECT 3000::BIGINT AS operations, 500::BIGINT AS keys, true AS agrees, true AS hit",
    "kv_new_keys": "SELECT hex(key) AS key FROM (SELECT key FROM sst_entries WHERE key IS NOT NULL EXCEPT SELECT key FROM base_keys)",
    "latency_percentiles": """WITH s AS (SELECT event_type, list_sort(list(value)) AS l, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
        SELECT event_type, l[least(floor(n * 0.99)::BIGINT, n - 1) + 1] AS p99, l[least(floor(n * 0.999)::BIGINT, n - 1) + 1] AS p999, l[least(floor(n * 0.9999)::BIGINT, n - 1) + 1] AS p9999, l[n] AS max, n FROM s""",
    "throughput_interval": "WITH h AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1) SELECT start, n, n - lag(n) OVER (ORDER BY start) AS change FROM h",
    "topk_least_used": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n, user_id LIMIT 10",
    "prop_between": "SELECT event_id, user_id, value FROM events WHERE value BETWEEN 10 AND 50",
    "key_parse": """WITH k AS (SELECT DISTINCT upper(elem) || '/' || id || '/' || key AS path, lower(elem) || '/' || id AS element, id FROM props WHERE elem IS NOT NULL AND id IS NOT NULL AND key IS NOT NULL)
        SELECT path, element, regexp_extract(path, '[^/]*$') AS name, id, '0x' || lower(hex(element)) AS hex, greatest(1, ceil(length(bin(id)) / 7.0))::BIGINT AS id_bytes FROM k""",
    "file_range_sizes": f"WITH {_STATS} SELECT file_num, key_bytes + value_bytes AS bytes, sum(key_bytes + value_bytes) OVER ()::BIGINT AS total FROM st",
}
