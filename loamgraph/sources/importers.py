"""Graphs from files, and workloads for measuring."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import strip, to_float, to_int
from loamgraph.operators.graph import PropertyGraph
from loamgraph.operators.widen import TYPES
from loamgraph.session import load, stored

_DATA = "data array<struct<_VALUE:string,_key:string>>"
_ELEMENTS = {"node": f"_id string, {_DATA}", "edge": f"_id string, _source string, _target string, _label string, {_DATA}"}


def _nested(depth: int) -> str:
    """Type of the graphs in an element, read ``depth`` levels deep; what lies deeper is text."""
    if not depth:
        return "graph array<string>"
    return "graph array<struct<" + ", ".join(f"{tag} array<struct<{ddl}, {_nested(depth - 1)}>>" for tag, ddl in _ELEMENTS.items()) + ">>"


def _inside(graphs: Any) -> Iterator[tuple[str, Any]]:
    """(tag, element) of all elements in these graphs, at any level; of graphs that are still text ('text', None)."""
    todo = list(graphs or ())
    while todo:
        g = todo.pop()
        if isinstance(g, str):
            yield "text", None
        elif g is not None:
            for tag in _ELEMENTS:
                for x in g[tag] or ():
                    yield tag, x
                    todo.extend(x["graph"] or ())


def _elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The nodes or edges, those in graphs that are nested in others too.

    The source gives the outermost element as one row.  How deep its schema has to reach is found
    by reading once for each level that there is.
    """
    own = [c.split()[0] for c in _ELEMENTS[tag].split(", ")]
    deeper = F.udf(lambda graphs: any(t == "text" for t, _ in _inside(graphs)), "boolean")
    inner = F.udf(lambda graphs: [tuple(x[c] for c in own) for t, x in _inside(graphs) if t == tag], f"array<struct<{_ELEMENTS[tag]}>>")
    depth = 0
    while True:
        rows = spark.read.format("xml").option("rowTag", tag).schema(f"{_ELEMENTS[tag]}, {_nested(depth)}").load(path)
        nested = rows.where("graph IS NOT NULL")
        if (nested if not depth else nested.where(deeper("graph"))).isEmpty():
            break
        depth += 1
    if not depth:
        return rows.select(*own)
    return rows.select(F.explode(F.concat(F.array(F.struct(*own)), inner("graph"))).alias("e")).select("e.*")


def graphml(spark: SparkSession, path: str, *, strict: bool = False) -> PropertyGraph:
    """A graph from GraphML files.

    Property values are kept as text in canonical form of their declared type (int, float,
    string); a value that does not suit its type is dropped.  Elements of graphs nested in a
    node or an edge are read too, at any depth; an outermost element with all that it holds is
    one row.  Nodes and edges have their own declarations; one for a kind goes before one for all,
    and among repeats the last in the order of the files counts.  Node and edge ids must be whole
    numbers; what is left out is listed by ``graphml_rejects``.  ``strict`` makes an unknown type an
    error, which else means string.
    """
    if strict and (unknown := [r.key for r in check_types(spark, path).limit(10).collect()]):
        raise ValueError(f"unknown attr.type of {unknown}")
    nodes, edges, typed = _parts(spark, path)
    val = F.when(F.col("type") == "int", to_int(F.col("val")).cast("string")).when(F.col("type") == "float", to_float(F.col("val")).cast("string")).otherwise(F.coalesce("val", F.lit("")))
    props = typed.select("elem", "id", F.coalesce("name", "key").alias("key"), val.alias("val")).where("val IS NOT NULL").dropDuplicates(["elem", "id", "key"])
    links = edges.select(*(to_int(F.col(c)).alias(n) for c, n in (("_id", "id"), ("_source", "src"), ("_target", "dst"))), F.col("_label").alias("label")).where("id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    return PropertyGraph(nodes.select(to_int(F.col("_id")).alias("id")).where("id IS NOT NULL").distinct(), links.dropDuplicates(["id"]), props)


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, cells with the name and type of their declaration) of GraphML files, as text."""
    read = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)
    nodes = _elements(spark, path, "node").where("_id IS NOT NULL")
    edges = _elements(spark, path, "edge")
    keys = read("key", "_id string, _for string, `_attr.name` string, `_attr.type` string").where("_id IS NOT NULL")
    # A key may be declared once for nodes and once for edges; without a kind it is declared for all.
    kinds = F.when(F.col("_for") == "node", F.array(F.lit("V"))).when(F.col("_for") == "edge", F.array(F.lit("E"))).when(F.coalesce("_for", F.lit("all")) == "all", F.array(F.lit("V"), F.lit("E")))
    place = F.struct(F.coalesce(F.col("_for") != "all", F.lit(False)), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    types = keys.select(F.col("_id").alias("key"), F.struct(F.coalesce("`_attr.name`", "_id").alias("name"), F.coalesce("`_attr.type`", F.lit("string")).alias("type")).alias("t"), place.alias("place"), F.explode(kinds).alias("elem"))
    types = types.groupBy("elem", "key").agg(F.max_by("t", "place").alias("t")).select("elem", "key", "t.name", "t.type")
    ids = lambda df, elem: df.select(F.lit(elem).alias("elem"), to_int(F.col("_id")).alias("id"), F.explode("data").alias("d")).where("id IS NOT NULL")
    cells = ids(nodes, "V").unionByName(ids(edges, "E")).select("elem", "id", F.col("d._key").alias("key"), F.col("d._VALUE").alias("val"))
    typed = cells.join(types, ["elem", "key"], "left")
    return nodes, edges, typed


def graphml_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(elem, id, what, text) of what ``graphml`` leaves out: elements whose 'id', 'source' or 'target' is no whole number (or missing), and values that do not suit their type (what is the key)."""
    nodes, edges, typed = _parts(spark, path)
    bad = lambda df, elem, c: df.where(to_int(F.col(f"_{c}")).isNull()).select(F.lit(elem).alias("elem"), F.col("_id").alias("id"), F.lit(c).alias("what"), F.col(f"_{c}").alias("text"))
    unfit = ((F.col("type") == "int") & to_int(F.col("val")).isNull()) | ((F.col("type") == "float") & to_float(F.col("val")).isNull())
    values = typed.where(unfit).select("elem", F.col("id").cast("string").alias("id"), F.coalesce("name", "key").alias("what"), F.col("val").alias("text"))
    return bad(nodes, "V", "id").unionByName(bad(edges, "E", "id")).unionByName(bad(edges, "E", "source")).unionByName(bad(edges, "E", "target")).unionByName(values)


def check_types(spark: SparkSession, path: str) -> DataFrame:
    """Declared attributes of GraphML files whose type is none of int, float and string."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.type` string").load(path)
    return keys.where(~F.col("`_attr.type`").isin(*TYPES)).select(F.col("_id").alias("key"), F.col("`_attr.type`").alias("type"))


def edge_list(spark: SparkSession, path: str, *, label: str = "link") -> PropertyGraph:
    """Lines 'src dst' (white space between); an edge's id is its line's number from 0 over the files in name order.

    Line numbers need no single task: lines are numbered within their partition, and the few
    partition sizes are summed up.  Other lines are left out but counted.
    """
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_block_start"))
    lines = stored(lines.withColumn("pid", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "lines")
    blocks = lines.groupBy("pid", "file", "at").agg(F.min("n").alias("first"), F.count("*").alias("size")).orderBy("file", "at").collect()  # one row per split of the input
    start, offsets = 0, []
    for b in blocks:
        offsets.append((b.pid, b.file, b.at, start - b.first))
        start += b.size
    shift = spark.createDataFrame(offsets, "pid int, file string, at bigint, shift bigint")
    part = F.split(strip(F.col("value")), r"\s+")
    rows = lines.join(F.broadcast(shift), ["pid", "file", "at"]).select((F.col("n") + F.col("shift")).alias("id"), to_int(F.try_element_at(part, F.lit(1))).alias("src"), to_int(F.try_element_at(part, F.lit(2))).alias("dst"), F.lit(label).alias("label"))  # one row per split
    rows = rows.where("src IS NOT NULL AND dst IS NOT NULL")
    vertices = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return PropertyGraph(vertices, rows, PropertyGraph.new(spark).props)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of every whole number in text files, white space between; other words are left out."""
    words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("word"))
    return words.select(to_int(F.col("word")).alias("id")).where("id IS NOT NULL")


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the tables edges, vertices and catalog_vertices: endpoints that are whole numbers, every edge id once."""
    rows = load(spark, sf_dir, "edges").select("id", to_int(F.col("source")).alias("src"), to_int(F.col("target")).alias("dst"), "label").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    vertices = load(spark, sf_dir, "vertices").select("id").unionByName(load(spark, sf_dir, "catalog_vertices").select("id")).distinct()
    props = load(spark, sf_dir, "props").where("elem IS NOT NULL AND id IS NOT NULL AND key IS NOT NULL").groupBy("elem", "id", "key").agg(F.max(F.struct("seq", "val")).alias("t"))
    return PropertyGraph(vertices, rows, props.select("elem", "id", "key", F.col("t.val").alias("val")).where("val IS NOT NULL"))


def table_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, side, endpoint) of the endpoints for which ``table_graph`` leaves an edge out: null, blank, or no whole number."""
    side = lambda c, n: F.struct(F.lit(n).alias("side"), F.col(c).alias("endpoint"))
    rows = load(spark, sf_dir, "edges").select("id", F.explode(F.array(side("source", "src"), side("target", "dst"))).alias("e"))
    return rows.select("id", "e.side", "e.endpoint").where(to_int(F.col("endpoint")).isNull()).distinct()


def workload(spark: SparkSession, n: int, *, keys: int = 1_000_000, value_bytes: int = 100, puts: float = 1.0, dels: float = 0.0, sequential: bool = False, seed: int = 1, rate: float | None = None) -> DataFrame:
    """(k, seq, op, v): random or sequential padded keys with a mix of ADD, DEL and GET; with ``rate`` also wait, the exponentially distributed time to the next one."""
    base = spark.range(n).withColumnRenamed("id", "seq")
    k = F.col("seq") % keys if sequential else F.floor(F.rand(seed) * keys)
    half = value_bytes // 2
    r = F.rand(seed + 1)
    wait = [] if rate is None else [(-F.log(1 - F.rand(seed + 2)) / rate).alias("wait")]
    return base.select(
        F.lpad(k.cast("string"), 12, "0").alias("k"), "seq", *wait,
        F.when(r < puts, "ADD").when(r < puts + dels, "DEL").otherwise("GET").alias("op"),
        F.rpad(F.repeat(F.hex(F.xxhash64("seq")), -(-half // 16)), half, "0").alias("v"),
    ).withColumn("v", F.concat("v", "v"))
