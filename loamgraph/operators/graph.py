"""A property graph as three tables.

vertices(id), edges(id, src, dst, label) and props(elem 'V' or 'E', id, key, val).  Property values are
text; in a graph that is ``typed`` they are JSON, so numbers, text, truth values, lists and maps differ.  An edge leads
from src (its outV) to dst (its inV); parallel edges and self loops are allowed.  Graphs are
values: a change gives a new graph, and nothing runs before a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import codec
from loamgraph.functions.text import to_float, to_int
from loamgraph.operators import ordered, traverse
from loamgraph.session import empty, pick

EDGE = ("id", "src", "dst", "label")
PROP = ("elem", "id", "key", "val")
#: What the graph can do.  Fixed values: the names, which are common to property-graph interfaces.  Values of any type are kept by a graph that is ``typed``.
FEATURES = {
    "supportsDuplicateEdges": True, "supportsSelfLoops": True, "isPersistent": True, "isRDFModel": False, "supportsVertexIteration": True, "supportsEdgeIteration": True,
    "supportsVertexIndex": False, "supportsEdgeIndex": False, "ignoresSuppliedIds": False, "supportsTransactions": False, "supportsIndices": False, "supportsKeyIndices": False,
    "supportsVertexKeyIndex": False, "supportsEdgeKeyIndex": False, "supportsEdgeRetrieval": True, "supportsVertexProperties": True, "supportsEdgeProperties": True, "supportsThreadedTransactions": False,
    "supportsSerializableObjectProperty": False, "supportsBooleanProperty": True, "supportsDoubleProperty": True, "supportsFloatProperty": True, "supportsIntegerProperty": True,
    "supportsPrimitiveArrayProperty": False, "supportsUniformListProperty": True, "supportsMixedListProperty": True, "supportsLongProperty": True, "supportsMapProperty": True, "supportsStringProperty": True,
}


@dataclass(frozen=True)
class PropertyGraph:
    """The graph and its operators."""

    vertices: DataFrame
    edges: DataFrame
    props: DataFrame
    #: key -> (applied when a value is set, applied when it is read), both on columns.
    hooks: Mapping[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = field(default_factory=dict)

    #: Property values are JSON.
    json: bool = False

    @classmethod
    def new(cls, spark) -> PropertyGraph:
        return cls(empty(spark, "id bigint"), empty(spark, "id bigint, src bigint, dst bigint, label string"), empty(spark, "elem string, id bigint, key string, val string"))

    def typed(self, types: DataFrame | None = None) -> PropertyGraph:
        """The graph with JSON values: by types(elem, key, type) 'int' and 'float' become numbers, all else text; a value that does not suit its type is left out."""
        if self.json:
            return self
        props = pick(self.props, *PROP)
        if types is None:
            return replace(self, json=True, props=props.withColumn("val", codec.json_value(F.col("val"))))
        kinds = pick(types, "elem", "key", "type").groupBy("elem", "key").agg(F.min("type").alias("type"))
        number = F.when(F.col("type") == "int", codec.json_value(to_int(F.col("val")))).when(F.col("type") == "float", codec.json_value(to_float(F.col("val"))))
        val = F.when(F.col("type").isin("int", "float"), number).otherwise(codec.json_value(F.col("val")))
        return replace(self, json=True, props=props.join(kinds, ["elem", "key"], "left").withColumn("val", val).where("val IS NOT NULL").select(*PROP))

    def with_hook(self, key: str, save: Callable[[Column], Column], load: Callable[[Column], Column]) -> PropertyGraph:
        """Values of this key go through ``save`` in set_properties and through ``load`` in property."""
        return replace(self, hooks={**self.hooks, key: (save, load)})

    # elements
    def v(self, id_: Any) -> DataFrame:
        """The vertex, or no row."""
        return self.vertices.where(F.col("id") == F.lit(id_))

    def e(self, id_: Any) -> DataFrame:
        """The edge, or no row."""
        return self.edges.where(F.col("id") == F.lit(id_))

    def counts(self) -> DataFrame:
        """(elem, n)."""
        return self.vertices.agg(F.lit("V").alias("elem"), F.count("*").alias("n")).unionByName(self.edges.agg(F.lit("E").alias("elem"), F.count("*").alias("n")))

    def next_id(self, elem: str) -> int:
        """One more than the greatest id in use."""
        return (self._table(elem).agg(F.max("id")).first()[0] or 0) + 1

    def with_ids(self, rows: DataFrame, elem: str, *order: str) -> DataFrame:
        """The rows with new ids of the kind, in the order of these columns."""
        return ordered.numbered(rows, *order, name="id").withColumn("id", F.col("id") + self.next_id(elem) - 1)

    def _table(self, elem: str) -> DataFrame:
        return {"V": self.vertices, "E": self.edges}[elem]

    def scan(self, elem: str) -> DataFrame:
        """All elements of a kind in the order of their keys, that is, of the ids as text."""
        return self._table(elem).orderBy(F.col("id").cast("string"))

    # changes
    def add_vertices(self, rows: DataFrame) -> PropertyGraph:
        """Vertices that are there already stay as they are."""
        return replace(self, vertices=pick(self.vertices, "id").unionByName(pick(rows, "id")).where("id IS NOT NULL").distinct())

    def add_edges(self, rows: DataFrame) -> PropertyGraph:
        """Edges(id, src, dst, label); an edge whose id exists replaces it, and of rows with one id the greatest counts.  Rows without id are left out.  Endpoints are taken to exist."""
        new = pick(rows, *EDGE).where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("src", "dst", "label")).alias("e")).select("id", "e.src", "e.dst", "e.label")
        return replace(self, edges=pick(self.edges, *EDGE).join(new.select("id"), "id", "left_anti").select(*EDGE).unionByName(new))

    def remove_vertices(self, ids: DataFrame, *, cascade: bool = False) -> PropertyGraph:
        """Properties and edges stay, unless ``cascade``; ``dangling`` finds such edges."""
        gone = pick(ids, "id").distinct()
        left = self.vertices.join(gone, "id", "left_anti")
        if not cascade:
            return replace(self, vertices=left)
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*EDGE)
        lost = self.edges.select("id").join(edges.select("id"), "id", "left_anti")
        own = gone.select(F.lit("V").alias("elem"), "id").unionByName(lost.select(F.lit("E").alias("elem"), "id"))
        return replace(self, vertices=left, edges=edges, props=self.props.join(own, ["elem", "id"], "left_anti"))

    def remove_edges(self, ids: DataFrame) -> PropertyGraph:
        return replace(self, edges=self.edges.join(pick(ids, "id"), "id", "left_anti").select(*EDGE))

    def set_properties(self, rows: DataFrame) -> PropertyGraph:
        """props(elem, id, key, val) written over what is there; a null val removes.  A typed graph takes values of any type."""
        rows = pick(rows, *PROP)
        new = (rows.withColumn("val", codec.json_value(F.col("val"))) if self.json else rows).groupBy("elem", "id", "key").agg(F.max("val").alias("val"))
        for key, (save, _) in self.hooks.items():
            new = new.withColumn("val", F.when(F.col("key") == key, save(F.col("val"))).otherwise(F.col("val")))
        old = self.props.join(new.select("elem", "id", "key"), ["elem", "id", "key"], "left_anti")
        return replace(self, props=old.select(*PROP).unionByName(new.where("val IS NOT NULL").select(*PROP)))

    def remove_properties(self, rows: DataFrame) -> PropertyGraph:
        return replace(self, props=self.props.join(pick(rows, "elem", "id", "key"), ["elem", "id", "key"], "left_anti").select(*PROP))

    # properties
    def property(self, elem: str, key: str, default: Any = None) -> DataFrame:
        """(id, val) for every element of the kind; the default where the property is missing."""
        own = self.props.where((F.col("elem") == elem) & (F.col("key") == key)).select("id", self.hooks[key][1](F.col("val")).alias("val") if key in self.hooks else "val")
        return self._table(elem).select("id").join(own, "id", "left").select("id", F.coalesce("val", F.lit(default)).alias("val"))

    def property_keys(self, elem: str, *, adjacency: bool = False) -> DataFrame:
        """(id, key) of the properties each element has; the stored adjacency lists are hidden unless asked for."""
        rows = self.props.where(F.col("elem") == elem).select("id", "key").distinct()
        return rows if adjacency else rows.where(~F.col("key").isin("inE", "outE"))

    def having(self, elem: str, key: str, value: Any) -> DataFrame:
        """Elements whose property equals the value, in a typed graph in type too (1 is not '1'); a missing property never does."""
        value = codec.json_literal(value) if self.json else value
        match = self.props.where((F.col("elem") == elem) & (F.col("key") == key) & (F.col("val") == F.lit(value))).select("id")
        return self._table(elem).join(match, "id", "left_semi")

    def having_between(self, elem: str, key: str, lo: Any, hi: Any, cast: str = "string") -> DataFrame:
        """Elements whose property lies between (both inclusive), after a cast that turns unfit values into null."""
        val = F.col("val").try_cast(cast)
        match = self.props.where((F.col("elem") == elem) & (F.col("key") == key) & val.between(F.lit(lo), F.lit(hi))).select("id")
        return self._table(elem).join(match, "id", "left_semi")

    # traversal
    def incident(self, direction: str, labels: Sequence[str] = (), seeds: DataFrame | None = None) -> DataFrame:
        """(v, edge_id, src, dst, label, dir): see ``traverse.incident``."""
        return traverse.incident(self.edges, self.vertices if seeds is None else seeds, direction, labels)

    def neighbours(self, direction: str, labels: Sequence[str] = (), seeds: DataFrame | None = None) -> DataFrame:
        """(v, edge_id, w, dir): see ``traverse.neighbours``."""
        return traverse.neighbours(self.edges, self.vertices if seeds is None else seeds, direction, labels)

    def query(self) -> VertexQuery:
        return VertexQuery(self)

    def dangling(self) -> DataFrame:
        """(id, side) of edges whose endpoint is no vertex."""
        ends = [self.edges.select("id", F.lit(s).alias("side"), F.col(s).alias("end")) for s in ("src", "dst")]
        known = self.vertices.select(F.col("id").alias("end")).distinct()
        return ends[0].unionByName(ends[1]).join(known, "end", "left_anti").select("id", "side")

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, degree) of every vertex; a self loop counts in both.  Partial counts are shuffled, not edges."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
        n = ends.groupBy("x.id").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return self.vertices.select("id").join(n, "id", "left").select("id", zero("o").alias("out_degree"), zero("i").alias("in_degree"), (zero("o") + zero("i")).alias("degree"))


@dataclass(frozen=True)
class VertexQuery:
    """Edges around vertices, narrowed step by step: ``has``, ``interval``, ``direction``, ``labels``, ``limit``."""

    graph: PropertyGraph
    filters: tuple = ()
    dir: str = "both"
    names: tuple[str, ...] = ()
    most: int | None = None

    def has(self, key: str, value: Any, compare: str = "=") -> VertexQuery:
        """Edges whose property compares so (=, <>, <, <=, >, >=); for numbers the property is read as a number."""
        return replace(self, filters=(*self.filters, (key, compare, value)))

    def interval(self, key: str, lo: Any, hi: Any) -> VertexQuery:
        """From lo (inclusive) to hi (exclusive)."""
        return self.has(key, lo, ">=").has(key, hi, "<")

    def direction(self, direction: str) -> VertexQuery:
        return replace(self, dir=direction)

    def labels(self, *labels: str) -> VertexQuery:
        return replace(self, names=labels)

    def limit(self, n: int) -> VertexQuery:
        """At most so many edges of each vertex, the first by (direction, edge id)."""
        return replace(self, most=n)

    def edges(self, seeds: DataFrame | None = None) -> DataFrame:
        rows = self.graph.incident(self.dir, self.names, seeds)
        for key, compare, value in self.filters:
            val = F.col("val").try_cast("double") if isinstance(value, (int, float)) else codec.json_text(F.col("val")) if self.graph.json else F.col("val")
            test = {"=": val == value, "<>": val != value, "<": val < value, "<=": val <= value, ">": val > value, ">=": val >= value}[compare]
            match = self.graph.props.where((F.col("elem") == "E") & (F.col("key") == key) & test).select(F.col("id").alias("edge_id"))
            rows = rows.join(match, "edge_id", "left_semi")
        if self.most is None:
            return rows
        # Each task keeps the first ones of its rows of a vertex before they are shuffled.
        place = F.row_number().over(Window.partitionBy("v").orderBy("dir", "edge_id"))
        return rows.withColumn("_n", place).where(F.col("_n") <= self.most).drop("_n")

    def vertices(self, seeds: DataFrame | None = None) -> DataFrame:
        """(v, edge_id, w, dir)."""
        return self.edges(seeds).select("v", "edge_id", F.when(F.col("dir") == "out", F.col("dst")).otherwise(F.col("src")).alias("w"), "dir")

    def vertex_ids(self, seeds: DataFrame | None = None) -> DataFrame:
        """(v, w): the vertices at the other ends."""
        return self.vertices(seeds).select("v", "w")

    def count(self, seeds: DataFrame | None = None) -> DataFrame:
        """(v, n)."""
        return self.edges(seeds).groupBy("v").agg(F.count("*").alias("n"))
