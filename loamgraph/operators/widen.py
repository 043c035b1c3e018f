"""Entity-attribute-value rows into wide, typed tables.

The current cells are partitioned by attribute into narrow tables (id, value) on
shared storage, each in the same buckets of id as the table of all entities.  The tables
are combined by a balanced tree of outer joins: each leaf joins some narrow tables to the
entities, and each node above joins some nodes below.  All of them are bucketed alike, so
a cell is shuffled to its bucket once and no join shuffles.  A plain full outer join forgets
its partitioning; anchored on the entities every node keeps it.  Every node but the
last is written, so a plan never has more than ``fan_in`` joins, however many attributes there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.text import to_float, to_int
from loamgraph.session import bucketed, pick, shuffle_parts

#: Property rows for each bucket of entities, and those below which a bucket is not worth while for the sake of another core.
BUCKET, LEAST = 200_000, 20_000

#: The word for an element's kind in declarations, and the types known.
KIND_OF = {"V": "node", "E": "edge"}
TYPES = {"int": "bigint", "float": "double", "string": "string"}


@dataclass(frozen=True)
class Attribute:
    """A declared attribute of one kind of element and its column in the wide table."""

    number: int
    elem: str
    key: str
    type: str
    column: str


def declared(attr_keys: DataFrame, *, most: int = 5000) -> list[Attribute]:
    """Attributes by element, from the declarations.

    A declaration for the kind itself beats one for 'all'.  A null type, or one that is
    not int, float or string, means string.  Repeated declarations count once; if they
    differ, the first type in alphabetical order holds.  Null keys or kinds are ignored.
    Declarations become columns, so they are few by nature; more than ``most`` is an error.
    """
    rows = pick(attr_keys, "for_elem", "key", "attr_type").where("for_elem IS NOT NULL AND key IS NOT NULL").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} declarations")
    found = []
    for elem, kind in KIND_OF.items():
        types: dict[str, tuple[bool, str]] = {}
        for r in rows:
            if r.for_elem in (kind, "all"):
                rank = (r.for_elem == "all", r.attr_type if r.attr_type in TYPES else "string")
                types[r.key] = min(rank, types.get(r.key, rank))
        taken = {"id", "unfit"}
        for key in sorted(types):
            column, n = key, 2
            while column.lower() in taken:
                column, n = f"{key}_{n}", n + 1
            taken.add(column.lower())
            found.append(Attribute(len(found), elem, key, types[key][1], column))
    return found


def current_cells(props: DataFrame, numbers: DataFrame) -> DataFrame:
    """(attr, id, val) of the row with the highest seq of each cell, by numbers(elem, key, attr) of the declared attributes.

    Rows without elem, id or key belong to no cell.  A null seq counts as the lowest; of different values with one
    seq the greatest counts.  A null val (removed) is kept.  All rows of an entity without a declared key make
    one cell, -1 for vertices and -2 for edges, which only names it: however many there are, they are combined before the shuffle.
    """
    rows = pick(props, "elem", "id", "key", "val", "seq").where(F.col("elem").isin(*KIND_OF) & F.col("id").isNotNull() & F.col("key").isNotNull())
    known = F.col("attr").isNotNull()
    rows = rows.join(F.broadcast(numbers), ["elem", "key"], "left").select(  # one row for each declared attribute
        F.coalesce("attr", F.when(F.col("elem") == "V", -1).otherwise(-2)).alias("attr"), "id", F.when(known, F.struct("seq", "val")).alias("cell")
    )
    return rows.groupBy("attr", "id").agg(F.max("cell").alias("cell")).select("attr", "id", F.col("cell.val").alias("val"))


class WideTables:
    """The wide tables of vertices ('V') and edges ('E') of one property table.

    Input: props(elem, id, key, val, seq) and declarations(for_elem, key, attr_type).
    ``wide(elem)`` has one row for each entity with any property row: id, a typed column
    for each declared key (null where the value is absent, removed or does not suit the
    type), and ``unfit``: key and text of the values that do not suit.  Undeclared keys
    have no column.  If two keys differ only in case, or a key is named id or unfit, later
    ones get _2, _3 ... appended.  Empty text is a value of a string column and unfit
    elsewhere.  Empty input gives empty tables.
    """

    def __init__(self, props: DataFrame, attr_keys: DataFrame, *, fan_in: int = 8):
        self.attributes, self.fan_in = declared(attr_keys), fan_in
        spark = props.sparkSession
        n = props.count()
        self.buckets = max(1, min(shuffle_parts(spark), max(-(-n // BUCKET), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)))))
        numbers = spark.createDataFrame([(a.elem, a.key, a.number) for a in self.attributes], "elem string, key string, attr int")
        cells = current_cells(props, numbers)
        self.cells = bucketed(cells.repartition(self.buckets, "id"), "cells", self.buckets, "id", "attr")
        self._entities: dict[str, DataFrame] = {}

    def entities(self, elem: str) -> DataFrame:
        """(id) of every entity of the kind."""
        if elem not in self._entities:
            own = [a.number for a in self.attributes if a.elem == elem] + [-1 if elem == "V" else -2]
            self._entities[elem] = bucketed(self.cells.where(F.col("attr").isin(own)).select("id").distinct(), f"entities_{elem}", self.buckets, "id")
        return self._entities[elem]

    def narrow(self, a: Attribute) -> DataFrame:
        """(id, v<n>, u<n>): the typed value, or the text that does not suit the type."""
        rows = self.cells.where((F.col("attr") == a.number) & F.col("val").isNotNull())
        value = {"int": to_int, "float": to_float}.get(a.type, lambda c: c)(F.col("val"))
        bad = F.when(value.isNull(), F.col("val")) if a.type != "string" else F.lit(None).cast("string")
        return rows.select("id", value.alias(f"v{a.number}"), bad.alias(f"u{a.number}"))

    def _tree(self, elem: str) -> DataFrame:
        """The entities with the values of all attributes; every node of the tree but this one is written."""
        level = [self.narrow(a) for a in self.attributes if a.elem == elem]
        how, root = "left", self.entities(elem)
        while True:
            nodes = []
            for i in range(0, len(level), self.fan_in):
                part = level[i : i + self.fan_in]
                node = root if how == "left" else part.pop(0)
                for x in part:  # above the leaves every node has all entities, so an inner join loses none
                    node = node.join(x, "id", how)
                nodes.append(node)
            if len(nodes) <= 1:
                return nodes[0] if nodes else root
            level, how = [bucketed(x, f"node{i}", self.buckets, "id") for i, x in enumerate(nodes)], "inner"

    def wide(self, elem: str) -> DataFrame:
        """One row per entity of the kind."""
        own = [a for a in self.attributes if a.elem == elem]
        unfit = [F.when(F.col(f"u{a.number}").isNotNull(), F.struct(F.lit(a.key).alias("key"), F.col(f"u{a.number}").alias("val"))) for a in own if a.type != "string"]
        bad = F.filter(F.array(*unfit), lambda x: x.isNotNull()) if unfit else F.expr("CAST(array() AS array<struct<key:string,val:string>>)")
        return self._tree(elem).select("id", *(F.col(f"v{a.number}").alias(a.column) for a in own), bad.alias("unfit"))

    def unfit(self) -> DataFrame:
        """(elem, id, key, val) of every current value that does not suit its declared type."""
        parts = [self.wide(e).select(F.lit(e).alias("elem"), "id", F.explode("unfit").alias("u")) for e in KIND_OF]
        return parts[0].unionByName(parts[1]).select("elem", "id", F.col("u.key").alias("key"), F.col("u.val").alias("val"))
