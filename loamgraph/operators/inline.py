"""Deeply nested records into flat tables, by shared inlining.

A first pass over the records gathers the schema graph: which element holds which child,
which scalar attributes an element has, and what occurs repeatedly.  An element that
occurs once at most and below one kind of parent only is inlined into its parent's
table; an element that is repeated, shared by several parents or part of a cycle gets a
table of its own, with a foreign key to the row (and table) that holds it.  A second pass
takes each record apart into the rows of the tables asked for, written column by column.

Every attribute of every element has a column of its own and every list of scalars a table of
its own: names that clash, also by case or with the columns of the keys, are numbered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.jsontext import clean, dump, parse
from loamgraph.session import pick, stored

ROOT = "record"
ITEM = "item"
#: The columns every table begins with.
KEYS = ("record_id", "row_id", "parent_tbl", "parent_row", "n")
#: The element at the top; the others are a dot and their name in the records.
TOP = ""


def _unique(wanted: str, taken: set[str]) -> str:
    """The name, or the name with _2, _3 ... if it is taken, without regard to case."""
    name, n = wanted, 2
    while name.lower() in taken:
        name, n = f"{wanted}_{n}", n + 1
    taken.add(name.lower())
    return name


@dataclass(frozen=True)
class SchemaGraph:
    """children: (parent, child) -> repeated; attributes: (element, name); lists: (element, name) of repeated scalars.

    Elements are written as ``_element`` does, and the one at the top as ''.
    ``repeatable``: elements the format allows to repeat, also if they do not in these records.
    """

    children: dict[tuple[str, str], bool]
    attributes: frozenset[tuple[str, str]]
    lists: frozenset[tuple[str, str]]
    repeatable: frozenset[str] = frozenset()

    @cached_property
    def below(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = defaultdict(list)
        for p, c in sorted(self.children):
            found[p].append(c)
        return dict(found)

    @cached_property
    def above(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = defaultdict(list)
        for p, c in sorted(self.children):
            found[c].append(p)
        return dict(found)

    def recursive(self, element: str) -> bool:
        todo, seen = [element], set()
        while todo:
            for c in self.below.get(todo.pop(), ()):
                if c == element:
                    return True
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return False

    @cached_property
    def ways(self) -> dict[str, tuple[str, ...]]:
        """Element -> the elements on the way from its table's element to it; elements with a table have ()."""
        repeated = {c for (_, c), r in self.children.items() if r} | self.repeatable
        way: dict[str, tuple[str, ...]] = {TOP: ()}
        alone = []
        for e in sorted(self.above):
            if e in repeated or len(self.above[e]) > 1 or self.recursive(e):
                way[e] = ()
            else:
                alone.append(e)
        for e in alone:
            chain = [e]
            while chain[-1] not in way:
                chain.append(self.above[chain[-1]][0])
            for at in reversed(chain[:-1]):
                way[at] = (*way[self.above[at][0]], at)
        return way

    def owner(self, element: str) -> str:
        """The element in whose table an element's attributes are."""
        return self.above[self.ways[element][0]][0] if self.ways[element] else element

    @cached_property
    def tables(self) -> dict[tuple[str, ...], str]:
        """(element,) or, for a list of scalars, (element, name) -> name of its table."""
        taken: set[str] = set()
        own = sorted(e for e, w in self.ways.items() if not w)
        found: dict[tuple[str, ...], str] = {(e,): _unique(_label(e), taken) for e in own}
        found.update({(e, n): _unique(f"{_label(e)}_{n}", taken) for e, n in sorted(self.lists)})
        return found

    @cached_property
    def columns(self) -> dict[tuple[str, str], tuple[str, str]]:
        """(element, attribute) -> (table, column); inlined ones are named child_attribute."""
        taken: dict[str, set[str]] = defaultdict(lambda: {k.lower() for k in KEYS})
        found = {}
        # An element's own attributes are named before those of what is inlined into it.
        for element, name in sorted(self.attributes, key=lambda x: (len(self.ways[x[0]]), x)):
            table = self.tables[(self.owner(element),)]
            found[element, name] = (table, _unique("_".join((*map(_label, self.ways[element]), name)), taken[table]))
        return found

    def layout(self) -> dict[str, list[str]]:
        """Table -> its columns from the records, in order."""
        found: dict[str, list[str]] = {t: [ITEM] if len(k) > 1 else [] for k, t in self.tables.items()}
        for table, column in self.columns.values():
            found[table].append(column)
        return {t: sorted(c) for t, c in found.items()}


def _element(name: str) -> str:
    """An element of this name, told apart from the top."""
    return f".{name}"


def _label(element: str) -> str:
    """What an element is called in names of tables and columns."""
    return element[1:] if element else ROOT


def _analyse(opaque: frozenset[str]):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str]] = set()
        for pdf in it:
            for text in pdf["payload"]:
                ok, top = parse(text)
                todo = [(TOP, top)] if ok and isinstance(top, dict) else []
                while todo:
                    element, o = todo.pop()
                    for raw, v in o.items():
                        name = clean(raw)
                        if name in opaque or not isinstance(v, (dict, list)):
                            seen.add(("a", element, name))
                        elif isinstance(v, dict):
                            seen.add(("o", element, _element(name)))
                            todo.append((_element(name), v))
                        else:
                            for x in v:
                                if isinstance(x, dict):
                                    seen.add(("oo", element, _element(name)))
                                    todo.append((_element(name), x))
                                else:
                                    seen.add(("l", element, name))
        yield pd.DataFrame(sorted(seen), columns=["what", "element", "name"])

    return run


def schema_graph(records: DataFrame, *, opaque: tuple[str, ...] = ("value",), repeatable: tuple[str, ...] = (), most: int = 10_000) -> SchemaGraph:
    """The schema graph of all records.

    ``opaque`` names are attributes whatever they hold.  Names become tables and columns, so
    they are few by nature; more than ``most`` different ones are an error that asks for more
    opaque names.
    """
    found = pick(records, "payload").mapInPandas(_analyse(frozenset(opaque)), "what string, element string, name string").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different element and attribute names")
    children: dict[tuple[str, str], bool] = defaultdict(bool)
    for r in found:
        if r.what in ("o", "oo"):
            children[r.element, r.name] |= r.what == "oo"
    return SchemaGraph(dict(children), frozenset((r.element, r.name) for r in found if r.what == "a"), frozenset((r.element, r.name) for r in found if r.what == "l"), frozenset(map(_element, repeatable)))


ROWS = "tbl string, record_id bigint, row_id string, parent_tbl string, parent_row string, n int, vals map<string,string>"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]


@dataclass(slots=True)
class _Place:
    """What to do with each name below an element, as inlined where it is."""

    table: str
    #: The table is asked for.
    emit: bool
    columns: dict[str, str] = field(default_factory=dict)  # attributes asked for
    inlined: dict[str, Any] = field(default_factory=dict)
    own: dict[str, Any] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)  # lists asked for


def _plan(graph: SchemaGraph, wanted: Mapping[str, Sequence[str] | None] | None) -> _Place:
    """The place of the top; ``wanted``: tables asked for, with their columns (None: all)."""
    places = {e: _Place(graph.tables[(graph.owner(e),)], False) for e in graph.ways}
    asked = lambda table: wanted is None or table in wanted
    for e, p in places.items():
        p.emit = asked(p.table)
        for c in graph.below.get(e, ()):
            (p.inlined if graph.ways[c] else p.own)[c] = places[c]
    for (e, name), (table, column) in graph.columns.items():
        if asked(table) and (wanted is None or wanted[table] is None or column in wanted[table]):
            places[e].columns[name] = column
    for e, name in graph.lists:
        if asked(graph.tables[e, name]):
            places[e].lists[name] = graph.tables[e, name]
    return places[TOP]


def _shred(graph: SchemaGraph, opaque: frozenset[str], wanted: Mapping[str, Sequence[str] | None] | None, batch: int = 20_000):
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_place = _plan(graph, wanted)
        out: tuple[list, ...] = tuple([] for _ in _TYPES)
        starts, keys, values = [0], [], []

        def take() -> pa.RecordBatch:
            vals = pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
            made = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, _TYPES)), vals], names=names)
            for c in out:
                c.clear()
            starts[:] = [0]
            keys.clear()
            values.clear()
            return made

        def put(*row: Any) -> None:
            for c, x in zip(out, row):
                c.append(x)
            starts.append(len(keys))

        for rb in it:
            cols = rb.to_pydict()
            for record, doc, text in zip(cols["record_id"], cols["doc"], cols["payload"]):
                ok, top = parse(text)
                if not ok or not isinstance(top, dict):
                    continue
                count = 0
                # Work list of (place, object, place among its siblings, parent's table and row): no recursion, so any depth will do.
                todo: list[tuple[_Place, dict, int, str | None, str | None]] = [(top_place, top, 0, None, None)]
                while todo:
                    place, o, n, ptable, prow = todo.pop()
                    row = f"{doc}/{count}"
                    count += 1
                    lists: list[tuple[str, int, Any]] = []
                    below: list[tuple[_Place, dict, int, str | None, str | None]] = []
                    inlined = [(place, o)]
                    while inlined:
                        here, part = inlined.pop()
                        at: dict[str, int] = {}
                        for raw, v in part.items():
                            name = clean(raw)
                            if name in opaque or not isinstance(v, (dict, list)):
                                if (column := here.columns.get(name)) is not None:
                                    keys.append(column)
                                    values.append(dump(v))
                                continue
                            child = _element(name)
                            for i, x in enumerate(v if isinstance(v, list) else (v,)):
                                if not isinstance(x, dict):
                                    if (table := here.lists.get(name)) is not None:
                                        lists.append((table, i, x))
                                elif child in here.own:
                                    below.append((here.own[child], x, at.get(child, 0), place.table, row))
                                    at[child] = at.get(child, 0) + 1
                                else:
                                    inlined.append((here.inlined[child], x))
                    todo.extend(reversed(below))  # rows are numbered in the order of the text
                    if place.emit:
                        put(place.table, record, row, ptable, prow, n)
                    for table, i, x in lists:
                        keys.append(ITEM)
                        values.append(dump(x))
                        put(table, record, f"{row}/{table}/{i}", place.table, row, i)
                    if len(starts) > batch:
                        yield take()
        if len(starts) > 1:
            yield take()

    return run


class FlatTables:
    """The flat tables of records(record_id, payload), payload being JSON.

    Each table has record_id, row_id, parent_tbl and parent_row (the row that directly holds
    it; null for the table ``record``), n (place among the siblings of one name, in a list of
    scalars the place in the list) and its own columns as text.  A payload that is not one
    complete JSON text, or is no object, gives no rows.  A record received again with the same
    payload counts once, with another payload separately.  Null and empty arrays or objects that
    are absent give no rows.  Of names repeated within an object the last counts.

    ``only`` (table -> columns, None for all of them) restricts what is written to these tables
    and columns; the schema graph and the row ids are always those of whole records.
    """

    def __init__(self, records: DataFrame, *, opaque: tuple[str, ...] = ("value",), repeatable: tuple[str, ...] = (), only: Mapping[str, Sequence[str] | None] | None = None):
        rows = pick(records, "record_id", "payload").where("payload IS NOT NULL")
        # The hash of the payload tells two versions of a record apart.  Equal rows are dropped by (id, hash, text).
        rows = rows.distinct().withColumn("doc", F.concat_ws(":", F.coalesce(F.col("record_id").cast("string"), F.lit("?")), F.left(F.md5(F.col("payload").cast("binary")), F.lit(16))))
        rows = stored(rows, "records")
        self.graph = schema_graph(rows, opaque=opaque, repeatable=repeatable)
        self.columns, self.only = self.graph.layout(), None
        if only is not None:
            self.only = {self.name(e): None if cs is None else [self.column(e, c) for c in cs] for e, cs in only.items()}
        shred = _shred(self.graph, frozenset(opaque), self.only)
        self.rows = stored(rows.select("record_id", "doc", "payload").mapInArrow(shred, ROWS), "rows", "tbl")

    def name(self, element: str) -> str:
        """Name of the table of an element that has one ('record' for the top); of one that does not occur, its own name."""
        return self.graph.tables.get((self._of(element),), element)

    def _of(self, element: str) -> str:
        return TOP if element == ROOT and (_element(ROOT),) not in self.graph.tables else _element(element)

    def column(self, element: str, attribute: str) -> str:
        """Name of an attribute's column."""
        return self.graph.columns.get((self._of(element), attribute), ("", attribute))[1]

    def table(self, name: str, *columns: str) -> DataFrame:
        """One flat table; a table or named column that never occurs is empty or null."""
        if self.only is not None and (name not in self.only or self.only[name] is not None and not set(columns) <= set(self.only[name])):
            raise ValueError(f"table {name} was not asked for with these columns")
        rows = self.rows.where(F.col("tbl") == name)
        wanted = columns or tuple(self.columns.get(name, ()) if self.only is None or self.only[name] is None else self.only[name])
        return rows.select(*KEYS, *(F.col("vals").getItem(c).alias(c) for c in wanted))

    def element(self, element: str, *attributes: str) -> DataFrame:
        """The table of an element, its attributes by their names in the records."""
        columns = [self.column(element, a) for a in attributes]
        found = self.table(self.name(element), *columns)
        return found.select(*KEYS, *(F.col(c).alias(a) for c, a in zip(columns, attributes)))


#: Elements of nested graphs that always get a table.
GRAPH = ("graph", "node", "edge", "data", "port", "key")
#: What ``graph_elements`` reads.
LINKS = {"node": ("id",), "edge": ("id",), "graph": (), "data": ("key",)}


def graph_tables(records: DataFrame, *, only: Mapping[str, Sequence[str] | None] | None = None) -> FlatTables:
    """The flat tables of records that hold graphs."""
    return FlatTables(records, repeatable=GRAPH, only=only)


def graph_elements(flat: FlatTables) -> DataFrame:
    """(record_id, elem_id, parent_id, key) of the nodes and edges of nested graphs, from ``graph_tables``.

    One distinct row for each node or edge and each key among its data entries, '' without a
    key.  parent_id is the node whose graph directly holds the element, '' for the outermost.
    An element without id (or with null as id) has '' as its id.
    """
    nodes, edges, graphs, data = (flat.element(t, *c) for t, c in LINKS.items())
    table = {e: flat.name(e) for e in LINKS}
    elements = nodes.withColumn("t", F.lit(table["node"])).unionByName(edges.withColumn("t", F.lit(table["edge"])))
    # The graphs get their node's id before the elements come in, which are many more and so are shuffled once less.
    holder = graphs.select(F.col("row_id").alias("parent_row"), F.when(F.col("parent_tbl") == table["node"], F.col("parent_row")).alias("node_row"))
    parent = nodes.select(F.col("row_id").alias("node_row"), F.col("id").alias("parent_id"))
    holder = holder.join(parent, "node_row", "left").select("parent_row", "parent_id")
    keys = data.where("key IS NOT NULL").select(F.col("parent_tbl").alias("t"), F.col("parent_row").alias("row_id"), "key")
    found = elements.where(F.col("parent_tbl") == table["graph"]).join(holder, "parent_row").join(keys, ["t", "row_id"], "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.select("record_id", F.coalesce("id", F.lit("")).alias("elem_id"), text("parent_id"), text("key")).distinct()
