"""The queries of the subpackage beside their SQL, and what is checked in place of SQL."""

from __future__ import annotations

import subprocess
import sys

import pytest

from loamgraph.llm.packing import CAPACITY
from loamgraph.llm.queries import ORACLES, QUERIES
from tests.parity import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, name):
    assert compare(spark, small, name) == ""


def near_has_all_found(spark, small):
    near = {(r.item_id, r.doc_id): r for r in QUERIES["p7_near"](spark, small).collect()}
    assert {tuple(r) for r in QUERIES["p7_found"](spark, small).collect()} == {k for k, r in near.items() if r.verbatim} and all(0.8 <= r.similarity + 1e-9 <= 1 + 2e-9 for r in near.values())


def filling_is_that_of_the_containers(spark, small):
    placed = QUERIES["p6_containers"](spark, small).collect()
    got = QUERIES["p6_filling"](spark, small).collect()
    assert sum(r.items * r.containers for r in got) == len(placed) and sum(r.tokens for r in got) == sum(r.tokens for r in placed)
    assert sum(r.containers for r in got) == len({r.container for r in placed}) and sum(r.tokens for r in got) > 0.9 * CAPACITY * sum(r.containers for r in got)


def every_document_has_a_level_or_a_reason(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    levels = QUERIES["p8_levels"](spark, small).collect()
    assert len(levels) == n and all((r.band is None) != (r.reason is None) for r in levels)
    assert {r.doc_id for r in QUERIES["p8_found"](spark, small).collect()} == {r.doc_id for r in levels if r.band is not None and r.p_top >= 0.5}
    assert sum(r.documents for r in QUERIES["p8_profile"](spark, small).collect()) == n


#: Checks of the queries without SQL; the operators themselves are held against brute force and held-out labels in the other modules.
NAMED = {"p6_containers": filling_is_that_of_the_containers, "p6_filling": filling_is_that_of_the_containers, "p7_near": near_has_all_found, **dict.fromkeys(("p8_found", "p8_levels", "p8_profile"), every_document_has_a_level_or_a_reason)}


@pytest.mark.parametrize("check", sorted(set(NAMED.values()), key=lambda f: f.__name__))
def test_named(spark, small, check):
    check(spark, small)


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLES) | set(NAMED) and not set(ORACLES) & set(NAMED)


def test_what_the_subpackage_needs_must_be_there():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; e.queries()"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert got.returncode and "xxhash" in got.stderr
