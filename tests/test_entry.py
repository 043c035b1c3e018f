"""Every query beside its SQL on the smallest tables; the rest stays whole without the text subpackage."""

from __future__ import annotations

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.parity import compare

CORE = [n for n in entry.queries() if not n.startswith(("p6_", "p7_", "p8_"))]


def error_rates(spark, small):
    """The counts are those of the query with SQL, a longer fingerprint is never worse, and the longest has no wrong answer."""
    got = {r.bits: r for r in entry.queries()["p2_error_rates"](spark, small).collect()}
    want = {r.bits: r for r in entry.queries()["p2_derived_rates"](spark, small).collect()}
    assert got.keys() == want.keys() and all((got[b].records, got[b].new_records) == (want[b].records, want[b].new_records) for b in got)
    assert [got[b].wrong for b in sorted(got)] == sorted((r.wrong for r in got.values()), reverse=True) and got[max(got)].wrong == 0
    assert all(r.measured_rate == r.wrong / r.records and r.wrong <= 5 + 5 * r.derived_rate * r.records for r in got.values())


#: What a query without SQL is held against.
NAMED = {"p2_error_rates": error_rates}


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, name):
    if name in NAMED:
        NAMED[name](spark, small)
    else:
        assert compare(spark, small, name) == ""


def test_every_query_is_held_against_something():
    assert set(CORE) == (set(entry.oracle_sql()) & set(CORE)) | set(NAMED)


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "v"]


def test_core_without_the_subpackage():
    code = "import sys; sys.modules['loamgraph.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert 'p1_found' in n and 'p7_found' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
