"""Packing: nothing lost, nothing cut that fits, little space lost."""

from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm import packing as P


def brute_fill(sizes, capacity, most):
    """The same rule with a plain list of open containers."""
    open_, where, fresh = [], [], 0
    for s in sizes:
        fits = [b for b in open_ if b[0] >= s]
        if fits:
            least = min(b[0] for b in fits)
            bin_ = [b for b in fits if b[0] == least][-1]
            open_.remove(bin_)
        else:
            if len(open_) == most:
                least = min(b[0] for b in open_)
                open_.remove([b for b in open_ if b[0] == least][-1])
            bin_, fresh = [capacity, fresh], fresh + 1
        bin_[0] -= s
        open_.append(bin_)
        where.append(bin_[1])
    return where


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120), st.integers(1, 6))
def test_best_fit_with_bounded_space(sizes, most):
    where, offset, still = P.fill(np.array(sizes, np.int64), 20, most)
    assert where.tolist() == brute_fill(sizes, 20, most)
    assert len(still) <= most
    load = {}
    for s, w, o in zip(sizes, where.tolist(), offset.tolist()):
        assert o == load.get(w, 0)
        load[w] = o + s
    assert all(v <= 20 for v in load.values())


def check(rows, sizes, capacity):
    load, got = {}, {}
    for r in rows:
        load.setdefault(r.container, []).append((r.start, r.tokens))
        got.setdefault(r.doc_id, []).append(r.tokens)
    for parts in load.values():
        end = 0
        for start, tokens in sorted(parts):
            assert start == end
            end += tokens
        assert end <= capacity
    for doc, n in sizes:
        if n:
            assert sum(got[doc]) == n and len(got[doc]) == max(1, math.ceil(n / capacity))
    return sum(n for _, n in sizes) / (len(load) * capacity)


def test_whole_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [tuple(r) for r in P.token_counts(docs).collect()]
    assert check(P.pack(docs).collect(), sizes, P.CAPACITY) > 0.9
    again = P.pack(docs.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, P.pack(docs).collect()))


def test_violations_are_seen(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 10), (3, 12), (None, 4), (4, 0)], "doc_id bigint, tokens bigint")
    good = [(1, 0, "a", 0, 5), (2, 0, "b", 0, 10), (3, 0, "c", 0, 10), (3, 1, "a", 5, 2), (None, 0, "d", 0, 4)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, piece bigint, container string, start bigint, tokens bigint")
    names = ("lost", "added", "cut", "overfull", "overlap", "gap")
    broken = {"lost": good[1:], "added": [*good, (9, 0, "e", 0, 1)], "cut": [(1, 0, "a", 0, 3), (1, 1, "e", 0, 2), *good[1:3], (3, 1, "a", 3, 2), good[4]], "overfull": [*good[:4], (None, 0, "b", 10, 4)], "overlap": [*good[:3], (3, 1, "a", 4, 2), good[4]], "gap": [*good[:4], (None, 0, "d", 1, 4)]}
    assert all(P.violations(table(good), sizes, capacity=10).first()[n] == 0 for n in names)
    for name, rows in broken.items():
        assert P.violations(table(rows), sizes, capacity=10).first()[name] > 0
    assert tuple(P.violations(table([]), sizes.limit(0)).first()) == (0,) * 9


def test_many_groups_lose_little(spark):
    rng = np.random.default_rng(3)
    sizes = [(int(i), int(n)) for i, n in enumerate(rng.integers(0, 900, 6000))]
    items = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").where("tokens > 0").selectExpr("doc_id", "tokens", "pmod(doc_id, 30) AS g")
    assert check(P._pack(items, 4096, 16, 30, 64).collect(), sizes, 4096) > 0.985


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "word " * 5000), (None, "a b c"), (4, "same"), (4, "same")], "doc_id bigint, text string")
    rows = P.pack(docs).collect()
    assert sorted((r.doc_id or 0, r.piece, r.tokens) for r in rows)[:1][0][0] == 0
    assert [r.tokens for r in rows if r.doc_id == 3 and r.piece == 0] == [4096]
    assert len([r for r in rows if r.doc_id == 4]) == 2
    assert P.pack(docs.limit(0)).count() == 0


def test_groups_are_bounded_whatever_the_ids(spark, monkeypatch):
    docs = spark.range(9000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id)) AS doc_id", "repeat('a b ', cast(1 + id % 2 AS int)) AS text")
    seen = []
    pack = P._pack
    monkeypatch.setattr(P, "_pack", lambda items, *a: seen.append(items.groupBy("g").count().toPandas()) or pack(items, *a))
    monkeypatch.setattr(P, "COPIES", 64)
    rows = P.pack(docs, group=300).collect()
    want = sorted(((r.doc_id, r.tokens) for r in P.token_counts(docs).collect()), key=str)
    assert sorted(((r.doc_id, r.tokens) for r in rows), key=str) == want
    assert seen[0]["count"].sum() == 9000 and seen[0]["count"].max() < 2 * 300


def test_tokenizers_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = P.token_counts(docs).collect()
    b = P.token_counts(docs, path=P.tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
