"""Leakage against brute force, and the guarantees of its parts."""

from __future__ import annotations

import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.llm import leakage as L
from loamgraph.llm.queries import QUERIES


def brute_words(text):
    t = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").lower()
    return [w for w in "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else "\n" for c in t).split("\n") if w]


def brute(docs, items, n=13):
    at = {}
    for i, p in items:
        w = brute_words(p or "")
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), set()).add(i)
    found = set()
    for d, t in docs:
        w = brute_words(t or "")
        for k in range(len(w) - n + 1):
            found |= {(i, d) for i in at.get(tuple(w[k : k + n]), ())}
    return found


def test_found_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "prompt").collect()
    got = {tuple(r) for r in QUERIES["p7_found"](spark, small).collect()}
    assert got == brute([tuple(r) for r in docs], [tuple(r) for r in items]) and got


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert L.words_of(text) == brute_words(text)


def test_simhash_is_a_majority():
    rng = np.random.default_rng(1)
    for per in (1, 3, 4, 9, 15):
        x = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        got = L.simhash(x, per)
        for i, g in enumerate(got.tolist()):
            want = sum(1 << b for b in range(64) if sum(int(v) >> b & 1 for v in x[i : i + per]) > per / 2)
            assert g == want


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    index = L.ItemIndex([(k, " ".join(rng.choice(words, 60))) for k in range(20)], 13, 5, 3)
    base = rng.choice(index.prints, 300)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 6, 300)], np.uint64)
    asked = base ^ flips
    got = set(zip(*(x.tolist() for x in index.near(asked))))
    want = {(a, w) for a in range(300) for w in range(len(index.prints)) if int(asked[a] ^ index.prints[w]).bit_count() <= 3}
    assert got == want
    at, w = index.near(asked)
    assert len(set(zip(at.tolist(), w.tolist()))) == len(at)


def test_near_passages_and_edge_cases(spark):
    passage = "the quick brown fox jumps over the lazy dog while nine grey geese watch from the far bank of a slow river"
    changed = passage.replace("river", "stream")
    docs = [(1, f"intro words {passage} and more"), (2, None), (3, ""), (4, passage.upper()), (5, "x " * 50_000 + passage), (6, "short"), (None, passage), (1, "something else"), (7, "ﬁ" + passage[0:0] + changed)]
    items = [(11, passage), (12, passage), (13, "too short"), (14, None), (None, passage), (11, passage)]
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id bigint, text string, DOC_ID string")
    e = spark.createDataFrame(items, "item_id bigint, prompt string")
    got = {(r.item_id, r.doc_id): r for r in L.find_leaks(d, e).collect()}
    assert {k for k, r in got.items() if r.verbatim} == {(i, k) for i in (11, 12) for k in (1, 4, 5, 7)}
    blocks = {(r.item_id, r.doc_id) for r in L.find_leaks(d, e, block=10).where("verbatim").collect()}
    assert blocks == {k for k, r in got.items() if r.verbatim}
    assert L.find_leaks(d.limit(0), e).count() == 0 and L.find_leaks(d, e.limit(0)).count() == 0


def edited(words, k, rng):
    """The words with k of them replaced, added or dropped."""
    words = list(words)
    for at in sorted(rng.choice(len(words), k, replace=False).tolist(), reverse=True):
        kind = rng.integers(3)
        if kind == 2:
            del words[at]
        else:
            words[at : at + 1 - kind] = [f"zz{rng.integers(999)}"]
    return words


def test_planted_edits(spark, small):
    rng = np.random.default_rng(6)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/eval_items.parquet").select("item_id", "prompt").orderBy("item_id").limit(60).collect()]
    texts = [L.words_of(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("text").where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()]
    clean = [t for t in texts if not {i for i, _, _ in L.ItemIndex(items, 13, 5, 2).scan(t, 1.0)}]
    index = L.ItemIndex(items, L.EDITED["window"], L.EDITED["shingle"], 2)
    for k in (1, 2, 3):
        hits = []
        for item, prompt in items:
            words, host = L.words_of(prompt), clean[rng.integers(len(clean))][:150]
            at, cut = rng.integers(len(words) - 19), rng.integers(len(host) + 1)
            text = host[:cut] + edited(words[at : at + 20], k, rng) + host[cut:]
            hits.append(item in {i for i, _, _ in index.scan(text, L.EDITED["least"])})
        assert np.mean(hits) >= 0.85
    others = sum(len(index.scan(t, L.EDITED["least"])) for t in clean)
    assert others <= 0.1 * len(clean)
    d = spark.createDataFrame([(1, " ".join(edited(L.words_of(items[0][1])[:20], 2, rng)))], "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, prompt string")
    assert items[0][0] in {r.item_id for r in L.find_leaks(d, e, **L.EDITED).collect()}


def test_blocks_hold_no_more_than_they_may(spark, monkeypatch):
    sizes = []
    make = L.ItemIndex.__init__
    monkeypatch.setattr(L.ItemIndex, "__init__", lambda self, *a, **kw: make(self, *a, **kw) or sizes.append(len(self.prints)))
    long = ",".join(str(i % 97) + "x" * (i % 5) for i in range(900))  # no blank in it
    items = [(1, long), (2, "\t".join(f"w{i}" for i in range(40))), *((k, " ".join(f"v{k}a{i}" for i in range(20))) for k in range(3, 30))]
    docs = [(1, "start " + long.replace(",", " ")[1500:1700] + " end"), (2, " ".join(f"w{i}" for i in range(20, 40))), (3, "nothing of all this " * 20)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, prompt string")
    for block in (1000, 400):
        sizes.clear()
        assert {(r.item_id, r.doc_id) for r in L.find_leaks(d, e, block=block, least=1.0).where("verbatim").collect()} == {(1, 1), (2, 2)}
        assert max(sizes) <= block and sum(sizes) == 888 + 28 + 27 * 8


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(6)]
    items = [(k, " ".join([*common, *rng.choice([f"w{i}" for i in range(300)], 14), *(common if k % 2 else [])])) for k in range(30)]
    docs = []
    for k, p in items:
        w = p.split()
        docs.append((4 * k, " ".join(["new0", *w[1:13], "new1"])))  # one changed word at an end
        docs.append((4 * k + 1, " ".join([*w[:6], "new2", *w[7:13]])))  # one inside
        docs.append((4 * k + 2, " ".join(["new3", "c9", "new4", *w[2:14], "new5"])))
        docs.append((4 * k + 3, " ".join(["w1 w2", *common * 3, "w3"])))
    whole = L.ItemIndex(items, 13, 5, 2)
    want = {}
    for d, t in docs:
        w = t.split()
        ids = np.array([whole.number.get(x, len(whole.number)) for x in w])
        sh = L.shingles(whole.hashes[ids], 5)
        for a in range(len(w) - 12):
            for u in range(len(whole.parts)):
                s = whole.similarity(sh[a : a + 9], whole.parts[u])
                if s >= 0.8 - 1e-9:
                    at = (int(whole.owners[u]), d)
                    want[at] = max(want.get(at, 0), s)
    assert len(want) > 30
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, prompt string")
    for block in (L.BLOCK, 200):  # the weights are those of all items, also if these come in blocks
        got = {(r.item_id, r.doc_id): r.similarity for r in L.find_leaks(d, e, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
