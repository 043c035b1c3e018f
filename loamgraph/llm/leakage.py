"""Passages of evaluation items inside documents.

Texts are compared in windows of as many words as a passage must have.  A window's
fingerprint is a 64-bit SimHash of its shingles.  The windows of the items form a
multi-index: the fingerprint is split into radius + 1 blocks, and two fingerprints
within the radius agree in at least one block, so looking up each block finds them all.
Candidates are verified by the weighted similarity of their shingles: equal windows have
distance 0 and similarity 1, so no verbatim passage is missed, and a passage counts as
verbatim if the words of such a pair are the same too.

Windows that are alike but not equal have fingerprints too far apart for that.  They are
found by shared shingles: whatever is similar to a window shares one of its heaviest shingles
that together weigh more than the part that may differ, and pairs that share one are
verified in the same way.

Documents are read once and never shuffled; what leaves a task are pairs found.  The items'
index is sent to the tasks in blocks of a bounded number of windows, one pass each; if there
are several, the documents' words are stored once for all passes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import pick, stored

WINDOW, SHINGLE, RADIUS = 13, 5, 2
#: Parameters that find passages of 20 words with one to three of them replaced, added or dropped.  Five-word shingles at a similarity of 0.8 cannot: a changed word takes five shingles.
EDITED = {"window": 16, "shingle": 2, "least": 0.45}
#: Windows of items in one block of the index, each of about 100 bytes.
BLOCK = 400_000
#: What rounding may take from a similarity, and pairs of windows compared at once.
EPS, PAIRS = 1e-9, 20_000
_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)}
_KEEP = {"L", "N"}


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKC, without format characters, in lower case."""
    if not text:
        return []
    if text.isascii():
        return text.translate(_ASCII).split()
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        odd = {c for c in set(text) if unicodedata.category(c) == "Cf"}
        if odd:
            text = text.translate({ord(c): None for c in odd})
        text = text.lower()
        # \w also takes marks that are neither letters nor digits in Unicode's sense.
        for c in {c for c in set(text) if ord(c) > 127 and not (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")}:
            text = text.replace(c, " ")
        return _WORD.findall(text)
    return text.translate(_ASCII).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(word_hash: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, the order of the words included."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mix(h + word_hash[i : i + n])
    return h


def simhash(shingle: np.ndarray, per: int) -> np.ndarray:
    """For each ``per`` consecutive shingles: a bit is set if it is set in more than half of them.

    The counts of all 64 bits are kept in bit slices: plane j holds bit j of each count,
    so one machine word adds 64 counters at once.
    """
    n = len(shingle) - per + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    planes = [np.zeros(n, np.uint64) for _ in range(per.bit_length())]
    for i in range(per):
        carry = shingle[i : i + n]
        for j, p in enumerate(planes):
            planes[j], carry = p ^ carry, p & carry
            if (1 << (j + 1)) > i + 1:
                break
    more, equal = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    half = per // 2
    for j in reversed(range(len(planes))):
        if half >> j & 1:
            equal &= planes[j]
        else:
            more |= equal & planes[j]
            equal &= ~planes[j]
    return more


class ItemIndex:
    """Multi-index over the windows of some items."""

    def __init__(self, items: list[tuple[int, str | list[str]]], window: int, shingle: int, radius: int, df: dict[int, int] | None = None, n_items: int | None = None):
        """Items are texts or their words.  ``df`` and ``n_items`` are those of all items if these are only some: shingles that several items have, and the number of items."""
        self.window, self.k, self.radius = window, shingle, radius
        self.per = window - shingle + 1
        words = [(i, words_of(t) if isinstance(t, str) else t) for i, t in items]
        self.number = {w: n for n, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        # A word that no item has is one and the same unknown word.
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in sorted(self.number)] + [xxhash.xxh64_intdigest("\x00")], np.uint64)
        runs, owners, prints, parts = [], [], [], []
        self.df: dict[int, int] = {}
        for i, ws in words:
            ids = np.array([self.number[w] for w in ws], np.int32)
            sh = shingles(self.hashes[ids], shingle)
            for h in np.unique(sh).tolist():
                self.df[h] = self.df.get(h, 0) + 1
            if len(ids) >= window:
                runs.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                parts.append(np.lib.stride_tricks.sliding_window_view(sh, self.per))
                prints.append(simhash(sh, self.per))
                owners.append(np.full(len(prints[-1]), i, np.int64))
        if df is not None:
            self.df = df
        self.n_items = len(items) if n_items is None else n_items
        empty = not runs
        self.runs = np.zeros((0, window), np.int32) if empty else np.concatenate(runs)
        self.parts = np.zeros((0, self.per), np.uint64) if empty else np.concatenate(parts)
        self.prints = np.zeros(0, np.uint64) if empty else np.concatenate(prints)
        self.owners = np.zeros(0, np.int64) if empty else np.concatenate(owners)
        cuts = [64 * b // (radius + 1) for b in range(radius + 2)]
        self.blocks = []
        for lo, hi in zip(cuts, cuts[1:]):
            mask = np.uint64((1 << (hi - lo)) - 1)
            value = (self.prints >> np.uint64(lo)) & mask
            order = np.argsort(value, kind="stable")
            # The low bits of the block tell quickly that no window has this value.
            low = np.uint64((1 << min(hi - lo, 22)) - 1)
            there = np.zeros(int(low) + 1, bool)
            there[(value & low).astype(np.int64)] = True
            self.blocks.append((np.uint64(lo), mask, low, there, order, value[order]))
        self.heavy: dict[float, tuple[np.ndarray, ...]] = {}

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in prints, window of an item) within the radius, each once."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for b, (lo, mask, low, there, order, values) in enumerate(self.blocks):
            v = (prints >> lo) & mask
            at = np.flatnonzero(there[(v & low).astype(np.int64)])
            first, last = np.searchsorted(values, v[at], "left"), np.searchsorted(values, v[at], "right")
            some = last > first
            at, first, last = at[some], first[some], last[some]
            while len(at):  # the windows of one value, one after the other: memory stays bounded
                w = order[first]
                close = np.bitwise_count(prints[at] ^ self.prints[w]) <= self.radius
                for lo2, mask2, *_ in self.blocks[:b]:  # found by an earlier block already?
                    close &= ((prints[at] ^ self.prints[w]) >> lo2) & mask2 != 0
                found.append((at[close], w[close]))
                first = first + 1
                go = first < last
                at, first, last = at[go], first[go], last[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([w for _, w in found])

    def weight(self, h: int) -> float:
        """Shingles that many items share weigh less."""
        return float(np.log1p(self.n_items / self.df[h])) if h in self.df else float(np.log1p(self.n_items))

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two windows' shingles (as bags)."""
        if np.array_equal(a, b):
            return 1.0
        x, n = np.unique(a, return_counts=True)
        y, m = np.unique(b, return_counts=True)
        p, q = dict(zip(x.tolist(), n.tolist())), dict(zip(y.tolist(), m.tolist()))
        both = sum(self.weight(h) * min(c, q.get(h, 0)) for h, c in p.items())
        all_ = sum(self.weight(h) * max(p.get(h, 0), q.get(h, 0)) for h in {**p, **q})
        return both / all_ if all_ else 0.0

    def weights(self, h: np.ndarray) -> np.ndarray:
        """The weight of each of many shingles."""
        each, back = np.unique(h, return_inverse=True)
        return np.array([self.weight(x) for x in each.tolist()])[back].reshape(h.shape)

    def _heavy(self, least: float) -> tuple[np.ndarray, ...]:
        """Shingles, sorted, each with a window: those of which a window as similar as ``least`` has at least one.  With them, what tells quickly that a shingle is none of them, and the weights of the windows' shingles."""
        if least not in self.heavy:
            weight = self.weights(self.parts)
            order = np.argsort(-weight, axis=1, kind="stable")
            sorted_ = np.take_along_axis(weight, order, 1)
            # A similar window shares at least the part `least` of the weight.  A shingle is needed as long as those before it do not yet weigh more than the rest.
            before = np.cumsum(sorted_, axis=1) - sorted_
            row, col = np.nonzero(before <= (1 - least + EPS) * weight.sum(axis=1, keepdims=True))
            key = self.parts[row, order[row, col]]
            by = np.argsort(key, kind="stable")
            there = np.zeros(1 << 22, bool)
            there[(key & np.uint64(there.size - 1)).astype(np.int64)] = True
            self.heavy[least] = key[by], row[by], there, weight
        return self.heavy[least]

    def verified(self, x: np.ndarray, w: np.ndarray, least: float) -> Iterator[tuple[int, float]]:
        """(place in the pairs, similarity) of the pairs of windows (shingles x, window w of an item) that are at least as similar as ``least``."""
        y = self.parts[w]
        same = (x == y).all(axis=1)
        yield from ((i, 1.0) for i in np.flatnonzero(same).tolist())
        other = np.flatnonzero(~same)
        for lo in range(0, len(other), PAIRS):
            at = other[lo : lo + PAIRS]
            a, b = x[at], y[at]
            equal = a[:, :, None] == b[:, None, :]
            wx, wy = self.weights(a), self.weights(b)
            # The shared weight is at most this; it is less only where shingles repeat.
            both = np.minimum((wx * equal.any(axis=2)).sum(axis=1), (wy * equal.any(axis=1)).sum(axis=1))
            for i in np.flatnonzero(both >= (least - EPS) * (wx.sum(axis=1) + wy.sum(axis=1) - both)).tolist():
                s = self.similarity(a[i], b[i])
                if s >= least - EPS:
                    yield int(at[i]), s

    def shared(self, sh: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, first, last + 1 in the heavy shingles) of the shingles without which a window of an item is less similar than ``least``."""
        key, _, there, _ = self._heavy(least)
        at = np.flatnonzero(there[(sh & np.uint64(there.size - 1)).astype(np.int64)])
        first, last = np.searchsorted(key, sh[at], "left"), np.searchsorted(key, sh[at], "right")
        some = last > first
        return at[some], first[some], last[some]

    def similar(self, at: np.ndarray, first: np.ndarray, last: np.ndarray, n: int, least: float, done: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place, window of an item) of windows of ``n`` shingles around what is ``shared``, without the items of ``done``."""
        window = self._heavy(least)[1]
        shift = np.arange(self.per)
        step = max(1, PAIRS // self.per)
        while len(at):  # the windows of one shingle, one after the other: memory stays bounded
            for lo in range(0, len(at), step):
                w = window[first[lo : lo + step]]
                a = at[lo : lo + step, None] - shift[None, :]
                w, a = np.repeat(w, self.per), a.ravel()
                keep = (a >= 0) & (a <= n - self.per) & ~np.isin(self.owners[w], done)
                if keep.any():
                    yield a[keep], w[keep]
            first = first + 1
            go = first < last
            at, first, last = at[go], first[go], last[go]

    def scan(self, words: list[str], least: float) -> list[tuple[int, bool, float]]:
        """(item, verbatim, similarity) of the windows of one text that are at least so similar to one of an item: each item once, with its best."""
        if len(words) < self.window or not len(self.prints):
            return []
        get, other = self.number.get, len(self.number)
        ids = np.fromiter((get(w, other) for w in words), np.int32, len(words))
        sh = shingles(self.hashes[ids], self.k)
        runs, view = (np.lib.stride_tricks.sliding_window_view(v, n) for v, n in ((ids, self.window), (sh, self.per)))
        best: dict[int, tuple[bool, float]] = {}

        def take(at: np.ndarray, window: np.ndarray) -> None:
            for i, s in self.verified(view[at], window, least):
                item = int(self.owners[window[i]])
                found = (s >= 1 - EPS and bool((runs[at[i]] == self.runs[window[i]]).all()), s)
                if found > best.get(item, (False, 0.0)):
                    best[item] = found

        at, window = self.near(simhash(sh, self.per))
        if len(at):
            take(at, window)
        if least < 1:
            done = np.array([i for i, (v, _) in best.items() if v], np.int64)
            hits = self.shared(sh, least)
            if len(hits[0]):
                # Words that none of these items has, but others may: their shingles weigh what they weigh among all items.
                own = self.hashes[ids].copy()
                for i in np.flatnonzero(ids == other).tolist():
                    own[i] = xxhash.xxh64_intdigest(words[i])
                sh = shingles(own, self.k)
                view = np.lib.stride_tricks.sliding_window_view(sh, self.per)
                for at, window in self.similar(*hits, len(sh), least, done):
                    take(at, window)
        return [(i, v, s) for i, (v, s) in best.items()]


def _frequencies(pieces: DataFrame, shingle: int) -> dict[int, int]:
    """Number of items of each shingle that several items have; one that a single item has weighs the same as an unknown one."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for item, text in zip(pdf["item_id"], pdf["words"]):
                own = np.array([xxhash.xxh64_intdigest(w) for w in text.split(" ")], np.uint64)
                yield pd.DataFrame({"item_id": item, "h": np.unique(shingles(own, shingle)).view(np.int64)})

    rows = pieces.select("item_id", "words").mapInPandas(run, "item_id bigint, h bigint").distinct().groupBy("h").count().where("count > 1").toPandas()
    return dict(zip(rows["h"].to_numpy(np.int64).view(np.uint64).tolist(), rows["count"].tolist()))


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, piece, words, windows): the items' words, cut into overlapping pieces of at most ``most`` windows, as a stored table."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for item, text in zip(pdf["item_id"].to_list(), pdf["prompt"].to_list()):
                ws = words_of(text)
                n = len(ws) - window + 1
                for piece, a in enumerate(range(0, n, most)):
                    yield pd.DataFrame({"item_id": [item], "piece": [piece], "words": [" ".join(ws[a : min(a + most, n) + window - 1])], "windows": [min(most, n - a)]})

    return stored(items.mapInPandas(run, "item_id bigint, piece bigint, words string, windows bigint").distinct(), "items")


def find_leaks(documents: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, radius: int = RADIUS, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, verbatim, similarity) of items and documents that share a passage.

    documents(doc_id, text), items(item_id, prompt).  Of each item and document it gives the closest
    pair of windows, if their weighted similarity is at least ``least``; no such pair is missed.
    ``verbatim``: ``window`` consecutive words are the same (the similarity is 1; with ``least`` = 1 only
    windows of the same shingles are looked for).  Items of fewer words have no passage; null texts and
    ids give no rows; repeated rows and ids are judged together.  A block of the index never has
    more than ``block`` windows: items are cut into overlapping pieces that fit.
    """
    docs = pick(documents, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    pieces = _pieces(pick(items, "item_id", "prompt").where("item_id IS NOT NULL AND prompt IS NOT NULL").distinct(), window, max(1, block // 4))
    total, n_items = pieces.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.count_distinct("item_id")).first()
    blocks = max(1, math.ceil(int(total) / block))
    part_of = lambda n: F.pmod(F.xxhash64("item_id", "piece"), F.lit(n))
    while (pieces.groupBy(part_of(blocks)).agg(F.sum("windows").alias("n")).agg(F.max("n")).first()[0] or 0) > block:
        blocks *= 2  # until the largest fits
    df = _frequencies(pieces, shingle) if blocks > 1 and least < 1 else None
    if blocks > 1:
        docs = stored(docs.mapInPandas(lambda it: (pd.DataFrame({"doc_id": pdf["doc_id"], "text": [" ".join(words_of(t)) for t in pdf["text"]]}) for pdf in it), "doc_id bigint, text string"), "words")
    split = words_of if blocks == 1 else str.split
    found = None
    for b in range(blocks):
        part = pieces.where(part_of(blocks) == b).orderBy("item_id", "piece").select("item_id", "words").collect()  # at most `block` windows
        index: Any = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r.item_id, r.words.split(" ")) for r in part], window, shingle, radius, df, n_items))

        def run(it: Iterator[pd.DataFrame], index: Any = index) -> Iterator[pd.DataFrame]:
            own = index.value
            for pdf in it:
                rows = [(item, doc, v, s) for doc, text in zip(pdf["doc_id"], pdf["text"]) for item, v, s in own.scan(split(text), least)]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "verbatim", "similarity"])

        got = docs.mapInPandas(run, "item_id bigint, doc_id bigint, verbatim boolean, similarity double")
        found = got if found is None else found.unionByName(got)
    return found.groupBy("item_id", "doc_id").agg(F.max("verbatim").alias("verbatim"), F.max("similarity").alias("similarity"))
