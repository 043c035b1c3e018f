"""Filling containers of fixed capacity with whole documents.

Documents are measured in tokens of a public tokenizer.  Only (id, size) is shuffled: the
items are spread by hash over groups of a fixed mean size, and each group is packed by
bounded-space best fit, that is, with a fixed number of open containers kept in a bitset
keyed by free space.  When no open container has room, the fullest is closed and a new one opened.
Containers that are still open when a group ends are handed on as single items to a
second round of the same kind over many groups at once, so the loss at the ends does not add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import pick, stored

CAPACITY = 4096
OPEN = 64
#: Mean number of items in a group of the first round, and of groups that share a second round.
GROUP, FAN_IN = 50_000, 64
#: Rows of one id and size that are made from one array.
COPIES = 4096


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(documents: DataFrame, *, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every document; null and empty texts have 0 tokens.

    ``path``: a ``.json`` file for the library tokenizers, or a ``.tiktoken`` file of ranks.
    It must be readable on every executor.  Special tokens in a text are ordinary text.
    """
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            count = lambda t: len(encoding.encode_to_numpy(t, disallowed_special=())) if t else 0
        else:
            from tokenizers import Tokenizer

            t_ = Tokenizer.from_file(path)
            t_.encode_special_tokens = True
            count = lambda t: len(t_.encode(t, add_special_tokens=False)) if t else 0
        for pdf in it:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [count(t) for t in pdf["text"]]})

    return pick(documents, "doc_id", "text").mapInPandas(run, "doc_id bigint, tokens bigint")


class OpenBins:
    """At most ``most`` open containers, found by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.used = capacity, most, 0
        self.bits = 0  # bit f is set if a container with f free is open
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, size: int, fresh: int) -> tuple[int, int, int | None]:
        """(container, place in it, container closed for it or None) of an item; ``fresh`` names a new one."""
        room = self.bits >> size
        closed = None
        if room:
            free = size + ((room & -room).bit_length() - 1)  # the least free space that is enough
            here = self._take(free)
        else:
            if self.used == self.most:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest
            here, free = fresh, self.capacity
        left = free - size
        self.at[left].append(here)
        self.bits |= 1 << left
        self.used += 1
        return here, self.capacity - free, closed

    def _take(self, free: int) -> int:
        here = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.used -= 1
        return here


def fill(sizes: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, offset) of each item, none larger than the capacity, and the containers still open at the end."""
    bins = OpenBins(capacity, most)
    where, offset, fresh = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        here, at, _ = bins.put(size, fresh)
        fresh += here == fresh
        where[i], offset[i] = here, at
    return where, offset, np.array(sorted(b for row in bins.at for b in row), np.int64)


def pack(documents: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN, group: int = GROUP, fan_in: int = FAN_IN, path: str | None = None) -> DataFrame:
    """(doc_id, piece, container, start, tokens): where each document lies.

    A document larger than the capacity is cut into full containers and a rest; no other is
    cut.  Documents without tokens take no room and have no row.  ``start`` is the place in the
    container.  Rows with one doc_id (or null) are separate items, and are spread over the groups like
    any others.  The outcome depends on the
    ids, the sizes and the parameters alone, so a task that is run again gives the same.
    """
    sizes = stored(token_counts(documents, path=path), "sizes")
    n = sizes.count()
    groups = max(1, math.ceil(n / group))
    # Rows of one id and size are alike, so they are counted and numbered, in two steps to keep the arrays short: no group gets all rows of an id.
    alike = sizes.where("tokens > 0").groupBy("doc_id", "tokens").agg(F.count("*").alias("n"))
    blocks = alike.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("b"))
    copies = blocks.select("doc_id", "tokens", F.explode(F.sequence(F.col("b") * COPIES, F.least(F.col("n"), (F.col("b") + 1) * COPIES) - 1)).alias("k"))
    items = copies.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "tokens", "k", F.lit(7)), F.lit(groups)).alias("g"))
    return _pack(items, capacity, open_bins, groups, fan_in)


def _pack(items: DataFrame, capacity: int, most: int, groups: int, fan_in: int) -> DataFrame:
    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        full, rest = np.divmod(pdf["tokens"].to_numpy(np.int64), capacity)
        part = pdf[rest > 0]
        where, offset, still = fill(rest[rest > 0], capacity, most)
        over = np.repeat(np.arange(len(pdf)), full)
        piece = np.arange(len(over)) - np.repeat(np.cumsum(full) - full, full)
        g = int(pdf["g"].iloc[0])
        used = int(where.max()) + 1 if len(where) else 0
        return pd.DataFrame({
            "doc_id": pd.concat([part["doc_id"], pdf["doc_id"].iloc[over]], ignore_index=True).astype("Int64"),
            "piece": np.concatenate([full[rest > 0], piece]), "g": g, "bin": np.concatenate([where, used + np.arange(len(over))]),
            "start": np.concatenate([offset, np.zeros(len(over), np.int64)]), "tokens": np.concatenate([rest[rest > 0], np.full(len(over), capacity)]),
            "open": np.concatenate([np.isin(where, still), np.zeros(len(over), bool)]),
        })

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "bin"]).reset_index(drop=True)
        where, offset, _ = fill(pdf["load"].to_numpy(np.int64), capacity, most)
        return pd.DataFrame({"g": pdf["g"], "bin": pdf["bin"], "to": where, "shift": offset})

    placed = stored(items.groupBy("g").applyInPandas(first, "doc_id bigint, piece bigint, g bigint, bin bigint, start bigint, tokens bigint, open boolean"), "placed")
    # Few rows: at most `most` for each group.  Each of the second round's groups gets fan_in * most of them.
    loads = placed.where("open").groupBy("g", "bin").agg(F.sum("tokens").alias("load"))
    moved = loads.groupBy(F.floor(F.col("g") / fan_in).alias("gg")).applyInPandas(second, "g bigint, bin bigint, to bigint, shift bigint")
    joined = placed.join(moved, ["g", "bin"], "left")
    name = F.when(F.col("to").isNull(), F.concat_ws("-", F.lit("a"), "g", "bin")).otherwise(F.concat_ws("-", F.lit("b"), F.floor(F.col("g") / fan_in), "to"))
    return joined.select("doc_id", "piece", name.alias("container"), (F.col("start") + F.coalesce("shift", F.lit(0))).alias("start"), "tokens")


def violations(placed: DataFrame, sizes: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row of counts: documents with tokens and those placed, both without repeats; pieces; and what must be 0.

    ``sizes`` is (doc_id, tokens) of the documents.  Wrong are: ``lost`` or ``added`` tokens of a document, containers that are
    ``overfull``, pieces that ``overlap`` or leave a ``gap`` in their container, and ``cut`` documents that would have fitted.
    """
    need = sizes.where("tokens > 0").groupBy("doc_id").agg(F.sum("tokens").alias("need"), F.max("tokens").alias("largest"))
    have = placed.groupBy("doc_id").agg(F.sum("tokens").alias("have"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    each = need.join(have, need["doc_id"].eqNullSafe(have["doc_id"]), "full")
    short, over = F.coalesce("need", F.lit(0)) > F.coalesce("have", F.lit(0)), F.coalesce("need", F.lit(0)) < F.coalesce("have", F.lit(0))
    docs = each.agg(F.count("need").alias("documents"), F.count("have").alias("placed"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.count_if(short).alias("lost"), F.count_if(over).alias("added"), F.count_if((F.col("last") > 0) & (F.col("largest") <= capacity)).alias("cut"))
    # Pieces of one container lie end to end exactly if, in their order, each begins where the one before ends; containers are small.
    w = Window.partitionBy("container").orderBy("start")
    ends = placed.select("container", "start", "tokens", F.coalesce(F.lag(F.col("start") + F.col("tokens")).over(w), F.lit(0)).alias("before"))
    boxes = ends.groupBy("container").agg(F.sum("tokens").alias("n"), F.count_if(F.col("start") < F.col("before")).alias("o"), F.count_if(F.col("start") > F.col("before")).alias("g"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return docs.crossJoin(boxes.agg(F.count_if(F.col("n") > capacity).alias("overfull"), zero("o").alias("overlap"), zero("g").alias("gap")))  # one row each


def filling(placed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """(items, tokens, fill, containers): how many containers hold so many items, and how full they are."""
    each = placed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return each.groupBy("items").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
