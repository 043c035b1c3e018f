"""Has this key been seen before?

Keys are hashed to fingerprints; their upper bits name a shard, the rest goes into that
shard's quotient filter.  A batch of records is first reduced to (fingerprint, lowest
seq) by map-side combining, so a key with a third of all records is one row per task.
Each shard then looks its fingerprints up in its filter, names the records that are
first of their fingerprint, and merges the batch's filter into its own.  All other
records have been seen.  Shards hold equally many fingerprints whatever the keys are,
since they divide the hash space.  The earlier keys themselves are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import quotient
from loamgraph.session import pick, stored

#: Fingerprints a shard is meant for; the shards' number follows from the number of keys, earlier ones included.
SHARD = 1 << 17
#: Bits of a fingerprint.  Of n keys about n * n / 2**63 meet one that is not theirs: 10**8 keys give a thousandth of one wrong answer.
BITS = 62


def fingerprint(key: Column, bits: int) -> Column:
    """The upper ``bits`` bits (below 64) of a 64-bit hash, as a non-negative BIGINT."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def shard_bits(capacity: int) -> int:
    """Upper bits of a fingerprint that name its shard, for so many keys."""
    return max(4, int(np.ceil(np.log2(max(1, capacity) / SHARD))))


class SeenFilter:
    """Quotient filters by shard, stored as a table (shard, blob).

    ``bits`` is the fingerprint's length, which sets the error rate; ``capacity`` is the
    number of keys expected, which only sets the number of shards.
    """

    def __init__(self, state: DataFrame, bits: int, shard_bits: int):
        self.state, self.bits, self.shard_bits = state, bits, shard_bits

    @classmethod
    def create(cls, keys: DataFrame, key: str, *, bits: int, capacity: int) -> SeenFilter:
        """Filter of all non-null keys of a table."""
        shards = shard_bits(capacity)
        if not shards < bits < 64:
            raise ValueError("bits must be below 64 and above the shards' bits")
        inner, rest = bits - shards, (1 << (bits - shards)) - 1

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            fp = np.unique(pdf["fp"].to_numpy(np.int64)).astype(np.uint64) & np.uint64(rest)
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "blob": [quotient.build(fp, inner)]})

        fps = pick(keys, key).where(F.col(key).isNotNull()).select(fingerprint(F.col(key), bits).alias("fp")).distinct()
        state = fps.select(F.shiftright("fp", inner).alias("shard"), "fp").groupBy("shard").applyInPandas(pack, "shard bigint, blob binary")
        return cls(stored(state, "filter"), bits, shards)

    def absorb(self, batch: DataFrame, key: str, seq: str) -> tuple[DataFrame, SeenFilter]:
        """(the seqs of the records that are first of their fingerprint, the filter with the batch in it)."""
        inner, bits = self.bits - self.shard_bits, self.bits
        rest = (1 << inner) - 1

        def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            old = right["blob"].iloc[0] if len(right) else None
            if not len(left):
                return pd.DataFrame({"kind": ["filter"], "shard": right["shard"].iloc[:1], "seq": [None], "blob": [old]})
            fp = left["fp"].to_numpy(np.int64).astype(np.uint64) & np.uint64(rest)
            fresh = ~quotient.contains(old, fp) if old is not None else np.ones(len(fp), bool)
            own = quotient.build(np.sort(fp), inner)
            new = left["seq"].to_numpy(np.int64)[fresh]
            out = pd.DataFrame({"kind": "first", "shard": left["shard"].iloc[0], "seq": new, "blob": None})
            state = pd.DataFrame({"kind": ["filter"], "shard": left["shard"].iloc[:1].to_numpy(), "seq": [None], "blob": [quotient.merge(old, own) if old is not None else own]})
            return pd.concat([out.astype({"seq": "Int64"}), state.astype({"seq": "Int64"})])

        fps = pick(batch, key, seq).select(fingerprint(F.col(key), bits).alias("fp"), F.col(seq).alias("seq"))
        firsts = fps.groupBy("fp").agg(F.min("seq").alias("seq")).select(F.shiftright("fp", inner).alias("shard"), "fp", "seq")
        both = firsts.groupBy("shard").cogroup(self.state.groupBy("shard")).applyInPandas(step, "kind string, shard bigint, seq bigint, blob binary")
        both = stored(both, "batch", "kind")
        return both.where("kind = 'first'").select("seq"), SeenFilter(both.where("kind = 'filter'").select("shard", "blob"), bits, self.shard_bits)

    def size(self) -> DataFrame:
        """One row: fingerprints held and bytes used."""

        def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pd.DataFrame({"entries": [sum(map(quotient.entries, pdf["blob"]))], "bytes": [sum(map(len, pdf["blob"]))]})

        return self.state.select("blob").mapInPandas(count, "entries bigint, bytes bigint").agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def _records(entries: DataFrame) -> DataFrame:
    return pick(entries, "seq", "key").where("seq IS NOT NULL AND key IS NOT NULL")


def first_by_filter(entries: DataFrame, base_keys: DataFrame, *, bits: int = BITS, batches: int = 4) -> DataFrame:
    """(seq) of the records whose fingerprint occurs neither in base_keys nor in a record of lower seq.

    The records are absorbed in ``batches`` slices of the range of seq, one after the other,
    as they would arrive.  No record whose key is new *and* whose fingerprint is new is missing.
    """
    records = _records(entries)
    r = records.agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if not r.n:
        return records.select("seq")
    earlier = pick(base_keys, "key").where("key IS NOT NULL").count()
    seen = SeenFilter.create(base_keys, "key", bits=bits, capacity=r.n + earlier)
    edges = [r.lo + (r.hi + 1 - r.lo) * i // batches for i in range(batches + 1)]
    firsts = None
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            first, seen = seen.absorb(records.where(F.col("seq").between(lo, hi - 1)), "key", "seq")
            firsts = first if firsts is None else firsts.unionByName(first)
    return firsts


def _exact_firsts(records: DataFrame, base: DataFrame) -> DataFrame:
    return records.groupBy("key").agg(F.min("seq").alias("seq")).join(base, "key", "left_anti").select("seq")


def seen_before(entries: DataFrame, base_keys: DataFrame, *, bits: int = BITS, batches: int = 4, exact: bool = False) -> DataFrame:
    """(seq) of each record whose key was in base_keys or in a record of lower seq.

    Records without seq or key are left out; rows of one seq are one record (of different
    keys under one seq each is looked at, and the record counts as seen unless one is new).
    Any bytes are a key, the empty key too.  The filter's answers are wrong only where two keys
    share a fingerprint (``error_rates``).  ``exact``, possible where the earlier keys are still at
    hand, looks for such keys among the records called seen and what shares their fingerprints,
    and compares these; two keys count as one if 62 and 64 bits of different hashes are the same.
    """
    records = _records(entries)
    firsts = first_by_filter(entries, base_keys, bits=bits, batches=batches)
    known = records.select("seq").distinct().join(firsts, "seq", "left_anti")
    if not exact:
        return known
    base = pick(base_keys, "key").where("key IS NOT NULL")
    fp, other = fingerprint(F.col("key"), bits).alias("fp"), F.xxhash64(F.lit(1), "key").alias("other")
    asked = records.join(known, "seq", "left_semi").select(fp).distinct()
    hashes = records.select(fp, other).unionByName(base.select(fp, other)).join(asked, "fp", "left_semi")
    shared = stored(hashes.groupBy("fp").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("fp"), "shared")
    mixed = records.withColumn("fp", fp).join(shared, "fp", "left_semi").drop("fp")
    return known.join(_exact_firsts(mixed, base), "seq", "left_anti")


def derived_rates(entries: DataFrame, base_keys: DataFrame, *, widths: tuple[int, ...] = (24, 28, BITS)) -> DataFrame:
    """(bits, records, new_records, base, derived_rate) for each fingerprint length.

    The derived rate is the share of records expected to be called seen although they are new: the
    mean over the new records of the chance to meet one of the keys stored before.
    """
    records = _records(entries)
    base = pick(base_keys, "key").where("key IS NOT NULL").distinct()
    new = _exact_firsts(records, base)
    n = (
        new.agg(F.count("*").alias("new_records"))
        .crossJoin(base.agg(F.count("*").alias("base")))  # one row each
        .crossJoin(records.select("seq").distinct().agg(F.count("*").alias("records")))
    )
    n = stored(n, "counts")
    rows = None
    for bits in widths:
        # mean over i = 0 .. m-1 of 1 - (1 - 2^-bits)^(base + i), in closed form; for long fingerprints (base + (m - 1) / 2) / 2^bits, which the closed form cannot tell from 0
        p, m, b = 2.0**-bits, F.greatest(F.col("new_records"), F.lit(1)), F.col("base")
        log1p = float(np.log1p(-p))
        closed = 1 + F.exp(b * log1p) * F.expm1(m * log1p) / (m * p)
        mean = F.when((b + m) * p < 1e-6, (b + (m - 1) / 2) * p).otherwise(closed)
        one = n.select(F.lit(bits).alias("bits"), "records", "new_records", "base", (mean * F.col("new_records") / F.greatest(F.col("records"), F.lit(1))).alias("derived_rate"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def error_rates(entries: DataFrame, base_keys: DataFrame, *, widths: tuple[int, ...] = (24, 28, BITS)) -> DataFrame:
    """(bits, records, new_records, wrong, measured_rate, derived_rate): for each fingerprint length the new records that the filter calls seen.

    A filter never calls a seen record new, so these are all wrong answers.
    """
    new = stored(_exact_firsts(_records(entries), pick(base_keys, "key").where("key IS NOT NULL")), "new")
    wrong = None
    for bits in widths:
        one = new.join(first_by_filter(entries, base_keys, bits=bits, batches=1), "seq", "left_anti").agg(F.lit(bits).alias("bits"), F.count("*").alias("wrong"))
        wrong = one if wrong is None else wrong.unionByName(one)
    rates = derived_rates(entries, base_keys, widths=widths).join(F.broadcast(wrong), "bits")  # one row per width
    return rates.select("bits", "records", "new_records", "wrong", (F.col("wrong") / F.greatest(F.col("records"), F.lit(1))).alias("measured_rate"), "derived_rate")
