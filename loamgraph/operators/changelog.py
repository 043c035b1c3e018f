"""An ordered key/value map as a change log.

A log has the columns k (any orderable type), seq (total order of the writes), op ('ADD' or
'DEL') and v.  Its state is the newest write of each key; a key whose newest write is a DEL is
absent.  A tombstone hides older writes whenever they arrive.  Empty text is a live value,
null is a live value that is null, and only DEL removes.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators import ordered
from loamgraph.session import pick

LOG = ("k", "seq", "op", "v")


def latest(log: DataFrame) -> DataFrame:
    """(k, seq, op, v): the newest write of each key, tombstones included.

    Partial maxima are taken before the shuffle.  Null keys are dropped; of several writes
    with one seq the greatest (op, v) counts; a null seq is the oldest.
    """
    rows = pick(log, *LOG).where("k IS NOT NULL")
    return rows.groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("top")).select("k", "top.seq", "top.op", "top.v")


def snapshot(log: DataFrame) -> DataFrame:
    """(k, v) of the live keys."""
    return latest(log).where("op = 'ADD'").select("k", "v")


def tombstones(log: DataFrame) -> DataFrame:
    """(k, seq) of the keys whose newest write is a removal."""
    return latest(log).where("op = 'DEL'").select("k", "seq")


def get(log: DataFrame, key: Any) -> DataFrame:
    """(k, v) of one key: no row if it is absent.  The key's filter reaches the scan."""
    return snapshot(log.where(F.col("k") == F.lit(key)))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, found, v) for each row of keys(k); repeated keys are answered as often."""
    # The log is reduced to one row per key before it is shuffled, so a key with very many writes does no harm.
    live = snapshot(log).withColumn("found", F.lit(True))
    return pick(keys, "k").join(live, "k", "left").select("k", F.coalesce("found", F.lit(False)).alias("found"), "v")


def in_range(lo: Any = None, hi: Any = None, prefix: Any = None, k: str = "k") -> Column:
    """Keys from ``lo`` (inclusive) to ``hi`` (inclusive) that start with ``prefix``; all parts are optional."""
    c = F.col(k)
    parts = [] if lo is None else [c >= F.lit(lo)]
    parts += [] if hi is None else [c <= F.lit(hi)]
    parts += [] if prefix is None else [F.startswith(c, F.lit(prefix))]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def scan(log: DataFrame, *, lo: Any = None, hi: Any = None, prefix: Any = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """(k, v) of the live keys in the range, in key order (byte order for text and binary)."""
    rows = snapshot(log.where(in_range(lo, hi, prefix))).orderBy(F.desc("k") if reverse else F.asc("k"))
    return rows if limit is None else rows.limit(limit)


def history(log: DataFrame) -> DataFrame:
    """(k, seq, op, v, version): every write, 1 being the newest of its key.  A key with very many writes is ranked in blocks of seq."""
    rows = pick(log, *LOG).where("k IS NOT NULL")
    return ordered.ranked(rows, ["k"], "seq", "version", F.desc("op"), F.desc("v"), descending=True)


def merge_runs(*runs: DataFrame) -> DataFrame:
    """One log of several: the newest write of each key over all runs."""
    return latest(reduce(DataFrame.unionByName, [pick(r, *LOG) for r in runs]))


def compact(log: DataFrame, *, base_level: bool = True) -> DataFrame:
    """The log with one write per key.  Only at the base level, where nothing older remains elsewhere, tombstones go."""
    rows = latest(log)
    return rows.where("op = 'ADD'") if base_level else rows


def run_stats(log: DataFrame, run: str) -> DataFrame:
    """Per run: entries, adds, dels, smallest and largest key, bytes of keys and values."""
    text = {c: F.octet_length(F.col(c).cast("string")) if dict(log.dtypes)[c] != "binary" else F.octet_length(c) for c in ("k", "v")}
    return log.groupBy(run).agg(
        F.count("*").alias("entries"), F.count_if(F.col("op") == "ADD").alias("adds"), F.count_if(F.col("op") == "DEL").alias("dels"),
        F.min("k").alias("smallest"), F.max("k").alias("largest"),
        F.coalesce(F.sum(text["k"]), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(text["v"]), F.lit(0)).alias("value_bytes"),
    )


def overlaps(stats: DataFrame, run: str) -> DataFrame:
    """Pairs of runs whose key ranges meet (both ends inclusive); one row per run is few rows."""
    a = stats.select(F.col(run).alias("left_run"), F.col("smallest").alias("s1"), F.col("largest").alias("l1"))
    b = stats.select(F.col(run).alias("right_run"), F.col("smallest").alias("s2"), F.col("largest").alias("l2"))
    return a.join(b, F.expr("left_run < right_run AND s1 <= l2 AND s2 <= l1")).select("left_run", "right_run")


def needs_compaction(stats: DataFrame, level: str, *, first: int = 4, base_bytes: int = 10 << 20) -> DataFrame:
    """(level, score): runs / ``first`` at level 0, bytes / (base_bytes * 10^(level-1)) above; 1 or more asks for compaction."""
    size = F.sum(F.col("key_bytes") + F.col("value_bytes"))
    each = stats.groupBy(level).agg(F.count("*").alias("runs"), size.alias("bytes"))
    score = F.when(F.col(level) == 0, F.col("runs") / first).otherwise(F.col("bytes") / (F.lit(base_bytes) * F.pow(F.lit(10.0), F.col(level) - 1)))
    return each.withColumn("score", score)
