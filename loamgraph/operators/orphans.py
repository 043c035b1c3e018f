"""References to records that do not exist.

Keys are dictionary-encoded: the distinct keys of parents and references, range
partitioned and sorted, get dense numbers, so that bitmaps over ranges of numbers are
well filled.  References are a bitmap per side, period and range of numbers.  Parents are a
bitmap per range and period of the numbers that begin or end to exist for whole periods;
taken together in the order of the periods these give who exists throughout each of
them.  Bitmaps with few numbers are kept as sorted lists.  A range's references AND NOT its
parents leave the keys that need a look; they are decoded.  A parent may exist for a part
of a period only, so references to decoded keys are compared with the parents' exact lifetimes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.functions.text import filled, to_int
from loamgraph.session import pick, shuffle_parts, stored

#: Before and after every month of a timestamp.
ALWAYS, FOREVER = -(10**6), 10**6
#: Numbers in one range, those of Spark's bitmap functions.
RANGE = 32_768
#: A key is split if it has more than the part 1 / (SPREAD * shuffle partitions) of all references, so there are at most so many such keys.
SPREAD = 4


def month(ts: Column) -> Column:
    """Months since year 0, as INT; null for null."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def first_whole_month(ts: Column) -> Column:
    """The first month that begins at or after ``ts``."""
    return month(ts) + F.when(ts > F.date_trunc("month", ts), 1).otherwise(0)


def dictionary(keys: DataFrame) -> DataFrame:
    """(key, code): numbers from 1, dense and in key order within each range partition, as a stored table."""
    n = shuffle_parts(keys.sparkSession)
    ordered = keys.distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    return stored(ordered.withColumn("code", F.monotonically_increasing_id() + 1), "dictionary")


def squeeze(bits: bytes) -> bytes:
    """A bitmap, or in its place the sorted list of its numbers, of two bytes each, if that is shorter."""
    places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype("<u2").tobytes()
    return places if len(places) < len(bits) else bytes(bits)


def unsqueeze(data: bytes) -> np.ndarray:
    """The bitmap, as bytes."""
    if len(data) == RANGE // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(RANGE, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


@F.pandas_udf(T.BinaryType())
def _squeezed(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(squeeze)


def _bitmaps(coded: DataFrame, *by: str) -> DataFrame:
    """A bitmap for each group and range, squeezed; partial bitmaps are combined before the shuffle."""
    made = coded.groupBy(*by, F.bitmap_bucket_number("code").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
    return made.select(*by, "bucket", _squeezed("bits").alias("bits"))


def _changes(spans: DataFrame) -> DataFrame:
    """(code, period): where a code with spans(code, since, until) begins, or has ceased, to be in one of them."""
    w = Window.partitionBy("code").orderBy("since", "until")  # distinct pairs of months of one key: few
    upto = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select("code", "since", upto.alias("upto"), before.alias("before"), F.lead("since").over(w).alias("next"))
    begins = F.when(F.col("before").isNull() | (F.col("since") > F.col("before") + 1), F.col("since"))
    ends = F.when((F.col("next").isNull() | (F.col("next") > F.col("upto") + 1)) & (F.col("upto") < FOREVER), F.col("upto") + 1)
    return rows.select("code", F.explode(F.array_compact(F.array(begins, ends))).alias("period"))


def _left_over(refs: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """Numbers of one range that are referred to in a period and do not exist throughout it."""
    changes = changes.sort_values("period")
    when, how = changes["period"].to_numpy(), changes["bits"].to_list()
    there, done, out = np.zeros(RANGE // 8, np.uint8), 0, []
    for r in refs.sort_values("period").itertuples(index=False):
        while done < len(when) and when[done] <= r.period:
            there, done = there ^ unsqueeze(how[done]), done + 1
        left = np.flatnonzero(np.unpackbits(unsqueeze(r.bits) & ~there, bitorder="little"))
        # codes begin at 1, and range b holds the codes from (b - 1) * RANGE + 1
        out.append(pd.DataFrame({"side": r.side, "period": r.period, "code": (r.bucket - 1) * RANGE + 1 + left}))
    return pd.concat(out) if out else pd.DataFrame({"side": pd.Series(dtype=str), "period": pd.Series(dtype="int32"), "code": pd.Series(dtype="int64")})


class References:
    """References of both sides of an edge table against the parents' lifetimes.

    edges(id, source, target, ts); lifetimes(id, created_ts, removed_ts): the parent exists
    from created_ts (null: always) until before removed_ts (null: for good); permanent(id):
    exists always.  Rows of one edge id, side, endpoint and ts count once.  A null or blank
    endpoint is no reference.  A reference without ts is met by permanent parents only, and
    belongs to the period null.  Self loops are two references, parallel edges are separate.
    """

    def __init__(self, edges: DataFrame, lifetimes: DataFrame, permanent: DataFrame):
        ends = pick(edges, "id", "source", "target", "ts").select(
            F.col("id").alias("edge_id"), "ts",
            F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("end")) for s in ("source", "target")))).alias("r"),
        )
        refs = ends.select("edge_id", "r.side", "r.end", "ts").where(filled(F.col("end"))).select("edge_id", "side", "ts", to_int(F.col("end")).alias("key"))
        refs = stored(refs, "references")  # the endpoints' text is read once
        #: References whose endpoint is no number at all.
        self.no_key = refs.where("key IS NULL").select("edge_id", "side", "ts")
        self.refs = refs.where("key IS NOT NULL").select("edge_id", "side", "key", "ts", month(F.col("ts")).alias("period"))
        alive = pick(lifetimes, "id", "created_ts", "removed_ts").where("id IS NOT NULL")
        lasting = pick(permanent, "id").where("id IS NOT NULL").select("id", *(F.lit(None).cast("timestamp").alias(c) for c in ("created_ts", "removed_ts")))
        self.lifetimes = alive.unionByName(lasting.withColumn("created_ts", F.col("created_ts").cast(alive.schema["created_ts"].dataType)).withColumn("removed_ts", F.col("removed_ts").cast(alive.schema["removed_ts"].dataType))).distinct()
        self.permanent = pick(permanent, "id").where("id IS NOT NULL").distinct()

    def in_doubt(self) -> DataFrame:
        """(side, period, key) of references that no parent covers for the whole period."""
        wanted = self.wanted
        spans = self.lifetimes.select(
            F.col("id").alias("key"),
            F.coalesce(first_whole_month(F.col("created_ts")), F.lit(ALWAYS)).alias("since"),
            F.coalesce(month(F.col("removed_ts")) - 1, F.lit(FOREVER)).alias("until"),
        ).where("since <= until").distinct()
        codes = dictionary(wanted.select("key").unionByName(spans.select("key")))
        refs = _bitmaps(wanted.where("period IS NOT NULL").join(codes, "key"), "side", "period")
        changes = _bitmaps(_changes(spans.join(codes, "key").select("code", "since", "until")), "period")
        left = refs.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(_left_over, "side string, period int, code bigint")
        dated = left.join(codes, "code").select("side", "period", "key")
        return dated.unionByName(wanted.where("period IS NULL").select("side", "period", "key"))

    @cached_property
    def wanted(self) -> DataFrame:
        """(side, period, key, n): the distinct references and how many rows each has."""
        return stored(self.refs.groupBy("side", "period", "key").agg(F.count("*").alias("n")), "wanted")

    def heavy(self) -> DataFrame:
        """(key, parts): keys with more than their share of all references, at most SPREAD * shuffle partitions of them, and how many parts to cut each into."""
        share = self.wanted.agg(F.sum("n")).first()[0] or 0
        share = max(1, share // (SPREAD * shuffle_parts(self.refs.sparkSession)))
        return self.wanted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).cast("int").alias("parts"))

    def orphans(self) -> DataFrame:
        """(edge_id, side, ts) of references without a parent at their time, each once."""
        doubt = stored(self.in_doubt(), "doubt")
        # A key in doubt may have a third of all references: such keys are spread over as many parts as their share asks for.
        heavy = F.broadcast(stored(self.heavy(), "heavy"))  # at most SPREAD * shuffle partitions rows
        cut = lambda df, key: df.join(heavy.withColumnRenamed("key", key), key, "left")
        parts = F.coalesce("parts", F.lit(1))
        every = lambda df, key: cut(df, key).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        refs = cut(self.refs, "key").withColumn("part", F.pmod(F.xxhash64("edge_id"), parts).cast("int")).drop("parts")
        refs = refs.alias("a").join(every(doubt, "key").alias("d"), F.expr("a.side = d.side AND a.key = d.key AND a.part = d.part AND a.period <=> d.period"), "left_semi")
        spans = every(self.lifetimes.join(doubt.select(F.col("key").alias("id")).distinct(), "id", "left_semi"), "id")
        a, s = refs.alias("a"), spans.alias("s")
        lost = a.join(
            s,
            F.expr("""a.key = s.id AND a.part = s.part AND (s.created_ts IS NULL AND s.removed_ts IS NULL
                      OR a.ts IS NOT NULL AND (s.created_ts IS NULL OR s.created_ts <= a.ts) AND (s.removed_ts IS NULL OR a.ts < s.removed_ts))"""),
            "left_anti",
        )
        return lost.select("edge_id", "side", "ts").unionByName(self.no_key).distinct()

    def by_period(self) -> DataFrame:
        """(side, month, orphans): counts per side and month of ts ('' without ts)."""
        return self.orphans().groupBy("side", F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("")).alias("month")).agg(F.count("*").alias("orphans"))
