"""Bloom filters in blocks, built and asked in the JVM.

A key's bits all lie in one block of 32,768 bits, so a filter is a table (bucket, bits) of any
size, spread over the tasks like any other: it is never sent whole to anyone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.session import pick, stored

BLOCK = 32_768


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _place(key: Column, i: int) -> Column:
    """Place of the key's bit number ``i`` in its block."""
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(BLOCK))


class Bloom:
    """A filter of all non-null keys of a column; ten bits a key and seven hashes let about one key in a hundred pass that is not there."""

    def __init__(self, keys: DataFrame, key: str, *, bits_per_key: int = 10, hashes: int = 7):
        rows = pick(keys, key).where(F.col(key).isNotNull())
        self.hashes, self.buckets = hashes, max(1, -(-rows.count() * bits_per_key // BLOCK))
        places = F.explode(F.array(*(_place(F.col(key), i) for i in range(hashes)))).alias("at")
        # Partial blocks are combined before the shuffle; repeated keys add nothing.
        code = (_bucket(F.col(key), self.buckets) * BLOCK + F.col("at") + 1).alias("code")
        codes = rows.select(F.col(key), places).select(code)
        blocks = codes.groupBy((F.bitmap_bucket_number("code") - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        self.blocks = stored(blocks, "bloom")

    def maybe(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be in the filter; no row whose key is in it is missing."""
        named = {c: F.col(c) for c in rows.columns}
        byte = lambda at: F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bits = [F.getbit(byte(at), (at % 8).cast("int")) == 1 for at in (_place(F.col(key), i) for i in range(self.hashes))]
        asked = rows.where(F.col(key).isNotNull()).withColumn("_bucket", _bucket(F.col(key), self.buckets))
        found = asked.join(self.blocks.withColumnsRenamed({"bucket": "_bucket", "bits": "_bits"}), "_bucket")
        return found.where(reduce(lambda a, b: a & b, bits)).select(*named.values())
