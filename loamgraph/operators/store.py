"""A store on disk: immutable Parquet files in levels and a manifest that names the live ones.

A batch of writes becomes one entry of level 0; reads take the newest write of each key over all
levels.  Deeper levels hold files that are range partitioned and sorted by key, so the
files of one level do not overlap.  The manifest keeps level, key range, number of entries and bytes
of each, so a get or a scan reads only files whose range can matter; row-group statistics and a
Bloom filter on the key skip most of those.  ``compact_step`` merges the level that needs it most with
what overlaps it one level below, and ``compact`` everything.

A manifest is a small new file per version; the highest version counts, so readers see a change
completely or not at all.  Names of data are never used twice: what a failed write left behind
is not named by any manifest, is no hindrance to the next, and goes with ``vacuum``.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import changelog
from loamgraph.session import empty, pick, shuffle_parts

SCHEMA = "k binary, seq bigint, op string, v binary"
#: Switches of the storage: Bloom filter on the key, compression, rows per file (0: no limit), bytes up to which the files are kept in memory (0: never),
#: entries of level 0 and bytes of level 1 that ask for a compaction (each level below may have ten times as many), bytes a compaction's file should have.
OPTIONS = {"bloom": True, "compression": "snappy", "max_records": 0, "cache_bytes": 0, "first": 4, "base_bytes": 64 << 20, "file_bytes": 256 << 20}
TENFOLD = 10
#: Bytes below which it is not worth while to write one more file.
SMALL = 8 << 20

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Run:
    """One entry of the manifest: a folder (level 0) or a file; keys in hexadecimal."""

    name: str
    level: int
    smallest: str
    largest: str
    entries: int
    adds: int
    bytes: int

    def meets(self, lo: str | None, hi: str | None) -> bool:
        """Whether the range (both ends inclusive, None: open) has a key in common with that of the run."""
        return (hi is None or self.smallest <= hi) and (lo is None or lo <= self.largest)


class Store:
    """Keys and values are bytes (text is taken as UTF-8).  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, **options: Any):
        unknown = set(options) - set(OPTIONS)
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        self.spark, self.path, self.options = spark, path.rstrip("/"), OPTIONS | options
        self.version, self.runs = self._manifest()
        self._cached: DataFrame | None = None

    # files
    def _fs(self) -> tuple[Any, Any]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        return sorted(int(str(f.getPath().getName())[9:-5]) for f in fs.globStatus(path(f"{self.path}/manifest-*.json")) or [])

    def _manifest(self) -> tuple[int, list[Run]]:
        versions = self._versions()
        if not versions:
            return 0, []
        rows = self.spark.read.text(f"{self.path}/manifest-{versions[-1]:012d}.json", wholetext=True).collect()
        return versions[-1], [Run(**r) for r in json.loads(rows[0][0])["runs"]]

    def _commit(self, runs: list[Run]) -> None:
        fs, path = self._fs()
        version = self.version + 1
        temporary, final = path(f"{self.path}/.manifest-{uuid.uuid4().hex}"), path(f"{self.path}/manifest-{version:012d}.json")
        runs = sorted(runs, key=lambda r: (r.level, r.smallest, r.name))
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps({"runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"version {version} has been written by another writer")
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None
        self.version, self.runs = version, runs
        log.info("%s: version %d with %d runs", self.path, version, len(runs))

    def _write(self, df: DataFrame, name: str) -> None:
        writer = df.write.option("compression", self.options["compression"])
        if self.options["bloom"]:
            writer = writer.option("parquet.bloom.filter.enabled#k", "true")
        if self.options["max_records"]:
            writer = writer.option("maxRecordsPerFile", self.options["max_records"])
        writer.parquet(f"{self.path}/{name}")

    def _new_name(self) -> str:
        return f"run-{self.version + 1:012d}-{uuid.uuid4().hex}"

    def _size(self, name: str) -> int:
        fs, path = self._fs()
        return int(fs.getContentSummary(path(f"{self.path}/{name}")).getLength())

    # reading
    def log(self, lo: bytes | str | None = None, hi: bytes | str | None = None) -> DataFrame:
        """(k, seq, op, v): every write that is still stored; with a range at least those of its keys."""
        chosen = self.runs_of(lo, hi)
        if self.options["cache_bytes"] and sum(r.bytes for r in self.runs) <= self.options["cache_bytes"]:
            if self._cached is None:
                self._cached = self._read(self.runs).persist()
            return self._cached
        return self._read(chosen)

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{r.name}" for r in runs)) if runs else empty(self.spark, SCHEMA)

    def runs_of(self, lo: bytes | str | None = None, hi: bytes | str | None = None) -> list[Run]:
        """The runs whose key range meets a range (both ends inclusive)."""
        low, high = (None if x is None else _bytes(x).hex() for x in (lo, hi))
        return [r for r in self.runs if r.meets(low, high)]

    def get(self, key: bytes | str) -> bytes | None:
        """The value, or None if the key is absent."""
        row = changelog.get(self.log(key, key), _bytes(key)).first()
        return None if row is None else bytes(row.v)

    def exists(self, key: bytes | str) -> bool:
        return not changelog.get(self.log(key, key), _bytes(key)).isEmpty()

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return changelog.multi_get(self.log(), pick(keys, "k").select(F.col("k").cast("binary").alias("k")))

    def snapshot(self) -> DataFrame:
        return changelog.snapshot(self.log())

    def scan(self, lo: bytes | str | None = None, hi: bytes | str | None = None, prefix: bytes | str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        low, high, start = (None if x is None else _bytes(x) for x in (lo, hi, prefix))
        first = max((x for x in (low, start) if x is not None), default=None)
        ends = [x for x in (high, _after(start)) if x is not None]
        return changelog.scan(self.log(first, min(ends) if ends else None), lo=low, hi=high, prefix=start, reverse=reverse, limit=limit)

    def seek(self, key: bytes | str = b"") -> Iterator[tuple[bytes, bytes]]:
        """Cursor over (key, value) from the first key that is not below ``key``."""
        for r in self.scan(lo=key).toLocalIterator():
            yield bytes(r.k), bytes(r.v)

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        return self.seek()

    # writing
    def _append(self, rows: DataFrame) -> None:
        """One entry of level 0; what it holds is observed while it is written."""
        name, seen = self._new_name(), Observation()
        self._write(rows.select("k", "seq", "op", "v").observe(seen, F.hex(F.min("k")).alias("lo"), F.hex(F.max("k")).alias("hi"), F.count("*").alias("n"), F.count_if(F.col("op") == "ADD").alias("adds")), name)
        s = seen.get
        if s["n"]:
            self._commit([*self.runs, Run(name, 0, s["lo"].lower(), s["hi"].lower(), s["n"], s["adds"], self._size(name))])

    def _batch(self, rows: DataFrame, order: str | None) -> None:
        rank = F.col("o") if order else F.lit(0)
        newest = rows.where("k IS NOT NULL").groupBy("k").agg(F.max(F.struct(rank.alias("o"), "op", "v")).alias("top"))
        self._append(newest.select("k", F.lit(self.version + 1).cast("bigint").alias("seq"), "top.op", "top.v"))

    def put_batch(self, rows: DataFrame, *, order: str | None = None) -> None:
        """Write all rows (k, v).  Later batches always win; of repeated keys in one batch the row counts that is last by
        column ``order``, and of rows alike in that, or without it, the greatest value."""
        both = pick(rows, "k", "v", *([order] if order else []))
        self._batch(both.select(F.col("k").cast("binary").alias("k"), F.lit("ADD").alias("op"), F.col("v").cast("binary").alias("v"), *([F.col(order).alias("o")] if order else [])), order)

    def remove_batch(self, keys: DataFrame) -> None:
        """Remove all keys (k), present or not."""
        self._batch(pick(keys, "k").select(F.col("k").cast("binary").alias("k"), F.lit("DEL").alias("op"), F.lit(None).cast("binary").alias("v")), None)

    def append_log(self, log: DataFrame) -> None:
        """Writes (k, seq, op, v) with an order of their own.  Do not mix with ``put_batch``, which numbers by batch."""
        self._append(changelog.latest(log).select(F.col("k").cast("binary").alias("k"), F.col("seq").cast("bigint").alias("seq"), "op", F.col("v").cast("binary").alias("v")))

    def add(self, key: bytes | str, value: bytes | str) -> None:
        """One key; for many use ``put_batch``."""
        self.put_batch(self.spark.createDataFrame([(_bytes(key), _bytes(value))], "k binary, v binary"))

    def remove(self, key: bytes | str) -> None:
        self.remove_batch(self.spark.createDataFrame([(_bytes(key),)], "k binary"))

    # compaction
    def scores(self) -> dict[int, float]:
        """Level -> entries / ``first`` for level 0, bytes / (``base_bytes`` * 10^(level-1)) below; 1 or more asks for a compaction."""
        levels = {r.level for r in self.runs}
        count = lambda n: sum(r.level == n for r in self.runs)
        size = lambda n: sum(r.bytes for r in self.runs if r.level == n)
        return {n: count(0) / self.options["first"] if n == 0 else size(n) / (self.options["base_bytes"] * TENFOLD ** (n - 1)) for n in sorted(levels)}

    def _inputs(self, level: int) -> tuple[list[Run], list[Run]]:
        """(runs of the level, runs one level below that they overlap): all of level 0, else as many files, oldest first, as are too much."""
        upper = [r for r in self.runs if r.level == level]
        if level:
            over, chosen = sum(r.bytes for r in upper) - self.options["base_bytes"] * TENFOLD ** (level - 1), []
            for r in sorted(upper, key=lambda r: r.name):
                if not chosen or over > 0:
                    chosen.append(r)
                    over -= r.bytes
            upper = chosen
        lo, hi = min(r.smallest for r in upper), max(r.largest for r in upper)
        return upper, [r for r in self.runs if r.level == level + 1 and r.meets(lo, hi)]

    def compact_step(self, *, keep_tombstones: bool = False) -> int | None:
        """Compact the level of the highest score into the next, if any is 1 or more; the level, or None."""
        scores = self.scores()
        level = max(scores, key=lambda n: (scores[n], -n), default=None)
        if level is None or scores[level] < 1:
            return None
        upper, lower = self._inputs(level)
        lo, hi = min(r.smallest for r in [*upper, *lower]), max(r.largest for r in [*upper, *lower])
        deeper = any(r.level > level + 1 and r.meets(lo, hi) for r in self.runs)
        self._merge([*upper, *lower], level + 1, keep_tombstones or deeper)
        return level

    def compact(self, *, keep_tombstones: bool = False) -> None:
        """Everything into sorted files of the deepest level.  The old files are kept until ``vacuum``.

        Tombstones go, unless older writes may still arrive.
        """
        if self.runs:
            self._merge(self.runs, max(1, *(r.level for r in self.runs)), keep_tombstones)

    def _merge(self, runs: list[Run], level: int, keep_tombstones: bool) -> None:
        name, total = self._new_name(), sum(r.bytes for r in runs)
        # A task for each shuffle partition unless files would be small, and more if they would be large.
        files = max(-(-total // self.options["file_bytes"]), min(shuffle_parts(self.spark), -(-total // SMALL)))
        rows = changelog.compact(self._read(runs), base_level=not keep_tombstones)
        self._write(rows.repartitionByRange(files, "k").sortWithinPartitions("k"), name)
        log.info("%s: %d runs of %d bytes merged into level %d", self.path, len(runs), total, level)
        written = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}").groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b"))
        each = written.agg(F.hex(F.min("k")).alias("lo"), F.hex(F.max("k")).alias("hi"), F.count("*").alias("n"), F.count_if(F.col("op") == "ADD").alias("adds")).collect()  # one row per file
        gone = {r.name for r in runs}
        self._commit([*(r for r in self.runs if r.name not in gone), *(Run(f"{name}/{e.f}", level, e.lo.lower(), e.hi.lower(), e.n, e.adds, e.b) for e in each)])

    def vacuum(self) -> None:
        """Delete files and manifests that the newest manifest does not need; no reader of an older version may be left."""
        fs, path = self._fs()
        live = {r.name for r in self.runs}
        folders = {n.split("/")[0] for n in live}
        for f in fs.globStatus(path(f"{self.path}/run-*")) or []:
            if str(f.getPath().getName()) not in folders:
                fs.delete(f.getPath(), True)
            elif str(f.getPath().getName()) not in live:
                for x in fs.globStatus(path(f"{f.getPath().toString()}/part-*")) or []:
                    if f"{f.getPath().getName()}/{x.getPath().getName()}" not in live:
                        fs.delete(x.getPath(), True)
        for v in self._versions()[:-1]:
            fs.delete(path(f"{self.path}/manifest-{v:012d}.json"), False)

    # about the store
    def stats(self) -> DataFrame:
        """(run, level, smallest, largest, entries, adds, dels, bytes) from the manifest; keys in hexadecimal."""
        rows = [(r.name, r.level, r.smallest.upper(), r.largest.upper(), r.entries, r.adds, r.entries - r.adds, r.bytes) for r in self.runs]
        return self.spark.createDataFrame(rows, "run string, level int, smallest string, largest string, entries bigint, adds bigint, dels bigint, bytes bigint")

    def info(self) -> dict[str, Any]:
        """Version, number of runs, entries and bytes, and the levels' scores."""
        return {"version": self.version, "runs": len(self.runs), "entries": sum(r.entries for r in self.runs), "bytes": sum(r.bytes for r in self.runs), "scores": self.scores()}

    def copy_to(self, path: str) -> Store:
        """A new store with the live entries only."""
        other = Store(self.spark, path, **self.options)
        other.put_batch(self.snapshot())
        other.compact()
        return other

    def close(self) -> None:
        """Nothing is buffered; every call has been durable when it returned."""


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _after(prefix: bytes | None) -> bytes | None:
    """A key that is not below any key with the prefix; None if there is none."""
    head = (prefix or b"").rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None
