"""Sessions, table access and the shared working folder."""

from __future__ import annotations

import atexit
import pathlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings that make sense at any size; the caller's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "loamgraph", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; keyword names use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> str | None:
    """Send this package, by way of the shared folder, to executors that do not have it: its functions are sent by name only.

    The archive's place, or None in a single process, which has the package already.
    """
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return None
    home = pathlib.Path(__file__).parent
    target = f"{shared_dir(spark)}/package-{uuid.uuid4().hex}/{home.name}.zip"
    with tempfile.TemporaryDirectory() as at:  # the driver's own, for as long as this takes
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        to = path(target)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(path(shutil.make_archive(f"{at}/{home.name}", "zip", home.parent, home.name)), to)
    spark.sparkContext.addPyFile(target)
    return target


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is ``spark.checkpoint.dir``.  Only a single-process session without that
    setting gets a temporary folder of its own; a cluster without it is an error,
    since a machine-local folder would not be seen by the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set and {master} is not a single process")
    own = tempfile.mkdtemp(prefix="loamgraph-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Folders of tables written by this process, and names of those the catalog knows.
_written: list[str] = []
_named: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; no result that is still to be read may rest on them."""
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_end() -> None:
    """When the process ends nobody can read its results any more; folders on other file systems are left to ``release``."""
    for home in _written:
        if re.match(r"file:|/", home):
            shutil.rmtree(re.sub(r"^file:/*", "/", home), ignore_errors=True)


def own_folder(spark: SparkSession) -> str:
    """A new name below the shared folder; what is written there goes with ``release``."""
    _written.append(f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts the lineage: a lost executor costs its tasks, not what was written.
    The schema is kept as given, so an empty result reads back as an empty table.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, n: int, by: str, *partition_by: str) -> DataFrame:
    """``stored``, in ``n`` buckets of column ``by``: tables with equally many buckets are joined by it without a shuffle.

    Only a table of the catalog can say so; it lies below the shared folder and goes with ``release``.
    """
    spark = df.sparkSession
    home, table = own_folder(spark), f"loam_{uuid.uuid4().hex}"
    _named.append(table)
    writer = df.write.mode("errorifexists").format("parquet").option("path", f"{home}/{name}").bucketBy(n, by).sortBy(by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return spark.table(table)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by exact spelling.

    Extra columns are dropped, also those whose names differ only in case or
    repeat a name (the first one counts), which a plain select finds ambiguous.
    """
    at = df.columns
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"no column {missing} among {at}")
    return df.toDF(*(f"c{i}" for i in range(len(at)))).select(*(F.col(f"c{at.index(n)}").alias(n) for n in names))


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], T._parse_datatype_string(ddl))
