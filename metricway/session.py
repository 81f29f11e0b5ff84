"""Session settings and the few helpers that need the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 500_000
DEALT_ROWS = 50_000

_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def local_session(cpus: str | int = "*", app: str = "metricway", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir` of the session.

    Only a session that leaves it unset (tests, a laptop) gets a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_CONF} is unset: executors of {spark.sparkContext.master} share no folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores when their scan has fewer partitions than there are cores.

    A small file is read by a task or two, however heavy the work on its texts. A large table
    comes in more partitions than cores and is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, rows: int = DEALT_ROWS) -> DataFrame:
    """The rows by key over as many partitions as hold about `rows` each: what a task holds does not grow with the table.

    For a source that is cheap to count. Grouping and joining by the key afterwards needs no other shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side to broadcast if it is counted to be small; else as it is, for a shuffled join.

    For narrow rows only, and where counting is cheap beside the join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def put(df: DataFrame, folder: str) -> DataFrame:
    """The rows written as a new table there, and read from it.

    The exchanges that made it are of no use afterwards: their files go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(folder)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: made once, whatever reads them and how often."""
    folder = f"{shared_folder(df.sparkSession)}/metricway-{uuid.uuid4().hex}"
    if (own := _passing.get()) is not None:
        own.append(folder)
    return put(df, folder)


def removed(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def released(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave: nothing may read them any more, nor a frame made from them."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not folder.rpartition("/")[2].startswith("metricway-"):
                raise ValueError(f"not a table of `written`: {folder}")
            removed(df.sparkSession, folder)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """All tables of `written` made inside go at its end: what is to stay is put elsewhere before."""
    token = _passing.set(own := [])
    try:
        yield
    finally:
        _passing.reset(token)
        for folder in own:
            removed(spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
