"""Session settings and the points where a job cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tallywork") -> SparkSession:
    """Session for tests and single-node runs; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only for local sessions."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallywork-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: what follows reads it, and an executor lost later costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of the input tables for which a shuffle has a partition. A ledger has about two rows for each of them.
ROWS_A_PARTITION = 300_000


def enough_partitions(*tables: DataFrame) -> None:
    """Raises the session's shuffle partitions to the size of the tables read, never lowers them.

    With a fixed number a task sorts and hashes ever more rows as tables grow, and spills them. Files are counted by their footers."""
    spark = tables[0].sparkSession
    wanted = -(-sum(t.count() for t in tables) // ROWS_A_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files of a command are deleted when it ends. Otherwise they stay on disk until the driver happens to collect
    its plan, so that the shuffles of all steps of a long job may lie there together."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


# The folder of the innermost scratch, if a job is in one.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A folder for a table or files of this job: in the innermost scratch, else among the tables of the application."""
    within = _SCRATCH.get() or f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    return f"{within}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this job wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Folders made within it are deleted when it ends, so what it leads to is written elsewhere before."""
    folder = new_folder(spark, "scratch")
    outer = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(outer)
        drop(spark, folder)


def write(df: DataFrame, path: str, *parted: str) -> None:
    """Adds the rows to a folder, in subfolders by the columns `parted`. zstd halves hex digests, which the default codec leaves as they are."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").partitionBy(*parted).parquet(path)


def store(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder, for plans that read them many times.

    All tables of an application lie in one folder named after it, which its owner clears when it has ended; those stored
    in a scratch go with it.
    """
    path = new_folder(df.sparkSession)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
