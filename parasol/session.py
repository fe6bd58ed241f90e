"""Session defaults and the shared folder that cuts lineage.

Every table that is written part-way through a job goes to the folder named by
``spark.checkpoint.dir``, because driver and executors share no other one. The
tables of a driver process lie in one folder there, which goes when it ends.
"""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, which is the case in tests.
FALLBACK_DIR = "file:/tmp/checkpoints"
#: Rows and bytes in one Arrow batch; texts may be long, so Spark's defaults are too many.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

#: The written tables of this process, in the order of writing.
_made: list[str] = []
_RUN = uuid.uuid4().hex


def build_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine expects."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parasol")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a fallback, a cluster an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = FALLBACK_DIR
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: The setting by which Spark deletes the shuffle files of a query when it ends; they else stay until the driver's garbage is collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; the session's own setting is put back."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def save_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns a scan of it.

    The result survives lost executors and is never computed twice, so the
    shuffles that led to it are deleted.
    """
    spark = df.sparkSession
    if not _made:
        atexit.register(lambda: _at_exit(spark))
    path = f"{shared_dir(spark)}/parasol/{_RUN}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    with no_shuffles_left(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may be gone before the process
        _delete(spark, _made[0].rsplit("/", 1)[0])


def cut(df: DataFrame) -> DataFrame:
    """A reliable eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_table(table: DataFrame) -> None:
    """Deletes what ``save_table`` wrote, if ``table`` is its very result, which must not be read any more."""
    path = vars(table).get("table_path")
    if path in _made:
        _delete(table.sparkSession, path)
        _made.remove(path)


def written() -> list[str]:
    """The folders of the written tables that are there now."""
    return list(_made)


def clear_up(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables and lets both sides of the driver collect their garbage.

    Spark drops shuffle files and broadcasts whose frames are collected, and
    the driver gives memory back, which it would do much later by itself.
    """
    for path in paths:
        if path in _made:
            _delete(spark, path)
            _made.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch where the session keeps Spark's defaults."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
