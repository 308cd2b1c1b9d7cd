"""Session helpers: table access and cluster-safe intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WORK_DIRS: set[str] = set()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session that names none (unit tests, local mode) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kronopanel-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: the rows survive the loss of any executor, and later passes do not
    recompute what produced them.  The folder goes with ``release``, at the latest when the program ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession) -> str:
    """This program's own folder of intermediate tables within the shared one."""
    path = f"{shared_dir(spark)}/kronopanel-{spark.sparkContext.applicationId}"
    if path not in _WORK_DIRS:
        _WORK_DIRS.add(path)
        atexit.register(_release_at_exit, spark)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables; results that were not written yet must not be read any more."""
    path = f"{shared_dir(spark)}/kronopanel-{spark.sparkContext.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _WORK_DIRS.discard(path)


def _release_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        release(spark)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
