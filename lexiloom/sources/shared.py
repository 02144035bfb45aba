"""Folders that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = option.get() if option.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: With this Spark deletes a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session has ``value`` as its setting ``key`` meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back, so that lost executors don't bring its computation back.

    What was shuffled for it is deleted from the executors' disks at once.
    """
    path = shared_dir(df.sparkSession)
    with with_conf(df.sparkSession, _CLEAN_UP, "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(table: DataFrame) -> None:
    """Empty the folder of a staged table that nothing reads any more."""
    for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)
