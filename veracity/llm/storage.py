"""Tables that cut lineage: written to the folder every executor shares, then read again."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only for a local session where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors have no folder in common")
    return root or os.path.join(tempfile.gettempdir(), f"veracity-{spark.sparkContext.applicationId}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries that are run inside go when each query has ended, not when the driver collects garbage."""
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` once and read it back: a lost executor costs a re-read, never a recomputed chain.

    ``free``: its shuffle files go as soon as it is written (not for what keeps shuffles of other frames in use).
    """
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession) if free else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and no later plan reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(at))
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
