"""Tables written to the folder that driver and executors share, to cut lineage and to compute once what is read often."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/glean"
_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, removed when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or LOCAL_DEFAULT
    path = f"{folder.rstrip('/')}/glean-core-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back; a lost executor costs a stage of what follows, not of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone: its owner clears the folder
            return
