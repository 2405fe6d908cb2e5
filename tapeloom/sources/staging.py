"""Write an intermediate result once and read it back.

The table goes to the shared folder named by ``spark.checkpoint.dir`` so that
it survives the loss of executors.  Only a local session without that setting
falls back to a fresh folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a shared folder before running multi-pass operators")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[sc.applicationId]


def stage(df: DataFrame) -> DataFrame:
    """Materialise df as Parquet under the staging folder and return the written table."""
    path = f"{staging_root(df.sparkSession)}/tapeloom-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
