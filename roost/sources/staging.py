"""Written intermediate tables: shared by several outputs, and safe when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="roost-stage-")
    return _LOCAL[context.applicationId]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, which cuts its lineage and plan."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/roost/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
