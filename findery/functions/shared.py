"""Tables in the folder that the driver and all executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="findery-")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again; later plans reread it, also after a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
