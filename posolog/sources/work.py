"""A scratch folder in the shared store."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/posolog/{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        return path
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="posolog-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a table in a scratch folder, for plans that branch from it; it survives lost executors."""
    path, schema = f"{scratch(df.sparkSession)}/table", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
