"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_edgewright_tables", None) or tempfile.mkdtemp(prefix="edgewright-")
        spark.sparkContext._edgewright_tables = found
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read again: what depends on how Spark dealt it out stays as it was, whatever is lost. It goes
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgewright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
