"""Tables that several branches of a plan read, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below the one that driver and executors share, deleted when the driver ends.

    The shared folder is ``spark.checkpoint.dir``; a local session without that setting uses its warehouse, a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(root or spark.conf.get('spark.sql.warehouse.dir') + '/_shared').rstrip('/')}/{name}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again.

    What is dear to work out (parsed pages above all) is then worked out once, and survives lost executors. The files stay until the driver
    ends, as results may read them until then.
    """
    path = shared_folder(df.sparkSession, f"staged-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
