"""Tables written to the folder that all executors share, so that what many branches of a job
read is made once and a lost executor costs a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="folioscan-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table. Alike rows pack so well that files of a few MB hold GB of rows,
    so by the size of its files Spark would broadcast a table that no driver can hold: what is
    read from one joins by shuffles, unless the join itself asks for a broadcast."""
    path = shared_path(df.sparkSession, f"tables/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in as many tasks as ``spark.sql.shuffle.partitions`` says. Alike rows pack so well
    that AQE, which goes by packed bytes, would put hundreds of MB of them into each of a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
