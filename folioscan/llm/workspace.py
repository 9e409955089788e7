"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioscan-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/folioscan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: a lost executor
    costs a reread, not the lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folioscan_path = path
    return out


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """How many rows Spark hands to a Python worker at a time from here on. Texts are long:
    Spark's own 10,000 rows of them hold some 100 MB of buffers for each task, outside the
    heap, on either side. A limit below ``rows`` stays as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows > 1000 or int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def discard(df: DataFrame) -> None:
    """Delete the table behind ``df`` if ``materialize`` wrote it; no later read may need it."""
    path = getattr(df, "_folioscan_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not hold yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
