"""Running a stream over what has arrived, into a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.sources.stored import shared_path


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of a table, with the table's schema. A table of one file is
    watched through its folder."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rstrip("/").rpartition("/")[2] for f in table.inputFiles()] == [name]:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all available input and return its result table. In complete mode
    each batch replaces the table; in append mode each has a folder of its own, which a batch
    that is run again writes anew."""
    spark = stream.sparkSession
    out = shared_path(spark, f"streams/{name}")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table" if mode == "complete" else f"{out}/table/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/table")


def run_closed(events: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, *, ts_col: str = "ts") -> DataFrame:
    """Run the append-mode stream ``build(events)`` over all available input and then close it:
    a last row, null but for a time past all others, lets the watermark pass every window, so
    windows still open come out. Each window is written once and its state dropped; the closing
    row's own window never ends, so it is no row of the result. A closed stream takes no more
    events."""
    spark = events.sparkSession
    out = shared_path(spark, f"streams/{name}")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
    row = [F.to_timestamp(F.lit("2200-01-01")).alias(f.name) if f.name == ts_col else c for f, c in zip(events.schema.fields, nothing, strict=True)]
    spark.range(0).select(*nothing).write.parquet(f"{out}/closing")
    both = build(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{out}/closing")))

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={n}")

    for last in (False, True):
        if last:
            spark.range(1).select(*row).write.mode("append").parquet(f"{out}/closing")
        both.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(both.schema).option("recursiveFileLookup", "true").parquet(f"{out}/table")
