"""Tables and outlines of pages as text files, and kept-state files read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_STATE_BYTES = 32 << 20
_SITE = "struct<seen:timestamp,items:array<array<string>>>"
_STATE = f"storage map<string,{_SITE}>, cookies array<struct<name:string,value:string,domain:string,path:string,expires:double,session:boolean,secure:boolean>>, _bad string"


def _write_lines(df: DataFrame, key: list[str], body: Column, path: str, folders: int) -> None:
    """A line for each row, its key and its body between tabs, in folders by the first key; a
    page's lines stand together in order. Line breaks in a body are written as spaces."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in key], F.regexp_replace(F.coalesce(body, F.lit("")), r"[\r\n]+", " "))
    dealt = df.withColumn("folder", F.pmod(F.xxhash64(key[0]), F.lit(folders)).cast("int")).repartition("folder").sortWithinPartitions("folder", *key)
    dealt.select("folder", line.alias("value")).write.partitionBy("folder").text(path)


def write_tables(tsv_rows: DataFrame, path: str, folders: int = 64) -> None:
    """(page_id, table, row, tsv) as lines of tab-separated cells behind their page, table and row."""
    _write_lines(tsv_rows, ["page_id", "table", "row"], F.col("tsv"), path, folders)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, table, row, tsv) that ``write_tables`` wrote."""
    parts = F.split("value", "\t", 4)
    return spark.read.schema("value string").text(path, recursiveFileLookup=True).select(*[parts[i].cast("long").alias(c) for i, c in enumerate(("page_id", "table", "row"))], parts[3].alias("tsv"))


def write_outlines(lines: DataFrame, path: str, folders: int = 64) -> None:
    """(page_id, pos, indent, line) as text, two spaces a level."""
    _write_lines(lines, ["page_id", "pos"], F.concat(F.repeat(F.lit("  "), F.col("indent")), "line"), path, folders)


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, pos, line) that ``write_outlines`` wrote, with the indent."""
    parts = F.split("value", "\t", 3)
    return spark.read.schema("value string").text(path, recursiveFileLookup=True).select(parts[0].cast("long").alias("page_id"), parts[1].cast("long").alias("pos"), parts[2].alias("line"))


def read_kept(spark: SparkSession, path: str, most_bytes: int = MOST_STATE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(storage (file, origin, seen, items), unreadable (file, why)) of kept-state files, one JSON
    document each. Files beyond ``most_bytes``, which are not parsed, and files that are not
    such documents are told, never dropped in silence."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sized = files.select(F.col("path").alias("file"), (F.col("length") > most_bytes).alias("large"), F.when(F.col("length") <= most_bytes, F.col("content").cast("string")).alias("text"))
    read = sized.withColumn("state", F.from_json("text", _STATE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    why = F.when(F.col("large"), "too large").when(F.col("state").isNull() | F.col("state._bad").isNotNull() | (F.trim("text") == ""), "no state")
    told = read.withColumn("why", why)
    storage = told.where("why is null").select("file", F.explode("state.storage").alias("origin", "site")).select("file", "origin", "site.seen", "site.items")
    return storage, told.where("why is not null").select("file", "why")
