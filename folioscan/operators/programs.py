"""Line-oriented session programs and their logs: parsing, errors, canonical form, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_SCHEMA = "time string, program string, reply string"
_REF = r"[A-Za-z]+[0-9]+"
_QUOTED = r'"(?:[^"\\]|\\["\\nt])*"'
_SAID = r'"(?:[^"\\]|\\["\\nt])+"'
_TARGET = rf"(?:{_REF}|{_SAID})"
_VALUE = rf"(?:{_QUOTED}|\$secret:[A-Za-z0-9_.-]+)"
_WITHIN = rf"(?: in {_TARGET})?"
# The statements, each with the shape of its operands.
GRAMMAR = {
    "goto": rf"(?:{_SAID}|[^\s\"]\S*)",
    "back": "",
    "forward": "",
    "click": _TARGET,
    "dblclick": _TARGET,
    "check": _TARGET,
    "hover": _TARGET,
    "fill": rf"{_TARGET} {_VALUE}",
    "select": rf"{_TARGET}(?: {_VALUE})+",
    "press": r"\S+",
    "scroll": rf"(?:{_TARGET} )?(?:down|up|to {_TARGET}|[0-9]+)",
    "upload": rf"{_TARGET} {_QUOTED}",
    "wait": rf"(?:(?:text|gone) {_QUOTED}{_WITHIN}|seconds [0-9]+)",
    "expect": rf"(?:url ~ .+|url = {_QUOTED}|(?:text|gone) {_QUOTED}{_WITHIN}|visible {_TARGET})",
    "view": rf"(?:(?:outline|interactive|read|net|unseen|help|(?:table|expand) {_REF}|find {_QUOTED})(?: budget=[0-9]+)?|budget=[0-9]+)?",
    "eval": r".+",
    "replay": r"[0-9]+",
    "dialog": rf"(?:accept|dismiss)(?: {_QUOTED})?",
}


def read_audit(spark, path: str) -> DataFrame:
    """Session log records, one JSON object a line; broken lines have null fields."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def write_audit(records: DataFrame, path: str) -> None:
    """Append records; JSON escapes line ends, so no content can forge a record."""
    records.select("time", "program", "reply").write.mode("append").json(path)


def unquote(s: Column) -> Column:
    body = s.substr(F.lit(2), F.length(s))
    body = F.regexp_replace(body, r'"$', "")
    for raw, out in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\x00", "\\")):
        body = F.replace(body, F.lit(raw), F.lit(out))
    return F.when(s.startswith('"'), body).otherwise(s)


def statements(programs: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, line, attempt, verb, operands, error) of each statement of (key, program): blank
    and ``#`` lines are skipped, lines count from 1, ``try`` marks an attempt."""
    each = programs.select(key, F.posexplode(F.split("program", "\n")).alias("at", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    each = each.where("raw <> '' and not raw like '#%'")
    attempt = F.col("raw").rlike(r"^try ")
    body = F.when(attempt, F.col("raw").substr(F.lit(5), F.length("raw"))).otherwise(F.col("raw"))
    verb = F.regexp_extract(body, r"^(\S+)", 1)
    operands = F.regexp_extract(body, r"^\S+ ?(.*)$", 1)
    shape = F.create_map(*[F.lit(x) for k, v in GRAMMAR.items() for x in (k, f"^(?:{v})$")])
    out = each.select(key, (F.col("at") + 1).alias("line"), attempt.alias("attempt"), verb.alias("verb"), operands.alias("operands")).withColumn("_shape", shape[F.col("verb")])
    error = F.when(F.col("_shape").isNull(), F.concat(F.lit("unknown statement "), "verb")).when(~F.expr("operands rlike _shape"), F.concat(F.lit("bad operands of "), "verb"))
    return out.withColumn("error", error).drop("_shape")


def first_errors(steps: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, line, message): the first error of each program that has one."""
    return steps.where("error is not null").groupBy(key).agg(F.min("line").alias("line"), F.min_by("error", "line").alias("message"))


def accepted(steps: DataFrame, key: str = "program_id") -> DataFrame:
    """Steps of programs without an error: the first error rejects the whole program."""
    return steps.join(first_errors(steps, key).select(key), key, "left_anti")


def canonical(steps: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, program): statements in canonical form, one a line."""
    said = F.concat(F.when(F.col("attempt"), "try ").otherwise(""), F.trim(F.concat_ws(" ", "verb", "operands")))
    each = steps.select(key, "line", said.alias("said"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("program"))


def outcomes(replies: DataFrame, key: str = "program_id") -> DataFrame:
    """(key, failed_line, cause, skipped, notes, events) read off replies. The cause is what
    follows the failed statement's canonical text."""
    each = replies.select(key, F.explode(F.split("reply", "\n")).alias("l"))
    shape = rf"^failed line (\d+): ((?:{_QUOTED}|[^\":]|:(?! ))*): (.*)$"
    failed = F.regexp_extract("l", shape, 1).try_cast("int")
    cause = F.nullif(F.regexp_extract("l", shape, 3), F.lit(""))
    return each.groupBy(key).agg(F.min(failed).alias("failed_line"), F.first(cause, ignorenulls=True).alias("cause"), F.count_if(F.col("l").rlike(r"^skipped line \d+: ")).alias("skipped"), F.count_if(F.col("l").startswith("note: ")).alias("notes"), F.count_if(F.col("l").rlike(r'^event [a-z-]+ "')).alias("events"))
