"""Readers and writers: message traces, hand-off traces, tasks, profiles and results.

A bad line of a trace is an error with its file and text, raised when the rows are
used; line numbers are not kept, as a file may be read in parts.
"""

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..evaluation.tasks import SCHEMA as _TASKS
from ..operators.sessions import STATS_SCHEMA

CONTRACT_FILE = "contract struct<evidence:array<struct<id:string,text:string,source:string>>,requirements:array<struct<id:string,evidence_id:string,quote:string>>>, handoffs array<struct<stage:string,text:string>>"


def read_trace(spark: SparkSession, path, order: bool = True) -> DataFrame:
    """path, seq, source, target, raw of each line; an envelope {source, target, message} is unwrapped.

    `seq` follows the lines of each file: by Spark's row position, so a file larger
    than a split is numbered by its parts in order.  Blank lines are skipped.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__part"), F.monotonically_increasing_id().alias("__row"), F.trim("value").alias("line"))
    lines = lines.filter(F.length(F.regexp_replace("line", r"\s+", "")) > 0)
    parsed = F.try_parse_json("line")
    bad = parsed.isNull() | ~F.col("line").startswith("{")
    line = F.when(bad, F.raise_error(F.concat(F.col("path"), F.lit(": expected a JSON object per line: "), F.left(F.col("line"), F.lit(200)))).cast("string")).otherwise(F.col("line"))
    rows = lines.withColumn("line", line)
    message = F.get_json_object("line", "$.message")
    wrapped = message.startswith("{") & (F.schema_of_variant(F.try_variant_get(F.parse_json("line"), "$.message", "variant")).startswith("OBJECT"))
    wrapped = F.coalesce(wrapped, F.lit(False))
    part = lambda name: F.when(wrapped, F.get_json_object("line", f"$.{name}"))
    made = rows.select("path", "__part", "__row", part("source").alias("source"), part("target").alias("target"), F.when(wrapped, message).otherwise(F.col("line")).alias("raw"))
    if not order:
        return made.drop("__part", "__row")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("path").orderBy("__part", "__row")) - 1
    return made.withColumn("seq", seq.cast("long")).select("path", "seq", "source", "target", "raw")


def read_tasks(spark: SparkSession, path) -> DataFrame:
    """Task lines (a file, or a folder with *.json and *.jsonl at any depth); message and expected fields stay JSON text."""
    read = spark.read.schema(_TASKS).option("mode", "FAILFAST").json(path, pathGlobFilter="*.json*", recursiveFileLookup=True)
    expected = F.struct(F.col("expected.kind").alias("kind"), F.coalesce("expected.values", F.array().cast("array<string>")).alias("values"), F.coalesce("expected.fields", F.lit("{}")).alias("fields"))
    return read.withColumn("expected", expected)


def write_tasks(tasks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON line a task, a folder per family; message and fields are objects in the file, as in readers of other makers."""
    expected = F.struct(F.col("expected.kind").alias("kind"), F.col("expected.values").alias("values"), F.parse_json("expected.fields").alias("fields"))
    tasks.select("task_id", "family", F.parse_json("handoff_message").alias("handoff_message"), "receiver_question", expected.alias("expected")).withColumn("part", F.col("family")).write.mode(mode).partitionBy("part").json(path)


def read_handoffs(spark: SparkSession, path) -> DataFrame:
    """trace_id, evidence, requirements, handoffs of whole-file JSON; unknown keys, missing parts and empty hand-offs are errors."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), "value")
    made = F.from_json("value", CONTRACT_FILE, {"mode": "FAILFAST"})
    rows = read.select("trace_id", "value", made.alias("t"))
    # The canonical text has the known keys alone; a file with others has more leaves.
    keys = r'"(?:[^"\\]|\\.)*"\s*:'
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(keys), F.lit(0)))
    bad = (F.coalesce(F.size("t.handoffs"), F.lit(0)) < 1) | F.col("t.contract").isNull() | (count(F.col("value")) != count(F.to_json("t")))
    checked = F.when(bad, F.raise_error(F.concat(F.col("trace_id"), F.lit(": not a hand-off trace"))).cast(rows.schema["t"].dataType)).otherwise(F.col("t"))
    return rows.select("trace_id", checked.alias("t")).select("trace_id", "t.contract.evidence", "t.contract.requirements", "t.handoffs")


def write_profile(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Hand-off records as JSON lines; derived columns are not stored."""
    records.drop("edge", "ratio", "tokens_saved", "cost_before", "cost_after").write.mode(mode).json(path)


def read_profile(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema("index long, source string, target string, raw string, sent string, " + STATS_SCHEMA).json(path)


def write_results(runs: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Run records as JSON and CSV folders."""
    runs.write.mode(mode).json(f"{folder}/results.json")
    runs.write.mode(mode).option("header", True).csv(f"{folder}/results.csv")


def write_json(data: dict, out: str | None, source: str | None = None) -> None:
    """A small result as JSON, to a file that is not the input, else to the terminal."""
    text = json.dumps(data, indent=2, ensure_ascii=False, default=str) + "\n"
    if out is None:
        print(text, end="")
        return
    check_output(out, source)
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    Path(out).write_text(text, encoding="utf-8")


def check_output(out: str | None, source: str | None) -> None:
    if out and source and Path(out).resolve() == Path(source).resolve():
        raise ValueError("the output must not be the input")
