"""The request log: JSON lines in, JSON lines or a CSV table out."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.leaks import guard_records
from ..schemas import AUDIT
from ..tables import written

#: The columns of the CSV table, in order.
CSV_COLUMNS = (
    "request_id", "timestamp", "verdict", "user_id", "role", "department", "ai_data_policy",
    "answer_model", "policy_version", "feed_version", "decisions", "bindings", "tool_decisions",
    "tool_iterations", "disabled_controls", "prompt_tokens", "completion_tokens", "judge_tokens",
    "cost_usd", "total_latency_ms", "prompt_text",
)


def in_range(log: DataFrame, since=None, until=None) -> DataFrame:
    """Rows with a readable timestamp, as column ts, in [since, until); either end may be open."""
    rows = log.withColumn("ts", F.try_to_timestamp("timestamp")).where("ts is not null")
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since))
    return rows if until is None else rows.where(F.col("ts") < F.lit(until))


def read_audit(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """The records of a log of JSON lines; lines that aren't JSON or lack a timestamp are skipped."""
    raw = spark.read.schema(f"{AUDIT}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    if "day" in raw.columns:  # folders of other days aren't read
        raw = raw.where(F.lit(True) if since is None else F.col("day") >= F.to_date(F.lit(since))).where(F.lit(True) if until is None else F.col("day") <= F.to_date(F.lit(until))).drop("day", "load")
    return in_range(raw.where("_bad is null").drop("_bad"), since, until)


def records_to_write(records: DataFrame, log_prompt_text: bool = True) -> DataFrame:
    """One row per request, latencies rounded to 3 places, the prompt left out unless the policy logs it; plus day."""
    rows = records.dropDuplicates(["request_id"])
    rows = rows.withColumns({
        "decisions": F.transform("decisions", lambda d: d.withField("latency_ms", F.round(d["latency_ms"], 3))),
        "bindings": F.transform("bindings", lambda b: b.withField("latency_ms", F.round(b["latency_ms"], 3))),
        "step_latency_ms": F.transform_values("step_latency_ms", lambda _, v: F.round(v, 3)),
        "total_latency_ms": F.round("total_latency_ms", 3),
        "day": F.to_date(F.try_to_timestamp("timestamp")),
    })
    return rows if log_prompt_text else rows.withColumn("prompt_text", F.lit(None).cast("string"))


def _reads_nothing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def logged_ids(spark: SparkSession, path: str, days: list, load: str) -> DataFrame:
    """(day, request_id) that the log at path holds for these days, by other loads than this one.

    Ids are read from the folder beside the log. A load that was stopped after its records and before its ids has
    records only; those are read instead, of that load's folders alone.
    """
    none = spark.createDataFrame([], "day string, request_id string")
    names = ",".join(str(d) if d is not None else "__HIVE_DEFAULT_PARTITION__" for d in days)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/day={{{names}}}").select("path")  # names only
    except AnalysisException as e:
        if _reads_nothing(e):
            return none
        raise
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1).alias(k)
    folders = files.select(part("day"), part("load")).distinct().where(F.col("load") != load)
    try:
        own = spark.read.schema("request_id string, day string, load string").parquet(f"{path}-ids").where(F.col("day").isin([str(d) for d in days]) | F.col("day").isNull())
    except AnalysisException as e:
        if not _reads_nothing(e):
            raise
        own = spark.createDataFrame([], "request_id string, day string, load string")
    own = own.withColumn("day", F.coalesce("day", F.lit("__HIVE_DEFAULT_PARTITION__")))
    without = folders.join(own.select("day", "load").distinct(), ["day", "load"], "left_anti").collect()  # loads that were stopped
    ids = own.where(F.col("load") != load).select("day", "request_id")
    for r in without:
        ids = ids.unionByName(spark.read.schema("request_id string").json(f"{path}/day={r.day}/load={r.load}").select(F.lit(r.day).alias("day"), "request_id"))
    return ids


def write_audit(records: DataFrame, path: str, load: str | None = None, values: DataFrame | None = None, log_prompt_text: bool = True) -> None:
    """Adds the records to the log at path, exactly one row per request: a folder per UTC day and load.

    load names the set of records: the same load again replaces its own folders and so changes nothing. Requests that another
    load has written on the same day stay out, whether loads overlap or one of them was stopped half-way: a load's
    folders appear at once, and the ids kept beside the log (path-ids) are only a short cut to what they hold. Loads of
    one log go one after the other. values (see leaks.value_forms) are those of the requests: records that spell
    one are withheld before anything is written.
    """
    spark, load, path = records.sparkSession, load or uuid.uuid4().hex, path.rstrip("/")
    rows = records_to_write(records, log_prompt_text)
    if values is not None:
        rows = guard_records(rows, values)
    rows = written(rows, "audit-load")
    days = [r.day for r in rows.select("day").distinct().collect()]  # calendar days
    if not days:
        return
    name = F.coalesce(F.col("day").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    known = logged_ids(spark, path, days, load).distinct()
    fresh = rows.withColumn("load", F.lit(load))
    if not known.isEmpty():  # looked for twice rather than kept: neither this load's folders nor its ids are among the known ones
        fresh = fresh.withColumn("_day", name).join(known.withColumnRenamed("day", "_day"), ["_day", "request_id"], "left_anti").drop("_day")
    put = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "load")
    put(fresh).option("compression", "gzip").json(path)
    put(fresh.select("request_id", "day", "load")).parquet(f"{path}-ids")


def safe_cell(text: Column) -> Column:
    """A cell that a spreadsheet won't evaluate: one that begins like a formula gets a quote in front; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def _cell_text(rows: DataFrame, name: str) -> Column:
    summaries = {
        "decisions": lambda d: F.concat(d["stage"], F.lit("/"), d["control"], F.lit(": "), d["verdict"]),
        "bindings": lambda b: F.concat(b["name"], F.lit(": "), b["status"]),
        "tool_decisions": lambda t: F.concat(t["tool"], F.lit(": "), t["verdict"]),
        "disabled_controls": lambda x: x,
    }
    if name in summaries:
        return F.array_join(F.transform(name, summaries[name]), "; ")
    kind = rows.schema[name].dataType.typeName()
    if kind == "double":
        # whole numbers keep their ".0", as JSON has it
        x = F.col(name)
        return F.when(x == F.floor(x), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(F.format_string("%s", x.cast("decimal(38,6)").cast("string")).substr(F.lit(1), F.lit(64)))
    return F.col(name).cast("string")


def csv_table(rows: DataFrame) -> DataFrame:
    """The log as a flat table of safe text cells; nested parts become summaries."""
    cells = []
    for name in CSV_COLUMNS:
        text = _cell_text(rows, name)
        if rows.schema[name].dataType.typeName() == "double":
            text = F.regexp_replace(text, r"(\.[0-9]*?[1-9])0+$", "$1")
        cells.append(safe_cell(text).alias(name))
    return rows.select(*cells)


def export_csv(rows: DataFrame, path: str) -> None:
    csv_table(rows).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
