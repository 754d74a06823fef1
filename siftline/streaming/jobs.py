"""Streaming counterparts of the batch jobs: each takes a streaming DataFrame and returns one.

Rows later than the watermark are dropped; the batch job over the whole log stays the source of truth.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import injection, scan, signatures
from ..operators.consumption import COST_SLACK
from ..schemas import AUDIT
from ..tables import shared_dir

LATE = "10 minutes"
#: Seconds of a user that one group holds at most.
SPAN = 3600


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream: new files of JSON lines as they come; bad lines are dropped."""
    raw = spark.readStream.schema(f"{AUDIT}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null").drop("_bad").withColumn("ts", F.try_to_timestamp("timestamp")).where("ts is not null")


def per_minute(log: DataFrame, late: str = LATE) -> DataFrame:
    """R1. (minute, requests, blocks) over tumbling minutes."""
    counts = log.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("requests"), F.count_if(F.col("verdict") == "block").alias("blocks"))
    return counts.select(F.col("window.start").alias("minute"), "requests", "blocks")


def daily_usage(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """R2. (user_id, day, tokens, cost_usd) running sums per UTC day, for output mode update. calls: user_id, ts, tokens,
    cost_usd (see C1)."""
    sums = calls.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day")).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return sums.select("user_id", F.to_date("window.start").alias("day"), "tokens", "cost_usd")


def budget_alerts(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """R2. Running sums above the user's limit, with control; limits: user_id, tokens_per_day, cost_per_day_usd (a static
    table; null: no limit)."""
    over = F.when(F.col("tokens") > F.col("tokens_per_day"), "budgets.tokens_per_day").when(F.col("cost_usd") > F.col("cost_per_day_usd") + COST_SLACK, "budgets.cost_per_day_usd")
    return usage.join(limits, "user_id").withColumn("control", over).where("control is not null")


def trailing_minute(requests: DataFrame, late: str = LATE) -> DataFrame:
    """R3. (user_id, until, load): requests per sliding minute, a value each second; an approximation of C5 for alerts, in mode
    update or append. The state has 60 rows for a request until the watermark passes; for backfills see trailing_minutes()."""
    counts = requests.withWatermark("ts", late).groupBy("user_id", F.window("ts", "60 seconds", "1 second")).agg(F.count("*").alias("load"))
    return counts.select("user_id", F.col("window.end").alias("until"), "load")


def per_second(requests: DataFrame) -> DataFrame:
    """R3. (user_id, second, n): requests per user and second since 1970 of a batch."""
    return requests.where("ts is not null").groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")).agg(F.count("*").alias("n"))


def trailing_load(counts: DataFrame) -> DataFrame:
    """R3. (user_id, until, load), as trailing_minute() has it, of per_second() counts, of which a second may have several rows.

    A request counts from the second after it until a minute later. The beginnings and ends of these stretches are added up
    within spans of SPAN seconds of a user; what goes on over a span's end is cut there, so that neither a user nor a
    span has to be held whole. Seconds come last, one by one, out of stretches of equal load.
    """
    begin, end = F.col("second") + 1, F.col("second") + 61
    cut = F.explode(F.sequence(F.floor(begin / SPAN), F.floor((end - 1) / SPAN)))
    parts = counts.select("user_id", "n", begin.alias("begin"), end.alias("end"), cut.alias("span"))
    first, after = F.greatest("begin", F.col("span") * SPAN), F.least("end", (F.col("span") + 1) * SPAN)
    steps = parts.select("user_id", "span", F.explode(F.array(F.struct(first.alias("at"), F.col("n").alias("d")), F.struct(after.alias("at"), (-F.col("n")).alias("d")))).alias("x"))
    changes = steps.repartition("user_id", "span").groupBy("user_id", "span", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("user_id", "span").orderBy("at")
    stretches = changes.select("user_id", "at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("load"), F.lead("at").over(w).alias("next")).where("load > 0")
    return stretches.select("user_id", F.explode(F.sequence("at", F.col("next") - 1)).alias("until"), "load").select("user_id", F.timestamp_seconds("until").alias("until"), "load")


def trailing_minutes(requests: DataFrame, name: str) -> DataFrame:
    """R3 over what there is, as a table. Loads are sums, so each micro-batch is kept as counts per user and second, without any
    state, and the counts of all batches are added up when the table is read: no request comes too late."""
    return trailing_load(drained(requests.select("user_id", "ts"), name, each=per_second))


def live_values(messages: DataFrame, issued: DataFrame, ttl_seconds: int, late: str = LATE) -> DataFrame:
    """R5. (id, user_id, ts, text, value): issued values that live when a message comes; an interval join of streams."""
    m = messages.withWatermark("ts", late)
    v = issued.withWatermark("issued_at", late).select(F.col("user_id").alias("owner"), "value", "issued_at")
    near = F.expr(f"user_id = owner and issued_at <= ts and issued_at > ts - interval {ttl_seconds} seconds")
    return m.join(v, near).select("id", "user_id", "ts", "text", "value")


def scan_messages(messages: DataFrame, feed: list[dict], mode: str = "block", text: str = "text") -> DataFrame:
    """R6. Adds spans, injection and signature verdicts to messages: stateless, the batch functions as they are."""
    rows = injection.check_injection(scan.with_spans(messages, text), mode, text)
    return signatures.match_signatures(rows, feed, F.lit("input"), mode, text)


class LatestFeed:
    """The feed at path as it is now; while it can't be read or has errors, the last good one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.entries = spark, path, None

    def __call__(self) -> list[dict]:
        try:
            _, self.entries = signatures.parse_feed(self.spark, self.path)
        except (signatures.FeedError, AnalysisException):
            if self.entries is None:
                raise
        return self.entries


def scanned_with_latest_feed(messages: DataFrame, feed_path: str, name: str, mode: str = "block", text: str = "text") -> DataFrame:
    """R6. scan_messages() with the feed read anew for each micro-batch."""
    feed = LatestFeed(messages.sparkSession, feed_path)
    return drained(messages, name, each=lambda batch: scan_messages(batch, feed(), mode, text))


def deduplicated(log: DataFrame, late: str = LATE) -> DataFrame:
    """R7. One record per request among those that come within the watermark of each other."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def drained(stream: DataFrame, name: str, mode: str = "append", each=None) -> DataFrame:
    """Runs a stream over what there is and returns its rows, as a table in the shared folder: for backfills.

    Each micro-batch is written by the executors to a folder of its own, over what a failed try has left there; nothing
    passes through the driver. name must be new. each: what to do with a batch first. Streams of
    mode update are merged by their keys instead: snapshots.upserted().
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}"
    make = each or (lambda batch: batch)
    empty = make(spark.createDataFrame([], stream.schema)).withColumn("_batch", F.lit(-1).cast("long"))
    empty.write.mode("overwrite").parquet(f"{path}/none")

    def put(batch: DataFrame, n: int) -> None:
        make(batch).withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(empty.schema).option("recursiveFileLookup", True).parquet(path)
    return rows.drop("_batch")
