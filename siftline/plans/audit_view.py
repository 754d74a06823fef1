"""The table events seen as a request log, so that every dashboard section runs over given data.

k is the number in props. What k stands for is set here once; the SQL of the queries repeats it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records of the log, with ts and k beside the record's own columns."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    verdict = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "purchase", "redact").when(F.col("event_type") == "signup", "log").otherwise("allow")
    rows = rows.withColumns({"verdict": verdict, "user": F.when(k < 95, F.concat(F.lit("u"), F.col("user_id").cast("string")))})
    control = F.get(F.array(*map(F.lit, ("injection", "signatures", "budgets.tokens_per_day"))), k % 4)
    reason = F.when(k % 4 == 1, F.when(k % 3 == 0, "Matched attack signature(s) SIG-A-001, SIG-B-002 (feed v1); blocked.").when(k % 3 == 1, "Matched attack signature(s) SIG-A-002 (feed v1); blocked.").otherwise("Matched attack signature(s) SIG-X-009 (feed v1); blocked.")).otherwise(F.concat(F.lit("reason "), k.cast("string")))
    decision = lambda stage, control, verdict, reason: F.struct(F.lit(stage).alias("stage"), control.alias("control"), verdict.alias("verdict"), reason.alias("reason"), (k / 10).alias("latency_ms"))
    first = decision("inbound", F.lit("masker"), F.lit("allow"), F.lit(""))
    second = decision("input_checks", control, F.col("verdict"), reason)
    status = lambda i: F.get(F.array(*map(F.lit, ("resolved", "denied", "rejected", "empty", "error"))), (k + i) % 5)
    tables = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("Employees"))).otherwise(F.array(F.lit("products"), F.lit("EMPLOYEES"), F.lit("employees")))
    binding = lambda i: F.struct(F.lit(f"{{x{i + 1}}}").alias("name"), status(i).alias("status"), tables.alias("tables"))
    return rows.select(
        F.col("event_id").cast("string").alias("request_id"), "ts", "k", "verdict", F.col("user").alias("user_id"),
        F.when(F.col("user").isNotNull(), F.get(F.array(*map(F.lit, ("analyst", "hr_manager", "admin"))), (F.col("user_id") % 3).cast("int"))).alias("role"),
        F.when(k % 4 < 3, F.array(first, second)).otherwise(F.array(first)).alias("decisions"),
        F.slice(F.array(binding(0), binding(1)), F.lit(1), k % 3).alias("bindings"),
        F.when(k % 2 == 1, F.array(F.struct(F.get(F.array(*map(F.lit, ("send_email", "create_ticket"))), F.floor(k / 2).cast("int") % 2).alias("tool"), F.when(k % 8 == 3, "deny").otherwise("allow").alias("verdict"), F.when(k % 8 == 3, "egress").alias("rule"), F.lit("r").alias("reason"))))
        .otherwise(F.array().cast("array<struct<tool:string,verdict:string,rule:string,reason:string>>")).alias("tool_decisions"),
        (k * 10).cast("long").alias("prompt_tokens"), F.floor(F.col("value") * 10).alias("completion_tokens"), F.when(k % 2 == 0, F.lit(5).cast("long")).alias("judge_tokens"),
        F.round(F.col("value") / 1000, 6).alias("cost_usd"), F.col("value").alias("total_latency_ms"),
        F.when(k % 5 != 0, F.create_map(F.lit("inbound"), F.col("value"), F.lit("judge"), k.cast("double"))).otherwise(F.create_map().cast("map<string,double>")).alias("step_latency_ms"),
    )


#: The same view for DuckDB, as a common table expression named a.
AUDIT_SQL = """
a AS (
  SELECT *, CASE WHEN usr IS NOT NULL THEN ['analyst','hr_manager','admin'][1 + user_id % 3] END AS role,
    CASE WHEN verdict = 'allow' THEN NULL WHEN k % 4 < 3 THEN ['injection','signatures','budgets.tokens_per_day'][1 + k % 4]
         WHEN k % 8 = 3 THEN 'tool_authz.egress' END AS control,
    CASE WHEN k % 4 = 1 THEN CASE k % 3 WHEN 0 THEN 'Matched attack signature(s) SIG-A-001, SIG-B-002 (feed v1); blocked.'
         WHEN 1 THEN 'Matched attack signature(s) SIG-A-002 (feed v1); blocked.' ELSE 'Matched attack signature(s) SIG-X-009 (feed v1); blocked.' END
         ELSE 'reason ' || k END AS why,
    k * 10 AS prompt_tokens, CAST(floor(value * 10) AS BIGINT) AS completion_tokens, CASE WHEN k % 2 = 0 THEN 5 END AS judge_tokens,
    round(value / 1000, 6) AS cost_usd
  FROM (
    SELECT event_id, ts, user_id, value, CAST(json_extract(props, '$.k') AS INT) AS k,
      CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'redact' WHEN 'signup' THEN 'log' ELSE 'allow' END AS verdict,
      CASE WHEN CAST(json_extract(props, '$.k') AS INT) < 95 THEN 'u' || user_id END AS usr
    FROM events)
)
"""


def admitted_sql(limit: int, seconds: int) -> str:
    """Requests admitted one after the other, each user's admitted ones of the last span in a list."""
    return f"""WITH RECURSIVE e AS (SELECT event_id AS id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BOOLEAN) AS admitted FROM e WHERE n = 1
        UNION ALL SELECT user_id, n, id, CASE WHEN len(h) < {limit} THEN list_append(h, us) ELSE h END, len(h) < {limit}
        FROM (SELECT e.user_id, e.n, e.id, e.us, list_filter(f.held, lambda x: x > e.us - {seconds * 1_000_000}) AS h FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
      SELECT id, admitted FROM f WHERE n > 0"""
