"""Dashboard, consumption and log queries over the request-log view of events, each with its DuckDB SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import consumption as C
from ..sources import audit_log
from .audit_view import AUDIT_SQL, admitted_sql, audit_view, table

#: A moment within the given events, for the sections that ask what happened lately.
NOW = datetime.datetime(2024, 1, 15, 12, 30, 30)
_NOW = "TIMESTAMP '2024-01-15 12:30:30'"
_FEED = [("SIG-A-001", "execution"), ("SIG-A-002", "execution"), ("SIG-B-002", "deserialization")]
_LIMITS = [("default", 20000, 2.0), ("hr_manager", 200000, None), ("admin", None, 5.0)]
_PRICES = [("m0", 0.5), ("m1", 0.25), ("m2", 2.0)]
_TOKENS = "prompt_tokens + completion_tokens + coalesce(judge_tokens, 0)"
_LIMITS_SQL = "lim(role, t, c) AS (VALUES ('hr_manager', 200000, 2.0), ('admin', 20000, 5.0), ('analyst', 20000, 2.0))"


def feed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FEED, "id string, category string")


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LIMITS, "role string, tokens_per_day long, cost_per_day_usd double")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PRICES, "model string, usd_per_1k double")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as model calls: id, user_id, role, ts, model, tokens, estimate, judge."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.when(F.col("user_id") % 2 == 0, "hr_manager").otherwise("analyst").alias("role"), "ts",
        F.concat(F.lit("m"), (k % 4).cast("string")).alias("model"), (k * 100).cast("long").alias("tokens"), (k * 90).cast("long").alias("estimate"), (k % 10 == 0).alias("judge"),
    )


_CALLS_SQL = """calls AS (SELECT event_id AS id, user_id, CASE WHEN user_id % 2 = 0 THEN 'hr_manager' ELSE 'analyst' END AS role, ts, 'm' || (k % 4) AS model,
  k * 100 AS tokens, k * 90 AS estimate, k % 10 = 0 AS judge,
  round(coalesce(CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 2.0 END, 0) * k * 100 / 1000, 6) AS cost,
  round(coalesce(CASE k % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 2.0 END, 0) * k * 90 / 1000, 6) AS ecost
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""

QUERIES = {
    "a0_deciding_control": lambda s, d: A.deciding(audit_view(s, d)).select("request_id", "control", F.col("decided_reason").alias("reason")),
    "a1_requests_by_verdict": lambda s, d: A.requests_by_verdict(audit_view(s, d)),
    "a2_blocks_by_control": lambda s, d: A.blocks_by_control(audit_view(s, d)),
    "a2_blocks_by_control_today": lambda s, d: A.blocks_by_control(A.of_day(audit_view(s, d), NOW)),
    "a3_tokens_and_cost": lambda s, d: A.tokens_and_cost(audit_view(s, d), limits(s)).select("user_id", "role", "tokens", F.round("cost_usd", 5).alias("cost_usd"), "tokens_limit", "cost_limit"),
    "a4_last_requests": lambda s, d: A.last_requests(audit_view(s, d)),
    "a5_blocks_by_category": lambda s, d: A.blocks_by_category(audit_view(s, d), feed(s)),
    "a6_over_time": lambda s, d: A.over_time(audit_view(s, d), NOW),
    "a7_blocks_by_user": lambda s, d: A.blocks_by_user(audit_view(s, d)),
    "a8_binding_outcomes": lambda s, d: A.binding_outcomes(audit_view(s, d)),
    "a9_tool_outcomes": lambda s, d: A.tool_outcomes(audit_view(s, d)),
    "a10_latency_by_step": lambda s, d: A.latency_by_step(audit_view(s, d)),
    "a11_totals": lambda s, d: A.totals(audit_view(s, d)),
    "a12_budget_bars": lambda s, d: A.budget_bars(A.tokens_and_cost(A.of_day(audit_view(s, d), NOW), limits(s))).select("user_id", F.round("tokens_share", 7).alias("tokens_share"), F.round("cost_share", 7).alias("cost_share")),
    "a13_feed_rows": lambda s, d: A.feed_rows(A.last_requests(audit_view(s, d))),
    "a14_final_verdict": lambda s, d: A.final_verdict(audit_view(s, d)).groupBy("verdict", "final_verdict").agg(F.count("*").alias("n")),
    "a15_latency_by_kind": lambda s, d: A.latency_by_kind(
        table(s, d, "benchmark").select((F.col("item_id") + 1).alias("n"), F.when(F.col("item_id") % 3 == 0, "plain").otherwise("data").alias("kind"), F.lit("allow").alias("expected")), audit_view(s, d))[0],
    "a16_model_comparison": lambda s, d: A.model_comparison(calls(s, d).select(
        "model", F.when(F.col("tokens") % 300 == 0, "data").otherwise("plain").alias("kind"), (F.col("tokens") % 500 == 0).alias("called_query_data"),
        F.array(F.col("tokens") % 700 == 0, F.col("tokens") % 200 == 0).alias("sql_ok"), F.col("judge").alias("used_placeholder"), (F.col("tokens") / 10).alias("latency_s"), F.lit(None).cast("string").alias("error")))
        .select("model", *[F.round(c, 6).alias(c) for c in ("queried", "valid", "used", "latency", "score")], "rank"),
    "a17_recent_samples": lambda s, d: A.recent_samples(table(s, d, "events").select(F.col("event_type").alias("step"), "ts", F.col("value").alias("ms"), F.col("event_id").alias("id")), 200),
    "c1_cost_of_calls": lambda s, d: C.with_cost(calls(s, d), prices(s)).select("id", F.round("cost_usd", 6).alias("cost_usd")),
    "c2_daily_usage": lambda s, d: C.daily_usage(calls(s, d), prices(s)).select("user_id", "day", "tokens", F.round("cost_usd", 4).alias("cost_usd")),
    "c3_budget_check": lambda s, d: C.budget_check(calls(s, d), prices(s), limits(s)).select("id", "used_tokens", F.round("used_cost", 4).alias("used_cost"), "verdict", "control"),
    "c4_admission": lambda s, d: C.admission(calls(s, d).select("id", "user_id", "ts"), 2, 3600).select("id", "admitted"),
    "c5_trailing_load": lambda s, d: C.trailing_load(calls(s, d).select("id", "user_id", "ts"), 3600).select("id", "load"),
    "s1_log_in_range": lambda s, d: audit_log.in_range(audit_view(s, d).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).drop("ts"), datetime.datetime(2024, 1, 3), datetime.datetime(2024, 1, 9)).select("request_id", "verdict"),
    "s3_csv_summaries": lambda s, d: audit_view(s, d).select(
        "request_id", audit_log.safe_cell(F.array_join(F.transform("decisions", lambda x: F.concat(x["stage"], F.lit("/"), x["control"], F.lit(": "), x["verdict"])), "; ")).alias("decisions"),
        audit_log.safe_cell(F.concat(F.lit("-"), F.col("verdict"))).alias("verdict")),
}

SQL = {
    "a0_deciding_control": "SELECT CAST(event_id AS VARCHAR) AS request_id, control, CASE WHEN control IS NULL THEN NULL WHEN control = 'tool_authz.egress' THEN 'r' ELSE why END AS reason FROM a",
    "a1_requests_by_verdict": "SELECT v AS verdict, (SELECT count(*) FROM a WHERE verdict = v) AS requests FROM (VALUES ('allow'),('log'),('redact'),('block')) x(v)",
    "a2_blocks_by_control": "SELECT coalesce(control, 'unknown') AS control, count(*) AS blocks FROM a WHERE verdict = 'block' GROUP BY 1",
    "a2_blocks_by_control_today": "SELECT coalesce(control, 'unknown') AS control, count(*) AS blocks FROM a WHERE verdict = 'block' AND CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1",
    "a3_tokens_and_cost": f"SELECT u.usr AS user_id, u.role, u.tokens, u.cost_usd, CAST(lim.t AS BIGINT) AS tokens_limit, CAST(lim.c AS DOUBLE) AS cost_limit FROM (SELECT usr, arg_min(role, (ts, event_id)) AS role, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, round(sum(cost_usd), 5) AS cost_usd FROM a WHERE usr IS NOT NULL GROUP BY usr) u JOIN lim USING (role)",
    "a4_last_requests": "SELECT ts, CAST(event_id AS VARCHAR) AS request_id, usr AS user_id, role, verdict, control, CASE WHEN control IS NULL THEN NULL WHEN control = 'tool_authz.egress' THEN 'r' ELSE why END AS reason FROM a ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 50",
    "a5_blocks_by_category": "SELECT category, count(*) AS blocks FROM (SELECT event_id, unnest(CASE k % 3 WHEN 0 THEN ['execution','deserialization'] WHEN 1 THEN ['execution'] ELSE ['unknown'] END) AS category FROM a WHERE verdict = 'block' AND k % 4 = 1) GROUP BY 1",
    "a6_over_time": f"SELECT m AS minute, count(event_id) AS requests, count(*) FILTER (WHERE verdict = 'block') AS blocks FROM (SELECT unnest(generate_series(date_trunc('minute', {_NOW}) - INTERVAL 59 MINUTE, date_trunc('minute', {_NOW}), INTERVAL 1 MINUTE)) AS m) g LEFT JOIN a ON date_trunc('minute', a.ts) = g.m GROUP BY m",
    "a7_blocks_by_user": "SELECT usr AS user_id, count(*) AS blocks FROM a WHERE verdict = 'block' AND usr IS NOT NULL GROUP BY 1",
    "a8_binding_outcomes": "SELECT role, t AS \"table\", " + ", ".join(f"count(*) FILTER (WHERE st = '{s}') AS {s}" for s in A.STATUSES) + " FROM (SELECT coalesce(role, '(unauthenticated)') AS role, ['resolved','denied','rejected','empty','error'][1 + (k + i) % 5] AS st, unnest(CASE WHEN k % 7 = 0 THEN ['(none)'] WHEN k % 2 = 0 THEN ['employees'] ELSE ['products','employees'] END) AS t FROM a, (VALUES (0),(1)) n(i) WHERE i < k % 3) GROUP BY 1, 2",
    "a9_tool_outcomes": "SELECT CASE (k // 2) % 2 WHEN 0 THEN 'send_email' ELSE 'create_ticket' END AS tool, count(*) FILTER (WHERE k % 8 <> 3) AS allow, count(*) FILTER (WHERE k % 8 = 3) AS deny FROM a WHERE k % 2 = 1 GROUP BY 1",
    "a10_latency_by_step": "SELECT step, count(*) AS count, round(quantile_disc(ms, 0.5), 3) AS median, round(quantile_disc(ms, 0.95), 3) AS p95 FROM (SELECT unnest(['inbound','judge','total']) AS step, unnest([value, CAST(k AS DOUBLE), value]) AS ms FROM a WHERE k % 5 <> 0) GROUP BY 1",
    "a11_totals": f"SELECT count(*) FILTER (WHERE verdict = 'allow') AS allowed, count(*) FILTER (WHERE verdict = 'block') AS blocked, count(*) FILTER (WHERE verdict = 'redact') AS redacted, CAST(coalesce(sum({_TOKENS}) FILTER (WHERE usr IS NOT NULL), 0) AS BIGINT) AS tokens FROM a",
    "a12_budget_bars": f"SELECT u.usr AS user_id, round(least(1.0, tokens / CAST(t AS DOUBLE)), 7) AS tokens_share, round(least(1.0, cost / CAST(c AS DOUBLE)), 7) AS cost_share FROM (SELECT usr, arg_min(role, (ts, event_id)) AS role, sum({_TOKENS}) AS tokens, round(sum(cost_usd), 6) AS cost FROM a WHERE usr IS NOT NULL AND CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY usr) u JOIN lim USING (role)",
    "a13_feed_rows": "SELECT strftime(ts, '%H:%M') AS minute, CAST(event_id AS VARCHAR) AS request_id, coalesce(usr, '(unauthenticated)') AS user_id, coalesce(role, '') AS role, verdict, coalesce(control, '') AS control, CASE WHEN control IS NULL THEN '' WHEN control = 'tool_authz.egress' THEN 'r' ELSE why END AS reason FROM a ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 50",
    "a14_final_verdict": "SELECT verdict, CASE WHEN k % 4 < 3 THEN verdict WHEN k % 8 = 3 THEN 'redact' ELSE 'allow' END AS final_verdict, count(*) AS n FROM a GROUP BY 1, 2",
    "a15_latency_by_kind": "SELECT kind, count(*) AS count, round(quantile_disc(value, 0.5), 2) AS median, round(quantile_disc(value, 0.95), 2) AS p95 FROM (SELECT unnest([p.kind, 'all']) AS kind, value FROM (SELECT item_id + 1 AS n, CASE WHEN item_id % 3 = 0 THEN 'plain' ELSE 'data' END AS kind FROM benchmark) p JOIN (SELECT row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) AS n, value FROM a WHERE ts < TIMESTAMP '2024-01-03') r USING (n)) GROUP BY 1",
    "a16_model_comparison": "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, latency, model) AS INT) AS rank FROM (SELECT model, round(q, 6) AS queried, round(v, 6) AS valid, round(u, 6) AS used, round(l, 6) AS latency, round((coalesce(q,0)+coalesce(v,0)+coalesce(u,0))/3, 6) AS score FROM (SELECT model, avg(CASE WHEN tokens % 300 = 0 THEN CAST(tokens % 500 = 0 AS INT) END) AS q, avg((CAST(tokens % 700 = 0 AS INT) + CAST(tokens % 200 = 0 AS INT)) / 2.0) AS v, avg(CASE WHEN tokens % 300 = 0 THEN CAST(judge AS INT) END) AS u, quantile_cont(tokens / 10.0, 0.5) AS l FROM calls GROUP BY model))",
    "a17_recent_samples": "SELECT step, count(*) AS count, round(quantile_disc(ms, 0.5), 3) AS median, round(quantile_disc(ms, 0.95), 3) AS p95 FROM (SELECT event_type AS step, value AS ms FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200) GROUP BY 1",
    "c1_cost_of_calls": "SELECT id, cost AS cost_usd FROM calls",
    "c2_daily_usage": "SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost_usd FROM calls WHERE tokens > 0 GROUP BY 1, 2",
    "c3_budget_check": "SELECT id, used_tokens, round(used_cost, 4) AS used_cost, CASE WHEN over IS NULL THEN 'allow' ELSE 'block' END AS verdict, over AS control FROM (SELECT *, CASE WHEN used_tokens + estimate > lim.t THEN 'budgets.tokens_per_day' WHEN used_cost + ecost > lim.c + 1e-9 THEN 'budgets.cost_per_day_usd' END AS over FROM (SELECT *, CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS used_tokens, coalesce(sum(cost) OVER w, 0) AS used_cost FROM calls WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) JOIN lim USING (role))",
    "c4_admission": admitted_sql(2, 3600),
    "c5_trailing_load": "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS load FROM calls",
    "s1_log_in_range": "SELECT CAST(event_id AS VARCHAR) AS request_id, verdict FROM a WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'",
    "s3_csv_summaries": "SELECT CAST(event_id AS VARCHAR) AS request_id, 'inbound/masker: allow' || CASE WHEN k % 4 < 3 THEN '; input_checks/' || ['injection','signatures','budgets.tokens_per_day'][1 + k % 4] || ': ' || verdict ELSE '' END AS decisions, '''-' || verdict AS verdict FROM a",
}


def sql() -> dict[str, str]:
    return {k: v if v.startswith("WITH") else f"WITH {AUDIT_SQL}, {_CALLS_SQL}, {_LIMITS_SQL} {v}" for k, v in SQL.items()}
