"""Audit analytics: the sections of a security dashboard over the request log.

Every section takes the log (see schemas.AUDIT, with its timestamp read into ts) and returns a small DataFrame. Where
order matters it is (ts, request_id). Aggregations have few keys, so that partial aggregation leaves almost nothing
to shuffle; the small dimension tables of the policy are joined by whatever strategy Catalyst picks for their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import nearest_ranks

#: Verdicts by severity, and the states of a data query.
VERDICTS = ("allow", "log", "redact", "block")
STATUSES = ("resolved", "denied", "rejected", "empty", "error")
NOBODY = "(unauthenticated)"


def severity(verdict: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), verdict) - 1
    return F.coalesce(rank, F.lit(-1))


def deciding(log: DataFrame) -> DataFrame:
    """A0. Adds control and decided_reason: of the first decision with the record's verdict, else of a denied tool call."""
    first = F.get(F.filter("decisions", lambda d: d["verdict"] == F.col("verdict")), F.lit(0))
    denied = F.get(F.filter("tool_decisions", lambda t: t["verdict"] == "deny"), F.lit(0))
    calm = F.col("verdict") == "allow"
    return log.withColumns({
        "control": F.when(~calm, F.coalesce(first["control"], F.when(denied.isNotNull(), F.concat(F.lit("tool_authz."), F.coalesce(denied["rule"], F.lit("")))))),
        "decided_reason": F.when(~calm, F.coalesce(first["reason"], denied["reason"])),
    })


def of_day(log: DataFrame, now) -> DataFrame:
    """Records of the UTC day of now."""
    return log.where(F.to_date("ts") == F.to_date(F.lit(now)))


def requests_by_verdict(log: DataFrame) -> DataFrame:
    """A1. (verdict, requests) with every verdict, zero included."""
    sums = log.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("requests")) for v in VERDICTS])).alias("x")).select("x.*")


def _ranked(rows: DataFrame, key: str, count: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key)


def blocks_by_control(log: DataFrame) -> DataFrame:
    """A2. (control, blocks), most first."""
    blocked = deciding(log).where("verdict = 'block'").select(F.coalesce("control", F.lit("unknown")).alias("control"))
    return _ranked(blocked, "control", "blocks")


def effective_limits(limits: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, key, value): a role's own limit, or else the default, per key. limits: role or 'default', key, value."""
    default = limits.where("role = 'default'").select("key", F.col("value").alias("d"))
    own = limits.where("role <> 'default'")
    pairs = roles.select("role").distinct().join(limits.select("key").distinct(), how="cross")  # both are policy tables
    return pairs.join(own, ["role", "key"], "left").join(default, "key", "left").select("role", "key", F.coalesce("value", "d").alias("value"))


def tokens_and_cost(log: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """A3. (user_id, role, tokens, cost_usd) per user, plus tokens_limit and cost_limit where limits are given.

    The role is that of the user's first record. limits: role, tokens_per_day, cost_per_day_usd with a row 'default'.
    """
    tokens = sum((F.coalesce(c, F.lit(0)) for c in ("completion_tokens", "judge_tokens")), F.coalesce("prompt_tokens", F.lit(0)))
    rows = log.where("user_id is not null").groupBy("user_id").agg(
        F.min_by("role", F.struct("ts", "request_id")).alias("role"), F.sum(tokens).alias("tokens"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd")
    )
    if limits is None:
        return rows
    default = limits.where("role = 'default'").select(F.col("tokens_per_day").alias("dt"), F.col("cost_per_day_usd").alias("dc"), F.lit(1).alias("one"))
    own = limits.where("role <> 'default'").select("role", "tokens_per_day", "cost_per_day_usd")
    joined = rows.join(own, "role", "left").withColumn("one", F.lit(1)).join(default, "one", "left")
    return joined.select("user_id", "role", "tokens", "cost_usd", F.coalesce("tokens_per_day", "dt").alias("tokens_limit"), F.coalesce("cost_per_day_usd", "dc").alias("cost_limit"))


def last_requests(log: DataFrame, n: int = 50) -> DataFrame:
    """A4. The n newest requests, newest first: a top-n, not a sort of the log."""
    rows = deciding(log).orderBy(F.desc("ts"), F.desc("request_id")).limit(n)
    return rows.select("ts", "request_id", "user_id", "role", "verdict", "control", F.col("decided_reason").alias("reason"))


def blocks_by_category(log: DataFrame, feed: DataFrame) -> DataFrame:
    """A5. (category, blocks): blocked records count once per category of the signatures that blocked them.

    feed: id, category. A blocking decision that names no known id counts as 'unknown'.
    """
    named = (
        log.where("verdict = 'block'").select("request_id", F.posexplode(F.filter("decisions", lambda d: (d["control"] == "signatures") & (d["verdict"] == "block"))).alias("n", "d"))
        .select("request_id", "n", F.explode(F.array_distinct(F.split("d.reason", r"[\s,;()]+"))).alias("id"))
    )
    known = named.join(feed.select("id", "category"), "id", "left")
    per_decision = known.groupBy("request_id", "n").agg(F.collect_set("category").alias("c"))
    each = per_decision.select("request_id", F.explode(F.when(F.size("c") == 0, F.array(F.lit("unknown"))).otherwise(F.col("c"))).alias("category")).distinct()
    return _ranked(each, "category", "blocks")


def over_time(log: DataFrame, now, minutes: int = 60) -> DataFrame:
    """A6. (minute, requests, blocks) of the last minutes up to now's, empty ones included."""
    spark = log.sparkSession
    last = F.date_trunc("minute", F.lit(now).cast("timestamp"))
    grid = spark.range(minutes).select((last - F.make_interval(mins=F.lit(minutes - 1) - F.col("id").cast("int"))).alias("minute"))
    counts = log.where((F.col("ts") >= last - F.make_interval(mins=F.lit(minutes - 1))) & (F.col("ts") < last + F.make_interval(mins=F.lit(1)))).groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("verdict") == "block").alias("blocks")
    )
    return grid.join(counts, "minute", "left").select("minute", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("blocks", F.lit(0)).alias("blocks")).orderBy("minute")


def blocks_by_user(log: DataFrame) -> DataFrame:
    """A7. (user_id, blocks) of known users, most first."""
    return _ranked(log.where("verdict = 'block' and user_id is not null"), "user_id", "blocks")


def binding_outcomes(log: DataFrame) -> DataFrame:
    """A8. Data queries by role and table, a column per status. Each table counts once per query; none is '(none)'."""
    each = log.select(F.coalesce("role", F.lit(NOBODY)).alias("role"), F.explode("bindings").alias("b")).select(
        "role", F.col("b.status").alias("status"),
        F.explode(F.when(F.coalesce(F.size("b.tables"), F.lit(0)) <= 0, F.array(F.lit("(none)"))).otherwise(F.array_distinct(F.transform("b.tables", F.lower)))).alias("table"),
    )
    return each.where(F.col("status").isin(*STATUSES)).groupBy("role", "table").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).orderBy("role", "table")


def tool_outcomes(log: DataFrame) -> DataFrame:
    """A9. (tool, allow, deny)."""
    each = log.select(F.explode("tool_decisions").alias("t")).select("t.tool", "t.verdict").where("verdict in ('allow', 'deny')")
    return each.groupBy("tool").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "deny")]).orderBy("tool")


def _steps(log: DataFrame) -> DataFrame:
    """(step, ms) of each record that has steps, with its total as the step 'total'; null and infinite values go."""
    each = log.where("cardinality(step_latency_ms) > 0").select(F.explode(F.map_concat("step_latency_ms", F.create_map(F.lit("total"), F.col("total_latency_ms")))).alias("step", "ms"))
    return each.where("ms is not null and not isnan(ms) and abs(ms) < double('Infinity')")


def nearest_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys with count, median and p95 by nearest rank, rounded to 3 places; exact, by selection."""
    found = nearest_ranks(rows, keys, value, {"median": 0.5, "p95": 0.95})
    return found.select(*keys, "count", F.round("median", 3).alias("median"), F.round("p95", 3).alias("p95"))


def latency_by_step(log: DataFrame) -> DataFrame:
    """A10. (step, count, median, p95) in milliseconds."""
    return nearest_rank(_steps(log), ["step"], "ms").orderBy("step")


def latency_by_step_approx(log: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """A10 for very large logs: ranks are off by at most count / accuracy, and the state per step is bounded."""
    return _steps(log).groupBy("step").agg(F.count("*").alias("count"), *[F.round(F.percentile_approx("ms", p, accuracy), 3).alias(n) for n, p in (("median", 0.5), ("p95", 0.95))]).orderBy("step")


def totals(log: DataFrame) -> DataFrame:
    """A11. One row: allowed, blocked, redacted, tokens (of known users)."""
    tokens = sum((F.coalesce(c, F.lit(0)) for c in ("completion_tokens", "judge_tokens")), F.coalesce("prompt_tokens", F.lit(0)))
    names = {"allowed": "allow", "blocked": "block", "redacted": "redact"}
    return log.agg(*[F.count_if(F.col("verdict") == v).alias(n) for n, v in names.items()], F.coalesce(F.sum(F.when(F.col("user_id").isNotNull(), tokens)), F.lit(0)).alias("tokens"))


def budget_bars(usage: DataFrame) -> DataFrame:
    """A12. Adds tokens_share and cost_share, at most 1; 0 without a limit. usage: of tokens_and_cost with limits."""
    share = lambda used, limit: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(used).cast("double"), F.col(limit)), F.lit(0.0)))
    return usage.withColumns({"tokens_share": share("tokens", "tokens_limit"), "cost_share": share("cost_usd", "cost_limit")})


def feed_rows(last: DataFrame) -> DataFrame:
    """A13. last_requests for a panel: no nulls, the minute as text."""
    return last.select(
        F.date_format("ts", "HH:mm").alias("minute"), "request_id", F.coalesce("user_id", F.lit(NOBODY)).alias("user_id"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "verdict", "control", "reason")],
    )


def final_verdict(log: DataFrame) -> DataFrame:
    """A14. Adds final_verdict: the worst of the decisions; a denied tool call makes it redact at least.

    If log has tool_calls (how many the model asked for), calls_left (how many passed all checks) and answer, a request whose
    calls were all taken away, with no answer beside them, is blocked.
    """
    worst = F.coalesce(F.array_max(F.transform("decisions", lambda d: severity(d["verdict"]))), F.lit(0))
    denied = F.exists("tool_decisions", lambda t: t["verdict"] == "deny")
    rank = F.greatest(worst, F.when(F.coalesce(denied, F.lit(False)), F.lit(2)).otherwise(F.lit(0)), F.lit(0))
    if {"tool_calls", "calls_left", "answer"} <= set(log.columns):
        nothing = (F.col("tool_calls") > 0) & (F.coalesce("calls_left", F.lit(0)) == 0) & (F.coalesce("answer", F.lit("")) == "")
        rank = F.when(F.coalesce(nothing, F.lit(False)), F.lit(3)).otherwise(rank)
    return log.withColumn("final_verdict", F.get(F.array(*map(F.lit, VERDICTS)), rank.cast("int")))


def numbered(log: DataFrame) -> DataFrame:
    """Adds n: the position of each record by ts, then request_id, from 1; nulls come first.

    Records are numbered within their second; the counts of seconds within a day, and of days, are added.
    """
    rows = log.withColumn("_second", F.date_trunc("second", "ts"))
    seconds = rows.groupBy("_second").agg(F.count("*").alias("_n")).withColumn("_day", F.to_date("_second"))
    days = seconds.groupBy("_day").agg(F.sum("_n").alias("_n"))
    sum_before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # as many rows as days
    days = days.select(F.col("_day").alias("_d"), sum_before(Window.orderBy("_day")).alias("_days"))
    seconds = seconds.select(F.col("_second").alias("_s"), "_day", sum_before(Window.partitionBy("_day").orderBy("_second")).alias("_seconds"))
    before = seconds.join(days, F.col("_day").eqNullSafe(F.col("_d"))).select("_s", (F.col("_days") + F.col("_seconds")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_second").orderBy("ts", "request_id"))
    return rows.withColumn("_within", within).join(before, F.col("_second").eqNullSafe(F.col("_s"))).withColumn("n", F.col("_before") + F.col("_within")).drop("_second", "_within", "_s", "_before")


def latency_by_kind(prompts: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A15. Pairs the n-th prompt (n, kind, expected) with the n-th record: latencies by kind, and wrong verdicts."""
    both = prompts.join(numbered(log), "n")
    kinds = both.select("kind", "total_latency_ms").unionByName(both.select(F.lit("all").alias("kind"), "total_latency_ms"))
    wrong = both.where("verdict <> expected").select("n", "kind", "expected", "verdict")
    return nearest_rank(kinds, ["kind"], "total_latency_ms").select("kind", "count", F.round("median", 2).alias("median"), F.round("p95", 2).alias("p95")), wrong


def model_comparison(runs: DataFrame) -> DataFrame:
    """A16. Per model the shares of data prompts that queried, of valid queries and of used placeholders, the
    interpolated median latency, their mean as score, and rank by score, then latency.

    runs: model, kind, called_query_data, sql_ok array<boolean>, used_placeholder, latency_s, error.
    """
    share = lambda x: F.avg(x.cast("double"))
    data = F.col("kind") == "data"
    rows = runs.groupBy("model").agg(
        share(F.when(data, F.col("called_query_data"))).alias("queried"),
        (F.sum(F.size(F.filter("sql_ok", lambda x: x))) / F.nullif(F.sum(F.size("sql_ok")), F.lit(0))).alias("valid"),
        share(F.when(data, F.col("used_placeholder"))).alias("used"),
        F.expr("percentile(latency_s, 0.5)").alias("latency"),
    )
    score = sum((F.coalesce(c, F.lit(0.0)) for c in ("valid", "used")), F.coalesce("queried", F.lit(0.0))) / 3
    rows = rows.withColumn("score", F.round(score, 6))
    # as many rows as models
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc_nulls_last("latency"), "model")))


def recent_samples(samples: DataFrame, n: int = 1000) -> DataFrame:
    """A17. (step, count, median, p95) over the n newest samples (step, ts, ms, id) of each step.

    The window filters by row_number, so each task keeps n rows of a step before the shuffle.
    """
    newest = samples.withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("r") <= n)
    return nearest_rank(newest, ["step"], "ms").orderBy("step")


def blocked_models(states: DataFrame) -> DataFrame:
    """A18. One row (models, blocked) of the models' pin states (name, status; see G11): all but ok and unpinned block."""
    return states.agg(F.count("*").alias("models"), F.count_if(~F.col("status").isin("ok", "unpinned")).alias("blocked"))


def control_states(controls: DataFrame, disabled: DataFrame) -> DataFrame:
    """A18. Adds status: off if the control or a control above it is disabled, else on. controls: control, value, source."""
    c, d = controls.alias("c"), disabled.select(F.col("control").alias("d")).distinct()
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("control", r"\."))), lambda k: F.array_join(F.slice(F.split("control", r"\."), F.lit(1), k), "."))).alias("d")
    off = c.select("control", above).join(d, "d").select("control").distinct().withColumn("hit", F.lit(True))
    return controls.join(off, "control", "left").select(*controls.columns, F.when(F.col("hit"), "off").otherwise("on").alias("status"))
