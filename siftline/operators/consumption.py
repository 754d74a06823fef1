"""Consumption: costs, daily usage, budget checks and rate admission over tables of calls and requests."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Fixed value: how far a cost may pass its limit before a call is refused.
COST_SLACK = 1e-9


def with_cost(calls: DataFrame, prices: DataFrame, tokens: str = "tokens", out: str = "cost_usd") -> DataFrame:
    """C1. Adds the cost: tokens / 1000 times the model's price, rounded to 6; 0 without a price. prices: model, usd_per_1k."""
    rows = calls.join(prices.select("model", "usd_per_1k"), "model", "left")
    return rows.withColumn(out, F.round(F.coalesce("usd_per_1k", F.lit(0.0)) * F.col(tokens) / 1000, 6)).drop("usd_per_1k")


def daily_usage(calls: DataFrame, prices: DataFrame, judge_tokens: bool = True) -> DataFrame:
    """C2. (user_id, day, tokens, cost_usd) per UTC day. calls: user_id, ts, model, tokens, judge (a judge's call).

    Calls of the judge count only if the policy says so; zero, negative and null token counts are left out.
    """
    rows = calls.where("tokens > 0")
    if not judge_tokens:
        rows = rows.where("not coalesce(judge, false)")
    return with_cost(rows, prices).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def budget_check(calls: DataFrame, prices: DataFrame, limits: DataFrame) -> DataFrame:
    """C3. Adds used_tokens and used_cost (of the day before the call), verdict and control.

    calls: id, user_id, role, ts, model, estimate, tokens. limits: role, tokens_per_day, cost_per_day_usd, with a row
    'default'. A call passes if usage and estimate reach the limit exactly.
    """
    priced = with_cost(with_cost(calls, prices), prices, "estimate", "estimated_cost")
    # two levels: sums within a minute, and those of the day's minutes before it, so that a busy day is many groups
    day, minute = F.to_date("ts").alias("_day"), F.date_trunc("minute", "ts").alias("_minute")
    priced = priced.select("*", day, minute)
    sums = priced.groupBy("user_id", "_day", "_minute").agg(F.sum("tokens").alias("_t"), F.sum("cost_usd").alias("_c"))
    earlier = Window.partitionBy("user_id", "_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(F.col("user_id").alias("_user"), F.col("_minute").alias("_m"), none(F.sum("_t").over(earlier)).alias("_t"), none(F.sum("_c").over(earlier)).alias("_c"))
    before = Window.partitionBy("user_id", "_minute").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    used = priced.withColumns({"used_tokens": none(F.sum("tokens").over(before)), "used_cost": none(F.sum("cost_usd").over(before))})
    used = used.join(sums, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("_minute").eqNullSafe(F.col("_m")))
    used = used.withColumns({"used_tokens": F.col("used_tokens") + F.col("_t"), "used_cost": F.col("used_cost") + F.col("_c")})
    default = limits.where("role = 'default'").select(F.lit("").alias("none"), F.col("tokens_per_day").alias("dt"), F.col("cost_per_day_usd").alias("dc"))
    rows = used.join(limits.where("role <> 'default'").select("role", "tokens_per_day", "cost_per_day_usd"), "role", "left").withColumn("none", F.lit("")).join(default, "none", "left")
    tokens, cost = F.coalesce("tokens_per_day", "dt"), F.coalesce("cost_per_day_usd", "dc")
    over = F.when(F.col("used_tokens") + F.col("estimate") > tokens, "budgets.tokens_per_day").when(F.col("used_cost") + F.col("estimated_cost") > cost + COST_SLACK, "budgets.cost_per_day_usd")
    return rows.withColumn("control", over).withColumn("verdict", F.when(F.col("control").isNull(), "allow").otherwise("block")).select(*calls.columns, "used_tokens", "used_cost", "verdict", "control")


def _with_halo(requests: DataFrame, seconds: int) -> DataFrame:
    """requests with _at (microseconds), each row in its own block of `seconds` (_own) and once more in the next one: all that
    a row's trailing span can hold lies in its block."""
    span = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    places = F.explode(F.array(F.struct(F.floor(at / span).alias("block"), F.lit(True).alias("own")), F.struct((F.floor(at / span) + 1).alias("block"), F.lit(False).alias("own"))))
    return requests.withColumn("_at", at).withColumn("_p", places).select("*", F.col("_p.block").alias("_block"), F.col("_p.own").alias("_own")).drop("_p")


def trailing_load(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """C5. Adds load: the user's requests in (ts - seconds, ts], itself included. A window per user and span, not per user."""
    span = Window.partitionBy("user_id", "_block").orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return _with_halo(requests, seconds).withColumn("load", F.count("*").over(span)).where("_own").select(*requests.columns, "load")


def admission(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """C4. Adds admitted: fewer than limit admitted requests of the user lie in (ts - seconds, ts).

    Refused requests don't count, so decisions depend on earlier ones. Two exact shortcuts keep the ordered fold
    small: no state survives a gap of `seconds`, so a user's requests split into sessions at such gaps, each its own
    group; and a session whose load never passes the limit is admitted as a whole, with built-ins only. Loads, gaps and
    sessions come from blocks of `seconds`, not from a window over a whole user. Requests of a user at one time go by
    id. requests: id, user_id, ts; ids are unique.
    """
    at = F.col("_at")
    block = Window.partitionBy("user_id", "_block").orderBy("_at", "id")
    recent = Window.partitionBy("user_id", "_block").orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    rows = _with_halo(requests, seconds).withColumns({"_load": F.count("*").over(recent), "_last": F.lag("_at").over(block)}).where("_own")
    starts = rows.withColumn("_start", F.when(F.coalesce(at - F.col("_last") >= seconds * 1_000_000, F.lit(True)), at))
    # the last start in the block up to a row, or else that of the blocks before it
    ends = starts.groupBy("user_id", "_block").agg(F.max("_start").alias("_m"))
    carried = F.max("_m").over(Window.partitionBy("user_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("user_id").alias("_u"), F.col("_block").alias("_b"), carried.alias("_carried"))
    own = F.max("_start").over(block.rowsBetween(Window.unboundedPreceding, 0))
    sessions = starts.withColumn("_in", own).join(ends, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("_block") == F.col("_b")))
    sessions = written(sessions.withColumn("_session", F.coalesce("_in", "_carried")).select(*requests.columns, "_at", "_load", "_session"), "sessions")
    busy = written(sessions.where(F.col("_load") > limit).select(F.col("user_id").alias("_u"), F.col("_session").alias("_s")).distinct(), "busy-sessions")
    is_busy = F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("_session") == F.col("_s"))
    calm = sessions.join(busy, is_busy, "left_anti").select(*requests.columns, F.lit(True).alias("admitted"))
    micros = seconds * 1_000_000

    def fold(frames):
        # rows come session by session in order; what is held is the admitted requests of one span, limit at most
        held: deque = deque()
        last = None
        for rows in frames:
            out = []
            for user, session, now in zip(rows["_user"], rows["_session"], rows["_at"], strict=True):
                if (user, session) != last:
                    held.clear()
                    last = user, session
                while held and held[0] <= now - micros:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(now)
            yield pd.DataFrame({"id": rows["id"].to_numpy(), "admitted": out})

    kind = dict(requests.dtypes)["id"]
    queue = sessions.join(busy, is_busy, "left_semi").select(F.to_json(F.struct("user_id")).alias("_user"), "_session", "id", "_at").repartition("_user", "_session").sortWithinPartitions("_user", "_session", "_at", "id")
    folded = queue.mapInPandas(fold, f"id {kind}, admitted boolean")
    return calm.unionByName(requests.join(folded, "id").select(*requests.columns, "admitted"))


def estimate(json_text: Column, max_tokens: Column) -> Column:
    """C6. Tokens that a request may use: a quarter of its JSON's length, 1 at least, plus what it asks for."""
    return F.greatest(F.lit(1), F.floor(F.length(json_text) / 4)) + F.coalesce(max_tokens, F.lit(0))
