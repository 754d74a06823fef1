"""Streams with a state per user, in one value each, so that every state store of Spark can hold it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.leaks import AFTER, BEFORE

LATE = "10 minutes"
#: Values remembered per user: older ones are forgotten, as L7 has it.
MOST_VALUES = 1000


def _keep(state, value: tuple, until_us: int) -> None:
    """Stores the state until the watermark passes until_us."""
    state.update(value)
    state.setTimeoutTimestamp(max(until_us // 1000, state.getCurrentWatermarkMs()) + 1)


def admission(requests: DataFrame, limit: int, seconds: int = 60, late: str = LATE) -> DataFrame:
    """R4. (user_id, id, admitted) of requests (user_id, id, ts): C4 as a stream.

    The state is a user's admitted timestamps of the last span, limit at most; it goes once the watermark has passed them.
    Rows of a micro-batch go by (ts, id), and later ones than the watermark are dropped.
    """
    span, kinds = seconds * 1_000_000, dict(requests.dtypes)

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for now in batch["at"].tolist():
            held = [x for x in held if x > now - span]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(now)
        if held:
            _keep(state, (held,), held[-1] + span)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": key[0], "id": batch["id"].to_numpy(), "admitted": out})

    rows = requests.withWatermark("ts", late).select("user_id", "id", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, f"user_id {kinds['user_id']}, id {kinds['id']}, admitted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def remasked(messages: DataFrame, issued: DataFrame, ttl_seconds: int, marker: str = "[value]", late: str = LATE, salts: int = 8) -> DataFrame:
    """R5. (id, user_id, masked, replaced) of messages (id, user_id, role, ts, text): L7 and L8 as a stream.

    Assistant messages lose the user's values of issued (user_id, value, issued_at) that live when they come: issued in
    (ts - ttl, ts], the newest MOST_VALUES. The state is the user's live values; what no later message can meet goes
    with the watermark. A user's messages are dealt over `salts` groups that all get the user's values, so that
    a user who fills the stream doesn't fill one task. A value has to come no later than the messages it is masked in.
    """
    ttl, kinds = ttl_seconds * 1_000_000, dict(messages.dtypes)
    kind = f"id {kinds['id']}, user_id {kinds['user_id']}, masked string, replaced int"

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        batch = pd.concat(list(frames)).sort_values(["at", "message"])
        out = []
        for row in batch.itertuples():
            if not row.message:
                known[row.text] = max(row.at, known.get(row.text, row.at))
                continue
            live = [v for v, at in known.items() if row.at - ttl < at <= row.at and v in row.text]
            masked, n = row.text, 0
            if live:
                whole = "|".join(re.escape(v) for v in sorted(live, key=lambda v: (-len(v), v)))
                masked, n = re.subn(f"{BEFORE}(?:{whole}){AFTER}", lambda _: marker, row.text)
            out.append((row.id, masked, n))
        gone = state.getCurrentWatermarkMs() * 1000 - ttl
        newest = sorted(((at, v) for v, at in known.items() if at > gone), key=lambda x: (-x[0], x[1]))[:MOST_VALUES]
        if newest:
            _keep(state, ([v for _, v in newest], [at for at, _ in newest]), newest[0][0] + ttl)
        elif state.exists:
            state.remove()
        ids = pd.Series([x[0] for x in out], dtype=batch["id"].dtype)
        yield pd.DataFrame({"id": ids, "user_id": key[0], "masked": [x[1] for x in out], "replaced": [x[2] for x in out]})

    wanted = "role = 'assistant' and text is not null"
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at")
    texts = messages.where(wanted).withWatermark("ts", late).select("user_id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "ts", at("ts"), F.lit(True).alias("message"), "id", "text")
    values = issued.where("trim(value) <> ''").withWatermark("issued_at", late).select(
        "user_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("issued_at").alias("ts"), at("issued_at"), F.lit(False).alias("message"), F.lit(None).cast(kinds["id"]).alias("id"), F.col("value").alias("text")
    )
    done = texts.unionByName(values).groupBy("user_id", "salt").applyInPandasWithState(fold, kind, "value array<string>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    others = messages.where(f"not coalesce({wanted}, false)").select("id", "user_id", F.col("text").alias("masked"), F.lit(0).alias("replaced"))
    return done.unionByName(others)
