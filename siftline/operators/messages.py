"""Client messages: their texts, what is new in them, and batches for a semantic review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import head_and_tail, parse_risk

#: How a text for review is delimited.
BEGIN, END = "<<<TEXT", "TEXT>>>"


def surface(role: Column) -> Column:
    """The scan surface of a message: results of tools, or other input."""
    return F.when(F.lower(F.trim(role)).isin("tool", "function"), "tool_result").otherwise("input")


def client_texts(messages: DataFrame) -> DataFrame:
    """S7. (request_id, turn, k, path, surface, text): every text a client wrote, in order; empty ones go.

    Order within a message: content, its parts, name, then each tool call's function name and arguments.
    """
    item = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    none = F.array().cast("array<struct<path:string,text:string>>")
    calls = F.flatten(F.transform("tool_calls", lambda c, k: F.array(
        item(F.concat(F.lit("tool_calls["), k.cast("string"), F.lit("].name")), c["function"]["name"]),
        item(F.concat(F.lit("tool_calls["), k.cast("string"), F.lit("].arguments")), c["function"]["arguments"]))))
    parts = F.transform("parts", lambda p, k: item(F.concat(F.lit("parts["), k.cast("string"), F.lit("]")), p["text"]))
    every = F.concat(F.array(item(F.lit("content"), F.col("content"))), F.coalesce(parts, none), F.array(item(F.lit("name"), F.col("name"))), F.coalesce(calls, none))
    return messages.select("request_id", "turn", surface(F.col("role")).alias("surface"), F.posexplode(every).alias("k", "x")).select("request_id", "turn", "k", "x.path", "surface", "x.text").where("text is not null and text <> ''")


def new_content(messages: DataFrame) -> DataFrame:
    """T14. Of each request the messages since its newest user message, that one included, or since the newest
    assistant message, that one excluded."""
    w = Window.partitionBy("request_id")
    kind = F.lower(F.trim("role"))
    user, assistant = F.max(F.when(kind == "user", F.col("turn"))).over(w), F.max(F.when(kind == "assistant", F.col("turn"))).over(w)
    start = F.greatest(F.coalesce(user, F.lit(-1)), F.coalesce(assistant, F.lit(-2)) + 1)
    return messages.withColumn("_start", start).where(F.col("turn") >= F.col("_start")).drop("_start")


def newest_user_text(messages: DataFrame) -> DataFrame:
    """T14. (request_id, text): content of the newest user message."""
    return messages.where(F.lower(F.trim("role")) == "user").groupBy("request_id").agg(F.max_by("content", "turn").alias("text"))


def review_batch(texts: DataFrame, most: int = 4000, text: str = "text") -> DataFrame:
    """T15. Adds review: the delimited text for a reviewer; long ones keep head and tail; delimiters in it become blanks."""
    body = F.regexp_replace(head_and_tail(F.col(text), most), r"<<<|>>>", " ")
    return texts.withColumn("review", F.concat(F.lit(f"{BEGIN}\n"), body, F.lit(f"\n{END}")))


def score_reviews(replies: DataFrame, threshold: float = 0.7, on_failure: str = "block") -> DataFrame:
    """T15. Adds risk and verdict to replies (reply): block from the threshold on; an unreadable reply gets on_failure."""
    rows = replies.withColumn("risk", parse_risk(F.col("reply")))
    return rows.withColumn("verdict", F.when(F.col("risk").isNull(), on_failure).when(F.col("risk") >= threshold, "block").otherwise("allow"))
