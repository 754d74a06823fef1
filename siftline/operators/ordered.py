"""Order statistics and positions whose work splits, also where one key holds most rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Distinct values of a key that may be sorted together; accuracy of the sketches that narrow larger ones down; most rounds.
BOUND, ACCURACY, ROUNDS = 200_000, 2_000, 6


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds the position of each row among those of its keys, from 1, by order (which has to be total; nulls first).

    Rows are dealt by ranges of (keys, order), so a key of very many rows lies in many tasks. Each range numbers its own
    part of a key; the counts of the ranges before it, a row per key and range, are added.
    """
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).drop("_n")
    within = ranged.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, "_part")]
    return within.alias("r").join(offsets.alias("o"), same).select(*[f"r.{c}" for c in rows.columns], (F.col("r._within") + F.col("o._before")).alias(name))


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """keys with count and, for each name of fractions, the value at rank ceil(fraction * count): exact.

    Selection by ranges: where a key has more rows than may be sorted together (BOUND), sketches say between which two values
    the rank lies, rows below are only counted, and rows between them are looked at again. At last the distinct values
    of the range that is left are counted and summed up. No state holds more than BOUND values of a key, or a sketch.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"))
    if (rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= BOUND:
        return _small_ranks(rows, keys, fractions)
    data = written(rows, "samples")
    sizes = written(data.groupBy(*keys).agg(F.count("*").alias("count"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.ceil(F.lit(p) * F.col("count")).alias("rank")) for n, p in fractions.items()]))
    # rank: among the rows from low to high
    asked = sizes.select(*keys, "low", "high", F.col("count").alias("inside"), ranks.alias("x")).select(*keys, "low", "high", "inside", "x.*")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    within = lambda asked: data.alias("d").join(asked.alias("a"), [*same("d", "a"), F.col("v").between(F.col("low"), F.col("high"))]).select("a.*", "v")
    for _ in range(ROUNDS):
        wide = asked.where((F.col("inside") > BOUND) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        # where the rank lies as a share differs from row to row, so all steps of the sketch are kept
        steps = [k / 64 for k in range(65)]
        cuts = within(wide).groupBy(*keys, "name").agg(F.percentile_approx("v", steps, ACCURACY).alias("cuts"))
        near = F.col("rank") / F.col("inside") * 64
        cut = lambda k: F.get("cuts", F.least(F.greatest(k, F.lit(0)), F.lit(64)).cast("int"))
        tried = written(wide.alias("a").join(cuts.alias("c"), [*same("a", "c"), F.col("a.name") == F.col("c.name")]).select("a.*", cut(F.floor(near) - 1).alias("from"), cut(F.ceil(near) + 1).alias("to")), "cuts")
        found = within(tried).groupBy(*keys, "name").agg(F.count_if(F.col("v") < F.col("from")).alias("below"), F.count_if(F.col("v").between(F.col("from"), F.col("to"))).alias("now"))
        good = (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("now"))
        pick = lambda new, old: F.when(good, new).otherwise(F.col(f"a.{old}")).alias(old)
        narrowed = tried.alias("a").join(found.alias("f"), [*same("a", "f"), F.col("a.name") == F.col("f.name")]).select(
            *[f"a.{k}" for k in keys], pick(F.col("from"), "low"), pick(F.col("to"), "high"), pick(F.col("now"), "inside"), F.col("a.name"), pick(F.col("rank") - F.col("below"), "rank")
        )
        done = asked.where((F.col("inside") <= BOUND) | (F.col("low") >= F.col("high")))
        asked = written(done.unionByName(narrowed), "asked")
    values = within(asked.where("low < high")).groupBy(*keys, "name", "rank", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("v"))
    last = values.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(*keys, "name", "v")
    last = last.unionByName(asked.where("low >= high").select(*keys, "name", F.col("low").alias("v")))
    wide = last.groupBy(*keys).pivot("name", list(fractions)).agg(F.first("v"))
    return sizes.alias("s").join(wide.alias("w"), same("s", "w")).select(*[f"s.{k}" for k in keys], "s.count", *[f"w.{n}" for n in fractions])


def _small_ranks(rows: DataFrame, keys: list[str], fractions: dict[str, float]) -> DataFrame:
    """nearest_ranks() of keys with few rows each: their distinct values are counted and summed up."""
    whole = Window.partitionBy(*keys)
    values = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    values = values.withColumns({"upto": F.sum("n").over(whole.orderBy("v")), "count": F.sum("n").over(whole)})
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * F.col("count")), F.col("v"))).alias(name) for name, p in fractions.items()]
    return values.groupBy(*keys).agg(F.max("count").alias("count"), *at)


def rank_of(fraction: float, n: int) -> int:
    """The nearest rank of a fraction of n values."""
    return max(1, math.ceil(fraction * n))
