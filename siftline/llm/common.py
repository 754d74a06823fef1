"""What the operators of this subpackage share: word splitting, folds, repeated ids, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

#: The blank characters that part words, and the same set with their negation, as Java regexes.
BLANK = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_words(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def kind_of(df: DataFrame, column: str = "doc_id") -> str:
    """The type of a column, as schemas of helpers spell it: ids need not be numbers."""
    return df.schema[column].dataType.simpleString()


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(doc_id) of the ids that several rows have."""
    return written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated-ids")


def one_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with one row per doc_id, that of the least text; rows with a null doc_id stay as they are.

    Ids alone are counted first, so that texts are shuffled only where an id does repeat.
    """
    again = repeated_ids(docs)
    if again.isEmpty():
        return docs
    least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return written(docs.join(again, "doc_id", "left_anti").unionByName(least), "documents")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b), a != b: rows (id, component), component the least id that can be reached.

    Alternates the large-star and small-star contractions, both joins and groupings only, until all
    edges lead to the least id of their component; that takes a number of rounds logarithmic in the longest path. Minima are written
    before they are joined: of two plain sides Spark can split the rows of a hub that has very many neighbours.
    """
    edges = written(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), name)
    while True:
        # stars: no vertex has two edges up, and none has edges up and down
        ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large")
        down = written(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-down")
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = written(small, name)
