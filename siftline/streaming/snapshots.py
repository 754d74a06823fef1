"""Tables that a stream keeps up to date: keyed rows in buckets, each batch a new version of the buckets it touches.

A manifest, one small file per version, says which version of each bucket counts. It is written last, so readers see a
batch whole or not at all, and a batch that is tried again writes the same version again. Only touched buckets are read
and written; versions that no manifest in use names may be deleted.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir

BUCKETS = 64
_VERSION, _BUCKET = "snapshot_version", "snapshot_bucket"


def _manifest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """Bucket -> version, by the newest manifest, or the newest one of a version less than `below`."""
    try:
        rows = spark.read.schema("version long, current map<string,long>").json(f"{path}/manifest/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    newest = (rows if below is None else rows.where(F.col("version") < below)).orderBy(F.desc("version")).first()
    return {int(b): v for b, v in newest["current"].items()} if newest else {}


def _read(spark: SparkSession, path: str, schema, current: dict[int, int]) -> DataFrame:
    if not current:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/{_VERSION}={v}/{_BUCKET}={b}" for b, v in sorted(current.items())]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(schema.names)


def upsert(batch: DataFrame, path: str, keys: list[str], version: int, buckets: int = BUCKETS) -> None:
    """Rows of the batch, one per key, replace those of their keys in the table at path. The same version again has the same
    effect. Null keys are equal to each other."""
    spark, names = batch.sparkSession, batch.columns
    before = _manifest(spark, path, version)
    rows = batch.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())  # numbers of buckets
    if not touched:
        return
    old = _read(spark, path, batch.schema, {b: before[b] for b in touched if b in before}).alias("o")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.join(batch.select(keys).alias("n"), same, "left_anti").withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    kept.unionByName(rows).repartition(_BUCKET).select(*names, _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/data/{_VERSION}={version}")
    now = spark.createDataFrame([(version, {str(b): v for b, v in (before | dict.fromkeys(touched, version)).items()})], "version long, current map<string,long>")
    now.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version}")


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path as its newest manifest has it."""
    return _read(spark, path, schema, _manifest(spark, path))


def upserted(stream: DataFrame, keys: list[str], path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Runs a stream of mode update over what there is and returns the table that its rows have been merged into. path: where
    it lies, with the stream's position beside it, so that a later call goes on from there; new if not given."""
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    put = lambda batch, n: upsert(batch, path, keys, n, buckets)
    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, path, stream.schema)
