"""Micro-batches of raw facts into a Parquet table by the null-preserving upsert.

The stored table is a directory of versions; a batch writes a new version and then a marker with its number, so a
batch that is tried again finds its work done and a batch that failed leaves the old version in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgelens.operators.loads import upsert_keep


def latest_version(spark, path: str) -> int:
    """The last committed batch, -1 if there is none."""
    try:
        return spark.read.parquet(f"{path}/commits").agg(F.max("batch")).first()[0]
    except Exception as e:  # Spark's own error class for a path that is not there yet
        if "PATH_NOT_FOUND" in str(e):
            return -1
        raise


def upsert_batch(path: str, keys: list[str], order: str | None = None):
    """A function for foreachBatch. Of several rows of a key in a batch the last by `order` counts."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = latest_version(spark, path)
        if number <= done:
            return
        if order is not None:
            batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        if done >= 0:
            batch = upsert_keep(spark.read.parquet(f"{path}/v={done}"), batch, keys)
        batch.write.mode("overwrite").parquet(f"{path}/v={number}")
        spark.range(1).select(F.lit(number).alias("batch")).coalesce(1).write.mode("append").parquet(f"{path}/commits")

    return apply


def read_upserted(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={latest_version(spark, path)}")
