"""Readers for the project's tables and the cleaning rules that hold for all operators."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The as-of time of the data; operators take time as a parameter and never read the clock.
AS_OF = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lit_ts(t: dt.datetime) -> Column:
    return F.timestamp_micros(F.lit(int(t.timestamp() * 1_000_000)))


def clean(c: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(F.trim(c))


def memories(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per memory id.

    Rows of one id differ in last_accessed_at at most; the latest access is kept.
    Columns are pruned before the shuffle, so only what is asked for moves.
    """
    df = read(spark, sf_dir, "memories")
    cols = list(columns or df.columns)
    if "last_accessed_at" in cols:
        rest = [c for c in cols if c not in ("id", "last_accessed_at")]
        return df.groupBy("id").agg(
            F.max("last_accessed_at").alias("last_accessed_at"), *[F.first(c).alias(c) for c in rest]
        ).select(*cols)
    return df.select(*dict.fromkeys(["id", *cols])).dropDuplicates(["id"]).select(*cols)
