"""Vector expressions, in double precision and NaN-safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order; null for a null vector."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(v: Column, dim: int) -> Column:
    """Not null, dim finite values, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero norm, a null vector or unequal lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def adjacent(rows: DataFrame, bucket: Column) -> DataFrame:
    """(container_tag, t, id, sim) of rows(id, container_tag, created_at, vector): cosine with the row before it in the container.

    The order is by created_at (null last), then id; rows of one id count once. Rows are ordered inside time
    buckets, so a container that holds a third of all rows is many tasks; the last row of a bucket is
    carried to the next one of the container, so the buckets do not show in the result.
    """
    at = F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(2**62).cast("long")).alias("t"), "id")
    m = rows.select("container_tag", "id", at.alias("at"), F.coalesce(bucket, F.to_timestamp(F.lit("9999-01-01"))).alias("b"), "vector")
    m = m.dropDuplicates(["container_tag", "b", "id"])
    w = Window.partitionBy("container_tag", "b").orderBy("at")
    inside = m.withColumn("before", F.lag("vector").over(w))
    last = m.groupBy("container_tag", "b").agg(F.max_by("vector", "at").alias("last"))
    carried = last.select("container_tag", "b", F.lag("last").over(Window.partitionBy("container_tag").orderBy("b")).alias("carried"))
    c = carried.withColumnsRenamed({"container_tag": "c", "b": "cb"})
    joined = inside.join(c, F.col("container_tag").eqNullSafe(F.col("c")) & (F.col("b") == F.col("cb")))
    before = F.coalesce("before", "carried")
    return joined.filter(before.isNotNull()).select("container_tag", "at.t", "id", cosine(F.col("vector"), before).alias("sim"))
