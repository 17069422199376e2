"""The store as partitioned snapshots, its shard catalog and additive schema migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

# Defaults of columns that older snapshots lack.
DEFAULTS = {"stability": 1.0, "tier": "neocortex", "strength": 0.5}


def write_snapshot(memories: DataFrame, path: str, max_records: int = 50_000) -> None:
    """Write memories as Parquet, partitioned by scope and scope hash of the container tag; files hold max_records at most.

    Rows are spread by id within a scope, so a container that holds a third of all rows is many files.
    """
    scoped = memories.withColumns(scope_of(F.col("container_tag")))
    rows = memories.count()
    parts = max(1, -(-rows // max_records))
    (
        scoped.repartition(parts, "scope", "scope_hash", F.pmod(F.xxhash64("id"), F.lit(parts)))
        .write.option("maxRecordsPerFile", max_records)
        .partitionBy("scope", "scope_hash")
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A snapshot with the columns that it lacks added with their defaults; scope filters prune partitions."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for c, v in DEFAULTS.items():
        if c in columns or not columns:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df.select(*columns) if columns else df


def scope_of(tag) -> dict:
    """scope and scope_hash of a container tag: prefix_scope_hash..., else scope 'user' and the whole tag."""
    parts = F.split(tag, "_")
    ok = F.size(parts) >= 3
    return {
        "scope": F.when(ok, F.element_at(parts, 2)).otherwise("user"),
        "scope_hash": F.when(ok, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")).otherwise(tag),
    }


def shard_rotation(memories: DataFrame, capacity: int, part_rows: int = 1_000_000) -> DataFrame:
    """(id, container_tag, shard_index): shards of `capacity` memories in order of creation within each container.

    Rows are cut into ranges of about part_rows by container, time and id, and the position is the number of
    rows in earlier ranges plus the position inside one; so neither a container that holds a third of all rows
    nor a burst of rows of one time is one task.
    """
    t = F.coalesce(F.unix_micros("created_at"), F.lit(2**62).cast("long"))
    m = memories.select("id", "container_tag", t.alias("t"))
    parts = max(1, -(-m.count() // part_rows))
    # written once: a range that is computed again may be cut elsewhere
    ranges = m.repartitionByRange(parts, "container_tag", "t", "id").withColumn("b", F.spark_partition_id())
    m = materialise(ranges, "rotation")
    n = m.groupBy("container_tag", "b").agg(F.count("*").alias("n"))
    before = n.select(
        F.col("container_tag").alias("c"), F.col("b").alias("d"), (F.sum("n").over(Window.partitionBy("container_tag").orderBy("b")) - F.col("n")).alias("before")
    )
    w = Window.partitionBy("container_tag", "b").orderBy("t", "id")
    return (
        m.withColumn("r", F.row_number().over(w) - 1)
        .join(before, F.col("container_tag").eqNullSafe(F.col("c")) & (F.col("b") == F.col("d")))
        .select("id", "container_tag", F.floor((F.col("before") + F.col("r")) / capacity).cast("long").alias("shard_index"))
    )


def catalog(shards: DataFrame) -> DataFrame:
    """Each shard (scope, scope_hash, shard_index) once, as first registered."""
    w = Window.partitionBy("scope", "scope_hash", "shard_index").orderBy("id", "created_at")
    return shards.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def active_shards(shards: DataFrame) -> DataFrame:
    """The active shard of highest index of each scope and hash."""
    return (
        catalog(shards).filter("is_active")
        .groupBy("scope", "scope_hash")
        .agg(F.max(F.struct("shard_index", "id", "db_path")).alias("s"))
        .select("scope", "scope_hash", "s.shard_index", "s.id", "s.db_path")
    )


def shard_by_path(shards: DataFrame, path: str) -> DataFrame:
    """The first registered shard whose db_path ends with the file name of path."""
    return catalog(shards).filter(F.col("db_path").endswith(path.rsplit("/", 1)[-1])).orderBy("id").limit(1)


def discovered(shards: DataFrame) -> DataFrame:
    """(id, f_scope, f_hash, f_index) read off the file names of the catalog; others than scope_hash_shard_n.db are left out."""
    name = F.regexp_extract("db_path", r"([^/]+)$", 1)
    pattern = r"^([^_]+)_(.+)_shard_(\d+)\.db$"
    return (
        shards.filter(name.rlike(pattern))
        .select("id", *[F.regexp_extract(name, pattern, i).alias(c) for i, c in ((1, "f_scope"), (2, "f_hash"), (3, "f_index"))])
        .withColumn("f_index", F.col("f_index").cast("int"))
    )


def counted(shards: DataFrame, memories: DataFrame) -> DataFrame:
    """(scope, scope_hash, stated, held): the catalog's counts beside what the containers hold; counts below 0 are 0."""
    held = memories.withColumns(scope_of(F.col("container_tag"))).groupBy("scope", "scope_hash").agg(F.count("*").alias("held"))
    stated = catalog(shards).groupBy("scope", "scope_hash").agg(F.sum(F.greatest(F.coalesce("vector_count", F.lit(0)), F.lit(0))).alias("stated"))
    return stated.join(held, ["scope", "scope_hash"], "full").select(
        "scope", "scope_hash", F.coalesce("stated", F.lit(0)).alias("stated"), F.coalesce("held", F.lit(0)).alias("held")
    )


def located(memories: DataFrame, ids: DataFrame, capacity: int) -> DataFrame:
    """Rows of memories of ids(id) with scope, scope_hash and the shard_index that holds each; unknown ids give no row."""
    want = ids.select("id").distinct()
    at = shard_rotation(memories, capacity).select("id", "shard_index").join(want, "id", "left_semi")
    return memories.join(want, "id", "left_semi").join(at, "id").withColumns(scope_of(F.col("container_tag")))


def key_values(rows: DataFrame, column: str) -> DataFrame:
    """(id, key, value) of a JSON object column, values as text; cut-off JSON and null values give no rows."""
    pairs = F.explode(F.from_json(column, "map<string, string>", {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json(column).isNotNull()
    return rows.filter(whole).select("id", pairs).filter("value is not null")


def typed_rows(pairs: DataFrame, by: str, types: dict[str, str]) -> DataFrame:
    """One row for each value of `by` that has a wanted key: pairs(by, key, value) as columns of the types given.

    A missing key, and a value that is not of the type, is null; of repeated keys the smallest value counts.
    """
    wide = pairs.filter(F.col("key").isin(*types)).groupBy(by).pivot("key", list(types)).agg(F.min("value"))
    return wide.select(by, *[F.expr(f"try_cast(`{k}` as {t})").alias(k) for k, t in types.items()])


def check_shard(metadata: dict, model: str, dimensions: int) -> None:
    """Raises if a shard was made for another embedding model or number of dimensions; missing entries are no conflict."""
    for key, want in (("embedding_model", model), ("embedding_dimensions", dimensions)):
        if metadata.get(key) not in (None, "", want, str(want)):
            raise ValueError(f"the shard has {key} {metadata[key]}, not {want}")


def refused(memories: DataFrame, dimensions: int) -> DataFrame:
    """Rows whose vector has another number of dimensions, with that number; null vectors are no conflict."""
    n = F.size("vector")
    return memories.filter(F.col("vector").isNotNull() & (n != dimensions)).withColumn("dimensions", n)
