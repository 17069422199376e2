"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over the training time t in [0, 1], piecewise linear between knots.
Its integral, scaled to one, says what share of the source's demand is used up by time t. The documents
of a source are put into a pseudo-random order; the tokens before a document, divided by the source's
demand, are the integral at which it is due, and the inverted integral gives its training position.
Sorting all documents by position by range gives the mix.

Cumulative tokens within a source are sums over ranges of the hash plus a running sum inside one range, so a
source that holds a third of all rows is spread over many; their number grows with the rows.

A source contributes min(target share x budget, repeats x its tokens); the document that crosses the
demand is kept whole. Edge cases: null max_repeats is 1, a negative one 0; source names are trimmed and
lower-cased; rows of one source in the targets add their shares and keep the larger repeats; sources
without documents contribute nothing; documents of no target, and those without tokens, are not in the
mix (the latter take no room); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from ..tables import clean
from .common import token_count

#: Documents that one range of the hash should hold.
RANGE = 50_000


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of documents(doc_id, text, source), written once: texts are read and counted one time."""
    return materialise(
        documents.select("doc_id", clean(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens")), "p8-sizes"
    )


def plan(docs: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(source, target_share, repeats, source_tokens, all_tokens, demand, supply) of sizes docs: one row per target source."""
    size = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    all_tokens = size.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    want = (
        targets.filter("source is not null")
        .groupBy(clean(F.col("source")).alias("source"))
        .agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("long").alias("repeats"),
        )
    )
    full = F.lit(budget).cast("double") if budget else F.col("all_tokens").cast("double")
    return (
        want.join(size, "source", "left")
        .crossJoin(F.broadcast(all_tokens))  # one row
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumns(
            {"demand": F.col("target_share") * full, "supply": F.col("repeats") * F.col("source_tokens")}
        )
    )


def _segments(spark: SparkSession, schedules: dict) -> DataFrame:
    """For each source with a schedule the pieces of its integrated schedule: from (t0, area a0) with weight w0 and slope."""
    rows = []
    for s, points in schedules.items():
        knots = sorted((float(t), float(w)) for t, w in points)
        area = [0.0]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
        if area[-1] <= 0:
            raise ValueError(f"the weights of {s} are zero everywhere")
        for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:])):
            if area[k + 1] > area[k]:
                z = area[-1]
                rows.append((s, t0, w0 / z, (w1 - w0) / (t1 - t0) / z, area[k] / z, area[k + 1] / z))
    return spark.createDataFrame(rows, "source string, t0 double, w0 double, slope double, a0 double, a1 double")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, schedules: dict | None = None, seed: int = 0) -> DataFrame:
    """(source, doc_id, repeat_no, n_tokens, position), range-sorted by position in [0, 1).

    schedules: source -> ((t, weight), ...) with t from 0 to 1; all other sources are supplied evenly.
    """
    return mix_sizes(sizes(documents), targets, budget, schedules, seed).orderBy("position", "source", "doc_id", "repeat_no")


def mix_sizes(docs: DataFrame, targets: DataFrame, budget: int | None, schedules: dict | None, seed: int = 0) -> DataFrame:
    """mix() over sizes, not sorted."""
    p = plan(docs, targets, budget).filter("demand > 0 and supply > 0")
    p = p.withColumn("laps", F.least(F.col("repeats"), F.ceil(F.col("demand") / F.col("source_tokens"))))
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("doc_id").cast("string")))
    ranges = max(16, -(-docs.count() // RANGE))
    d = (
        docs.filter("n_tokens > 0")
        .join(p.select("source", "source_tokens", "demand", "supply", "laps"), "source")
        .withColumn("h", h)
        .withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 * ranges).cast("int"))
    )
    sums = d.groupBy("source", "range").agg(F.sum("n_tokens").alias("t"))
    before = sums.select(
        "source", "range", (F.sum("t").over(Window.partitionBy("source").orderBy("range")) - F.col("t")).alias("before")
    )  # at most `ranges` rows a source
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        d.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
        .join(before, ["source", "range"])
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("laps").cast("long") - 1)))
        .withColumn("start", F.col("repeat_no") * F.col("source_tokens") + F.col("before") + F.col("own"))
        .filter(F.col("start") < F.col("demand"))
        .withColumn("u", F.col("start") / F.least("demand", F.col("supply").cast("double")))
    )
    seg = _segments(docs.sparkSession, schedules or {}).withColumnRenamed("source", "s")  # as many rows as the schedules have knots
    due = at.join(F.broadcast(seg), (F.col("source") == F.col("s")) & (F.col("u") >= F.col("a0")) & (F.col("u") < F.col("a1")), "left")
    rest = F.col("u") - F.col("a0")
    # w0 x + slope x^2 / 2 = rest, in the form that is stable for small slopes
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * F.col("slope") * rest, F.lit(0.0)))
    x = F.when(F.col("w0") + root > 0, 2 * rest / (F.col("w0") + root)).otherwise(0.0)
    position = F.when(F.col("s").isNull(), F.col("u")).otherwise(F.col("t0") + x)
    return due.select("source", "doc_id", "repeat_no", "n_tokens", position.alias("position"))


def shares(documents: DataFrame, targets: DataFrame, budget: int | None = None, schedules: dict | None = None) -> DataFrame:
    """(source, target_share, actual_share, demand, mixed_tokens, docs, most_repeats, mean_position, short), from the mix itself."""
    docs = sizes(documents)
    got = (
        mix_sizes(docs, targets, budget, schedules)
        .groupBy("source")
        .agg(
            F.sum("n_tokens").alias("mixed_tokens"),
            F.count("*").alias("docs"),
            (F.max("repeat_no") + 1).alias("most_repeats"),
            (F.sum(F.col("position") * F.col("n_tokens")) / F.sum("n_tokens")).alias("mean_position"),
        )
    )
    out = plan(docs, targets, budget).join(got, "source", "left").fillna(0, ["mixed_tokens", "docs", "most_repeats"])
    total = out.agg(F.sum("mixed_tokens").alias("mixed_all"))
    return out.crossJoin(F.broadcast(total)).select(  # one row
        "source",
        "target_share",
        F.when(F.col("mixed_all") > 0, F.col("mixed_tokens") / F.col("mixed_all")).otherwise(0.0).alias("actual_share"),
        "demand",
        "mixed_tokens",
        "docs",
        "most_repeats",
        "mean_position",
        (F.col("mixed_tokens") < F.col("demand")).alias("short"),
    )
