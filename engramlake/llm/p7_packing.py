"""Filling fixed-capacity containers with items, by refined harmonic packing.

An item of length n belongs to the class j = floor(capacity / n): j items of the class always fit into
one container, so each worker fills the containers of its share of a class with j items each, without
looking at any other worker. Items longer than the capacity are cut into full pieces and a rest, which
is packed like an item. Classes are split by a salt of the id, so a length that a third of all items
share is not one task's work; each share of a class leaves at most one container less than full.

An item of the first class has a container of its own, and what it leaves may be nearly half. So lengths
are partitioned once more, into `bands` equal bands of the capacity: an item whose length rounded up to
bands is the room rounded down to bands goes beside it. The r-th such item of a share, longest first, joins
the r-th such room of that share; items left over fill containers of their own class.

Within a class the items are taken in turn from the short and the long end of their lengths, so that
containers of one class are filled alike.

Edge cases: null and empty texts have no tokens and share containers of the last class; repeated ids
are packed as separate items; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import token_count


def pack(items: DataFrame, capacity: int = 512, share_rows: int = 200_000, bands: int = 32) -> DataFrame:
    """(doc_id, piece_no, first_token, n_tokens, container_id, slots, beside) for items(doc_id, n_tokens).

    container_id is unique over all classes and shares; slots is the fixed number of items of its class, and
    beside tells the one item more that a container of the first class may hold.
    """
    shares = max(1, -(-items.count() // share_rows))
    n = F.col("n_tokens")
    pieces = items.select(
        "doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)))).alias("piece_no", "k"), n.alias("all")
    ).select(
        "doc_id",
        "piece_no",
        (F.col("piece_no") * capacity).cast("long").alias("first_token"),
        F.least(F.col("all") - F.col("piece_no") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"),
    )
    slots = F.floor(F.lit(capacity) / F.greatest(n, F.lit(1)))
    share = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shares))
    p = pieces.withColumns({"slots": slots, "share": share, "alone": slots == 1})
    # room and length in whole bands: what has the same number fits
    band = F.when(F.col("alone"), F.floor((capacity - n) * bands / capacity)).otherwise(F.ceil(n * bands / capacity))
    p = p.withColumn("band", band)
    order = ("n_tokens", "doc_id", "piece_no")
    rooms = F.count(F.when(F.col("alone"), 1)).over(Window.partitionBy("share", "band"))
    p = p.withColumns({"rooms": rooms, "pair": F.row_number().over(Window.partitionBy("share", "band", "alone").orderBy(F.desc("n_tokens"), *order[1:])) - 1})
    beside = ~F.col("alone") & (F.col("pair") < F.col("rooms"))
    p = p.withColumn("beside", beside).withColumn("slots", F.when(F.col("beside"), 1).otherwise(F.col("slots")))
    own = Window.partitionBy("slots", "share", "beside")
    p = p.withColumns({"r": F.row_number().over(own.orderBy(*order)) - 1, "m": F.count("*").over(own)})
    # short and long ends in turn: r, m - 1 - r
    turn = F.when(F.col("r") * 2 < F.col("m"), F.col("r") * 2).otherwise((F.col("m") - 1 - F.col("r")) * 2 + 1)
    shared = F.concat_ws("-", "slots", "share", "band", "pair")
    return p.select(
        "doc_id",
        "piece_no",
        "first_token",
        "n_tokens",
        F.when(F.col("slots") == 1, shared).otherwise(F.concat_ws("-", "slots", "share", F.floor(turn / F.col("slots")))).alias("container_id"),
        "slots",
        "beside",
    )


def pack_documents(documents: DataFrame, capacity: int = 512) -> DataFrame:
    """pack() over documents(doc_id, text), sizes in tokens of the text."""
    return pack(documents.select("doc_id", token_count(F.col("text")).alias("n_tokens")), capacity)


def fill_report(packed: DataFrame, capacity: int = 512) -> DataFrame:
    """(slots, containers, items, tokens, fill) by class; fill is the used share of the capacity."""
    return (
        packed.groupBy("slots", "container_id")
        .agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
        .groupBy("slots")
        .agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
    )


def split_documents(packed: DataFrame) -> DataFrame:
    """doc_id of the documents that lie in several containers."""
    return (
        packed.groupBy("doc_id")
        .agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
        .filter("a <> b")
        .select("doc_id")
    )
