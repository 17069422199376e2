"""Registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import AS_OF, read
from . import p1_groups, p2_history, p3_neighbours, p4_neardup, p5_survivor, p6_clusters, p7_packing, p8_mixing, p9_abuse, sql


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_groups.memory_groups(read(spark, d, "links"), read(spark, d, "memories"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_history.repeats(read(spark, d, "memories"), read(spark, d, "incoming"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbours.close_pairs(read(spark, d, "memories"), {"vector": 96, "tags_vector": 32})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_neardup.near_duplicates(read(spark, d, "memories")).select(
        F.col("id_a").alias("memory_id_a"), F.col("id_b").alias("memory_id_b")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_survivor.survivors(read(spark, d, "merge_groups"), read(spark, d, "memories"), AS_OF).select(
        "group_id", "survivor_id", "display_from_id"
    )


def p5_current_tier(spark: SparkSession, d: str) -> DataFrame:
    return p5_survivor.current_values(read(spark, d, "merge_groups"), read(spark, d, "memories"), "tier", AS_OF)


def p5_current_type(spark: SparkSession, d: str) -> DataFrame:
    return p5_survivor.current_values(read(spark, d, "merge_groups"), read(spark, d, "memories"), "type", AS_OF)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    r = p5_survivor.records(read(spark, d, "merge_groups"), read(spark, d, "memories"), ["type", "tier"], AS_OF)
    return r.select("group_id", "survivor_id", "display_from_id", "type", "tier")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = p6_clusters.clusters(read(spark, d, "memories"))
    return members.select(F.col("id").alias("memory_id"), "group_id")


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    s = p6_clusters.clusters(read(spark, d, "memories"))[1]
    return s.select("group_id", "n_members", F.round("avg_cosine", 3).alias("avg_cosine"), "medoids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing.split_documents(p7_packing.pack_documents(read(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing.pack_documents(read(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing.fill_report(p7_packing.pack_documents(read(spark, d, "documents")))


#: Small sources early, chats late; all others evenly.
CURRICULUM = {
    "synthesis": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    "session_chat": ((0.0, 0.25), (1.0, 1.75)),
    "md_notes": ((0.0, 1.5), (1.0, 0.5)),
}


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    s = p8_mixing.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"), schedules=CURRICULUM)
    return s.filter("short").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    m = p8_mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"), schedules=CURRICULUM)
    return m.select("source", "doc_id", "repeat_no", "n_tokens", F.round("position", 6).alias("position"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    s = p8_mixing.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"), schedules=CURRICULUM)
    six = ("target_share", "actual_share", "demand", "mean_position")
    return s.select(*[F.round(c, 6).alias(c) if c in six else c for c in s.columns])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return p9_abuse.score(docs, p9_abuse.fit(docs, read(spark, d, "doc_labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("score >= 0.5").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return p9_abuse.flag_rates(_scored(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found,
        p2_found,
        p3_found,
        p4_found,
        p5_found,
        p5_current_tier,
        p5_current_type,
        p5_records,
        p6_found,
        p6_summary,
        p7_found,
        p7_containers,
        p7_fill,
        p8_found,
        p8_mix,
        p8_shares,
        p9_found,
        p9_scores,
        p9_rates,
    )
}

ORACLES = sql.oracles()
