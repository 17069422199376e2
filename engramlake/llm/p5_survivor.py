"""Best representative of each duplicate group.

`survivors` ranks the members of each group and takes, field by field, the value of the best ranked
member that has one; TESTDATA.md fixes that ranking. `current_values` reasons about currency: the values
that groups held earlier and later teach which value tends to follow which, and the steps are closed
transitively. Values of a group that carry timestamps are ordered by them, all others by what was learnt;
what no value of the group follows is latest. `records` puts both together: one record a group.

Everything is aggregated with map-side partial results, so a group that holds a third of all rows
is never gathered in one task.

Edge cases: members that are in no memory are left out; a group with fewer than two distinct members
gives no row; repeated rows count once; null is_pinned is false; null or NaN stability is 1.0; a
display name that is null or blank does not count; empty tables give no rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from ..tables import lit_ts


def _members(groups: DataFrame, memories: DataFrame, *columns: str) -> DataFrame:
    g = groups.select("group_id", "memory_id").filter("group_id is not null and memory_id is not null").distinct()
    # rows of one memory are equal in these columns, so what is left of them does no harm to min, max and any
    m = memories.select(F.col("id").alias("memory_id"), *columns)
    return g.join(m, "memory_id")


def survivors(groups: DataFrame, memories: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(group_id, survivor_id, display_from_id, display_name) of groups with two or more members.

    Members rank by: pinned; later updated_at (null or after as_of last); larger stability; smaller id.
    """
    m = _members(groups, memories, "is_pinned", "updated_at", "stability", "display_name")
    known = F.coalesce(F.col("updated_at") <= lit_ts(as_of), F.lit(False))
    stab = F.when(F.col("stability").isNull() | F.isnan("stability"), 1.0).otherwise(F.col("stability"))
    rank = F.struct(
        (~F.coalesce("is_pinned", F.lit(False))).alias("loose"),
        (~known).alias("undated"),
        F.when(known, -F.unix_micros("updated_at")).otherwise(F.lit(0)).alias("age"),
        (-stab).alias("weak"),
        F.col("memory_id").alias("id"),
    )
    named = F.length(F.regexp_replace("display_name", r"(?U)\s", "")) > 0
    r = m.select("group_id", "memory_id", rank.alias("rank"), F.when(named, F.struct("rank", "display_name")).alias("named"))
    return (
        r.groupBy("group_id")
        .agg(
            F.min("rank").alias("best"),
            F.min("named").alias("name"),
            F.min("memory_id").alias("lo"),
            F.max("memory_id").alias("hi"),
        )
        .filter("lo <> hi")
        .select(
            "group_id",
            F.col("best.id").alias("survivor_id"),
            F.coalesce("name.rank.id", F.lit("")).alias("display_from_id"),
            F.col("name.display_name").alias("display_name"),
        )
    )


def value_precedence(held: DataFrame) -> DataFrame:
    """(before, after, n) learnt from held(group_id, value, first_at, last_at).

    A value that a group last held before it first held the next one precedes it. A pair that occurs in
    both directions counts only in the more frequent one.
    """
    w = Window.partitionBy("group_id").orderBy("first_at", "last_at", "value")
    # a group has as many rows here as it has distinct dated values of a categorical field
    steps = (
        held.filter("first_at is not null")
        .withColumns({"next": F.lead("value").over(w), "next_at": F.lead("first_at").over(w)})
        .filter("last_at < next_at")
        .groupBy(F.col("value").alias("before"), F.col("next").alias("after"))
        .agg(F.count("*").alias("n"))
    )
    back = steps.select(F.col("after").alias("before"), F.col("before").alias("after"), F.col("n").alias("m"))
    return steps.join(back, ["before", "after"], "left").filter("m is null or n > m").select("before", "after", "n")


def closed(steps: DataFrame) -> DataFrame:
    """(before, after) of the transitive closure of steps(before, after), by doubling; values of one cycle do not precede each other."""
    reach = materialise(steps.select("before", "after").distinct(), "p5-reach")
    n, known = reach.count(), -1
    while n != known:
        further = reach.select("before", F.col("after").alias("via")).join(reach.select(F.col("before").alias("via"), "after"), "via")
        reach = materialise(reach.unionByName(further.select("before", "after")).distinct(), "p5-reach")
        n, known = reach.count(), n
    back = reach.select(F.col("after").alias("before"), F.col("before").alias("after"))
    return reach.join(back, ["before", "after"], "left_anti")


def current_values(groups: DataFrame, memories: DataFrame, field: str, as_of: dt.datetime) -> DataFrame:
    """(group_id, value, n_rows, dated) of a categorical field: the value that is current in each group.

    Of two dated values the one held last is later; of two others the one that comes later in the closed
    value_precedence. Among the values that none of the group is later than (all of them, should they go
    in a circle), dated ones come first, then the one held last, the more frequent, the smaller one. dated:
    whether the value that comes out has a date.
    """
    value = F.lower(F.trim(field))
    m = _members(groups, memories, field, "updated_at").filter(F.length(value) > 0)
    at = F.when(F.col("updated_at") <= lit_ts(as_of), F.col("updated_at"))
    held = (
        m.select("group_id", "memory_id", value.alias("value"), at.alias("at"))
        .distinct()
        .groupBy("group_id", "value")
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n_rows"))
    )
    held = materialise(held, "p5-held")
    order = closed(value_precedence(held)).select(F.col("before").alias("value"), "after")
    other = held.select("group_id", F.col("value").alias("after"), F.col("last_at").alias("other_at"))
    learnt = (
        held.join(order, "value").join(other, ["group_id", "after"])
        .filter("last_at is null or other_at is null")
        .select("group_id", "value").distinct().withColumn("learnt", F.lit(True))
    )
    top = held.groupBy("group_id").agg(F.max("last_at").alias("top"))
    followed = F.coalesce("learnt", F.lit(False)) | F.coalesce(F.col("last_at") < F.col("top"), F.lit(False))
    rank = F.struct(
        followed.alias("followed"),
        F.col("last_at").isNull().alias("undated"),
        (-F.unix_micros("last_at")).alias("age"),
        (-F.col("n_rows")).alias("few"),
        F.col("value").alias("value"),
    )
    return (
        held.join(top, "group_id").join(learnt, ["group_id", "value"], "left")
        .groupBy("group_id").agg(F.min(rank).alias("r"))
        .select("group_id", F.col("r.value").alias("value"), (-F.col("r.few")).alias("n_rows"), (~F.col("r.undated")).alias("dated"))
    )


def records(groups: DataFrame, memories: DataFrame, fields: list[str], as_of: dt.datetime) -> DataFrame:
    """survivors() with the current value of each of `fields`, null where no member has one."""
    out = survivors(groups, memories, as_of)
    for f in fields:
        out = out.join(current_values(groups, memories, f, as_of).select("group_id", F.col("value").alias(f)), "group_id", "left")
    return out
