"""Markdown files in and out of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Folders that are skipped, and types by first path segment.
SKIPPED = ("node_modules", "data", "plans", "_synced", ".git", ".model-cache", "dist")
TYPES = {"profile": "profile", "projects": "project", "logs": "log", "notes": "note", "scripts": "script"}


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the *.md files under root, path relative to it; skipped folders and dot-entries are left out."""
    df = (
        spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    rel = F.substring_index("file", root.rstrip("/") + "/", -1)
    parts = F.split(rel, "/")
    skip = F.exists(parts, lambda x: x.startswith(".") | x.isin(*SKIPPED))
    return df.filter(~skip).select(rel.alias("path"), F.col("value").alias("content"))


def path_tags(path: Column) -> Column:
    """Segments of a path without its .md ending; empty ones dropped."""
    return F.filter(F.split(F.regexp_replace(path, r"\.md$", ""), "/"), lambda x: x != "")


def path_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(table[F.try_element_at(path_tags(path), F.lit(1))], F.lit("reference"))


def changed(files: DataFrame, memories: DataFrame, prefix: str = "note") -> DataFrame:
    """(id, container_tag, path, content, tags, type, is_update): files that the store lacks or holds otherwise.

    A file is known by metadata.sourceFile; a changed one keeps its id (an upsert).
    """
    known = memories.select(
        F.col("id").alias("old_id"), F.col("content").alias("old"), text.metadata_value(F.col("metadata"), "sourceFile").alias("path")
    ).filter("path is not null")
    first = known.groupBy("path").agg(F.min(F.struct("old_id", "old")).alias("k"))
    h = F.substring(F.sha2("path", 256), 1, 16)
    return (
        files.join(first, "path", "left")
        .filter(F.col("k").isNull() | ~F.col("k.old").eqNullSafe(F.col("content")))
        .select(
            F.coalesce("k.old_id", F.concat(F.lit("sync_"), h)).alias("id"),
            F.concat_ws("_", F.lit(prefix), F.lit("project"), h).alias("container_tag"),
            "path", "content", F.array_join(path_tags(F.col("path")), ",").alias("tags"), path_type(F.col("path")).alias("type"),
            F.col("k").isNotNull().alias("is_update"),
        )
    )


def front_matter(memories: DataFrame) -> DataFrame:
    """(path, text): what is written for each memory that came from no file: tags as folders, YAML front matter, content."""
    tags = text.normal_tags(F.col("tags"))
    folder = F.when(F.size(tags) > 0, F.array_join(tags, "/")).otherwise("uncategorized")
    body = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")),
        F.concat(F.lit("type: "), F.coalesce(F.lower(F.trim("type")), F.lit("fact"))), F.lit("---"), F.lit(""), F.coalesce("content", F.lit("")),
    )
    return memories.filter(text.metadata_value(F.col("metadata"), "sourceFile").isNull()).select(
        F.concat(folder, F.lit("/"), "id", F.lit(".md")).alias("path"), body.alias("text")
    )


def write_markdown(rendered: DataFrame, root: str) -> None:
    """One file a row, written by the tasks under root, which all executors share."""

    def put(rows) -> None:
        from pathlib import Path

        for r in rows:
            p = Path(root, r["path"])
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(r["text"])

    rendered.foreachPartition(put)
