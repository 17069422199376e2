"""Pluggable embedding and synthesis, with offline defaults."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dim: int = 96) -> Embedder:
    """Deterministic unit vectors of hashed word counts; all zero for a text without words."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 1024 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return embed


def embed(records: DataFrame, make: Callable[[], Embedder], text_column: str = "content") -> DataFrame:
    """records with a column `vector`; the model is made once a task and fed in Arrow batches."""
    schema = records.drop("vector").withColumn("vector", F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(vector=list(model(b[text_column].fillna("").tolist())))

    return records.drop("vector").mapInPandas(run, schema)


def synthesise(inputs: DataFrame, summarise: Callable[[str], str] | None = None, stability: float = 5.0) -> DataFrame:
    """(id, content, type, tags, stability) of new memories made from synthesis inputs (new_id, cluster_id, prompt).

    Offline default: the prompt itself, an extract. A model is called in Arrow batches.
    """
    if summarise is None:
        content = F.col("prompt")
    else:
        content = F.pandas_udf(lambda s: s.map(summarise), "string")("prompt")
    return inputs.select(
        F.col("new_id").alias("id"), content.alias("content"), F.lit("synthesis").alias("type"),
        F.concat(F.lit("synthesis,cluster_"), F.col("cluster_id").cast("string")).alias("tags"), F.lit(stability).alias("stability"),
    )


def reflections(new: DataFrame, stored: DataFrame, inputs: DataFrame) -> DataFrame:
    """(source_id, target_id, link_type, strength): reflection_of links from each new memory to the members it sums up."""
    return (
        inputs.select("cluster_id", F.col("new_id").alias("source_id")).join(stored.select("cluster_id", F.col("member").alias("target_id")).distinct(), "cluster_id")
        .join(new.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        .select("source_id", "target_id", F.lit("reflection_of").alias("link_type"), F.lit(1.0).alias("strength"))
    )
