"""Near-duplicate records with small edits, by a multi-index Hamming join over b-bit signatures.

Records are alike if their vectors have at least `min_cosine`, or their contents have at least
`min_words` distinct words each and share at least `min_jaccard` of the words of both. Signatures of
words and of vectors give the candidates (see signatures.py), which are then checked exactly.

Exact copies: a set of words or a vector that more than `copies` records hold is a copy class. Its
smallest id stands for it in the join, and every other copy is paired with that one only; smaller groups
are paired in full. So a class that holds a third of all rows costs a third of the rows, and no link
between different texts is lost. Which form a class has depends on its own size alone, not on the table's.

Edge cases: rows of one id count once; null or unusable vectors and short or null contents take no
part in that comparison; an id is never paired with itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import signatures as sig
from .common import cosine, stack, unit, usable, words

DIM, MIN_COSINE, MIN_JACCARD, MIN_WORDS, COPIES = 96, 0.985, 0.7, 8, 64
#: Candidate ids up to this number are broadcast to prune the second scan; beyond it they are joined by shuffle.
BROADCAST_IDS = 300_000


def features(records: DataFrame, dim: int = DIM, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, w, v) of records(id, content, vector): distinct words, hashed to 32 bits, and usable vector, null where there is none."""
    w = F.array_sort(F.array_distinct(F.transform(words(F.col("content")), lambda x: F.shiftright(F.xxhash64(x), 32).cast("int"))))
    return (
        records.filter("id is not null")
        .select("id", F.xxhash64("id").alias("h"), w.alias("w"), "vector")
        .select(
            "id",
            "h",
            F.when(F.size("w") >= min_words, F.col("w")).alias("w"),
            F.when(usable(F.col("vector"), dim), F.col("vector")).alias("v"),
        )
    )


def jaccard_test(a: str, b: str, min_jaccard: float) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common >= min_jaccard * (F.size(a) + F.size(b) - common) - 1e-9, F.lit(False))


def cosine_test(a: str, b: str, min_cosine: float) -> Column:
    return F.coalesce(cosine(F.col(a), F.col(b)) >= min_cosine, F.lit(False))


def tests(min_cosine: float, min_jaccard: float) -> tuple[Column, Column]:
    """Exact tests of words and of vectors, as columns x1 and x2."""
    return jaccard_test("x1", "x2", min_jaccard), cosine_test("x1", "x2", min_cosine)


def word_keys(f: DataFrame, df: np.ndarray, texts: int) -> DataFrame:
    """Key rows of the word signatures of f(h, w)."""
    bc = f.sparkSession.sparkContext.broadcast(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = b.column("w")
                n = np.diff(w.offsets.to_numpy())
                flat = w.flatten().to_numpy(zero_copy_only=False)
                s = sig.text_symbols(flat, n, bc.value, texts)
                yield pa.RecordBatch.from_pandas(sig.key_rows(b.column("h").to_numpy(), s, 1), preserve_index=False)

    return f.filter("w is not null").select("h", "w").mapInArrow(run, "key long, h long, sk long")


def vector_keys(f: DataFrame, space: sig.VectorSpace) -> DataFrame:
    """Key rows of the vector signatures of f(h, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield sig.key_rows(b["h"].to_numpy(), space.symbols(unit(stack(b["v"]))), 2)

    return f.filter("v is not null").select("h", "v").mapInPandas(run, "key long, h long, sk long")


def code_filter(pairs: DataFrame, f: DataFrame, space: sig.VectorSpace, min_cosine: float) -> DataFrame:
    """pairs(a, b) whose sign codes differ in no more bits than those of vectors with min_cosine do, and four deviations.

    The angle between vectors without the mean may be larger than that between the vectors; what the mean
    takes from them at most is known, so the limit allows for it.
    """
    n = sig.CODE_BITS
    left = max(0.05, 1 - float(space.mean @ space.mean))  # squared length that is left of an average vector
    share = float(np.arccos(max(-1.0, 1 - (1 - min_cosine) / left))) / np.pi
    limit = int(n * share + 4 * np.sqrt(n * share * (1 - share)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"h": b["h"], "code": list(space.codes(unit(stack(b["v"]))))})

    ids = materialise(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "p4-coded")
    few = ids.count() <= BROADCAST_IDS
    own = f.filter("v is not null").select("h", "v").join(F.broadcast(ids) if few else ids, "h", "left_semi")
    codes = materialise(own.mapInPandas(run, "h long, code array<long>").dropDuplicates(["h"]), "p4-codes")
    one, two = codes.select(F.col("h").alias("a"), F.col("code").alias("x")), codes.select(F.col("h").alias("b"), F.col("code").alias("y"))
    differ = sum(F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(n // 64))
    return pairs.join(one, "a").join(two, "b").filter(differ <= limit).select("a", "b")


def copy_classes(f: DataFrame, column: str, limit: int) -> DataFrame:
    """(c, c2, rep, n) of the values of a column that more than limit ids hold."""
    return (
        f.filter(F.col(column).isNotNull())
        .select(F.xxhash64(column).alias("c"), F.hash(column).alias("c2"), "id")
        .groupBy("c", "c2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("n"))
        .filter(F.col("n") > limit)
    )


def with_class(f: DataFrame, column: str, many: DataFrame, rows: int) -> DataFrame:
    """f with the copy class (c, c2, rep, n) of its column, null where there is none."""
    c, key = f.withColumns({"c": F.xxhash64(column), "c2": F.hash(column)}), ["c", "c2"]
    if many.count() <= BROADCAST_IDS:
        return c.join(F.broadcast(many), key, "left")
    # fewer than 64 classes hold more than 1/64 of all rows
    hot = F.broadcast(many.filter(F.col("n") > rows // 64))
    return c.join(hot, key).unionByName(c.join(hot, key, "left_anti").join(many.filter(F.col("n") <= rows // 64), key, "left"))


def near_duplicates(
    records: DataFrame,
    dim: int = DIM,
    min_cosine: float = MIN_COSINE,
    min_jaccard: float = MIN_JACCARD,
    min_words: int = MIN_WORDS,
    copies: int = COPIES,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records(id, content, vector) that are alike."""
    rows = records.count()
    f = materialise(features(records, dim, min_words), "p4-features")  # contents are read once
    df = sig.document_frequency(f.filter("w is not null").select(F.col("w").alias("h")))
    space = sig.VectorSpace.fit(f.filter("v is not null"), dim)
    stars, keys = [], []
    for column in ("w", "v"):
        # a third of all rows may be copies: one of them stands for all
        many = materialise(copy_classes(f, column, copies), "p4-copies")
        c = with_class(f.filter(F.col(column).isNotNull()), column, many, rows)
        stars.append(c.filter("rep is not null and rep <> id").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b")))
        one = c.filter("rep is null or rep = id").select("h", column)
        keys.append(word_keys(one, df, rows) if column == "w" else vector_keys(one, space))
    out = stars[0].unionByName(stars[1])
    for k, test, column, errors in zip(keys, tests(min_cosine, min_jaccard), ("w", "v"), (sig.WORD_ERRORS, sig.VECTOR_ERRORS)):
        pairs = materialise(sig.hamming_join(k, errors), "p4-pairs")
        if column == "v":  # inside a cluster many signatures are alike: sign codes are shorter to move than vectors
            pairs = materialise(code_filter(pairs, f, space, min_cosine), "p4-close")
        out = out.unionByName(verify(pairs, f.select("id", "h", F.col(column).alias("x")), test))
    return out.distinct()


def verify(pairs: DataFrame, f: DataFrame, test: Column) -> DataFrame:
    """(id_a, id_b) of candidate pairs(a, b) of id hashes that pass the exact test of their features f(id, h, x)."""
    ids = materialise(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "p4-ids")
    few = ids.count() <= BROADCAST_IDS
    g = f.join(F.broadcast(ids) if few else ids, "h", "left_semi")
    # exactly equal rows of one id give equal pairs, which distinct() at the end takes away
    one = g.select(F.col("h").alias("a"), F.col("id").alias("id1"), F.col("x").alias("x1"))
    two = g.select(F.col("h").alias("b"), F.col("id").alias("id2"), F.col("x").alias("x2"))
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .filter(test & (F.col("id1") != F.col("id2")))
        .select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"))
    )
