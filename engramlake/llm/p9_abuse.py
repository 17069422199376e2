"""Scoring documents for abusive, hateful or sexually explicit language.

FTRL-proximal logistic regression over hashed word n-grams and skip-grams. A document's score is that
of its worst window of `WINDOW` words, so a long harmless text does not hide one harmful sentence;
training follows the same rule, updating with the features of the window that scores highest at that
moment. Per-coordinate rates and L1 leave few weights other than zero. They are fitted on a sample of
at most `MAX_TRAIN` labelled documents of at most `MAX_WORDS` words (smallest hashes of doc_id) and number at most 2 ** BITS, which bounds what
one task of the fit holds and what is broadcast. Every document is scored, whole.

Words are normalised before hashing: letters of other scripts that look Latin, accents, digits and
signs used as letters, zero-width characters, separators inside words, letters spelt apart and
repeated letters.

Labels are noisy: null ones are dropped, contradictory ones decided by majority or dropped. The rest is
judged on held-out halves (documents with much text in common fall into the same half): a label that
the other half's model clearly contradicts is left out of the second fit. The scores of its two halves
on each other, again held out, give the cut with the best F1 against all labels, and the bias is moved so that
this cut is a score of 0.5.

Edge cases: null and empty texts score like a window without features; repeated doc_ids are scored
row by row; without any harmful or harmless label nothing can be learnt, and all scores are 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..tables import clean

BITS = 20
WINDOW = 16
MAX_TRAIN, MAX_WORDS = 20_000, 4_000
#: Held-out scores below and above which a harmful and a harmless label count as wrong.
DOUBT = (0.05, 0.9)
HARMFUL = ("abusive", "hateful", "sexual")

# Look-alike letters of the Cyrillic and Greek scripts, and signs used as letters.
LOOKALIKE = str.maketrans("асеіјорѕухкмтнвԁԛѡαβεικνορτυχ", "aceijopsyxkmthbdqwabeiknoptux")
SIGNS = str.maketrans("0134578@$!|€", "oieastbasiie")
MASKS = "*#_"

#: Zero-width characters, for Arrow's regular expressions.
_ZERO = "[\u00ad\u200b-\u200f\u2060\ufeff]"
#: Texts that are cut into words together.
SLICE = 2_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SPLIT = re.compile(r"[,;:!?()\[\]{}<>\"“”«»/=|]+")
_DROP = re.compile(rf"[^\w{re.escape(MASKS)}]+")
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = ",;:!?()[]{}<>\"'.-"
_REPEAT = re.compile(r"(.)\1+")


def normal_words(token: str) -> list[str]:
    """The normalised words of one blank-separated, lower-cased token."""
    plain = token.strip(_PLAIN)
    if plain.isalpha() and plain.isascii():  # most tokens; the rest of the way would change nothing else
        return [_REPEAT.sub(r"\1", plain)]
    out = []
    for part in _SPLIT.split(token):
        if _LETTER.search(part):
            part = _EDGE.sub("", part if part.isalpha() else part.translate(SIGNS))
            if not part.isascii():
                part = "".join(c for c in unicodedata.normalize("NFKD", part) if not unicodedata.combining(c)).translate(LOOKALIKE)
            part = _REPEAT.sub(r"\1", _DROP.sub("", part))
            if part:
                out.append(part)
    return out


class _Hashes(dict):
    """Token -> (hashes of its words, its letter if it is but one); kept for the life of a task, emptied when large."""

    def __missing__(self, token: str) -> tuple[tuple[int, ...], str]:
        if len(self) > 500_000:
            self.clear()
        w = normal_words(token)
        one = w[0] if len(w) == 1 and len(w[0]) == 1 and w[0].isalpha() else ""
        h = self[token] = tuple(zlib.crc32(x.encode()) for x in w), one
        return h


def hashed_words(texts: pa.Array, cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); three or more single letters in a row are one word."""
    clean_ = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), _ZERO, ""))
    tokens = pc.utf8_split_whitespace(clean_)
    ends = tokens.offsets.to_numpy()[1:] - tokens.offsets[0].as_py()
    coded = tokens.flatten().dictionary_encode()
    known = [cache[t] for t in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy()
    size = np.array([len(k[0]) for k in known], np.int64)
    flat = np.array([h for k in known for h in k[0]], np.uint64)
    first = np.cumsum(size) - size
    n = size[code] if len(code) else np.zeros(0, np.int64)
    letters = np.array([bool(k[1]) for k in known], bool)
    extra: dict[int, int] = {}
    if letters.any():
        text = np.searchsorted(ends, np.arange(len(code)), "right")
        at = np.flatnonzero(letters[code])
        for run in np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(text[at]) != 0)) + 1):
            if len(run) >= 3:
                n[run] = 0
                n[run[0]] = 1
                extra[int(run[0])] = zlib.crc32(_REPEAT.sub(r"\1", "".join(known[c][1] for c in code[run])).encode())
    total = np.concatenate([[0], np.cumsum(n)])
    start = first[code] if len(code) else n
    h = flat[np.arange(total[-1]) + np.repeat(start - total[:-1], n)] if total[-1] else np.zeros(0, np.uint64)
    for i, x in extra.items():
        h[total[i]] = x
    return h, np.diff(total[ends], prepend=0)


def features(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashed feature indexes that begin at each word: 1-, 2- and 3-grams and two skip-grams.

    Index 2 ** BITS stands for none (the gram would leave its text).
    """
    none = 1 << BITS
    text = np.repeat(np.arange(len(n)), n)
    out = np.full((len(h), 5), none, np.int32)

    def put(col: int, x: np.ndarray, reach: int) -> None:
        x = x * np.uint64(0x9E3779B97F4A7C15)
        idx = (x >> np.uint64(64 - BITS)).astype(np.int32)
        ok = text[: len(idx)] == text[reach : reach + len(idx)] if reach else slice(None)
        out[: len(idx), col][ok] = idx[ok]

    a, b, c = (np.uint64(k) for k in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    put(0, h + np.uint64(1), 0)
    if len(h) > 1:
        put(1, h[:-1] * a + h[1:] * b + np.uint64(2), 1)
    if len(h) > 2:
        put(2, h[:-2] * a + h[1:-1] * b + h[2:] * c, 2)
        put(3, h[:-2] * a + h[2:] * b + np.uint64(3), 2)
    if len(h) > 3:
        put(4, h[:-3] * a + h[3:] * b + np.uint64(4), 3)
    return out


def worst_windows(w: np.ndarray, f: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score without bias, first word) of the highest scoring window of each text."""
    score = np.zeros(len(start))
    first = start.copy()
    if len(f):
        c = np.concatenate([[0.0], np.cumsum(w[f].sum(axis=1))])
        full = np.flatnonzero(end > start)
        text_end = np.repeat(end[full], (end - start)[full])
        i = _ranges(start[full], (end - start)[full])
        sums = c[np.minimum(i + WINDOW, text_end)] - c[i]
        offsets = np.concatenate([[0], np.cumsum((end - start)[full])[:-1]])
        best = np.maximum.reduceat(sums, offsets)
        hit = np.flatnonzero(sums == np.repeat(best, (end - start)[full]))
        at = hit[np.searchsorted(hit, offsets)]
        score[full], first[full] = best, i[at]
    return score, first


def ftrl(f, start, end, y, epochs: int = 5, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, batch: int = 128, seed: int = 0):
    """(weights, bias) of FTRL-proximal; the first epoch uses all words of a text, later ones its worst window."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bz, bn, bias = 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    bias0 = bias
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            b = order[k : k + batch]
            lo, hi = start[b], end[b]
            if epoch:
                m = hi - lo
                ends = np.cumsum(m)
                _, first = worst_windows(w, f[_ranges(lo, m)], ends - m, ends)
                lo = lo + first - (ends - m)
                hi = np.minimum(lo + WINDOW, hi)
            doc = np.repeat(np.arange(len(b)), hi - lo)
            idx, own = f[_ranges(lo, hi - lo)].ravel(), np.repeat(doc, f.shape[1])
            keep = idx < size - 1
            key = np.unique(own[keep].astype(np.int64) * size + idx[keep])  # presence, not counts
            own, idx = key // size, key % size
            g = 1 / (1 + np.exp(-np.clip(bias + np.bincount(own, w[idx], len(b)), -35, 35))) - y[b]
            u, inv = np.unique(idx, return_inverse=True)
            gu = np.bincount(inv, g[own])
            sigma = (np.sqrt(n[u] + gu * gu) - np.sqrt(n[u])) / alpha
            z[u] += gu - sigma * w[u]
            n[u] += gu * gu
            w[u] = np.where(np.abs(z[u]) <= l1, 0.0, -(z[u] - np.sign(z[u]) * l1) / ((beta + np.sqrt(n[u])) / alpha + l2))
            gb = g.sum() / len(b)
            s2 = (np.sqrt(bn + gb * gb) - np.sqrt(bn)) / alpha
            bz += gb - s2 * (bias - bias0)
            bn += gb * gb
            bias = bias0 - bz / ((beta + np.sqrt(bn)) / alpha)
    return w, bias


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those from start[1], and so on."""
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(start - (total - n), n)


def halves(f: np.ndarray, n: np.ndarray) -> np.ndarray:
    """0 or 1 for each text, by the smallest hash of its runs of three words: near-copies mostly fall together."""
    least = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        mixed = f[:, 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        least[full] = np.minimum.reduceat(mixed, (np.cumsum(n) - n)[full])
    return ((least * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(int)


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The score between two texts above which F1 against y is best; 0 where nothing can be told."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order])
    if not len(y) or not right[-1]:
        return 0.0
    s = score[order]
    last = np.append(s[1:] < s[:-1], True)  # equal scores go together
    f1 = np.where(last, 2 * right / (np.arange(1, len(y) + 1) + right[-1]), -1)
    i = int(f1.argmax())
    return float(s[i] if i + 1 == len(s) else (s[i] + s[i + 1]) / 2)


MODEL = "doc_id long, idx long, value double"


def _train(pdf: pd.DataFrame, half: int) -> pd.DataFrame:
    """MODEL rows: held-out scores (before the logistic function) of one half by a fit on the other; for half 2 the weights of a fit on both.

    A text without `trusted` is scored, but not fitted on.
    """
    pdf = pdf.sort_values("doc_id")
    y, n = pdf["harmful"].to_numpy(float), pdf["h"].map(len).to_numpy(np.int64)
    f = features(np.concatenate([np.zeros(0, np.uint64), *(np.asarray(x, np.int64).view(np.uint64) for x in pdf["h"])]), n)
    end = np.cumsum(n)
    start = end - n
    own = halves(f, n)
    rows = np.flatnonzero(pdf["trusted"].to_numpy(bool) & (own != half))
    fits = 0 < y[rows].sum() < len(rows)
    w, bias = ftrl(f, start[rows], end[rows], y[rows]) if fits else (np.zeros((1 << BITS) + 1), -30.0)
    if half < 2:
        t = own == half
        return pd.DataFrame({"doc_id": pdf["doc_id"][t], "idx": -2, "value": worst_windows(w, f, start, end)[0][t] + bias})
    idx = np.flatnonzero(w[:-1])
    return pd.DataFrame({"doc_id": -1, "idx": [-1, *idx], "value": [bias, *w[idx]]})


def labelled(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, harmful): at most max_train documents with a label that most of its rows agree on."""
    label = clean(F.col("label"))
    votes = (
        labels.filter(label.isin("none", *HARMFUL))
        .select("doc_id", (label != "none").cast("int").alias("v"), "annotator")
        .distinct()
        .groupBy("doc_id")
        .agg(F.avg("v").alias("v"))
        .filter("v <> 0.5")
        .select("doc_id", (F.col("v") > 0.5).cast("int").alias("harmful"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    return documents.select("doc_id", "text").join(votes, "doc_id")


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for b in batches:
        h, n = hashed_words(b.column("text"), cache)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("harmful"), words], ["doc_id", "harmful", "h"])


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> tuple[np.ndarray, float]:
    """(weights, bias). At most 2 ** BITS weights and max_train held-out scores come to the driver."""
    sample = labelled(documents, labels, max_train).select(F.col("doc_id").cast("long"), "text", "harmful")
    sample = sample.mapInArrow(_hash_texts, "doc_id long, harmful int, h array<long>").filter(F.size("h") <= max_words)
    sample = materialise(sample.dropDuplicates(["doc_id"]), "p9-sample")
    runs = lambda *k: F.explode(F.array(*[F.lit(i) for i in k])).alias("half")

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _train(pdf, key[0])

    first = sample.select("*", F.lit(True).alias("trusted"), runs(0, 1)).groupBy("half").applyInPandas(train, MODEL)
    held = F.broadcast(materialise(first.select("doc_id", (1 / (1 + F.exp(-F.col("value")))).alias("p")), "p9-held"))  # one number a text
    trusted = F.when(F.col("harmful") == 1, F.col("p") >= DOUBT[0]).otherwise(F.col("p") <= DOUBT[1])
    second = sample.join(held, "doc_id").select("doc_id", "harmful", "h", trusted.alias("trusted"), runs(0, 1, 2))
    got = second.groupBy("half").applyInPandas(train, MODEL).join(F.broadcast(sample.select("doc_id", "harmful")), "doc_id", "left").toPandas()
    w = np.zeros((1 << BITS) + 1, np.float32)
    own, bias, scored = got[got["idx"] >= 0], got.loc[got["idx"] == -1, "value"], got[got["idx"] == -2].sort_values("doc_id")
    w[own["idx"].to_numpy(int)] = own["value"]
    if not len(own):
        return w, -30.0
    return w, float(bias.iloc[0]) - best_cut(scored["value"].to_numpy(float), scored["harmful"].to_numpy(float))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, source, score) of every document; score is that of its worst window, 0.5 at the cut chosen in the fit."""
    w, bias = model
    idx = np.flatnonzero(w).astype(np.int32)
    sparse = documents.sparkSession.sparkContext.broadcast((idx, w[idx]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[sparse.value[0]] = sparse.value[1]
        cache = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                h, n = hashed_words(b.column("text"), cache)
                end = np.cumsum(n)
                s, _ = worst_windows(weights, features(h, n), end - n, end)
                p = 1 / (1 + np.exp(-np.clip(s + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(p)], ["doc_id", "source", "score"])

    d = documents.select(F.col("doc_id").cast("long"), clean(F.col("source")).alias("source"), "text")
    return d.mapInArrow(run, "doc_id long, source string, score double")


def flag_rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, docs, flagged, rate) of every source; a null source is one of its own."""
    return scored.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("score") >= threshold).alias("flagged"),
        F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("rate"),
    )
