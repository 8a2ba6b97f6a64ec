"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Every word gives two symbols, its letters in lower case and its shape (case and punctuation);
features are the uni- and bigrams of both, hashed to a fixed number of weights. A text's value of
a feature is its count over the square root of all counts, and a score is the logistic of one
sparse dot product. Training goes in `SHARDS` tasks: each learns by FTRL-proximal over its part
of the labelled rows, and the weights are averaged. Labelled rows are at most about `MAX_ROWS`,
the ones of least hash, so that what reaches the driver is bounded: SHARDS vectors of 2^18.

Only the text is an input of a score. Texts become features before they are dealt to the shards. A
shard has their distinct features and counts in memory, so the documented bound of rows, and 2^18
features a row, bound it.

Defined results: a null, empty or blank text scores by the bias alone; without training rows every
score is 0.5; null labels are left out; of repeated labels the least counts; repeated rows score
alike; a null doc_id counts as the empty text in the split and never joins a label; rows of equal
hash are learnt in the order of their features; an empty table gives an empty result; texts of any
length are read whole; columns of any name stay as they are, but scored() replaces score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import ship_package
from probitas.llm.common import all_of, id_remainder, table

BITS, SHARDS, MAX_ROWS, EPOCHS, THRESHOLD = 18, 8, 1 << 16, 3, 0.7
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 1.0
_KEEP = 1 << 18
_RUN = re.compile(r"[^\W\d_]+|\d+|[\W_]+")


def _shape(word: str) -> str:
    """Runs of letters, digits and signs: 'Ab', 'AB', 'ab', '1', or the first signs themselves."""
    out = []
    for run in _RUN.findall(word)[:6]:
        if run.isalpha():
            out.append("AB" if run.isupper() and len(run) > 1 else "Ab" if run[:1].isupper() else "ab")
        else:
            out.append("1" if run.isdigit() else run[:3])
    return "\x01".join(out)


class _Symbols(dict):
    """Hashes of a word's letters and shape in one integer, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEEP:
            self.clear()
        w = word.decode("utf-8", "replace")
        core = "".join(c for c in w if c.isalnum()).lower()
        h = self[word] = (xxhash.xxh32_intdigest(core) << 32) | xxhash.xxh32_intdigest(_shape(w), 1)
        return h


_symbols = _Symbols()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Indices of a text's features, repeats included; index 0 of the weights is kept for the bias."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    v = np.fromiter(map(_symbols.__getitem__, words), dtype=np.uint64, count=len(words))
    core, shape = v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)
    odd = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)
    grams = [core * odd[0], shape * odd[1], core[:-1] * odd[2] + core[1:] * odd[0], shape[:-1] * odd[3] + shape[1:] * odd[1]]
    grams.append(np.full(int((core[:-1] == core[1:]).sum()), odd[0] + odd[1]))  # any word after itself
    h = np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)
    return np.maximum((h >> np.uint64(64 - bits)).astype(np.int64), 1)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def score(text: str | None, weights: np.ndarray) -> float:
    i = features(text)
    return _logistic(weights[0] + (weights[i].sum() / np.sqrt(len(i)) if len(i) else 0.0))


def counted(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features, ascending, and their counts."""
    i, c = np.unique(features(text, bits), return_counts=True)
    return i.astype("<i4"), c.astype("<i4")


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], prior: float = 0.0, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights by FTRL-proximal over the rows (features, counts, label) in the given order, epochs
    times; prior: log odds that every score begins with."""
    z, n, w = (np.zeros(1 << bits) for _ in range(3))
    for _ in range(epochs):
        for f, c, y in rows:
            i = np.concatenate([[0], f])
            x = np.concatenate([[1.0], c / np.sqrt(max(1, int(c.sum())))])
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1 * (i > 0), 0.0, -(zi - np.sign(zi) * L1 * (i > 0)) / ((BETA + np.sqrt(ni)) / ALPHA + L2 * (i > 0)))
            g = (_logistic(prior + float(wi @ x)) - y) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - s * wi
            n[i] = ni + g * g
    on = np.arange(1 << bits) > 0
    w = np.where(np.abs(z) <= L1 * on, 0.0, -(z - np.sign(z) * L1 * on) / ((BETA + np.sqrt(n)) / ALPHA + L2 * on))
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shards: int = SHARDS) -> np.ndarray:
    """Weights from docs (doc_id, text) and labels (doc_id, quality) outside the held-out quarter."""
    ship_package(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).filter(id_remainder(4) != 2)
    known = known.withColumn("r", F.xxhash64("doc_id", F.lit("ftrl")))
    n = known.count()
    if n > max_rows:  # the rows of least hash, about max_rows
        known = known.filter(F.col("r") < int(-(1 << 63) + (1 << 64) * (max_rows / n)))
    # the ids are bounded by max_rows, so texts stay where they are read and only sampled ones move
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y", "r", F.pmod(F.hash("r"), F.lit(shards)).alias("shard"))

    @F.pandas_udf("f binary, c binary")
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[x.tobytes() for x in counted(t)] for t in s], columns=["f", "c"], dtype=object)

    # an id that documents repeat is one row, the one of least text hash, so max_rows bounds the rows of a shard too
    rows = rows.select("doc_id", "shard", "r", "y", F.xxhash64("text").alias("h"), of("text").alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("shard", "r", "y", "x.f", "x.c"), F.col("h")).alias("row")).select("row.*")

    good, all_ = known.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    prior = float(np.log((good + 1) / (all_ - good + 1)))  # a text of few words stays near the share of good ones

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "f", "c"])
        w = train_ftrl([(np.frombuffer(f, dtype="<i4"), np.frombuffer(c, dtype="<i4"), y) for f, c, y in zip(pdf["f"], pdf["c"], pdf["y"], strict=True)], prior)
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype("<f4").tobytes()]})

    parts = rows.groupBy("shard").applyInPandas(learn, "n long, w binary").collect()  # `shards` rows
    total = sum(p.n for p in parts)
    w = sum((np.frombuffer(p.w, dtype="<f4").astype(np.float64) * (p.n / total) for p in parts), np.zeros(1 << BITS))
    w[0] += prior
    return w


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with a double column score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for s in batches:
            yield pd.Series([score(t, w) for t in s], dtype="float64")

    return docs.withColumn("score", of("text"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that the classifier accepts."""
    row = docs.select(F.struct(*all_of(docs)).alias("row"), "text")
    return scored(row, train(docs, labels)).filter(F.col("score") >= threshold).select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return d.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
