"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Shards get rows: counts are at most one apart. How many rows of input partition p go to shard s
is drawn from the multivariate hypergeometric law, so that the whole is distributed as if all
rows had been permuted at once: the matrix has the partition sizes as row sums and the shard
sizes as column sums. Each partition then permutes its rows locally and deals them by its row of
the matrix; after the exchange each shard is permuted again. The second permutation is by random
keys in equal key ranges, whose first slots come from prefix sums, so a shard is no single task.

The input must be a plain read, as its partitions are counted in one pass and dealt in another;
a partition whose rows differ between the two fails the job. Every draw is seeded by partition,
so a task that runs again after a lost executor deals the same.

Defined results: a null text has no bytes (size 1) and the checksum of the empty text; repeated
rows are dealt one by one; an empty table gives an empty result; columns of the input named shard or
slot are replaced, others stay, whatever their names; texts of any length move whole; equal keys of
the second permutation are told apart by `tie`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas.cluster import ship_package
from probitas.llm.common import table

SHARDS, SEED, RANGE_ROWS = 16, 20240611, 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn; also for counts beyond the generator's limit."""
    if n == 0 or good == 0:
        return 0
    if bad == 0 or n == good + bad:
        return min(n, good)
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    lo, hi = max(0, n - bad, int(mode - 40 * sd - 40)), min(n, good, int(mode + 40 * sd + 40))
    k = np.arange(lo, hi, dtype=np.float64)  # p(k + 1) / p(k), as logarithms
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts, partitions by shards: row sums as given, column sums at most one apart."""
    rng = np.random.default_rng([seed, 0])
    total = sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        rest = sum(left)
        for s in range(shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, n)
            out[p, s] = k
            left[s] -= k
            n -= k
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with shard (from 0) and slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("shard", "slot")
    names = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names that nothing here clashes with
    tie = [f"c{names.index(c)}" for c in tie]
    counts = {r[0]: r[1] for r in docs.groupBy(F.spark_partition_id()).count().collect()}  # one row a partition
    rows = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    total = sum(rows)
    ranges = max(1, -(-total // (shards * RANGE_ROWS)))
    matrix = spark.sparkContext.broadcast(communication_matrix(rows, shards, seed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        mine = matrix.value[p] if p < len(matrix.value) else np.zeros(shards, dtype=np.int64)
        rng = np.random.default_rng([seed, 1, p])
        labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), mine))
        at = 0
        for b in batches:
            n = b.num_rows
            if at + n > len(labels):
                raise RuntimeError(f"partition {p} has more rows than were counted: the input must be a plain read")
            keys = rng.integers(0, 1 << 62, n)
            part = np.minimum((keys / float(1 << 62) * ranges).astype(np.int64), ranges - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels[at : at + n]), pa.array(part), pa.array(keys)], names=[*b.schema.names, "shard", "range", "key"])
            at += n
        if at != len(labels):
            raise RuntimeError(f"partition {p} has fewer rows than were counted: the input must be a plain read")

    def dealt(d: DataFrame) -> DataFrame:
        return d.mapInArrow(deal, T.StructType([*d.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("range", T.LongType()), T.StructField("key", T.LongType())]))

    sums = dealt(docs.select(*tie)).groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "range").orderBy("key", *tie)
    out = dealt(docs).withColumn("rank", F.row_number().over(within)).join(bases, ["shard", "range"])
    return out.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shuffle_to_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
