"""The prefix-filtered join against all pairs, on random names with every kind of overlap and hot words."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from probitas.operators import linkage as L
from probitas.operators import similarity as M


def entities(spark, seed, n, key):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Hotel", "Pvt", "Ltd", "Foods"]
    rows = []
    for i in range(n):
        size = rnd.choice([0, 1, 1, 2, 2, 3, 4, 5])
        name = " ".join(rnd.choice(words[:4]) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(size)) or rnd.choice([None, "Private Limited", "Ltd"])
        pick = lambda p, *of: rnd.choice(of) if rnd.random() < p else None  # noqa: E731, B023
        rows.append((i, 1, name, pick(0.5, "Pune", "Delhi"), pick(0.3, "a.com", "b.com", "c.com"), pick(0.3, "27A", "27B"), pick(0.2, "U1", "U2")))
    return spark.createDataFrame(rows, f"{key} long, one int, name string, location string, website string, gstin string, cin string")


@pytest.mark.parametrize(("seed", "threshold", "part"), [(1, 0.75, 4096), (2, 0.75, 3), (3, 0.9, 5)])
def test_corpus_pairs_are_all_pairs(spark, seed, threshold, part):
    t, c = entities(spark, seed, 150, "target_id"), entities(spark, seed + 100, 400, "candidate_id")
    names = t.select("target_id", F.col("name").alias("tn")), c.select("candidate_id", F.col("name").alias("cn"))
    every = L.score_pairs(t, c, "one").join(names[0], "target_id").join(names[1], "candidate_id")
    want = every.filter((F.col("score") >= threshold) & F.col("tn").isNotNull() & F.col("cn").isNotNull() | F.col("exact")).drop("tn", "cn")
    want = sorted(map(tuple, want.select("target_id", "candidate_id", "score", "exact", "conflict", "supported", "one_token").collect()))
    got = sorted(map(tuple, M.corpus_pairs(t, c, threshold, part).collect()))
    assert got == want and sum(not r[3] for r in got) > 100


def test_pairs_come_once_and_few_are_formed(spark):
    t, c = entities(spark, 7, 200, "target_id"), entities(spark, 8, 400, "candidate_id")
    formed = M.formed_pairs(t, c, part=10)
    n = formed.count()
    assert formed.select("target_id", "candidate_id").distinct().count() == n < 0.15 * 200 * 400
    with pytest.raises(ValueError, match="single shared word"):
        M.formed_pairs(t, c, 0.7)


def test_edges(spark):
    t, c = entities(spark, 1, 5, "target_id"), entities(spark, 2, 5, "candidate_id")
    assert M.corpus_pairs(t.limit(0), c).collect() == [] == M.corpus_pairs(t, c.limit(0)).collect()
    no_name = t.withColumn("name", F.lit(None).cast("string")).withColumn("key", F.lit(1)).withColumn("p", F.lit(1))
    assert all(r.exact for r in M.corpus_pairs(no_name, c).collect())
