"""The pipeline's near-dedup stage against brute force over planted copies."""

from __future__ import annotations

from itertools import combinations

import numpy as np

import corpus_pipeline
from probitas.llm import simhash, similar

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w)} if len(w) < 5 else {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def planted(size, copies, seed):
    """Texts of `size` words, each with copies that differ in a few words, some of them below 0.8."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(12):
        base = rng.choice(WORDS, size)
        for k in range(copies):
            w = base.copy()
            for p in rng.choice(size, int(rng.integers(0, max(2, size // 30))) if k else 0, replace=False):
                w[p] = f"new{rng.integers(1 << 30)}"
            rows.append(" ".join(w))
    return rows


def brute_kept(rows):
    """Doc ids that stay: the least of each group of linked texts."""
    label, sets = list(range(len(rows))), [grams(t) for _, t in rows]
    pairs = [(x, y) for x, y in combinations(range(len(rows)), 2) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    for _ in rows:
        before = list(label)
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    return [None if none else i for none, i in sorted(least.values())], len(pairs)


def test_near_dedup_stage_keeps_what_brute_force_keeps(spark):
    texts = planted(150, 4, 1) + planted(60, 3, 2) + planted(600, 3, 3) + ["one two", "ONE  two", None, "", " \n", "one two three"]
    texts += [" ".join(np.random.default_rng(9 + i).choice(WORDS, 80)) for i in range(40)]
    rows = list(enumerate(texts, 1000))
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, pairs = brute_kept(rows)
    assert pairs > 60 and len(want) > 60
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    empty = docs.limit(0)
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0


def test_large_group_and_null_ids(spark):
    rng = np.random.default_rng(4)
    base, rows = rng.choice(WORDS, 120), []
    for i in range(300):  # a chain and a crowd: copies of copies, so that not all are near one centre
        w = base.copy()
        for p in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[p] = f"new{rng.integers(1 << 30)}"
        rows.append((i if i % 7 else None, " ".join(w)))
    lone = " ".join(rng.choice(WORDS, 50))
    rows += [(None, lone), (None, lone + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_kept(rows)
    got = [r.doc_id for r in similar.drop_similar(docs).collect()]
    key = lambda i: (i is None, i or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_large_buckets_are_asked_in_full(spark):
    """With one neighbour in round two, links of a large bucket come from the last round; brute force agrees."""
    rng = np.random.default_rng(12)
    base, rows = rng.choice(WORDS, 100), []
    for i in range(90):  # crowds around six texts that are themselves near the bound
        w = base.copy()
        for p in range((i % 6) * 3):
            w[99 - p] = f"crowd{i % 6}x{p}"
        for p in rng.choice(80, int(rng.integers(0, 4)), replace=False):
            w[p] = f"new{rng.integers(1 << 30)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_kept(rows)
    groups = similar.similar_groups(docs, following=1).groupBy("label").agg({"doc_id": "min"}).collect()
    assert sorted(r[1] for r in groups) == want


def test_sketch_bound_holds():
    rng = np.random.default_rng(5)
    for size in (1, 20, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        y = np.union1d(x[: -size // 5 or None], rng.integers(0, 1 << 63, size // 6, dtype=np.uint64))
        differ = np.unpackbits((similar.sketch(x) ^ similar.sketch(y)).view(np.uint8)).sum()
        assert differ <= len(np.setxor1d(x, y))


def test_simhash_proposes_where_minhash_does_not(spark, monkeypatch):
    rng, rows = np.random.default_rng(5), []
    for k in range(6):
        base = rng.choice(WORDS, 3000)
        near = base.copy()
        near[17] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    rows += [(50, rows[0][1].upper()), (51, "short text"), (52, "short  text")]
    bits = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for (_, a), (_, b) in zip(rows[:12:2], rows[1:12:2], strict=True)]
    assert all(n <= 3 for n in bits)
    # bands that no two texts share
    monkeypatch.setattr(similar, "band_keys", lambda h: __import__("numpy").random.default_rng().integers(1 << 62, size=50))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want, _ = brute_kept(rows)
    assert want == [0, 2, 4, 6, 8, 10, 51]
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == want
