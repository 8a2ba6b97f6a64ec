"""Decontamination of texts and items that repeat a word, a pair or a line, against every diagonal, and in time."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from probitas.llm import decontaminate as D


def block(items):
    parts = [D.token_hashes(t).view(np.int64) for t in items]
    return D._Block(pa.table({"item_id": list(range(len(items))), "offset": [0] * len(items), "item_tokens": [len(p) for p in parts], "tokens": [p.tolist() for p in parts]}, schema=pa.schema([("item_id", pa.int64()), ("offset", pa.int64()), ("item_tokens", pa.int64()), ("tokens", pa.list_(pa.int64()))])))


def every_hit(items, text):
    """(item, diagonal's first best stretch) of every diagonal that has one, by plain comparison."""
    out, t = set(), D.token_hashes(text)
    for i, x in enumerate(items):
        b = D.token_hashes(x)
        w, k = D._allowed(len(b))
        for d in range(-len(b) + 1, len(t)):
            lo, hi = max(0, -d), min(len(b), len(t) - d)
            if hi - lo < w:
                continue
            same = (b[lo:hi] == t[lo + d : hi + d]).astype(int)
            equal = np.convolve(same, np.ones(w, dtype=int), "valid")
            if equal.max() >= w - k:
                s = int(equal.argmax())
                out.add((i, lo + d + s, lo + s, w, int(equal.max())))
    return out


@pytest.mark.parametrize("limit", [0, 30, 1 << 12])
def test_repeats_give_the_hits_of_every_diagonal(monkeypatch, limit):
    monkeypatch.setattr(D, "HOT_PAIRS", limit)
    rnd = random.Random(4)
    words = ["a", "b", "c", "d"]
    items = ["a " * 40, "a b " * 20, "x " * 12 + "a " * 20, " ".join(rnd.choice(words[:2]) for _ in range(60)), " ".join(f"w{i}" for i in range(30)), "a b c d e f g h"]
    b = block(items)
    for text in ("a " * 90, "a b " * 45, "c a a " * 20, items[4] + " " + "a " * 30, " ".join(rnd.choice(words[:2]) for _ in range(120)), "", "a " * 15):
        got = [tuple(map(int, h)) for h in b.overlaps(D.token_hashes(text))]
        assert len(got) == len(set(got)) and set(got) == every_hit(items, text)


def test_long_runs_take_seconds():
    """20,000 equal words against a whole piece of them, and against items with a short run: minutes if paired."""
    rest = " ".join(f"u{i}" for i in range(200))
    items = ["spam " * 4000] + [f"{rest} i{k} " + "spam " * 60 for k in range(20)]
    b, began = block(items), time.time()
    for text in ("spam " * 20000, "spam eggs " * 10000):
        hits = list(b.overlaps(D.token_hashes(text)))
        assert bool(hits) == text.startswith("spam spam")
    assert time.time() - began < 30


def test_blocks_one_at_a_time(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(40))) for i in range(6)], "doc_id long, text string")
    items = docs.selectExpr("doc_id AS item_id", "text").filter("item_id % 2 = 0")
    for tokens in (1 << 20, 40):
        assert sorted(r.doc_id for r in D.contaminated(docs, items, block_tokens=tokens).collect()) == [0, 2, 4]
    assert D.contaminated(docs, items.limit(0)).collect() == []
