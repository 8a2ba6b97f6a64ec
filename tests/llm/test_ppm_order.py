"""The byte model at op4's order against brute force, in one block and in several."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from probitas.llm import ppm


def brute(train, text, order):
    count = defaultdict(Counter)
    for t in train:
        s = [254] * order + list(t) + [255]
        for j in range(order, len(s)):
            for k in range(order + 1):
                count[tuple(s[j - k : j])][s[j]] += 1
    s, total = [254] * order + list(text) + [255], 0.0
    for j in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            c = {a: n for a, n in count[tuple(s[j - k : j])].items() if a not in out}
            n, q = sum(c.values()), len(c)
            if s[j] in c:
                total += log10(c[s[j]] / (n + q))
                break
            if q:
                total += log10(q / (n + q))
            out |= set(c)
        else:
            total -= log10(256 - len(out))
    return total


def test_order_of_op4(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "x"], 30)) + f" {i}") for i in range(40)] + [(90, None), (91, "\x00\x00\x00\x00\x00\x00 zz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10 != 0]
    for limit in (1 << 22, 100):
        monkeypatch.setattr(ppm.score_documents, "__defaults__", (ppm.HEAD, ppm.ORDER, limit))
        got = {r.doc_id: r.score for r in ppm.op4_ppm_scoring(spark, str(tmp_path)).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            assert got[i] == pytest.approx(brute(train, (t or "").encode(), 5), abs=1e-3)
