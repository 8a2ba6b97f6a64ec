"""Periodic runs: the seeds against every lag and place, the query against plain Python, and edges."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import pyarrow.parquet as pq

from probitas.llm import periodic

SF = "/root/testdata/sf0.001"


def every_run(w, least=24, times=3):
    """Every maximal stretch of every lag that no shorter period explains."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, times * q) and not any(all(w[x] == w[x + r] for x in range(s, s + length - r)) for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_seeds_find_every_run():
    rnd = random.Random(11)
    found = 0
    for _ in range(600):
        n, k = rnd.randint(0, 160), rnd.choice([1, 2, 2, 3, 5, 50])
        w = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 30 else 0):
            a, p = rnd.randrange(n), rnd.randint(1, rnd.choice([3, 10, 45]))
            for i in range(a, min(n, a + p * rnd.randint(2, 6) + rnd.randint(0, p))):
                w[i] = w[a + (i - a) % p]
        least, times = rnd.choice([(24, 3), (24, 3), (10, 3), (6, 4), (2, 3), (40, 5)])
        want = every_run(w, least, times)
        found += len(want)
        assert periodic.runs_of(w, least, times) == want
    assert found > 500


def test_long_texts_take_time_in_proportion():
    began = time.time()
    assert periodic.runs_of(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of(["a", "b", "a"] * 60_000) == [(0, 180_000, 3)]
    assert periodic.runs_of([str(i % 33_333) for i in range(100_000)]) == [(0, 100_000, 33_333)]
    assert time.time() - began < 20


def test_overlapping_runs_drop_words_behind_any_first_period():
    w = ["x"] * 30 + ["x", "y"] * 20
    runs = periodic.runs_of(w)
    assert runs == every_run(w) == [(0, 31, 1), (30, 40, 2)]
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    assert periodic.collapsed(w, runs) == kept


def test_op11(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = [x.decode() for x in (d["text"] or "").encode().split()]
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = every_run(w) if len(w) <= 1500 else periodic.runs_of(w)
        some += bool(runs)
        r = got[d["doc_id"]]
        best = None
        for x in runs:
            if best is None or x[1] * best[2] > best[1] * x[2]:
                best = x
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert some > 10


def test_edges(spark):
    """Nulls, blanks, repeats, a null id, columns with the names that are used inside, and an empty table."""
    line = "the same line again "
    rows = [(1, line * 10, 7), (1, line * 10, 7), (None, None, 8), (2, "", 9), (3, " \n\t ", 1), (4, "a b " * 30, 2), (5, "one two", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, periodic int").withColumnRenamed("periodic", "Periodic")
    out = Counter(map(tuple, periodic.collapse_runs(d).collect()))
    want = [(1, "the same line again", 7)] * 2 + [(None, None, 8), (2, "", 9), (3, " \n\t ", 1), (4, "a b", 2), (5, "one two", 3)]
    assert out == Counter(want)
    marked = periodic.with_runs(d, "found").filter("doc_id = 1").first().found
    assert marked.n_words == 40 and [tuple(r) for r in marked.runs] == [(0, 40, 4)]
    assert periodic.collapse_runs(d.limit(0)).count() == 0
