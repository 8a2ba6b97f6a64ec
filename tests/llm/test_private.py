"""Personal data: base spans against the plain patterns, the query, EM against known truth, planted spans."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from probitas.llm import private

SF = "/root/testdata/sf0.001"


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain(t):
    """The four patterns as they are said, by the library's own search."""
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and private.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15],
    }


def card(rnd, n=16, head="4"):
    while True:
        d = head + "".join(str(rnd.randrange(10)) for _ in range(n - len(head)))
        if private.luhn(d):
            return d


def test_base_spans_are_the_patterns():
    rnd = random.Random(3)
    found = Counter()
    for _ in range(20000):
        signs = rnd.choice([["ab@.-_1"], ["12.3"], ["+1 ().-234567"], ["ab@.-_1", "0123456789. -", "+1 ().-23@a", "@@a.b", "12.3"]])
        t = "".join(rnd.choice(rnd.choice(signs)) for _ in range(rnd.randint(0, 40)))
        want = plain(t)
        assert private.base_spans(t) == want
        found.update(k for k, v in want.items() if v)
    for t in (f"x {card(rnd)} y", " ".join(card(rnd)), "x" * 100 + "@b.c", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256"):
        assert private.base_spans(t) == plain(t)
    assert min(found[k] for k in ("email", "ip", "phone")) > 50


def test_hostile_texts_take_little_time():
    began = time.time()
    for t in ("a" * 100000, "1" * 100000, "1." * 50000, "a@" * 50000, "+1" + " " * 100000, "1 " * 50000, "a." * 50000 + "@b", "@" * 50000, "a" * 100000 + "@b.c", "1:" * 40000, "(1" * 40000, "[at]" * 20000, "0000-" * 10000):
        found = private.candidates(t)
        private.chosen([(*c[:4], 0.9) for c in found], 0.5)
    assert time.time() - began < 30


def test_em_finds_how_often_labelers_are_right():
    rnd = np.random.default_rng(5)
    truth = rnd.random(40000) < 0.3
    right = np.array([[0.95, 0.9, 0.7, 0.8], [0.9, 0.97, 0.75, 0.85]])
    votes = np.array([[0 if rnd.random() < 0.3 else (1 if y else -1) * (1 if rnd.random() < right[0 if y else 1, j] else -1) for j in range(4)] for y in truth])
    vectors, number, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, got, share = private.label_model(vectors, counts.astype(float))
    assert abs(share - truth.mean()) < 0.02 and np.abs(got - right).max() < 0.03
    most = np.sign(votes.sum(1)) > 0
    v = votes[:, :, None] == np.array([1, -1])
    odds = np.log(0.3 / 0.7) + (v * np.log(np.stack([right[0] / (1 - right[1]), (1 - right[0]) / right[1]], 1))).sum((1, 2))
    best = ((odds > 0) == truth).mean()  # with the true rates known
    assert best - 0.003 < ((p[number.ravel()] > 0.5) == truth).mean() > (most == truth).mean()


def planted(n=1200):
    """Texts with spans that no base pattern takes, and numbers that only look like one: (id, text, kind, the true spans)."""
    rnd = random.Random(9)
    out = []
    for i in range(n):
        a, b, c = rnd.randint(200, 989), rnd.randint(200, 999), rnd.randint(1000, 9999)
        words = " ".join(rnd.choice("lorem ipsum dolor sit amet sed do".split()) for _ in range(8))
        kind, said, true = [
            ("phone", f"call +1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}"),
            ("phone", f"call ({a}) {b}-{c}", f"({a}) {b}-{c}"),
            ("phone", f"order {a}-{b}-{c}", None),
            ("email", f"mail joe{i}@mail.example.com", f"joe{i}@mail.example.com"),
            ("email", f"contact joe{i} [at] example [dot] com", f"joe{i} [at] example [dot] com"),
            ("email", f"image joé{i}@2x.png", None),
            ("card", f"card {card(rnd)}", "same"),
            ("card", f"visa {rnd.randint(10, 99)} {card(rnd)}", "last"),
            ("card", f"hash {rnd.randint(10**13, 10**14 - 1)}", None),
            ("ip", f"server {a % 200 + 1}.{b % 250}.7.{c % 250}", "same"),
            ("ip", f"host 10[.]{b % 250}[.]7[.]{c % 250}", "same"),
        ][i % 11]
        if kind == "card" and i % 11 == 8 and private.luhn(said.split()[1]):
            said = "hash " + str(int(said.split()[1]) + 1)
        true = said.split()[1] if true == "same" else said.split()[2] if true == "last" else true
        text = f"{words} {said} {words}"
        out.append((i, text, kind, [] if true is None else [(text.index(true), text.index(true) + len(true))]))
    return out


def test_planted_spans(spark):
    rows = planted()
    got = {r.doc_id: r.spans for r in private.find_private(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    right, added = 0, 0
    for i, text, kind, true in rows:
        base = plain(text)[kind]
        assert set(base) <= {(s.start, s.end) for s in got[i] if s.kind == kind}
        right += sorted({(s.start, s.end) for s in got[i] if s.kind == kind} - (set(base) - set(true))) == true
        added += not base and bool(true)
    assert added > 250 and right / len(rows) > 0.97


def test_op12(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in private.op12_personal_data(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        base, r = plain(d["text"] or ""), got[d["doc_id"]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in private.KINDS]
        parts = [f"{k}:{s}:{e}" for k in private.KINDS for s, e in base[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(parts).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert set(parts) <= {":".join(x) for x in spans} and spans == sorted(spans, key=lambda x: (private.KINDS.index(x[0]), int(x[1])))
        some += bool(parts)
    assert some > 3


def test_rows_in_any_order_learn_the_same(spark):
    rows = [r[:2] for r in planted(330)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (private.learn(private.find_candidates(x), 20) for x in (d, d.orderBy(d.doc_id.desc()).repartition(3)))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_edges(spark):
    rows = [(1, "mail a@b.com", 1), (1, "mail a@b.com", 1), (None, None, 2), (2, "", 3), (3, " \n", 4), (4, "a@b.com 1.2.3.4 é +1 (234) 555-1234", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, found int").withColumnRenamed("found", "Found")
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end, s.base) for s in r.spans)) for r in private.find_private(d).collect())
    mail = (1, (("email", 5, 12, True),))
    assert got == Counter([mail, mail, (None, ()), (2, ()), (3, ()), (4, (("email", 0, 7, True), ("ip", 8, 15, True), ("phone", 18, 35, True)))])
    assert private.find_private(d.limit(0)).collect() == [] and private.find_private(d.filter("doc_id = 2")).first().spans == []
