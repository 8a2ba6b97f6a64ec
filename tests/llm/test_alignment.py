"""Alignment of tokenizers: the query against plain Python with no frames and no memory, counts on both ways, edges."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from probitas.llm import alignment

SF = "/root/testdata/sf0.001"
ODD = ["a  b", "  a", "a ", " ", "\n", "x\n\ny", "\t x", "don't  \n stop", "a b  c", "</s> <|endoftext|> x", "▁a", "é \x1c x", "日本語 テスト", "<0x41>", "a \n b", "x ''s!'d 12ab", "🙂🙂 ok", "I'll we've 'llx 's", "1²3 ½", "œuvre…x", "–a —b", "‘x’ “y”", "€5", "ǅa", "a_b__c", "x\t\ty", "('s 5's don'tx", "a\n", "\na", "a,b;c(d)e", "și ți"]


@pytest.fixture(scope="module")
def plain():
    """(ids, bytes) of both sides for one text, by the libraries alone."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    shown = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown.values()))}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def of(text):
        if not text:
            return [], []
        left = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        said = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == said == b"".join(x for _, x in right) else ([], [])

    return of


def expected(rows, plain):
    """Every figure of each (id, text), with each pair of tokens tried."""
    made, count = [], Counter()
    for i, text in rows:
        sides = []
        for tokens in plain(text):
            at, spans = 0, []
            for t, b in tokens:
                spans.append((at, at + len(b), t))
                at += len(b)
            sides.append(spans)
        a, b = sides
        links, lo = [], 0
        for x in a:
            while lo < len(b) and b[lo][1] <= x[0]:
                lo += 1
            k = lo
            while k < len(b) and b[k][0] < x[1]:
                links.append((x[2], b[k][2]))
                k += 1
        groups, x, y, p, q = [], [], [], 0, 0
        ends = sorted({s[1] for s in a} & {s[1] for s in b})
        for e in ends:
            x, y = [], []
            while p < len(a) and a[p][1] <= e:
                x.append(str(a[p][2]))
                p += 1
            while q < len(b) and b[q][1] <= e:
                y.append(str(b[q][2]))
                q += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        count.update(links)
        made.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, n_a, n_b, n_g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha) for i, n_a, n_b, n_g, links, sha in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op13(spark, plain):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = alignment.op13_tokenizer_alignment(spark, SF)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(expected([(d["doc_id"], d["text"]) for d in docs], plain))


def test_odd_texts_repeats_nulls_and_rare_pairs(spark, plain):
    """With a broadcast of few pairs or none, most counts come by the shuffle; the figures are the same."""
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(0, ODD[0], 1), (0, ODD[0], 1), (90, None, 1), (91, "", 1), (92, "the cat sat on the mat " * 300, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumnRenamed("row", "Row")
    want = Counter(expected([r[:2] for r in rows], plain))
    for hot in (0, 5, 1 << 18):
        assert Counter(map(tuple, alignment.align_digests(d, *alignment.default_paths(), hot=hot).collect())) == want
    none = [r for r in want if r[0] == 10]
    assert none == [(10, 0, 0, 0, 0, 0, 0, "")]
    null = d.filter("doc_id = 5").selectExpr("cast(null as long) as doc_id", "text")
    assert alignment.align_digests(null, *alignment.default_paths()).first().doc_id is None
    assert alignment.align_digests(d.limit(0), *alignment.default_paths()).collect() == []


def test_arrays(spark, plain):
    """What align() itself gives: ids, sizes of groups, both ids of each link."""
    texts = ["Tokenization differs, naïve 日本", *ODD]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in alignment.align(d, *alignment.default_paths()).collect():
        a, b = plain(texts[r.doc_id])
        assert (r.a_ids, r.b_ids) == ([i for i, _ in a], [i for i, _ in b])
        assert sum(r.group_a) == len(a) and sum(r.group_b) == len(b) and len(r.group_a) == len(r.group_b) and len(r.link_a) == len(r.link_b)


def test_remembered_chunks_are_what_the_libraries_give(monkeypatch):
    monkeypatch.setattr(alignment, "KEEP", 5000)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t] + ODD
    pair = alignment._Pair(*alignment.default_paths())
    assert pair.by_chunk
    for k in range(0, len(texts), 100):
        assert pair.of(texts[k : k + 100]) == list(pair.whole([" " + x for x in texts[k : k + 100]]))
    assert pair.older and len(pair.known) < 100_000


def test_least_count_of_the_broadcast(spark):
    counts = spark.createDataFrame([(n,) for n in [1] * 50 + [2] * 20 + [7] * 3 + [1000]], "n long")
    for limit in (0, 1, 3, 4, 30, 100):
        cut = alignment.hot_cut(counts, limit)
        assert counts.filter(f"n >= {cut}").count() <= limit
    assert alignment.hot_cut(counts, 100) == 1 and alignment.hot_cut(counts, 30) == 2 and alignment.hot_cut(counts.limit(0), 5) == 1


def test_texts_of_numbers_are_made_once():
    alignment._numbers.cache_clear()
    for k in range(40):  # batches of different greatest ids
        alignment.align_batch([f"word {chr(97 + k % 26)} {k} and more"], *alignment.default_paths(), ("groups_sha256",))
    assert alignment._numbers.cache_info().misses <= 12


def test_each_chunk_is_held_against_its_own_tokens():
    bytes_ = [b"ab", b"c", b"a", b"bc"]
    sizes = np.array([2, 1, 1, 2])
    of = lambda said, ids: alignment._Pair._spelled(said, ids, bytes_, sizes).tolist()
    assert of([b"abc", b"c"], [[0, 1], [1]]) == [True, True]
    assert of([b"ab", b"cc"], [[2], [3, 1]]) == [False, False]  # together they spell the same
    assert of([b"ab", b"c"], [[0], [2]]) == [True, False]
    assert of([b"", b"c"], [[], [1]]) == [True, True] and of([], []) == []
