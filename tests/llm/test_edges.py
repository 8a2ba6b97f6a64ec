"""Names that clash with any that operators use inside, and what a whole pipeline keeps of planted rows."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from probitas.cluster import _session, release, scratch, stage
from probitas.llm import chat, classifier, decontaminate, mixing, ppm, quality_rules, sharding, similar, simhash, token_files, url_filter

NAMES = ("_copy _n _key _copies _kept _leak _words _lines _range _rank _base _id _good key key_ n n_ s s_ at at_ copy copy_ leak range_ rank_ base_ row words lines cut cut_s cut_of cut_cut more epochs extra taken size "
         "h fp node label component group_id component_id text_hash step stratum of base_failed fit hits rule verdict window place again tokens block head p q k a.b `c` UPPER").split()  # fmt: skip
WORDS = [f"w{i}" for i in range(500)]


def text_of(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Documents with repeats, nulls and near copies, and a column of every name, all of which hold the row's number."""
    texts = [text_of(i, 80) for i in range(12)]
    texts += [texts[0], texts[1] + " more", None, None, "", " ", "x y", text_of(50, 4000)]
    rows = [(i, t, "en", "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[3], None, "s1", 1), (None, None, None, None, None)]
    d = spark.createDataFrame([(*r, *[i] * len(NAMES)) for i, r in enumerate(rows)], ", ".join(f"{n} {k}" for n, k in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"), *((f"`{n.replace('`', '``')}`", "int") for n in NAMES))))
    path = str(tmp_path_factory.mktemp("wide") / "d")
    d.write.parquet(path)
    return spark.read.parquet(path), rows


def whole(out, rows, columns):
    """The numbers of the rows of out, each checked to be the row that was given."""
    numbers = []
    assert out.columns[: len(columns)] == columns
    for r in out.collect():
        i = r["UPPER"]
        assert all(v == i for v in tuple(r)[5 : 5 + len(NAMES)]) and tuple(r)[:5] == rows[i]
        numbers.append(i)
    return numbers


def test_clashing_names(spark, wide):
    d, rows = wide
    same = lambda out: whole(out, rows, d.columns)
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").withColumn("text", F.lit(1)).withColumn("y", F.lit(2))
    bench = spark.createDataFrame([(1, rows[5][1]), (2, "x y")], "item_id long, text string").withColumn("doc_id", F.lit(9)).withColumn("tokens", F.lit(9))
    assert sorted(same(decontaminate.drop_contaminated(d, bench))) == [i for i in range(len(rows)) if i not in (5, 18)]
    kept = same(simhash.drop_near_duplicates(d))
    assert len(kept) == len(set(kept)) and 12 not in kept and 0 in kept and len({2, 20, 21} & set(kept)) == 1
    kept = same(similar.drop_similar(d))
    assert len(kept) == len(set(kept)) and not {12, 13, 22} & set(kept) and len({2, 20, 21} & set(kept)) == 1
    shards = sharding.shuffle_to_shards(d, 3)
    assert sorted(same(shards)) == list(range(len(rows)))
    mixed = Counter(same(mixing.apply_mix(d)))
    taken = {(r.doc_id, r.text_hash): r for r in mixing.mix(d).collect()}
    hashes = dict(enumerate(r.h for r in d.select("UPPER", F.xxhash64("text").alias("h")).orderBy("UPPER").collect()))
    for i, r in enumerate(rows):
        if i not in (2, 20, 21):
            t = taken[(r[0], hashes[i])]
            assert mixed[i] == ((2 * t.taken + t.size) // (2 * t.size) if t.size else 0)
    assert sorted(same(classifier.keep_good(d, labels, 0.0))) == list(range(len(rows)))
    assert quality_rules.judge_quality(d, labels).count() == len(rows) == quality_rules.with_counts(d).count()
    assert ppm.score_documents(d, d.filter("doc_id > 3")).count() == len(rows)
    assert decontaminate.contaminated(d, bench).count() == 2


def test_mix_of_full_repeats(spark):
    """A cut within full repeats takes a part of them."""
    d = spark.createDataFrame([(1, "a b", "s", i) for i in range(9)] + [(2, "c d e f", "t", 9)], "doc_id long, text string, source string, x int")
    m = mixing.mix(d).collect()
    n = Counter(r.x for r in mixing.apply_mix(d).collect())
    want = sum(r.taken for r in m if r.source == "s")
    assert max(n[i] for i in range(9)) - min(n[i] for i in range(9)) <= 1 and abs(2 * sum(n[i] for i in range(9)) - want) <= 1
    assert n[9] == (2 * next(r.taken for r in m if r.source == "t") + 4) // 8


def test_empty_and_odd_inputs_of_the_other_operators(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, host int, hits int")
    assert url_filter.judge_urls(pages).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x", 5)], "conv_id long, turn long, role string, text string, block int").withColumns({n: F.lit(7) for n in ("c0", "c1", "tokens", "p", "q", "k", "sys", "fresh", "window", "place", "again", "head")})
    assert chat.read_back(chat.formatted(turns)).count() == 1
    docs = spark.createDataFrame([(3, "a b c", 1)], "doc_id long, text string, p int").withColumn("lengths", F.lit(1))
    assert token_files.write_token_files(docs, str(tmp_path / "t"), token_files.default_tokenizer(), 2) == 1


def test_staged_folders_go(spark):
    import os

    before = list(_session)
    with scratch(spark) as keep:
        a = stage(spark.range(5), "a")
        b = keep(a, "b")
        inner = a.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inner)
    assert not os.path.exists(inner) and b.count() == 5 and len(_session) == len(before) + 1
    with pytest.raises(ValueError, match="x"), scratch(spark):
        c = stage(spark.range(5), "c").inputFiles()[0].removeprefix("file://")
        raise ValueError("x")
    assert not os.path.exists(c)
    release(spark)
    assert not _session and not os.path.exists(b.inputFiles()[0].removeprefix("file://"))


# the pipeline


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if len(w) < 5 else {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """sf0.001 with planted copies, near copies, leaks, nulls, repeats and clashing columns, in a folder of its own."""
    src, folder = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("planted"))
    docs = [tuple(r) for r in spark.read.parquet(f"{src}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = [r.text for r in spark.read.parquet(f"{src}/benchmark.parquet").orderBy("item_id").collect()]
    long = [d for d in docs if len((d[1] or "").split()) > 200][:6]
    more = [(10_000 + i, d[1], "en", d[3], 0) for i, d in enumerate(long)]  # exact copies
    more += [(10_100 + i, d[1] + " and one more word", "en", d[3], 0) for i, d in enumerate(long)]
    more += [(10_200 + i, f"{docs[20 + i][1]} {b}", "en", "src1", 0) for i, b in enumerate(bench[:5])]
    more += [(None, docs[30][1], None, None, None), (None, None, None, None, None), docs[31], docs[31], (10_300, "", "", "", 0)]
    rows = [(*d, i, i) for i, d in enumerate(docs + more)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _copy int, key int").repartition(4).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder, rows


def test_pipeline_against_brute_force(spark, planted, tmp_path):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        assert docs.columns[: len(columns)] == columns
        path = str(tmp_path / name.replace(" ", "_"))
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = Counter(r.key for r in docs.collect())
    by = {r[6]: r for r in rows}
    # the classifier's weights are those of its own training; scores by the plain function
    w = classifier.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).astype(np.float32)
    good = {k for k, r in by.items() if classifier.score(r[1], w) >= 0.7}
    near = {k for k, r in by.items() if abs(classifier.score(r[1], w) - 0.7) < 1e-4}
    assert set(after["quality classifier"]) - near == good - near and max(after["quality classifier"].values()) == 1
    left = sorted(after["quality classifier"])
    part, sets = {k: k for k in left}, {k: grams(by[k][1]) for k in left}
    pairs = [(a, b) for a, b in combinations(left, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in left:
        before = dict(part)
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    order = lambda k: (by[k][0] is None, by[k][0] or 0)
    want = Counter(min(map(order, (k for k in left if part[k] == g))) for g in set(part.values()))
    assert Counter(map(order, after["near dedup"])) == want and max(after["near dedup"].values()) == 1
    items = [decontaminate.token_hashes(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(t):
        a = decontaminate.token_hashes(t)
        for b in items:
            n, k = decontaminate._allowed(len(b))
            for s in range(-len(b) + n, len(a) - n + 1):
                lo, hi = max(0, -s), min(len(b), len(a) - s)
                same = np.concatenate([[0], np.cumsum(b[lo:hi] == a[lo + s : hi + s])])
                if len(same) > n and (same[n:] - same[:-n]).max() >= n - k:
                    return True
        return False

    bad = {by[k][0] for k in after["near dedup"] if leaks(by[k][1])}
    assert bad and set(after["decontamination"]) == {k for k in after["near dedup"] if by[k][0] not in bad}
    m = {(r.doc_id, r.source): r for r in mixing.mix(spark.read.parquet(str(tmp_path / "decontamination"))).collect()}
    for k in after["decontamination"]:
        r = m[(by[k][0], by[k][3])]
        assert after["source mixing"][k] == ((2 * r.taken + r.size) // (2 * r.size) if r.size else 0)
    assert after["sharding"] == after["source mixing"]
    out = spark.read.parquet(str(tmp_path / "sharding")).collect()
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r.shard, r.slot) for r in out}) == len(out)
    assert corpus_pipeline.run(spark, folder).count() == len(out)


def test_stages_of_empty_tables(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), folder).count() == 0
