"""Each operator against brute force on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import comb, log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from probitas.llm import chat, classifier, decontaminate, mixing, ppm, quality_rules, sharding, simhash, token_files, url_filter
from probitas.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, _x string"
WORDS = [f"w{i}" for i in range(400)]


def text_of(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def rows_of() -> list[tuple]:
    texts = [None, "", " \t\n", "one", "one two", text_of(1, 200), text_of(1, 200), text_of(2, 60) + "\n" + text_of(2, 60), text_of(3, 9000), "É Ünï " * 40, "a\x00b c", "x" * 5000]
    base = text_of(4, 300).split()
    texts += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(["new", *base]), "THE END. " * 30]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s0", None][i % 3], len(t or ""), "x", "y", None) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "null id here", "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows_of(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# benchmark decontamination


def test_masks_miss_no_allowed_overlap():
    for n in range(decontaminate.MIN_TOKENS, decontaminate.WINDOW + 1):
        w, k = decontaminate._allowed(n)
        for subs in combinations(range(w), k):
            assert any(all(p + o not in subs for o in m) for m in decontaminate.MASKS for p in range(w - m[-1])), (n, subs)


def brute_leaks(docs, items):
    found = set()
    for d, t in docs:
        a = decontaminate.token_hashes(t)
        for i, s in items:
            b = decontaminate.token_hashes(s)
            w, k = decontaminate._allowed(len(b))
            if w and any((a[x : x + w] == b[y : y + w]).sum() >= w - k for x in range(len(a) - w + 1) for y in range(len(b) - w + 1)):
                found.add((d, i))
    return found


def test_contaminated(spark):
    rng = np.random.default_rng(0)
    items = [(i, text_of(100 + i, n)) for i, n in enumerate((8, 11, 15, 16, 30, 60, 7, 2))] + [(8, None), (9, ""), (10, text_of(104, 30)), (11, "?!"), (12, text_of(107, 2)), (None, text_of(103, 16)), (13, "w7")]
    rows = [(0, None), (1, ""), (2, text_of(200, 500)), (None, text_of(103, 16))]
    for i, t in items[:8]:
        for subs in (0, 1, 2, 3, 4, 6):
            w = t.split()
            for p in rng.choice(len(w), min(subs, len(w)), replace=False):
                w[p] = "changed"
            rows.append((len(rows), f"{text_of(len(rows), 20)} | {' '.join(w).upper()}! {text_of(len(rows) + 1, 5)}"))
    rows.append(rows[-1])
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):  # in one block and in several
        got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, block).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_leaks(rows, items)
    assert decontaminate.drop_contaminated(d, b).columns == d.columns
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 == decontaminate.contaminated(d, b.limit(0)).count()


# url filter


def test_judge_urls(spark):
    urls = {1: None, 2: "", 3: "nothing", 4: "http://A.Example.ORG/es/x?y", 5: "http://example.org/en/12#a", 6: "http://x.org", 7: "http://x.org/porn", 8: "http://x.net/xxx/", 9: "http://free.net/bets",
            10: "http://free.net/free?free", 11: "http://freebets.net/adults", 12: "http://b.com/de/xxx", 13: "http://org.com/fr/xxx", 14: "http://myexample.org/es/", 15: "http://com:80/fr/",
            16: "http://x.net/écasino", 17: "http://x.net/é-casino", 18: "http://x.net/xİcasino", 19: "http://x.net/casino٣", 20: "http://x.net/" + "a" * 70_000 + "/casino", 21: "x.net/CASINO"}
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("host", F.lit(1))).collect()}
    verdict = {k: (r.rule, r.verdict) for k, r in got.items()}
    assert [got[k].host for k in (1, 3, 4)] == ["", "", "a.example.org"] and got[4].path == "/es/x" and got[6].path == ""
    assert verdict == {1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("example.org/es/", "block"), 5: ("example.org/en/1", "block"), 6: (None, "allow"), 7: ("org/", "allow"), 8: (None, "block"),
                       9: (None, "block"), 10: (None, "allow"), 11: (None, "allow"), 12: ("com/de/", "block"), 13: ("com/fr/", "allow"), 14: ("org/", "allow"), 15: (None, "allow"),
                       16: (None, "allow"), 17: (None, "block"), 18: (None, "allow"), 19: (None, "allow"), 20: (None, "block"), 21: (None, "block")}
    pages = spark.createDataFrame([(None, "http://x.net/casino"), (1, "http://x.net/casino"), (1, "http://x.net/casino")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages).collect()] == ["block"] * 3 and url_filter.judge_urls(pages.limit(0)).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(pages, strict=(), soft=()).collect()] == ["allow"] * 3
    assert [r.strict_hits for r in url_filter.judge_urls(pages, strict=("casino", ""), soft=("casino",)).collect()] == [1] * 3


# quality rules


def test_counts(docs):
    for r in quality_rules.with_counts(docs).collect():
        t = r.text or ""
        ws = [w.decode() for w in t.encode().split()]
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(ws), sum(map(len, ws)), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)


def test_binomial_tail_and_cutoffs(spark):
    got = spark.createDataFrame([(k, n) for n in (0, 1, 50, 4000) for k in (0, 1, 2, 30) if k <= n], "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.0125)).collect()
    for r in got:
        exact = 1.0 if r.k > r.n * 0.0125 else sum(comb(r.n, i) * 0.0125**i * 0.9875 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)
    good = [(i, "ok " * 60 if i % 100 else "a & b " * 30, "en") for i in range(4000)]
    d = spark.createDataFrame([(i, "".join(f"{w}{i}_{j} " for j, w in enumerate(t.split())), s) for i, t, s in good], "doc_id long, text string, lang string")
    labels = d.select("doc_id", F.lit(1).alias("quality"))
    out = quality_rules.judge_quality(d, labels)
    assert [r.cut_symbols for r in out.select("cut_symbols").distinct().collect()] == [5] and out.filter("not kept").count() == 40
    few = quality_rules.judge_quality(d, labels.filter("doc_id < 10"))
    assert few.filter("kept = base_failed").count() == 0  # nothing is certified by ten labels


def test_quality_edges(docs, none, spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    assert quality_rules.judge_quality(docs, labels).count() == docs.count()
    assert quality_rules.judge_quality(none, labels).count() == 0 == quality_rules.judge_quality(none, labels.limit(0)).count()


# prediction by partial matching


def brute_ppm(train, text):
    count = defaultdict(Counter)
    for t in train:
        s = [254] * 3 + list(t) + [255]
        for j in range(3, len(s)):
            for k in range(4):
                count[tuple(s[j - k : j])][s[j]] += 1
    s, total = [254] * 3 + list(text) + [255], 0.0
    for j in range(3, len(s)):
        out = set()
        for k in (3, 2, 1, 0):
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


def test_ppm(docs, none):
    plain = {(r.doc_id, r.text or "") for r in docs.collect()}
    training = docs.filter(F.col("doc_id") % 3 != 0)
    train = [r.text or "" for r in training.collect()]
    words = Counter(w for t in train for w in t.encode().lower().split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    short = {(i, t) for i, t in plain if len(t) < 3000}
    for limit, head in ((1 << 22, 1 << 17), (2000, 10)):
        got = ppm.score_documents(docs, training, head, 3, limit).collect()
        assert len(got) == docs.count() and sum(r.doc_id == 5 for r in got) == 3
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        for i, t in short:
            ws = t.encode().lower().split()
            base = sum(log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
            r = min(by[i], key=lambda r: abs(r.base_score - base))
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(w in words for w in ws) + 1, n)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert min(abs(r.score - brute_ppm([x.encode() for x in train], t.encode())) for r in by[i]) < 1e-3
    assert ppm.score_documents(none, none).count() == 0
    assert ppm.score_documents(docs, none).count() == docs.count()


def test_code_runs_of_long_texts():
    texts = [b"abcdefghij" * 5, b"", b"xy", b"qwertyuiop" * 9]
    for run in (7, 16, 1000):
        got = defaultdict(list)
        for rows, codes in ppm.code_runs(texts, run, 3):
            for r, c in zip(rows.tolist(), codes.tolist(), strict=True):
                got[r].append(c)
        for i, t in enumerate(texts):
            s = b"\xfe" * 3 + t + b"\xff"
            assert got[i] == [int.from_bytes(s[j : j + 4], "big") for j in range(len(t) + 1)]


# token files


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    t = Tokenizer.from_file(path)
    odd = ["it's, THEY'LL <|endoftext|>. <|endoftext|>x", "H̱! ẖ", "a̸ ≠ x,≠", "tab\tline\n\n  two nb sp", "don't,'s 's, 12,3a!", "<|startoftext|", "ÉCOLE, ΣΑΣ. İ!"]
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    token_files.write_token_files(d, str(tmp_path / "a"), path, 2)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / "a")).collect())
    start, want = 0, []
    rows = sorted(((token_files.NULL_ID if r.doc_id is None else r.doc_id, r.text or "") for r in d.collect()), key=lambda r: r[0])
    ids = [(i, np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")) for i, x in rows]
    assert Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids) == Counter((g[0], g[2], g[3]) for g in got)
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == start
        start += g[2]
        want.append(g[0])
    assert want == sorted(want)
    token_files.write_token_files(none, str(tmp_path / "b"), path, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


# sharding


def test_sharding(docs, none):
    for shards in (1, 3, 16, 50):
        got = sharding.shuffle_to_shards(docs, shards)
        assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
        by = defaultdict(list)
        for r in got.collect():
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(shards)]
        assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shuffle_to_shards(docs, 3).select("doc_id", "slot").collect() is not None
    assert sharding.shuffle_to_shards(none, 3).count() == 0


def test_matrix_and_large_draws():
    m = sharding.communication_matrix([5, 0, 12, 7], 5, 3)
    assert m.sum(1).tolist() == [5, 0, 12, 7] and sorted(m.sum(0).tolist()) == [4, 5, 5, 5, 5]
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 10_000) for _ in range(400)]
    assert abs(np.mean(big) - 2500) < 15 and 30 < np.std(big) < 60
    firsts = Counter(tuple(sharding.communication_matrix([2, 2], 2, s)[0]) for s in range(600))
    assert abs(firsts[(1, 1)] / 600 - 4 / 6) < 0.08


# mixing


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    size = defaultdict(int)
    for r in got:
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    rest = 1.5 * sum(size.values())
    while True:
        w = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / w for s in open_}
        above = {s for s in open_ if share[s] > 2 * size[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * size[s]
            rest -= 2 * size[s]
        open_ -= above
        if not open_:
            break
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(target[s]) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, bins=1).collect()))
    assert mixing.mix(none).count() == 0 == mixing.apply_mix(none).count()
    assert mixing.apply_mix(docs).columns == docs.columns


# quality classifier


def test_classifier(spark, docs, none):
    rng = np.random.default_rng(5)
    good = [(i, " ".join(rng.choice(WORDS, 50)) + ".", 1) for i in range(400)]
    bad = [(i, "!! ".join(rng.choice(WORDS, 50)).upper(), 0) for i in range(400, 500)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    w = classifier.train(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    out = classifier.scored(d, w).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all((r.score >= 0.7) == (r.quality == 1) for r in held)
    assert all(0 <= r.score <= 1 for r in classifier.scored(docs.drop("score"), w).collect())
    blank = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.scored(docs.drop("score"), classifier.train(docs, blank)).collect()} == {0.5}
    labels = d.select("doc_id", "quality")
    assert classifier.keep_good(docs, labels).columns == docs.columns
    assert classifier.keep_good(none, labels).count() == 0


# simhash


def brute_fp(t):
    ws = (t or "").encode().lower().split()
    if not ws:
        return 0
    grams = [b" ".join(ws)] if len(ws) < 3 else [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(docs, none):
    rows = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    label = {f: f for _, f in rows}
    for _ in rows:
        for a, b in combinations(list(label), 2):
            if (a ^ b).bit_count() <= 3:
                label[a] = label[b] = min(label[a], label[b])
    least = {}
    for i, f in rows:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    got = simhash.near_duplicate_groups(docs).collect()
    assert Counter((i, f, least.get(label[f])) for i, f in rows) == Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label.values()))
    assert simhash.near_duplicate_groups(none).count() == 0 == simhash.drop_near_duplicates(none).count()


def test_near_pairs_of_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = {int(b) ^ (sum(1 << int(k) for k in rng.choice(62, m, replace=False))) for b in base for m in (0, 1, 2, 3, 4)}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    for segments in (2, 3, 4):
        assert {(r.a, r.b) for r in simhash.near_pairs(d, 3, segments).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (300, 299), (301, 300), (302, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 302: 0, 200: 200, 201: 200, 299: 299, 300: 299, 301: 299}


# chat


def test_escapes():
    for t in ("", "\\", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>", "\\<|", "<\\|im_end|>", "<<SYS>>", "a\\nb", "[\\INST]"):
        assert chat.unescape(t.replace("\\", "\\\\")) == t


def test_chat(spark):
    rows = [(-7, 0, "user", chat._EXTRA), (-7, 1, "assistant", chat._EXTRA), (1, 0, None, None), (1, 1, "assistant", None), (2, None, "system", "be <|im_end|> kind"), (None, 0, "user", "x"), (None, 1, "a\nb", "\\n")]
    rows += [(3, 0, "system", "short")] + [(3, t, ["user", "assistant"][t % 2], text_of(t, 30 + 13 * t % 300)) for t in range(1, 700)]
    rows += [(4, 0, "assistant", text_of(9, 5000)), (4, 1, "user", "ok"), (5, 3, "user", "same"), (5, 3, "user", "same"), (6, 2, "assistant", "é</s>\\")]
    rows += [(c, 0, "system", text_of(c, n)) for c, n in ((7, 600), (8, 764), (9, 900), (10, 3000))] + [(c, t, ["user", "assistant"][t % 2], text_of(t, 10 + 7 * t % 120)) for c in (7, 8, 9, 10) for t in range(1, 60)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    w = chat.formatted(d).cache()
    for r in w.collect():
        turns = chat.parse(r.text)
        fresh = [len(t.split()) + chat.MARKS for role, t in turns[r.n_again :] if role != "system" or r.conv_id in (9, 10)]
        whole = sum(len(t.split()) + chat.MARKS for _, t in turns)
        assert len(fresh) == 1 or whole <= chat.BUDGET
        assert fresh or len(turns) == 1  # a conversation that is a system turn alone
        if r.conv_id == 3:
            assert turns[0] == ("system", "short")
        if r.conv_id in (7, 8):  # a long system turn leaves less for history, and the budget holds
            assert turns[0][0] == "system" and whole <= chat.BUDGET
        if r.conv_id in (9, 10):  # above three quarters it stands once
            assert (turns[0][0] == "system") == (r.window == 0)
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(d.limit(0))).count() == 0
