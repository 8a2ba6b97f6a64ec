"""Every opN_ query over its whole sf0.001 table against a plain-Python version of its columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import comb, exp, log, log10

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from probitas.llm import chat, classifier, decontaminate, mixing, ppm, quality_rules, sharding, simhash, token_files, url_filter

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def remainder(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def documents():
    return rows("documents")


@pytest.fixture(scope="module")
def labels():
    out = {}
    for r in rows("labels"):
        if r["quality"] is not None:
            out[r["doc_id"]] = min(r["quality"], out.get(r["doc_id"], 1))
    return out


def test_op1(spark, documents):
    items = [(r["item_id"], decontaminate.token_hashes(r["text"])) for r in rows("benchmark")]
    want = set()
    for d in documents:
        a = decontaminate.token_hashes(d["text"])
        for i, b in items:
            w, k = decontaminate._allowed(len(b))
            at = {int(h): x for x, h in enumerate(b)}
            diagonals = {x - at[int(h)] for x, h in enumerate(a) if int(h) in at}
            for s in diagonals:
                lo, hi = max(0, -s), min(len(b), len(a) - s)
                same = b[lo:hi] == a[lo + s : hi + s]
                if any(same[x : x + w].sum() >= w - k for x in range(len(same) - w + 1)):
                    want.add((d["doc_id"], i))
    got = decontaminate.op1_benchmark_decontamination(spark, SF).collect()
    assert want and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_op2(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    got = {r.page_id: r for r in url_filter.op2_url_filter(spark, SF).collect()}
    pages = rows("pages")
    assert len(got) == len(pages)
    for p in pages:
        u = p["url"] or ""
        m = re.search(r"://([^/?#]*)([^?#]*)", u, re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        hit = {t for t in (*url_filter.STRICT, *url_filter.SOFT) if re.search(rf"(?<![^\W_]){t}(?![^\W_])", u.lower())}
        weight = sum(2 if t in url_filter.STRICT else 1 for t in hit)
        said = rules[rule] if rule else "block" if weight >= 2 else "allow"
        r = got[p["page_id"]]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, said)


def test_op3(spark, documents, labels):
    def base(t):
        ws, t = words(t), t or ""
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        again = {i + k for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(lines), sum("A" <= c <= "Z" for c in t)

    counts = {d["doc_id"]: base(d["text"]) for d in documents}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, c in counts.items()}
    ratio = lambda c: [(c[2], c[1]), (c[6], c[1]), (c[3], c[5]), (c[4], c[0])]
    step = {i: min((g * 4 + k for k, (n, d) in enumerate(ratio(c)) for g, cut in enumerate(quality_rules.GRID) if 1000 * n > cut * d), default=48) for i, c in counts.items()}
    strata = {d["lang"] for d in documents}
    last = {}
    for s in strata:
        good = {(d["text"] or "", step[d["doc_id"]]) for d in documents if d["lang"] == s and labels.get(d["doc_id"]) == 1 and not failed[d["doc_id"]]}
        for g in range(48):
            k, n = sum(x <= g for _, x in good), len(good)
            p = sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
            if not good or p > 0.05 / len(strata):
                break
            last[s] = g
    got = quality_rules.op3_quality_rules(spark, SF).collect()
    assert len(got) == len(documents)
    lang = {d["doc_id"]: d["lang"] for d in documents}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts[r.doc_id][:5]
        assert r.base_failed == failed[r.doc_id]
        assert r.kept == (not r.base_failed and step[r.doc_id] > last.get(lang[r.doc_id], -1))


def test_quality_rules_of_several_strata(spark):
    """Each stratum stops at its own step: some symbols are in too many of de's good texts."""
    docs, labels = [], []
    for lang, n, share in (("en", 600, 0), ("de", 600, 8), ("fr", 40, 0), (None, 90, 0)):
        for i in range(n):
            t = " ".join(f"{lang or 'xx'}{i}word{j}" for j in range(60)) + (" " + "#" * 40 if share and i % share == 0 else "")
            docs.append((len(docs), t, lang))
            labels.append((len(labels), 1))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = quality_rules.judge_quality(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    cuts = {r.stratum: (r.cut_symbols, r.cut_capitals, r.cut_dup_lines, r.cut_repeats) for r in out.drop("doc_id").collect()}
    least = min(c for c in quality_rules.GRID if 1000 * 40 <= c * (sum(map(len, docs[600][1].split()))))
    assert cuts["en"] == (5, 5, 5, 5) and cuts["fr"] == (None,) * 4 and cuts["de"][0] == least
    p = {n: exp(n * log(0.95)) for n in (40, 90)}
    assert p[40] > 0.05 / 4 > p[90] and cuts[None] == (5, 5, 5, 5)


def test_op4(spark, documents):
    got = {r.doc_id: r for r in ppm.op4_ppm_scoring(spark, SF).collect()}
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    train = [low(d["text"]) for d in documents if remainder(d["doc_id"], 10)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()) + len(train), len(count) + 1
    assert len(got) == len(documents)
    for d in documents:
        r, ws = got[d["doc_id"]], low(d["text"])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(d["doc_id"], 10) == 0, len(ws) + 1, sum(w in count for w in ws) + 1, n)
        base = sum(log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


def test_op5(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    got = {r.doc_id: r for r in token_files.op5_token_files(spark, SF).collect()}
    start = 0
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        r = got.pop(d["doc_id"])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert token_files.by_word(token_files.default_tokenizer()) and not token_files.by_word(path)
    texts = ["a  b\tc\n\n d", None, "", "tab\t\tthen  spaces   ", "\n", "plain words"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_token_files(d, str(tmp_path / "bytes"), path, 50256)
    for r in token_files.read_token_files(spark, str(tmp_path / "bytes")).collect():
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 50256], dtype="<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    counts = token_files.with_token_counts(d, path, 4).collect()
    assert [r.n_tokens for r in counts] == [len(t.encode(x or "", add_special_tokens=False).ids) + 4 for x in texts]


def test_files_elsewhere_are_read_by_ranges(tmp_path):
    (tmp_path / "x").write_bytes(np.arange(1000, dtype="<u4").tobytes())
    local = token_files._File(str(tmp_path), "x", "<u4")
    other = token_files._File(str(tmp_path), "x", "<u4")
    other.at = token_files._open(str(tmp_path))[0].open_input_file(str(tmp_path / "x"))
    for part in (slice(0, 10), slice(990, 2000), slice(None), slice(5, 5)):
        assert local[part].tolist() == other[part].tolist() == list(range(1000))[part]


def test_op6(spark, documents):
    got = sharding.op6_sharding(spark, SF).collect()
    by = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    slots = defaultdict(list)
    for r in got:
        data = by.pop(r.doc_id)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert not by and set(slots) == set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shuffle_is_uniform(spark):
    """The matrix against the law counted over all permutations, then a whole shuffle by chi-square."""
    from itertools import permutations

    part, exact = [0, 0, 0, 1, 2, 2], Counter()
    for p in permutations(range(6)):  # rows 0-2 to shard 0, 3-5 to shard 1
        exact[tuple(sum(part[i] == k for i in p[:3]) for k in range(3))] += 1 / 720
    n = 3000
    drawn = Counter(tuple(sharding.communication_matrix([3, 1, 2], 2, s)[:, 0].tolist()) for s in range(n))
    assert set(drawn) <= set(exact)
    assert sum((drawn[k] - n * p) ** 2 / (n * p) for k, p in exact.items()) < 25  # 0.999 of 8 degrees of freedom is 26
    d = spark.range(0, 8000, 1, 7).withColumnRenamed("id", "doc_id")
    x = sharding.shuffle_to_shards(d, 4).toPandas()
    cells = np.zeros((8, 8))  # eighths of the input by (shard, half of its slots)
    np.add.at(cells, (x.doc_id // 1000, x.shard * 2 + (x.slot >= 1000)), 1)
    assert ((cells - 125) ** 2 / 125).sum() < 90  # 49 degrees of freedom
    order = x.sort_values(["shard", "slot"]).doc_id.to_numpy()
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.05


def test_op7(spark, documents):
    size = {d["doc_id"]: len(words(d["text"])) for d in documents}
    source = {d["doc_id"]: d["source"] for d in documents}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, rest, free = {}, 1.5 * sum(total.values()), set(total)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in above} if above else share
        rest -= sum(target[s] for s in above)
        free = free - set(above) if above else set()
    got = mixing.op7_source_mixing(spark, SF).collect()
    taken = Counter()
    assert len(got) == len(documents)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(t) for s, t in target.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.op7_source_mixing(spark, SF).collect()))


def brute_features(text, bits=18):
    """Counts by feature, with whole numbers alone."""
    full, out = (1 << 64) - 1, Counter()
    pairs = []
    for w in words(text):
        core = xxhash.xxh32_intdigest("".join(c for c in w if c.isalnum()).lower())
        shape = []
        for run in re.findall(r"[^\W\d_]+|\d+|[\W_]+", w)[:6]:
            shape.append("AB" if run.isalpha() and run.isupper() and len(run) > 1 else "Ab" if run.isalpha() and run[0].isupper() else "ab" if run.isalpha() else "1" if run.isdigit() else run[:3])
        pairs.append((core, xxhash.xxh32_intdigest("\x01".join(shape), 1)))
    a, b, c, d = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F
    grams = [x * a for x, _ in pairs] + [y * b for _, y in pairs]
    for (x, y), (x2, y2) in zip(pairs, pairs[1:], strict=False):
        grams += [x * c + x2 * a, y * d + y2 * b] + ([a + b] if x == x2 else [])
    for g in grams:
        out[max(1, ((g & full) * 0x9E3779B97F4A7C15 & full) >> (64 - bits))] += 1
    return out


def test_features_and_ftrl_against_dictionaries(documents, labels):
    texts = [(d["text"], labels[d["doc_id"]]) for d in documents if d["doc_id"] in labels][:60] + [(None, 0), ("", 1), ("same same same", 0), ("É1 x_y --- A.B.C İ", 1)]
    for t, _ in texts:
        i, c = classifier.counted(t)
        assert dict(zip(i.tolist(), c.tolist(), strict=True)) == brute_features(t)
    prior = 0.7
    got = classifier.train_ftrl([(*classifier.counted(t), y) for t, y in texts], prior)
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= (0.1 if i else 0) else -(z[i] - (np.sign(z[i]) * 0.1 if i else 0)) / ((1 + n[i] ** 0.5) / 0.3 + (1.0 if i else 0))
    for _ in range(3):
        for t, y in texts:
            f = brute_features(t)
            x = {0: 1.0} | {i: c / sum(f.values()) ** 0.5 for i, c in f.items()}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + exp(-max(-35, min(35, prior + sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * w[i]
                n[i] += g * g
    assert got[0] == pytest.approx(weight(0), rel=1e-6)
    assert max(abs(got[i] - weight(i)) for i in z) < 1e-9 and np.count_nonzero(got) <= len(z)
    for t, _ in texts[:10]:
        f = brute_features(t)
        x = weight(0) + sum(weight(i) * c for i, c in f.items()) / max(1, sum(f.values())) ** 0.5
        assert classifier.score(t, got) == pytest.approx(1 / (1 + exp(-x)), rel=1e-6)


def test_op8(spark, documents):
    got = {r.doc_id: r for r in classifier.op8_quality_classifier(spark, SF).collect()}
    w = classifier.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(got) == len(documents)
    for d in documents:
        r = got[d["doc_id"]]
        assert r.held_out == (remainder(d["doc_id"], 4) == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        assert r.score == pytest.approx(classifier.score(d["text"], w.astype(np.float32)), rel=1e-4)


def test_op9(spark, documents):
    def fp(t):
        ws = [w.decode() for w in (t or "").encode().lower().split()]
        grams = [" ".join(ws)] if 0 < len(ws) < 3 else [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)]
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d["doc_id"]: fp(d["text"]) for d in documents}
    part = {i: i for i in fps}
    pairs = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    for _ in fps:
        before = dict(part)
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", part[i]) for i, f in fps.items()} and pairs


def test_op10(spark):
    turns = defaultdict(list)
    for r in [*rows("conversations"), *({"conv_id": -7, "turn": t, "role": role, "text": "</s>[INST] ok [/INST]"} for t, role in enumerate(("user", "assistant")))]:
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    got = {r.conv_id: r for r in chat.op10_chat_formatting(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(t), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in t).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars >= sum(len(x) for *_, x in t)


def test_chat_with_a_tokenizers_counts(spark):
    rows_ = [(1, t, "user" if t % 2 else "assistant", f"word{t} " * (t % 50)) for t in range(200)]
    d = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    counted = token_files.with_token_counts(d, token_files.default_tokenizer(), chat.MARKS).cache()
    n = {(r.role, r.text): r.n_tokens for r in counted.collect()}
    seen = 0
    for w in chat.formatted(counted, tokens="n_tokens").collect():
        turns = chat.parse(w.text)
        assert sum(n[t] for t in turns) <= chat.BUDGET or len(turns) - w.n_again == 1
        seen += len(turns) - w.n_again
    assert seen == 200
