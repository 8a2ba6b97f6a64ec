"""Language-model scoring by prediction by partial matching over bytes.

Model: a trie of byte contexts up to an order (3 to 7, `ORDER` = 5), with counts from every training text. A symbol
(a byte, or the end of the text) is coded in the longest known context; if it isn't there, an
escape is coded and the next shorter context is used, without the symbols that the longer one
had (symbol exclusion). Escape estimation is method C: with n symbols seen in a context, q of
them different, after exclusion, a symbol seen c times has c / (n + q) and the escape q / (n + q);
where exclusion leaves nothing the context costs nothing. Below order 0 all values left are
equally likely. As the trie is trained before it codes, each (context, symbol) has one
probability, and a text's code length is a sum over its positions.

The trie's deepest level is counted by Spark from runs of order + 1 bytes; shorter levels are its
sums. Levels up to order 2 have at most 2^24 entries whatever the corpus and are broadcast once; the
deepest is cut by the last two bytes of the context, and where such a pair has too many by the last
three, into blocks of about `BLOCK` entries (more only where three bytes have more, 2^24 at order 5).
All longer contexts that end in these bytes are in the same block, so each block has its levels
complete and scores its positions; nothing is pruned. Blocks are made, broadcast, used and freed one
after another: the driver holds one at a time.

Base: a word unigram model with additive smoothing over lower-cased words, whose counts cover all
training texts. Words of the commonest counts, at most `HEAD` of them, are scored where the text
is read; all other words are joined with their counts, so that no hot word meets in one task.

Defined results: null text is the empty text, with the end alone; a null doc_id counts as the
empty text in the split; rows that repeat both doc_id and text are scored alike, a row each; if
nothing is left to train on, the base counts are 0 and every symbol is equally likely; an empty
table gives an empty result; texts of any length are coded whole; other columns, whatever their
names, change nothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from probitas.cluster import scratch, ship_package, stage
from probitas.llm.common import id_remainder, lower_az, table, words_of

ORDER, BLOCK, HEAD, RUN = 5, 1 << 22, 1 << 17, 1 << 20
#: Bytes that UTF-8 never uses: what stands before a text, and its end as a symbol.
BEFORE, END = 0xFE, 0xFF
ADD = 0.1


def _codes(s: np.ndarray, order: int) -> np.ndarray:
    n = len(s) - order
    out = s[:n].astype(np.uint64)
    for k in range(1, order + 1):
        out <<= np.uint64(8)
        out |= s[k : n + k]
    return out


def code_runs(texts: list[bytes], run: int = RUN, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, codes): a code is `order` bytes of context and the symbol, one for each byte of a
    text and one for its end. Runs hold about `run` symbols; a longer text comes in several."""

    def of(block: list[int]) -> tuple[np.ndarray, np.ndarray]:
        pad, end = bytes([BEFORE]) * order, bytes([END])
        s = np.frombuffer(b"".join(pad + texts[i] + end for i in block), dtype=np.uint8)
        n = np.array([len(texts[i]) + 1 for i in block])
        starts = np.cumsum(n + order) - (n + order)
        codes = _codes(s, order)
        on = np.ones(len(codes), dtype=bool)
        for k in range(1, order + 1):  # codes whose symbol is another text's beginning
            on[starts[1:] - k] = False
        return np.repeat(np.array(block), n), codes[on]

    block, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= run:  # by itself, in windows that share their context
            s = np.frombuffer(bytes([BEFORE]) * order + t + bytes([END]), dtype=np.uint8)
            for a in range(0, len(t) + 1, run):
                codes = _codes(s[a : a + run + order], order)
                yield np.full(len(codes), i), codes
            continue
        block.append(i)
        size += len(t)
        if size >= run:
            yield of(block)
            block, size = [], 0
    if block:
        yield of(block)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def trie_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n) over all texts of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, n = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            by = np.argsort(codes, kind="stable")
            codes, n = codes[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return codes[first], np.add.reduceat(n, first)

        def batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        for b in batches:
            for _, codes in code_runs(_bytes(b.column("text")), order=order):
                held.append(np.unique(codes, return_counts=True))
                if sum(len(c) for c, _ in held) > 1 << 21:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 20:
                        yield batch(*held.pop())
        if held:
            yield batch(*merged())

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sums of n for each."""
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first, dtype=np.int64)


def _small(n: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least memory."""
    return n.astype(np.min_scalar_type(int(n.max())) if len(n) else np.uint8)


def _packed(codes: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, str]:
    """Sorted codes and their counts for a broadcast, which each Python process keeps: about a quarter of their size."""
    n = _small(n)
    return zlib.compress(np.diff(codes, prepend=0).tobytes(), 1), zlib.compress(n.tobytes(), 1), n.dtype.str


def _unpacked(codes: bytes, n: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(zlib.decompress(codes), dtype=np.int64)), np.frombuffer(zlib.decompress(n), dtype=kind)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the sorted keys, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Level:
    """Contexts of one order with their symbols: entries (context << 8 | symbol) and counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, lower: Level | None):
        self.codes, self.n = codes.astype(np.int64, copy=False), _small(n)
        ctx = self.codes >> 8
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, dtype=np.int64)
        self.ctx = ctx[first]
        del ctx
        sums = lambda v: np.add.reduceat(v, first, dtype=np.int64) if len(first) else first
        total, kinds = sums(self.n), np.diff(first, append=len(self.codes))
        self.lower = lower
        if lower is not None:
            # what the next shorter context keeps, less the symbols of this one
            size = 8 * max(0, lower.order)
            of = np.empty(len(self.codes), dtype=lower.n.dtype)
            for a in range(0, len(of), RUN):
                of[a : a + RUN] = lower.n[_find(lower.codes, self.codes[a : a + RUN] & ((1 << (size + 8)) - 1))]
            gone = sums(of)
            del of
            at = _find(lower.ctx, self.ctx & ((1 << size) - 1))
            self.rest_total, self.rest_kinds = _small(lower.total[at].astype(np.int64) - gone), _small(lower.kinds[at].astype(np.int64) - kinds)
            self.order = lower.order + 1
        else:
            self.order = 0
        self.total, self.kinds = _small(total), _small(kinds)

    def seen(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.codes, codes), _find(self.ctx, codes >> 8)

    def log10p(self, codes: np.ndarray, total: np.ndarray | None = None, kinds: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of codes (context << 8 | symbol) in this order; total and kinds:
        of the context after exclusion, NaN where nothing is excluded."""
        out = np.zeros(len(codes))
        if not len(codes):
            return out
        at, ctx = self.seen(codes)
        known = ctx >= 0
        n = np.where(known, self.total[ctx] if len(self.total) else 0, 0.0)
        q = np.where(known, self.kinds[ctx] if len(self.kinds) else 0, 0.0)
        if total is not None:
            cut = ~np.isnan(total)
            n, q = np.where(cut, total, n), np.where(cut, kinds, q)
        hit = at >= 0
        out[hit] = np.log10(self.n[at[hit]] / (n[hit] + q[hit]))
        esc = ~hit & (q > 0)
        out[esc] = np.log10(q[esc] / (n[esc] + q[esc]))
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return out
        if self.lower is None:
            left = 256 - np.where(known[miss], self.kinds[ctx[miss]] if len(self.kinds) else 0, 0).astype(np.int64)
            out[miss] -= np.log10(left)
        else:
            size = 8 * self.lower.order
            short = codes[miss] & ((1 << (size + 8)) - 1)
            there = known[miss]
            rt = np.where(there, self.rest_total[ctx[miss]] if len(self.ctx) else np.nan, np.nan)
            rk = np.where(there, self.rest_kinds[ctx[miss]] if len(self.ctx) else np.nan, np.nan)
            out[miss] += self.lower.log10p(short, rt, rk)
        return out


def levels(codes: np.ndarray, n: np.ndarray) -> list[Level]:
    """Orders 0 to 2 from the sorted entries of order 2 (two bytes of context and the symbol)."""
    out: list[Level] = []
    for order in (0, 1, 2):
        short = codes & ((1 << (8 * order + 8)) - 1)
        by = np.argsort(short, kind="stable")
        out.append(Level(*_sums(short[by], n[by]), out[-1] if out else None))
    return out


def deeper(codes: np.ndarray, n: np.ndarray, low: list[Level], order: int) -> Level:
    """The level of `order` over orders 0 to 2 of all contexts and the orders from 3 on of the
    contexts that codes has: all that end in its groups of three bytes."""
    top = low[2]
    for k in range(3, order):
        short = codes & ((1 << (8 * k + 8)) - 1)
        by = np.argsort(short, kind="stable")
        entries = _sums(short[by], n[by])
        del short, by
        top = Level(*entries, top)
        del entries
    return Level(codes, n, top)


class Block:
    """The deepest level for contexts whose last_three() is from lo to below hi, with a hash table from code to log10 p.
    The table has all of the level's entries, so the level keeps only its contexts, for codes that are not there."""

    def __init__(self, top: Level, lo: int, hi: int):
        self.top, self.lo, self.hi = top, lo, hi
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(top.codes)) * 1.5))))
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)  # an empty slot has no value
        self.vals = np.full(1 << self.bits, np.nan, dtype=np.float32)
        for a in range(0, len(top.codes), RUN):
            codes = top.codes[a : a + RUN]
            ctx = _find(top.ctx, codes >> 8)
            self._put(codes.astype(np.uint64), np.log10(top.n[a : a + RUN] / (top.total[ctx].astype(np.float64) + top.kinds[ctx])))
        top.codes, top.n = top.codes[:0].copy(), top.n[:0].copy()

    def _put(self, codes: np.ndarray, logp: np.ndarray) -> None:
        left, slot = np.arange(len(logp)), self._slot(codes)
        while len(left):
            free = np.isnan(self.vals[slot[left]])
            _, one = np.unique(np.where(free, slot[left], -1 - np.arange(len(left), dtype=np.int64)), return_index=True)
            one = one[free[one]]
            self.keys[slot[left[one]]], self.vals[slot[left[one]]] = codes[left[one]], logp[left[one]]
            left = np.delete(left, one)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def log10p(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        out = self.vals[slot].astype(np.float64)
        todo = np.flatnonzero((self.keys[slot] != codes) & ~np.isnan(out))
        miss = [np.flatnonzero(np.isnan(out))]
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            v = self.vals[slot]
            hit, end = (self.keys[slot] == codes[todo]) & ~np.isnan(v), np.isnan(v)
            out[todo[hit]] = v[hit]
            miss.append(todo[end])
            on = ~hit & ~end
            todo, slot = todo[on], slot[on]
        miss = np.concatenate(miss)
        if len(miss):
            kinds, back = np.unique(codes[miss], return_inverse=True)
            out[miss] = self.top.log10p(kinds.astype(np.int64))[back]
        return out


_ready: dict[str, Block] = {}


def last_three(codes: np.ndarray) -> np.ndarray:
    """The last two bytes of the context and then the third last, as one number."""
    return ((codes >> np.uint64(8)) & np.uint64(0xFFFF)) << np.uint64(8) | (codes >> np.uint64(24)) & np.uint64(0xFF)


def _block(name: str, packed: tuple[bytes, bytes, str], lo: int, hi: int, codes2: np.ndarray, n2: np.ndarray, order: int) -> Block:
    """A block's tables, built once in each Python process."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = Block(deeper(*_unpacked(*packed), levels(codes2, n2), order), lo, hi)
    return _ready[name]


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.toArrow()
    codes, n = (t.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(codes)
    return codes[order], n[order]


def _low(trie: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted entries of order 2 and their counts, 2^24 at most."""
    return _collected(trie.groupBy((F.col("code") % (1 << 24)).alias("code")).agg(F.sum("n").alias("n")))


def _last_three() -> Column:
    two = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.shiftleft(two, 8) + F.shiftright("code", 24).bitwiseAND(F.lit(0xFF).cast("long"))


def block_bounds(trie: DataFrame, limit: int = BLOCK) -> list[int]:
    """Where blocks of last_three() begin, and the end of all."""
    pairs = {r[0]: r[1] for r in trie.groupBy(F.shiftright(_last_three(), 8).alias("h")).count().collect()}  # 2^16 rows at most
    large = [h for h, n in pairs.items() if n > limit]
    sizes = {h << 8: n for h, n in pairs.items() if n <= limit}
    if large:  # 256 rows for each, of which there are no more than entries / limit
        of = trie.filter(F.shiftright(_last_three(), 8).isin(large))
        sizes |= {r[0]: r[1] for r in of.groupBy(_last_three().alias("h")).count().collect()}
    cuts, size = [0], 0
    for h in sorted(sizes):
        if size and size + sizes[h] > limit:
            cuts.append(h)
            size = 0
        size += sizes[h]
    return [*cuts, 1 << 24]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs, lower-cased."""
    return docs.select(F.explode(words_of(lower_az(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def score_documents(docs: DataFrame, training: DataFrame, head: int = HEAD, order: int = ORDER, limit: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    counts = stage(word_counts(training), "words")
    n_docs = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = total[0] + n_docs, total[1] + (n_docs > 0)
    by_power = sorted(counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect(), reverse=True)  # 64 rows at most
    least, room = 1 << 62, head
    for k, words in by_power:
        room -= words
        if room < 0:
            break
        least = 1 << k
    top = counts.filter(F.col("n") >= least).toArrow()  # `head` rows at most
    common = spark.sparkContext.broadcast((top.column(0).cast(pa.binary()).to_pylist(), top.column(1).to_numpy()))
    run = uuid.uuid4().hex
    id_type = docs.schema["doc_id"].dataType
    fields = [("h", T.LongType()), ("word", T.StringType()), ("m", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("ppm", T.DoubleType())]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, k) for n, k in fields)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def summed(texts: list[bytes], name: str, shared) -> np.ndarray:
        """log10 probability of each text, over the positions whose context is in the block."""
        out, block = np.zeros(len(texts)), _block(name, *shared.value, *low.value, order)
        for rows, codes in code_runs(texts, order=order):
            if block.lo > 0 or block.hi < 1 << 24:
                last = last_three(codes)
                on = (last >= block.lo) & (last < block.hi)
                rows, codes = rows[on], codes[on]
            if len(codes):
                out += np.bincount(rows, weights=block.log10p(codes), minlength=len(texts))
        return out

    def more(batches: Iterator[pa.RecordBatch], name: str, shared) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            none = [pa.nulls(n, arrow.field(x).type) for x in ("n_tokens", "n_known", "base")]
            keys = pa.array([f" {x}" for x in b.column("h").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), keys, pa.array([0] * n, pa.int64()), *none, pa.array(summed(_bytes(b.column("text")), name, shared))], schema=arrow)

    def score(batches: Iterator[pa.RecordBatch], name: str, shared) -> Iterator[pa.RecordBatch]:
        class Common(dict):
            def __missing__(self, word: bytes) -> float:
                return np.nan

        words, n = common.value
        logs = Common(zip(words, np.log10(n + ADD).tolist(), strict=True))
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                texts = _bytes(b.column("text"))
                ppm = summed(texts, name, shared)
                main, tail = [], []
                for i, t in enumerate(texts):
                    ws = t.lower().split()
                    v = np.fromiter(map(logs.__getitem__, ws), dtype=np.float64, count=len(ws))
                    rare = np.isnan(v)
                    n_rare = int(rare.sum())
                    if n_rare:
                        tail.extend((i, w, c) for w, c in Counter(ws[j] for j in np.flatnonzero(rare).tolist()).items())
                    known = len(ws) - n_rare + (n_docs > 0)
                    main.append((len(ws) + 1, known, float(v[~rare].sum()) + float(np.log10(n_docs + ADD)), float(ppm[i])))
                ids, h = b.column("doc_id"), b.column("h")
                # a key that is no word, another for each row, so that these rows are dealt evenly
                keys = pa.array([f" {x}" for x in h.to_pylist()], pa.string())
                m = pa.array([1] * len(texts), pa.int64())
                cols = [ids, h, keys, m, *(pa.array(c) for c in zip(*main, strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
                if tail:
                    at, w, c = zip(*tail, strict=True)
                    at = pa.array(at)
                    none = [pa.nulls(len(at), arrow.field(x).type) for x in ("n_known", "base", "ppm")]
                    # utf-8 may be broken by no split at white space, so the words are text again
                    cols = [ids.take(at), h.take(at), pa.array(w, pa.binary()).cast(pa.string()), pa.array([0] * len(at), pa.int64()), pa.array(c, pa.int64()), *none]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    keyed = docs.select("doc_id", F.xxhash64("text", F.col("doc_id").cast("string")).alias("h"), "text")
    with scratch(spark) as keep:
        trie = stage(trie_counts(training, order), "trie")
        low = spark.sparkContext.broadcast(_low(trie))
        bounds, parts = block_bounds(trie, limit), []
        for i in range(len(bounds) - 2, -1, -1):  # the first block last, as its rows are not staged
            lo, hi = bounds[i], bounds[i + 1]
            shared = spark.sparkContext.broadcast((_packed(*_collected(trie.filter(_last_three().between(lo, hi - 1)).select("code", "n"))), lo, hi))
            part = keyed.mapInArrow(partial(more if i else score, name=f"{run}-{i}", shared=shared), schema)
            if i:
                parts.append(keep(part, "scores"))
                shared.destroy()
            else:
                parts.append(part)
    rows = reduce(DataFrame.union, parts)
    j = rows.join(counts.withColumnRenamed("n", "c"), "word", "left")
    main = F.col("m") == 1
    c = F.coalesce("c", F.lit(0))
    per = j.groupBy("doc_id", "h").agg(
        F.sum("m").alias("m"),
        F.sum(F.when(main, F.col("n_tokens"))).alias("n_tokens"),
        F.sum(F.when(main, F.col("n_known")).otherwise(F.when(c > 0, F.col("n_tokens")).otherwise(0))).alias("n_known"),
        F.sum(F.when(main, F.col("base")).otherwise(F.col("n_tokens") * F.log10(c + ADD))).alias("base"),
        F.sum("ppm").alias("ppm"),
    )
    each = lambda x: (F.col(x) / F.col("m")).cast("long")
    norm = float(np.log10(tokens + ADD * (kinds + 1)))
    one = per.select("doc_id", "m", each("n_tokens").alias("n_tokens"), each("n_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                     (F.col("base") / F.col("m") - F.col("n_tokens") / F.col("m") * norm).alias("base_score"), (F.col("ppm") / F.col("m")).alias("score"))
    return one.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("m")


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = score_documents(docs, docs.filter(id_remainder(10) != 0))
    return d.select("doc_id", (id_remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
