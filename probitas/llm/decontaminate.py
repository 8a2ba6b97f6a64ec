"""Benchmark decontamination by spaced-seed hashing.

Tokens are words, A-Z lower-cased and stripped to letters and digits; words without any are
passed over. A seed is a fixed mask over a window of tokens whose zeros are ignored, so that a
substituted word under a zero doesn't break the hit. Hashes of every window of every document
are joined with those of the benchmark; around each hit the two texts are compared token by
token on the hit's diagonal, and an overlap counts if some stretch of `WINDOW` item tokens (the
whole item, if shorter) has at most 3 substitutions in 16 (in proportion if shorter). With the
masks below no such overlap is missed (tests try every substitution pattern). An item of fewer
than `MIN_TOKENS` tokens has no room for a mask with zeros: its seed reads all its tokens, and it
matches where all of them stand in a row.

The benchmark is stated once and held against all documents in blocks: it is cut into pieces of
bounded length, pieces are dealt to blocks of at most about `block_tokens` tokens, and each block
is a broadcast of that proven size, freed before the next. A larger benchmark means more blocks, each of which
reads the documents, not a larger broadcast. A seed that comes often in a text and in an item, as in a run of
one word, is not paired place by place: its diagonals are the sums of two sets of places, made by shifting
a map of bits, so that such texts take time in proportion to their diagonals.

Defined results: null, empty and blank documents never match, nor does an item without tokens
(null, empty, or signs alone); a repeated item matches under each of its ids; repeated documents
match each; (doc_id, item_id) appears once, with its best stretch, earliest in the document; null
ids are kept as null; an empty table of documents or items gives an empty result; texts of any
length are read whole; other columns of either table, whatever their names, change nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from probitas.cluster import ship_package, stage
from probitas.llm.common import free, table

#: Offsets of the tokens that a mask reads.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 3, 6, 7))
WINDOW, MAX_SUBSTITUTIONS, MIN_TOKENS = 16, 3, 8
_PIECE = 4096
#: Pairs of one seed, of a text with all items, from which its diagonals are found without them.
HOT_PAIRS = 1 << 12
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_KEEP = 1 << 18
_NOT_WORD = re.compile(r"[\W_]+")


class _Tokens(dict):
    """Hash of a word, kept for words seen before; 0 for a word without letters and digits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEEP:
            self.clear()
        core = _NOT_WORD.sub("", word.decode("utf-8", "replace")).encode()
        self[word] = h = (xxhash.xxh64_intdigest(core) | 1) if core else 0
        return h


_tokens = _Tokens()


def token_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_tokens.__getitem__, words), dtype=np.uint64, count=len(words))
    return h[h != 0]


def _seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the window that begins at each token; windows over the end are left out."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k, off in enumerate(mask):
        h += tokens[off : off + n] * _ODD[k % len(_ODD)]
        h ^= h >> np.uint64(29)
    return h * _ODD[0]


def _allowed(n: int) -> tuple[int, int]:
    """Length of a stretch in an item of n tokens, and the substitutions allowed in it."""
    w = min(WINDOW, n)
    return w, MAX_SUBSTITUTIONS * w // WINDOW if n >= MIN_TOKENS else 0


class _Block:
    """A block of item pieces with its seeds, sorted by hash."""

    def __init__(self, pieces: pa.Table):
        self.ids = pieces["item_id"].to_pylist()
        self.offset = pieces["offset"].to_numpy()
        parts = [t.values.to_numpy().view(np.uint64) for t in pieces["tokens"]]
        self.start = np.cumsum([0, *map(len, parts)])
        self.tokens = np.concatenate([*parts, np.empty(0, dtype=np.uint64)])
        self.rule = [_allowed(int(n)) for n in pieces["item_tokens"].to_pylist()]
        self.hash, self.at, self.maybe = [], [], []
        small = [len(p) < MIN_TOKENS for p in parts]
        self.short = {}  # length of short items: sorted hashes of whole items, and their pieces
        for n in sorted({len(p) for p, few in zip(parts, small, strict=True) if few}):
            which = np.array([i for i, p in enumerate(parts) if len(p) == n])
            h = np.concatenate([_seeds(parts[i], tuple(range(n))) for i in which])
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], which[order]
        for m in MASKS:
            hs = [_seeds(p if not few else p[:0], m) for p, few in zip(parts, small, strict=True)]
            at = np.concatenate([*(s + np.arange(len(h)) for s, h in zip(self.start, hs, strict=False)), np.empty(0, dtype=np.int64)]).astype(np.int64)
            h = np.concatenate([*hs, np.empty(0, dtype=np.uint64)])
            order = np.argsort(h, kind="stable")
            self.hash.append(h[order])
            self.at.append(at[order])
            seen = np.zeros(1 << 22, dtype=bool)
            seen[h >> np.uint64(42)] = True
            self.maybe.append(seen)

    def diagonals(self, tokens: np.ndarray) -> np.ndarray:
        """Rows (piece, token of the text under the piece's first) that share a seed, each once."""
        found = [np.empty((0, 2), dtype=np.int64)]
        for m, hashes, at, maybe in zip(MASKS, self.hash, self.at, self.maybe, strict=True):
            h = _seeds(tokens, m)
            where = np.flatnonzero(maybe[h >> np.uint64(42)])
            lo, hi = np.searchsorted(hashes, h[where], "left"), np.searchsorted(hashes, h[where], "right")
            where, lo, n = where[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if n.sum() > HOT_PAIRS:
                # a seed that comes often on both sides, as in a run of equal words, has far more pairs than diagonals
                _, number, times = np.unique(lo, return_inverse=True, return_counts=True)
                hot = (times[number] > 1) & (n > 1) & (times[number] * n > HOT_PAIRS)
                for first in np.unique(lo[hot]).tolist():
                    mine = lo == first
                    found += self._between(where[mine], at[first : first + int(n[mine][0])])
                where, lo, n = where[~hot], lo[~hot], n[~hot]
            part = (np.cumsum(n) - n) >> 20  # portions of bounded size
            for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1) if len(n) else ():
                k = n[rows]
                item = at[np.repeat(lo[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                piece = np.searchsorted(self.start, item, "right") - 1
                found.append(np.unique(np.stack([piece, np.repeat(where[rows], k) - (item - self.start[piece])], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def _between(self, places: np.ndarray, items: np.ndarray) -> Iterator[np.ndarray]:
        """The diagonals of every place with every item token, without their pairs: a map of bits of one side is
        shifted by each place of the other."""
        pieces = np.searchsorted(self.start, items, "right") - 1
        for piece in np.unique(pieces).tolist():
            inside = items[pieces == piece] - self.start[piece]
            last = int(inside.max())
            few, many = sorted((places, last - inside), key=len)  # their sums are the diagonals, last too high
            mark = np.zeros(int(many.max()) + 1, dtype=np.uint8)
            mark[many] = 1
            bits, sums = int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little"), 0
            for k in few.tolist():
                sums |= bits << k
            raw = np.frombuffer(sums.to_bytes((sums.bit_length() + 7) // 8, "little"), dtype=np.uint8)
            d = np.flatnonzero(np.unpackbits(raw, bitorder="little")) - last
            yield np.stack([np.full(len(d), piece), d], axis=1)

    def whole(self, tokens: np.ndarray) -> Iterator[tuple]:
        """(item_id, start, item_start, width, equal) of the first place of each short item."""
        for n, (hashes, pieces) in self.short.items():
            h, first = np.unique(_seeds(tokens, tuple(range(n))), return_index=True)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, b, at in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), first[hi > lo].tolist(), strict=True):
                for piece in pieces[a:b].tolist():
                    if (self.tokens[self.start[piece] : self.start[piece + 1]] == tokens[at : at + n]).all():
                        yield self.ids[piece], at, 0, n, n

    def overlaps(self, tokens: np.ndarray) -> Iterator[tuple]:
        """(item_id, start, item_start, width, equal) of the best stretch of each diagonal that has one."""
        yield from self.whole(tokens)
        found = self.diagonals(tokens)
        for rows in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1) if len(found) else ():
            piece = int(rows[0, 0])
            item = self.tokens[self.start[piece] : self.start[piece + 1]]
            w, subs = self.rule[piece]
            step = max(1, (1 << 20) // len(item))
            for k in range(0, len(rows), step):
                yield from self._best(tokens, piece, item, rows[k : k + step, 1], w, subs)

    def _best(self, tokens: np.ndarray, piece: int, item: np.ndarray, diagonals: np.ndarray, w: int, subs: int) -> Iterator[tuple]:
        """Hits of some diagonals of one piece, a row of comparisons for each."""
        if len(tokens) < w:
            return
        under = diagonals[:, None] + np.arange(len(item))
        there = (under >= 0) & (under < len(tokens))
        same = np.zeros((len(diagonals), len(item) + 1), dtype=np.int32)
        np.cumsum((tokens[np.where(there, under, 0)] == item) & there, axis=1, out=same[:, 1:])
        equal = np.where(there[:, : len(item) - w + 1] & there[:, w - 1 :], same[:, w:] - same[:, :-w], -1)
        at = equal.argmax(axis=1)
        best = equal[np.arange(len(diagonals)), at]
        for i in np.flatnonzero(best >= max(0, w - subs)).tolist():
            k = int(at[i])
            yield self.ids[piece], int(diagonals[i]) + k, int(self.offset[piece]) + k, w, int(best[i])


_ready: dict[str, _Block] = {}


def _block(name: str, pieces: pa.Table) -> _Block:
    """A block's tables, built once in each Python process."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = _Block(pieces)
    return _ready[name]


def item_pieces(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_tokens, offset, tokens): items with tokens in pieces of bounded length, which
    overlap so that every stretch lies within one."""
    kind = T.ArrayType(T.StructType([T.StructField("item_tokens", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]))

    @F.pandas_udf(kind)
    def cut(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            t = token_hashes(text).view(np.int64)
            step = _PIECE - WINDOW + 1
            out.append([{"item_tokens": len(t), "offset": i, "tokens": t[i : i + _PIECE].tolist()} for i in range(0, max(1, len(t) - WINDOW + 1), step)] if len(t) else [])
        return pd.Series(out)

    return benchmark.select("item_id", F.explode(cut("text")).alias("p")).select("item_id", "p.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_equal): documents that hold a benchmark
    passage, a row for each such item, with the first of its best stretches. Positions count tokens."""
    spark = docs.sparkSession
    ship_package(spark)
    run = uuid.uuid4().hex
    pieces = stage(item_pieces(benchmark), "benchmark")
    total = pieces.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = -(-total // block_tokens)
    id_type, item_type = docs.schema["doc_id"].dataType, pieces.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), *(T.StructField(c, T.LongType()) for c in ("doc_start", "item_start", "n_tokens", "n_equal"))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    hits = []
    for k in range(blocks):
        part = pieces.filter(F.pmod(F.xxhash64("item_id", "offset"), F.lit(blocks)) == k).toArrow()
        shared = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=f"{run}-{k}") -> Iterator[pa.RecordBatch]:
            block = _block(name, shared.value)
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column("text")):
                    for hit in block.overlaps(token_hashes(text.as_py())):
                        rows.append(i)
                        hits.append(hit)
                if rows:
                    cols = [batch.column("doc_id").take(pa.array(rows)), *(pa.array(c) for c in zip(*hits, strict=True))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        hits.append(stage(docs.select("doc_id", "text").mapInArrow(search, schema), "hits"))
        shared.destroy()  # one block at a time is on driver and executors
    found = reduce(DataFrame.union, hits, spark.createDataFrame([], schema))
    best = F.max_by(F.struct("doc_start", "item_start", "n_tokens", "n_equal"), F.struct(F.col("n_equal") / F.col("n_tokens"), -F.col("doc_start"), -F.col("item_start"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage; rows that share an id with one go too."""
    (leak,) = free(docs, "leak")
    leaks = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
