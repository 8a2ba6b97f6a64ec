"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash bands propose, sets decide.

SimHash: texts whose 64-bit fingerprints (3-word shingles, as in simhash.py) differ in `BITS` or fewer bits are
candidates; those that are not in one group yet are asked for. Similar texts are often further apart than that, so
MinHash proposes too: candidates share one of `BANDS` keys, each of `ROWS` minima of random permutations: two texts of
similarity 0.8 miss each other in all bands with a chance of 5 in 100,000, whatever the table's
size. Pairs of a large bucket would grow with its square, so they are asked for in three rounds:
first each member with the bucket's centre (the member that shares most keys with others), then
members that are still in different groups with the next `NEXT` ones in an order that puts shared
minima side by side, and last, in buckets of more than `NEXT` + 1 members, all that are outside the
bucket's largest group with all members of other groups. The last round compares sketches of a fixed
size, a bound that never rules out a similar pair, so whole sets move for the few pairs left. Every pair of
a bucket is thus asked for or already in one group. A pair links only if the exact similarity of its sets
reaches the bound; linked texts form a group.

Defined results: null, empty and blank texts are one text; a text of fewer words than a shingle is
one shingle; of a group the row of least doc_id stays, a null doc_id only if all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.cluster import scratch, ship_package, stage
from probitas.llm.common import connected_components, one_of_each, text_of
from probitas.llm.simhash import near_pairs, with_fingerprints

SHINGLE, SIMILARITY, BANDS, ROWS, NEXT = 5, 0.8, 25, 5, 8
#: Words of a shingle of a fingerprint, and bits in which fingerprints of candidates differ at most.
FP_SHINGLE, BITS = 3, 3
#: Members of a bucket that one ordered slice of round two holds, about.
SLICE = 1 << 16
#: Bits of a sketch.
SKETCH = 1024
#: Cells of the bitmap that tells which texts are in candidate pairs, as a power of 2.
CELLS = 24

_random = np.random.default_rng(42)
_MULTIPLY = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 values of the distinct word shingles of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, 42) for g in grams], dtype="<u8"))


def band_keys(h: np.ndarray) -> np.ndarray:
    """The key of each band, then a number for each band that orders its members."""
    if not len(h):
        return np.empty(0, dtype="<i8")
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 2048):
        np.minimum(low, (h[i : i + 2048, None] * _MULTIPLY + _ADD).min(0), out=low)
    low = low.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(low)], dtype="<u8")
    bits = np.roll(low, -1, 0) & np.uint64(0xFFFF)
    order = bits[:, 0] << np.uint64(48) | bits[:, 1] << np.uint64(32) | bits[:, 2] << np.uint64(16) | bits[:, 3]
    return np.concatenate([keys, order]).view("<i8")


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the number of values that fall on each bit. Sketches of two sets differ in no more
    bits than there are values in only one of the sets."""
    return np.packbits((np.bincount((h % np.uint64(SKETCH)).astype("<i8"), minlength=SKETCH) & 1).astype(np.uint8)).view("<i8")


def _node(text: str = "text") -> Column:
    """The number of a text; blank texts are number 0."""
    return F.when(text_of(text).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    @F.pandas_udf("array<long>")
    def keys(s: pd.Series) -> pd.Series:
        return pd.Series([band_keys(shingle_set(t, shingle)) for t in s], dtype=object)

    marked = with_fingerprints(docs.select("doc_id", "text"), FP_SHINGLE)
    return marked.select("doc_id", F.xxhash64("text").alias("text_hash"), _node().alias("node"), keys("text").alias("keys"), "fp")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, set, sketch) of at least the texts in nodes; the bitmap has a fixed size, so it may let others by."""
    cells = nodes.select(F.shiftrightunsigned("node", 64 - CELLS).alias("c")).distinct().toArrow().column(0).to_numpy()  # 2^CELLS rows at most
    on = np.zeros(1 << CELLS, dtype=bool)
    on[cells] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(on))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            c = b.column("node").to_numpy().view(np.uint64) >> np.uint64(64 - CELLS)
            b = b.filter(pa.array((bitmap[c >> np.uint64(3)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8)) & 1).cast(pa.bool_()))
            texts = pc.cast(b.column("text"), pa.string()).to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            parts = [b.column("node"), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([sketch(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(parts, names=["node", "set", "sketch"])

    made = docs.select(_node().alias("node"), "text").mapInArrow(of, "node long, set binary, sketch array<long>")
    return made.groupBy("node").agg(F.first("set").alias("set"), F.first("sketch").alias("sketch"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sets of too different sizes can't be."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    x = sets.select(F.col("node").alias("a"), F.col("set").alias("of_a"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("of_b"))
    size = (F.length("of_a"), F.length("of_b"))
    both = pairs.join(x, "a").join(y, "b").filter(F.least(*size) >= F.greatest(*size) * (similarity - 1e-9))
    return both.filter(jaccard("of_a", "of_b") >= similarity).select("a", "b")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (node, ...) with label, the same for the texts that edges link."""
    parts = connected_components(edges)
    return rows.join(parts, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _mixed(rows: DataFrame) -> DataFrame:
    """The buckets whose members have more than one label, with the most frequent one as top."""
    of = rows.groupBy("v", "label").agg(F.count("*").alias("n"))
    return of.groupBy("v").agg(F.max(F.struct("n", "label")).alias("t"), F.count("*").alias("labels")).filter("labels > 1").select("v", F.col("t.label").alias("top"))


def _rest(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows (v, node, label) that share v, differ in label and can be similar by size and sketch."""
    left = rows.join(_mixed(rows), "v").join(sets.select("node", (F.length("set") / 8).alias("size"), "sketch"), "node")
    x = left.filter("label <> top").select("v", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("size").alias("nx"), F.col("sketch").alias("sx"))
    y = left.select("v", F.col("node").alias("y"), F.col("label").alias("ly"), "top", F.col("size").alias("ny"), F.col("sketch").alias("sy"))
    differ = F.aggregate(F.zip_with("sx", "sy", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    once = F.expr("lx <> ly and (ly = top or x < y)") & (F.least("nx", "ny") >= F.greatest("nx", "ny") * (similarity - 1e-9))
    bound = (F.col("nx") + F.col("ny")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return x.join(y, "v").filter(once & (differ <= bound)).select(*_pair("x", "y")).distinct()


def _near(nodes: DataFrame) -> DataFrame:
    """(a, b): the fingerprints of nodes (node, fp) that differ in few bits, a < b, and (a, a) where texts share one."""
    same = nodes.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1")
    return near_pairs(nodes, BITS).distinct().union(same.select(F.col("fp").alias("a"), F.col("fp").alias("b")))


def _apart(near: DataFrame, rows: DataFrame) -> DataFrame:
    """(v, node, label): buckets of the texts rows (node, fp, label) of each two near fingerprints, one for each
    fingerprint with those above it, but for two whose texts all have one label."""
    of = rows.groupBy("fp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (of.select(F.col("fp").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}")) for c in "ab")
    todo = near.join(x, "a").join(y, "b").filter("lo_a <> hi_a or lo_b <> hi_b or lo_a <> lo_b")
    return todo.select(F.col("a").alias("v"), F.explode(F.array("a", "b")).alias("fp")).distinct().join(rows, "fp").select("v", "node", "label")


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, following: int = NEXT) -> DataFrame:
    """(doc_id, text_hash, node, label), a row for each row of docs; label names the group."""
    ship_package(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        marked = stage(_marked(docs.select("doc_id", "text"), shingle), "minhash")
        one = marked.groupBy("node").agg(F.first("keys").alias("k"), F.first("fp").alias("fp"))
        prints = stage(one.select("node", "fp"), "simhash")
        alike = stage(_near(prints), "near")
        close = stage(prints.join(alike.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp").select("node", "fp"), "close")
        each = one.select("node", F.inline(F.arrays_zip(F.slice("k", 1, BANDS).alias("v"), F.slice("k", BANDS + 1, BANDS).alias("o"))).alias("v", "o"))
        shared = each.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
        buckets = stage(each.join(shared, "v"), "buckets")
        sets = stage(_sets(docs, buckets.select("node").union(close.select("node")), shingle), "shingles")
        known = buckets.groupBy("node").agg(F.sum("n").alias("p"))
        centre = buckets.join(known, "node").groupBy("v").agg(F.max(F.struct("p", "node")).alias("c")).select("v", F.col("c.node").alias("centre"))
        star = stage(buckets.join(centre, "v").filter("node <> centre").select(*_pair("node", "centre")).distinct(), "pairs")
        first = stage(_linked(star, sets, similarity), "links")
        rows = _labelled(buckets, first)
        apart = rows.join(_mixed(rows), "v").withColumn("slice", F.pmod("node", F.ceil(F.col("n") / SLICE)))
        near = Window.partitionBy("v", "slice").orderBy("o", "node").rowsBetween(1, following)
        later = apart.withColumn("l", F.collect_list(F.struct("node", "label")).over(near)).select("node", F.explode(F.expr("filter(l, x -> x.label <> label)")).alias("x"))
        more = later.select(*_pair("node", "x.node")).distinct().join(star, ["a", "b"], "left_anti")
        links = stage(first.union(_linked(more, sets, similarity)), "links")
        large = stage(_labelled(buckets.filter(F.col("n") > following + 1).select("v", "node"), links), "large")
        rest = large.select("v", "node", "label").union(_apart(alike, stage(_labelled(close, links), "close")))
        links = stage(links.union(_linked(_rest(rest, sets, similarity), sets, similarity)), "links")
        return keep(_labelled(marked.select("doc_id", "text_hash", "node"), links), "groups")


def drop_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: the one of least doc_id, and of rows that share that id
    the one of least text hash. A group of null ids alone keeps one such row."""
    return one_of_each(docs, similar_groups(docs, shingle, similarity), "label")
