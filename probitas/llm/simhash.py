"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 if it is set in over half the XXH64 values of a text's word shingles.
Fingerprints within `distance` bits link; linked fingerprints form a group. Search: a
fingerprint is cut into segments; two fingerprints within `distance` bits have a segment within
`distance // segments` bits, so each fingerprint looks up the small Hamming ball around each of
its segments in a table of all segments, and complete distances are checked in the join.

Equal fingerprints are one node, so copies never multiply: the join runs over distinct values.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a
text of fewer words than a shingle is one shingle; repeated rows are linked as equal texts; a
null doc_id takes part in linking, and a group's id is its smallest doc_id that isn't null (null
if all are); other columns stay as they are, whatever their names; a text of any length gives one
fingerprint of the whole; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import scratch, ship_package, stage
from probitas.llm.common import connected_components, one_of_each, table

_PLACE = np.arange(8) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    # counts of each value of each of the 8 bytes, then of each bit
    seen = np.zeros(2048, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        seen += np.bincount((part.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
    ones = (seen.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with a long column of fingerprints."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in s], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def _probe(segment: int, value: Column, flip: Column) -> Column:
    return F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(flip).alias("v"))


def near_pairs(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b): pairs of the distinct longs of fps.fp within `distance` bits, a < b, some twice."""
    radius, bounds = distance // segments, [64 * i // segments for i in range(segments + 1)]
    parts, balls = [], []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) if hi - lo < 64 else F.col("fp")
        flips = [sum(1 << x for x in c) for r in range(radius + 1) for c in combinations(range(hi - lo), r)]
        flips = [x - (1 << 64) if x >> 63 else x for x in flips]
        parts.append(F.struct(F.lit(i).alias("seg"), value.alias("v")))
        balls.append(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), partial(_probe, i, value)))
    rows = fps.select("fp").distinct()
    kept = rows.select(F.col("fp").alias("b"), F.explode(F.array(*parts)).alias("k")).select("b", "k.*")
    asked = rows.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*balls))).alias("k")).select("a", "k.*")
    close = (F.col("asked.a") < F.col("kept.b")) & (F.bit_count(F.col("asked.a").bitwiseXOR(F.col("kept.b"))) <= distance)
    return asked.alias("asked").join(kept.alias("kept"), (F.col("asked.seg") == F.col("kept.seg")) & (F.col("asked.v") == F.col("kept.v")) & close).select("a", "b")


def with_groups(marked: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """marked (doc_id, fp, ...) with component_id, the least doc_id that links reach, group_id, a
    fingerprint that names the group, and n_same, the rows that have the row's own fingerprint.
    marked is read twice: stage it."""
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")), "fingerprints")
    parts = connected_components(near_pairs(nodes, distance, segments))
    linked = parts.join(nodes, parts.node == nodes.fp).select("node", "component", "first_id")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = stage(linked.join(least, "component").select(F.col("node").alias("fp"), "component", "least_id"), "groups")
    known = nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group_id"), F.coalesce("least_id", "first_id").alias("component_id"), "n_same")
    return marked.join(known, "fp")


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, group_id, component_id, n_same), a row for each row of docs."""
    with scratch(docs.sparkSession) as keep:
        rows = with_fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", F.xxhash64("text").alias("text_hash"), "fp")
        return keep(with_groups(stage(rows, "simhash"), distance, segments), "groups")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """docs with one row of each group: the one of least doc_id, and of rows that share that id
    the one of least text hash. A group of null ids alone keeps one such row."""
    return one_of_each(docs, near_duplicate_groups(docs, shingle, distance, segments), "group_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n_same"))
