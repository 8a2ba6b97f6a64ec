"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key. A source's documents are taken in the order of their keys
until its budget of words is reached; a budget above the source's size repeats the epoch in the
same order. Prefix sums are distributed: keys fall into equal ranges, sizes are summed per
(source, range), summed up over the ranges of a source, and then within each range, so that a
source with most of the rows is still dealt over many tasks. There is a range for every `BIN_ROWS`
rows of the table, at least `BINS`. Targets are found over one row a source, in one task.

The last document that is taken is cut at the budget: it counts with the words that are left, so
a source's taken words are exactly its target, rounded down.

Defined results: a null or blank text has size 0 and takes nothing; sources are numbered by code
point with null last; an empty table gives an empty result; rows that repeat an id (or have a null
one) are told apart by their text, and full repeats share what they take between them in any order;
texts of any length count whole; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probitas.cluster import scratch, stage
from probitas.llm.common import all_of, free, n_words, table

WEIGHTS, SHARE_PERCENT, MAX_EPOCHS, SEED, BINS, BIN_ROWS = (3, 1, 2), 150, 2, "mix-1", 2048, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Targets share the whole by weight, none above its cap of max_epochs * source_size; what is cut
    off is shared among the others by weight until none is above. That end is found without
    rounds: with sources sorted by cap / weight, the first ones are at their caps, and each later
    one has the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long"))
    d = d.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    d = d.withColumns({
        "rest100": F.sum("source_size").over(all_) * share_percent - F.coalesce(F.sum("cap").over(before), F.lit(0)) * 100,
        "weights": F.sum("weight").over(after),
    })
    d = d.withColumn("at_cap", F.col("rest100") * F.col("weight") > F.col("cap") * 100 * F.col("weights"))
    # from the first source that is below its cap on, all share what was left there
    free = order.rowsBetween(Window.unboundedPreceding, 0)
    level = F.first(F.when(~F.col("at_cap"), F.struct("rest100", "weights")), ignorenulls=True).over(free)
    d = d.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise((F.col("level.rest100") * F.col("weight")).cast("double") / (100 * F.col("level.weights")).cast("double"))
    return d.select(*sizes.columns, target.alias("target"))


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _source() -> Column:
    """A source's name that is never null, so that one exchange serves windows and joins."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _taken(docs: DataFrame, size: Column | None, seed: str, bins: int | None, of_targets: dict) -> DataFrame:
    """mix()'s columns with s, key, epochs, the whole rounds a source is taken, and extra, what the
    last round takes of a row."""
    rows = docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"), F.xxhash64("text").alias("text_hash"), _key(seed).alias("key"), _source().alias("s"))
    rows = stage(rows, "sizes")
    bins = max(BINS, -(-rows.count() // BIN_ROWS)) if bins is None else bins
    rows = rows.withColumn("bin", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins / (1 << 32)).cast("int"))
    bin_sums = stage(rows.groupBy("s", "source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = source_targets(bin_sums.groupBy("s", "source").agg(F.sum("bin_size").alias("source_size")), **of_targets)
    earlier = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = bin_sums.select("s", "bin", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("base")).join(targets.drop("source"), "s")
    within = Window.partitionBy("s", "bin").orderBy("key", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["s", "bin"])
    budget = F.floor("target")
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    left = budget - F.col("epochs") * F.col("source_size") - F.col("base") - F.col("inner")
    d = d.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    return d.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def mix(docs: DataFrame, size: Column | None = None, seed: str = SEED, bins: int | None = None, **of_targets) -> DataFrame:
    """(doc_id, source, size, text_hash, source_size, target, taken), a row for each row of docs."""
    return _taken(docs, size, seed, bins, of_targets).select("doc_id", "source", "size", "text_hash", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, size: Column | None = None, seed: str = SEED, bins: int | None = None, **of_targets) -> DataFrame:
    """docs as the mix takes them, whole: a row appears as often as its taken words, rounded to
    whole copies (half a copy counts as one), so a source misses its target by half a document.

    Of each source only the place of its cut is joined with docs: rows before it are taken once more
    than rows behind it. So texts stay where they are read, unless full repeats lie on a cut."""
    with scratch(docs.sparkSession) as keep:
        m = _taken(docs, size, seed, bins, of_targets)
        spots = m.groupBy("s", "epochs", "key", "text_hash").agg(F.sum("extra").alias("words"), F.max("size").alias("size"), F.count("*").alias("n"))
        last = spots.groupBy("s", "epochs").agg(F.max(F.when(F.col("words") > 0, F.struct("key", "text_hash", "words", "size", "n"))).alias("x"))
        cuts = keep(last.select(F.col("s").alias("of"), "epochs", F.struct("x.key", "x.text_hash").alias("cut"), F.coalesce(F.floor(F.col("x.words") / F.col("x.size") + 0.5), F.lit(0)).alias("more"), F.coalesce("x.n", F.lit(0)).alias("n")), "cuts")
    few = cuts.count() <= 100_000  # else Spark shuffles both sides
    s, at, copy = free(docs, "s_", "at_", "copy_")
    name = lambda c: f"cut_{c}"
    cuts = cuts.select(*(F.col(c).alias(name(c)) for c in cuts.columns))
    inside = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) if size is None else size > 0
    packed = docs.filter(inside).select(F.struct(*all_of(docs)).alias("row"), _source().alias(s), F.struct(_key(seed).alias("key"), F.xxhash64("text").alias("text_hash")).alias(at))
    d = packed.join(F.broadcast(cuts) if few else cuts, F.col(s) == F.col("cut_of"))
    here = F.col(at) == F.col("cut_cut")
    even = (F.col("cut_more") == 0) | (F.col("cut_more") >= F.col("cut_n"))
    once = F.coalesce((F.col(at) < F.col("cut_cut")) | (here & (F.col("cut_more") > 0)), F.lit(False))
    plain = d.filter(~F.coalesce(here, F.lit(False)) | even).withColumn(copy, F.col("cut_epochs") + once.cast("long"))
    parts = [plain]
    if not cuts.filter(~even).isEmpty():  # full repeats of which a part is taken
        rank = F.row_number().over(Window.partitionBy(s).orderBy(F.lit(0)))
        parts.append(d.filter(here & ~even).withColumn(copy, F.col("cut_epochs") + (rank <= F.col("cut_more")).cast("long")))
    out = [p.filter(F.col(copy) > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).select("row.*") for p in parts]
    return reduce(DataFrame.union, out)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    w = f"[{', '.join(map(str, WEIGHTS))}]"
    return f"""
WITH r AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM r GROUP BY source),
c AS (SELECT *, {w}[k % {len(WEIGHTS)} + 1] AS weight, source_size * {MAX_EPOCHS} AS cap FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () * {SHARE_PERCENT} - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100 AS BIGINT) AS rest100,
             CAST(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM c),
f AS (SELECT *, rest100 * weight > cap * 100 * weights AS at_cap FROM o),
l AS (SELECT *, (SELECT min(cap / weight) FROM f WHERE NOT at_cap) AS ratio FROM f),
t AS (SELECT source, source_size, CASE WHEN at_cap OR ratio IS NULL THEN CAST(cap AS DOUBLE)
        ELSE CAST((SELECT arg_min(rest100, (cap / weight, k)) FROM f WHERE NOT at_cap) * weight AS DOUBLE) / CAST(100 * (SELECT arg_min(weights, (cap / weight, k)) FROM f WHERE NOT at_cap) AS DOUBLE) END AS target FROM l),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (CAST(floor(target) AS BIGINT) // source_size) * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""
