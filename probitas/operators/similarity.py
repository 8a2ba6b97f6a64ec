"""Linkage of whole tables without a scope: a prefix-filtered similarity join on name tokens.

A pair of named entities can reach a score of t only if its name similarity reaches a bound that
follows from the weights of the other fields that both may share: s = t - (1 - t) * others / name.
Name similarity is the F1 of token sets, so of a tokens at least s * a / (2 - s) must be shared, and at
least two, as one shared token of several never reaches the bound. Tokens are ordered by how rare
they are. If o of a tokens are shared, the a - o + 2 rarest tokens of both sides share two, so the keys
of a row are the pairs of tokens of that prefix: rarer by far than single tokens. Single tokens are
keys only for names that have no other, and for names short enough to be similar to one.

Before a pair is formed its sizes and sectors must fit; a pair is kept under the first key that it
shares, so nothing has to be made distinct. A key that many rows hold is dealt into cells of about
`part` rows a side (linkage.met), so no key meets in one task.

Records that say the same are one profile (linkage.entity_profiles), and keys are looked for by name, of
which a table has fewer: names are compared first, then the profiles of similar names, and ids come in
when a pair of profiles has passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.cluster import stage
from probitas.operators.linkage import CELL, SCORED, THRESHOLD, WEIGHTS, agreeing, compare_entities, entity_profiles, expanded, met, name_similarity, normalize_entities, resolve_profiles

#: A score is rounded to four digits, a name similarity too.
_ROUNDING = 0.0005
_NAME = dict(WEIGHTS)["name"]
#: What one shared token of several gives at most.
_ONE_TOKEN = 0.30


def _least_similarity(e: Column, threshold: float) -> Column:
    """The least name similarity with which an entity can reach the threshold, by the fields it has."""
    others = sum((F.when(e[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS if k != "name"), F.lit(0.0))
    t = threshold - _ROUNDING
    return (t * (_NAME + others) - others) / _NAME - _ROUNDING


def ordered_tokens(d: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """d (key, e) with names, and their distinct tokens from rare to frequent; order is (token, rarity)."""
    each = d.select(key, F.explode(F.array_distinct("e.tokens")).alias("token")).join(order, "token")
    listed = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rarity", "token"))), lambda x: x["token"]).alias("tokens"))
    return d.filter(F.col("e.name").isNotNull()).join(listed, key, "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def _keys(n: Column, single: Column, need: Column) -> Column:
    """Keys of a row with column tokens: single ones, and the pairs of its prefix."""
    prefix = F.slice("tokens", 1, n - need + 2)
    pairs = F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.size(prefix)), lambda y: F.concat(x, F.lit(" "), y))))
    none = F.array().cast("array<string>")
    return F.when(n == 0, F.array(F.concat(F.lit("="), F.col("e.name")))).otherwise(F.concat(F.when(single, F.col("tokens")).otherwise(none), F.when(n >= 2, pairs).otherwise(none)))


def keyed(d: DataFrame, threshold: float, target: bool) -> DataFrame:
    """A row of d (tokens, e) for each of its keys, with its least similarity. Targets have single tokens
    as keys if they have one token, candidates if they are short enough to be similar to such a target."""
    n = F.size("tokens")
    d = d if "least" in d.columns else d.withColumn("least", _least_similarity(F.col("e"), threshold))
    need = F.greatest(F.lit(2), F.ceil(F.col("least") * n / (2 - F.col("least")) - 1e-9)).cast("int")
    single = (n == 1) if target else (F.lit(2.0) / (1 + n) >= F.col("least"))
    return d.withColumn("key", F.explode(_keys(n, single, need)))


def _least_of(d: DataFrame) -> list[str]:
    return ["least"] if {"e", "least"} <= set(d.columns) else []


def _named(d: DataFrame, side: str, key: str, threshold: float) -> DataFrame:
    """(key, e, least): one row a name of the profiles d, with the least similarity that any of them needs."""
    d = d.select(F.col(side).alias("e")).filter("e.name is not null")
    return d.groupBy(F.col("e.name").alias(key)).agg(F.min(_least_similarity(F.col("e"), threshold)).alias("least"), F.first("e").alias("e"))


def formed_pairs(targets: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, part: int = CELL) -> DataFrame:
    """(target_id, candidate_id, t, c): every pair of named entities that may reach the threshold, once."""
    if 2.5 * threshold - 1.5 - 2.5 * _ROUNDING <= _ONE_TOKEN:
        raise ValueError("below 0.73 a single shared word could do, and the filter would lose pairs")
    t, c = (d.select(*key, "e") for d, key in ((normalize_entities(targets), ["target_id", *_least_of(targets)]), (normalize_entities(candidates), ["candidate_id", *_least_of(candidates)])))
    both = t.select("e").union(c.select("e"))
    order = both.select(F.explode(F.array_distinct("e.tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("rarity"))
    a = keyed(ordered_tokens(t, "target_id", order), threshold, True).select("key", "target_id", F.col("e").alias("t"), F.col("tokens").alias("t_tokens"), F.col("least").alias("t_least"))
    b = keyed(ordered_tokens(c, "candidate_id", order), threshold, False).select("key", "candidate_id", F.col("e").alias("c"), F.col("tokens").alias("c_tokens"), F.col("least").alias("c_least"))
    n, m, shared = F.size("t_tokens"), F.size("c_tokens"), F.array_intersect("t_tokens", "c_tokens")
    fits = 2 * F.least(n, m) >= F.greatest("t_least", "c_least") * (n + m) - 1e-9
    first = F.when(n == 0, True).when(F.instr("key", " ") == 0, F.size(shared) == 1).otherwise(F.array_join(F.slice(shared, 1, 2), " ") == F.col("key"))
    both = met(a, b, ["key"], cell=part).filter((F.col("t.sector") == F.col("c.sector")) & fits).filter(first)
    return both.select("target_id", "candidate_id", "t", "c")


def _corpus(targets: DataFrame, candidates: DataFrame, threshold: float, part: int) -> tuple[DataFrame, DataFrame]:
    """The profiles of targets, and the pairs of profiles that corpus_pairs() keeps, with t_ids and c_ids."""
    t, c = entity_profiles(targets, "target_id", "t"), entity_profiles(candidates, "candidate_id", "c")
    formed = formed_pairs(_named(t, "t", "target_id", threshold), _named(c, "c", "candidate_id", threshold), threshold, part)
    names = stage(formed.select(F.col("target_id").alias("t_name"), F.col("candidate_id").alias("c_name"), name_similarity(F.col("t"), F.col("c")).alias("alike")), "names")
    a = t.withColumn("t_name", F.col("t.name")).join(names, "t_name").drop("t_name")
    both = met(a, c.withColumn("c_name", F.col("c.name")), ["c_name"], (F.size("t_ids"), F.size("c_ids")), part)
    similar = compare_entities(both.withColumnsRenamed({"t_id": "target_id", "c_id": "candidate_id"}), "t_ids", "c_ids", alike=F.col("alike")).filter(F.col("score") >= threshold)
    named = F.col("t.name").isNotNull() & F.col("c.name").isNotNull()
    same = agreeing(t, c).withColumnsRenamed({"t_id": "target_id", "c_id": "candidate_id"}).withColumn("named", named)
    scored = compare_entities(same, "t_ids", "c_ids", "named").filter(~F.col("named") | (F.col("score") < threshold))
    return t, similar.unionByName(scored.drop("named"))


def corpus_pairs(targets: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, part: int = CELL) -> DataFrame:
    """score_pairs() over whole tables: the pairs of named entities that reach the threshold, and those that
    agree on an identifier, whatever their score. Ids are unique; rows without a name meet by identifier only."""
    return expanded(_corpus(targets, candidates, threshold, part)[1], *SCORED)


def corpus_resolve(targets: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, part: int = CELL) -> DataFrame:
    """linkage.resolve() of corpus_pairs(), without forming pairs of ids."""
    t, pairs = _corpus(targets, candidates, threshold, part)
    return resolve_profiles(targets, t, pairs, threshold)
