"""As-of joins: for each row with a time of its own, the newest fact of its key that is not later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probitas.cluster import merged, stage
from probitas.operators.evidence import is_fresh, source_key


def newest_before(asks: DataFrame, facts: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """asks with `value` of facts' newest row of the same keys whose time `at` is not later than theirs, null
    without one; of facts at one instant the greatest value. Rows with a null key or time find nothing.

    Both sides shrink to one row an instant of a key before they meet. A key's time line is cut into days,
    each of which starts with what the days before it leave: no task holds more of a key than one day's
    instants, or one row for each of its days."""
    known = [F.col(c).isNotNull() for c in (*keys, at)]
    sound = lambda d: d.filter(F.array_min(F.array(*known)))
    facts = sound(facts).groupBy(*keys, at).agg(F.max(value).alias(value)).withColumn("day_", F.to_date(at))
    times = sound(asks.select(*keys, at)).distinct().withColumn("day_", F.to_date(at))
    ends = facts.groupBy(*keys, "day_").agg(F.max_by(value, at).alias(value))
    null = F.lit(None).cast(facts.schema[value].dataType)
    days = ends.unionByName(times.select(*keys, "day_", null.alias(value)).distinct()).groupBy(*keys, "day_").agg(F.max(value).alias(value))
    earlier = Window.partitionBy(*keys).orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    start = days.withColumn(value, F.last(value, ignorenulls=True).over(earlier)).filter(F.col(value).isNotNull())
    row = lambda d, time, kind, v: d.select(*keys, "day_", time.alias(at), F.lit(kind).alias("kind_"), v.alias(value))
    stamp = facts.schema[at].dataType
    line = row(start, F.col("day_").cast(stamp), 0, F.col(value)).unionByName(row(facts, F.col(at), 1, F.col(value))).unionByName(row(times, F.col(at), 2, null))
    so_far = Window.partitionBy(*keys, "day_").orderBy(at, "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn(value, F.last(value, ignorenulls=True).over(so_far)).filter("kind_ = 2").select(*keys, at, value)
    return asks.join(found, [*keys, at], "left").select(*asks.columns, value)


def cached_as_of(wanted: DataFrame, linked: DataFrame, at: str = "asked_at") -> DataFrame:
    """wanted (task_type, target, objective, field_name, source_name, at, ...), each row at its own time, with the
    newest evidence of link_evidence_to_tasks() that was there by then, for that field and source, and
    fresh then: found_value, found_at and found. Evidence linked to a task serves only tasks of the same
    type, target and objective."""
    own = ["field_name", "key_", "kind_of_", "target_", "objective_"]
    low = lambda c: F.lower(F.trim(c))
    facts = linked.select("field_name", source_key(F.col("source_name")).alias("key_"), F.col("kind").alias("kind_of_"), F.col("target").alias("target_"), F.col("objective").alias("objective_"), "linked", F.col("retrieved_at").cast("timestamp").alias(at), F.struct("retrieved_at", "investigation_id", "ev_seq", "field_value").alias("x_"))
    asks = wanted.withColumns({"key_": source_key(F.col("source_name")), "kind_of_": F.upper(F.trim("task_type")), "target_": low("target"), "objective_": low("objective"), at: F.col(at).cast("timestamp")})
    # what asks is looked up once for each key and instant, staged as it is read four times, so that whole rows are
    # shuffled once, for the last join; a struct is equal to one with nulls in the same places
    ask = F.struct(*own, at).alias("ask_")
    once = stage(asks.select(*own, at).distinct(), "asks")
    d = newest_before(once, facts.filter("linked"), own, at, "x_").withColumnRenamed("x_", "own_")
    d = newest_before(d, facts.filter("not linked"), own[:2], at, "x_")
    best: Column = F.greatest("own_", "x_")
    d = d.withColumn("best_", best).filter(is_fresh(F.col("best_.retrieved_at"), F.col("field_name"), F.col(at)))
    answer = d.select(ask, F.col("best_.field_value").alias("found_value"), F.col("best_.retrieved_at").alias("found_at"), F.lit(True).alias("found"))
    rest = [c for c in wanted.columns if c not in ("field_name", at)]
    found = asks.select(*rest, ask).join(merged(answer), "ask_", "left").withColumns({c: F.col(f"ask_.{c}") for c in ("field_name", at)})
    return found.select(*wanted.columns, "found_value", "found_at", F.coalesce("found", F.lit(False)).alias("found"))
