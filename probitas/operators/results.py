"""From fetched pages to numbered results: the page that each task uses, its fields, and who extracts what."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values that say nothing, fields that a page of another company may still give, and bounds.
NO_VALUES, NO_PAGE = ("NOT_FOUND", "UNAVAILABLE"), "SOURCE_UNAVAILABLE"
OF_ANY_PAGE = ("candidate_entities", "page_title", "title", "page_text", "content", "source_text")
VERIFIED_FROM, NO_PAGE_TIER, REJECTED_TIER, OFFICIAL = 0.70, 4, 5, "gov.in"


def choose_page(tasks: DataFrame, fetches: DataFrame) -> DataFrame:
    """tasks (task_id, ...) with page_id, url, source_name, tier and confidence of the first fetch
    (task_id, source_order, url_order, usable, and these five) that is usable, by order of source, then url, then page.
    Without one: no page, tier 4, confidence 0. A null `usable` is not usable."""
    found = F.struct("page_id", "url", "source_name", "tier", "confidence")
    first = fetches.filter("usable").groupBy("task_id").agg(F.min_by(found, F.struct("source_order", "url_order", "page_id")).alias("page_"))
    d = tasks.join(first, "task_id", "left")
    given = {"tier": NO_PAGE_TIER, "confidence": 0.0}
    return d.select(*tasks.columns, "page_.page_id", "page_.url", "page_.source_name", *(F.coalesce(f"page_.{k}", F.lit(v)).alias(k) for k, v in given.items()))


def page_results(chosen: DataFrame, values: DataFrame) -> DataFrame:
    """A row for each required field of choose_page()'s tasks (with required_fields, an array, and entity_conflict),
    numbered by the field's place: (result_id, task_id, page_id, field_name, field_value, source_name, source_url,
    confidence, verification_status, tier). values is (page_id, field_name, field_value); a field without a value is
    NOT_FOUND, of repeated ones the least counts. Tasks without required fields give no rows."""
    each = chosen.select("task_id", "page_id", "url", "source_name", "tier", "confidence", "entity_conflict", F.posexplode("required_fields").alias("place", "field_name"))
    one = values.groupBy("page_id", "field_name").agg(F.min("field_value").alias("field_value"))
    d = each.join(one, ["page_id", "field_name"], "left").withColumn("field_value", F.coalesce("field_value", F.lit("NOT_FOUND")))
    other = F.coalesce("entity_conflict", F.lit(False)) & ~F.col("field_name").isin(*OF_ANY_PAGE)
    none = F.col("page_id").isNull() | (F.col("confidence") == 0)
    empty, official = F.col("field_value").isin(*NO_VALUES), F.coalesce(F.col("url").contains(OFFICIAL), F.lit(False))
    confidence = F.when(other | F.col("field_value").isin(*NO_VALUES, NO_PAGE), 0.0).otherwise(F.col("confidence"))
    status = F.when(other, "REJECTED").when(none, NO_PAGE).when(empty, "NOT_FOUND").when(official | (confidence >= VERIFIED_FROM), "VERIFIED").otherwise("UNVERIFIED")
    tier = F.when(other, REJECTED_TIER).when(none, NO_PAGE_TIER).when(~empty & official, 1).otherwise(F.col("tier"))
    number = F.concat(F.lit("RESULT-"), F.col("task_id").cast("string"), F.lit("-"), F.format_string("%03d", F.col("place") + 1))
    return d.select(
        number.alias("result_id"), "task_id", "page_id", "field_name", "field_value", F.coalesce("source_name", F.lit("Public Source")).alias("source_name"), F.col("url").alias("source_url"),
        confidence.alias("confidence"), status.alias("verification_status"), tier.alias("tier"),
    )


Extractor = tuple[Callable[[Column], Column], Callable[[DataFrame], DataFrame]]


def dispatch(tasks: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """The results of all extractors (handles, research): each task (task_type, ...) goes to the last one whose
    handles(task_type) is true, so that an extractor added later takes precedence. Tasks that none handles give no rows."""
    if not extractors:
        raise ValueError("no extractors")
    mine = F.coalesce(*(F.when(handles(F.col("task_type")), i) for i, (handles, _) in reversed(list(enumerate(extractors)))))
    parts = (research(tasks.filter(mine == i)) for i, (_, research) in enumerate(extractors))
    return reduce(DataFrame.unionByName, parts)
