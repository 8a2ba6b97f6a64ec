"""Intake: requests in a fixed schema, their normal form, and where each value is from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.cluster import merged
from probitas.functions import text as X
from probitas.operators.linkage import resolve, score_pairs

# Fields with their greatest lengths, and the shapes of identifiers.
FIELDS = {"business_name": 255, "gstin": 15, "cin": 21, "epfo_code": 100, "website": 500, "location": 255, "additional_information": None, "user_id": 100}
GSTIN, CIN = "^[0-9]{2}[A-Z0-9]{12,13}$", "^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"
HOST, HOST_SHAPE = r"^https?://(?:[^/?#@]*@)?([^/?#:@]*)", r"^[a-z0-9\-.]*\.[a-z0-9\-.]*$"


def read_intake(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Requests of a file in the intake schema, with too_long, the names of fields above their length."""
    d = spark.read.schema(", ".join(f"{c} string" for c in FIELDS)).format(kind).load(path)
    return check_lengths(d)


def check_lengths(d: DataFrame) -> DataFrame:
    """d with too_long (array of field names); fields that d lacks are not checked."""
    return d.withColumn("too_long", F.array_compact(F.array(*(F.when(F.length(c) > n, c) for c, n in FIELDS.items() if n and c in d.columns))))


def normalize_intake(d: DataFrame) -> DataFrame:
    """d with its six fields in normal form and provenance, a struct that says for each of them
    USER_SUPPLIED, INVALID or NOT_CHECKED; what is invalid or blank is null."""
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    up = lambda c: F.upper(F.trim(c))
    low = F.lower(F.trim("website"))
    url = F.when(low.contains("://"), low).otherwise(F.concat(F.lit("https://"), low))
    valid = {"gstin": up("gstin").rlike(GSTIN), "cin": up("cin").rlike(CIN), "website": F.regexp_extract(url, HOST, 1).rlike(HOST_SHAPE)}
    value = {"business_name": X.norm_text(F.col("business_name")), "gstin": up("gstin"), "cin": up("cin"), "epfo_code": X.squeeze(F.col("epfo_code")), "website": url, "location": X.norm_location(F.col("location"))}
    ok = {c: given(c) & valid[c] if c in valid else F.coalesce(value[c] != "", F.lit(False)) for c in value}
    said = F.struct(*(F.when(ok[c], "USER_SUPPLIED").when(given(c) & F.lit(c in valid), "INVALID").otherwise("NOT_CHECKED").alias(c) for c in value))
    return d.withColumns({**{c: F.when(ok[c], v) for c, v in value.items()}, "provenance": said})


def dropped_identifiers(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(investigation_id, field): identifiers that a request gave and its report's entity lacks."""
    keys = ("gstin", "cin", "epfo_code")
    given = lambda c: ~F.lower(F.trim(F.coalesce(F.col(f"r.{c}"), F.lit("")))).isin("invalid", "none", "null", "n/a", "")
    d = requests.alias("r").join(entities.alias("e"), "investigation_id")
    lost = F.array_compact(F.array(*(F.when(given(c) & (F.coalesce(F.col(f"e.{c}"), F.lit("")) == ""), c) for c in keys)))
    return d.select("investigation_id", F.explode(lost).alias("field"))


def merge_entity(inputs: DataFrame, candidates: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    """inputs with the values of fields overridden by those of the chosen candidate, a row by key,
    that are neither blank nor placeholders; candidates may lack keys."""
    theirs = candidates.select(key, *(F.col(c).alias(f"c_{c}") for c in fields))
    usable = lambda c: (F.coalesce(F.col(c), F.lit("")) != "") & ~F.upper(F.trim(c)).isin("NOT_FOUND", "UNAVAILABLE", "NONE")
    d = inputs.join(theirs, key, "left")
    return d.withColumns({c: F.when(usable(f"c_{c}"), F.col(f"c_{c}")).otherwise(F.col(c)) for c in fields}).drop(*(f"c_{c}" for c in fields))


def entity_id(name: Column) -> Column:
    """Name-based UUID (version 5, DNS) of an entity's name; null for a null or empty one."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.when(name != "", F.concat_ws("-", *parts))


def upsert_entities(store: DataFrame, resolved: DataFrame) -> DataFrame:
    """store (entity_id, canonical_name, trade_name, registered_address, state) and those of resolved
    (name, trade_name, registered_address, address, state, location) whose id it lacks, each once."""
    first = lambda *c: F.coalesce(*(F.when(F.col(x) != "", F.col(x)) for x in c))
    new = resolved.select(entity_id(F.col("name")).alias("entity_id"), F.col("name").alias("canonical_name"), first("trade_name", "name").alias("trade_name"), first("registered_address", "address").alias("registered_address"), first("state", "location").alias("state")).filter("entity_id is not null")
    one = new.groupBy("entity_id").agg(F.min(F.struct("canonical_name", "trade_name", "registered_address", "state")).alias("x")).select("entity_id", "x.*")
    return store.unionByName(one.join(store, "entity_id", "left_anti"))


def discovery_confidence(candidates: DataFrame) -> DataFrame:
    """(investigation_id, confidence): the greatest of its candidates', 0 where one has none."""
    return candidates.groupBy("investigation_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def candidates_of(ev: DataFrame) -> DataFrame:
    """(investigation_id, ev_seq, pos, name, gstin, cin, confidence): candidates inside evidence rows."""
    kind = "array<struct<name:string,gstin:string,cin:string,confidence:double>>"
    d = ev.filter("field_name = 'candidate_entities'").select("investigation_id", "ev_seq", F.posexplode(F.from_json("field_value", kind)).alias("pos", "c"))
    return d.select("investigation_id", "ev_seq", "pos", "c.*")


def resolved_entities(inputs: DataFrame, ev: DataFrame) -> DataFrame:
    """inputs (investigation_id, business_name, gstin, cin, website, location; a row each) with name, gstin and cin of the
    candidate that resolution chose among those of the investigation's own evidence of confidence 0.5 or more, and
    entity_confidence and resolution_status. Candidates come in order of ev_seq, then place in their list; without any
    the inputs stay, name is the business name, and confidence is 0."""
    named = merged(inputs.withColumn("name", F.col("business_name")))
    place = (F.col("ev_seq").cast("long") * (1 << 20) + F.col("pos")).alias("candidate_id")
    found = merged(candidates_of(ev.filter("confidence >= 0.5")).select("investigation_id", place, "name", "gstin", "cin"))
    chosen = resolve(named.select(F.col("investigation_id").alias("target_id")), score_pairs(named.withColumn("target_id", F.col("investigation_id")), found, "investigation_id"))
    chosen = merged(chosen.select(F.col("target_id").alias("investigation_id"), "candidate_id", F.col("confidence").alias("entity_confidence"), F.col("match_type").alias("resolution_status")))
    theirs = found.join(chosen.filter("candidate_id is not null").select("investigation_id", "candidate_id"), ["investigation_id", "candidate_id"], "left_semi")
    return merge_entity(named, merged(theirs), ("name", "gstin", "cin"), "investigation_id").join(chosen.drop("candidate_id"), "investigation_id", "left").fillna(0.0, ["entity_confidence"])


# the same in DuckDB's SQL


def sql_entity_id(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return f"CASE WHEN {name} <> '' THEN substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr({h}, 17, 1) AS INTEGER) % 4 + 1] || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) END"


def sql_normal() -> str:
    """The columns of normalize_intake() but for business_name's and location's."""
    up = lambda c: f"upper(trim({c}))"
    url = "CASE WHEN contains(lower(trim(website)), '://') THEN lower(trim(website)) ELSE 'https://' || lower(trim(website)) END"
    ok = {"gstin": f"regexp_matches({up('gstin')}, '{GSTIN}')", "cin": f"regexp_matches({up('cin')}, '{CIN}')", "website": f"(trim(website) <> '' AND regexp_matches(regexp_extract({url}, '{HOST}', 1), '{HOST_SHAPE}'))"}
    value = {"gstin": up("gstin"), "cin": up("cin"), "website": url}
    said = {c: f"CASE WHEN {ok[c]} THEN 'USER_SUPPLIED' WHEN trim(coalesce({c}, '')) <> '' THEN 'INVALID' ELSE 'NOT_CHECKED' END" for c in ok}
    return ", ".join(f"CASE WHEN {ok[c]} THEN {value[c]} END AS {c}, {said[c]} AS {c}_from" for c in ok)
