"""Risk rules as data: a table or file of rules becomes the one array of triggers that a pass over evidence fills.

A rule has a code, a weight, a category, a severity, the fields it reads, and one of three kinds:
  one_of       a value is one of `values`, after `form`
  younger_than a date lies less than `days` before the row was retrieved, or after it
  differs      two rows of one group of fields have different values, after `form`
`fields` is a list of names, or a list of lists that are groups (differs). Forms: text (lower case), squeezed
(single spaces, too), name, address (full addresses only), activity. A rule more is an expression more in the same pass."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probitas.functions import text as X
from probitas.functions.dates import read_date

KINDS = ("one_of", "younger_than", "differs")


def age_days(value: Column, at: Column) -> Column:
    """Whole days from a date in free form to `at`, from which it takes what it doesn't tell; null if it is no date."""
    plain = F.try_to_timestamp(F.trim(value), F.lit("yyyy-MM-dd"))  # most dates; the reader takes the others
    return F.floor((F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.coalesce(plain, read_date(value, at)))) / 86400)


def _lower(c: Column) -> Column:
    return F.lower(F.trim(c))


FORMS: dict[str, Callable[[Column], Column]] = {
    "text": _lower, "squeezed": lambda c: F.regexp_replace(_lower(c), r"(?U)\s+", " "), "name": X.rule_name,
    "address": lambda c: F.when(X.is_full_address(c), X.norm_address(c)), "activity": X.norm_activity,
}


@dataclass(frozen=True)
class Rule:
    code: str
    weight: int
    category: str
    severity: str
    kind: str
    groups: tuple[tuple[str, ...], ...]
    form: str = "text"
    values: tuple[str, ...] = ()
    days: int = 0

    def __post_init__(self) -> None:
        if not self.code or self.kind not in KINDS or self.form not in FORMS or not self.groups or not all(self.groups):
            raise ValueError(f"rule {self.code!r}: a code, a kind of {KINDS}, a form of {tuple(FORMS)} and fields are needed")
        if (self.kind == "one_of") != bool(self.values) or (self.kind == "younger_than") != (self.days > 0):
            raise ValueError(f"rule {self.code!r}: one_of takes values, younger_than takes days, differs neither")
        if self.kind != "differs" and len(self.groups) > 1:
            raise ValueError(f"rule {self.code!r}: only differs takes groups of fields")

    def trigger(self) -> Column:
        """(code, grp, norm) if a row says something to the rule, else null."""
        name, value = F.col("field_name"), F.col("field_value")
        group = reduce(lambda c, g: c.when(name.isin(*g[1]), g[0]), enumerate(self.groups), F.when(F.lit(False), 0))
        item = lambda norm: F.struct(F.lit(self.code).alias("code"), F.coalesce(group, F.lit(0)).cast("int").alias("grp"), norm.alias("norm"))
        if self.kind == "differs":
            norm = FORMS[self.form](value)
            return F.when(group.isNotNull() & F.coalesce(norm != "", F.lit(False)), item(norm))
        hit = FORMS[self.form](value).isin(*self.values) if self.kind == "one_of" else age_days(value, F.col("retrieved_at")) < self.days
        return F.when(group.isNotNull() & hit, item(F.lit("")))


@dataclass(frozen=True)
class RuleBook:
    """Rules in the order of their findings, levels (name, least, most) in the order they are tried, and the least evidence."""

    rules: tuple[Rule, ...]
    levels: tuple[tuple[str, int, int], ...]
    policy: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len({r.code for r in self.rules}) < len(self.rules):
            raise ValueError("codes of rules repeat")

    @property
    def pair_codes(self) -> tuple[str, ...]:
        return tuple(r.code for r in self.rules if r.kind == "differs")

    def triggers(self) -> list[Column]:
        return [r.trigger() for r in self.rules]

    def weight(self, code: Column) -> Column:
        return reduce(lambda c, r: c.when(code == r.code, r.weight), self.rules, F.when(F.lit(False), 0)).otherwise(0)

    def catalog(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.code, r.weight, r.category, r.severity) for r in self.rules], "code string, weight int, category string, severity string")

    def with_rule(self, rule: Rule) -> RuleBook:
        """The book with a rule more, or in place of the one with its code."""
        if rule.code in {r.code for r in self.rules}:
            return replace(self, rules=tuple(rule if r.code == rule.code else r for r in self.rules))
        return replace(self, rules=(*self.rules, rule))

    def with_levels(self, *levels: tuple[str, int, int]) -> RuleBook:
        return replace(self, levels=levels)


def _groups(fields: list) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(g) for g in fields) if fields and isinstance(fields[0], list) else (tuple(fields),)


def rule_of(row: dict, default: Rule | None = None) -> Rule:
    """A rule from a row of a catalogue; what the row lacks is as in default."""
    known = {"code", "weight", "category", "severity", "kind", "fields", "form", "values", "days"}
    if set(row) - known - {"description"}:
        raise ValueError(f"rule {row.get('code')!r}: unknown keys {sorted(set(row) - known)}")
    given = {k: row[k] for k in ("code", "weight", "category", "severity", "kind", "form", "days") if row.get(k) is not None}
    given |= {"groups": _groups(list(row["fields"]))} if row.get("fields") else {}
    given |= {"values": tuple(row["values"])} if row.get("values") else {}
    return replace(default, **given) if default else Rule(**({"category": "IDENTITY", "severity": "MEDIUM", "weight": 0} | given))


def rules_from_table(catalogue: DataFrame, base: RuleBook) -> RuleBook:
    """base with the rules of a table (code, and any of the keys of a rule), in order of code; codes that base has are changed."""
    book, known = base, {r.code: r for r in base.rules}
    for row in sorted((r.asDict(recursive=True) for r in catalogue.collect()), key=lambda r: r["code"]):  # a catalogue of rules
        book = book.with_rule(rule_of({k: v for k, v in row.items() if v is not None}, known.get(row["code"])))
    return book


def parse_rules(text: str, base: RuleBook) -> RuleBook:
    """A rule book from YAML or JSON: `rules` (code to its keys; those that base knows may give only what changes, and
    rules of base that are not named are left out), `risk_levels` (name to min and max) and `minimum_evidence_policy`."""
    try:
        import yaml

        said = yaml.safe_load(text)
    except ImportError:
        said = json.loads(text)
    known = {r.code: r for r in base.rules}
    rules = tuple(rule_of({"code": code} | dict(row or {}), known.get(code)) for code, row in (said.get("rules") or {}).items())
    levels = tuple((name.upper(), int(v["min"]), int(v["max"])) for name, v in (said.get("risk_levels") or {}).items())
    return RuleBook(rules or base.rules, levels or base.levels, said.get("minimum_evidence_policy") or base.policy)


def read_rules(spark: SparkSession, path: str, base: RuleBook) -> RuleBook:
    """parse_rules() of a file that Spark can read."""
    return parse_rules("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()), base)  # one small file
