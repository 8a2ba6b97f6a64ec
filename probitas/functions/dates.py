"""Dates in free form, read by column expressions: a text is cut into numbers, month names, a time and a zone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of dates.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORD = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAY_WORD = "mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
NO_MEANING = "at|on|and|ad|m|t|of"

#: A time of day: with minutes and perhaps seconds, or a full hour with am or pm; then perhaps a zone.
HALF = r"\s*([aApP])\.?[mM]\b\.?"
ZONE = r"\s*(?:[zZ]\b|[A-Z]{3,5}\b|(?:UTC|GMT)?\s*[+-]\d{2}:?\d{2}\b)?"
CLOCK = rf"(?:(?<=\d)[tT]|\b)(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.\d+)?)?(?:{HALF})?{ZONE}"
HOUR = rf"\b(\d{{1,2}}){HALF}{ZONE}"
#: Dates in one number, with the time of day that may follow in it.
SOLID = r"^(\d{4})(\d{2})(\d{2})(?:\d{4}|\d{6})?$"
SOLID_TIME = r"^\d{8}(\d{2})(\d{2})(\d{2})?$"
SHORT = r"^(\d{2})(\d{2})(\d{2})$"
PART = rf"(?:\d+|\b(?:{MONTH_WORD})\b)"
ALL_PARTS = rf"^(?:\d+(?:st|nd|rd|th)?(?![a-z])|(?<![a-z])(?:{MONTH_WORD}|{DAY_WORD}|{NO_MEANING})(?![a-z])|[\s,;./'-])*$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month_of(word: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(word, 1, 3))
    return F.when(at > 0, at.cast("int"))


def _year(part: Column, as_of: Column) -> Column:
    """A year of one or two digits lies less than 50 years before or after as_of."""
    now = F.year(as_of)
    near = part["v"] + now - now % 100
    near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
    return F.when(part["long"], part["v"]).otherwise(near)


def _ymd(p: Column, as_of: Column) -> Column:
    """(y, m, d) of one to three parts (v, word, long), null where a part isn't told. A month name and a year
    of more than two digits (or above 31) are known by themselves; the others go month, day, year unless
    their values say otherwise."""
    n, at = F.size(p), F.array_position(F.transform(p, lambda x: x["word"]), F.lit(True))
    a, b, c = (F.get(p, F.lit(i)) for i in range(3))
    big = lambda x: x["long"] | (x["v"] > 31)
    none = F.lit(None).cast("int")
    out = lambda y=None, m=None, d=None: F.struct((none if y is None else _year(y, as_of)).alias("y"), (none if m is None else m["v"]).alias("m"), (none if d is None else d["v"]).alias("d"))
    one = F.when(at == 1, out(m=a)).when(big(a), out(y=a)).otherwise(out(d=a))
    with_name = lambda m, x: F.when(big(x), out(y=x, m=m)).otherwise(out(m=m, d=x))
    two = F.when(at == 1, with_name(a, b)).when(at == 2, with_name(b, a)).when(big(a), out(y=a, m=b)).when(big(b), out(y=b, m=a)).otherwise(out(m=a, d=b))
    three = (
        F.when(at == 1, F.when(big(b), out(b, a, c)).otherwise(out(c, a, b)))
        .when(at == 2, F.when(big(a), out(a, b, c)).otherwise(out(c, b, a)))
        .when(at == 3, F.when(big(b), out(b, c, a)).otherwise(out(a, c, b)))
        .when(big(a), out(a, b, c)).when(a["v"] > 12, out(c, b, a)).otherwise(out(c, a, b))
    )
    return F.when(n == 1, one).when(n == 2, two).when(n == 3, three)


def read_date(text: Column, as_of: Column) -> Column:
    """The timestamp that a text tells; its wall time, as zones are read but not applied.

    Parts that it doesn't tell come from the date of as_of (a day past the month's end becomes its last
    day), times not told are midnight. Null for null, blank and overlong texts (over 100 signs), for texts
    with a word or sign that belongs to no date, for more than three parts or two month names, for a
    weekday alone, and for days, months and times that don't exist."""
    raw = F.trim(text)
    now = as_of.cast("timestamp")

    def after_time(x: Column) -> Column:
        solid = x["s"].rlike(SOLID_TIME)
        clock, hour = x["s"].rlike(CLOCK), x["s"].rlike(HOUR)
        of = lambda i: F.when(solid, F.regexp_extract(x["s"], SOLID_TIME, i)).when(clock, F.regexp_extract(x["s"], CLOCK, i)).when(hour & F.lit(i == 1), F.regexp_extract(x["s"], HOUR, 1)).otherwise("")
        half = F.lower(F.when(solid, "").when(clock, F.regexp_extract(x["s"], CLOCK, 4)).when(hour, F.regexp_extract(x["s"], HOUR, 2)).otherwise(""))
        rest = F.when(solid, x["s"]).when(clock, F.regexp_replace(x["s"], CLOCK, " ")).when(hour, F.regexp_replace(x["s"], HOUR, " ")).otherwise(x["s"])
        rest = F.regexp_replace(F.regexp_replace(F.trim(F.lower(rest)), SOLID, "$1 $2 $3"), SHORT, "$1 $2 $3")
        h = _int(of(1))
        h24 = F.when(half == "", h).when((h > 12), None).when(half == "p", h % 12 + 12).otherwise(h % 12)
        timed = solid | clock | hour
        return F.struct(rest.alias("rest"), timed.alias("timed"), F.when(timed, h24).otherwise(0).alias("h"), F.coalesce(_int(of(2)), F.lit(0)).alias("mi"), F.coalesce(_int(of(3)), F.lit(0)).alias("s"))

    def with_parts(x: Column) -> Column:
        found = F.regexp_extract_all(x["rest"], F.lit(f"({PART})"), F.lit(1))
        parts = F.transform(found, lambda w: F.struct(F.coalesce(_month_of(w), _int(w)).alias("v"), _month_of(w).isNotNull().alias("word"), (_month_of(w).isNull() & ((F.length(w) > 2) | (F.coalesce(_int(w), F.lit(0)) > 100))).alias("long")))
        return F.struct(x.alias("t"), parts.alias("p"))

    def date(x: Column) -> Column:
        p, t = x["p"], x["t"]
        sound = t["rest"].rlike(ALL_PARTS) & (F.size(p) <= 3) & ~F.exists(p, lambda w: w["v"].isNull()) & (F.size(F.filter(p, lambda w: w["word"])) <= 1) & ((F.size(p) > 0) | t["timed"])
        return F.when(sound, _let(F.coalesce(_ymd(p, now), F.struct(*(F.lit(None).cast("int").alias(k) for k in "ymd"))), lambda d: built(d, t)))

    def built(d: Column, t: Column) -> Column:
        y, m = F.coalesce(d["y"], F.year(now)), F.coalesce(d["m"], F.month(now))
        last = F.dayofmonth(F.last_day(F.try_make_timestamp(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))
        day = F.coalesce(d["d"], F.least(F.dayofmonth(now), last))
        return F.when(y.between(1, 9999) & (t["h"] < 24), F.try_make_timestamp(y, m, day, t["h"], t["mi"], F.when(t["s"] < 60, t["s"])))

    usable = F.when((raw != "") & (F.length(raw) <= 100), raw)
    return F.when(usable.isNotNull(), _let(F.struct(usable.alias("s")), lambda x: _let(after_time(x), lambda y: _let(with_parts(y), date))))
