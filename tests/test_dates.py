"""Dates in free form against the meaning that dateutil's parser gives them."""

from __future__ import annotations

import datetime as dt

from dateutil import parser
from pyspark.sql import functions as F

from probitas.functions.dates import read_date

AS_OF = dt.datetime(2026, 2, 28)
SAME = [
    "2019-03-04", "2019-03-04T10:11:12", "2019-03-04T10:11:12Z", "2019-03-04 10:11:12+05:30", "2019-03-04T10:11:12.500Z", "2020", "March 3, 2019", "3rd Mar 19", "Mar 3 19", "3 March", "March 2019", "Mar 99",
    "03/04/2019", "13/04/2019", "04-13-2019", "13.04.2019", "2019/04/13", "99-01-02", "01-99", "05/06", "20190304", "190304", "20190304101112", "201903041011", "Mon, 04 Mar 2019 10:30:00 GMT", "4-Mar-2019 9 PM", "12 am 4 Mar 2019",
    "12:30 pm 2019-03-04", "1st of January 2001", "Sept 5 2001", "September 5th, 2001", "on 2001-01-05", "01/02/03", "31 Jan", "Feb", "10:30", "15", "1994 Jan 7", "7 1994 Jan", "75-Jan-02", "2 Jan 75", "2 Jan 77", "Tuesday 5 May 2020 at 11:15", "2019-03-04 10:11 UTC", "3 MARCH 2019 10:30 IST",
]
NONE = ["", "  ", "Incorporated 2019", "2019-13-45", "31 Feb 2019", "NOT_FOUND", "1 2 3 4", "Mar Apr 2019", "25:10 2019-03-04", "13 pm 4 Mar 2019", "x" * 200, "2019-02-30T10:00:00", "12345678901234567890", "5 marching 2019"]


def read(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", read_date(F.col("x"), F.lit(AS_OF)).alias("y"))
    return [r.y for r in d.orderBy("i").collect()]


def test_dates_are_read_as_dateutil_reads_them(spark, monkeypatch):
    info = parser.parserinfo()
    info._year, info._century = 2026, 2000
    want = [parser.parse(x, parserinfo=info, default=AS_OF, ignoretz=True).replace(microsecond=0) for x in SAME]
    assert dict(zip(SAME, read(spark, SAME), strict=True)) == dict(zip(SAME, want, strict=True))


def test_what_is_no_date_is_null(spark):
    assert dict(zip([*NONE, None], read(spark, [*NONE, None]), strict=True)) == dict.fromkeys([*NONE, None])
