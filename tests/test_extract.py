"""Hand-made texts for addresses, activities and page fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from probitas.operators import extract as T

PUNE = "12 MG Road, Pune 411001"
ADDRESSES = [
    (f"Registered Office: {PUNE}", None, False, PUNE),
    (f"Address is {PUNE} GSTIN 27", None, False, PUNE),
    (f"Registered address\n{PUNE}", None, False, PUNE),
    ("Registered address\n12 MG Road\nDirector X\nPune 411001", None, False, "12 MG Road, Pune 411001"),
    (f"Address not available: {PUNE}", None, False, f"not available: {PUNE}"),
    (f"Same address: {PUNE}", None, False, "NOT_FOUND"),
    ("Visit 12 MG Road\nPune 411001", None, False, "Pune 411001"),
    ("Visit 12 MG Road\nPune 011001", None, False, "Visit 12 MG Road | Pune 011001"),
    (f"Beta\nAddress: {PUNE}", "Alpha Foods Limited", False, "NOT_FOUND"),
    (f"Beta\nAddress: {PUNE}", "Alpha Foods Limited", True, PUNE),
    (f"Alpha Foods\nAddress: {PUNE}", "Alpha Foods Limited", False, PUNE),
    (f"Alpha\na\nb\nc\nAddress: {PUNE}", "Alpha Foods Limited", False, "NOT_FOUND"),
    (f"Beta\nAddress: {PUNE}", "27ABCDE1234F1Z5", False, PUNE),
    ("", "x", False, "NOT_FOUND"),
    (None, None, None, "NOT_FOUND"),
]


def test_addresses(spark):
    d = spark.createDataFrame([(k, *a[:3]) for k, a in enumerate(ADDRESSES)], "k int, text string, target string, confirmed boolean")
    got = {r.k: r.address for r in T.find_addresses(d).collect()}
    assert {k: (ADDRESSES[k][0], v) for k, v in got.items()} == {k: (a[0], a[3]) for k, a in enumerate(ADDRESSES)}


def test_fields_of_pages(spark):
    rows = [
        ("http://a.in", "Nature of business: code\nBusiness Activity - Wholesale trade. Status: Active", "http://a.in", "Nature of business: code", "Wholesale trade"),
        ("", "see https://b.in/x for all of it and more" + "z" * 300, "https://b.in", None, "NOT_FOUND"),
        (None, "short\nIndustrial class 6201 [Includes the writing of software]", "NOT_FOUND", "Industrial class 6201 [Includes the writing of software]", "NOT_FOUND"),
        (None, None, "NOT_FOUND", "NOT_FOUND", "NOT_FOUND"),
    ]
    d = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "page_id int, url string, text string")
    got = T.page_fields(d).orderBy("page_id").collect()
    assert [(r.website, r.activity) for r in got] == [(r[2], r[4]) for r in rows]
    assert [r.description for r in got if r.page_id != 1] == [r[3] for k, r in enumerate(rows) if k != 1] and len(got[1].description) == T.CUT
