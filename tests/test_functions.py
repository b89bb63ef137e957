"""Dates, white space and missing values against Python's own behaviour."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import dates as D
from vellum.functions.text import NA_VALUES, missing_to_null, preview, py_strip

DATES = [
    ("109 [i.e. 1609]..", None, "109 [i.e. 1609].."), ("Anno .M.D.XL..", None, "Anno .M.D.XL.."), ("1633", 1633, "1633"), ("[1633]", 1633, "1633"), ("[1633?]", 1633, "1633"),
    ("-1633", 1633, "1633"), ("1633-1640", 1633, "1633"), ("1655 [i.e. 1656]", 1655, "1655"), ("166l", 1661, "1661"), ("-[1609", 1609, "1609"), ("Printed 1650.", 1650, "1650"),
    ("Printed 1650]?", 1650, "1650"), ("April 1655, London", 1655, "1655"), ("165-?", None, "165-?"), ("1500", None, "1500"), ("1900", None, "1900"), ("Anno 1500 or so", 1500, "1500"),
    ("printed for Hill", None, "printed for Hi11"), ("Unknown", None, "Unknown"), ("", None, ""), ("16 50", None, "16 50"), (None, None, None), (" 1633", None, " 1633"), ("1_6_3", None, "1_6_3"),
]


def test_dates(spark):
    got = D.clean_dates(spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, date string")).orderBy("i").collect()
    assert [(r["date"], r["year"], r["date_convert"]) for r in got] == DATES


def test_dates_like_int(spark):
    """The first two stages against int() itself."""
    values = ["+165", " 165", "16_5", "1__5", "_165", "165_", "0165", "1.65", "१६५०", "  16", "1 65", "x"]

    def expected(s):
        s = s.replace("l", "1")
        for cut in (s.lstrip("[").lstrip("-")[:4], s.rstrip(".").rstrip("]").rstrip("?")[-4:]):
            try:
                n = int(cut) if cut.isascii() else None
            except ValueError:
                n = None
            if n is not None:
                return n if 1500 < n < 1900 else None
        return None

    got = D.clean_dates(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, date string")).orderBy("i").collect()
    assert [r["year"] for r in got] == [expected(v) for v in values]


def test_lookup(spark):
    cleaned = D.clean_dates(spark.createDataFrame([("1633",), ("unclear",), ("other",), (None,)], "date string"))
    found = D.resolve(D.unresolved_dates(cleaned), lambda values: ["1700" if v == "unc1ear" else None for v in values])
    got = {r["date"]: r["date_convert"] for r in D.apply_resolved(cleaned, found).collect()}
    assert got == {"1633": "1633", "unclear": "1700", "other": "other", None: None}


def test_strip_and_missing(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    values = [f"{c}a b{c}" for c in spaces] + ["".join(spaces), "", "​x"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", py_strip("v").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [v.strip() for v in values]
    na = missing_to_null(spark.createDataFrame([(v,) for v in (*NA_VALUES, "Na", "0")], "v string")).where("v IS NOT NULL").collect()
    assert [r["v"] for r in na] == ["Na", "0"]


@pytest.mark.parametrize(("text", "expected"), [("a" * 100, "a" * 100), ("a" * 101, "a" * 100 + "..."), (None, None)])
def test_preview(spark, text, expected):
    assert spark.createDataFrame([(text,)], "v string").select(preview(F.col("v")).alias("v")).first()["v"] == expected
