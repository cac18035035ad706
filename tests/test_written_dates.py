import datetime as dt

import pytest
from pyspark.sql import functions as F

from brackwater.functions import dates

D = dt.date
def REF():
    return F.lit("2025-06-30").cast("date")


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,want", [
    ("seen 05/06/2024 twice 05/06/2024", [D(2024, 6, 5), D(2024, 5, 6)]),
    ("on 31.12.2024", [D(2024, 12, 31)]),
    ("le 3 février 2024, am 4. Mai 2024 and 7 August 2023", [D(2024, 2, 3), D(2023, 8, 7)]),
    ("2024-02-30 is none, 2024-02-29 is", [D(2024, 2, 29)]),
    ("after 2025-12-01", []),
    ("24-03-05", [D(2005, 3, 24), D(2024, 3, 5)]),
    ("", []), (None, None),
])
def test_dates_in_texts(spark, value, want):
    got = _one(spark, value, lambda c: dates.text_dates(c, REF()))
    assert got is None if want is None else sorted(got) == sorted(want)


def test_markers_hide_what_follows(spark):
    value = "Best before 2024-01-05. " + "x" * 100 + " Published 2024-02-06, again 2024-01-05"
    assert _one(spark, value, lambda c: dates.text_dates(c, REF(), dates.EXCLUDING)) == [D(2024, 2, 6)]


@pytest.mark.parametrize("value,want", [
    ("2024-05-06T23:30:00-08:00", [D(2024, 5, 6)]), ("06.05.2024", [D(2024, 5, 6)]), ("06/05/2024", [D(2024, 5, 6), D(2024, 6, 5)]), ("5 May 2024", [D(2024, 5, 5)]), ("soon", []),
])
def test_structured(spark, value, want):
    assert _one(spark, value, lambda c: dates.structured_dates(c, REF())) == want


def test_choice_follows_trust_then_order(spark):
    found = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(d).cast("date").alias("day")) for s, d in (("generic", "2025-06-29"), ("structured", "2025-07-09"), ("selector", "2025-06-01"), ("structured", "2024-01-01"))))
    row = spark.range(1).select(dates.best_date(found, REF()).alias("a"), dates.best_date(found, REF(), 100).alias("b"), dates.best_date(F.slice(found, 2, 1), REF()).alias("c")).first()
    assert row.a.day == D(2024, 1, 1) and row.b.day == D(2025, 6, 1) and row.c is None


@pytest.mark.parametrize("value,want", [("2026 07", False), ("2026 A series", False), ("4 June 2026", True), ("12/05/2024", True), (" ", False), ("2024-05-06", True)])
def test_complete(spark, value, want):
    assert _one(spark, value, dates.complete_match) is want


def test_next_run(spark):
    row = spark.sql("SELECT timestamp'2024-03-31 00:30:00' AS t").select(dates.seconds_to(3, F.col("t"), "Europe/Paris").alias("s")).first()
    assert row.s == 1800
