import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from brackwater.operators.instants import normalise_instants, utc_text, with_epoch_seconds

CASES = [
    # value, zone, month first, expected
    ("2025-03-09T07:09:00+01:00", "Europe/Paris", False, "2025-03-09T06:09:00Z"),
    ("2026-04-10", "Europe/Paris", False, "2026-04-09T22:00:00Z"),
    ("2024-11-03T04:00:00.241Z", "Europe/Paris", False, "2024-11-03T04:00:00Z"),
    ("04/12/2024", "UTC", False, "2024-12-04T00:00:00Z"),
    ("04/12/2024", "UTC", True, "2024-04-12T00:00:00Z"),
    ("2026-03-29 02:30:00", "Europe/Paris", False, "2026-03-29T01:30:00Z"),  # skipped hour
    ("2025-10-26 02:30:00", "Europe/Paris", False, "2025-10-26T00:30:00Z"),  # first of two
    ("11/06/2025 00:44", "Europe/London", False, "2025-06-10T23:44:00Z"),
    ("1764936566", "Europe/Paris", False, "2025-12-05T12:09:26Z"),
    ("1749798096432", "Europe/Paris", False, "2025-06-13T07:01:36Z"),
    ("18 avril 2024 à 10h13", "Europe/Paris", False, "2024-04-18T08:13:00Z"),
    ("1er septembre 2025 à 13h18", "Europe/Paris", False, "2025-09-01T11:18:00Z"),
    ("12 février 2024", "Europe/Paris", False, "2024-02-11T23:00:00Z"),
    ("23.03.24", "UTC", False, "2024-03-23T00:00:00Z"),
    ("20251026T002300Z", "UTC", False, "2025-10-26T00:23:00Z"),
    ("20231029", "UTC", False, "2023-10-29T00:00:00Z"),
    ("Fri, 29 Aug 2025 14:59:02 +0900", "UTC", False, "2025-08-29T05:59:02Z"),
    ("2024-10-19 18:22:55 CEST", "UTC", False, "2024-10-19T16:22:55Z"),
    ("18 Jun 2025 14:44:15 BST", "UTC", False, "2025-06-18T13:44:15Z"),
    ("06/27/2023 8:34 PM", "America/New_York", True, "2023-06-28T00:34:00Z"),
    ("Nov 3, 2024 12:15 AM EDT", "America/New_York", True, "2024-11-03T04:15:00Z"),
    ("4-20-23", "UTC", True, "2023-04-20T00:00:00Z"),
    ("2023/12/31 23:30", "UTC", False, "2023-12-31T23:30:00Z"),
    (" 2024-02-29 ", "UTC", False, "2024-02-29T00:00:00Z"),
    ("2023-02-29", "UTC", False, None),
    ("31/31/2024", "UTC", False, None),
    ("2024-01-01T24:00", "UTC", False, None),
    ("2024-05-05 10:00 XYZ", "UTC", False, None),
    ("pending", "UTC", False, None),
    ("n/a", "UTC", False, None),
    ("", "UTC", False, None),
    (None, "UTC", False, None),
    ("x" * 100_000, "UTC", False, None),
]


@pytest.mark.parametrize("zone,month_first", sorted({(c[1], c[2]) for c in CASES}))
def test_written_forms(spark, zone, month_first):
    rows = [(c[0], c[3]) for c in CASES if (c[1], c[2]) == (zone, month_first)]
    df = spark.createDataFrame(rows, "value string, want string")
    got = with_epoch_seconds(df, "value", "sec", zone, month_first).select("value", "want", utc_text(F.col("sec")).alias("got")).collect()
    assert [(r.value, r.got) for r in got] == [(r.value, r.want) for r in got]


def test_local_times_agree_with_zoneinfo(spark):
    for zone in ("Europe/Paris", "America/New_York"):
        start = dt.datetime(2024, 1, 1)
        texts = [(start + dt.timedelta(minutes=47 * i)).strftime("%Y-%m-%d %H:%M:%S") for i in range(12_000)]
        got = {r.v: r.s for r in with_epoch_seconds(spark.createDataFrame([(t,) for t in texts], "v string"), "v", "s", zone).collect()}
        for t in texts:
            local = dt.datetime.strptime(t, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(zone), fold=0)
            assert got[t] == int(local.timestamp()), t


def test_repeats_extra_columns_and_empty_table(spark):
    rows = [("a", "2024-01-01", "x"), ("a", "2024-01-01", "x"), ("b", None, "y"), (None, "2024-01-01", "z")]
    df = spark.createDataFrame(rows, "id string, v string, utc_text string")
    assert sorted(map(tuple, normalise_instants(df, "id", "v", "UTC").collect()), key=str) == sorted(
        [("a", 1704067200, "2024-01-01T00:00:00Z"), (None, 1704067200, "2024-01-01T00:00:00Z")], key=str
    )
    assert normalise_instants(df.limit(0), "id", "v", "UTC").count() == 0
