import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from pitchgrid.functions.instants import iso_instant, normalise_times, with_instants

CASES = {
    "2023-02-18T11:15:00+01:00": "2023-02-18T10:15:00Z", "19/12/2022 21:30:00 CET": "2022-12-19T20:30:00Z", "1664543700": "2022-09-30T13:15:00Z", "1740945600692": "2025-03-02T20:00:00Z",
    "20250316T103000Z": "2025-03-16T10:30:00Z", "Wed, 29 Nov 2023 12:15:00 GMT": "2023-11-29T12:15:00Z", "2025-01-21 06:30:00-05:00": "2025-01-21T11:30:00Z",
    "15.03.2024, 12:00 Uhr (UTC+1)": "2024-03-15T11:00:00Z", "Apr 13, 2024 12:15 AM": "2024-04-12T22:15:00Z", "Apr 13, 2024 12:15 PM": "2024-04-13T10:15:00Z",
    "2023-08-13 18:00:00 Atlantic/Canary": "2023-08-13T17:00:00Z", "2024-05-09T22:00:00.250+02:00": "2024-05-09T20:00:00Z", "12/31/2023 10:00": "2023-12-31T09:00:00Z",
    "2023-10-29 02:30:00": "2023-10-29T00:30:00Z", "2024-03-31T02:30": "2024-03-31T01:30:00Z", "20240502": "2024-05-01T22:00:00Z", "2024-02-30 10:00": None, "2024-13-01": None,
    "2024-01-01 25:00": None, "TBC": None, "--:--": None, "": None, "0000-00-00": None, "2024-01-01 10:00 Mars/Base": None,
}


def test_cases(spark):
    df = spark.createDataFrame([(t, "Europe/Madrid") for t in CASES] + [(None, "Europe/Madrid")], "text string, zone string")
    got = {r.text: r.norm for r in with_instants(df).withColumn("norm", iso_instant(F.col("seconds"))).collect()}
    assert got == CASES | {None: None}


def test_against_tz_database(spark):
    rnd = random.Random(5)
    days = [datetime(2020, 1, 1) + timedelta(minutes=rnd.randrange(6 * 365 * 24 * 60)) for _ in range(400)]
    df = spark.createDataFrame([(t.strftime("%Y-%m-%d %H:%M:%S"), "Europe/Madrid") for t in days], "text string, zone string")
    got = {r.text: r.seconds for r in with_instants(df).collect()}
    for t in days:
        assert got[t.strftime("%Y-%m-%d %H:%M:%S")] == int(t.replace(tzinfo=ZoneInfo("Europe/Madrid")).astimezone(timezone.utc).timestamp())


def test_rows_repeats_and_days(spark):
    df = spark.createDataFrame([("a", "2023-08-13T22:15:00Z", 1), ("a", "2023-08-13T22:15:00Z", 2), ("b", "TBC", 3), (None, "13.02.2024", 4)], "id string, date string, text int")
    got = {tuple(r) for r in normalise_times(df, "t", "id", {"date": ("day", "Europe/Madrid")}).collect()}
    assert got == {("t", "a", "date", "2023-08-14"), ("t", None, "date", "2024-02-13")}
    assert normalise_times(df.limit(0), "t", "id", {"date": ("day", "Europe/Madrid")}).count() == 0


def test_other_zones_and_earlier_years_against_tz_database(spark):
    """Years before the European rule, and zones outside it, follow their own history."""
    rnd = random.Random(6)
    zones = ["Europe/Madrid", "Europe/London", "America/New_York", "America/Argentina/Buenos_Aires", "Asia/Tokyo", "Australia/Sydney"]
    cases = [(datetime(1950, 1, 1) + timedelta(minutes=rnd.randrange(75 * 365 * 24 * 60)), rnd.choice(zones)) for _ in range(500)]
    df = spark.createDataFrame([(f"{t:%Y-%m-%d %H:%M:%S} {z}", "Europe/Madrid") for t, z in cases] + [("1978-05-01 10:00:00", "Europe/Madrid"), ("2024-01-01 10:00 Mars/Base", "Europe/Madrid")], "text string, zone string")
    got = {r.text: r.seconds for r in with_instants(df).collect()}
    for t, z in cases:
        assert got[f"{t:%Y-%m-%d %H:%M:%S} {z}"] == int(t.replace(tzinfo=ZoneInfo(z)).astimezone(timezone.utc).timestamp()), (t, z)
    assert got["1978-05-01 10:00:00"] == int(datetime(1978, 5, 1, 8, tzinfo=timezone.utc).timestamp()) and got["2024-01-01 10:00 Mars/Base"] is None
    day = normalise_times(spark.createDataFrame([("a", "1978-05-01T22:30:00Z")], "id string, date string"), "t", "id", {"date": ("day", "Europe/Madrid")})
    assert day.first().norm == "1978-05-02"
