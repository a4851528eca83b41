import datetime as dt
import zoneinfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.functions.zones import transitions, wall_to_utc, zone_version
from postmill.operators.timestamps import number_instant, text_instants


def us(text):
    return int(dt.datetime.fromisoformat(text).timestamp() * 1_000_000 + 0.5)


CASES = [
    ("2025-06-01T12:00:00Z", None, None, "2025-06-01T12:00:00+00:00"),
    ("2025-06-01T12:00:00.123456789+02:00", "Asia/Tokyo", None, "2025-06-01T10:00:00.123456+00:00"),
    ("  2025/06/01 12:00:00 ", "America/New_York", None, "2025-06-01T16:00:00+00:00"),
    ("2025-06-01", "Asia/Tokyo", None, "2025-05-31T15:00:00+00:00"),
    ("2025-152T12:00:00Z", None, None, "2025-06-01T12:00:00+00:00"),
    ("20250601T120000Z", None, None, "2025-06-01T12:00:00+00:00"),
    ("01.06.2025 12:00", "UTC", "dmy", "2025-06-01T12:00:00+00:00"),
    ("6/1/2025 12:30 am", "UTC", "mdy", "2025-06-01T00:30:00+00:00"),
    ("1/6/2025 12:30 pm", "UTC", "dmy", "2025-06-01T12:30:00+00:00"),
    ("Sun, 01 Jun 2025 12:00:00 GMT", "Asia/Tokyo", None, "2025-06-01T12:00:00+00:00"),
    ("Sun, 01 Jun 2025 12:00:00 -0330", None, None, "2025-06-01T15:30:00+00:00"),
    ("Jun 1, 2025 8:00 AM PDT", "Asia/Tokyo", None, "2025-06-01T15:00:00+00:00"),
    ("1 June 2025, 12:00", "UTC", None, "2025-06-01T12:00:00+00:00"),
    ("01-JUN-2025 12:00", "UTC", None, "2025-06-01T12:00:00+00:00"),
    ("2025-06-01 12:00:00 Europe/Berlin", None, None, "2025-06-01T10:00:00+00:00"),
    ("2025-10-26 02:30:00", "Europe/Berlin", None, "2025-10-26T00:30:00+00:00"),  # twice: the first
    ("2025-03-30 02:30:00", "Europe/Berlin", None, "2025-03-30T01:30:00+00:00"),  # skipped: moved on
    ("1748779200", None, None, "2025-06-01T12:00:00+00:00"),
    ("1748779200123", None, None, "2025-06-01T12:00:00.123+00:00"),
    ("1748779200.5", None, None, "2025-06-01T12:00:00.5+00:00"),
    ("2024-02-29 00:00", "UTC", None, "2024-02-29T00:00:00+00:00"),
]
NOTHING = ["", "   ", None, "TBD", "yesterday", "0000-00-00", "2025-13-01", "2025-02-29", "25:61", "2025-06-01T24:30:00Z", "-5", "0", "12345", "2025-06-01 12:00:00 Mars/Base",
           "2025-06-01 12:00:00 XYZ", "1" * 400, "13/13/2025 10:00", "2025-366T00:00:00Z", "May 32, 2025 1:00 PM UTC", "9" * 19]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, z, s) for i, (v, z, s, _) in enumerate(CASES)], "id int, v string, z string, s string")
    got = {r.id: r.epoch_us for r in text_instants(df, ["id"], "v", "z", "s").collect()}
    assert got == {i: us(want) for i, (*_, want) in enumerate(CASES)}


def test_nothing_and_empty(spark):
    df = spark.createDataFrame([(v, "UTC") for v in NOTHING], "v string, z string")
    assert text_instants(df, ["v"], "v", "z", F.lit("dmy")).count() == 0
    assert text_instants(df.limit(0), ["v"], "v", "z", F.lit("dmy")).count() == 0


def test_clashing_names_and_repeats(spark):
    df = spark.createDataFrame([("2025-06-01", "a", 1)] * 2, "epoch string, mask string, value int")
    assert [r.value for r in text_instants(df, ["value", "mask"], "epoch", F.lit(None).cast("string"), F.lit(None).cast("string")).collect()] == [1, 1]


def test_numbers(spark):
    t = 1748779200
    df = spark.createDataFrame([(t,), (t * 1000,), (t * 10**6 + 1,), (t * 10**9 + 1999,), (0,), (-t,), (None,), (5,)], "v bigint")
    assert [r[0] for r in df.select(number_instant(F.col("v"))).collect()] == [t * 10**6, t * 10**6, t * 10**6 + 1, t * 10**6 + 1, None, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2_400_000_000), st.sampled_from(["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Lord_Howe", "America/Phoenix"]))
def test_wall_time(wall, name):
    naive = dt.datetime.fromtimestamp(wall, dt.UTC).replace(tzinfo=None)
    assert wall_to_utc(np.array([wall]), name)[0] == naive.replace(tzinfo=zoneinfo.ZoneInfo(name)).timestamp()


def test_zone_tables():
    assert transitions("No/Where") is None and zone_version()
    assert len(transitions("Europe/Berlin")[0]) > 100


@pytest.mark.parametrize("bad", [None, "Nope/Zone"])
def test_unknown_zone(spark, bad):
    df = spark.createDataFrame([("2025-06-01 12:00", bad)], "v string, z string")
    assert text_instants(df, ["v"], "v", "z", F.lit("ymd")).count() == (1 if bad is None else 0)
