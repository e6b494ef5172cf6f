"""Timestamp normalisation by cases, and against an independent reading of the whole tables."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyspark.sql.functions as F
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from millrace.operators import instants
from millrace.plans.general import p3_found

OSLO = [
    ("2024-06-30T12:00:00+02:00", "2024-06-30T10:00:00.000000Z"),
    ("2024-06-30t12:00:00,5z", "2024-06-30T12:00:00.500000Z"),
    ("2024-06-30 12:00", "2024-06-30T10:00:00.000000Z"),
    ("30.06.2024 kl. 12.00", "2024-06-30T10:00:00.000000Z"),
    ("30.06.2024, 12.00", "2024-06-30T10:00:00.000000Z"),
    ("søndag 30. juni 2024 kl. 12:00", "2024-06-30T10:00:00.000000Z"),
    ("30/06/2024", "2024-06-30"),
    ("2024/06/30", "2024-06-30"),
    ("3. Mai 2024", "2024-05-03"),
    ("Oppdatert: 3. mai 2024", "2024-05-03"),
    ("December 3, 2024", "2024-12-03"),
    ("20240331T021749Z", "2024-03-31T02:17:49.000000Z"),
    ("Oct 18, 2024 12:23 AM UTC", "2024-10-18T00:23:00.000000Z"),
    ("Oct 18, 2024 12:23 PM UTC", "2024-10-18T12:23:00.000000Z"),
    ("Sat, 26 Oct 2024 19:47:37 EDT", "2024-10-26T23:47:37.000000Z"),
    ("2024-10-27T02:02:12+02:00[Europe/London]", "2024-10-27T00:02:12.000000Z"),
    ("2026-02-25 22:06 Europe/Helsinki", "2026-02-25T20:06:00.000000Z"),
    ("2025-04-30T23:00:00+12:45", "2025-04-30T10:15:00.000000Z"),
    ("Tue, 02 Jul 2024 19:36:45 +0200 (CEST)", "2024-07-02T17:36:45.000000Z"),
    ("2024-07-02 19:36 UTC+2", "2024-07-02T17:36:00.000000Z"),
    ("2025-04-30T23:00:00-0330", "2025-05-01T02:30:00.000000Z"),
    ("1700000000", "2023-11-14T22:13:20.000000Z"),
    ("1700000000123", "2023-11-14T22:13:20.123000Z"),
    ("1700000000123456", "2023-11-14T22:13:20.123456Z"),
    ("2025-08-10T22:03:32.488152999Z", "2025-08-10T22:03:32.488152Z"),
    ("2025-10-26 02:30:00", "2025-10-26T00:30:00.000000Z"),  # occurs twice: the earlier one
    ("2025-03-30 02:30:00", "2025-03-30T01:30:00.000000Z"),  # skipped: the offset before
    ("2024-02-29", "2024-02-29"),
    (" 2024-02-29 ", "2024-02-29"),
]
UNUSABLE = ["", " ", None, "2023-02-29", "31.04.2026", "0000-00-00", "2026-06-14T25:10:00Z", "2025-13-04", "ukjent", "i går", "for to uker siden", "-", "n/a", "13:45", "2024-01-01T10:60:00Z", "2024-01-01 10:00 Mars/Olympus", "2024-01-01 13:00 PM", "9" * 30, "x" * 50_000, "2024-01-01T10:00:00+19:00"]


def test_cases(spark):
    rows = [(i, v, "clash") for i, v in enumerate([a for a, _ in OSLO] + UNUSABLE)]
    df = spark.createDataFrame(rows, "id int, v string, normal_form string")
    got = {r.k: r.normal_form for r in instants.normal_forms(df, F.col("v"), {"k": F.col("id")}, "Europe/Oslo").collect()}
    assert got == {i: b for i, (_, b) in enumerate(OSLO)}


def test_empty_table_and_unknown_zone(spark):
    df = spark.createDataFrame([], "v string")
    assert instants.normal_forms(df, F.col("v"), {}, "UTC").count() == 0
    with pytest.raises(ValueError, match="no zone"):
        instants.convert(["2024-01-01 10:00"], "9999-99-99 99:99", "No/Where")


@settings(max_examples=200, deadline=None)
@given(st.datetimes(min_value=datetime(1971, 1, 1), max_value=datetime(2090, 1, 1)), st.sampled_from(["Europe/Oslo", "America/New_York", "Australia/Lord_Howe", "UTC"]))
def test_local_times_agree_with_the_zone_database(local, name):
    local = local.replace(microsecond=0)
    got = instants.convert([local.strftime("%Y-%m-%d %H:%M:%S")], "9999-99-99 99:99:99", name)[0]
    zone = ZoneInfo(name)
    expected = local.replace(tzinfo=zone, fold=0).astimezone(timezone.utc)
    assert got == expected.strftime("%Y-%m-%dT%H:%M:%S.000000Z")


@settings(max_examples=300, deadline=None)
@given(st.datetimes(min_value=datetime(2, 1, 1), max_value=datetime(9998, 12, 31)), st.sampled_from(["Europe/Oslo", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca"]))
@example(datetime(2150, 7, 1, 12), "Europe/Oslo")
@example(datetime(1890, 7, 1, 12), "Europe/Oslo")
@example(datetime(2499, 12, 31, 23, 59, 59), "Australia/Lord_Howe")
@example(datetime(2500, 1, 1), "Australia/Lord_Howe")
@example(datetime(9998, 7, 1), "Europe/Oslo")
def test_zone_rules_hold_in_every_year(local, name):
    local = local.replace(microsecond=0)
    got = instants.zone_table(name).to_utc(np.array([(local - datetime(1970, 1, 1)) // timedelta(seconds=1)]))[0]
    assert got == (local.replace(tzinfo=ZoneInfo(name), fold=0) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)


def test_each_mask_is_compiled_once():
    instants.mask_parser.cache_clear()
    instants._convert_batch(["2024-01-01"] * 50, ["9999-99-99"] * 50, "UTC")
    assert instants.mask_parser.cache_info().misses == 1


def test_table_is_versioned():
    table = instants.zone_table("Europe/Oslo")
    assert table.version == instants.zone_database_version() and len(table.instants) == len(table.offsets) > 100


def test_query_gives_distinct_rows(spark, sf):
    rows = [tuple(r) for r in p3_found(spark, sf).collect()]
    assert rows and len(rows) == len(set(rows))
    for _, _, _, form in rows:
        datetime.strptime(form, "%Y-%m-%dT%H:%M:%S.%fZ" if "T" in form else "%Y-%m-%d") + timedelta(0)


def test_another_zone_database_is_an_error():
    instants.same_zones(instants.zone_database_version())
    with pytest.raises(RuntimeError, match="on the driver"):
        instants.same_zones("1999a")
