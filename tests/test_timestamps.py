from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from waymark.operators.timestamps import ZoneTable, parser_of, with_utc_micros, zone_source, zone_table

US = timedelta(microseconds=1)


def utc(*a, us=0):
    return (datetime(*a) - datetime(1970, 1, 1)) // US + us


CASES = [
    # text, zone, day first, expected
    ("2022-09-08T10:43:13.000-04:00", "UTC", True, utc(2022, 9, 8, 14, 43, 13)),
    ("2022-03-27t18:45:49.761172103+0530", "UTC", True, utc(2022, 3, 27, 13, 15, 49, us=761172)),
    ("2024-11-12T06:51−05:00", "UTC", True, utc(2024, 11, 12, 11, 51)),
    ("2020-10-14 23:10:00 -09:30", "UTC", True, utc(2020, 10, 15, 8, 40)),
    ("2018-06-24T03:18:57+03:00[Europe/Helsinki]", "UTC", True, utc(2018, 6, 24, 0, 18, 57)),
    ("2019-08-15T21:09:08[Europe/Berlin]", "Asia/Tokyo", True, utc(2019, 8, 15, 19, 9, 8)),
    ("2020-03-28 10:19:33 Europe/Berlin", "Asia/Tokyo", True, utc(2020, 3, 28, 9, 19, 33)),
    ("2025-03-30 03:53:22 EDT", "Asia/Tokyo", True, utc(2025, 3, 30, 7, 53, 22)),
    ("Sun, 21 Feb 2021 02:58:16 GMT", "Asia/Tokyo", True, utc(2021, 2, 21, 2, 58, 16)),
    ("Saturday, 26-May-18 18:03:52 GMT", "Asia/Tokyo", True, utc(2018, 5, 26, 18, 3, 52)),
    ("Fri Mar 11 10:58:36 CET 2022", "Asia/Tokyo", True, utc(2022, 3, 11, 9, 58, 36)),
    ("Sat Feb  5 22:30:39 2022", "Asia/Tokyo", True, utc(2022, 2, 5, 13, 30, 39)),
    ("03-NOV-2017 23:24:34", "UTC", True, utc(2017, 11, 3, 23, 24, 34)),
    ("20210225064359", "Asia/Kolkata", True, utc(2021, 2, 25, 1, 13, 59)),
    ("20241117T052814+0900", "UTC", True, utc(2024, 11, 16, 20, 28, 14)),
    ("2024-01-01T00:00:00." + "0" * 80 + "Z", "UTC", True, utc(2024, 1, 1)),
    ("2024-01-01T00:00:00.123456" + "7" * 100_000 + "+01:00", "UTC", True, utc(2023, 12, 31, 23, us=123456)),
    ("x" * 100_000, "UTC", True, None),
    ("1633335724.444", "Asia/Tokyo", True, 1633335724444000),
    ("1633335724", "Asia/Tokyo", True, 1633335724000000),
    ("1623545985844", "Asia/Tokyo", True, 1623545985844000),
    ("1665154622798558", "Asia/Tokyo", True, 1665154622798558),
    ("1665154622798558123", "Asia/Tokyo", True, 1665154622798558),
    ("05/06/2021 13:21", "UTC", True, utc(2021, 6, 5, 13, 21)),
    ("05/06/2021 13:21", "UTC", False, utc(2021, 5, 6, 13, 21)),
    ("06/11/2020 12:28 am", "UTC", False, utc(2020, 6, 11, 0, 28)),
    ("06/11/2020 12:28 PM", "UTC", False, utc(2020, 6, 11, 12, 28)),
    ("05/06/2021 13:21", "UTC", None, None),
    ("13.06.2023 07:18", "UTC", False, utc(2023, 6, 13, 7, 18)),
    ("2019-08-20", "Asia/Tokyo", True, utc(2019, 8, 20)),
    ("2022-02", "Asia/Tokyo", True, utc(2022, 2, 1)),
    ("2021/08/19", "Asia/Tokyo", True, utc(2021, 8, 19)),
    ("2020-030", "Asia/Tokyo", True, utc(2020, 1, 30)),
    ("2020-366", "Asia/Tokyo", True, utc(2020, 12, 31)),
    ("2021-366", "Asia/Tokyo", True, None),
    ("2017-W18-4", "Asia/Tokyo", True, utc(2017, 5, 4)),
    ("2020-W53-7", "Asia/Tokyo", True, utc(2021, 1, 3)),
    ("2021-W53-1", "Asia/Tokyo", True, None),
    ("January 27, 2024", "Asia/Tokyo", True, utc(2024, 1, 27)),
    ("6 April 2016", "Asia/Tokyo", True, utc(2016, 4, 6)),
    ("  2019-08-20　", "UTC", True, utc(2019, 8, 20)),
    # twice, skipped, impossible
    ("2021-11-07 01:30:00", "America/New_York", True, utc(2021, 11, 7, 5, 30)),
    ("2021-03-14 02:30:00", "America/New_York", True, None),
    ("2018-10-12T25:04:00Z", "UTC", True, None),
    ("2021-02-30T18:00:00Z", "UTC", True, None),
    ("2024-04-02T01:62:00Z", "UTC", True, None),
    ("0000-00-00 00:00:00", "UTC", True, None),
    ("2016-13-15", "UTC", True, None),
    ("2019-08-15 21:09:08", None, True, None),
    ("2019-08-15 21:09:08", "Nowhere/Land", True, None),
    ("2019-08-15T21:09:08[Nowhere/Land]", "UTC", True, None),
    ("2019-08-15", None, None, utc(2019, 8, 15)),
] + [(t, "UTC", True, None) for t in (None, "", " ", "today", "1 hour ago", "n/a", "-", "????", "null", "9" * 5000, "2019-08-20\x00", "𝟚𝟘𝟙𝟡-08-20")]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "utc_us int, t string, z string, f boolean, want long")
    df = df.withColumnRenamed("utc_us", "id").selectExpr("*", "'kept' as host_id", "1 as utc_us")
    got = {r.id: (r.t, r.want, r.utc_us, r.host_id) for r in with_utc_micros(df, "t", "z", "f").collect()}
    assert [(t, w, u) for t, w, u, _ in got.values() if w != u] == []
    assert len(got) == len(CASES) and {h for *_, h in got.values()} == {"kept"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "t string, z string, f boolean")
    assert with_utc_micros(df, "t", "z", "f").columns == ["t", "z", "f", "utc_us"] and with_utc_micros(df, "t", "z", "f").count() == 0


@pytest.mark.parametrize("name", ["Europe/Berlin", "Australia/Lord_Howe", "America/New_York", "Africa/Casablanca", "Pacific/Apia", "Asia/Kathmandu"])
def test_zone_table_against_zoneinfo(name):
    zone, table = ZoneInfo(name), zone_table()
    near = np.concatenate([t + np.arange(-20, 21) * 900 + table.zones[name][1].max() for t in table.zones[name][0][1:]])
    near = near[(near > -2e9) & (near < 4e9)]
    got, known = table.to_utc(name, near)
    for clock, value, exists in zip(near.tolist(), got.tolist(), known.tolist(), strict=True):
        local = datetime(1970, 1, 1) + timedelta(seconds=clock)
        first = local.replace(tzinfo=zone).astimezone(timezone.utc)
        assert exists == (first.astimezone(zone).replace(tzinfo=None) == local)
        assert not exists or value == first.timestamp()


def test_masks_are_parsed_once_and_bounded():
    assert parser_of("9999-99-99")[0] == "ymd" and parser_of("9" * 1000) is None


def test_years_beyond_the_table_follow_the_rule():
    zones = ZoneTable.build()
    for name in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Gaza", "Africa/Casablanca", "Asia/Tokyo"):
        clocks = [datetime(y, m, d, 12) for y in (2119, 2125, 2128, 2129, 2130, 2300, 2399, 2400, 2500, 9998) for m in range(1, 13) for d in (1, 28)]
        local = np.array([(c - datetime(1970, 1, 1)) // timedelta(seconds=1) for c in clocks], np.int64)
        utc, known = zones.to_utc(name, local)
        want = [round((c.replace(tzinfo=ZoneInfo(name)).astimezone(timezone.utc).replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()) for c in clocks]
        assert known.all() and utc.tolist() == want, name


def test_the_zone_table_names_the_release_it_was_read_from(spark):
    version, names, read = zone_source()
    assert zone_table().version == version and set(names) == set(zone_table().zones) and read("Europe/Berlin")[:4] == b"TZif"
    df = spark.createDataFrame([("2024-07-01 12:00", "X", True)], "t string, z string, f boolean")
    old = ZoneTable("some release", {"X": (np.array([-(1 << 60)]), np.array([3600]))})
    got = with_utc_micros(df, "t", "z", "f", table=old)
    assert got.schema["utc_us"].metadata == {"zone_data": "some release"} and got.first().utc_us == utc(2024, 7, 1, 11)
