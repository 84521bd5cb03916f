from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventsort.functions import exif_time, filename_time, text
from eventsort.operators.naming import allocate


def column(spark, values, make, name="x"):
    """``make`` of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r["y"] for r in df.select("i", make(F.col(name)).alias("y")).orderBy("i").collect()]


EXIF = {
    "2024:07:18 23:30:00+01:00": "2024-07-18T23:30:00+01:00",
    "2024:07:18 12:09:04": "2024-07-18T12:09:04+00:00",
    "2024-7-8 1:2:3": "2024-07-08T01:02:03+00:00",
    "2024:07: 8   01:02:03Z": "2024-07-08T01:02:03+00:00",
    "2024:07:18 10:00:00-0530": "2024-07-18T10:00:00-05:30",
    "2024:07:18 10:00:00+01:02:03": "2024-07-18T10:00:00+01:02:03",
    "2024:07:18 10:00:00.50": None,
    "2024:07:18 10:00:00 ": None,
    "2024:07:18 10:00:00\n": None,
    "2024:07:18 10:00:00z": None,
    "2024:07:18 10:00:00+01": None,
    "2024:07-18 10:00:00": None,
    "2024:02:30 10:00:00": None,
    "2024:07:18 24:00:00": None,
    "2024:07:18 10:00:60": None,
    "0000:00:00 00:00:00": None,
    "0000:07:18 10:00:00": None,
    "2024-07-18": None,
    "": None,
}


def test_exif_goldens(spark):
    got = column(spark, [*EXIF, None], lambda x: exif_time.iso(exif_time.parse(x)))
    assert dict(zip(EXIF, got, strict=False)) == EXIF
    assert got[-1] is None


def test_exif_instant_honours_offset(spark):
    assert column(spark, ["1970:01:01 01:00:00+01:00"], lambda x: exif_time.parse(x)["epoch"]) == [0]


NAMES = {
    "IMG20240718120904.jpg": ("2024-07-18T12:09:04+00:00", "second"),
    "IMG_20201023_184331.jpg": ("2020-10-23T18:43:31+00:00", "second"),
    "Screenshot_2024-07-19-20-39-21.png": ("2024-07-19T20:39:21+00:00", "second"),
    "a_2024-07-19_20-39-21.png": ("2024-07-19T20:39:21+00:00", "second"),
    "IMG-20240718-WA0004.jpg": ("2024-07-18T12:00:00+00:00", "date"),
    "PXL_20240718_120904123.jpg": ("2024-07-18T12:00:00+00:00", "date"),
    "trip 2024-07-18.jpg": ("2024-07-18T12:00:00+00:00", "date"),
    "12345678_20240718.jpg": (None, None),
    "20240718120904123.jpg": (None, None),
    "00000101 20240718.jpg": (None, None),
    "DSC_1.jpg": (None, None),
    "20240718": ("2024-07-18T12:00:00+00:00", "date"),
}


def test_filename_goldens(spark):
    got = column(spark, list(NAMES), lambda x: F.struct(exif_time.iso(filename_time.parse(x)["time"]).alias("t"), filename_time.parse(x)["precision"].alias("p")))
    assert {n: (r["t"], r["p"]) for n, r in zip(NAMES, got, strict=True)} == NAMES


def test_path_parts(spark):
    names = ["a.b.JPG", "foo.", ".jpg", "..jpg", "noext", "a.jpg"]
    assert column(spark, names, text.stem) == ["a.b", "foo.", ".jpg", ".", "noext", "a"]
    assert column(spark, names, text.suffix) == [".JPG", "", "", ".jpg", "", ".jpg"]


def test_text_goldens(spark):
    assert column(spark, ["2024:07:18 10:00:00", "", None, "2024-07-18"], text.date_key) == ["2024-07-18", None, None, "2024-07-18"]
    assert column(spark, ["event-0001", "a b/c", "__", "é 1"], text.folder_part) == ["event-0001", "a_bc", "unknown", "é_1"]
    assert column(spark, ["manifest.jpg", "acc_1.jpg", "Fatura 7.jpg", "x.jpg", "CARTÃO.png"], text.is_document) == [True, True, True, False, True]
    assert column(spark, ["a.jpg", "a copy.jpg", "a (1).jpg", "a 2.jpg", "a__dup02.jpg", "a_copy 3.jpg"], text.duplicate_penalty) == [0, 50, 20, 20, 100, 70]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a.jpg", "A.JPG", "a__dup02.jpg", "a__dup03.jpg", "a__dup02__dup02.jpg", "b", "B", ".x", "c."]), max_size=12))
def test_allocation_never_repeats(names):
    out = allocate(names)
    assert len({n.lower() for n in out}) == len(names)
    assert all(o == n or "__dup" in o for o, n in zip(out, names, strict=True))


def test_allocation_goldens():
    assert allocate(["A.JPG", "a.jpg", "a__dup03.jpg", "a.jpg", "a__dup02.jpg"]) == ["A.JPG", "a__dup02.jpg", "a__dup03.jpg", "a__dup04.jpg", "a__dup02__dup02.jpg"]


@pytest.mark.parametrize("zone", ["", "Z", "+0100", "-03:30"])
def test_exif_fuzz(spark, zone):
    base = datetime(2019, 12, 30, 22, 15, 1)
    moments = [base + timedelta(hours=7 * k, seconds=13 * k) for k in range(300)]
    got = column(spark, [m.strftime("%Y:%m:%d %H:%M:%S") + zone for m in moments], lambda x: exif_time.parse(x)["epoch"])
    shift = {"": 0, "Z": 0, "+0100": 3600, "-03:30": -12600}[zone]
    assert got == [int(m.replace(tzinfo=timezone.utc).timestamp()) - shift for m in moments]
