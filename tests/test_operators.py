from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from eventsort.operators import cluster, dedup, enrich, naming, normalize, plan, positions, review, select

REGISTRY = "seq long, file_name string, created_at string, created_at_source string, created_at_is_embedded boolean, hash_sha256 string, file_path string"
ROWS = [
    (1, "IMG20240718120904.jpg", "2024:07:18 12:09:04", "DateTimeOriginal", True, "h1"),
    (2, "IMG_20240718_160904.jpg", "2024:07:18 16:09:04", "DateTimeOriginal", True, "h2"),
    (3, "x.jpg", "2024:07:18 20:09:05", "CreateDate", True, "h3"),
    (4, "IMG-20240719-WA0004.jpg", "2024:08:01 09:00:00+01:00", "FileModifyDate", False, "h4"),
    (5, "IMG-20240719-WA0004 copy.jpg", None, None, False, "h4"),
    (6, "night.jpg", "2024:07:20 23:30:00+01:00", "DateTimeOriginal", True, "h5"),
    (7, "fatura 7.jpg", "2024:07:20 23:45:00+01:00", "DateTimeOriginal", True, "h6"),
    (8, "unknown.jpg", None, None, False, "h7"),
    (9, "PXL_20240721_120904123.jpg", "0000:00:00 00:00:00", "DateTimeOriginal", True, "h8"),
]


@pytest.fixture(scope="module")
def clustered(spark):
    df = spark.createDataFrame([(*r, f"/m/{r[0]}/{r[1]}") for r in ROWS], REGISTRY)
    return cluster.assign(enrich.enrich(df)).cache()


def test_events_of_the_fixture(clustered):
    events = {r["cluster_id"]: r for r in cluster.event_table(clustered).collect()}
    names = {k: [int(f["file_path"].split("/")[2]) for f in r["files"]] for k, r in events.items()}
    assert names == {"event-0001": [1, 2], "event-0002": [3], "event-0003": [5, 4], "event-0004": [6, 7], "event-0005": [9], "event-0006": [8]}
    assert [events[f"event-000{k}"]["cluster_confidence"] for k in range(1, 7)] == ["high", "high", "medium", "high", "medium", "low"]
    assert events["event-0004"]["timestamp_start"] == "2024-07-20T23:30:00+01:00"
    assert events["event-0006"]["event_day"] == "missing"
    assert events["event-0003"]["timestamp_source_mix"] == {"FilenameDate": 2}


def test_plan_of_the_fixture(clustered):
    files = dedup.flag(clustered)
    built = plan.build(files, cluster.summarize(files), "/t").orderBy("seq").collect()
    rows = {int(r["source_path"].split("/")[2]): r for r in built}
    assert list(rows) == [1, 2, 3, 5, 4, 6, 7, 9, 8]
    assert {k: r["proposed_destination"].rsplit("/", 1)[0] for k, r in rows.items()} == {
        1: "/t/2024/07-18", 2: "/t/2024/07-18", 3: "/t/2024/07-18_02", 4: "/t/_REVIEW/2024-07-19_event-0003", 5: "/t/_GENERAL/_DUPLICATES/event-0003",
        6: "/t/2024/07-20", 7: "/t/_GENERAL/_DOCUMENTS/event-0004", 8: "/t/_GENERAL/_UNSORTED/event-0006", 9: "/t/_REVIEW/2024-07-21_event-0005",
    }
    assert list(plan.PLAN_COLUMNS) == [c for c in rows[1].asDict() if c != "seq"]


def fold(rows):
    """Cluster numbers by a plain loop: (day, epoch, name, seq, rank, precision) in order."""
    out, last, n = {}, None, 0
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        gap = {2: 4, 1: 8, 0: 12}[min(r[4], last[4])] * 3600 if last else 0
        if last is None or last[0] != r[0] or (r[5] != "date" and last[5] != "date" and r[1] - last[1] > gap):
            n += 1
        out[r[3]] = n
        last = r
    return out


def test_gap_events_equal_a_fold(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(1500):
        day = f"2024-01-{rng.randint(1, 12):02d}"
        second = rng.choice([0, 1800, 3600 * rng.randint(0, 23), rng.randint(0, 86399)])
        precision = rng.choice(["second"] * 9 + ["date"])
        rows.append((seq, rng.choice(["a.jpg", "B.jpg", "b.jpg"]), f"{day} {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}", rng.choice(["high", "medium", "low"]), precision))
    df = spark.createDataFrame(rows, "seq long, file_name string, at string, effective_timestamp_confidence string, effective_timestamp_precision string")
    df = df.withColumn("l", F.col("at").cast("timestamp_ntz")).withColumn(enrich.TIME, F.struct(F.col("l").alias("local"), F.lit(0).alias("offset_s"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("l")).alias("epoch"))).drop("l", "at")
    got = {r["seq"]: r["cluster_no"] for r in cluster.assign(df).collect()}
    from datetime import datetime, timezone

    ranks = {"low": 0, "medium": 1, "high": 2}
    expected = fold([(at[:10], int(datetime.fromisoformat(at).replace(tzinfo=timezone.utc).timestamp()), name.lower(), seq, ranks[c], p) for seq, name, at, c, p in rows])
    assert got == expected


def test_undated_rows_are_numbered_last(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}.jpg", None, None, False, "h", "p") for i in range(7)], REGISTRY)
    got = [(r["cluster_no"], r["file_name"], r["seq"]) for r in cluster.assign(enrich.enrich(df)).orderBy("cluster_no").collect()]
    assert [g[0] for g in got] == list(range(1, 8))
    assert [g[1:] for g in got] == sorted((g[1:] for g in got))


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("hot", [50, 100_000])
def test_hot_keys_span_ranges(spark, many_ranges, monkeypatch, hot):
    """One undated name, one instant, one hash and one destination, each over many ranges."""
    monkeypatch.setattr(positions, "HOT_ROWS", hot)
    rows = [(i, "same.jpg", None, None, False, "h", f"/{i}") for i in range(400)]
    rows += [(1000 + i, "IMG-20240719-WA0004.jpg", None, None, False, "h", f"/{1000 + i}") for i in range(400)]
    rows += [(2000 + i, "x.jpg", "2024:07:20 10:00:00" if i < 399 else "2024:07:20 15:00:00", "CreateDate", True, "h", f"/{2000 + i}") for i in range(400)]
    got = {r["seq"]: r for r in cluster.assign(enrich.enrich(spark.createDataFrame(rows, REGISTRY))).collect()}
    assert [got[1000 + i]["cluster_no"] for i in range(400)] == [1] * 400
    assert [got[2000 + i]["cluster_no"] for i in range(400)] == [2] * 399 + [3]
    assert [got[i]["cluster_no"] for i in range(400)] == [4 + i for i in range(400)]
    order = sorted(got.values(), key=lambda r: r["file_order"])
    assert [r["file_order"] for r in order] == list(range(1, 1201)) and [r["seq"] for r in order] == [*range(1000, 1400), *range(2000, 2400), *range(400)]
    df = spark.createDataFrame(rows, REGISTRY)
    ranks = {r["seq"]: r["copy_rank"] for r in dedup.ranked(df).collect()}
    by_rank = sorted(rows, key=lambda r: (len(r[1]), r[1].lower(), r[0]))
    assert [ranks[r[0]] for r in by_rank] == list(range(1, 1201))
    named = naming.name_destinations(df.select("seq", "file_name", F.lit("/f").alias("proposed_folder")), "seq").collect()
    assert {r["seq"]: r["proposed_destination"] for r in named if r["seq"] < 400} == {i: "/f/same.jpg" if not i else f"/f/same__dup{i + 1:02d}.jpg" for i in range(400)}


def test_one_user_spans_ranges(spark, many_ranges):
    rng = random.Random(4)
    rows = [(1, "2024-01-01", rng.randrange(0, 86400, 1800) if i % 2 else 3600, i) for i in range(900)]
    df = spark.createDataFrame(rows, "user long, event_day string, at long, seq long")
    point = F.struct(F.col("at").alias("epoch"), F.lit(2).alias("rank"), F.lit("second").alias("precision"))
    got = {r["seq"]: r["day_sequence"] for r in cluster.number_events(df, point, (F.col("at"), F.col("seq")), ["user"]).collect()}
    n, last, expected = 0, None, {}
    for _, _, at, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        n += last is None or at - last > 4 * 3600
        expected[seq], last = n, at
    assert got == expected


def test_allocation_is_linear():
    names = ["a.jpg", "A.JPG", "a__dup02.jpg"] * 20_000
    began = time.time()
    out = naming.allocate(names)
    assert time.time() - began < 5 and len({x.lower() for x in out}) == len(names)


def test_normalize(spark):
    rows = [
        (1, {"DateTimeOriginal": "2024:07:18 12:09:04", "Make": "Acme", "Model": "X1", "GPSLatitude": "38.7", "GPSLongitude": "-9.1"}),
        (2, {"MediaCreateDate": "2024:07:18 13:00:00", "FileModifyDate": "2024:07:20 09:00:00+01:00"}),
        (3, {"DateTimeOriginal": "0000:00:00 00:00:00", "CreateDate": "2024:07:18 14:00:00"}),
        (4, {"FileModifyDate": "2024:07:20 09:00:00+01:00"}),
        (5, {"Model": "", "GPSLatitude": "0"}),
        (6, {}),
    ]
    got = {r["i"]: r for r in normalize.normalize(spark.createDataFrame(rows, "i int, metadata map<string,string>")).collect()}
    assert got[1]["exif"]["camera"] == "Acme X1" and got[1]["exif"]["gps"]["longitude"] == -9.1
    assert [got[k]["exif"]["created_at_source"] for k in range(1, 7)] == ["DateTimeOriginal", "MediaCreateDate", "DateTimeOriginal", "FileModifyDate", None, None]
    assert got[3]["exif"]["created_at"] == "0000:00:00 00:00:00"
    assert [got[k]["metadata_quality"]["has_embedded_capture_time"] for k in range(1, 7)] == [True, True, True, False, False, False]
    assert got[5]["exif"]["camera"] == "" and got[5]["metadata_quality"]["has_camera_metadata"] and got[5]["exif"]["gps"] is None
    assert got[6]["raw_exif_keys"] == []


def test_duplicates(spark):
    rows = [(1, "a copy.jpg", "h", "/1"), (2, "a (1).jpg", "h", "/2"), (3, "a.jpg", "h", "/3"), (4, "b.jpg", "g", "/4"), (5, "a.jpg", "h", "/5")]
    df = spark.createDataFrame(rows, "seq long, file_name string, hash_sha256 string, file_path string")
    assert {r["seq"]: r["is_duplicate_secondary"] for r in dedup.flag(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert [r["paths"] for r in dedup.groups(df).collect()] == [["/1", "/2", "/3", "/5"]]
    assert {r["seq"]: r["copy_rank"] for r in dedup.ranked(df).collect()} == {3: 1, 5: 2, 2: 3, 1: 4, 4: 1}


def test_files_without_a_hash_stay(spark):
    rows = [(1, "a.jpg", None, "/1"), (2, "a copy.jpg", None, "/2"), (3, "b.jpg", "h", "/3"), (4, "b copy.jpg", "h", "/4"), (5, "c.jpg", "i", "/5")]
    df = spark.createDataFrame(rows, "seq long, file_name string, hash_sha256 string, file_path string")
    # as in the reference, which groups by any value
    assert {r["seq"]: r["is_duplicate_secondary"] for r in dedup.flag(df).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_naming_equals_allocation(spark):
    rng = random.Random(3)
    names = ["A.JPG", "a.jpg", "a__dup02.jpg", "a__dup03.jpg", "b.png", "noext", "NoExt", "a__dup02__dup02.jpg"]
    rows = [(i, f"/f/{rng.randint(0, 25)}", rng.choice(names)) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, proposed_folder string, file_name string")
    got = {r["seq"]: r["proposed_destination"] for r in naming.name_destinations(df, "seq").collect()}
    expected = {}
    for folder in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == folder]
        expected |= {r[0]: f"{folder}/{n}" for r, n in zip(mine, naming.allocate([r[2] for r in mine]), strict=True)}
    assert got == expected


def test_selection_and_outcomes(spark):
    rows = [("c1", "high", False), ("c1", "medium", False), ("c2", "low", True), ("c2", None, None), ("c3", "odd", False), ("c3", "high", None)]
    df = spark.createDataFrame(rows, "cluster_id string, cluster_confidence string, review_recommended boolean")
    n = lambda **k: select.chosen(df, select.Selection(**k)).count()
    assert n() == 2 and n(min_confidence="low") == 4 and n(only_auto_approved=True) == 1 and n(min_confidence="low", cluster_ids=("c2",)) == 1
    work = spark.createDataFrame([("s1", "t1"), ("s2", "t2"), ("s3", "t3"), ("s4", "t4")], "source_path string, proposed_destination string")
    here = spark.createDataFrame([("s2", 5), ("s3", 5), ("s4", 5)], "path string, size long")
    there = spark.createDataFrame([("t2", 5), ("t3", 6)], "path string, size long")
    probed = select.probe(work, here, there)
    done = lambda **k: {r["source_path"]: r["outcome"] for r in select.dry_run(probed, select.Selection(**k)).collect()}
    assert done() == {"s1": "source_missing", "s2": "skipped_existing", "s3": "skipped_conflict", "s4": "dry_run_planned"}
    assert done(overwrite=True)["s3"] == "dry_run_planned"


def test_review_routing(spark):
    events = spark.createDataFrame([("event-0003", "2024-07-19", 1), ("event-0005", "2024-07-21", 2), ("event-12345", "2024-08-01", 3)], "cluster_id string, event_day string, day_sequence long")
    names = ["2024-07-19_event-0003_A", "2024-07-21_event-0005_G", "2024-07-21_event-0005", "2024-07-21_event-0005_a", "trip_G", "x_event-9999_A", "d_event-12345_A"]
    got = {r["folder_name"]: (r["status"], r["target_folder"]) for r in review.route(spark.createDataFrame([(n,) for n in names], "folder_name string"), events, "/t", "/g").collect()}
    assert [got[n] for n in names] == [
        ("decided", "/t/2024/07-19"), ("decided", "/g/2024-07-21_event-0005"), ("ignored_no_suffix", None), ("ignored_no_suffix", None),
        ("ignored_no_cluster_id", None), ("decided", "/t/_GENERAL/_UNSORTED/event-9999"), ("decided", "/t/2024/08-01_03"),
    ]
