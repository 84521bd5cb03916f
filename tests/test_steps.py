"""From a folder of tiny files to a sorted one, through the command line's steps."""

from __future__ import annotations

import hashlib
import json
import os

import pytest

from eventsort import cli
from eventsort.operators.select import Selection
from eventsort.plans import steps
from eventsort.sources import content, files
from eventsort.sources.listing import extension_of, listing, media
from eventsort.streaming import registry as stream


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    made = {"_DSC1.jpg": b"1", ".hidden.jpg": b"2", "a b.JPG": b"3", "c%20é.jpg": b"4", "x.txt": b"5", "noext": b"6", "foo.": b"7", ".jpg": b"8", "sub/y.MP4": b"9", "sub/deep/y copy.mp4": b"9", "sub/IMG20240718120904.jpg": b"10"}
    for name, data in made.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(data)
    os.makedirs(root / "dir.jpg")
    return root


def test_listing(spark, library):
    found = {r["name"] for r in media(spark, str(library)).collect()}
    assert found == {"_DSC1.jpg", ".hidden.jpg", "a b.JPG", "c%20é.jpg", "y.MP4", "y copy.mp4", "IMG20240718120904.jpg"}
    assert {r["name"] for r in listing(spark, str(library), depth="one", kind="dir").collect()} == {"dir.jpg", "sub"}
    assert extension_of("a.B.JPG") == ".jpg" and extension_of(".jpg") == "" and extension_of("x.") == ""
    with pytest.raises(Exception, match="no such folder"):
        listing(spark, str(library / "none")).collect()


def test_hashes(spark, library):
    got = {r["path"].rsplit("/", 1)[1]: r["hash_sha256"] for r in content.hash_files(media(spark, str(library))).collect()}
    assert got["a b.JPG"] == hashlib.sha256(b"3").hexdigest()
    gone = spark.createDataFrame([("/no/such",)], "path string")
    assert content.hash_files(gone).first()["error"]


def test_extractor_failure_is_a_row(spark, library):
    rows = content.extract_metadata(media(spark, str(library)), ("/no/such/tool",)).collect()
    assert len(rows) == 7 and all(r["error"] and r["metadata"] is None for r in rows)
    assert content.parse_metadata('[{"a": 1.5, "b": null, "c": "x", "d": [1]}]') == [{"a": "1.5", "b": None, "c": "x", "d": "[1]"}]


def test_whole_way(spark, library, tmp_path):
    meta = tmp_path / "meta.jsonl"
    lines = []
    for r in media(spark, str(library)).collect():
        known = {"SourceFile": r["path"], "FileModifyDate": "2024:07:19 09:00:00+01:00"}
        if r["name"] == "a b.JPG":
            known["DateTimeOriginal"] = "2024:07:20 10:00:00"
        if r["name"] != ".hidden.jpg":
            lines.append(json.dumps(known, ensure_ascii=False))
    meta.write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    out = lambda n: str(tmp_path / n)
    registry = steps.scan(spark, str(library), out("scan"), str(meta))
    assert registry.count() == 6 and spark.read.json(out("scan/errors")).count() == 1
    report = steps.summarize(spark, out("scan/registry"), out("summary"))
    assert report["total_files"] == 6 and report["duplicate_hash_group_count"] == 1 and report["extensions"][".jpg"] == 4
    events = steps.clusters(spark, out("scan/registry"), out("events"), array=True)
    assert events.count() >= 3 and len(json.load(open(out("events/events.json"), encoding="utf-8"))) == events.count()
    target = out("organized")
    made = steps.make_plan(spark, out("events/clustered"), out("plan"), target, array=True)
    plan_report = json.load(open(out("plan/plan_summary.json"), encoding="utf-8"))
    assert plan_report["total_files"] == 6 == sum(n for k, n in plan_report["result_counters"].items() if k.startswith("bucket_")) and plan_report["auto_cluster_count"] == 1
    assert [r["source_path"] for r in made.orderBy("seq").collect()] == [r["source_path"] for r in json.load(open(out("plan/plan.json"), encoding="utf-8"))]
    actions = {r["file_name"]: r["proposed_action"] for r in made.collect()}
    assert actions["a b.JPG"] == "auto" and actions["y copy.mp4"] == "general_duplicate"
    text = spark.read.text(out("plan/plan_csv"), wholetext=True).collect()
    assert any("True" in r["value"] or "False" in r["value"] for r in text)
    plan_path = out("plan/plan")
    dry = steps.apply_plan(spark, plan_path, out("dry"), Selection("low"))
    assert dry["result_counters"] == {"rows_total": 6, "rows_selected": 6, "dry_run_planned": 6} and not os.path.exists(target)
    assert steps.apply_plan(spark, plan_path, out("done"), Selection("low"), execute=True)["result_counters"]["copied"] == 6
    assert steps.apply_plan(spark, plan_path, out("again"), Selection("low"), execute=True)["result_counters"]["skipped_existing"] == 6
    sort = steps.simple_sort(spark, plan_path, out("sort"))
    assert sort["result_counters"]["skipped_existing"] == 6 and sort["result_counters"]["action_auto"] == 1
    assert files.read_plan(spark, plan_path).columns[-1] == "seq"
    with pytest.raises(FileNotFoundError):
        steps.apply_plan(spark, out("nothing"), out("x"), Selection())


def test_conflicts_and_renames(spark, tmp_path):
    from eventsort.plans.actions import perform

    (tmp_path / "s").mkdir()
    (tmp_path / "t").mkdir()
    for k, n in enumerate(("a", "b", "c")):
        (tmp_path / "s" / n).write_bytes(b"x" * (k + 1))
    (tmp_path / "t" / "f.jpg").write_bytes(b"yyyyyy")
    rows = [(str(tmp_path / "s" / n), str(tmp_path / "t" / "f.jpg"), k) for k, n in enumerate(("a", "b", "c"))] + [(str(tmp_path / "s" / "gone"), str(tmp_path / "t" / "g"), 9)]
    df = spark.createDataFrame(rows, "source string, target string, seq long")
    held = [r["outcome"] for r in perform(df, "copy", rename=False).orderBy("seq").collect()]
    assert held == ["skipped_conflict"] * 3 + ["source_missing"]
    promised = [r["final"].rsplit("/", 1)[1] for r in perform(df, "copy").orderBy("seq").collect()]
    assert promised == ["f__dup02.jpg", "f__dup03.jpg", "f__dup04.jpg", "g"]
    moved = perform(df, "move", execute=True)
    assert sorted(r["outcome"] for r in moved.collect()) == ["files_moved"] * 3 + ["source_missing"]
    assert sorted(os.listdir(tmp_path / "t")) == ["f.jpg", "f__dup02.jpg", "f__dup03.jpg", "f__dup04.jpg"]


def test_acting_again_does_no_harm(spark, tmp_path):
    """As when a task or a step is retried: on one decided table, twice."""
    from eventsort.plans.actions import act, decide

    for folder in ("s", "t"):
        (tmp_path / folder).mkdir()
    for k, n in enumerate(("a", "b", "c")):
        (tmp_path / "s" / n).write_bytes(b"x" * (k + 1))
    (tmp_path / "t" / "f.jpg").write_bytes(b"yyyyyy")
    (tmp_path / "t" / "f__dup03.jpg").write_bytes(b"zz")
    rows = spark.createDataFrame([(str(tmp_path / "s" / n), str(tmp_path / "t" / "f.jpg"), k) for k, n in enumerate(("a", "b", "c"))], "source string, target string, seq long")
    for kind, word in (("copy", "copied"), ("move", "files_moved")):
        decided = decide(rows, kind)
        for _ in range(2):
            done = act(decided, kind).orderBy("seq").collect()
            assert [r["outcome"] for r in done] == [word] * 3 and all(os.path.getsize(r["final"]) == r["seq"] + 1 for r in done)
    found = {n: os.path.getsize(tmp_path / "t" / n) for n in os.listdir(tmp_path / "t")}
    assert found == {"f.jpg": 6, "f__dup03.jpg": 2, "f__dup02.jpg": 1, "f__dup04.jpg": 2, "f__dup05.jpg": 3, "f__dup06.jpg": 1, "f__dup07.jpg": 2, "f__dup08.jpg": 3}
    assert os.listdir(tmp_path / "s") == []


def test_verifying_by_hash(spark, tmp_path):
    from eventsort.plans.actions import perform

    for n, data in (("a", b"one"), ("b", b"two"), ("ta", b"one"), ("tb", b"TWO")):
        (tmp_path / n).write_bytes(data)
    rows = spark.createDataFrame([(str(tmp_path / n), str(tmp_path / f"t{n}"), k) for k, n in enumerate("ab")], "source string, target string, seq long")
    found = lambda **k: [r["outcome"] for r in perform(rows, "copy", rename=False, **k).orderBy("seq").collect()]
    assert found() == ["skipped_existing"] * 2 and found(verify="hash") == ["skipped_existing", "skipped_conflict"]
    assert found(verify="hash", overwrite=True, execute=True) == ["copied"] * 2 and (tmp_path / "tb").read_bytes() == b"two"


def test_paths_with_a_scheme(spark, tmp_path):
    from eventsort.sources.listing import _remote

    (tmp_path / "d").mkdir()
    (tmp_path / "a.JPG").write_bytes(b"1")
    (tmp_path / "d" / "b.txt").write_bytes(b"22")
    url = f"file://{tmp_path}"
    assert files.need(spark, url, "folder") == url and listing(spark, url).count() == 2
    with pytest.raises(FileNotFoundError):
        files.need(spark, f"{url}/none", "folder")
    assert [(r["name"], r["size"]) for r in _remote(spark, url, extensions=".jpg").collect()] == [("a.JPG", 1)] and _remote(spark, url).count() == 2
    files.write_summary(spark, {"n": 1}, f"{url}/x/s.json")
    assert json.load(open(tmp_path / "x" / "s.json", encoding="utf-8")) == {"n": 1}


def test_reviews(spark, tmp_path):
    root = tmp_path / "_REVIEW"
    for folder, name in (("2024-07-19_event-0003_A", "x/a.jpg"), ("2024-07-19_event-0003_A", "y/a.jpg"), ("2024-07-21_event-0005_G", "b.jpg"), ("plain", "c.jpg"), ("trip_G", "d.jpg")):
        os.makedirs((root / folder / name).parent, exist_ok=True)
        (root / folder / name).write_bytes(name.encode())
    (root / "2024-07-19_event-0003_A" / "y" / "a.jpg").write_bytes(b"longer content")
    (root / "2024-07-20_event-0004_A" / "empty").mkdir(parents=True)
    events = tmp_path / "events.jsonl"
    events.write_text("".join(json.dumps({"cluster_id": f"event-000{k}", "cluster_no": k, "event_day": f"2024-07-{16 + k}", "day_sequence": 1}) + "\n" for k in (3, 4, 5)))
    go = lambda out, execute: steps.process_reviews(spark, str(root), str(events), str(tmp_path / out), str(tmp_path / "t"), str(tmp_path / "g"), execute)
    dry = go("dry", False)["result_counters"]
    assert dry["files_planned"] == 3 and dry["ignored_no_suffix"] == 1 and dry["ignored_no_cluster_id"] == 1 and dry["decision_A"] == 2 and not (tmp_path / "t").exists()
    done = go("done", True)["result_counters"]
    assert done["files_moved"] == 3 and done["decision_G"] == 1 and done["folder_cleanup_events"] >= 4
    assert sorted(os.listdir(tmp_path / "t" / "2024" / "07-19")) == ["a.jpg", "a__dup02.jpg"]
    assert sorted(os.listdir(root)) == ["plain", "trip_G"]


def test_stream_drops_repeated_content(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = {"file_path": "/a", "file_name": "IMG20240718120904.jpg", "extension": ".jpg", "hash_sha256": "h", "exif": {"created_at": None, "created_at_is_embedded": False}}
    (source / "1.json").write_text("\n".join(json.dumps(row | {"hash_sha256": h}) for h in ("h", "h", "g")))
    q = stream.new_files(stream.registry_stream(spark, str(source))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("seen")
    assert got.count() == 2 and {r["effective_timestamp_source"] for r in got.collect()} == {"FilenameDateTime"}


def test_flags():
    a = cli.parser().parse_args(["apply", "--plan", "p", "--out", "o", "--min-confidence", "low", "--cluster-id", "a", "--cluster-id", "b", "--execute"])
    assert a.execute and a.cluster_id == ["a", "b"] and a.min_confidence == "low" and not a.overwrite
