"""Command line: scan, summarize, cluster, plan, apply, sort, review. Dry runs unless --execute is given."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from .operators.select import Selection
from .plans import steps
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventsort", description=__doc__)
    sub = p.add_subparsers(dest="step", required=True)

    def step(name: str, *needed: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for n in (*needed, "out"):
            s.add_argument(f"--{n}", required=True)
        return s

    step("scan", "root").add_argument("--metadata", help="JSON lines that an extractor wrote; without it the extractor runs")
    step("summarize", "registry")
    for x in (step("cluster", "registry"), step("plan", "clustered", "target")):
        x.add_argument("--json-array", action="store_true", help="also write one JSON array")
    a = step("apply", "plan")
    a.add_argument("--min-confidence", choices=("low", "medium", "high"), default="high")
    a.add_argument("--only-auto-approved", action="store_true")
    a.add_argument("--cluster-id", action="append", default=[])
    a.add_argument("--overwrite", action="store_true")
    a.add_argument("--verify", choices=("size", "hash"), default="size", help="what makes a file that is there the same")
    s = step("sort", "plan")
    r = step("review", "review-root", "general-root", "clusters", "target-root")
    for x in (a, s, r):
        x.add_argument("--execute", action="store_true")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    """Returns 1 if files could not be copied or moved."""
    a = parser().parse_args(argv)
    spark = session()
    done: dict = {}
    if a.step == "scan":
        steps.scan(spark, a.root, a.out, a.metadata)
    elif a.step == "summarize":
        done = steps.summarize(spark, a.registry, a.out)
    elif a.step == "cluster":
        steps.preview(steps.clusters(spark, a.registry, a.out, a.json_array), "cluster_no", columns=("cluster_no", "cluster_id", "event_day", "file_count", "cluster_confidence")).show(truncate=False)
    elif a.step == "plan":
        steps.preview(steps.make_plan(spark, a.clustered, a.out, a.target, a.json_array), "seq", columns=("seq", "proposed_action", "proposed_destination")).show(truncate=False)
    elif a.step == "apply":
        done = steps.apply_plan(spark, a.plan, a.out, Selection(a.min_confidence, a.only_auto_approved, tuple(a.cluster_id), a.overwrite), a.execute, a.verify)
    elif a.step == "sort":
        done = steps.simple_sort(spark, a.plan, a.out, a.execute)
    else:
        done = steps.process_reviews(spark, a.review_root, a.clusters, a.out, a.target_root, a.general_root, a.execute)
    if done:
        print(json.dumps(done, ensure_ascii=False, indent=2))
    counters = done.get("result_counters", {})
    return int(bool(counters.get("copy_error") or counters.get("move_error")))


if __name__ == "__main__":
    raise SystemExit(main())
