"""The steps from a folder of media to an ordered one. Each reads what the step
before wrote and writes its own."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, dedup, enrich, normalize, plan, review, select, summary
from ..operators.positions import positions
from ..scratch import new_path, write_table
from ..sources import content, files
from ..sources.listing import listing, media
from . import actions


def flat(registry: DataFrame) -> DataFrame:
    """Registry rows with the fields of exif and quality as columns."""
    return registry.select("*", "exif.created_at", "exif.created_at_source", "exif.created_at_is_embedded", "metadata_quality.has_gps", "metadata_quality.has_camera_metadata")


def scan(spark: SparkSession, root: str, out: str, metadata: str | None = None) -> DataFrame:
    """Lists, hashes and describes media files; files that fail go to ``out``/errors.

    ``seq`` grows along paths."""
    found = media(spark, root)
    hashed = content.hash_files(found).withColumnRenamed("error", "hash_error")
    described = (content.read_metadata(spark, metadata) if metadata else content.extract_metadata(found)).withColumnRenamed("error", "metadata_error")
    rows = found.join(hashed, "path").join(described, "path", "left")
    missing = F.when(F.col("metadata").isNull(), F.coalesce("metadata_error", F.lit("no metadata")))
    # written, so that each file is read once for both of what follows
    rows = write_table(rows.withColumn("error", F.coalesce("hash_error", missing)), new_path(spark, "scanned"))
    rows.where("error is not null").select("path", "error").write.mode("overwrite").json(os.path.join(out, "errors"))
    good = normalize.normalize(rows.where("error is null")).orderBy("path")
    extension = F.lower(F.regexp_extract("name", r"^.+(\.[^.]+)$", 1))
    record = good.select(F.col("path").alias("file_path"), F.col("name").alias("file_name"), extension.alias("extension"), F.col("size").alias("size_bytes"), "hash_sha256", "exif", "metadata_quality", "raw_exif_keys", F.monotonically_increasing_id().alias("seq"))
    path = os.path.join(out, "registry")
    files.write_lines(record, path)
    return files.read_registry(spark, path)


def _map(rows: DataFrame, key: str, value: str) -> dict:
    """A report's small counts."""
    return {r[key]: r[value] for r in rows.orderBy(key).collect()}


def summarize(spark: SparkSession, registry: str, out: str) -> dict:
    rows = flat(files.read_registry(spark, files.need(spark, registry, "registry")))
    files.write_lines(dedup.group_rows(rows), os.path.join(out, "duplicate_files"))
    groups = dedup.groups(rows)
    files.write_lines(groups, os.path.join(out, "duplicates"))
    return files.write_summary(
        spark,
        {
            "total_files": rows.count(),
            "extensions": _map(summary.by_extension(rows), "extension", "files"),
            "timestamp_sources": _map(summary.by_source(rows), "timestamp_source", "files"),
            "metadata_quality": {k: v for k, v in summary.quality(rows).first().asDict().items() if k != "total_files"},
            "dates": _map(summary.by_date(rows), "date", "files"),
            "duplicate_hash_group_count": groups.count(),
        },
        os.path.join(out, "summary.json"),
    )


def clusters(spark: SparkSession, registry: str, out: str, array: bool = False) -> DataFrame:
    """``array``: also writes events as one JSON array."""
    rows = cluster.assign(enrich.enrich(files.read_registry(spark, files.need(spark, registry, "registry"))))
    path = os.path.join(out, "clustered")
    rows.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    files.write_lines(stored.drop(enrich.TIME, "cluster_no", "day_sequence", "event_day", "file_order"), os.path.join(out, "enriched"))
    files.write_lines(cluster.file_rows(stored), os.path.join(out, "event_files"))
    files.write_lines(cluster.event_table(stored), os.path.join(out, "events"), order="cluster_no")
    events = files.read_events(spark, os.path.join(out, "events"))
    if array:
        files.write_array(events, os.path.join(out, "events.json"), "cluster_no")
    return events


def make_plan(spark: SparkSession, clustered: str, out: str, target: str, array: bool = False) -> DataFrame:
    """``array``: also writes the plan as one JSON array."""
    rows = spark.read.parquet(files.need(spark, clustered, "clustered registry"))
    made = plan.build(dedup.flag(rows), cluster.summarize(rows), target)
    path = os.path.join(out, "plan")
    files.write_lines(made, path, order="seq")
    stored = files.read_plan(spark, path)
    files.write_csv(stored.select(*plan.PLAN_COLUMNS, "seq").orderBy("seq").drop("seq"), os.path.join(out, "plan_csv"))
    if array:
        files.write_array(stored, os.path.join(out, "plan.json"), "seq")
    by_bucket = {r["proposed_bucket"]: r["clusters"] for r in summary.clusters_per_bucket(stored).collect()}
    counts = {"total_clusters": stored.select("cluster_id").distinct().count(), "total_files": stored.count(), "target_root": target, "result_counters": _map(summary.plan_counts(stored), "counter", "files")}
    files.write_summary(spark, counts | {f"{b}_cluster_count": by_bucket.get(b, 0) for b in ("auto", "review", "general")}, os.path.join(out, "plan_summary.json"))
    return stored


def _report(done: DataFrame, head: dict, out: str, *log: str) -> dict:
    path = os.path.join(out, "outcomes")
    done.write.mode("overwrite").parquet(path)
    spark = done.sparkSession
    done = spark.read.parquet(path)
    files.append_log(done, os.path.join(out, "log"), *log)
    counters = _map(summary.outcomes(done), "counter", "n")
    return files.write_summary(spark, {"generated_at_utc": files.now_utc()} | head | {"result_counters": head.get("result_counters", {}) | counters}, os.path.join(out, "summary.json"))


def apply_plan(spark: SparkSession, plan_path: str, out: str, by: select.Selection, execute: bool = False, verify: str = "size") -> dict:
    """Copies the chosen rows, or says what would be copied. ``verify``: see ``actions.probe``."""
    rows = files.read_plan(spark, files.need(spark, plan_path, "plan"))
    chosen = select.chosen(rows, by)
    work = chosen.withColumns({"source": F.col("source_path"), "target": F.col("proposed_destination")})
    done = actions.perform(work, "copy", execute, by.overwrite, rename=False, verify=verify)
    mix = summary.selection(chosen).collect()
    head = {
        "mode": "execute" if execute else "dry_run",
        "plan_path": plan_path,
        "filters": {"min_confidence": by.min_confidence, "only_auto_approved": by.only_auto_approved, "cluster_ids": sorted(by.cluster_ids), "overwrite": by.overwrite},
        "selected_file_count": sum(r["files"] for r in mix),
        "selected_cluster_count": chosen.select("cluster_id").distinct().count(),
        "selected_confidence_mix": {r["cluster_confidence"]: r["files"] for r in mix},
        "result_counters": {"rows_total": rows.count(), "rows_selected": sum(r["files"] for r in mix)},
    }
    files.write_lines(chosen.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("files")), os.path.join(out, "selected_clusters"))
    return _report(done, head, out, "outcome", "source", "final", "detail")


def simple_sort(spark: SparkSession, plan_path: str, out: str, execute: bool = False) -> dict:
    """Copies every row; a taken place gives another name."""
    rows = files.read_plan(spark, files.need(spark, plan_path, "plan"))
    work = rows.withColumns({"source": F.col("source_path"), "target": F.col("proposed_destination")})
    done = actions.perform(work, "copy", execute, rename=True)
    head = {"execute": execute, "plan_path": plan_path, "result_counters": _map(summary.plan_counts(rows), "counter", "files")}
    return _report(done, head, out, "proposed_bucket", "proposed_action", "source", "outcome", "final", "detail")


def process_reviews(spark: SparkSession, review_root: str, events: str, out: str, target_root: str, general_root: str, execute: bool = False) -> dict:
    """Moves the files of decided review folders, then takes empty folders away."""
    files.need(spark, review_root, "review folder")
    known = files.read_events(spark, files.need(spark, events, "events"))
    folders = listing(spark, review_root, depth="one", kind="dir").select(F.col("name").alias("folder_name"), F.col("path").alias("folder_path"))
    routed = review.route(folders, known, target_root, general_root)
    below = listing(spark, review_root).select("path", "name", F.split(F.substring("path", len(os.path.abspath(review_root)) + 2, 100_000), "/")[0].alias("folder_name"))
    decided = review.with_counts(routed, below).where("status = 'decided'")
    files.write_lines(decided, os.path.join(out, "decisions"), order="folder_name")
    work = below.join(decided.select("folder_name", "target_folder", "decision"), "folder_name").select(F.col("path").alias("source"), F.concat_ws("/", "target_folder", "name").alias("target"), "decision", "folder_name")
    work = positions(work, ["folder_name", "source"], "seq")
    ignored = _map(summary.outcomes(routed.where("status <> 'decided'"), "status"), "counter", "n")
    choices = decided.select("decision", "folder_path").collect()  # one row for each folder that a person has named
    counters = ignored | ({"decision_folders": len(choices)} if choices else {}) | {f"decision_{d}": sum(r["decision"] == d for r in choices) for d in sorted({r["decision"] for r in choices})}
    done = actions.perform(work, "move", execute, rename=True)
    path = os.path.join(out, "outcomes")
    done.write.mode("overwrite").parquet(path)
    cleaned = [line for r in choices for line in actions.remove_empty(r["folder_path"], execute)]
    done = spark.read.parquet(path)
    files.append_log(done, os.path.join(out, "log"), "decision", "source", "outcome", "final", "detail")
    counters |= _map(summary.outcomes(done), "counter", "n") | ({"folder_cleanup_events": len(cleaned)} if cleaned else {})
    return files.write_summary(spark, {"generated_at_utc": files.now_utc(), "execute": execute, "review_root": review_root, "general_root": general_root, "clusters_path": events, "result_counters": counters, "cleanup": cleaned}, os.path.join(out, "summary.json"))


def preview(rows: DataFrame, order: str, n: int = 10, columns: Sequence[str] = ()) -> DataFrame:
    """The first rows, by a top-n and not a sort."""
    return (rows.select(*columns) if columns else rows).orderBy(order).limit(n)
