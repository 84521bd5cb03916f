"""Copies and moves, in two steps: what happens to every row is decided and written
first, then it is done. Acting on a decided table again changes nothing, so a task
that is retried, or a whole step, does no harm: a copy appears under its name only
once it is whole, and a file that has already moved counts as moved."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.naming import name_destinations
from ..operators.select import existing
from ..scratch import new_path, write_table
from ..sources.content import sha256_of

# What outcomes are called, by kind of action: done, planned, failed, already there.
WORDS = {"copy": ("copied", "dry_run_planned", "copy_error", "skipped_existing"), "move": ("files_moved", "files_planned", "move_error", "files_skipped_existing")}


def _size(path: str) -> int | None:
    try:
        return os.path.getsize(path)
    except OSError:
        return None


def _probe(verify: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            found: list[tuple] = []
            for source, target in zip(frame["source"], frame["target"], strict=True):
                sizes = _size(source), _size(target)
                same = sizes[0] == sizes[1]
                if same and None not in sizes and verify == "hash":
                    try:
                        same = sha256_of(source) == sha256_of(target)
                    except OSError:
                        same = False
                found.append((os.path.exists(source), sizes[0], os.path.exists(target), sizes[1], same))
            here, source_size, there, target_size, alike = zip(*found, strict=True)
            yield frame.assign(source_exists=here, source_size=pd.array(source_size, "Int64"), target_exists=there, target_size=pd.array(target_size, "Int64"), alike=alike)

    return run


def probe(rows: DataFrame, verify: str = "size") -> DataFrame:
    """Adds source_exists, source_size, existing to rows (source, target, ...). ``verify``:
    whether a file of the same ``size`` is the same, or one that also has the same ``hash``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    probed = rows.mapInPandas(_probe(verify), f"{fields}, source_exists boolean, source_size bigint, target_exists boolean, target_size bigint, alike boolean")
    by_size = existing(F.col("source_size"), F.col("target_exists"), F.col("target_size"))
    state = F.when((by_size == "exists_same_size") & ~F.col("alike"), "exists_conflict").otherwise(by_size)
    return probed.withColumn("existing", state).drop("target_exists", "target_size", "alike")


def _names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for folder in frame["folder"]:
            if os.path.isdir(folder) and (names := sorted(os.listdir(folder))):
                yield pd.DataFrame({"folder": folder, "name": names})


def _split(path: str) -> tuple[Column, Column]:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)


def decide(rows: DataFrame, kind: str, overwrite: bool = False, rename: bool = True, verify: str = "size") -> DataFrame:
    """rows (source, target, seq, ...) with outcome and final, written. The outcome of a
    row that is to be acted on is that of a dry run. ``rename``: a taken place gives
    another name, in the order of seq, which must tell rows apart; else it is a conflict."""
    _, planned, _, skipped = WORDS[kind]
    spark = rows.sparkSession
    held = F.lit(not overwrite)
    probed = write_table(probe(rows, verify), new_path(spark, "probed"))
    conflict = F.lit(False) if rename else (F.col("existing") == "exists_conflict") & held
    outcome = F.when(~F.col("source_exists"), "source_missing").when((F.col("existing") == "exists_same_size") & held, skipped).when(conflict, "skipped_conflict").otherwise(planned)
    judged = probed.withColumn("outcome", outcome)
    if rename:
        # names that are on the disk come first, so they keep theirs
        folder, name = _split("target")
        wanted = judged.where(F.col("outcome") == planned).select(folder.alias("folder"), name.alias("name"), F.col("seq").cast("long").alias("seq"))
        taken = wanted.select("folder").distinct().mapInPandas(_names, "folder string, name string").select("folder", "name", (F.lit(-1) - F.monotonically_increasing_id()).alias("seq"))
        both = write_table(wanted.union(taken), new_path(spark, "names"))
        given = name_destinations(both, "seq", "folder", "name", "__final").where("seq >= 0").select(F.col("seq").alias("__seq"), "__final")
        judged = judged.join(given, F.col("seq") == F.col("__seq"), "left").drop("__seq")
    else:
        judged = judged.withColumn("__final", F.col("target"))
    final = F.when(F.col("outcome") == planned, F.col("__final")).otherwise(F.col("target"))
    return write_table(judged.withColumn("final", final).drop("__final", "source_exists", "existing"), new_path(spark, "decided"))


def _act(kind: str, overwrite: bool):
    done, planned, failed, _ = WORDS[kind]

    def copied(source: str, final: str, size: int) -> None:
        if overwrite or _size(final) != size:
            beside = f"{final}.{uuid.uuid4().hex}.part"
            try:
                shutil.copy2(source, beside)
                os.replace(beside, final)
            finally:
                if os.path.exists(beside):
                    os.remove(beside)

    def moved(source: str, final: str, size: int) -> None:
        if os.path.exists(source) or _size(final) != size:
            shutil.move(source, final)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            outcomes, details = frame["outcome"].tolist(), [None] * len(frame)
            for k, (source, final, size) in enumerate(zip(frame["source"], frame["final"], frame["source_size"], strict=True)):
                if outcomes[k] == planned:
                    try:
                        os.makedirs(os.path.dirname(final), exist_ok=True)
                        (copied if kind == "copy" else moved)(source, final, int(size))
                        outcomes[k] = done
                    except OSError as e:
                        outcomes[k], details[k] = failed, str(e)
            yield frame.assign(outcome=outcomes, detail=details).drop(columns="source_size")

    return run


def act(decided: DataFrame, kind: str, overwrite: bool = False) -> DataFrame:
    """Does what ``decide`` wrote: its rows with their outcomes and detail."""
    kept = [f for f in decided.schema if f.name != "source_size"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return decided.select(*[f.name for f in kept], "source_size").mapInPandas(_act(kind, overwrite), f"{fields}, detail string")


def perform(rows: DataFrame, kind: str, execute: bool = False, overwrite: bool = False, rename: bool = True, verify: str = "size") -> DataFrame:
    """rows (source, target, seq, ...) with outcome, final and detail: decided, and done if ``execute``."""
    decided = decide(rows, kind, overwrite, rename, verify)
    return act(decided, kind, overwrite) if execute else decided.drop("source_size").withColumn("detail", F.lit(None).cast("string"))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) that hold no file at any depth, deepest first."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = files.select(F.explode(above).alias("path")).distinct()
    depth = F.size(F.split("path", "/"))
    return folders.join(held, "path", "left_anti").withColumn("depth", depth).orderBy(F.col("depth").desc(), "path")


def remove_empty(root: str, execute: bool) -> list[str]:
    """Takes away empty folders bottom up, the root last; without ``execute`` names those that are empty now."""
    out = []
    for folder, _, _ in os.walk(root, topdown=False):
        if not os.listdir(folder):
            if execute:
                os.rmdir(folder)
            out.append(f"{'removed' if execute else 'dry_run_remove'}_empty_folder -> {folder}")
    return out
