"""What is read out of files: content hashes and metadata. A file that fails is a
row with an error, and the run goes on."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are hashed at a time, and files that one extractor run gets.
CHUNK, BATCH = 1 << 20, 200


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found: list[tuple] = []
        for path in frame["path"]:
            try:
                found.append((path, sha256_of(path), None))
            except OSError as e:
                found.append((path, None, str(e)))
        yield pd.DataFrame(found, columns=["path", "hash_sha256", "error"])


def hash_files(files: DataFrame) -> DataFrame:
    """(path, hash_sha256, error). Files are read block by block, never whole."""
    return files.select("path").mapInPandas(_hashed, "path string, hash_sha256 string, error string")


def parse_metadata(text: str) -> list[dict[str, str | None]]:
    """The extractor's JSON array, values as text; nulls stay."""
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return [{k: plain(v) for k, v in record.items()} for record in json.loads(text or "[]")]


def extract_metadata(files: DataFrame, command: tuple[str, ...] = ("exiftool", "-j", "-n")) -> DataFrame:
    """(path, metadata, error) from an external extractor that is given many files at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = frame["path"].tolist()
            for k in range(0, len(paths), BATCH):
                some = paths[k : k + BATCH]
                try:
                    done = subprocess.run([*command, *some], capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
                    by = {r.get("SourceFile"): r for r in parse_metadata(done.stdout)}
                    failed = done.stderr.strip() or "the extractor gave nothing"
                except (OSError, ValueError) as e:
                    by, failed = {}, str(e)
                yield pd.DataFrame({"path": some, "metadata": [by.get(p) for p in some], "error": [None if p in by else failed for p in some]})

    return files.select("path").mapInPandas(run, "path string, metadata map<string,string>, error string")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata, error) from JSON lines that an extractor wrote before."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", "map<string,string>").alias("metadata"))
    return rows.select(F.try_element_at("metadata", F.lit("SourceFile")).alias("path"), "metadata", F.lit(None).cast("string").alias("error"))
