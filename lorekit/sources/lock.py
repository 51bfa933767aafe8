"""The lock: hashes of the source segments as of the last sync, as YAML on disk and as rows in Spark."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "relative_path string, seg_key string, hash string"


def read_lock(spark: SparkSession, path: str | Path) -> tuple[DataFrame, bool]:
    """Lock rows and whether the lock exists. YAML that can't be read counts as an empty lock; a path that ends in .parquet is a table."""
    file = Path(path)
    if str(path).endswith(".parquet"):
        there = file.is_dir() and any(file.iterdir())
        return (spark.read.schema(SCHEMA).parquet(str(path)) if there else spark.createDataFrame([], SCHEMA)), there
    files: dict = {}
    if file.is_file():
        try:
            raw = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
            files = raw.get("files") or {}
        except (yaml.YAMLError, AttributeError):
            files = {}
    rows = [(p, k, h) for p, segments in files.items() for k, h in (segments or {}).items()]
    return spark.createDataFrame(rows, SCHEMA), file.is_file()


def write_lock(segments: DataFrame, path: str | Path) -> int:
    """Replace the lock by the hashes of (relative_path, seg_key, hash); returns the number of pages.

    A YAML lock is a file that people review and commit, so the driver writes it; a path that ends in .parquet is a
    table that the executors write, for locks of any size.
    """
    if str(path).endswith(".parquet"):
        write_lock_table(segments, str(path))
        return segments.select("relative_path").distinct().count()
    files: dict[str, dict[str, str]] = {}
    for r in segments.select("relative_path", "seg_key", "hash").orderBy("relative_path", "seg_key").toLocalIterator():
        files.setdefault(r["relative_path"], {})[r["seg_key"]] = r["hash"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump({"version": 1, "files": files}, sort_keys=True, allow_unicode=True), encoding="utf-8")
    return len(files)


def write_lock_table(segments: DataFrame, path: str) -> None:
    segments.select("relative_path", "seg_key", "hash").write.mode("overwrite").parquet(path)
