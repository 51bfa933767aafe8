"""Source trees as a Spark data source.

Spark's file sources pass over names that begin with ``_`` or ``.``, also where the path is given; the trees read here
hold such names (package markers, allowlists), so the listing is a data source of its own. Its partitions are the
entries of the root and of the directories below it, so a large tree is read by many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorekit.functions import text as X

SCHEMA = "root string, path string, relative_path string, extension string, size_bytes long, is_dir boolean, content string"


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.prune = options.get("prune", "false") == "true"
        self.extensions = {e for e in options.get("extensions", "").split(",") if e}

    def _enters(self, name: str) -> bool:
        return not self.prune or not (name.startswith(".") or name in X.IGNORED_DIRS)

    def partitions(self) -> list[InputPartition]:
        """One for each directory of the first two levels, without what lies in deeper ones of these levels."""
        if not os.path.isdir(self.root):
            return []
        out = [("", False)]
        for e in os.scandir(self.root):
            if e.is_dir(follow_symlinks=False) and self._enters(e.name):
                out.append((e.name, False))
                out += [(f"{e.name}/{x.name}", True) for x in os.scandir(e.path) if x.is_dir(follow_symlinks=False) and self._enters(x.name)]
        return [InputPartition(x) for x in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, deep = partition.value
        todo = [start]
        while todo:
            at = todo.pop()
            for e in sorted(os.scandir(os.path.join(self.root, at)), key=lambda e: e.name):
                relative = f"{at}/{e.name}" if at else e.name
                if e.is_dir(follow_symlinks=False):
                    if self._enters(e.name):
                        yield self.root, e.path, relative, "", 0, True, None
                        if deep:
                            todo.append(relative)
                elif e.is_file(follow_symlinks=False):
                    stem, dot, ext = e.name.rpartition(".")
                    ext = ext.lower() if dot and stem else ""
                    if self.extensions and ext not in self.extensions:
                        continue
                    with open(e.path, "rb") as f:
                        raw = f.read()
                    try:
                        content = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        content = None
                    yield self.root, e.path, relative, ext, len(raw), False, content


class TreeSource(DataSource):
    """``spark.read.format("tree")``: options path, prune (skip ignored and hidden directories), extensions (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, prune: bool = False, extensions: tuple[str, ...] = ()) -> DataFrame:
    """All entries below a root, directories included; content is null where it is no UTF-8. A missing root is empty."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(path=root, prune=str(prune).lower(), extensions=",".join(extensions)).load()


def source_files(files: DataFrame) -> DataFrame:
    """Of (path, relative_path, ..) the files whose extension maps to a ``language``, outside hidden and ignored directories."""
    named = files.withColumn("language", X.language(F.col("path")))
    return named.where(F.col("language").isNotNull() & ~X.in_ignored_dir(F.col("relative_path")))


def scan_sources(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Source files of several roots. Roots that are no directories are passed over; a root without source files is an error."""
    frames = []
    for root in roots:
        if os.path.isdir(root):
            files = source_files(read_tree(spark, root, prune=True).where("NOT is_dir"))
            if files.isEmpty():
                raise ValueError(f"no source files below {root}")
            frames.append(files.drop("is_dir"))
    if not frames:
        return read_tree(spark, "/nonexistent").drop("is_dir").withColumn("language", F.lit(None).cast("string"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def documents_of(files: DataFrame) -> DataFrame:
    """(provider, relative_path, title, size_bytes) of files: provider is the first directory, title the first heading."""
    return files.select(F.element_at(F.split("relative_path", "/"), 1).alias("provider"), "relative_path", X.first_title(F.col("content")).alias("title"), "size_bytes")


def competitors(spark: SparkSession, root: str) -> DataFrame:
    """Documents of other providers."""
    return documents_of(read_tree(spark, root, extensions=("md", "mdx", "txt")).where("NOT is_dir"))
