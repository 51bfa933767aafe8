"""Page trees: frontmatter, locale, slug and preview of every page, and the slugs that links may name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekit.functions import text as X
from lorekit.sources.tree import read_tree

# Top directories whose sub-directories are slugs of their own.
SECTIONS = ("start", "build", "api", "resources")


def with_frontmatter(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``frontmatter`` (map) and ``body``."""
    parts = X.frontmatter_parts(F.col(raw))
    return df.withColumn("_p", parts).withColumns({"frontmatter": X.frontmatter(F.col("_p.frontmatter")), "body": F.col("_p.body")}).drop("_p")


def pages(files: DataFrame, path: str = "relative_path", raw: str = "raw") -> DataFrame:
    """Page rows from (path, raw): slug, locale, title, description, method (upper case), path, operation id, preview."""
    df = with_frontmatter(files.select(F.col(path).alias("relative_path"), F.col(raw).alias("raw")))
    meta = lambda k: F.element_at("frontmatter", k)
    return df.select(
        "relative_path",
        X.slug(F.col("relative_path")).alias("slug"),
        X.locale(F.col("relative_path")).alias("locale"),
        meta("title").alias("title"),
        meta("description").alias("description"),
        F.upper(meta("method")).alias("method"),
        meta("path").alias("path"),
        meta("operationId").alias("operation_id"),
        F.substring("body", 1, 500).alias("body_preview"),
        "frontmatter",
        "body",
        "raw",
    )


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages below a content root."""
    files = read_tree(spark, root, extensions=("mdx",)).where(~F.col("is_dir") & F.col("content").isNotNull())
    return pages(files.withColumnRenamed("content", "raw"))


def valid_slugs(page_rows: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """(slug) of all pages, and of the directories right below a section; without a listing these are read off the paths."""
    section = rf"^(?:{'|'.join(SECTIONS)})/[^/]+"
    if directories is None:
        found = page_rows.select(F.regexp_extract("relative_path", rf"({section})/", 1).alias("slug")).where("slug <> ''")
    else:
        found = directories.where(F.col("relative_path").rlike(rf"{section}$")).select(F.col("relative_path").alias("slug"))
    return page_rows.select("slug").unionByName(found).distinct()


def english(page_rows: DataFrame) -> DataFrame:
    return page_rows.where(F.col("locale") == "en")


def documented_operations(page_rows: DataFrame) -> DataFrame:
    """(op_key, relative_path) of English pages with method and path; the last page of a key wins."""
    keyed = english(page_rows).where(F.col("method").isNotNull() & F.col("path").isNotNull())
    return keyed.groupBy(X.operation_key(F.col("method"), F.col("path")).alias("op_key")).agg(F.max("relative_path").alias("relative_path"))


def source_pages(page_rows: DataFrame, prefix: str, include: list[str], exclude: list[str]) -> DataFrame:
    """English pages that an include glob takes and no exclude glob does; all English pages if that leaves none."""
    full = F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("relative_path"))
    chosen = english(page_rows).where(X.matches_any(full, include) & ~X.matches_any(full, exclude))
    return english(page_rows) if chosen.isEmpty() else chosen
