"""Locales: pairing of pages, comparison of segments with the lock, comparison of structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekit.functions import text as X
from lorekit.functions.markdown import HEADING
from lorekit.operators.drift import issues
from lorekit.operators.spread import corpus
from lorekit.sources.pages import english


# The messages of issues below, which reports are compared by.


def pairs(sources: DataFrame, page_rows: DataFrame, targets: list[str]) -> DataFrame:
    """Each source page with each target locale: (relative_path, target, target_path, present)."""
    wanted = sources.select("relative_path", F.explode(F.lit(list(targets)).cast("array<string>")).alias("target")).withColumn("target_path", X.sibling(F.col("relative_path"), F.col("target")))
    have = page_rows.select(F.col("relative_path").alias("target_path"), F.lit(True).alias("_have"))
    return wanted.join(corpus(have), "target_path", "left").select("relative_path", "target", "target_path", F.coalesce("_have", F.lit(False)).alias("present"))


def orphans(page_rows: DataFrame, targets: list[str], source: str = "en") -> DataFrame:
    """Pages of a target locale whose source page does not exist."""
    own = page_rows.where((F.col("locale") != source) & F.col("locale").isin(*targets)).withColumn("_source", X.source_path(F.col("relative_path"), source))
    lone = own.join(corpus(page_rows.select(F.col("relative_path").alias("_source"))), "_source", "left_anti")
    return issues(lone, "locale_orphan", F.format_string("Orphan %s page with no EN source: %s", "locale", "relative_path"), F.col("relative_path"))


def lock_changes(segments: DataFrame, lock: DataFrame) -> DataFrame:
    """(relative_path, seg_key, change) with change one of added, removed, changed, same.

    Pages that the lock does not know have added segments only; pages that are gone from the corpus are not compared.
    """
    now = segments.select("relative_path", "seg_key", "hash")
    old = lock.join(corpus(segments.select("relative_path").distinct()), "relative_path", "left_semi").withColumnRenamed("hash", "_old")
    both = now.join(corpus(old), ["relative_path", "seg_key"], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("_old"), "changed").otherwise("same")
    return both.select("relative_path", "seg_key", change.alias("change"))


def stale_pages(segments: DataFrame, lock: DataFrame) -> DataFrame:
    """(relative_path) of pages in the lock of which a segment was added, removed or changed."""
    moved = lock_changes(segments, lock).groupBy("relative_path").agg(F.bool_or(F.col("change") != "same").alias("_stale")).where("_stale")
    return moved.join(corpus(lock.select("relative_path").distinct()), "relative_path", "left_semi").select("relative_path")


def pending(segments: DataFrame, lock: DataFrame, targets: list[str], force: bool = False) -> DataFrame:
    """(relative_path, target, seg_key, value) to translate: translatable segments that are new or changed, or all if forced."""
    todo = segments.where("translatable")
    if not force:
        moved = lock_changes(segments, lock).where(F.col("change").isin("added", "changed"))
        todo = todo.join(corpus(moved.select("relative_path", "seg_key")), ["relative_path", "seg_key"], "left_semi")
    return todo.select("relative_path", F.explode(F.lit(list(targets)).cast("array<string>")).alias("target"), "seg_key", "value")


def pending_counts(todo: DataFrame) -> DataFrame:
    return todo.groupBy("relative_path", "target").agg(F.count(F.lit(1)).alias("segments"))


def structure(page_rows: DataFrame) -> DataFrame:
    """(relative_path, headings, keys, links) of pages with ``frontmatter`` and ``blocks``."""
    links = F.array_sort(F.array_distinct(F.flatten(F.transform("blocks", lambda b: X.internal_links(b["content"])))))
    keys = F.array_sort(F.filter(F.map_keys("frontmatter"), lambda k: k.isin("title", "description")))
    return page_rows.select("relative_path", F.size(F.filter("blocks", lambda b: b["kind"] == HEADING)).alias("headings"), keys.alias("keys"), links.alias("links"))


def structure_issues(paired: DataFrame, shapes: DataFrame) -> DataFrame:
    """Issues of present pairs whose numbers of headings, frontmatter keys or link sets differ."""
    a = shapes.select("relative_path", F.struct("headings", "keys", "links").alias("a"))
    b = shapes.select(F.col("relative_path").alias("target_path"), F.struct("headings", "keys", "links").alias("b"))
    both = paired.where("present").join(corpus(a), "relative_path").join(corpus(b), "target_path")
    message = F.array_compact(
        F.array(
            F.when(F.col("a.headings") != F.col("b.headings"), F.concat(F.lit("Heading count mismatch EN="), F.col("a.headings").cast("string"), F.lit(" "), F.upper("target"), F.lit("="), F.col("b.headings").cast("string"), F.lit(" for "), F.col("relative_path"))),
            F.when(F.col("a.keys") != F.col("b.keys"), F.concat(F.lit("Frontmatter key mismatch for "), F.col("relative_path"))),
            F.when(F.col("a.links") != F.col("b.links"), F.concat(F.lit("Internal link set mismatch for "), F.col("relative_path"))),
        )
    )
    each = both.select("relative_path", F.explode(message).alias("_m"))
    return issues(each, "locale_structure", F.col("_m"), F.col("relative_path"))


def gaps(paired: DataFrame) -> DataFrame:
    return issues(paired.where("NOT present"), "locale_gap", F.format_string("Missing %s sibling for %s", "target", "relative_path"), F.col("relative_path"))


def stale_issues(paired: DataFrame, segments: DataFrame, lock: DataFrame) -> DataFrame:
    """An issue for each present pair whose source page is stale."""
    old = paired.where("present").join(corpus(stale_pages(segments, lock)), "relative_path", "left_semi")
    return issues(old, "locale_stale", F.concat(F.lit("EN segments changed since lock for "), F.col("relative_path")), F.col("relative_path"))


def sync_issues(page_rows: DataFrame, segments: DataFrame, lock: DataFrame, lock_exists: bool, targets: list[str], sources: DataFrame | None = None, shapes: DataFrame | None = None) -> list[DataFrame]:
    """Parts of the locale report: orphans, gaps, stale pages, structure, which is that of the pages unless ``shapes`` has it."""
    sources = english(page_rows) if sources is None else sources
    paired = pairs(sources, page_rows, targets)
    parts = [orphans(page_rows, targets), gaps(paired)]
    if lock_exists:
        parts.append(stale_issues(paired, segments, lock))
    return [*parts, structure_issues(paired, structure(page_rows) if shapes is None else shapes)]
