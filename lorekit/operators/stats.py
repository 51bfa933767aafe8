"""Counts over scans, checks and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_totals(files: DataFrame, parsed: DataFrame, elements: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """One row: listed files (parsed or not), lines, classes, functions with methods, imports, elements, graph sizes."""
    p = F.col("parsed")
    methods = F.aggregate(p["classes"], F.lit(0), lambda a, c: a + F.size(c["methods"]))
    own = parsed.agg(
        F.coalesce(F.sum("total_lines"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"),
        F.coalesce(F.sum(F.size(p["classes"])), F.lit(0)).alias("total_classes"),
        F.coalesce(F.sum(F.size(p["functions"]) + methods), F.lit(0)).alias("total_functions"),
        F.coalesce(F.sum(F.size(p["imports"])), F.lit(0)).alias("total_imports"),
    )
    parts = [files.agg(F.count(F.lit(1)).alias("total_files")), own, elements.agg(F.count(F.lit(1)).alias("total_elements"))]
    if graphs is not None:
        parts.append(graphs.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("graph_nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("graph_edges")))
    out = parts[0].withColumn("_k", F.lit(0))  # each part is one row
    for x in parts[1:]:
        out = out.join(x.withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def status_counts(checks: DataFrame, status: str = "status") -> DataFrame:
    return checks.agg(*[F.count_if(F.col(status) == s).alias(f"{s}_count") for s in ("ok", "warn", "fail")])


def key_sets(df: DataFrame, group: str, key: str, side: str, left: object, right: object) -> DataFrame:
    """(group, only_left, only_right, both, equal): distinct keys of two sides of each group, compared as sets.

    Keys are counted after a distinct, so each group costs its distinct keys, and the sets stay as numbers.
    """
    sides = df.where(F.col(side).isin(left, right)).groupBy(group, key).agg(F.bool_or(F.col(side) == left).alias("_l"), F.bool_or(F.col(side) == right).alias("_r"))
    out = sides.groupBy(group).agg(F.count_if(F.col("_l") & ~F.col("_r")).alias("only_left"), F.count_if(F.col("_r") & ~F.col("_l")).alias("only_right"), F.count_if(F.col("_l") & F.col("_r")).alias("both"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
