"""Drift: set differences between operations, pages, SDK methods and links, as issues."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekit.functions import text as X
from lorekit.operators.spread import corpus
from lorekit.sources.pages import documented_operations, english

# Categories of issues.
CATEGORIES = ("missing_endpoint", "orphan_doc", "locale_gap", "locale_stale", "locale_structure", "locale_orphan", "sdk_unmentioned", "guide_dead_link")


# The messages of issues and the advice on them below, which reports are compared by.


def issues(df: DataFrame, category: str, message: Column, file: Column | None = None) -> DataFrame:
    return df.select(F.lit(category).alias("category"), message.alias("message"), (F.lit(None).cast("string") if file is None else file).alias("file"))


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left side whose key the right side does not have; null keys are missing too."""
    return left.join(corpus(right.select(key)), key, "left_anti")


def missing_endpoints(public: DataFrame, documented: DataFrame) -> DataFrame:
    return issues(missing(public, documented, "op_key"), "missing_endpoint", F.concat(F.lit("OpenAPI operation missing MDX: "), F.col("op_key")))


def orphan_docs(documented: DataFrame, public: DataFrame) -> DataFrame:
    text = F.concat(F.lit("MDX documents unknown or non-public OpenAPI operation: "), F.col("op_key"))
    return issues(missing(documented, public, "op_key"), "orphan_doc", text, F.col("relative_path"))


def locale_gaps(page_rows: DataFrame, target: str = "fr") -> DataFrame:
    """English pages without a sibling in the target locale."""
    have = page_rows.where(F.col("locale") == target).select(F.col("relative_path").alias("_sibling"))
    lone = english(page_rows).withColumn("_sibling", X.sibling(F.col("relative_path"), F.lit(target))).join(corpus(have), "_sibling", "left_anti")
    name = X.LANGUAGE_NAMES.get(target, target)
    return issues(lone, "locale_gap", F.concat(F.lit(f"Missing {name} sibling for "), F.col("relative_path")), F.col("relative_path"))


def unmentioned(methods: DataFrame, texts: DataFrame, text: str = "raw", prefix: str = "sdk") -> DataFrame:
    """Methods of which no text holds the name, the qualified name or the service's qualified name, as a substring.

    Texts look for all needles at once, and what is joined back is the set of needles found: texts are never paired with methods.
    """
    needles = methods.select(F.explode(F.array("method", "qualified", F.concat(F.lit(f"{prefix}."), F.col("service")))).alias("needle")).distinct()
    found = found_needles(texts, text, needles)
    each = methods.withColumn("_needle", F.explode(F.array("method", "qualified", F.concat(F.lit(f"{prefix}."), F.col("service")))))
    mentioned = each.join(corpus(found.withColumnRenamed("needle", "_needle")), "_needle", "left_semi").select("qualified").distinct()
    return methods.join(corpus(mentioned), "qualified", "left_anti")


#: Bytes of needles that one automaton holds; more are dealt over several passes.
NEEDLE_BYTES = 16 << 20


def found_needles(texts: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """(needle) of those that some text holds: texts are streamed through one automaton of all needles.

    The size of the needles is checked first: what goes to the workers at once has at most about NEEDLE_BYTES, more
    needles are dealt by hash over as many passes. Null needles are in no text, an empty one in every text.
    """
    each = needles.where("needle IS NOT NULL").select("needle").distinct()
    size = each.agg(F.sum(F.octet_length("needle") + 1)).first()[0] or 0
    n = -(-size // NEEDLE_BYTES)
    shards = [each if n == 1 else each.where(F.pmod(F.xxhash64("needle"), F.lit(n)) == i) for i in range(n)]
    passes = [_stream(texts.select(F.col(text).alias("text")), [r[0] for r in shard.toLocalIterator()]) for shard in shards]
    return reduce(DataFrame.unionByName, passes) if passes else each.limit(0)


@lru_cache(maxsize=1)
def _built(key: str) -> ahocorasick.Automaton:
    return ahocorasick.Automaton(ahocorasick.STORE_INTS)


def _automaton(key: str, needles: list[str]) -> ahocorasick.Automaton:
    """The automaton of a pass, built once by a Python worker for all of its tasks; that of the pass before goes."""
    automaton = _built(key)
    if automaton.kind != ahocorasick.AHOCORASICK:
        for i, needle in enumerate(needles):
            if needle:
                automaton.add_word(needle, i)
        automaton.make_automaton()
    return automaton


def _stream(texts: DataFrame, needles: list[str]) -> DataFrame:
    shared, key = texts.sparkSession.sparkContext.broadcast(needles), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        found = np.zeros(len(shared.value), bool)
        nothing = next((i for i, x in enumerate(shared.value) if not x), None)
        for b in batches:
            for t in b.column(0):
                if (value := t.as_py()) is not None:
                    if len(automaton):
                        found[[i for _, i in automaton.iter(value)]] = True
                    if nothing is not None:
                        found[nothing] = True
        yield pa.RecordBatch.from_arrays([pa.array([x for x, hit in zip(shared.value, found.tolist(), strict=True) if hit], pa.string())], names=["needle"])

    return texts.mapInArrow(run, "needle string").distinct()


def sdk_unmentioned(methods: DataFrame, page_rows: DataFrame, prefix: str = "sdk") -> DataFrame:
    return issues(unmentioned(methods, page_rows, "raw", prefix), "sdk_unmentioned", F.concat(F.lit("SDK method not mentioned in docs: "), F.col("qualified")))


def links(page_rows: DataFrame, text: str = "raw") -> DataFrame:
    """(relative_path, slug) of all internal links, repeats kept."""
    return page_rows.select("relative_path", F.explode(X.internal_links(F.col(text))).alias("slug"))


def dead_links(page_rows: DataFrame, slugs: DataFrame) -> DataFrame:
    gone = links(english(page_rows)).join(corpus(slugs), "slug", "left_anti")
    return issues(gone, "guide_dead_link", F.concat(F.lit("Dead internal link in "), F.col("relative_path"), F.lit(": /"), F.col("slug")), F.col("relative_path"))


def script_errors(output: DataFrame, text: str = "output") -> DataFrame:
    """An issue for each line of a check script's output that is not blank."""
    each = output.select(F.explode(X.lines(F.col(text))).alias("line")).where(F.regexp_like("line", F.lit(r"(?U)\S")))
    return issues(each, "ts_drift", F.col("line"))


def report(public: DataFrame, page_rows: DataFrame, slugs: DataFrame, methods: DataFrame | None = None, target: str = "fr", prefix: str = "sdk") -> DataFrame:
    """All drift issues with ``seq``, their place in the report: by kind of check, then file, then message."""
    documented = documented_operations(page_rows)
    parts = [missing_endpoints(public, documented), orphan_docs(documented, public), locale_gaps(page_rows, target)]
    if methods is not None:
        parts.append(sdk_unmentioned(methods, page_rows, prefix))
    return numbered([*parts, dead_links(page_rows, slugs)])


def numbered(parts: list[DataFrame], first: int = 0) -> DataFrame:
    """Union of issue lists with ``seq``, a value that sorts as the report does: by part, file (none first), message.

    It is a struct and no running number, so that no task has to see all issues; ``first`` is the number of the first part.
    """
    return reduce(DataFrame.unionByName, [p.withColumn("seq", F.struct(F.lit(first + i).alias("part"), F.col("file"), F.col("message"))) for i, p in enumerate(parts)])


def by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")


def category_summary(df: DataFrame) -> DataFrame:
    """One row: "category: n" by name, comma-joined."""
    return by_category(df).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.format_string("%s: %d", x["category"], x["n"])), ", ").alias("summary"))


def is_clean(df: DataFrame) -> bool:
    return df.isEmpty()


def next_step(category: Column, tool: str = "lorekit") -> Column:
    """Command or advice that deals with a category; null where there is none."""
    return (
        F.when(category == "missing_endpoint", f"{tool} scaffold")
        .when(category == "locale_gap", f"{tool} sync-i18n --scaffold-missing")
        .when(category == "locale_stale", f"{tool} sync-i18n lock")
        .when(category == "guide_dead_link", "Fix dead internal links in MDX")
    )


def next_steps(df: DataFrame) -> DataFrame:
    """(step) of the issues in the order in which they first appear."""
    steps = df.withColumn("step", next_step(F.col("category"))).where(F.col("step").isNotNull())
    return steps.groupBy("step").agg(F.min("seq").alias("seq")).orderBy("seq").select("step")


def locale_next_steps(df: DataFrame) -> DataFrame:
    """The same for locale issues, with advice on structure and orphans, by name."""
    more = F.when(F.col("category") == "locale_structure", "Manually align FR structure with EN source").when(F.col("category") == "locale_orphan", "Remove orphan FR pages or restore EN source")
    return df.select(F.explode(F.array(next_step(F.col("category")), more)).alias("step")).where("step IS NOT NULL").distinct().orderBy("step")
