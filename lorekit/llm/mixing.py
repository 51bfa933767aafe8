"""Mixing sources to target weights by systematic sampling.

Targets: a total is shared over the sources by weight; a source's target stops at ``cap`` times its size and the
excess is shared again, which is a water level over cap/weight. Within a source every document is expected
target/size times; the running sum of these expectations plus one random offset for the source is cut at whole
numbers, and a document is emitted once for each whole number that its stretch crosses. Documents stand in order of
their size, so neighbours on the line are alike and the taken words stay near the target; of OFFSETS seeded random
offsets a source has the one whose words come nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Size classes per doubling, and pieces of each class by the hash of the key: no task ranks a whole source.
CLASSES, PIECES = 4, 64
#: Random offsets that a source chooses from.
OFFSETS = 16


def targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, source_size), one row per source, to the same with ``target``.

    Weights repeat along the sources in order of code points, null last. The windows without a key run over one row
    per source, after aggregation. Sources without words get 0. If the total exceeds all caps, every target is its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(cap))
    everyone = Window.partitionBy()
    by_level = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    filled = ranked.withColumns(
        {
            "_total": F.sum("source_size").over(everyone) * F.lit(share),
            "_full": F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "_k": F.row_number().over(by_level),
        }
    )
    level = (F.col("_total") - F.col("_full")) / F.col("_rest")
    fits = filled.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    water = fits.withColumn("_water", F.min_by("_level", F.when(F.col("_level").isNotNull(), F.col("_k"))).over(everyone))
    out = F.when(F.col("_level").isNotNull() | F.col("_water").isNull(), F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap")))).otherwise(F.col("_cap"))
    return water.select("source", "source_size", out.alias("target"))


def copies(df: DataFrame, key: str, size: Column, source: str = "source", seed: str = "mix", weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    Null sources form a source of their own, placed last. Null or empty texts have size 0; a source without words has
    target 0 and no copies. Equal rows are told apart only by their rank, so the result as a set of rows is the same
    on every run. Columns of these names in the input are replaced.
    """
    rows = df.withColumn("size", size.cast("long")).drop("source_size", "target", "copies")
    class_, piece, rank_ = common.fresh(rows, "_class", "_piece", "_rank")
    rows = rows.withColumn(class_, F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES).cast("int")).withColumn(piece, common.bucket(PIECES, F.coalesce(F.col(key).cast("string"), F.lit(""))))
    names = common.fresh(rows, "_source", "_c", "_p", "_before", "_offset")
    source_, c, p, before, offset = names
    pieces = rows.groupBy(F.col(source).alias(source_), F.col(class_).alias(c), F.col(piece).alias(p)).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    along = Window.partitionBy(source_).orderBy(c, p).rowsBetween(Window.unboundedPreceding, -1)
    level = targets(pieces.groupBy(F.col(source_).alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, cap)
    level = level.withColumnRenamed("source", "_s")
    placed = pieces.withColumn(before, F.coalesce(F.sum("_n").over(along), F.lit(0))).join(level, F.col(source_).eqNullSafe(F.col("_s")))
    placed = placed.select(source_, c, p, before, "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(source, class_, piece).orderBy("size", F.col(key).asc_nulls_last()))
    met = lambda some: some.withColumn(rank_, rank).join(placed, F.col(source).eqNullSafe(F.col(source_)) & (F.col(class_) == F.col(c)) & (F.col(piece) == F.col(p)), "left")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col(before) + F.col(rank_)
    taken = lambda u: F.floor(place * expected + u) - F.floor((place - 1) * expected + u)
    uniform = lambda k: common.uniform(F.lit(seed), F.coalesce(F.col(source), F.lit("")), F.lit(k))
    # The words that each offset would take, from sizes alone; then the nearest, the first on a tie.
    sums = met(rows.select(source, key, "size", class_, piece)).groupBy(F.col(source).alias("_s")).agg(F.first("target").alias("_t"), *[F.sum(taken(uniform(k)) * F.col("size")).alias(f"_{k}") for k in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("_t")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS)]))["k"]
    chosen = sums.select("_s", best.alias(offset))
    out = met(rows).join(chosen, F.col(source).eqNullSafe(F.col("_s")), "left")
    u = common.uniform(F.lit(seed), F.coalesce(F.col(source), F.lit("")), F.col(offset))
    return out.withColumn("copies", F.coalesce(taken(u), F.lit(0)).cast("int")).drop("_s", class_, piece, rank_, *names)


def mix(df: DataFrame, key: str, size: Column, **options) -> DataFrame:
    """The mixed rows themselves: each row as often as the mix takes it, with the columns of the input."""
    taken = copies(df, key, size, **options).where(F.col("copies") > 0)
    (copy,) = common.fresh(taken, "_copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*df.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document under weights 5, 2, 1, repeating. The texts are read once, for their sizes, and never shuffled."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    taken = copies(common.materialise(docs, "mix-sizes"), "doc_id", F.col("size"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, CASE WHEN (total - full_) / rest * w <= cap THEN (total - full_) / rest END AS lvl FROM f),
m AS (SELECT min_by(lvl, k) FILTER (lvl IS NOT NULL) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN lvl IS NOT NULL OR water IS NULL THEN least(cap, coalesce(water * w, cap)) ELSE cap END AS target FROM l, m),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(size + 1.0::DOUBLE) * 4),
  floor(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 64.0::DOUBLE), size, doc_id NULLS LAST) AS rk,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT DISTINCT source, target, k, ('0x' || substr(md5('mix:' || coalesce(source, '') || ':' || k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM r, (SELECT unnest(range(16)) AS k)),
z AS (SELECT r.source, u.k, u.u, abs(sum((floor(rk * e + u) - floor((rk - 1) * e + u))::BIGINT * size)::BIGINT - any_value(r.target)) AS off_ FROM r JOIN u ON r.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
b AS (SELECT source, u FROM z QUALIFY row_number() OVER (PARTITION BY source ORDER BY off_, k) = 1),
c AS (SELECT r.*, CAST(floor(rk * e + u) - floor((rk - 1) * e + u) AS INTEGER) AS copies FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM c
"""
