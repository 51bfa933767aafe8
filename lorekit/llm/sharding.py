"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard gets a score ``-ln(u(key, shard)) / weight`` and the record goes to the smallest. A shard that is added
can only take records (its score is the only new one), and a shard that is removed gives only its own away. The
shard's name enters the hash, so its position in the list does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Slots are counted in this many pieces of each shard, so that no task sorts a whole shard.
PIECES = 1024


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """Shard (an int) of a key. A null key counts as the empty text."""
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("shards need positive weights")
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [
        F.struct((-F.log(common.uniform(key, F.lit(i)) + F.lit(2.0**-49)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
        for i, w in shards
    ]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def with_slots(df: DataFrame, shard: str = "shard", key: str = "doc_id", slot: str = "slot", apart: Sequence[str] = (), pieces: int = PIECES) -> DataFrame:
    """Number the rows of each shard without gaps from 0.

    Rows are ranked within (shard, piece), a piece being a hash of the key and of the columns ``apart``, which spread
    the rows of a frequent key; the pieces' offsets are a running sum over at most shards x pieces rows. They are joined
    on what the rows are dealt by already; Spark broadcasts them where they are below its threshold.
    """
    piece_, rank_, s_, p_, before_ = common.fresh(df, "_piece", "_rank", "_s", "_p", "_before")
    df = df.withColumn(piece_, common.bucket(pieces, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *apart)]))
    counts = df.groupBy(shard, piece_).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(piece_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias(s_), F.col(piece_).alias(p_), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(before_))
    rank = F.row_number().over(Window.partitionBy(shard, piece_).orderBy(F.col(key).asc_nulls_last(), *apart))
    ranked = df.withColumn(rank_, rank)
    return (
        ranked.join(offsets, (F.col(shard) == F.col(s_)) & (F.col(piece_) == F.col(p_)))
        .withColumn(slot, (F.col(before_) + F.col(rank_) - 1).cast("long"))
        .drop(s_, p_, before_, rank_, piece_)
    )


def assign(df: DataFrame, key: str, shards: Sequence[tuple[int, float]], grown: Sequence[tuple[int, float]] | None = None) -> DataFrame:
    """Add ``shard`` (and ``grown_shard`` under a larger list) to every row; other columns stay as they are.

    Null keys go where the empty text goes; equal keys go together; an empty table stays empty. Columns of the same
    names in the input are replaced.
    """
    out = df.withColumn("shard", rendezvous(F.col(key), shards))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown)) if grown else out


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard; each task writes to each shard at most once."""
    df.write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over shards 0 to 7 of equal weight, and over 0 to 8. Only digests of a text are shuffled."""
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    eight = [(i, 1.0) for i in range(8)]
    out = with_slots(assign(rows, "doc_id", eight, [*eight, (8, 1.0)]), apart=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP5_SQL = """
WITH poly AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, size, list_transform(range(9), lambda i: -ln(('0x' || substr(md5(k || ':' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE + pow(2.0, -49))) AS s,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, poly),
a AS (SELECT doc_id, k, size, text_crc32, list_position(s[1:8], list_min(s[1:8])) - 1 AS shard, list_position(s, list_min(s)) - 1 AS grown_shard FROM c)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY floor(('0x' || substr(md5(k || ':' || size || ':' || text_crc32), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 1024.0::DOUBLE), doc_id NULLS LAST, size, text_crc32) - 1 AS slot FROM a
"""
