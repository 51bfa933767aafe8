"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space only; every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words, without building them: runs of word characters, each shrunk to one character."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only. From md5, so that any SQL engine can repeat it."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def bucket(n: int, *parts: Column) -> Column:
    return F.floor(uniform(*parts) * F.lit(float(n))).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the frame has, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lorekit-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Tables that this session has written and not deleted: frame, path, name in the catalog.
_MADE: dict[int, tuple[DataFrame, str, str | None]] = {}


def materialise(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors.

    The write's own shuffle files go as soon as it is done; nothing reads them again. With ``bucket`` the table is
    bucketed by that column, so that joins on it move only their other side. ``discard`` deletes the table again, and
    ``made``, ``keep_only`` and ``clear`` all that an operator or the session has written.
    """
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lorekit/{unique}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    table_name = unique.replace("-", "_") if bucket is not None else None
    try:
        out = df.write.option("compression", "zstd")
        if bucket is None:
            out.parquet(path)
            read = spark.read.schema(df.schema).parquet(path)
        else:
            out.bucketBy(partitions(spark), bucket).option("path", path).saveAsTable(table_name, format="parquet")
            read = spark.table(table_name)
    finally:
        spark.conf.set(cleanup, before)
    _MADE[id(read)] = (read, path, table_name)
    return read


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads; other frames are left alone."""
    for df in tables:
        _, path, table_name = _MADE.pop(id(df), (None, None, None))
        if path is not None:
            spark = df.sparkSession
            if table_name:
                spark.sql(f"DROP TABLE IF EXISTS `{table_name}`")
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def made() -> set[int]:
    """The tables that there are, for ``keep_only``."""
    return set(_MADE)


def keep_only(since: set[int], *tables: DataFrame) -> None:
    """Delete what was written after ``since`` was taken, except these tables."""
    kept = since | {id(t) for t in tables}
    discard(*[df for i, (df, _, _) in list(_MADE.items()) if i not in kept])


def clear() -> None:
    """Delete every table that this session has written, once no result of an operator is read any more."""
    keep_only(set())


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that Python objects exist for few of them at a time."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_chunks(df: DataFrame, text: str, name: str, target_bytes: int = 8 << 20, least: int | None = None) -> DataFrame:
    """The rows with ``_chunk`` as a table bucketed by it: chunks of about ``target_bytes`` of text, ``least`` at least (or four to a bucket).

    Rows are dealt by their place in the input, so neither a hot key nor a text that many rows share fills a chunk. The
    texts are measured for it. Plans that group the table by chunk do not move it again.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = partitions(spark)
    n = max(least or 4 * buckets, -(-total // target_bytes))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    if n <= 4 * buckets <= 4096:  # few chunks: name them so that buckets get equally many
        places = [r[0] for r in spark.range(0, 16 * buckets + 4 * n, 1, 1).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets))).collect()]
        by_bucket: dict[int, list[int]] = {}
        for i, place in enumerate(places):
            by_bucket.setdefault(place, []).append(i)
        ids = [x for layer in zip(*[by_bucket[b][: -(-n // len(by_bucket))] for b in sorted(by_bucket) if len(by_bucket[b]) >= -(-n // len(by_bucket))], strict=True) for x in layer][:n]
        number = F.get(F.array(*[F.lit(x) for x in ids]), F.pmod(number, F.lit(len(ids))))
    dealt = df.withColumn("_chunk", number)
    return materialise(dealt.repartition(buckets, "_chunk"), name, bucket="_chunk")
