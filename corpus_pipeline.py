"""Corpus pipeline: clean, deduplicate, redact, mix and encode the documents, one written stage after the other.

Edge cases: null and empty texts fail the quality rules; a null source is a source of its own; rows of equal
doc_id and text fall to one document in the second stage, other rows of equal or null doc_id do not; an empty table passes through all stages. Columns beyond those of
documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekit.llm import bpe, common, jaccard, mixing, quality, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: The stages run Python, windows and joins that no single statement can express.
ORACLE_SQL = None


def _recounted(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose their failing lines."""
    return _recounted(quality.keep(docs.select(*COLUMNS)))


def _identity() -> Column:
    """17 bytes that tell rows apart and sort by doc_id, null last: whether it is null, doc_id, hash of the text."""
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.concat(F.when(F.col("doc_id").isNull(), "01").otherwise("00"), part(number), part(F.xxhash64("text"))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that of the least doc_id, null ids last, and of equal
    ids that of the least hash of the text.

    Rows are told apart by doc_id and text, so only rows that agree in both are one document. Documents without words
    are no duplicates of each other and stay.
    """
    named = docs.withColumn("_row", _identity())
    found = jaccard.join(named.select("_row", "text"), key="_row", k=SHINGLE, percent=PERCENT)
    stays = found.where((F.col("n_shingles") == 0) | (F.col("_row") == F.col("component_id")))
    # Only keys travel until it is known which stay; then each text moves once, for the join and the order alike.
    kept = named.join(stays.select("_row").distinct(), "_row", "left_semi")
    order = Window.partitionBy("_row").orderBy("source", "lang")
    return kept.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder."""
    return _recounted(secrets.redact(docs, secrets.train(secrets.labelled_samples(spark, docs=docs))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; size is its number of words."""
    return mixing.mix(docs, "doc_id", common.word_count(F.col("text"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest that shows that they decode to its text."""
    vocabulary = bpe.default_vocabulary()
    coded = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), vocabulary)
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("quality rules", clean), ("n-gram Jaccard join", deduplicate), ("secret scans", redact), ("mixing sources", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again, so that a lost executor repeats one stage at most."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        since = common.made()
        after = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return after
        after = common.materialise(after, name.replace(" ", "-"))
        common.keep_only(since, after)  # what the stage wrote on its way
        common.discard(docs)
        docs = after
    return docs
