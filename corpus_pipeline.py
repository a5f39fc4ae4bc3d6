"""A training corpus from raw documents: filter, deduplicate, mix and pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import documents, materialize, shuffle_partitions
from wayfold.llm.exact_dedup import exact_dedup
from wayfold.llm.minhash import near_dedup
from wayfold.llm.mixing import mix_sources
from wayfold.llm.packing import default_vocabulary, pack_documents
from wayfold.llm.quality import score_quality

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs.select(*_COLUMNS), labels).where("score >= 0.5").select(*_COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and row, a key that is unique and follows doc_id, null last.

    It is doc_id itself where ids are unique and none is null. Else rows are ordered by (doc_id, text) over ranges
    and numbered in a written table, so that each row, repeated or without id, is a document of its own.
    """
    docs = docs.select(*_COLUMNS)
    ids = docs.groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]
    ranged = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("row", F.monotonically_increasing_id()))


def _stay(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``decide`` keeps; it sees their numbers as doc_id. They grow with the input, so they are never
    broadcast."""
    rows = _numbered(docs)
    kept = decide(rows.select(F.col("row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("row")).hint("merge")
    return rows.join(kept, "row", "left_semi").select(*_COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whether its id is null or another row's too."""
    return _stay(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at 0.8; rows without words all stay."""
    return _stay(docs, near_dedup)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: dropped, once, or repeated."""
    rows = _numbered(docs)
    mixed = mix_sources(rows.select(F.col("row").alias("doc_id"), "text", "source"))
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("row"), "copies").hint("merge")
    out = rows.join(taken, "row")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    return pack_documents(docs, default_vocabulary())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: A fitted classifier and a tokenizer are not SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table. Rows without id and rows that share one go through like others; a null text
    counts as empty; an empty table gives no rows; columns other than those of documents are ignored."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
