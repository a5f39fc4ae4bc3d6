"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, SPACE_CLASS, documents, materialize

_HASHED = "doc_id long, n_code_points long, content_hash binary, text_sha256 string"


def _hasher(with_text: bool, digest: Callable[[bytes], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            norm = [t.encode().translate(None, SPACE_BYTES) for t in texts]
            cols = {
                "doc_id": batch.column("doc_id"),
                "n_code_points": pa.array(map(len, texts), pa.int64()),
                "content_hash": pa.array(map(digest, norm), pa.binary()),
            }
            if with_text:
                cols["norm"] = pa.array(norm, pa.binary())
            else:
                cols["text_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in norm])
            yield pa.RecordBatch.from_pydict(cols)

    return run


#: A group is hot when it holds at least this part of all rows, so at most 1,000 groups are.
HOT_SHARE = 1000
#: Tasks that share a hot group's rows.
SALTS = 64


def exact_dedup(docs: DataFrame, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_code_points.

    Texts are equal when identical once white space is deleted. Of equal texts with an id the longest original (code
    points) stays, then the smallest doc_id. The 128-bit hash only proposes groups: members of groups of two
    or more are compared byte by byte with the row that would stay, and rows that differ (a collision) are
    grouped by their bytes themselves. Only those members' texts are kept in a table; the group's counts and
    best row are aggregated before the shuffle. The rows of hot groups (``HOT_SHARE``) are dealt over ``salts``
    keys by doc_id and their group's row is repeated for each, so no task reads a hot group whole.

    Null text counts as empty; empty texts equal each other. A row without doc_id forms part of its group but
    never stays before one with an id. Repeated rows count each; the first of equal ids stays once, its
    repeats are marked kept too (they carry the same id). Other columns of ``docs`` are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialize(src.mapInArrow(_hasher(False, digest), _HASHED))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "n_code_points", (-F.col("doc_id")).alias("neg_id"))).alias("best")
    groups = rows.groupBy("content_hash").agg(best, F.count("*").alias("n"))
    groups = materialize(groups.select("content_hash", (-F.col("best.neg_id")).alias("keep_id"), F.col("n").alias("group_size")))
    hot = groups.where((F.col("group_size") * HOT_SHARE >= rows.count()) & (F.col("group_size") >= salts)).select("content_hash", F.lit(True).alias("hot"))
    marked = lambda df: df.join(F.broadcast(hot), "content_hash", "left")

    def dealt(df: DataFrame) -> DataFrame:
        """Rows with a salt, 0 outside hot groups."""
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(0)
        return marked(df).withColumn("salt", salt.cast("int")).drop("hot")

    def repeated(df: DataFrame) -> DataFrame:
        """One row per group, or per group and text, for each salt; partitioned anew, or the salt would not count."""
        every = F.sequence(F.lit(0), F.when(F.col("hot"), salts - 1).otherwise(0))
        return marked(df).withColumn("salt", F.explode(every)).drop("hot").repartition("content_hash", "salt")

    several = groups.where("group_size > 1")

    texts = src.mapInArrow(_hasher(True, digest), "doc_id long, n_code_points long, content_hash binary, norm binary")
    members = materialize(dealt(texts).join(repeated(several), ["content_hash", "salt"]))
    stay = members.where("doc_id <=> keep_id").groupBy("content_hash").agg(F.min("norm").alias("keep_norm"))
    compared = members.join(repeated(stay), ["content_hash", "salt"]).select("content_hash", "doc_id", "n_code_points", "norm", (F.col("norm") == F.col("keep_norm")).alias("same"))
    odd = materialize(compared.where("NOT same").drop("same"))
    odd_groups = odd.groupBy("content_hash", "norm").agg(best, F.count("*").alias("n"))
    odd_groups = odd_groups.select("content_hash", F.sha2("norm", 256).alias("text_sha256"), (-F.col("best.neg_id")).alias("keep_id"), F.col("n").alias("group_size"))
    fewer = odd.groupBy("content_hash").agg(F.count("*").alias("n_odd"))

    right = groups.join(fewer, "content_hash", "left").select("content_hash", "keep_id", (F.col("group_size") - F.coalesce("n_odd", F.lit(0))).alias("group_size"))
    odd_groups = odd_groups.select("content_hash", "text_sha256", F.col("keep_id").alias("odd_keep"), F.col("group_size").alias("odd_size"))
    out = dealt(rows).join(repeated(right), ["content_hash", "salt"]).join(repeated(odd_groups), ["content_hash", "salt", "text_sha256"], "left")
    out = out.select(
        "doc_id",
        F.when(F.col("odd_size").isNull(), F.col("keep_id")).otherwise(F.col("odd_keep")).alias("keep_id"),
        F.coalesce("odd_size", "group_size").alias("group_size"),
        "text_sha256",
        "n_code_points",
    )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_code_points")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_code_points")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[{SPACE_CLASS}]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size FROM d GROUP BY norm
), k AS (
  SELECT norm, doc_id AS keep_id FROM (
    SELECT norm, doc_id, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS r FROM d) WHERE r = 1
)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm) JOIN k USING (norm)
"""
