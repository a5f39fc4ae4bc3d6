"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, materialize, shuffle_partitions

#: Weights dealt to the sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its size, so no document more than this many copies.
MAX_REPEAT = 3
#: The random offset of a source is a multiple of 2**-20, so that adding it to a whole number is exact.
OFFSET_BITS = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00null"))).cast("binary")), 1, OFFSET_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << OFFSET_BITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n_docs) -> the same with target double.

    The targets share the sum of all sizes by weight; none exceeds max_repeat times its source's size, and what
    is above is shared again by weight. That fixed point is a water level: with sources by size over weight, the
    smallest k whose rest, shared over the others, stays under their limits. Windows here run over one row per
    source, never over documents.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (nth % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("rest") / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # capped rows come first in this order; the first row under its limit sets the level for all that follow
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level"))))
    s = s.withColumn("water", level.over(all_rows)["level"])
    return s.select("source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, and the ``keep`` columns.

    Within a source, documents stand in order of (size, doc_id); each is expected target / source_size times.
    One random offset is added to the prefix sums of these expectations, and a document is taken once for each
    whole number its interval crosses. Ordered by size, the taken words follow the target closely.

    The prefix sums are two-level: documents are dealt by range of (source, size, doc_id), each range counts its
    rows by source, and the counts of earlier ranges (ranges + sources rows) are added; no source, however
    large, meets in one task. Null text has size 0, a null source is a source of its own, and a source of size 0
    has target 0. Repeated rows are rows like others; ties of size and id fall in any order, with equal effect.
    An empty table gives no rows. Columns other than doc_id, text, source and ``keep`` are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    kept = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "source")]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), *(F.col(c).alias(f"keep {c}") for c in kept))
    ranged = src.repartitionByRange(n, F.col("source").asc_nulls_last(), "size", "doc_id").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged)  # ranges are sampled: a second run could cut elsewhere
    per_part = ranged.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    targets = source_targets(per_part.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs")), weights, max_repeat)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.col("source").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = starts.join(targets.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2").withColumnRenamed("part", "p")

    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id"))
    ranked = ranged.withColumn("rank", rank)
    out = ranked.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))
    place = F.col("rank") + F.col("before")
    copies = F.floor(place * rate + offset(F.col("source"), seed)) - F.floor((place - 1) * rate + offset(F.col("source"), seed))
    out = out.withColumn("copies", F.least(F.coalesce(copies, F.lit(0)), F.lit(max_repeat)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(F.col(f"keep {c}").alias(c) for c in kept))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE_CLASS}]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w FROM s
), g AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level FROM f
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM g WHERE level * w <= cap)) AS target,
    ('0x' || md5('17:' || coalesce(source, chr(0) || 'null'))[1:5])::INT / 1048576.0::DOUBLE AS u FROM g
), r AS (
  SELECT doc_id, size, source_size, target, u, target / source_size::DOUBLE AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * coalesce(floor(k * rate + u) - floor((k - 1) * rate + u), 0))::BIGINT AS taken FROM r
"""
