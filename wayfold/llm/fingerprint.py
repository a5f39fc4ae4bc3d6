"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, documents, shuffle_partitions

SHINGLE_WORDS = 5
#: One shingle hash in this many is retained.
SCALE = 2
#: Bytes of text that one range of documents holds, about.
RANGE_BYTES = 64 << 20
_SKETCH = "struct<hashes:array<bigint>,least:bigint>"


def sketch(text: Column, k: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """struct<hashes: sorted distinct 64-bit shingle hashes below 1/scale of their range, least>.

    Words are cut at ASCII white space, case kept; a text of fewer than k words is one shingle. Every shingle of
    the whole text is hashed and every hash under the threshold retained, and nothing else, so hashes of any two
    texts compare without bias and the union of two sketches' hashes is the sketch of the union. The standard error
    of a containment c is sqrt(c (1 - c) (scale - 1) / shingles): at c = 0.5 and scale 2 it is 0.16 for 10
    shingles, 0.05 for 100, 0.016 for 1,000. A text of n shingles has no hash under the threshold with probability
    (1 - 1/scale)**n; then ``least`` is the smallest of its hashes (else null), kept apart: it only tells whether
    two such texts are alike. Texts without words have neither.
    """
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _retained(hashed, k, scale)


def _retained(hashed: Column, k: int, scale: int) -> Column:
    # the hashes of all words are bound once, as a one-element array, so that the lambda below does not hash them anew
    def shingled(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.least(F.size(h), F.lit(1)))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))

    def kept(s: Column) -> Column:
        below = F.filter(s, lambda x: x < F.lit((1 << 64) // scale - (1 << 63)))
        return F.transform(F.array(below), lambda b: F.struct(F.array_sort(F.array_distinct(b)).alias("hashes"), F.when(F.size(b) == 0, F.array_min(s)).alias("least")))

    bound = F.transform(F.array(hashed), shingled)
    return F.get(F.get(F.transform(bound, kept), F.lit(0)), F.lit(0)).cast(_SKETCH)


def as_text(found: Column) -> Column:
    """A fingerprint as one string: its hashes in order, as 16 hexadecimal digits each; or "~" and the least."""
    hexes = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.coalesce(F.concat(F.lit("~"), hexes(found["least"])), F.array_join(F.transform(found["hashes"], hexes), ""))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a["hashes"], b["hashes"])).cast("double")


def _without(a: Column, b: Column) -> Column:
    """Likeness where a sketch retains no hash: 1 for two with equal ``least`` (or neither any word), else 0."""
    return F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0) & a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other holds."""
    smaller = F.least(F.size(a["hashes"]), F.size(b["hashes"]))
    return F.when(smaller == 0, _without(a, b)).otherwise(_shared(a, b) / smaller)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    union = F.size(a["hashes"]) + F.size(b["hashes"]) - _shared(a, b)
    return F.when(F.least(F.size(a["hashes"]), F.size(b["hashes"])) == 0, _without(a, b)).otherwise(_shared(a, b) / union)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together, from their sketches."""
    both = F.array_sort(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(both.alias("hashes"), F.when(F.size(both) == 0, F.least(a["least"], b["least"])).alias("least")).cast(_SKETCH)


def with_next(rows: DataFrame, order: list[str], take: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds next_<take>: its value in the following row by ``order``; after the last, the first row's.

    Rows are dealt by range of the first, numeric order column (null first), between its approximate quantiles;
    there are enough ranges that one holds about ``range_bytes`` of ``take``. The first row of each range is also
    dealt to the range before it (that of the first range to the last), behind all its rows; then the next row is
    always in the same range. Rows move once, and no task holds more than a few ranges.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length(take))).first()[0] or 0
    n = max(2 * shuffle_partitions(spark), -(-size // range_bytes))
    cuts = sorted(set(rows.approxQuantile(order[0], [i / n for i in range(1, n)], 0.1 / n)))
    part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    ranged = rows.withColumn("part", F.when(F.col(order[0]).isNull(), -1).otherwise(part))
    here = Window.partitionBy("part").orderBy(*order)
    firsts = ranged.select("part", *order).withColumn("nth", F.row_number().over(here)).where("nth = 1").drop("nth")
    chain = Window.orderBy("part")  # one row a range
    ahead = F.coalesce(F.lag("part").over(chain), F.last("part").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = firsts.withColumn("behind", F.lit(True)).withColumn("part", ahead)
    both = ranged.withColumn("behind", F.lit(False)).unionByName(guests, allowMissingColumns=True)
    following = F.lead(take).over(Window.partitionBy("part").orderBy("behind", *order))
    return both.withColumn(f"next_{take}", following).where("NOT behind").select(*rows.columns, f"next_{take}")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, text, sketch of each row. Null text is empty, rows without id and repeated rows are rows like others,
    an empty table gives no rows, other columns are ignored."""
    return _texts(docs).withColumn("sketch", sketch(F.col("text"), k, scale))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses by containment.

    Rows without id come first; ties of doc_id are ordered by text. The only document is its own next one. Only
    texts are moved, and their sketches made where they arrive.
    """
    src = with_next(_texts(documents(spark, sf_dir)), ["doc_id", "text"], "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    src = src.withColumn("edited", edited)
    for c in ("text", "edited", "next_text"):
        src = src.withColumn(f"s_{c}", sketch(F.col(c)))
    return src.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("s_text")).alias("fingerprint"),
        as_text(F.col("s_edited")).alias("edited_fingerprint"),
        containment(F.col("s_text"), F.col("s_edited")).alias("near_edited"),
        containment(F.col("s_text"), F.col("s_next_text")).alias("near_next"),
    )
