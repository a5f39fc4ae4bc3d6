"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, spans_of, utf8_bytes
from .graph import connected_components
from .kernels import U64, lower_ascii, mix, shingles, text_sum

#: 40 bands of 5 of 200 ranks: a pair at similarity 0.8 is missed with probability (1 - 0.8**5)**40 = 1e-7.
BANDS, ROWS = 40, 5
#: Ranks of 200 that must agree for a pair to be worth an early comparison; it decides nothing else.
LIKELY = 150
#: Documents of a bucket compared with each other at once.
BLOCK = 512


def superminhash(h: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signature values (level in the top byte, 56 random bits below) of sorted distinct element hashes.

    Element x walks one pseudo-random permutation of the m slots: at level j it offers j + r_j(x) to slot p_j(x),
    so ranks of one element are correlated (no slot twice), which lowers the variance. A text stops as soon as
    each of its slots holds a value of the levels done: later offers could not be smaller. Texts without
    elements keep all-ones.
    """
    top = U64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * m, top, U64)
    swaps: list[np.ndarray] = []
    for level in range(m):
        if not len(h):
            break
        bits = mix(h + U64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = bits >> U64(8)
        k = level + (mix(bits ^ U64(0x5851F42D4C957F2D)) >> U64(33)).astype(np.int64) % (m - level)
        slot = k
        for i in range(level - 1, -1, -1):
            slot = np.where(slot == swaps[i], i, slot)
        np.minimum.at(sig, doc * m + slot, r | U64(level << 56))
        open_docs = sig.reshape(n, m).max(axis=1) >= U64((level + 1) << 56) if level < 255 else np.zeros(n, bool)
        keep = open_docs[doc]
        h, doc, swaps = h[keep], doc[keep], [x[keep] for x in [*swaps, k]]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1).astype(U64)), parts.shape[:2]).copy()
    for i in range(rows):
        acc = mix(acc * U64(0xA24BAED4963EE407) ^ parts[:, :, i])
    return acc.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _signer(k: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            for i, j in spans_of(off):
                data, o, n = lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i], j - i
                h, doc = shingles(data, o, k)
                sig = superminhash(h, doc, n, bands * rows)
                keys = band_keys(sig, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, n),
                        pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                        pa.array(text_sum(mix(h), doc, n).view(np.int64)),
                        pa.array(text_sum(mix(h ^ U64(0x632BE59BD9B4E019)), doc, n).view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * bands, keys.reshape(-1)),
                        pa.array([x.tobytes() for x in (sig & U64(255)).astype(np.uint8)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return run


def _alike(least: int) -> Callable:
    """Keep pairs whose sketches agree in enough ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                a, b = (utf8_bytes(batch.column(c))[0].reshape(n, -1) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _brief(k: int) -> Callable:
    """(doc_id, text) -> doc_id, n_shingles, brief: the distinct top 16 bits of its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            for i, j in spans_of(off):
                h, doc = shingles(lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i], k)
                n = np.bincount(doc, minlength=j - i)
                short = (h >> U64(48)).astype(np.uint16)
                new = np.ones(len(h), bool)
                new[1:] = (short[1:] != short[:-1]) | (doc[1:] != doc[:-1])
                parts = np.split(short[new], np.cumsum(np.bincount(doc[new], minlength=j - i))[:-1])
                brief = pa.array([x.tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), brief], names=["doc_id", "n_shingles", "brief"])

    return run


def _block_pairs(per_cent: int) -> Callable:
    """Rows sorted by (key, i, j), a group being two blocks of a bucket -> pairs that may reach per_cent.

    Shared shingles of all pairs of two blocks are one matrix product of their 0/1 incidences. 16-bit values can
    only join shingles, so adding what either side lost bounds the true count from above: no link is missed.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch:
        doc, label, n, block = (rows.column(c).to_numpy() for c in ("doc_id", "label", "n_shingles", "block"))
        raw, off = utf8_bytes(rows.column("brief"))
        value, size = raw.view(np.uint16), np.diff(off) // 2
        row = np.repeat(np.arange(len(doc)), size)
        often = np.flatnonzero(np.bincount(value, minlength=1 << 16) > 1)
        place = np.full(1 << 16, -1)
        place[often] = np.arange(len(often))
        left, right = (np.flatnonzero(block == x) for x in (block.min(), block.max()))
        shared = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(often), 4096):
            at = place[value]
            here = (at >= lo) & (at < lo + 4096)
            grid = np.zeros((len(doc), min(4096, len(often) - lo)), np.float32)
            grid[row[here], at[here] - lo] = 1
            shared += grid[left] @ grid[right].T
        lost = n - size
        most = shared + np.minimum(lost[left][:, None], lost[right][None, :])
        fits = 100 * most >= per_cent * (n[left][:, None] + n[right][None, :] - most)
        fits &= (label[left][:, None] != label[right][None, :]) & (doc[left][:, None] != doc[right][None, :])
        a, b = np.nonzero(fits)
        u, v = np.maximum(doc[left][a], doc[right][b]), np.minimum(doc[left][a], doc[right][b])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)] if len(ids) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                group = tuple(ids[lo])
                if held and group != last:
                    yield compare(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = group
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    return run


def _across(rows: DataFrame, briefs: DataFrame, per_cent: int, block: int) -> DataFrame:
    """Rows (key, doc_id, label) -> distinct pairs (u, v) of a bucket, of different labels, that may be links.

    The most frequent label of a bucket is its major side: its rows need no comparison with each other, only with
    the others. Both sides are cut into blocks of about ``block`` documents, and each two blocks of which one is
    minor are compared in one place; no task holds more than two blocks, and pairs that are not links are never rows.
    A bucket of at most ``block`` rows is one block.
    """
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("major"), F.sum("n").alias("n"))
    cut = lambda n: F.ceil(n / block).cast("int")
    whole = F.col("n") <= block
    minors = F.when(whole, F.lit(1)).otherwise(cut(F.col("n") - F.col("major.n"))).alias("minors")
    majors = F.when(whole, F.lit(0)).otherwise(cut(F.col("major.n"))).alias("majors")
    sizes = sizes.select("key", F.when(~whole, F.col("major.label")).alias("major"), minors, majors)
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    is_major = F.col("label") == F.col("major")
    dealt = rows.join(sizes, "key").withColumn("block", F.when(is_major, F.col("minors") + place(F.col("majors"))).otherwise(place(F.col("minors"))))
    last = F.when(is_major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    each = each.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "label")
    full = each.join(briefs, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return full.mapInArrow(_block_pairs(per_cent), "u long, v long").distinct()


def _verifier(k: int, per_cent: int) -> Callable:
    """Keep pairs of texts with 100 * intersection >= per_cent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [utf8_bytes(batch.column(c)) for c in ("text_a", "text_b")]
            both = sides[0][1] + sides[1][1]
            for i, j in spans_of(both):
                n, found = j - i, []
                for raw, off in sides:
                    found.append(shingles(lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i], k))
                h, doc = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                twice = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                shared = np.bincount(doc[1:][twice], minlength=n)
                union = np.bincount(doc, minlength=n) - shared
                keep = (100 * shared >= per_cent * union) & (union > 0)
                yield batch.slice(i, n).select(["u", "v"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, per_cent: int) -> DataFrame:
    """pairs (u, v), distinct -> those that hold on full sets."""
    side = lambda c, name: texts.select(F.col("doc_id").alias(c), F.col("text").alias(name))
    full = pairs.join(side("u", "text_a"), "u").join(side("v", "text_b"), "v")
    return materialize(full.select("u", "v", "text_a", "text_b").mapInArrow(_verifier(k, per_cent), "u long, v long"))


def _similar(pairs: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """pairs (u, v), distinct -> those whose sketches agree in enough ranks."""
    side = lambda c, x: facts.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"sketch_{x}"))
    full = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "sketch_a", "sketch_b")
    return full.mapInArrow(_alike(least), "u long, v long")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels: key, doc_id, label. A document without label is its own."""
    out = members.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    mixed = out.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return out.join(mixed, "key")


def near_dedup(docs: DataFrame, shingle_words: int = 5, per_cent: int = 80, bands: int = BANDS, rows: int = ROWS, likely: int = LIKELY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; documents whose sets of ``shingle_words``-word
    shingles reach ``per_cent`` similarity are linked, and component_id is the smallest doc_id reachable.

    Equal sets collapse to their smallest id first (128-bit set hash). Every representative is compared with
    one leader, the smallest id it shares a band bucket with, then with a second, drawn anew for each bucket;
    so a group of near copies is linked through leaders, at a cost in proportion to its size. Last, in buckets
    that still hold several components, all pairs in different ones are bounded, block by block, from short
    hashes of their full sets, and those that may be links compared, so no link between groups is lost. Only
    documents outside a bucket's largest component are blocked against the rest. Nothing is capped.

    Null and empty texts have no shingles and link with nothing. Rows without doc_id are returned unlinked
    (component null, kept false). Repeated rows share one component. Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(src.mapInArrow(_signer(shingle_words, bands, rows), _SIGNED))
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = full.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    members = materialize(keyed.join(buckets.drop("last"), "key"))
    first = members.where("doc_id > leader").groupBy("doc_id").agg(F.min("leader").alias("v")).select(F.col("doc_id").alias("u"), "v")
    named = members.select("doc_id").distinct().hint("merge")  # grows with the input: never broadcast
    texts = materialize(src.join(named, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    links = _verified(materialize(first), texts, shingle_words, per_cent)

    # a second leader, another for each bucket, gathers near copies that are not like the first
    labelled = _labelled(members, links.select(F.col("u").alias("doc_id"), F.col("v").alias("label")))
    facts = reps.select("doc_id", "sketch")
    drawn = F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), "doc_id", "label")).alias("lead")
    leads = labelled.groupBy("key").agg(drawn).select("key", F.col("lead.doc_id").alias("lead"), F.col("lead.label").alias("lead_label"))
    star = labelled.join(leads, "key").where("label <> lead_label")
    star = star.select(F.greatest("doc_id", "lead").alias("u"), F.least("doc_id", "lead").alias("v"))
    star = materialize(_similar(star.distinct(), facts, likely))
    links = links.union(_verified(star, texts, shingle_words, per_cent))

    # then every pair of a bucket that is still in two components
    parts = connected_components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
    briefs = materialize(texts.mapInArrow(_brief(shingle_words), "doc_id long, n_shingles long, brief binary"))
    pairs = materialize(_across(_labelled(members, parts), briefs, per_cent, BLOCK))
    found = connected_components(links.union(_verified(pairs, texts, shingle_words, per_cent)))

    groups = sets.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(groups, ["set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), shingle_words=2)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
      ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""
