"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_bucket, spans_of, utf8_bytes
from .kernels import U64, Rolling, lower_ascii, mix, words

#: At most this many labelled documents are fitted on and broadcast: 3,000 vectors are under 1 MB.
SAMPLE = 3000
DIMENSIONS, NEIGHBOURS = 48, 25
_SHAPES, _WORDS, _RATES = 2048, 2048, 8
_RATE_WEIGHT = 6.0

# classes of bytes: letters fold to lower or upper, digits to 0, all else stays itself
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """n x D term counts, log-scaled, of whole texts: 4-grams of byte classes, words, and a few rates."""
    n = len(off) - 1
    out = np.zeros((n, _SHAPES + _WORDS + _RATES), np.float32)
    if len(raw) < 1:
        return out
    c = _CLASS[raw]
    doc = np.repeat(np.arange(n), np.diff(off))
    gram = c.copy()
    for i in range(1, 4):
        gram = gram * np.uint32(0x01000193)
        gram[:-i] ^= c[i:]
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(21)).astype(np.int64)
    inside = np.arange(len(raw)) + 3 < off[1:][doc]
    out[:, :_SHAPES] = np.bincount((doc * _SHAPES + bucket)[inside], minlength=n * _SHAPES).reshape(n, _SHAPES)
    low = lower_ascii(raw)
    s, e, first = words(low, off)
    count = np.diff(first)
    h = Rolling(low).hash(s, e) if len(s) else np.zeros(0, U64)
    wdoc = np.repeat(np.arange(n), count)
    out[:, _SHAPES : _SHAPES + _WORDS] = np.bincount(wdoc * _WORDS + (mix(h) >> U64(53)).astype(np.int64), minlength=n * _WORDS).reshape(n, _WORDS)
    np.log1p(out, out=out)
    chars, some = np.maximum(np.diff(off), 1), np.maximum(count, 1)
    order = np.lexsort((h, wdoc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
    distinct = np.bincount(wdoc[order][new], minlength=n)
    again = np.bincount(wdoc[1:][(h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])], minlength=n)
    share = lambda mask: np.bincount(doc[mask], minlength=n) / chars
    rates = [share(c == 65), share((c > 32) & (c < 48) & (c != 44) & (c != 46)), share(c == 48), share((c > 90) & (c < 97) | (c > 122)), again / some, 1 - distinct / some, np.minimum(chars / some, 20) / 20, share(c == 32)]
    out[:, _SHAPES + _WORDS :] = np.stack(rates, axis=1)
    return out


@dataclass
class QualityModel:
    idf: np.ndarray
    mean_rates: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = x * self.idf
        head = z[:, : -_RATES]
        head /= np.maximum(np.linalg.norm(head, axis=1, keepdims=True), 1e-9)
        z[:, -_RATES:] = (x[:, -_RATES:] - self.mean_rates) * _RATE_WEIGHT * (x[:, :-_RATES].any(axis=1, keepdims=True))
        v = z @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted vote of the nearest labelled vectors, by exact cosine with all of them, in blocks."""
        v, prior = self.embed(x), float(self.labels.mean())
        k, out = min(neighbours, len(self.labels)), np.empty(len(x))
        for lo in range(0, len(x), 512):
            near = v[lo : lo + 512] @ self.vectors.T
            top = np.argpartition(near, -k, axis=1)[:, -k:] if k < near.shape[1] else np.broadcast_to(np.arange(k), near.shape)
            w = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 4
            out[lo : lo + 512] = ((w * self.labels[top]).sum(axis=1) + 1e-6 * prior) / (w.sum(axis=1) + 1e-6)
        return np.clip(out, 0, 1)


def fit(texts: list[str], labels: list[int], dimensions: int = DIMENSIONS, seed: int = 5) -> QualityModel:
    """Latent-semantic space of the sample (a truncated singular value decomposition by random projection)."""
    col = pa.array([t or "" for t in texts], pa.large_string())
    raw, off = utf8_bytes(col)
    x = np.concatenate([features(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in spans_of(off)])
    df = (x > 0).sum(axis=0)
    idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 0.1
    idf[-_RATES:] = 1
    model = QualityModel(idf, x[:, -_RATES:].mean(axis=0), np.eye(x.shape[1], dtype=np.float32), np.zeros((1, 1)), np.asarray(labels, np.float64))
    z = x * idf
    z[:, :-_RATES] /= np.maximum(np.linalg.norm(z[:, :-_RATES], axis=1, keepdims=True), 1e-9)
    z[:, -_RATES:] = (x[:, -_RATES:] - model.mean_rates) * _RATE_WEIGHT
    rng = np.random.default_rng(seed)
    y = z @ rng.standard_normal((z.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = z @ (z.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ z, full_matrices=False)
    model.project = np.ascontiguousarray(vt[:dimensions].T.astype(np.float32))
    model.vectors = model.embed(x).astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``limit`` labelled documents outside the held-out bucket, drawn by hash of the id.

    Null labels and ids are left out. An id with several labels has the greatest, an id with several texts the
    least, so one text an id, ``limit`` in all, comes to the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (id_bucket(F.col("doc_id"), modulus) != held_out))
    some = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in rows], [r["label"] for r in rows]


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``docs`` with score double (0..1, higher: label 1 likelier); its own column of that name is replaced.

    Fitted on at most ``sample`` labelled documents whose crc32 bucket of 3 is not 1; only the text is an input.
    Each whole text is scored where it is read, without a shuffle. A null or empty text gets the sample's share
    of label 1; without any label every score is 0.5. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    texts, marks = labelled_sample(docs, labels, "quality", 3, 1, sample)
    model = spark.sparkContext.broadcast(fit(texts, marks) if texts else None)
    src = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            scores = np.full(batch.num_rows, 0.5)
            for i, j in spans_of(off):
                if m is not None:
                    scores[i:j] = m.score(features(raw[off[i] : off[j]], off[i : j + 1] - off[i]), neighbours)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return src.mapInArrow(run, StructType([*src.schema.fields, StructField("score", DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
    held = (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
