"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_bucket, spans_of, utf8_bytes
from .kernels import NOT_WORD, U64, Rolling, lower_ascii, mix, words
from .quality import labelled_sample

#: At most this many labelled documents are trained on.
SAMPLE = 4000
#: Words in a window, and words from one window's start to the next: windows overlap by half, so any passage of up
#: to 16 words lies whole in one.
WINDOW, STRIDE = 32, 16
_WORDS, _GRAMS, _EMBED, _HIDDEN = 1 << 14, 1 << 12, 8, 8
_EPOCHS, _BLIND, _BATCH, _LEAST_STEPS, _RATE, _EMBED_RATE = 6, 48, 128, 300, 0.01, 1.0


@dataclass
class Words:
    """Distinct words of a run of texts, and all windows over them."""

    word: np.ndarray  # bucket of each distinct word
    gram: np.ndarray  # buckets of their character trigrams, word after word
    gram_at: np.ndarray  # first trigram of each
    index: np.ndarray  # windows x WINDOW of distinct-word numbers
    mask: np.ndarray  # windows x WINDOW, 0 where a short text has no word
    first: np.ndarray  # first window of each text, and their number


def read(raw: np.ndarray, off: np.ndarray) -> Words:
    """All windows of whole texts; the last of a text ends with it, a text under WINDOW words has one, padded."""
    low = lower_ascii(raw)
    s, e, first = words(low, off, NOT_WORD)
    h = Rolling(low).hash(s, e) if len(s) else np.zeros(0, U64)
    uniq, one, back = np.unique(h, return_index=True, return_inverse=True)
    us, ue = s[one], e[one]
    n = ue - us
    at = np.cumsum(n) - n
    pos = np.repeat(us - at, n) + np.arange(int(n.sum()))
    if len(pos):
        mid = low[pos].astype(np.uint32)
        head, tail = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
        head[at], tail[at + n - 1] = True, True
        prev = np.where(head, 0, low[pos - 1]).astype(np.uint32)
        nxt = np.where(tail, 0, low[np.minimum(pos + 1, len(low) - 1)]).astype(np.uint32)
        gram = (((prev << 16 | mid << 8 | nxt) * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    else:
        gram = np.zeros(0, np.int64)
    count = np.diff(first)
    windows = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)))
    w_first = np.concatenate([[0], np.cumsum(windows)])
    doc = np.repeat(np.arange(len(count)), windows)
    nth = np.arange(len(doc)) - w_first[doc]
    start = np.maximum(np.minimum(nth * STRIDE, count[doc] - WINDOW), 0)
    place = start[:, None] + np.arange(WINDOW)
    mask = (place < count[doc][:, None]).astype(np.float32)
    index = back[np.minimum(first[doc][:, None] + place, max(len(back) - 1, 0))] if len(back) else np.zeros((0, WINDOW), np.int64)
    return Words((uniq >> U64(50)).astype(np.int64), gram, at, index, mask, w_first)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    lowest: float = -8.0
    _m: dict = field(default_factory=dict)

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        d, h = 2 * _EMBED, _HIDDEN
        r = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": r(_WORDS, _EMBED, scale=0.1), "gram": r(_GRAMS, _EMBED, scale=0.1), "att": r(2 * h, h, scale=0.3), "vec": r(h, scale=0.3), "out": r(2 * h, scale=0.3), "b": np.zeros(1, np.float32)}
        for way in "fb":
            p |= {f"x{way}": r(d, 3 * h, scale=d**-0.5), f"h{way}": r(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        return Network(p)

    def embed(self, w: Words) -> np.ndarray:
        n = np.diff(np.append(w.gram_at, len(w.gram)))
        chars = np.add.reduceat(self.p["gram"][w.gram], w.gram_at, axis=0) / n[:, None] if len(n) else np.zeros((0, _EMBED))
        return np.concatenate([self.p["word"][w.word], chars.astype(np.float32)], axis=1)

    def states(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, way: str, keep: bool = False):
        """States of one direction, T x n x H; x: inputs of the distinct words. keep: also what training needs."""
        p, h = self.p, _HIDDEN
        proj = x @ p[f"x{way}"] + p[f"c{way}"]
        t_all = range(index.shape[1]) if way == "f" else range(index.shape[1] - 1, -1, -1)
        now = np.zeros((len(index), h), np.float32)
        out, saved = np.empty((index.shape[1], len(index), h), np.float32), {}
        for t in t_all:
            a, u = proj[index[:, t]], now @ p[f"h{way}"]
            gates = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h] * mask[:, t, None], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
            if keep:
                saved[t] = (now, gates[:, :h], r, new, u[:, 2 * h :])
            now = now + z * (new - now)
            out[t] = now
        return (out, saved) if keep else out

    def pool(self, both: np.ndarray, mask: np.ndarray):
        """Attention over T x n x 2H states -> logits, weights and the hidden layer of attention."""
        hid = np.tanh(both @ self.p["att"])
        e = hid @ self.p["vec"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        return pooled @ self.p["out"] + self.p["b"][0], a, hid, pooled

    def logits(self, w: Words) -> np.ndarray:
        x = self.embed(w)
        both = np.concatenate([self.states(x, w.index, w.mask, way) for way in "fb"], axis=2)
        return self.pool(both, w.mask)[0]

    def gradients(self, w: Words, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """The mean cross-entropy's gradients on a batch of windows of ``w``, by hand, back through time, and its value."""
        p, h = self.p, _HIDDEN
        used, flat = np.unique(index, return_inverse=True)
        index = flat.reshape(index.shape)
        n_gram = np.diff(np.append(w.gram_at, len(w.gram)))
        grams = np.concatenate([w.gram[w.gram_at[i] : w.gram_at[i] + n_gram[i]] for i in used])
        own = np.repeat(np.arange(len(used)), n_gram[used])
        x = self.embed(Words(w.word[used], grams, np.cumsum(n_gram[used]) - n_gram[used], index, mask, w.first))
        f, sf = self.states(x, index, mask, "f", True)
        b, sb = self.states(x, index, mask, "b", True)
        both = np.concatenate([f, b], axis=2)
        logit, a, hid, pooled = self.pool(both, mask)
        prob = _sigmoid(logit)
        g = {}
        d = ((prob - y) / len(y)).astype(np.float32)
        g["out"], g["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * p["out"]
        d_both = a[:, :, None] * d_pool
        d_a = np.einsum("nh,tnh->tn", d_pool, both)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["vec"] = np.einsum("tn,tnh->h", d_e, hid)
        d_hid = d_e[:, :, None] * p["vec"] * (1 - hid**2)
        g["att"] = np.einsum("tni,tnj->ij", both, d_hid)
        d_both = d_both + d_hid @ p["att"].T
        d_x = np.zeros_like(x)
        for way, saved, part in (("f", sf, d_both[:, :, :h]), ("b", sb, d_both[:, :, h:])):
            d_proj, g[f"h{way}"] = np.zeros((len(used), 3 * h), np.float32), np.zeros_like(p[f"h{way}"])
            carry = np.zeros((len(y), h), np.float32)
            for s in range(index.shape[1] - 1, -1, -1) if way == "f" else range(index.shape[1]):
                before, z, r, new, u = saved[s]
                m = mask[:, s, None]
                d_h = part[s] + carry
                d_new = d_h * z * m * (1 - new**2)
                d_z = d_h * (new - before) * m * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_proj, index[:, s], np.concatenate([d_z, d_r, d_new], axis=1))
                g[f"h{way}"] += before.T @ d_u
                carry = d_h * (1 - z * m) + d_u @ p[f"h{way}"].T
            g[f"x{way}"], g[f"c{way}"] = x.T @ d_proj, d_proj.sum(axis=0)
            d_x += d_proj @ p[f"x{way}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], w.word[used], d_x[:, :_EMBED])
        np.add.at(g["gram"], grams, (d_x[:, _EMBED:] / n_gram[used][:, None])[own])
        return g, float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9)))

    def step(self, w: Words, index: np.ndarray, mask: np.ndarray, y: np.ndarray, t: int) -> float:
        """One Adam step on a batch of windows of ``w``."""
        p = self.p
        g, loss = self.gradients(w, index, mask, y)
        for k, grad in g.items():
            m1, m2 = self._m.setdefault(k, (np.zeros_like(grad), np.zeros_like(grad)))
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad**2
            rate = _RATE * _EMBED_RATE if k in ("word", "gram") else _RATE
            p[k] -= (rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return loss

    def document_scores(self, w: Words) -> np.ndarray:
        """The calibrated score of each text's highest window; a text without words scores as the lowest seen."""
        best = np.full(len(w.first) - 1, self.lowest)
        if len(w.index):
            some = np.diff(w.first) > 0
            best[some] = np.maximum.reduceat(self.logits(w), w.first[:-1][some])
        return _sigmoid(self.slope * best + self.shift)


def _join(parts: list[Words]) -> Words:
    """Runs of texts as one; distinct words are kept by run."""
    n, g, wi = (np.cumsum([0] + [f(x) for x in parts]) for f in (lambda x: len(x.word), lambda x: len(x.gram), lambda x: len(x.index)))
    cat = lambda f: np.concatenate([f(x, k) for k, x in enumerate(parts)])
    return Words(cat(lambda x, _: x.word), cat(lambda x, _: x.gram), cat(lambda x, k: x.gram_at + g[k]), cat(lambda x, k: x.index + n[k]), cat(lambda x, _: x.mask), np.append(cat(lambda x, k: x.first[:-1] + wi[k]), wi[-1]))


def train(texts: list[str], labels: list[int], seed: int = 3) -> Network:
    """Multiple-instance training: a document's label falls on its most telling window.

    At first that is a window drawn at random, anew each epoch, mostly of documents with few windows; after _BLIND
    steps it is the network's own highest. Other windows of clean documents are drawn at random. A logistic curve
    over the highest logits of all documents then calibrates the score.
    """
    net = Network.fresh(rng := np.random.default_rng(seed))
    y = np.asarray(labels, np.float32)
    net.slope, net.shift = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(y) or y.min() == y.max():
        return net
    raw, off = utf8_bytes(pa.array(texts, pa.large_string()))
    w = _join(parts := [read(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in spans_of(off)])
    doc = np.repeat(np.arange(len(y)), np.diff(w.first))
    if not (y[doc] > 0).any() or not (y[doc] == 0).any():  # one label has no words at all
        return net
    step = epoch = 0
    while epoch < _EPOCHS or step < _LEAST_STEPS:
        blind = step < _BLIND
        score = rng.random(len(doc)) if blind else np.concatenate([net.logits(x) for x in parts])
        order = np.lexsort((score, doc))
        top = order[np.append(doc[order][1:] != doc[order][:-1], True)]
        clean = np.flatnonzero(y[doc] == 0)
        hard = clean[np.argsort(-score[clean])[: len(y) // 4]]
        toxic = top[y[doc[top]] > 0]
        many = max(1, int((y == 0).sum() / max(1, y.sum()) / 3))
        if blind:  # the fewer windows a document has, the likelier a random one is what its label means
            share = 1 / np.diff(w.first)[doc[toxic]]
            toxic = rng.choice(toxic, many * len(toxic), p=share / share.sum())
        else:
            toxic = np.repeat(toxic, many)
        picked = np.concatenate([toxic, top[y[doc[top]] == 0], rng.choice(clean, min(len(clean), len(y) // 2), replace=False), hard])
        rng.shuffle(picked)
        for lo in range(0, len(picked), _BATCH):
            rows = picked[lo : lo + _BATCH]
            step += 1
            net.step(w, w.index[rows], w.mask[rows], y[doc[rows]], step)
        epoch += 1
    best = np.full(len(y), np.nan)
    logit = np.concatenate([net.logits(x) for x in parts])
    some = np.diff(w.first) > 0
    best[some] = np.maximum.reduceat(logit, w.first[:-1][some])
    net.lowest = float(np.nanmin(best))
    x, target = np.clip(best[some], -15, 15), y[some]
    a, c = 1.0, 0.0
    for _ in range(200):  # Newton steps of a ridge-penalised logistic curve
        q = _sigmoid(a * x + c)
        v = q * (1 - q) + 1e-6
        ga, gc = ((q - target) * x).sum() + 0.01 * a, (q - target).sum()
        haa, hac, hcc = (v * x * x).sum() + 0.01, (v * x).sum(), v.sum()
        det = haa * hcc - hac * hac
        a, c = a - 0.5 * (hcc * ga - hac * gc) / det, c - 0.5 * (haa * gc - hac * ga) / det
    net.slope, net.shift = float(a), float(c)
    net._m = {}
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text) rows -> doc_id, score double: how likely ``labels.toxic`` is 1.

    Trained on at most ``sample`` labelled documents whose crc32 bucket of 4 is not 2. Only the text is an input:
    words (cut at all but letters and digits, lower-cased) and their characters. Every overlapping window of each
    whole text is scored where it is read, and the highest counts. Null and empty texts score as the lowest seen
    in training. With one label only, or none, all score that label's smoothed share. Repeated rows score equal;
    other columns are ignored.
    """
    spark = docs.sparkSession
    texts, marks = labelled_sample(docs, labels, "toxic", 4, 2, sample)
    model = spark.sparkContext.broadcast(train(texts, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            scores = np.empty(batch.num_rows)
            for i, j in spans_of(off):
                scores[i:j] = net.document_scores(read(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
