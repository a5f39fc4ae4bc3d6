"""The corpus pipeline, stage by stage, against a brute-force version of the whole."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wayfold.llm import quality
from wayfold.llm.packing import default_vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, score string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + int(x)) for x in r.integers(0, 26, int(r.integers(3, 9)))) for _ in range(300)]
    prose = lambda n: " ".join(words[int(i)] for i in r.integers(0, 300, n)) + "."
    junk = lambda n: "".join("!$#%@ 0123456789"[int(i)] for i in r.integers(0, 16, n))
    texts = [prose(int(r.integers(20, 150))) for _ in range(60)] + [junk(int(r.integers(100, 600))) for _ in range(30)]
    texts += texts[:6] + [t.replace(" ", "  \n") for t in texts[6:10]] + [f"{t} {words[0]}" for t in texts[10:20]] + [None, "", " \n", "one"]
    texts[30] = " ".join(texts[30:60]) * 2
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 4}", len(t or ""), i % 2 == 0, "x") for i, t in enumerate(texts)]
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, rows


def one_a_group(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(re.sub("[ \t-\r]", "", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]


def unlinked(rows, k=5):
    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(low)
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if before == low:
            break
    return [r for r in rows if low[r[0]] == r[0]]


def copies(rows):
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append(r[0])
    order = sorted(by, key=lambda s: (s is None, s))
    total, weight, most = sum(size.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 3.0 * sum(size[i] for i in by[s]) for s in order}
    full: set = set()
    while True:
        rest, open_ = total - sum(most[s] for s in full), [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most[s]}
        if not over:
            break
        full |= over
    target = {s: most[s] if s in full else share[s] for s in order}
    out: Counter = Counter()
    for s in order:
        u = int(hashlib.md5(f"17:{chr(0) + 'null' if s is None else s}".encode()).hexdigest()[:5], 16) / 2**20
        rate = target[s] / (most[s] / 3)
        for k, i in enumerate(sorted(by[s], key=lambda i: (size[i], i)), 1):
            out[i] = math.floor(k * rate + u) - math.floor((k - 1) * rate + u)
    return out


def test_pipeline_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    top, rows = folder
    seen = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality.fit([rows[i][1] or "" for i in seen], [int(i < 60) for i in seen])

    def score(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return model.score(quality.features(raw, np.array([0, len(raw)])))[0]

    want = [[r for r in rows if score(r[1]) >= 0.5]]
    assert {r[0] for r in want[0]} & set(range(90)) == set(range(60))  # clean documents stay, junk goes
    want.append(one_a_group(want[0]))
    want.append(unlinked(want[1]))
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2])
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:3], want, strict=False):
        docs = corpus_pipeline.materialize(stage(spark, docs, top))
        assert docs.columns == list(corpus_pipeline._COLUMNS)
        assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(repr(r[:5]) for r in kept), name
    docs = corpus_pipeline.materialize(corpus_pipeline.mix(spark, docs, top))
    times = +copies(want[2])
    assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == times
    tokens = Tokenizer.from_file(default_vocabulary())
    length = {r[0]: len(tokens.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    found, fill = Counter(), Counter()
    for r in sorted(corpus_pipeline.run(spark, top).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.doc_tokens == length[r.doc_id]
        fill[r.sequence_id] += r.length
        found[r.doc_id] += r.length
    assert found == Counter({i: n * length[i] for i, n in times.items()}) and max(fill.values()) <= 2048


def test_pipeline_of_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_of_their_own_go_through(spark, folder):
    texts = [f"words of text number {i} that no other text has in it" for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[4]), (None, texts[4] + " "), (3, texts[5]), (3, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    left = corpus_pipeline.exact(spark, docs, folder[0])
    assert sorted((r.doc_id or 0, r.text.strip()) for r in left.collect()) == sorted([(0, texts[0]), (0, texts[1]), (1, texts[2]), (1, texts[3]), (0, texts[4]), (3, texts[5])])
    left = corpus_pipeline.near(spark, corpus_pipeline.materialize(left), folder[0])
    assert left.count() == 6
    mixed = corpus_pipeline.mix(spark, corpus_pipeline.materialize(left), folder[0])
    assert sorted((r.doc_id or 0, r.text) for r in mixed.collect()) == sorted((r.doc_id or 0, r.text) for r in left.collect())


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3 + [(0, 1), (None, 1)], "doc_id long, quality int")
    texts, marks = quality.labelled_sample(docs, labels, "quality", 3, 1, 4)
    assert len(texts) <= 4 and texts == sorted(texts) and all(t in {f"text {i}" if i < 5 else "" for i in range(5)} for t in texts)
