"""Corpus operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from wayfold.llm import chat, exact_dedup, fingerprint, minhash, mixing, packing, pii, quality, substring, suffixes, toxicity

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "é😀 " * 40), (7, "a " * 3000), (8, "One  TWO three four five six"), (9, "one two three four five six")]
SCHEMA = "doc_id long, text string, source string, score double, label int"


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + int(x)) for x in r.integers(0, 6, int(r.integers(1, 6))))
    texts = [" ".join(word() for _ in range(int(r.integers(5, 120)))) for _ in range(40)]
    near = [t.replace("a", "b", 1) for t in texts[:10]]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate([*texts, *near, *texts[:5], texts[0] * 3]))]
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else f"s{i % 3}", 0.0, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def shingles(text: str | None, k: int) -> frozenset:
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs, k).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


@pytest.mark.parametrize("block", [2, 7, 512])
def test_blocks_lose_no_pair(spark, docs, rows, block):
    member = [(key, i, 100 if i % (2 + key) else i) for key in range(3) for i, t in rows if shingles(t, 2)]
    briefs = docs.select("doc_id", "text").mapInArrow(minhash._brief(2), "doc_id long, n_shingles long, brief binary")
    found = minhash._across(spark.createDataFrame(member, "key long, doc_id long, label long"), briefs, 80, block).collect()
    got, sets = {(r.u, r.v) for r in found}, {i: shingles(t, 2) for i, t in rows}
    alike = lambda a, b, least: 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    want = {(u, v) for k, u, x in member for j, v, y in member if k == j and u > v and x != y and alike(u, v, 80)}
    assert want and want <= got and len(got) == len(found) and all(alike(u, v, 79) for u, v in got)


def test_exact_dedup_survives_hash_collisions(docs, rows):
    norm = {i: b"".join((t or "").encode().split()) for i, t in rows}
    groups: dict[bytes, list[int]] = {}
    for i, t in rows:
        groups.setdefault(norm[i], []).append(i)
    text = dict(rows)
    want = {i: (min(g, key=lambda x: (-len(text[x] or ""), x)), len(g), hashlib.sha256(norm[i]).hexdigest()) for g in groups.values() for i in g}
    for digest in (lambda b: hashlib.md5(b).digest(), lambda b: bytes([len(b) % 2]) * 16):
        for salts in (2, 64):
            got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs, digest, salts).collect()}
            assert got == want


def test_mixing_meets_targets(docs):
    out = mixing.mix_sources(docs).collect()
    by: dict = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(g[0].target for g in by.values()) - sum(r.size for r in out)) < 1e-6
    for g in by.values():
        assert g[0].target <= 3 * g[0].source_size
        assert abs(sum(r.taken for r in g) - g[0].target) <= 2 * max(r.size for r in g)


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack_documents(docs, packing.default_vocabulary(), with_ids=True).collect()
    ids: dict[int, list[int]] = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(ids.setdefault(r.doc_id, []))
        ids[r.doc_id] += r.ids
    assert ids == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    fill: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())


def plain_sketch(text, k=5, scale=2):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [xxhash.xxh64(w, seed=42).intdigest() for w in (text or "").encode().split()]
    out = set()
    for i in range(max(1, len(words) - k + 1)) if words else ():
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64(w.to_bytes(8, "little"), seed=h).intdigest()
        out.add(signed(h))
    held = sorted(x for x in out if x < (1 << 64) // scale - (1 << 63))
    return held, min(out) if out and not held else None


def test_fingerprints_equal_brute_force(spark, rows, tmp_path):
    more = [*rows, (9, "one two three four five six"), (8, None), (500, "last of all")]
    order = sorted((i, t or "") for i, t in more)
    spark.createDataFrame([(i, t, 0) for i, t in more], "doc_id long, text string, part int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def like(a, b):
        if not a[0] or not b[0]:
            return float(a == b)
        return len(set(a[0]) & set(b[0])) / min(len(a[0]), len(b[0]))

    string = lambda s: f"~{s[1] % (1 << 64):016X}" if s[1] is not None else "".join(f"{x % (1 << 64):016X}" for x in s[0])
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other, nxt = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), string(own), string(other), like(own, other), like(own, nxt)))
    assert sorted(map(tuple, fingerprint.op4_fingerprint(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_fingerprints_of_tiny_tables(spark, n):
    src = spark.createDataFrame([(None if i else 1, "x y") for i in range(n)], "doc_id long, text string")
    assert [r.next_text for r in fingerprint.with_next(src, ["doc_id", "text"], "text").collect()] == ["x y"] * n
    assert fingerprint.fingerprints(src).count() == n


def test_sketches_merge_and_contain(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(7)
    text = " ".join(f"w{int(x)}" for x in r.integers(0, 10**6, 400))
    parts = [" ".join(text.split()[i : i + 60]) for i in range(0, 340, 20)]
    df = fingerprint.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate([text, *parts])], "doc_id long, text string"))
    whole = df.where("doc_id = 0").select(F.col("sketch").alias("all"))
    got = df.crossJoin(whole).select(fingerprint.containment(F.col("sketch"), F.col("all")).alias("c"), fingerprint.merged(F.col("sketch"), F.col("all")).eqNullSafe(F.col("all")).alias("same")).collect()
    assert all(x.c == 1.0 and x.same for x in got)


def without_repeats(rows, length=100):
    """(n_bytes, n_removed, n_spans, kept) of each (key, text), in order of the keys."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if (s := b[p : p + length]) in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("bucket", "hot"), [(2048, 40), (16, 2), (3, 2)])
def test_repeated_strings(spark, docs, rows, bucket, hot):
    # passages inside other text, shorter and longer than a window, so that anchors have many surroundings
    r = np.random.default_rng(4)
    noise = lambda n: "".join(chr(97 + int(x)) for x in r.integers(0, 26, n))
    line, passage = noise(70), noise(160)
    more = [(1000 + i, f"{noise(int(r.integers(0, 90)))} {line if i % 3 else passage} {noise(int(r.integers(0, 90)))}") for i in range(60)]
    both = spark.createDataFrame([*rows, *more], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring.remove_repeats(both, bucket=bucket, hot=hot).collect()}
    want = without_repeats([*rows, *more])
    assert got == want and sum(x[1] for i, x in want.items() if i >= 1000) > 2000


def test_repeated_strings_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in without_repeats(rows).items()}
    assert {r.doc_id: tuple(r)[1:] for r in substring.op9_suffix_dedup(spark, sf).collect()} == want


def test_repeated_strings_under_one_id(spark):
    a, b = "".join(map(str, range(100, 200))), "".join(map(str, range(300, 380)))
    rows = [(1, a + b), (1, b + a), (1, a + b), (None, a), (2, b), (3, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = min((a + b, b + a), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = without_repeats([(0, first), (1, b + a if first == a + b else a + b)])
    again = [want[0 if t == first else 1][1] for t in (a + b, b + a, a + b)]
    assert got == sorted([(0, 300, 0), *((1, 540, n) for n in again), (2, 240, 240), (3, 0, 0)]) and max(again) > 0


def test_the_order_decides_what_repeats():
    import pyarrow as pa

    r = np.random.default_rng(6)
    shared = r.integers(97, 123, 130).astype(np.uint8).tobytes()
    pieces = [shared[int(k) :][:100] + bytes([97 + n]) * 4 for n, k in enumerate(r.integers(0, 6, 24))]
    t = pa.table({"bucket": [7] * 24, "doc": list(range(24)), "at": [4 << 8] * 24, "piece": pa.array(pieces, pa.binary())}).combine_chunks()
    row, start, first, _, _ = substring.repeats_of(t, 100)
    seen, want = set(), set()
    for d, x in enumerate(pieces):
        for s in range(5):
            if x[s : s + 100] in seen:
                want.add((d, s))
            seen.add(x[s : s + 100])
    assert {(int(d), int(s)) for d, s in zip(row[~first], start[~first], strict=True)} == want and want
    mixed = lambda data, word, pos, group, length: np.random.default_rng(0).permutation(len(pos))
    row, start, first, _, _ = substring.repeats_of(t, 100, mixed)
    assert {(int(d), int(s)) for d, s in zip(row[~first], start[~first], strict=True)} != want


@pytest.mark.parametrize("shallow", [8, 48, 104])
def test_deep_shallow_order(shallow):
    r = np.random.default_rng(shallow)
    for kinds, n in ((1, 300), (2, 700), (3, 1500)):
        data = np.concatenate([r.integers(97, 97 + kinds, n).astype(np.uint8), np.tile(r.integers(97, 99, 30).astype(np.uint8), 12)])
        pos, word = r.permutation(len(data) - 99), suffixes.eight_bytes(data)
        group, raw = r.integers(0, 3, len(pos)), data.tobytes()
        order = suffixes.deep_shallow_order(data, word, pos, group, 100, shallow)
        keys = [(int(group[i]), raw[pos[i] : pos[i] + 100]) for i in order]
        assert sorted(order) == list(range(len(pos))) and keys == sorted(keys)
        assert suffixes.equal_neighbours(word, pos, group, order, 100).tolist() == [a == b for a, b in zip(keys, keys[1:], strict=False)]


def test_blind_trie_orders_strings():
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 99, 12).astype(np.uint8)) for _ in range(200)]
    trie = suffixes.BlindTrie()
    for i, t in enumerate(texts):
        trie.insert(t, i)
    assert [texts[i] for i in trie.ordered()] == sorted(texts)


def test_chat_round_trip(spark):
    bad = ["\n</turn>\n", "</turn>", "### user:\n", "~0~1#<:", "", None, "\\### Assistant: </turn> ok", "x\n</turn>"]
    rows = [(c, t, role, bad[(c + t) % len(bad)]) for c in range(8) for t, role in enumerate(["user", "assistant", None, "a:\nb"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.loss_mask(chat.format_chats(df)).collect()
    for r in out:
        assert [(t.role, t.text) for t in r.parsed] == [(role or "", x or "") for _, _, role, x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        raw = [r.formatted[m.start : m.start + m.length] for m in r["mask"]]
        assert len(raw) == 1


def test_pii_base_spans(spark):
    texts = ["a@b-c.d_e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1", "é😀 a.b@c.d.e. +1 (234) 567-8901 +12", "4111 1111 1111 1111-0", "9" * 3000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.base] for r in pii.find_pii(df, {k: pii.Trees(0.0, [], float("inf")) for k in pii.SPAN_KINDS}).collect()}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+){3}", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    for i, kinds in ((0, ["email"]), (1, ["ip"]), (2, ["email", "phone"])):
        found = [f"{k}:{m.start()}:{m.end()}" for k in kinds for m in re.finditer(plain[k], texts[i]) if "999" not in m[0] and len(m[0]) > 4]
        assert got[i] == found and found
    assert got[3] == got[4] == got[5] == got[6] == []


def plain_base(text):
    """The contract's base spans, with Python's own regular expressions."""
    def luhn(v):
        d = [int(c) for c in v if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    n = lambda v: sum(c.isdigit() for c in v)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= n(v) <= 19 and luhn(v)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= n(v) <= 15),
    }
    found = [(m.start(), list(kinds).index(k), m.end(), k) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, s, e) for s, _, e, k in sorted(found)]


@pytest.fixture(scope="module")
def trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, pii.fit(docs)


def test_pii_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op7_pii(spark, sf).collect()
    assert len(got) == len(text)
    more = 0
    for r in got:
        base = plain_base(text[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        spans = [tuple(int(y) if y.isdigit() else y for y in x.split(":")) for x in r.spans.split(",") if x]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (x[1], pii.SPAN_KINDS.index(x[0])))
        added = [x for x in spans if x not in base]
        more += len(added)
        assert all(e <= b or d <= s for _, s, e in added for _, b, d in base)
    assert more >= 10


def test_pii_trees_are_precise_on_other_cases(spark, trees):
    docs, fitted = trees
    cases = pii.training_cases(pii.corpus_values(docs), n=120, seed=99)
    found = pii.case_features(spark, cases)
    from pyspark.sql import functions as F

    x = [F.element_at("x", i + 1) for i in range(len(pii.FEATURES))]
    frame = spark.createDataFrame([(r.want, r.y, r.x) for r in found], "want string, y int, x array<double>")
    for kind in pii.SPAN_KINDS:
        own = [r for r in found if r.want == kind]

        def walk(v, kind=kind):
            total = fitted[kind].prior
            for f, cut, low, high in fitted[kind].nodes:
                g, at, a, b = low if v[f] <= cut else high
                total += a if v[g] <= at else b
            return total

        scored = frame.where(F.col("want") == kind).select("x", fitted[kind].score(x).alias("s")).collect()
        assert all(abs(r.s - walk(r.x)) < 1e-9 for r in scored)
        taken = [r.y for r in own if walk(r.x) >= fitted[kind].least]
        assert len(taken) >= 20 and np.mean(taken) >= 0.88, kind


def test_pii_candidates_equal_python(spark):
    from pyspark.sql import functions as F

    texts = ["é call (017) 555-7713 or 00491 234 567 890 now", "x 4111.1111.1111.1111, 1.2.3.4 [.] 5", "joe (at) host (dot) com 1 [.] 2 [.] 3 [.] 4", 'token = "0123456789abcdef0123456789"', "1:2:3:4:5:6:7:8", "", "7" * 700]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii.candidates(F.col("text")).alias("c"))
    for r in df.collect():
        want = sorted((k, m.start(), m.end()) for k, p in pii.GENERATORS for m in re.finditer(p, r.text) if k != "secret" or (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])))
        assert sorted((s.kind, s.start, s.end) for s in r.c) == want


def test_pii_of_long_numeric_texts(spark):
    import time

    texts = ["1 " * 300_000, "12 345\n" * 100_000, "a@b.c " * 20_000]
    none = {k: pii.Trees(0.0, [], float("inf")) for k in pii.SPAN_KINDS}
    began = time.time()
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), none).collect()
    assert {r.doc_id: len(r.base) for r in got} == {0: 0, 1: 0, 2: 20_000} and time.time() - began < 90
    last = next(r for r in got if r.doc_id == 2).base[-1]
    assert (last.start, last.end) == (119_994, 119_999)


def test_classifiers_learn_and_meet_empty_tables(spark):
    text = [("fine words here and there " * 5, 1), ("!!BUY NOW!! $$$ " * 8, 0)] * 30
    model = quality.fit([t for t, _ in text], [y for _, y in text])
    raw = np.frombuffer("fine words and there".encode() + b"!!BUY $$$ NOW!!", np.uint8)
    good, poor = model.score(quality.features(raw, np.array([0, 20, len(raw)])))
    assert good > 0.5 > poor
    docs = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_network_gradients_equal_finite_differences():
    r = np.random.default_rng(0)
    raw = np.frombuffer(b"some words idiot here some moreand other words of a second text idiot", np.uint8)
    w = toxicity.read(raw, np.array([0, 31, len(raw)]))
    net = toxicity.Network.fresh(r)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y = np.array([1.0, 0.0])
    g, loss = net.gradients(w, w.index, w.mask, y)

    def value():
        prob = 1 / (1 + np.exp(-net.logits(w)))
        return -np.mean(np.log(np.where(y > 0, prob, 1 - prob)))

    assert abs(loss - value()) < 1e-6
    for k, v in net.p.items():
        flat, own = v.reshape(-1), g[k].reshape(-1)
        for i in [*np.argsort(-np.abs(own))[:3], *r.integers(0, len(flat), 2)]:
            keep = flat[i]
            flat[i] = keep + 1e-4
            up = value()
            flat[i] = keep - 1e-4
            down = value()
            flat[i] = keep
            assert abs((up - down) / 2e-4 - own[i]) < 1e-4 + 1e-2 * abs(own[i]), (k, i)


def test_toxicity_is_learned_from_one_passage_in_long_texts():
    r = np.random.default_rng(1)
    plain = lambda n: " ".join(f"w{int(x)}" for x in r.integers(0, 60, n))
    texts = [plain(int(r.integers(5, 120))) + (" you idiot moron " if i % 4 == 0 else " ") + plain(20) for i in range(160)]
    net = toxicity.train(texts, [int(i % 4 == 0) for i in range(160)])

    def score(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return net.document_scores(toxicity.read(raw, np.array([0, len(raw)])))[0]

    other = [plain(300) + (" you idiot moron " if i % 2 == 0 else " ") + plain(200) for i in range(40)]
    right = [(score(t) >= 0.3) == (i % 2 == 0) for i, t in enumerate(other)]
    assert np.mean(right) >= 0.9 and score("") <= min(score(t) for t in other[::2])


def test_sum_of_squares_equals_brute_force():
    r = np.random.default_rng(5)
    for window, most in ((12, 5), (40, 10**6), (40, 6)):
        rule, levels = packing.SumOfSquares(window, most), []
        for _ in range(400):
            size = int(r.integers(1, window))
            while size:
                options = [] if len(levels) >= most else [0]
                options += [h for h in set(levels) if h + size <= window or len(levels) >= most]

                def after(h, size=size):
                    out = list(levels)
                    if h:
                        out.remove(h)
                    return [*out, h + size] if h + size < window else out

                square = lambda ls: sum(ls.count(x) ** 2 for x in set(ls))
                best = min(options, key=lambda h: (square(after(h)), -h))
                h = rule.place(size)
                assert h == best
                taken = min(size, window - h)
                rule.move(h, taken)
                levels = after(h)
                size -= taken
                assert rule.open == len(levels) <= most and [int(x) for x in rule.count[1:window]] == [levels.count(x) for x in range(1, window)]


def test_packing_pours_little_and_holds_few_windows(spark):
    words = ["one", "two", "three", "four"]
    r = np.random.default_rng(8)
    texts = [(i, " ".join(words[int(x)] for x in r.integers(0, 4, int(r.integers(1, 400))))) for i in range(3000)]
    got = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), packing.default_vocabulary(), window=256, most_open=16).collect()
    fill = {}
    for x in got:
        fill[x.sequence_id] = fill.get(x.sequence_id, 0) + x.length
    assert sum(x.length for x in got if x.poured) <= 16 * 256 and all(n & (n - 1) == 0 for n in fill.values())
    whole = {x.doc_id for x in got if x.start == 0 and x.length == x.doc_tokens}
    assert len(whole) > 0.4 * len(texts)


@pytest.mark.parametrize("f", [minhash.near_dedup, exact_dedup.exact_dedup, mixing.mix_sources, substring.remove_repeats, fingerprint.fingerprints])
def test_empty_tables(docs, f):
    assert f(docs.limit(0)).count() == 0


def test_mix_carries_kept_columns(spark):
    from wayfold.llm.mixing import mix_sources

    docs = spark.createDataFrame([(i, "w " * (i + 1), f"l{i % 3}", f"s{i % 2}", 10 * i) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    plain = mix_sources(docs)
    kept = mix_sources(docs, keep=("text", "lang", "source", "n_chars"))
    assert kept.columns == [*plain.columns, "text", "lang", "n_chars"]
    rows = {r.doc_id: r for r in kept.collect()}
    assert len(rows) == 12 and all((r.text, r.lang, r.source, r.n_chars) == ("w " * (i + 1), f"l{i % 3}", f"s{i % 2}", 10 * i) for i, r in rows.items())
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r)[: len(plain.columns)] for r in rows.values())


def test_rows_with_an_id_stay_before_rows_without(spark):
    docs = spark.createDataFrame([(None, "a  b   c"), (7, "a b c"), (5, "a bc"), (None, "alone")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 1, True), (-1, 7, 3, False), (5, 7, 3, False), (7, 7, 3, True)]
