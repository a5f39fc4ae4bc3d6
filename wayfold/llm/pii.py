"""Personal data: base patterns, overlapping candidates, boosted trees, calibrated thresholds; DataFrame functions only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans: the method also finds secrets (keys and tokens), which have no base pattern.
SPAN_KINDS = (*KINDS, "secret")
#: At most this many documents give values and contexts to train on, each at most eight short cuts of its text.
SAMPLE = 4000

# The base patterns of the contract. Runs are possessive and start at a run's beginning or where the
# last match ended, which finds the same leftmost matches without trying each place inside a long run again.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[ -]?[0-9]){14})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the base pattern to be tried.
_HINT = {"email": "@", "ip": ".", "phone": "+"}

# Candidate generators: high recall, overlapping; the trees decide.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])00[0-9][ ().0-9-]{8,16}[0-9](?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}[ ._/-]{1,2}[0-9]{4}[ ._/-]{1,2}[0-9]{4}[ ._/-]{1,2}[0-9]{1,7}(?![0-9A-Za-z])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?[\[({]? ?(?:\.|dot|DOT) ?[\])}]? ?[A-Za-z0-9-]{2,63}){1,4}"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("secret", r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{20,128}+={0,2}(?![0-9A-Za-z_+/=-])"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,3} ?[\[(]?\.[\])]? ?[0-9]{1,3} ?[\[(]?\.[\])]? ?[0-9]{1,3} ?[\[(]?\.[\])]? ?[0-9]{1,3}(?![0-9A-Za-z.])"),
)
_CONTEXT = 24
FEATURES = ("digits", "length", "separators", "brackets", "luhn", "octets", "same_separator", "zeros", "cue", "number_cue", "touches", "secret_cue", "hash_cue", "quoted", "turns", "domain")
#: Matches whose places are summed at once.
_BLOCK = 256
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _located(text: Column, pattern: str, kind: str, holds=None) -> Column:
    """array<struct<kind, start, end, value>> of the matches (that hold, if asked). split and regexp_extract_all cut
    the same text at the same places, so the lengths of the pieces between give the positions, in code points.
    Places are summed block by block, so time stays in proportion to the matches but for the hits of one block."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        more = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), (F.when(holds(pair["value"]), more).otherwise(acc["out"]) if holds else more).alias("out"))

    def placed(pairs: Column) -> Column:
        block = lambda i: F.slice(pairs, i * _BLOCK + 1, F.lit(_BLOCK))
        size = lambda i: F.aggregate(block(i), F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"]))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
        starts = F.aggregate(blocks, none, lambda acc, i: F.struct((acc["at"] + size(i)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out"))
        each = F.transform(starts, lambda at, i: F.aggregate(block(i), begin(at), step, lambda acc: acc["out"]))
        return F.when(F.size(pairs) > 0, F.flatten(each)).otherwise(F.array().cast(_SPANS))

    pairs = F.transform(F.array(found), lambda f: F.arrays_zip(F.slice(gaps, 1, F.size(f)).alias("gap"), f.alias("value")))
    return F.get(F.transform(pairs, placed), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(value)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    return F.coalesce(F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.coalesce(F.substring(short, 1, 4).try_cast("int"), F.lit(999)) <= 255)


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": F.forall(F.split(value, r"\."), _octet), "card": n.between(14, 19) & _luhn(value), "phone": n.between(10, 15)}[kind]


def base_spans(text: Column) -> Column:
    """All base spans, by kind; matches that fail their test are dropped and not tried again."""
    out = []
    for kind in KINDS:
        hint = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else F.regexp_like(text, F.lit("[0-9][0-9 -]{12,}[0-9]"))
        own = _located(text, BASE[kind], kind, lambda v, kind=kind: _holds(kind, v))
        out.append(F.when(hint, own).otherwise(F.array().cast(_SPANS)))
    return F.concat(*out)


def candidates(text: Column) -> Column:
    """Spans of all generators; they may overlap."""
    none = F.array().cast(_SPANS)
    digit = F.regexp_like(text, F.lit("[0-9]"))
    at = F.regexp_like(text, F.lit(r"[\[({] ?(?:at|AT|@) ?[\])}]"))
    long_run = F.regexp_like(text, F.lit("[0-9A-Za-z_+/-]{20}"))
    hint = {"email": at, "phone": digit, "card": digit, "ip": digit, "secret": digit & long_run}
    test = {"secret": lambda v: F.regexp_like(v, F.lit("[0-9]")) & F.regexp_like(v, F.lit("[A-Za-z]"))}
    return F.concat(*(F.when(hint[k], _located(text, p, k, test.get(k))).otherwise(none) for k, p in GENERATORS))


def _features(text: Column, s: Column) -> list[Column]:
    """Format and context of a candidate, in the order of FEATURES."""
    v = s["value"]
    before = F.lower(F.substring(text, F.greatest(s["start"] - _CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(_CONTEXT))))
    after = F.substring(text, s["end"] + 1, F.lit(2))
    signs = F.regexp_replace(v, "[0-9A-Za-z]", "")
    flag = lambda c: c.cast("double")
    return [
        F.length(_digits(v)).cast("double"),
        F.length(v).cast("double"),
        F.length(signs).cast("double"),
        flag(F.regexp_like(v, F.lit(r"[\[({]"))),
        flag(_luhn(v)),
        flag(F.forall(F.split(F.regexp_replace(v, "[^0-9]+", "."), r"\."), _octet)),
        flag(F.length(F.replace(F.replace(signs, F.lit("("), F.lit("")), F.substring(signs, -1, 1), F.lit(""))) == 0),
        F.length(F.regexp_replace(v, "[^0]", "")).cast("double"),
        flag(F.regexp_like(before, F.lit(r"(?:phone|tel|call|fax|mobile|contact|mail|write|card|visa|paid|pay|host|server|addr|from|ip)[a-z]*[ :=.]*(?:me|us|at|on|to|no|is)?[ :=.]*$"))),
        flag(F.regexp_like(before, F.lit(r"(?:isbn|order|id|no|nr|ref|version|build|serial|invoice|page|sku|part|section|met|seen)[ #:.=]*$"))),
        flag(F.regexp_like(F.substring(before, -1, 1), F.lit("[0-9a-z#$/_=.-]")) | F.regexp_like(after, F.lit(r"^(?:[a-zA-Z0-9_/%$]|[.-][0-9])"))),
        flag(F.regexp_like(before, F.lit(r"(?:key|token|secret|passw|pwd|auth|bearer|credential)[a-z0-9_]*[\"' ]*[:=> ][\"' :=]*$"))),
        flag(F.regexp_like(before, F.lit(r"(?:sha|md5|commit|checksum|hash|etag|rev|uuid|digest|blob|href|http)[a-z0-9_]*[\"' ]*[:=/# ][\"' :=/]*$"))),
        flag(F.regexp_like(F.substring(before, -1, 1), F.lit("[\"']"))),
        F.length(F.regexp_replace(v, "(?:[0-9]+|[a-z]+|[A-Z]+)", "x")).cast("double"),
        flag(F.regexp_like(F.lower(v), F.lit(r"(?:com|org|net|io|edu|gov|de|fr|es|uk|eu)$"))),
    ]


@dataclass
class Trees:
    """Boosted depth-2 trees and the calibrated least score of a kind."""

    prior: float
    nodes: list[tuple]  # (feature, cut, (feature, cut, left, right), (feature, cut, left, right))
    least: float

    def score(self, x: list[Column]) -> Column:
        def leaf(node: tuple) -> Column:
            f, cut, low, high = node
            return F.when(x[f] <= cut, F.lit(low)).otherwise(F.lit(high))

        return reduce(lambda a, b: a + b, (F.when(x[f] <= cut, leaf(lo)).otherwise(leaf(hi)) for f, cut, lo, hi in self.nodes), F.lit(self.prior))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    best, out = -1.0, (0, float("inf"))
    for f in range(x.shape[1]):
        for cut in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2:
            left = x[:, f] <= cut
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))
            if gain > best + 1e-12:
                best, out = gain, (f, float(cut))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.3) -> Trees:
    """Newton boosting of the logistic loss; every third row is held out to calibrate the threshold: the least
    score at which 19 of 20 accepted held-out candidates are personal data, and never under even odds."""
    held = np.arange(len(y)) % 3 == 2
    tx, ty = x[~held], y[~held]
    prior = float(np.log((ty.sum() + 1) / ((1 - ty).sum() + 1)))
    nodes, fit, out = [], np.full(len(ty), prior), np.full(len(y), prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-fit))
        g, h = ty - p, p * (1 - p)
        f, cut = _best_split(tx, g, h)
        sides = []
        for m in (tx[:, f] <= cut, tx[:, f] > cut):
            f2, cut2 = _best_split(tx[m], g[m], h[m]) if m.sum() > 1 else (0, float("inf"))
            parts = [m & (tx[:, f2] <= cut2), m & (tx[:, f2] > cut2)]
            sides.append((f2, cut2, *(float(rate * g[q].sum() / (h[q].sum() + 1)) for q in parts)))
        nodes.append((f, cut, *sides))
        leaf = lambda z, n: np.where(z[:, n[0]] <= n[1], n[2], n[3])
        grow = lambda z: np.where(z[:, f] <= cut, leaf(z, sides[0]), leaf(z, sides[1]))  # noqa: B023, E731
        fit, out = fit + grow(tx), out + grow(x)
    score, label = out[held], y[held]
    fair = [s for s in np.sort(score) if label[score >= s].mean() >= 0.95]
    return Trees(prior, nodes, max(0.0, float(fair[0]) if fair else float("inf")))


def corpus_values(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str, str, str]]:
    """(kind or "number" or "run", text before, value, text after): base matches, numbers that are none, and long
    runs of letters and digits, with their surroundings, of a sample of documents drawn by hash of the id."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = src.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.col("text")
    other = F.concat(_located(text, r"(?<![0-9A-Za-z])[0-9]{7,19}(?![0-9A-Za-z])", "number"), _located(text, r"(?<![0-9A-Za-z])(?=[a-z]*[0-9])[0-9a-zA-Z]{20,64}(?![0-9A-Za-z])", "run"))
    near = F.transform(F.slice(F.concat(base_spans(text), other), 1, 8), lambda s: F.struct(s["kind"].alias("kind"), F.substring(text, F.greatest(s["start"] - 40, F.lit(0)) + 1, F.least(s["start"], F.lit(40))).alias("before"), F.substring(s["value"], 1, 64).alias("value"), F.substring(text, s["end"] + 1, F.lit(20)).alias("after")))
    rows = src.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", F.explode(near).alias("c")).collect()
    return sorted((r["c"]["kind"], r["c"]["before"], r["c"]["value"], r["c"]["after"]) for r in rows)


def _luhn_digit(head: str) -> str:
    total = 0
    for i, c in enumerate(reversed(head)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def training_cases(values: list[tuple[str, str, str, str]], n: int = 480, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, kind, 1 if its candidate is personal data), n of each kind, half of them positive.

    Positives are values that the base patterns found (or made by rule, where the corpus has too few) in other
    surface forms; negatives are numbers and words that they did not find, in the same forms. Both stand in the
    same surroundings, cut from the corpus; a cue word of their own side comes before most of them. So neither
    length nor layout tells them apart: check digits, ranges and context must.
    """
    r = np.random.default_rng(seed)
    d = lambda k: "".join(str(i) for i in r.integers(0, 10, k))
    pick = lambda a: a[int(r.integers(len(a)))]
    by: dict[str, list[str]] = {}
    for kind, _, value, _ in values:
        by.setdefault(kind, []).append("".join(c for c in value if c.isdigit()) if kind in ("card", "phone", "number") else value)
    around = [(re.sub(r"\S*$", "", b), re.sub(r"^\S*", "", a)) for _, b, _, a in values] or [("some words before ", " and after")]
    word = lambda k: "".join(chr(97 + int(i)) for i in r.integers(0, 26, k))
    hexes = lambda k: "".join("0123456789abcdef"[int(i)] for i in r.integers(0, 16, k))
    mixed = lambda k: "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[int(i)] for i in r.integers(0, 62, k))
    fives = lambda x, s: s.join(x[i : i + 4] for i in range(0, len(x), 4))

    def card(good: bool) -> str:
        known = [x for x in by.get("card" if good else "number", []) if len(x) == 16]
        x = pick(known) if known and r.random() < 0.5 else "4" + d(14) + "0"
        last = _luhn_digit(x[:15])
        x = x[:15] + (last if good else str((int(last) + 1 + int(r.integers(9))) % 10))
        return fives(x, pick([".", "/", "_", "  ", "--", ". "]))

    def phone(good: bool) -> str:
        known = [x[-10:] for x in by.get("phone" if good else "number", []) if len(x) >= 10]
        x = pick(known) if known and r.random() < 0.5 else d(10)
        form = pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}{}{}", "00{} {} {}"])
        return form.format(x[:3], x[3:6], x[6:])

    def email(good: bool) -> str:
        at, dot = pick([" (at) ", " [at] ", "(at)", "{at}"]), pick([".", " [dot] ", " (dot) ", " dot "])
        end = pick(["com", "org", "net", "io", "de"]) if good or r.random() < 0.3 else word(int(r.integers(2, 6)))
        return f"{word(6)}{at}{word(5)}{dot}{end}"

    def ip(good: bool) -> str:
        top = 256 if good or r.random() < 0.5 else 999
        return pick(["[.]", "(.)", " . "]).join(str(int(k)) for k in r.integers(0, top, 4))

    def secret(good: bool) -> str:
        known = by.get("run", [])
        kind = int(r.integers(4))
        if not good and kind == 0:
            return "_".join(word(int(r.integers(4, 8))) for _ in range(5)) + str(int(r.integers(10)))
        return pick(known) if known and kind == 1 else hexes(int(pick([24, 32, 40, 64]))) if kind < 3 else mixed(int(r.integers(20, 49)))

    cues = {
        "phone": (["phone: ", "call me at ", "tel ", "fax "], ["order no ", "isbn ", "id ", "ref "]),
        "card": (["card ", "paid with visa ", "pay "], ["serial ", "ref ", "sku "]),
        "email": (["mail ", "write to ", "contact "], ["we met ", "was seen ", "page "]),
        "ip": (["host ", "server ip ", "from "], ["version ", "build ", "section "]),
        "secret": (["token = \"", "api_key: ", "secret=", "password: \"", "auth bearer "], ["commit ", "sha256: ", "checksum = ", "http://", "etag: \"", "see ", "and "]),
    }
    sure = {"phone": 0.7, "card": 0.4, "email": 0.6, "ip": 0.6, "secret": 0.9}
    make = {"phone": phone, "card": card, "email": email, "ip": ip, "secret": secret}
    out = []
    for i in range(n):
        for kind in SPAN_KINDS:
            good = i % 2 == 0
            before, after = pick(around)
            side = good if r.random() < 0.97 else not good
            cue = pick(cues[kind][0 if side else 1]) if r.random() < sure[kind] else ""
            if kind == "secret" and not good and r.random() < 0.3:
                cue = pick(["title = \"", "name: ", "file \""])
            value = make[kind](good)
            out.append((f"{before}{cue}{value}{chr(34) if cue.endswith(chr(34)) else ''}{after or ' '}", kind, int(good)))
    return out


def case_features(spark: SparkSession, cases: list[tuple[str, str, int]]) -> list:
    """(nth, want, y, x) of the cases' candidates of their kind, from the same expressions as in use."""
    told = json.dumps([{"nth": i, "text": t, "want": k, "y": y} for i, (t, k, y) in enumerate(cases)])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(told), "array<struct<nth:bigint,text:string,want:string,y:int>>")).alias("c")).select("c.*")
    found = rows.withColumn("s", F.explode(candidates(F.col("text")))).where("s.kind = want")
    return found.select("nth", "want", "y", F.array(*_features(F.col("text"), F.col("s"))).alias("x")).orderBy("nth", "s.start", "s.end").collect()


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, Trees]:
    """Trees of each kind, from values and surroundings of a sample of the corpus."""
    found = case_features(docs.sparkSession, training_cases(corpus_values(docs, sample)))
    out = {}
    for kind in SPAN_KINDS:
        own = [r for r in found if r["want"] == kind]
        out[kind] = boost(np.array([r["x"] for r in own]), np.array([float(r["y"]) for r in own])) if len({r["y"] for r in own}) > 1 else Trees(0.0, [], float("inf"))
    return out


def find_pii(docs: DataFrame, trees: dict[str, Trees] | None = None) -> DataFrame:
    """doc_id, text, base, spans: arrays of struct<kind, start, end, value>, of each row's whole text.

    base: what the base patterns find. spans: base and every candidate over its kind's threshold that touches no
    base span (of all SPAN_KINDS); of accepted candidates that overlap, the first, then the longest stays. Both
    sorted by start, then kind in the order of SPAN_KINDS. Positions are code points, the end exclusive. Trees are
    fitted on a sample of ``docs`` unless given; without any documents on rule-made values alone. Null text is
    empty; empty texts have no spans; very long texts are read whole; repeated rows and rows without id are rows of
    their own; an empty table gives no rows; other columns are ignored.
    """
    trees = trees or fit(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, SPAN_KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    src = src.withColumn("base", order(base_spans(F.col("text")))).withColumn("maybe", candidates(F.col("text")))

    def accepted(s: Column) -> Column:
        x = _features(F.col("text"), s)
        ok = F.lit(False)
        for kind in SPAN_KINDS:
            ok = F.when(s["kind"] == kind, trees[kind].score(x) >= trees[kind].least).otherwise(ok)
        return ok

    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(F.filter("maybe", apart), accepted)
    by_place = F.array_sort(F.transform(more, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    empty = F.array().cast("array<struct<start:int,minus_end:int,kind:string,end:int,value:string>>")
    chosen = F.aggregate(by_place, empty, lambda acc, s: F.when(F.exists(acc, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    spans = F.when(F.size("maybe") == 0, F.col("base")).otherwise(order(F.concat(plain(F.col("base")), plain(chosen))))
    return src.select("doc_id", "text", plain(F.col("base")).alias("base"), plain(spans).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """Adds redacted: the text with each span replaced by its kind in brackets."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        label = F.when(s["end"] > acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], kept, label).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.withColumn("redacted", F.aggregate("spans", start, step, end))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
