"""Removal of repeated 100-byte strings by sorting suffixes, deep-shallow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, shuffle_partitions, spans_of, utf8_bytes
from .kernels import U64, Rolling, eight_bytes, mix
from .suffixes import deep_shallow_order, equal_neighbours

#: Length of a repeated string, and of the grams that anchor it.
LENGTH, GRAM = 100, 24
#: Pieces of one anchor that are sorted at once; an anchor with more is dealt over several buckets first.
BUCKET = 2048
#: Pieces gathered before a task sorts them.
GATHER = 16_000
#: Documents whose anchors are looked at to plan the exchange, appearances among them that make an anchor hot, and
#: the keys that a hot anchor's rows are dealt over. They decide where rows go, never which.
PLANNED, HOT, SALTS = 10_000, 40, 64

_ANCHORS = "h long, g long, doc long, at long, mark long"
_FOUND = "kind int, h long, doc long, at long, stop long, src long, src_at long"
RUN, WHOLE, PIECE = 0, 1, 2


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching and overlapping ranges of each document as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    # ranges are of one length up to the windows of an anchor, so the furthest stop so far needs no reset by document
    lift = np.cumsum(fresh) * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + lift)
    gap = np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - lift[last]


def _same_bytes(word: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` (8 at least) bytes at a and at b are equal."""
    out = np.ones(len(a), bool)
    for at in range(0, int(size.max(initial=0)), 8):
        k = np.minimum(at, size - 8)
        out &= word[a + k] == word[b + k]
    return out


def _anchors(length: int, gram: int, seed: int, hot: np.ndarray | None = None) -> Callable:
    """(doc, text) -> its anchors: h (hash of the gram), g (hash of all bytes of its windows), doc, at (packed).

    A window is a string of ``length`` bytes; its anchor is the gram with the smallest hash in it, the first of
    equal ones. Equal windows have equal anchors at equal places, so a repeated string shows as a repeated h.
    Consecutive windows with one anchor are one row: at = first window << 16 | (windows - 1) << 8 | anchor - first.

    Rows that equal an earlier one of the same run of texts, byte by byte, are settled here: they go on as ranges
    of removed bytes (at = start, mark = stop). For anchors in ``hot`` mark is -(1 + salt by g), else 0.
    """
    width = length - gram + 1
    hot = np.zeros(0, np.int64) if hot is None else np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for i, j in spans_of(off):
                data, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                n = len(data)
                if n < length:
                    continue
                roll, place = Rolling(data, seed), np.arange(n - gram + 1)
                bits = U64(max(21, int(n).bit_length()))
                key = (roll.hash(place, place + gram) >> bits << bits) | place.astype(U64)
                low, span = key, 1
                while span * 2 <= width:
                    low, span = np.minimum(low[:-span], low[span:]), span * 2
                low = np.minimum(low[: n - length + 1], low[width - span : width - span + n - length + 1])
                doc = np.searchsorted(o, np.arange(n - length + 1), side="right") - 1
                start = np.flatnonzero(np.arange(n - length + 1) + length <= o[doc + 1])
                if not len(start):
                    continue
                doc, anchor = doc[start], (low[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
                first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
                anchor, doc = anchor[cut], doc[cut]
                h = roll.hash(anchor, anchor + gram).view(np.int64)
                g = mix(roll.hash(first, last + length) + (anchor - first).astype(U64)).view(np.int64)
                who, begin = ids[i + doc], first - o[doc]
                at = begin << 16 | (last - first) << 8 | (anchor - first)
                order = np.lexsort((begin, who, g, h))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                again, head = order[~new], head[~new]
                if len(again):
                    fits = (last - first)[again] == (last - first)[head]
                    again, head = again[fits], head[fits]
                    again = again[_same_bytes(eight_bytes(data), first[again], first[head], (last - first)[again] + length)]
                goes = np.ones(len(h), bool)
                goes[again] = False
                d, s, e = _runs(who[again], begin[again], (begin + last - first)[again] + length)
                salt = np.where(np.isin(h, hot), -1 - (g & (SALTS - 1)), 0)[goes] if len(hot) else np.zeros(goes.sum(), np.int64)
                spread = mix(d.astype(U64) + s.astype(U64)).view(np.int64)
                cols = ((h[goes], spread), (g[goes], np.zeros(len(d), np.int64)), (who[goes], d), (at[goes], s), (salt, e))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "g", "doc", "at", "mark"])

    return run


def _repeated(length: int) -> Callable:
    """Rows sorted by (h, g, doc, at) -> RUN: ranges settled before; WHOLE: all its windows also start in an earlier
    row of the same h and g, named as its source; PIECE: the first of its g, while h has (or may have) other g, so
    that single windows may be repeats."""
    names = ["kind", "h", "doc", "at", "stop", "src", "src_at"]

    def rows(kind: int, h: np.ndarray, doc: np.ndarray, at: np.ndarray, stop: np.ndarray | None = None, src: np.ndarray | None = None, src_at: np.ndarray | None = None) -> pa.RecordBatch:
        none = np.zeros(len(h), np.int64)
        cols = [np.full(len(h), kind, np.int32), h, doc, at, *(none if x is None else x for x in (stop, src, src_at))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # h, g, and doc, at of the first row of that g
        held = None  # the last first-of-its-g row (h, doc, at), and whether it is known to be a PIECE
        for batch in batches:
            h, g, doc, at, mark = (batch.column(c).to_numpy() for c in ("h", "g", "doc", "at", "mark"))
            ready = mark > 0
            if ready.any():
                yield rows(RUN, h[ready], doc[ready], at[ready], mark[ready])
                h, g, doc, at, mark = (x[~ready] for x in (h, g, doc, at, mark))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            if last is not None:
                new[0] = (h[0], g[0]) != last[:2]
            head = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            d0, a0 = np.where(head >= 0, doc[head], last[2] if last else 0), np.where(head >= 0, at[head], last[3] if last else 0)
            last = (h[-1], g[-1], d0[-1], a0[-1])
            if not new.all():
                w = ~new
                yield rows(WHOLE, h[w], doc[w], at[w], None, d0[w], a0[w])
            rh, rd, ra, sure = h[new], doc[new], at[new], mark[new] < 0
            if held is not None:
                rh, rd, ra, sure = (np.concatenate([[x], y]) for x, y in zip(held, (rh, rd, ra, sure), strict=True))
            if not len(rh):
                continue
            same = rh[1:] == rh[:-1]
            sure[1:] |= same
            held = (rh[-1], rd[-1], ra[-1], bool(sure[-1]))
            sure[:-1] |= same
            out = sure[:-1]
            yield rows(PIECE, rh[:-1][out], rd[:-1][out], ra[:-1][out])
        if held is not None and held[3]:
            yield rows(PIECE, *(np.array([x]) for x in held[:3]))

    return run


_PIECES = "bucket long, key long, doc long, at long, piece binary"


def _cut_pieces(length: int) -> Callable:
    """(doc, text, wants: bucket, key, at) -> the bytes that each anchor's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            wants = batch.column("wants")
            each, flat = pa.compute.list_parent_indices(wants).to_numpy(), wants.flatten()
            doc = batch.column("doc").to_numpy()[each]
            bucket, key, at = flat.field("bucket").to_numpy(), flat.field("key"), flat.field("at").to_numpy()
            s = off[each] + (at >> 16)
            e = s + (at >> 8 & 255) + length
            buf = memoryview(raw)
            step = 50_000
            for lo in range(0, len(at), step):
                hi = lo + step
                piece = pa.array([bytes(buf[a:b]) for a, b in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[lo:hi]), key[lo:hi], pa.array(doc[lo:hi]), pa.array(at[lo:hi]), piece], names=["bucket", "key", "doc", "at", "piece"])

    return run


def _cut_copies(length: int) -> Callable:
    """(doc, text, wants: at, src, src_at) -> src, start, piece: the bytes of its runs that shall equal those at
    ``start`` in ``src``. Consecutive rows with one source are one run; equal runs of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8_bytes(batch.column("text"))
            wants = batch.column("wants")
            each, flat = pa.compute.list_parent_indices(wants).to_numpy(), wants.flatten()
            at, src, src_at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "src", "src_at"))
            start, ahead = at >> 16, (src_at >> 16) - (at >> 16)
            stop = start + (at >> 8 & 255) + length
            order = np.lexsort((start, ahead, src, each))
            each, src, ahead, start, stop = (x[order] for x in (each, src, ahead, start, stop))
            new = np.ones(len(each), bool)
            new[1:] = (each[1:] != each[:-1]) | (src[1:] != src[:-1]) | (ahead[1:] != ahead[:-1])
            group, s, e = _runs(np.cumsum(new) - 1, start, stop)
            lead = np.flatnonzero(new)[group]
            each, src, ahead = each[lead], src[lead], ahead[lead]
            buf, seen = memoryview(raw), {}
            for d, a, x, y, base in zip(src.tolist(), (s + ahead).tolist(), (off[each] + s).tolist(), (off[each] + e).tolist(), range(len(s)), strict=True):
                seen.setdefault((d, a, bytes(buf[x:y])), base)
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["src", "start", "piece"])

    return run


_SORTED = "kind int, key long, w long, doc long, at long, stop long"


def repeats_of(t: pa.Table | pa.RecordBatch, length: int, order_of: Callable = deep_shallow_order) -> tuple[np.ndarray, ...]:
    """Pieces (bucket, doc, at, piece) -> row, start, and earliest of all their windows in sorted order: earliest is
    false where the neighbours before share the window's bytes and one of them starts earlier.

    The windows of each bucket are suffixes of its pieces, put in order by ``order_of``; equal ones are neighbours.
    """
    bucket, doc, at = (t.column(c).to_numpy() for c in ("bucket", "doc", "at"))
    data, off = utf8_bytes(t.column("piece"))
    count = (at >> 8 & 255) + 1
    row = np.repeat(np.arange(len(bucket)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    pos, start = off[row] + nth, (at >> 16)[row] + nth
    group = np.unique(bucket, return_inverse=True)[1][row]
    word = eight_bytes(data)
    order = order_of(data, word, pos, group, length)
    same = equal_neighbours(word, pos, group, order, length)
    string = np.concatenate([[0], np.cumsum(~same)]) if len(order) else order
    who, start = row[order], start[order]
    by = np.lexsort((start, doc[who], string))
    first = np.concatenate([[True], string[by][1:] != string[by][:-1]]) if len(by) else np.zeros(0, bool)
    return who[by], start[by], first, pos[order][by], data


def _sorted_repeats(length: int) -> Callable:
    """Rows in order of bucket -> RUN: ranges of windows that start earlier elsewhere; from pieces that have a key
    also PIECE: the earliest of each distinct window, to be compared with other buckets of the key."""

    def find(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, crowded = t.column("doc").to_numpy(), t.column("key").is_valid().to_numpy(zero_copy_only=False)
        row, start, first, pos, data = repeats_of(t, length)
        d, s, e = _runs(doc[row[~first]], start[~first], start[~first] + length)
        cols = [np.full(len(d), RUN, np.int32), mix(d.astype(U64) + s.astype(U64)).view(np.int64), np.zeros(len(d), np.int64), d, s, e]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "key", "w", "doc", "at", "stop"])
        first &= crowded[row]
        if first.any():
            key = t.column("key").fill_null(0).to_numpy()[row[first]]
            w = Rolling(data).hash(pos[first], pos[first] + length).view(np.int64)
            cols = [np.full(len(w), PIECE, np.int32), key, w, doc[row[first]], start[first] << 16, np.zeros(len(w), np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "key", "w", "doc", "at", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            b = batch.column("bucket").to_numpy()
            if held and len(b) and rows > GATHER:  # the last bucket may go on in this batch
                own = int(np.searchsorted(b, held[-1].column("bucket")[-1].as_py(), side="right"))
                if own < len(b):
                    yield from find(pa.Table.from_batches([*held, batch.slice(0, own)]).combine_chunks())
                    held, rows, batch = [], 0, batch.slice(own)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from find(pa.Table.from_batches(held).combine_chunks())

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, w) -> the RUN rows, and those PIECE rows whose (key, w) another row has too."""
    held = None  # the last PIECE row, and whether the one before it was its equal
    known = False
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        yield batch.filter(pa.array(kind == RUN))
        rows = batch.filter(pa.array(kind == PIECE))
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        key, w = rows.column("key").to_numpy(), rows.column("w").to_numpy()
        same = (key[1:] == key[:-1]) & (w[1:] == w[:-1])
        keep = np.concatenate([[known], same]) | np.append(same, False)
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
        held, known = rows.slice(rows.num_rows - 1), bool(keep[-1])
    if held is not None and known:
        yield held


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8_bytes(batch.column("text"))
        out = []
        for n, marks in enumerate(batch.column("marks").to_pylist()):
            text = raw[off[n] : off[n + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            if marks:
                np.add.at(edge, [m["start"] for m in marks], 1)
                np.add.at(edge, [m["stop"] for m in marks], -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((len(text), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0, text[~gone].tobytes()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc, doc_id, text) of all rows, and whether some documents have several. doc orders the documents.

    Where ids are unique, doc is the id. Else the rank of (doc_id, sha256 of the text), by ranges: rows of one id
    and one text are one document, rows of one id with other texts documents of their own.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = src.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return src.select(F.col("doc_id").alias("doc"), "doc_id", "text"), False
    named = materialize(src.withColumn("digest", F.sha2("text", 256)))
    ids = named.where("doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    ids = materialize(ids.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "digest").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ids.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "digest"))
    ranks = ids.withColumn("nth", nth).join(F.broadcast(starts), "part").select("doc_id", "digest", (F.col("nth") + F.col("before")).alias("doc"))
    return materialize(named.join(ranks, ["doc_id", "digest"], "left").select("doc", "doc_id", "text")), True


def _each_once(rows: DataFrame, repeated: bool) -> DataFrame:
    """(doc, text) of each document that has an id, once."""
    known = rows.where("doc IS NOT NULL").select("doc", "text")
    return known.dropDuplicates(["doc"]) if repeated else known


def _hot_anchors(unique: DataFrame, length: int, gram: int, seed: int, hot: int) -> np.ndarray:
    """Hashes of the anchors that many documents of a sample share, 1,000 at most."""
    share = PLANNED / max(1, unique.count())
    some = unique.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else unique
    seen = some.mapInArrow(_anchors(length, gram, seed), _ANCHORS).where("mark = 0").groupBy("h").agg(F.count("*").alias("n"))
    return np.array([r["h"] for r in seen.where(F.col("n") >= hot).orderBy(F.desc("n"), "h").limit(1000).collect()], np.int64)


def _dealt(pieces: DataFrame, bucket: int) -> DataFrame:
    """(key, doc, at, count) rows -> doc, at, bucket, key: rows of a key with more than ``bucket`` are dealt over
    several buckets; the others keep their key's own, and no key."""
    salt = F.pmod(F.xxhash64("doc", "at"), F.ceil(F.col("count") / bucket))
    crowded = F.coalesce(F.col("count"), F.lit(0)) > bucket
    return pieces.select("doc", "at", F.when(crowded, F.xxhash64("key", salt)).otherwise(F.col("key")).alias("bucket"), F.when(crowded, F.col("key")).alias("key"))


def _sorted(pieces: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(doc, at, bucket, key) rows -> the repeats among their windows, sorted bucket by bucket, and what survives
    of keys that have several buckets and is in more than one."""
    n = shuffle_partitions(pieces.sparkSession)
    wants = pieces.groupBy("doc").agg(F.collect_list(F.struct("bucket", "key", "at")).alias("wants"))
    cut = texts.join(wants, "doc").select("doc", "text", "wants").mapInArrow(_cut_pieces(length), _PIECES)
    done = cut.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_repeats(length), _SORTED)
    return done


def _compared(done: DataFrame) -> DataFrame:
    n = shuffle_partitions(done.sparkSession)
    return done.repartition(n, "key", "w").sortWithinPartitions("key", "w").mapInArrow(_shared, _SORTED)


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == RUN).select("doc", F.col("at").alias("start"), "stop")


def _left(rows: DataFrame) -> DataFrame:
    """Surviving windows as pieces of their own; all with one key are equal, or nearly always."""
    return rows.where(F.col("kind") == PIECE).select(F.xxhash64("key", "w").alias("key"), "doc", "at")


def _sorted_levels(pieces: DataFrame, texts: DataFrame, length: int, bucket: int) -> list[DataFrame]:
    """Repeats among the windows of pieces (key, doc, at), as ranges.

    Where a key has more than ``bucket`` pieces they are dealt over buckets by document, each bucket is sorted, and
    the earliest of each distinct window survives; windows that survive in several buckets are the next level, each
    distinct one with a key of its own. A key's rows shrink ``bucket``-fold a level. Up to ``bucket`` squared
    pieces two levels do, in one plan; beyond, levels are written until nothing is left. No task ever sorts more
    than ``bucket`` pieces of a key and what it gathers.
    """
    sizes = materialize(pieces.groupBy("key").count().where(F.col("count") > bucket))
    most = sizes.agg(F.max("count")).first()[0] or 0
    if not most:
        return [_ranges(_sorted(pieces.select("doc", "at", F.col("key").alias("bucket"), F.lit(None).cast("long").alias("key")), texts, length))]
    first = _compared(_sorted(_dealt(pieces.join(sizes, "key", "left"), bucket), texts, length))
    if most <= bucket * bucket:
        again = _left(first).select("doc", "at", F.col("key").alias("bucket"), F.lit(None).cast("long").alias("key"))
        return [_ranges(first), _ranges(_sorted(again, texts, length))]
    out = []
    while True:
        first = materialize(first)
        out.append(_ranges(first))
        left = _left(first)
        if left.isEmpty():
            return out
        counts = left.groupBy("key").count()
        first = _compared(_sorted(_dealt(left.join(counts, "key"), bucket), texts, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, seed: int = 0, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a ``length``-byte string over it also starts earlier: in a document of smaller id, or earlier
    in its own. Strings are judged on the input. The suffixes are sorted by anchors: one row for each run of windows
    with one anchor (about 2 in ``length - gram`` bytes) says where suffixes can be equal at all. Of rows with the
    same bytes (by hash, and then compared byte by byte: inside a batch where they are read, else against the
    source's text) only the earliest goes on. Where an anchor then has several surroundings, their windows'
    bytes are sent and sorted deep-shallow, and equal neighbours in that order are the repeats.

    Hot anchors, found in a sample that only plans the exchange, are dealt over keys by surroundings, and anchors
    with more than ``bucket`` surroundings are sorted in levels, so no task holds an unbounded group. Should two
    strings have equal 128 bits of hash and different bytes, the query fails and says so: run it with another ``seed``.

    Null text is empty; texts under ``length`` bytes lose nothing. Repeated rows of one doc_id and text are one
    document and get equal results; rows of one doc_id with other texts are documents of their own, in order of the
    text's sha256. Rows without id are returned whole. An empty table gives no rows. Other columns are ignored.
    length - gram must be under 256.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows, repeated = _keyed(docs)
    unique = _each_once(rows, repeated)
    anchors = unique.mapInArrow(_anchors(length, gram, seed, _hot_anchors(unique, length, gram, seed, hot)), _ANCHORS)
    ordered = anchors.repartition(n, "h", "mark").sortWithinPartitions("h", "g", "doc", "at")
    found = materialize(ordered.mapInArrow(_repeated(length), _FOUND))
    dealt = rows.repartition(n, "doc")  # one exchange of the texts, read by all joins below
    once = _each_once(dealt, repeated)
    ranges = [_ranges(found), *_sorted_levels(found.where(F.col("kind") == PIECE).select(F.col("h").alias("key"), "doc", "at"), once, length, bucket)]
    whole = found.where(F.col("kind") == WHOLE)
    first = F.shiftright("at", 16)
    ranges.append(whole.select("doc", first.alias("start"), (first + F.shiftright("at", 8).bitwiseAND(255) + length).alias("stop")))
    copies = whole.groupBy("doc").agg(F.collect_list(F.struct("at", "src", "src_at")).alias("wants"))
    copies = once.join(copies.hint("merge"), "doc").select("doc", "text", "wants").mapInArrow(_cut_copies(length), "src long, start long, piece binary")
    held = copies.hint("merge").join(once.withColumnRenamed("doc", "src"), "src")
    own = F.substring(F.col("text").cast("binary"), F.col("start").cast("int") + 1, F.length("piece"))
    wrong = held.where(own != F.col("piece"))
    stop = F.raise_error(F.lit("two strings have equal hashes and different bytes: run again with another seed")).cast("long")
    ranges.append(wrong.select("src", stop.alias("start"), stop.alias("stop")).toDF("doc", "start", "stop"))
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionByName(r)
    marks = every.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("marks")).hint("merge")
    out = dealt.join(marks, "doc", "left").select("doc_id", "text", "marks")
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, n - {LENGTH - 2})) AS p FROM d WHERE n >= {LENGTH}
), s AS (
  SELECT w.doc_id, p, row_number() OVER (PARTITION BY array_slice(b, p, p + {LENGTH - 1}) ORDER BY w.doc_id, p) AS k FROM w JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, p, p - {LENGTH} > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{LENGTH}) AS fresh FROM s WHERE k > 1
), q AS (
  SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM r
), gone AS (
  SELECT doc_id, min(p) AS lo, max(p) + {LENGTH - 1} AS hi FROM q GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN los IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(los) + 2),
    lambda i: array_slice(b, CASE WHEN i = 1 THEN 1 ELSE his[i - 1] + 1 END, CASE WHEN i > len(los) THEN n ELSE los[i] - 1 END)), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id)
"""


__all__ = ["OP9_SQL", "op9_suffix_dedup", "remove_repeats", "repeats_of"]
