"""Packing token sequences into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spans_of, utf8_bytes
from .kernels import U64, Rolling, lower_ascii, mix, words

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: Windows that a packing task holds open.
OPEN = 64
#: Words a worker keeps the ids of; when full it starts anew. About 30 bytes each.
CACHED_WORDS = 1_000_000
#: ASCII signs that the tokenizer splits from a word before them, when they end it.
_TAIL = b".,!*$%&#;:?)(|\""


class WordTokenizer:
    """Ids of whole texts, by the tokenizer's own encoding of each distinct word.

    The vocabulary lower-cases, drops white space and never joins across it, so a text's ids are its words' ids
    end to end; trailing signs after an ASCII letter or digit are words of their own for it too. Words are
    looked up by 64-bit hash with a second 64-bit hash compared; unknown words go to the tokenizer. A word with
    "<" (it may hold a special token) is never looked up.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(path), cached_words
        self._clear()
        self.is_tail, self.is_plain = np.zeros(256, bool), np.zeros(256, bool)
        self.is_tail[list(_TAIL)] = True
        self.is_plain[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(0, U64), np.zeros(0, U64)
        self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut trailing signs off; the parts' starts and ends in order, and the word of each."""
        tail = np.concatenate([self.is_tail[low], [False]])
        # the start of the run of tail signs that ends at each place
        other = np.flatnonzero(~tail[: len(low)])
        last = other[np.maximum(np.searchsorted(other, e) - 1, 0)] if len(other) else np.full(len(e), -1)
        cut = np.where((last >= s) & (last + 1 < e) & self.is_plain[low[np.maximum(last, 0)]], last + 1, e) if len(other) else e
        split = cut < e
        word = np.repeat(np.arange(len(s)), 1 + split)
        first = np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)
        return np.where(first, s[word], cut[word]), np.where(first, cut[word], e[word]), word

    def __call__(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end (without END_ID), and their offsets."""
        low = lower_ascii(raw)
        s, e, first = words(low, off)
        ps, pe, word = self._parts(low, s, e)
        roll = Rolling(low)
        key = roll.hash(ps, pe)
        angle = np.concatenate([[0], np.cumsum(low == ord("<"))])
        odd = angle[pe] > angle[ps]
        uniq, one, back = np.unique(key, return_index=True, return_inverse=True)
        check = self._second(low, ps[one], pe[one])
        place = np.searchsorted(self.keys, uniq)
        inside = np.minimum(place, max(len(self.keys) - 1, 0))
        known = (self.keys[inside] == uniq) & (self.checks[inside] == check) if len(self.keys) else np.zeros(len(uniq), bool)
        lengths = np.zeros(len(uniq), np.int64)
        starts = np.zeros(len(uniq), np.int64)
        lengths[known], starts[known] = self.len[inside[known]], self.at[inside[known]]
        new = np.flatnonzero(~known)
        got = self._encode([bytes(low[a:b]).decode("utf-8", "replace") for a, b in zip(ps[one[new]], pe[one[new]], strict=True)])
        lengths[new] = [len(x) for x in got]
        fresh = np.array([i for x in got for i in x], np.uint32)
        starts[new] = len(self.ids) + np.cumsum(lengths[new]) - lengths[new]
        pool = np.concatenate([self.ids, fresh])
        keep = new[~odd[one[new]]]
        keys = np.concatenate([self.keys, uniq[keep]])
        if len(keys) > self.limit or len(pool) > 8 * self.limit:
            self._clear()
        else:
            order = np.argsort(keys, kind="stable")
            self.keys, self.checks = keys[order], np.concatenate([self.checks, check[keep]])[order]
            self.at, self.len, self.ids = np.concatenate([self.at, starts[keep]])[order], np.concatenate([self.len, lengths[keep]])[order], pool
        n, at = lengths[back], starts[back]
        if odd.any():  # special tokens are case-sensitive: encode these words as they stand
            which = np.flatnonzero(odd)
            got = self._encode([bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(ps[which], pe[which], strict=True)])
            n[which] = [len(x) for x in got]
            at[which] = len(pool) + np.cumsum(n[which]) - n[which]
            pool = np.concatenate([pool, np.array([i for x in got for i in x], np.uint32)])
        ends = np.cumsum(n)
        ids = pool[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])
        return ids, bounds[np.searchsorted(word, first)]

    @staticmethod
    def _second(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Another hash: of the words' lengths, first eight and last eight bytes."""
        acc = mix((e - s).astype(U64) ^ U64(0x2545F4914F6CDD1D))
        for i in range(8):
            acc = acc * U64(257) + low[np.minimum(s + i, e - 1)].astype(U64)
            acc = acc * U64(263) + low[np.maximum(e - 1 - i, s)].astype(U64)
        return mix(acc)


class SumOfSquares:
    """Online packing with a level array: count[h] open windows are filled to level h, at most ``most`` in all.

    A piece goes to the level (or a new window) whose choice leaves the smallest sum of count[h]**2 over partly
    filled levels; of equal choices the fullest window wins. When ``most`` windows are open none is opened: the
    choice is then also among completing a window with the front of the piece, the rest being placed anew.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.count = [0] * (window + 1)
        self.levels: set[int] = set()  # those with an open window
        self.open = 0

    def place(self, size: int) -> int:
        """The level to put a piece of ``size`` (1 .. window - 1) on; 0 opens a window. A level above window - size
        takes only the front of the piece."""
        w, c = self.window, self.count
        full = self.open >= self.most
        best, least = 0, w * w if full else 2 * c[size] + 1
        for h in self.levels:
            reach = h + size
            if reach > w and not full:
                continue
            cost = (2 * c[reach] + 1 if reach < w else 0) - (2 * c[h] - 1)
            if cost < least or (cost == least and h > best):
                best, least = h, cost
        return best

    def move(self, level: int, size: int) -> None:
        """A piece of ``size`` goes on ``level`` (0: a new window)."""
        if level:
            self.count[level] -= 1
            self.open -= 1
            if not self.count[level]:
                self.levels.remove(level)
        if level + size < self.window:
            self.count[level + size] += 1
            self.open += 1
            self.levels.add(level + size)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, poured boolean"


def _packer(path: str, window: int, with_ids: bool, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 32
        encode, level = WordTokenizer(path), SumOfSquares(window, most)
        held: dict[int, list[list[tuple]]] = {}  # open windows by level, each a list of (doc, start, ids, doc_tokens)
        rows: list[tuple] = []

        def emit(pieces: list[tuple], poured: bool = False) -> None:
            nonlocal next_id
            at = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, next_id, at, poured)
                rows.append((*row, ids) if with_ids else row)
                at += len(ids)
            next_id += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(8 + with_ids)]
            out = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.bool_())] + [pa.array(c, pa.list_(pa.int32())) for c in cols[8:]]
            names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            raw, off = utf8_bytes(batch.column("text"))
            for i, j in spans_of(off):
                ids, bounds = encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                for n in range(j - i):
                    own = np.concatenate([ids[bounds[n] : bounds[n + 1]], np.array([END_ID], np.uint32)]).astype("<u4")
                    total, at = len(own), 0
                    while total - at >= window:
                        emit([(docs[i + n], at, own[at : at + window], total)])
                        at += window
                    while at < total:
                        h = level.place(total - at)
                        size = min(total - at, window - h)
                        level.move(h, size)
                        pieces = held[h].pop() if h else []
                        pieces.append((docs[i + n], at, own[at : at + size], total))
                        at += size
                        if h + size == window:
                            emit(pieces)
                        else:
                            held.setdefault(h + size, []).append(pieces)
            yield flush()
        # what is left in open windows is poured into full ones, pieces cut where a window ends; the last part is
        # laid out as windows whose lengths are powers of two, which need no padding
        pieces = [p for h in sorted(held, reverse=True) for x in held[h] for p in x]
        rest = sum(len(p[2]) for p in pieces)
        room, now = 0, []
        target = lambda: window if rest >= window else 1 << (rest.bit_length() - 1)
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room = target()
                    now = []
                take = min(room, len(ids) - at)
                now.append((doc, start + at, ids[at : at + take], total))
                at, room, rest = at + take, room - take, rest - take
                if not room:
                    emit(now, True)
        yield flush()

    return run


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False, most_open: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, poured (and ids if asked for).

    A document is its ids and END_ID. Whole windows are cut off its front; the remainder is placed online by
    the sum-of-squares rule, and cut only where that completes a window while ``most_open`` are open. Each input
    partition packs as one stream, so nothing is shuffled and a hot source or group is only more rows. Memory is
    ``most_open`` windows. Those still open at a partition's end (under ``most_open * window`` tokens, whatever the
    partition's size; ``poured`` says which) are poured together and end in windows of a power of two. sequence_id
    is partition number * 2**32 + window number: a task that runs again gives the same rows.

    Null and empty texts are the end id alone. Repeated rows are packed each. Null ids stay null. An empty table
    gives no rows. Other columns are ignored. ``vocabulary`` must be readable at the same path on each executor.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return src.mapInArrow(_packer(vocabulary, window, with_ids, most_open), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_vocabulary())
