"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

from .kernels import U64, eight_bytes

#: Bytes that the multikey quicksort reads; suffixes equal that far are ordered by blind tries.
SHALLOW = 48


def multikey_quicksort(word: np.ndarray, pos: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order suffixes by group and their first ``shallow`` bytes.

    ``word`` holds the eight bytes at each place: one character of the sort. Every round takes the segments that
    are still open, splits each by a pivot character of its own into less, equal and greater, and only the equal
    part goes on to the next character. Returns the order and the starts and sizes of segments left equal.
    """
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    start, size = edge, np.diff(np.append(edge, len(order)))
    depth = np.zeros(len(start), np.int64)
    deep: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        done = (depth >= shallow) & (size > 1)
        deep.append((start[done], size[done]))
        go = (size > 1) & ~done
        start, size, depth = start[go], size[go], depth[go]
        if not len(start):
            break
        seg = np.repeat(np.arange(len(start)), size)
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(len(seg))
        who = order[at]
        key = word[pos[who] + depth[seg]]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]  # the median of three
        less, same = key < pivot, key == pivot
        n_less, n_same = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)
        nth = lambda mask: np.cumsum(mask) - np.repeat(np.cumsum(np.add.reduceat(mask, first, dtype=np.int64)) - np.add.reduceat(mask, first, dtype=np.int64), size) - 1  # noqa: B023, E731
        more = ~(less | same)
        put = start[seg] + np.where(less, nth(less), np.where(same, n_less[seg] + nth(same), (n_less + n_same)[seg] + nth(more)))
        order[put] = who
        start = np.concatenate([start, start + n_less, start + n_less + n_same])
        size = np.concatenate([n_less, n_same, size - n_less - n_same])
        depth = np.concatenate([depth, depth + 8, depth])
    return order, np.concatenate([d[0] for d in deep]), np.concatenate([d[1] for d in deep])


class BlindTrie:
    """Orders strings of one length by storing branching depths and bytes only: an insertion descends blindly to a
    leaf, compares once with its string, and branches where the two differ. Equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: list | tuple | None = None

    def insert(self, text: bytes, who: int) -> None:
        node = self.root
        if node is None:
            self.root = (text, [who])
            return
        path = []
        while type(node) is list:
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(who)
            return
        differ = int.from_bytes(text) ^ int.from_bytes(node[0])
        at = len(text) - (differ.bit_length() + 7) // 8
        above = 0
        while above < len(path) and path[above][0] < at:
            above += 1
        below = path[above] if above < len(path) else node
        if type(below) is list and below[0] == at:
            below[1][text[at]] = (text, [who])
            return
        branch = [at, {node[0][at]: below, text[at]: (text, [who])}]
        if above:
            path[above - 1][1][text[path[above - 1][0]]] = branch
        else:
            self.root = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def deep_shallow_order(data: np.ndarray, word: np.ndarray, pos: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the suffixes of ``data`` at ``pos`` by group and their first ``length`` bytes."""
    shallow = min(shallow, length // 8 * 8)
    order, start, size = multikey_quicksort(word, pos, group, shallow)
    if shallow >= length:
        return order
    raw = data.tobytes()
    two = size == 2
    if two.any():  # a trie of two leaves: one comparison
        s = start[two]
        a, b = order[s], order[s + 1]
        swap = np.zeros(len(s), bool)
        open_ = np.ones(len(s), bool)
        for at in [*range(shallow, length - 7, 8), length - 8]:
            x, y = word[pos[a] + at], word[pos[b] + at]
            swap |= open_ & (x > y)
            open_ &= x == y
        order[s], order[s + 1] = np.where(swap, b, a), np.where(swap, a, b)
    for s, n in zip(start[~two].tolist(), size[~two].tolist(), strict=True):
        trie = BlindTrie()
        for i in order[s : s + n].tolist():
            p = int(pos[i])
            trie.insert(raw[p + shallow : p + length], i)
        order[s : s + n] = trie.ordered()
    return order


def equal_neighbours(word: np.ndarray, pos: np.ndarray, group: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``order`` but the first: does it share ``length`` bytes and the group with the one before?"""
    a, b = order[:-1], order[1:]
    same = group[a] == group[b]
    left = np.flatnonzero(same)
    for at in [*range(0, length - 7, 8), length - 8]:
        left = left[word[pos[a[left]] + at] == word[pos[b[left]] + at]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


__all__ = ["BlindTrie", "SHALLOW", "U64", "deep_shallow_order", "eight_bytes", "equal_neighbours", "multikey_quicksort"]
