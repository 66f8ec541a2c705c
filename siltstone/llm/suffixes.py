"""Suffix arrays, common prefixes and repeated windows of byte texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Parts texts; no UTF-8 text holds this byte.
SEPARATOR = 0xFF


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like them; zeros beyond the end."""
    padded = np.concatenate([x, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(x), dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(x)]
    return out


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The places of ``x`` (bytes) in the order of their suffixes; a suffix that ends first is smaller.

    Larsson-Sadakane: suffixes are sorted by their first eight bytes and get the number of their group's last place. Then
    each pass sorts the groups that have more than one member by the number that stands as far behind as all groups
    are sorted already, which doubles that depth. Groups of one are left alone.
    """
    n = len(x)
    words = _words(x)
    order = np.argsort(words, kind="stable")
    number = np.empty(n, dtype=np.int64)

    def renumbered(places: np.ndarray, changed: np.ndarray) -> np.ndarray:
        """Numbers the groups that begin where ``changed`` holds; the places of those with several members."""
        begins = np.flatnonzero(changed)
        sizes = np.diff(np.concatenate([begins, [len(places)]]))
        number[order[places]] = np.repeat(places[begins + sizes - 1], sizes)
        return places[np.repeat(sizes > 1, sizes)]

    if not n:
        return order
    keys = words[order]
    open_places = renumbered(np.arange(n), np.concatenate([[True], keys[1:] != keys[:-1]]))
    depth = 8
    while len(open_places):
        at = order[open_places]
        behind = at + depth
        second = np.where(behind < n, number[np.minimum(behind, n - 1)] + n + 1, n - at)
        keys = number[at] * (2 * n + 2) + second
        sort = np.argsort(keys)
        order[open_places], keys = at[sort], keys[sort]
        open_places = renumbered(open_places, np.concatenate([[True], keys[1:] != keys[:-1]]))
        depth *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each suffix shares with the one before it in ``order``; 0 for the first.

    Kasai: going through the text, the next suffix shares at least one byte less than the last one did. Where the bytes
    before the two suffixes are equal, it is exactly one less, so only the other places are compared, eight bytes at a
    time, and the rest follow as a running maximum of place plus length.
    """
    n = len(x)
    if not n:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    same = (before > 0) & (place > 0) & (x[place - 1] == x[np.maximum(before, 0) - 1])
    todo = np.flatnonzero((before >= 0) & ~same)
    length = np.zeros(n, dtype=np.int64)
    words = np.concatenate([_words(x), np.zeros(1, dtype=np.uint64)])
    a, b = todo.copy(), before[todo]
    while len(todo):
        apart = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        equal = np.zeros(len(todo), dtype=np.int64)
        for shift in range(56, -8, -8):
            equal += apart >> np.uint64(shift) == 0
        end = n - np.maximum(a, b)
        length[todo] += np.minimum(equal, np.maximum(end, 0))
        on = (equal == 8) & (end > 8)
        todo, a, b = todo[on], a[on] + 8, b[on] + 8
    running = np.maximum.accumulate(np.where(same, 0, length + place))
    return np.where(before >= 0, running - place, 0)[order]


class Shard:
    """The suffix array of several texts, and which of their windows of ``length`` bytes also start elsewhere in it.

    ``sizes`` are the numbers of windows of the texts, of which each has ``length`` - 1 more bytes. ``found`` marks the
    windows, by place in ``x``; ``begins`` has the places of the texts.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        mark = bytes([SEPARATOR])
        self.x = np.frombuffer(mark.join(texts) + mark, dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.cumsum(size + 1) - size - 1
        self.sizes = np.maximum(size - length + 1, 0)
        steps = np.zeros(len(self.x) + 1, dtype=np.int64)
        steps[self.begins] += self.sizes > 0
        np.subtract.at(steps, self.begins + self.sizes, self.sizes > 0)
        order = suffix_array(self.x)
        shared = common_prefixes(self.x, order)
        window = np.cumsum(steps[:-1])[order] > 0
        kind = np.cumsum(shared < length)[window]
        self.order = order[window]
        many = np.bincount(kind)[kind] > 1 if len(kind) else np.zeros(0, dtype=bool)
        self.first = np.concatenate([[True], kind[1:] != kind[:-1]])[: len(kind)]
        self.found = np.zeros(len(self.x), dtype=bool)
        self.found[self.order[many]] = True

    def run(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The different windows of the texts ``begin`` to ``end`` as sorted strings, and one place of each."""
        low, high = self.begins[begin], self.begins[end - 1] + self.sizes[end - 1]
        mine = (self.order >= low) & (self.order < high)
        kind = np.cumsum(self.first)[mine]
        at = self.order[mine][np.concatenate([[True], kind[1:] != kind[:-1]])[: len(kind)]]
        return strings(self.x, at, self.length), at


def strings(x: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    rows = np.lib.stride_tricks.sliding_window_view(x, length)[at] if len(at) else np.empty((0, length), dtype=np.uint8)
    return np.ascontiguousarray(rows).view(f"S{length}").ravel()


def merged(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted runs of different strings, merged by binary search: where each string of ``two`` goes in ``one``, and
    which strings of either are in the other too."""
    at = np.searchsorted(one, two)
    hit = np.zeros(len(two), dtype=bool)
    inside = at < len(one)
    hit[inside] = one[at[inside]] == two[inside]
    of_one = np.zeros(len(one), dtype=bool)
    of_one[at[hit]] = True
    return at, of_one, hit
