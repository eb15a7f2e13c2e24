"""Token ids of word tables: a growing table of words seen, gathered for many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np


class Places(dict):
    """Numbers of words in the order in which they come; ``new`` holds the latest."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class WordTable:
    """Ids of each word seen, end to end in one array; a worker keeps one over its tasks.

    ``encode(words)`` gives the ids of words not seen before, one after the other, and how many
    each has; ``known`` are words whose ids are given so from the start. Past ``most`` words the
    table starts anew, which bounds the memory and changes no result.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 400_000, known: tuple[list, np.ndarray, np.ndarray] | None = None):
        self.encode, self.most, self.known = encode, most, known
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        if self.known:
            words, ids, sizes = self.known
            for word in words:
                self.place[word]
            self._take(ids, sizes)

    def _take(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the newest words."""
        count = len(self.place) - len(self.place.new)
        used = int(self.starts[count])
        self.ids = _grown(self.ids, used + len(ids))
        self.starts = _grown(self.starts, len(self.place) + 1)
        self.ids[used: used + len(ids)] = ids
        self.starts[count + 1: len(self.place) + 1] = used + np.cumsum(sizes)
        self.place.new = []

    def __call__(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words``, one after the other, and how many each has."""
        if len(self.place) > self.most:
            self.clear()
        found = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if new := self.place.new:
            self._take(*self.encode(new))
        return gather(self.ids, self.starts, found), self.starts[found + 1] - self.starts[found]


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    while len(a) < size:
        a = np.concatenate((a, np.zeros_like(a)))
    return a


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[starts[i]:starts[i + 1]]`` for each i of ``which``, end to end."""
    first = starts[which]
    sizes = starts[which + 1] - first
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]


def encoded(texts: Sequence, cut: Callable[[object], list], table: WordTable, most: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Ids of ``texts``, a part of them with about ``most`` characters at a time: the number of
    the part's first text and the ids of each of its texts. ``cut`` gives the words of a text."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(cut(text))
        size += len(text)
        if size >= most or i == len(texts) - 1:
            ids, sizes = table(list(chain.from_iterable(held)))
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(w) for w in held])]
            yield first, np.split(ids, ends[:-1])
            held, size, first = [], 0, i + 1
