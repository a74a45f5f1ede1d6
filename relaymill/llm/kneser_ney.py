"""Interpolated modified Kneser-Ney over byte n-grams, in arrays. Runs inside tasks.

An n-gram is one integer of up to ORDER bytes, the first byte on top. Orders are kept apart,
so no length is stored. For orders below the highest, counts are continuation counts: the
number of different bytes seen before the n-gram.

With a(g) the count of g = hw, D the discounts of the order and h' the history without its
first byte:   p(w|h) = (a(hw) - D(a)) / a(h.) + gamma(h) p(w|h'),   where gamma(h) is the mass
that the discounts free. Unigrams are interpolated with the uniform distribution.

A model is cut into shards by the two bytes before the last one. All n-grams of three bytes
and more that the probability of one n-gram depends on lie in its shard; those of two bytes
and less are at most 65,792 numbers and go to every shard.
"""

from __future__ import annotations

import numpy as np

from relaymill.llm import arrays

ORDER = 5
_MASKS = [(1 << (8 * k)) - 1 for k in range(ORDER + 1)]


def codes(part: arrays.Slice) -> tuple[np.ndarray, np.ndarray]:
    """All ORDER-grams within documents, in order, and how many each document has."""
    data = part.data.astype(np.int64)
    total = max(0, len(data) - ORDER + 1)
    out = np.zeros(total, dtype=np.int64)
    for k in range(ORDER):
        out <<= 8
        out |= data[k : k + total]
    lengths = np.diff(part.offsets)
    counts = np.maximum(lengths - ORDER + 1, 0)
    if part.n == 1:
        return out, counts
    at = np.arange(int(counts.sum())) + np.repeat(part.offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return out[at], counts


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the two bytes before the last one; for three bytes and more."""
    pair = ((grams >> 8) & 0xFFFF).astype(np.uint64)
    return (arrays.mix(pair) % np.uint64(shards)).astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams with count 1 to 4."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


class Level:
    """The n-grams of one order in a shard: probabilities, and weights of their histories."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, cut: tuple[float, float, float], lower):
        order = np.argsort(grams)
        self.grams, counts = grams[order], counts[order]
        history = self.grams >> 8
        first = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1]))) if len(grams) else np.zeros(0, np.int64)
        self.histories = history[first]
        taken = np.array([0.0, *cut])[np.minimum(counts, 3)]
        total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
        self.gamma = (np.add.reduceat(taken, first) / total) if len(first) else np.zeros(0)
        within = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(counts)]))))
        self.p = (counts - taken) / total[within] + self.gamma[within] * lower(self.grams) if len(grams) else np.zeros(0)

    def __call__(self, grams: np.ndarray, lower) -> np.ndarray:
        """Probabilities of any n-grams, given those of the next lower order."""
        out = lower(grams)
        if not len(self.grams):
            return out
        history = grams >> 8
        at = np.minimum(np.searchsorted(self.histories, history), len(self.histories) - 1)
        out = out * np.where(self.histories[at] == history, self.gamma[at], 1.0)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.p[at], out)


def short_probabilities(bigrams: np.ndarray, counts: np.ndarray, unigram_counts: np.ndarray, cut1, cut2) -> np.ndarray:
    """Probabilities of all 65,536 bigrams; `unigram_counts` has 256 entries."""
    total = unigram_counts.sum()
    taken = np.array([0.0, *cut1])[np.minimum(unigram_counts, 3)]
    if total:
        unigram = (unigram_counts - taken) / total + taken.sum() / total / 256
    else:
        unigram = np.full(256, 1 / 256)
    level = Level(bigrams, counts, cut2, lambda g: unigram[g & 0xFF])
    return level(np.arange(1 << 16), lambda g: unigram[g & 0xFF])


class Shard:
    """All levels of three bytes and more of a shard."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, np.ndarray]], cuts: dict[int, tuple], short: np.ndarray):
        self.levels = []
        below = lambda g: short[g & 0xFFFF]
        for order in range(3, ORDER + 1):
            grams, counts = rows.get(order, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            mask = _MASKS[order - 1]
            lower = lambda g, f=below, m=mask: f(g & m)
            level = Level(grams, counts, cuts[order], lower)
            below = lambda g, l=level, f=lower: l(g, f)
        self.probability = below


class Distinct:
    """The distinct codes among many, with their counts, in bounded memory per step."""

    LIMIT = 1_500_000

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, found: np.ndarray) -> None:
        unique, counts = np.unique(found, return_counts=True)
        self.parts.append((unique, counts))
        self.waiting += len(unique)
        if self.waiting > self.LIMIT and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            unique, at = np.unique(np.concatenate([u for u, _ in self.parts]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([c for _, c in self.parts]))
            self.parts = [(unique, counts.astype(np.int64))]
        self.waiting = len(self.parts[0][0])
        return self.parts[0]
