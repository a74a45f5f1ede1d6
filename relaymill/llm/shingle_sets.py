"""Word shingle sets of texts as sorted codes, and exact joins of a few sets. Runs inside tasks.

A shingle's code is a 64-bit number: a class of frequency in the top byte and 56 bits of its
hash below. Codes are ordered as numbers, so rare shingles come first in every set. Any class
table gives right results; a good one makes the first shingles of a set rare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from relaymill.llm import arrays

WIDTH = 4
COUNTERS = 1 << 22
BITMAP_BITS = 1024

# Similarity of 0.85 in whole numbers: overlap * 37 >= 17 * (size + size).
OVERLAP, SIZES = 37, 17


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes."""
    return -((-SIZES * (n + m)) // OVERLAP)


def prefix_length(n: int) -> int:
    """Two linked sets share a shingle among this many first ones of each."""
    return n - -(-85 * n // 100) + 1 if n else 0


def hashes(part: arrays.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, with repeats, and how many each document has."""
    part = part.lower()
    starts, ends, counts = part.words()
    words = part.hashes(starts, ends)
    windows, first = arrays.windows(words, counts, WIDTH)
    owner = arrays.owners(counts)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        at = np.concatenate(([0], np.cumsum(counts)))[short]
        whole = np.full(len(short), 0x51ED270B, dtype=np.uint64) + counts[short].astype(np.uint64)
        for k in range(WIDTH - 1):
            there = counts[short] > k
            whole[there] = arrays.mix(whole[there] * np.uint64(31) + words[at[there] + k])
        windows, owner = np.concatenate((windows, whole)), np.concatenate((owner[first], short))
        order = np.argsort(owner, kind="stable")
        windows, owner = windows[order], owner[order]
    else:
        owner = owner[first]
    return windows, np.bincount(owner, minlength=part.n)


def counted(text: pa.Array, counters: np.ndarray) -> None:
    """Add the shingles of the texts to a table of counters."""
    for _, _, part in arrays.slices(text):
        found, _ = hashes(part)
        np.add.at(counters, (found >> np.uint64(42)).astype(np.int64), 1)


def class_table(counts: np.ndarray) -> np.ndarray:
    """A class of frequency for every counter, in steps of nine per cent."""
    return np.minimum(255, 8 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)


def sets(text: pa.Array, classes: np.ndarray) -> list[np.ndarray]:
    """The sorted codes of every text's distinct shingles."""
    out = []
    for _, _, part in arrays.slices(text):
        found, counts = hashes(part)
        top = classes[(found >> np.uint64(42)).astype(np.int64)].astype(np.uint64)
        codes = (found >> np.uint64(8)) | (top << np.uint64(56))
        ends = np.cumsum(counts).tolist()
        begin = 0
        for end in ends:
            out.append(np.unique(codes[begin:end]))
            begin = end
    return out


def signature(codes: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    mixed = arrays.mix(codes & np.uint64((1 << 56) - 1))
    total = np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(codes))])
    return int(arrays.mix(total ^ arrays.mix(np.bitwise_xor.reduce(mixed, keepdims=True)))[0].astype(np.int64))


def bitmap(codes: np.ndarray) -> bytes:
    """Parity of the number of shingles per bit position."""
    place = (arrays.mix(codes & np.uint64((1 << 56) - 1)) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=BITMAP_BITS) & 1).tobytes()


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False only where bitmaps prove that sets differ in too many shingles.

    Every differing bit needs a shingle that only one of the two sets has.
    """
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return differ <= n + m - 2 * needed(n, m)


def pairs_in_lists(token, node, size, rest, most: int):
    """Candidate pairs from index lists, and the lists that are too long for pairs.

    The entries are sorted by token and then by set size; `rest` is the number of the set's
    shingles from this one on. A pair is passed over where even an overlap in all of the rest
    would be too small. Lists are in blocks of equal distance in the order of size: once no
    pair at some distance can meet the size bound, all greater distances are skipped.
    """
    change = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    length = np.diff(np.concatenate((change, [len(token)])))
    own = np.repeat(length, length)
    long = own > most
    first, second = [], []
    keep = np.flatnonzero(~long & (own > 1))
    token, node, size, rest, = token[keep], node[keep], size[keep], rest[keep]
    for distance in range(1, most):
        if distance >= len(token):
            break
        a, b = slice(None, -distance), slice(distance, None)
        near = (token[a] == token[b]) & (size[a] * 100 >= size[b] * 85)
        if not near.any():
            break
        at = np.flatnonzero(near)
        fits = np.minimum(rest[at], rest[at + distance]) >= needed(size[at], size[at + distance])
        at = at[fits & (node[at] != node[at + distance])]
        first.append(np.minimum(node[at], node[at + distance]))
        second.append(np.maximum(node[at], node[at + distance]))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(first or empty), np.concatenate(second or empty), long


class Index:
    """Inverted lists of some sets, sorted by size."""

    def __init__(self, members: list[np.ndarray]):
        self.size = np.array([len(s) for s in members], dtype=np.int64)
        _, token = np.unique(np.concatenate(members), return_inverse=True)
        owner = np.repeat(np.arange(len(members)), self.size)
        order = np.argsort(token, kind="stable")
        self.holders = owner[order]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(token))))
        self.tokens = np.split(token, np.cumsum(self.size)[:-1])

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of these tokens each set holds."""
        begin, length = self.begin[tokens], self.begin[tokens + 1] - self.begin[tokens]
        total = int(length.sum())
        shift = np.repeat(begin - (np.cumsum(length) - length), length)
        return np.bincount(self.holders[np.arange(total) + shift], minlength=len(self.size))


def linked(members: list[np.ndarray]) -> np.ndarray:
    """For sets sorted by size: the index of the first set that links reach, for each set.

    The overlaps of one set with all others are its answers. Where the next set is much like
    it, its answers are derived: only the lists of the shingles in which the two differ are
    read, and their counts added or taken away.
    """
    label = np.arange(len(members))
    if len(members) == 2:
        both = len(np.intersect1d(members[0], members[1], assume_unique=True))
        if OVERLAP * both >= SIZES * (len(members[0]) + len(members[1])):
            label[1] = 0
        return label
    index = Index(members)
    known, before = None, None
    for i, tokens in enumerate(index.tokens):
        if known is not None:
            gone = np.setdiff1d(before, tokens, assume_unique=True)
            new = np.setdiff1d(tokens, before, assume_unique=True)
            known = None if len(gone) + len(new) >= len(tokens) else known
        if known is None:
            known = index.overlaps(tokens)
        else:
            known = known + index.overlaps(new) - index.overlaps(gone)
        before = tokens
        hits = np.flatnonzero(OVERLAP * known >= SIZES * (index.size + index.size[i]))
        roots = np.unique(label[hits])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    return label
